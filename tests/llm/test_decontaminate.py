import hashlib
import random
import re

from kerbside.llm import decontaminate as D
from tests.llm.helpers import documents, write

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            x = words(text)
            size = min(13, len(x))
            for a in range(len(x) - size + 1) if x else ():
                for b in range(len(w) - size + 1):
                    if w[b : b + size] == x[a : a + size]:
                        hit.update(range(b, b + size))
                        ids.add(str(item))
        ids = sorted(ids)
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def cases():
    r = random.Random(5)
    vocabulary = ["alpha", "béta", "Gamma", "d4", "e", "ß", "the", "of"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".", "\n"]) for _ in range(n))
    items = [(10, say(30)), (9, say(13)), (2, say(5)), (3, "Solo"), (4, ""), (5, None), (6, "!!"), (7, say(14)), (9, say(20))]
    docs = [(0, None), (1, ""), (2, "--"), (3, "solo SOLO no"), (4, say(4000))]
    docs += [(5 + k, say(20) + " " + items[k % 4][1] + "\t" + say(r.randint(0, 300))) for k in range(20)]
    docs += [(40, items[0][1].upper()), (41, items[0][1][: len(items[0][1]) // 2]), (42, "ÉÉ " + items[1][1])]
    return docs, items


def test_against_brute_force(spark, tmp_path):
    docs, items = cases()
    folder = write(spark, tmp_path, documents=documents(spark, docs), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in D.digest(spark, folder).collect()}
    assert got == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = cases()
    d, b = documents(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")
    one, many = ({r.doc_id: r for r in D.contamination(d, b, block_chars=n).collect()} for n in (10**6, 60))
    assert one == many


def test_offsets_are_of_the_original(spark):
    text = "Ünder — the Quick, BROWN fox; ok"
    d = documents(spark, [(1, text)])
    b = spark.createDataFrame([(1, "the quick brown FOX")], "item_id bigint, text string")
    h = D.contamination(d, b).first().hits[0]
    assert text[h.start : h.end] == "the Quick, BROWN fox"


def test_empty_tables_and_filter(spark):
    d, b = documents(spark, [(1, "a b c"), (1, "x y z"), (2, None)]), spark.createDataFrame([], "item_id bigint, text string")
    assert D.decontaminate(d, b).count() == 3
    assert D.decontaminate(d.limit(0), b).count() == 0
    hit = D.decontaminate(d, spark.createDataFrame([(1, "a b")], "item_id bigint, text string"))
    assert hit.columns == d.columns and sorted((r.doc_id, r.text) for r in hit.collect()) == [(1, "x y z"), (2, None)]


def test_benchmarks_of_one_session_are_kept_apart(spark):
    """Workers are used again; none may scan with the benchmark of an earlier call."""
    d = documents(spark, [(k, f"start word{k} other{k} end") for k in range(12)])
    for k in range(12):
        b = spark.createDataFrame([(k, f"word{k} other{k}")], "item_id bigint, text string")
        hit = D.contamination(d, b).where("size(hits) > 0").collect()
        assert [(r.doc_id, r["items"]) for r in hit] == [(k, [str(k)])]
