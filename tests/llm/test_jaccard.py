import random
import re

from kerbside.llm import jaccard as J
from kerbside.llm.components import connected_components
from tests.llm.helpers import documents, write

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), i), i)
    return sorted((i, len(sets[k]), low[root(k)] if sets[k] else i) for k, (i, _) in enumerate(docs))


def corpus(seed):
    r = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 30 + [f"w{k}" for k in range(400)] + ["Éa", "ß\x00x"]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, texts = say(30), []
    for _ in range(12):
        base = say(r.choice([4, 9, 20, 60, 200]))
        for _ in range(r.randint(1, 14)):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 25))):
                at = r.randrange(len(own))
                own[at : at + r.randint(0, 1)] = say(r.randint(0, 2))
            texts.append(r.choice([" ", "  ", "\n"]).join(own))
        texts.append(" ".join(passage + say(12)))
        texts.append(" ".join(passage).upper())
    texts += [None, "", " \t", "a", "A", "a b", "b a", "x y z", "x y z x y z", " ".join(say(3000))]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts))


def test_against_brute_force(spark, tmp_path):
    for seed in (1, 2):
        docs = corpus(seed)
        folder = write(spark, tmp_path, documents=documents(spark, docs).repartition(3))
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in J.digest(spark, folder).collect()) == brute(docs)


def test_deduplicate_and_empty(spark):
    d = documents(spark, [(3, "a b c d"), (1, "A b  c d"), (2, "z"), (2, "z"), (5, None), (6, None)])
    out = J.deduplicate(d)
    assert out.columns == d.columns and sorted(x.doc_id for x in out.collect()) == [1, 2, 5, 6]
    assert J.jaccard_components(d.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (300, 300), (None, 3), (200, 201), (201, 200)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 300: 300, 200: 200, 201: 200}


def test_lists_take_one_shuffle_and_no_row_objects(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans, write_table = {}, J.materialise

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write_table(df, name)

    def refuse(self):
        raise AssertionError("a row object for each bucket on the driver")

    monkeypatch.setattr(J, "materialise", watched)
    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    docs = corpus(3)
    got = J.jaccard_components(documents(spark, docs)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs)
    assert plans["lists"].count("Exchange") == 1
