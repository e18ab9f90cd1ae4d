"""The pipeline against the same decisions taken in plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from kerbside.llm import mixing, tokens_out
from tests.llm import test_decontaminate, test_jaccard, test_mixing
from tests.llm.helpers import documents, write


def corpus():
    r = random.Random(12)
    plain = ["".join(r.choice("abcdeéghil") for _ in range(r.randint(2, 7))) for _ in range(900)]
    say = lambda n: " ".join(r.choice(plain) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (3, say(4))]
    docs, labels, toxic = [], [], set()
    for k in range(0, 600, 2):
        text = say(r.randint(20, 90))
        if k % 8 == 0:
            text += " zorgut" + r.choice(["", "en", "tion"])
            toxic.add(k)
        elif k % 14 == 0:
            text = say(30) + " " + items[r.randrange(3)][1] + " " + say(30)
        docs += [(k, text)] + ([(k + 1, text.upper() if r.random() < 0.5 else text + " ok")] if k % 6 == 0 else [])
        toxic |= {k + 1} & {d for d, _ in docs} if k in toxic else set()
    docs += [(2000, None), (2001, ""), (2002, "one")]
    labels = [(i, 1, int(i in toxic)) for i, _ in docs]
    return docs, labels, toxic, items


def test_stages(spark, tmp_path):
    docs, labels, toxic, items = corpus()
    table = documents(spark, docs, extra=False)
    folder = write(spark, tmp_path, documents=table, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
                   benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted((tuple(x) for x in P.run(spark, folder).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    kept = [d for d in docs if d[0] not in toxic]
    low = {i: c for i, _, c in test_jaccard.brute(kept)}
    kept = [d for d in kept if low[d[0]] == d[0]]
    bad = test_decontaminate.brute(kept, items)
    kept = [d for d in kept if not bad[d[0]][4]]
    assert len(kept) < 260
    size = {i: len((t or "").split()) for i, t in kept}
    source = {i: f"s{i % 3}" for i, _ in kept}
    sums = Counter()
    for i in size:
        sums[source[i]] += size[i]
    goal = test_mixing.brute_targets(dict(sums))
    import hashlib

    want, start = [], 0
    plain = Tokenizer.from_file(public_tokenizers.path(tokens_out.VOCABULARY))
    for i, t in sorted(kept):
        rate = goal[source[i]] / sums[source[i]]
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        ids = plain.encode(t or "", add_special_tokens=False).ids + [tokens_out.END_ID]
        for _ in range(int(rate) + (u < rate - int(rate))):
            want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == want


def test_columns(spark, tmp_path):
    docs, labels, _, items = corpus()
    table = documents(spark, docs[:40], extra=False)
    folder = write(spark, tmp_path, labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame(items, "item_id bigint, text string"))
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns
        assert stage(spark, table.limit(0), folder).count() == 0
