import random

import numpy as np
import pyarrow as pa

from kerbside.llm import langid as G
from tests.llm.helpers import DOCS, documents, write

SYLLABLES = {
    "en": "the and ing er on st ea".split(), "de": "sch ung der ich ein ö ß".split(), "fr": "eau tion é les ou ç".split(),
    "es": "ción ñ que os ll ar".split(), "xx": "zq wj kx vv".split(),
}


def corpus(n=900):
    r = random.Random(6)
    rows = []
    for k in range(n):
        lang = r.choice(list(SYLLABLES))
        text = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(12, 60)))
        rows.append((k, text.capitalize() + r.choice([".", "! 12", "\n"]), lang, "s", 1))
    return rows


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    odd = [(5000, None, "en", "s", 0), (5001, "12 -- !", "en", "s", 0), (5002, "", None, "s", 0), (5003, "the and ing " * 9000, None, "s", 0)]
    folder = write(spark, tmp_path, documents=spark.createDataFrame(rows + odd, DOCS))
    got = {x.doc_id: x for x in G.digest(spark, folder).collect()}
    truth = {x[0]: x[2] for x in rows}
    held = [got[i].lang_pred == t for i, t in truth.items() if got[i].held_out]
    assert len(got) == len(rows) + 4 and len(held) > 150 and np.mean(held) > 0.97
    assert [got[i].lang_pred for i in (5000, 5001, 5002, 5003)] == ["und", "und", "und", "en"]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[5000].score == 0


def test_few_languages(spark):
    d = documents(spark, [(1, "abc"), (1, "abc"), (2, None)])
    assert [x.lang_pred for x in G.identify(d, G.Model([], [])).collect()] == ["und"] * 3
    one = G.identify(d, G.Model(["hello there", "hello you"], ["en", "en"])).collect()
    assert [x.lang_pred for x in one] == ["en", "en", "und"] and G.identify(d.limit(0), G.Model([], [])).count() == 0


def test_pairs_stay_within_texts():
    pairs, triples, doc = G.cells(pa.array(["ab", None, "c", "De f"]))
    assert [(d, p) for d, p in zip(doc.tolist(), pairs.tolist()) if p >= 0] == [(0, 0x6162), (3, 0x6465), (3, 0x6520), (3, 0x2066)]
    assert (triples >= 0).sum() == 2
