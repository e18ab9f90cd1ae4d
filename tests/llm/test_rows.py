"""Operators that hand rows on judge each by itself and keep columns of any name."""

import pytest
from pyspark.sql import functions as F

from kerbside.llm import decontaminate, jaccard, langid, linededup, mixing, toxicity
from tests.llm.helpers import documents

NAMES = ["_id", "_dropped", "_kept", "_copy", "_source", "_size", "_target", "_copies", "_text", "key", "copy", "copies", "doc", "c", "no", "sig", "h1", "h2", "band", "component", "target", "source_size", "hits", "items", "dropped", "a.b"]
ROWS = [(1, "Copied text of some words here"), (3, "copied text of some words here"), (3, "another text altogether, with words"), (None, "a text without any id at all"), (None, None), (3, None), (7, "")]


@pytest.fixture(scope="module")
def docs(spark):
    d = documents(spark, ROWS)
    for k, name in enumerate(NAMES):
        d = d.withColumn(name, F.lit(k))
    return d


def told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_deduplicate(docs):
    out = jaccard.deduplicate(docs)
    assert out.columns == docs.columns and out.schema["_kept"] == docs.schema["_kept"]
    assert told(out) == sorted([x for x in ROWS if x != ROWS[1]], key=repr)
    assert {r["_kept"] for r in out.collect()} == {NAMES.index("_kept")}


def test_dedup_lines(spark, docs):
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns and told(out) == sorted([(i, "" if k == 1 else t) for k, (i, t) in enumerate(ROWS)], key=repr)
    twice = linededup.dedup_lines(documents(spark, [(1, "one line\ntwo lines"), (1, "one line\ntwo lines"), (1, "three lines")]))
    assert sorted(r.text for r in twice.collect()) == ["", "one line\ntwo lines", "three lines"]


def test_mix_and_decontaminate(spark, docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {r["_copy"] for r in out.collect()} <= {NAMES.index("_copy")}
    items = spark.createDataFrame([(1, "another text altogether")], "item_id bigint, text string")
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and told(left) == sorted([x for x in ROWS if "another" not in (x[1] or "")], key=repr)


def test_added_columns_replace_those_of_the_same_name(spark, docs):
    d = docs.withColumn("score", F.lit("x")).withColumn("spans", F.lit("x")).withColumn("lang_pred", F.lit("x"))
    field = toxicity.Field()
    out = toxicity.score_documents(d, field)
    assert dict(out.dtypes)["score"] == "double" and out.columns.count("spans") == 1 and {r.score for r in out.collect()} == {0.0}
    out = langid.identify(d, langid.Model([], []))
    assert out.columns.count("score") == 1 and {(r.lang_pred, r.score) for r in out.collect()} == {("und", 0.0)}
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.clean(d, labels)
    assert kept.columns == d.columns and kept.count() == len(ROWS)
