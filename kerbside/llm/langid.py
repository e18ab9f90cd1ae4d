"""Language identification in two steps: the family first, then the language within it.

Features are relative frequencies of byte pairs and hashed byte triples of the text,
in lower case and with all but letters as blanks; the ``FEATURES`` most frequent of
the training sample count.  One linear support vector machine for each family against
the others picks the family; within it, machines for each pair of languages vote, and
ties go to the larger sum of margins, then to the first name.  Languages without a
known family form one of their own.

The fit takes at most about ``SAMPLE_ROWS`` labelled documents, an equal number of
each language, and ``SAMPLE_CHARS`` characters, chosen by a hash of the id.

Cases: a text that is null or has no letter is ``und`` with score 0; with a single
learned language all others are that language; without any, all are ``und``; rows
that repeat an id are judged each by its own text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.textvec import as_rows, from_rows, map_batches, raw, slices

SAMPLE_ROWS = 2400
SAMPLE_CHARS = 12_000_000
FEATURES = 1500
TRIPLE_BITS = 17
CELLS = (1 << 16) + (1 << TRIPLE_BITS)

#: Families of languages, by ISO 639-1 codes.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz", "tk", "ky"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne", "si"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "am", "mt"],
    "austronesian": ["id", "ms", "tl", "jv"],
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_TABLE = np.full(256, 0x20, np.uint8)
_TABLE[0x61:0x7B] = _TABLE[0x41:0x5B] = np.arange(0x61, 0x7B)
_TABLE[0x80:] = np.arange(0x80, 0x100)


def cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells of byte pairs, cells of byte triples, text of each byte); -1 where a pair or triple leaves its text or is blank."""
    data, offsets = raw(texts)
    b = _TABLE[data].astype(np.int32)
    n = len(b)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pairs, triples = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    if n > 1:
        code = b[:-1] << 8 | b[1:]
        pairs[:-1] = np.where((doc[:-1] == doc[1:]) & (code != 0x2020), code, -1)
    if n > 2:
        code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint32) * np.uint32(2654435761)
        cell = (code >> np.uint32(32 - TRIPLE_BITS)).astype(np.int32) + (1 << 16)
        triples[:-2] = np.where((doc[:-2] == doc[2:]) & (pairs[:-2] >= 0), cell, -1)
    return pairs, triples, doc


def matrix(texts: pa.Array, index: np.ndarray, size: int) -> np.ndarray:
    """Relative frequencies of the indexed features, a row for each text."""
    pairs, triples, doc = cells(texts)
    n = len(texts)
    out = np.zeros(n * (size + 1))
    for found in (pairs, triples):
        out += np.bincount(doc * (size + 1) + index[found], minlength=len(out))
    out = out.reshape(n, size + 1)
    return out[:, :size] / np.maximum(1, out.sum(axis=1))[:, None]


def machine(x: np.ndarray, y: np.ndarray, rounds: int = 120, ridge: float = 1e-3) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by accelerated gradient descent; y is -1 or 1."""
    x = np.concatenate((x, np.ones((len(x), 1))), axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    # largest eigenvalue of the weighted second moments bounds the curvature
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= top or 1
    step = 1 / (2 * top * 1.1 + ridge)
    w = z = np.zeros(x.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        new = z - step * (-2 * x.T @ (weight * y * slack) + ridge * z)
        z, w = new + k / (k + 3) * (new - w), new
    return w


class Model:
    """Families, pairs of languages and the weights of their machines."""

    def __init__(self, texts: list[str], langs: list[str], features: int = FEATURES):
        self.langs = sorted(set(langs))
        families = sorted({_FAMILY.get(x, x) for x in self.langs})
        self.families = [(f, [x for x in self.langs if _FAMILY.get(x, x) == f]) for f in families]
        self.index, self.size = np.full(CELLS + 1, 0, np.int32), 0
        if not self.langs:
            return
        chunks = [pa.array(texts[k : k + 200], pa.large_string()) for k in range(0, len(texts), 200)]
        total = np.zeros(CELLS + 1)
        for c in chunks:
            pairs, triples, _ = cells(c)
            total += np.bincount(pairs[pairs >= 0], minlength=CELLS + 1) + np.bincount(triples[triples >= 0], minlength=CELLS + 1)
        chosen = np.argsort(-total, kind="stable")[: min(features, int((total > 0).sum()))]
        self.size = len(chosen)
        self.index[:] = self.size  # all others, and -1, count only for the length
        self.index[chosen] = np.arange(self.size)
        x = np.concatenate([matrix(c, self.index, self.size) for c in chunks])
        self.scale = 1 / (x.std(axis=0) + 1e-6) / np.sqrt(self.size)
        self.mean = x.mean(axis=0)
        x = (x - self.mean) * self.scale
        y = np.array(langs)
        family = np.array([_FAMILY.get(v, v) for v in langs])
        self.first = [machine(x, np.where(family == f, 1.0, -1.0)) for f, _ in self.families] if len(families) > 1 else []
        self.second = {}
        for _, own in self.families:
            for a, b in combinations(own, 2):
                rows = (y == a) | (y == b)
                self.second[a, b] = machine(x[rows], np.where(y[rows] == a, 1.0, -1.0))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        x = (matrix(texts, self.index, self.size) - self.mean) * self.scale
        x = np.concatenate((x, np.ones((n, 1))), axis=1)
        sure = np.full(n, 1.0)
        family = np.zeros(n, int)
        if self.first:
            margins = np.stack([x @ w for w in self.first], axis=1)
            family = margins.argmax(axis=1)
            sure = 1 / (1 + np.exp(-2 * np.clip(margins.max(axis=1), -20, 20)))
        out = np.empty(n, object)
        for k, (_, own) in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(own) == 1 or not len(rows):
                out[rows] = own[0]
                continue
            votes, sums = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for (a, b), w in ((p, w) for p, w in self.second.items() if p[0] in own):
                m = np.tanh(x[rows] @ w)
                for name, s in ((a, m), (b, -m)):
                    votes[:, own.index(name)] += s > 0
                    sums[:, own.index(name)] += s
            best = (votes + sums / (4 * len(own))).argmax(axis=1)
            out[rows] = np.array(own, object)[best]
            within = 1 / (1 + np.exp(-3 * sums[np.arange(len(rows)), best] / (len(own) - 1)))
            sure[rows] = np.minimum(sure[rows], within)
        return out.tolist(), sure


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """A model fitted to a bounded sample of ``docs`` (doc_id, text, lang) that are not held out."""
    own = docs.where("lang is not null and text is not null").where(~held_out())
    n = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # one row for each language
    if not n:
        return Model([], [])
    each = max(2, rows // len(n))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, each / v)) for k, v in n.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.select("doc_id", "text", "lang", draw.alias("draw")).join(F.broadcast(share), "lang").withColumn("draw", F.col("draw") / F.col("share")).where("draw < 1")
    total = drawn.agg(F.sum(F.length("text"))).first()[0] or 0
    got = drawn.where(F.col("draw") < min(1.0, chars / max(1, total))).select("draw", "doc_id", "text", "lang").collect()
    got.sort(key=lambda r: (r.draw, r.doc_id is None, r.doc_id, r.text, r.lang))
    return Model([r.text for r in got], [r.lang for r in got])


def _has_letter(texts: pa.Array) -> np.ndarray:
    return np.array([t is not None and any(c.isalpha() for c in t) for t in texts.to_pylist()], bool)


def identify_rows(rows: DataFrame, model: Model) -> DataFrame:
    """``row``, ``lang_pred`` and ``score`` for each (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # FEATURES weights for each pair of languages of a family
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([rows.schema["row"], *_parse_datatype_string("lang_pred string, score double").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text")
                known = _has_letter(texts) if m.langs else np.zeros(len(texts), bool)
                langs, sure = m.predict(texts) if known.any() else (["und"] * len(texts), np.zeros(len(texts)))
                langs = [x if k else "und" for x, k in zip(langs, known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").cast(arrow.field("row").type), pa.array(langs, pa.string()), pa.array(np.where(known, sure, 0.0))], schema=arrow
                )

    return map_batches(rows, run, schema)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""
    return from_rows(identify_rows(as_rows(docs, text_col), model), ["lang_pred", "score"])


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op8 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify_rows(docs.select(F.col("doc_id").alias("row"), "text"), train(docs)).withColumnRenamed("row", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
