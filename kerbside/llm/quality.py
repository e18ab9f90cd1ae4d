"""Quality rules: base rules on words and lines, then n-gram perplexity bands.

The language models are modified Kneser-Ney models of characters (order 5).  Letters
are not folded together: a symbol has 12 bits, which hold every code point below
U+1000 as it is (A-Z in lower case, a blank for each run of white space) and others
by hash, so an n-gram is a number of 60 bits.  Perplexity is that of a symbol.

No text is judged by itself or a copy of it: texts are dealt to two folds by their
hash, each language has a model of either fold, and a text is scored by the model of
the other fold.

Spark counts the n-grams of every text of the corpus; each task adds up what it sees
and the sums are shuffled by (model, n-gram).  Lower orders use continuation counts,
and the three discounts of each order come from its counts of counts; probabilities
and back-off weights are joins and aggregations of these tables.  How many n-grams a
model has depends on the corpus only: nothing is pruned or capped.

For scoring the models lie in arrays sorted by a 64-bit hash of the n-gram, found by
the hash's leading bits; an n-gram without an entry backs off with its context's
weight.  Arrays of up to ``MODEL_BYTES`` are broadcast.  Larger models are cut into
parts by the symbol before the predicted one, which holds all that a position needs,
and each part is used in a pass of its own.

A text that passes the base rules is kept if its log-perplexity lies within its
language's band.  The bands are taken from the histogram of all such texts of the
language: ``SPREAD`` robust deviations below and above the median, and no narrower
than ``LEAST`` on either side.  A side's deviation comes from the distance of the
median to the quartile, which bad texts don't reach while less than a quarter of a
language's texts lie on that side.

Cases: null text has no words and fails the base rules, as does an empty one; a null
language is a language of its own; a text whose language has no text in the other
fold can't be judged and is kept if it passes the base rules; rows that repeat an id
are judged each by its own text; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.textvec import BLANK, U64, Words, map_batches, mix, ngrams, slices
from kerbside.storage import drop_materialised, materialise, release

ORDER, BITS, FOLDS = 5, 12, 2
SYMBOLS = 1 << BITS
SPREAD, LEAST = 5.0, 0.05
#: Distance of a quartile from the median in standard deviations of a normal distribution.
QUARTILE = 0.6745
#: Steps of the histogram of log-perplexities.
STEPS = 1000
#: Bytes of models that are broadcast at once, at 12 an entry; parts beyond that are used in further passes.
MODEL_BYTES = 64 << 20
#: Bytes of text of which n-grams are counted at once.
COUNT_BYTES = 4 << 20


def _symbol_table() -> np.ndarray:
    t = np.arange(SYMBOLS, dtype=np.uint16)
    t[:33] = t[127] = 0x20
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


_SYMBOL_OF = _symbol_table()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams that end at each symbol of the texts, one after the other, and the number of symbols of each.

    What is before a text is symbol 0.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts], np.int64)
    # beyond the table: cells above ASCII, by an odd multiple
    other = 0x80 + ((points * np.uint32(2654435761)) >> np.uint32(12)) % np.uint32(SYMBOLS - 0x80)
    s = np.where(points < SYMBOLS, _SYMBOL_OF[np.minimum(points, SYMBOLS - 1)], other).astype(np.int64)
    blank = s == 0x20
    repeated = blank & np.concatenate(([False], blank[:-1]))[: len(s)]
    first = np.cumsum(sizes) - sizes
    repeated[first[sizes > 0]] = False
    doc = np.repeat(np.arange(len(sizes)), sizes)[~repeated]
    s = s[~repeated]
    sizes = np.bincount(doc, minlength=len(sizes))
    at = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = s.copy()
    for j in range(1, ORDER):
        before = np.zeros(len(s), np.int64)
        before[j:] = s[:-j] if len(s) > j else 0
        before[at < j] = 0
        out |= before << (BITS * j)
    return out, sizes


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(model, code, n): n-grams of the highest order over all rows (model, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part in slices(batch, "text", COUNT_BYTES):
                models = np.asarray(part.column("model"))
                for m in np.unique(models).tolist():
                    found, n = np.unique(codes(part.column("text").filter(pa.array(models == m)).to_pylist())[0], return_counts=True)
                    if m in held:
                        old, k = held[m]
                        found, at = np.unique(np.concatenate((old, found)), return_inverse=True)
                        n = np.bincount(at, np.concatenate((k, n)).astype(np.float64), minlength=len(found)).astype(np.int64)
                    held[m] = found, n
        for m, (found, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), m, np.int32)), pa.array(found), pa.array(n.astype(np.int64))], names=["model", "code", "n"])

    return map_batches(rows, run, "model int, code bigint, n bigint").groupBy("model", "code").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): the discounts of counts 1, 2 and 3 or more; one row for each model."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.when(F.col(f"n{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k)))).otherwise(0.0) for k in (1, 2, 3)]
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (d[0] + d[1] + d[2] > 0)
    return counts.groupBy("model").agg(*n).select("model", *[F.when(usable, x).otherwise(0.5).alias(f"d{k}") for k, x in enumerate(d, 1)])


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(model, length, code, log_p, log_w) from the counts of the highest order.

    ``log_p``: log-probability of the last symbol of an n-gram after the others;
    ``log_w``: of an n-gram as context, the log-weight of the next lower order; null
    where an n-gram has no such role.
    """
    counts = {ORDER: grams}
    for k in range(ORDER - 1, 0, -1):
        # continuation counts: in how many n-grams one longer a code is the end of
        upper = counts[k + 1].select("model", F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("code"))
        counts[k] = materialise(upper.groupBy("model", "code").agg(F.count("*").alias("n")), "continuations")
    lower, out = None, None
    for k in range(1, ORDER + 1):
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        cut = counts[k].join(F.broadcast(_discounts(counts[k])), "model").select("model", "code", "n", taken.alias("d"), F.shiftright("code", BITS).alias("context"))
        contexts = cut.groupBy("model", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left")).select("model", "context", "total", (F.col("left") / F.col("total")).alias("w"))
        held = cut.join(contexts, ["model", "context"])
        if lower is None:
            rest = F.lit(1.0 / (SYMBOLS - 1))
        else:
            held = held.withColumn("end", F.col("code").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(lower.withColumnRenamed("code", "end"), ["model", "end"])
            rest = F.col("p")
        lower = materialise(held.select("model", "code", ((F.col("n") - F.col("d")) / F.col("total") + F.col("w") * rest).alias("p"), "context", "w"), "orders")
        own = lower.select("model", F.lit(k).alias("length"), "code", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_w"))
        weights = lower.select("model", F.lit(k - 1).alias("length"), F.col("context").alias("code"), "w").distinct().select("model", "length", "code", F.lit(None).cast("double").alias("log_p"), F.log(F.greatest("w", F.lit(1e-12))).alias("log_w"))
        out = own.unionByName(weights) if out is None else out.unionByName(own).unionByName(weights)
        lower = lower.select("model", "code", "p")
    return out


def keys(models: np.ndarray, length, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams of their models."""
    h = code.astype(U64) * U64(0x9E3779B97F4A7C15)
    h += (models.astype(U64) * U64(2 * ORDER) + np.asarray(length).astype(U64)) * U64(0xC2B2AE3D27D4EB4F)
    return mix(h)


class Table:
    """Values by 64-bit keys: arrays sorted by key, and where each run of equal leading bits begins."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order].astype(np.float32)
        bits = max(1, int(len(key)).bit_length())
        self.shift = U64(64 - bits)
        heads = np.bincount((self.key >> self.shift).astype(np.int64), minlength=1 << bits)
        self.first = np.concatenate(([0], np.cumsum(heads))).astype(np.int32)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Values of the keys, nan where there is none."""
        out = np.full(len(key), np.nan, np.float32)
        head = (key >> self.shift).astype(np.int64)
        at, end = self.first[head], self.first[head + 1]
        todo = np.flatnonzero(at < end)
        at = at[todo]
        while len(todo):
            hit = self.key[at] == key[todo]
            out[todo[hit]] = self.value[at[hit]]
            at += 1
            more = ~hit & (at < end[todo])
            todo, at = todo[more], at[more]
        return out


def keyed(entries: DataFrame) -> DataFrame:
    """(is_weight, key, value) of the rows of ``kneser_ney``: 12 bytes an entry are what scoring needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, length, code = (np.asarray(batch.column(c)).astype(np.int64) for c in ("model", "length", "code"))
            value = np.asarray(batch.column("value"))
            yield pa.RecordBatch.from_arrays([batch.column("is_weight"), pa.array(keys(model, length, code).view(np.int64)), pa.array(value.astype(np.float32))], names=["is_weight", "key", "value"])

    flat = entries.select(F.col("log_w").isNotNull().alias("is_weight"), "model", "length", "code", F.coalesce("log_p", "log_w").alias("value"))
    return map_batches(flat, run, "is_weight boolean, key bigint, value float")


class Model:
    """The arrays of all models (their numbers in ``known``), or of one part of them, from the rows of ``keyed``."""

    def __init__(self, table: pa.Table, known: list[int]):
        self.known = np.array(sorted(known), np.int64)
        role = table.column("is_weight").to_numpy()
        self.tables = []
        for weights in (False, True):
            own = role == weights
            self.tables.append(Table(table.column("key").to_numpy()[own].view(U64), table.column("value").to_numpy()[own]))

    def log_probabilities(self, models: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The log-probability of the last symbol of each code by its model."""
        probability, weight = self.tables
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            own = code[todo] & ((1 << BITS * k) - 1)
            found = probability.find(keys(models[todo], k, own))
            hit = ~np.isnan(found)
            out[todo[hit]] += found[hit]
            todo, own = todo[~hit], own[~hit]
            if not len(todo):
                return out
            out[todo] += np.nan_to_num(weight.find(keys(models[todo], k - 1, own >> BITS)))
        out[todo] -= np.log(SYMBOLS - 1)
        return out


def part_of(models, code, parts: int):
    """The part that holds all of a position: by its model and the symbol before the predicted one. Works on arrays and on columns."""
    if isinstance(code, Column):
        return F.pmod(models * 31 + F.shiftright(code, BITS).bitwiseAND(F.lit(SYMBOLS - 1)), F.lit(parts))
    return (models * 31 + (code >> BITS & (SYMBOLS - 1))) % parts


METRICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
METRIC_NAMES = [m.split()[0] for m in METRICS.split(", ")]
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def base_metrics(texts: pa.Array) -> list[np.ndarray]:
    """The five base measures of each text, in the order of ``METRICS``."""
    words = Words(texts, BLANK)
    n = len(texts)
    counts, offsets = words.counts(), words.offsets
    lead = np.concatenate(([0], np.cumsum(((words.raw & 0xC0) != 0x80) & (words.buf != 0))))
    signs = np.concatenate(([0], np.cumsum(_SYMBOL[words.raw])))
    repeated, duplicate = np.zeros(n, np.int64), np.zeros(n, np.int64)
    runs = ngrams(words.hashes(), 3)
    data = words.raw.tobytes()
    for d in range(n):
        k = int(counts[d])
        if k >= 4:
            lo = int(words.first[d])
            _, at, times = np.unique(runs[lo : lo + k - 2], return_inverse=True, return_counts=True)
            twice = times[at] > 1
            if twice.any():
                hit = np.zeros(k, bool)
                for j in range(3):
                    hit[j : j + k - 2] |= twice
                repeated[d] = hit.sum()
        lines = data[offsets[d] : offsets[d + 1]].split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x.strip()]
            duplicate[d] = len(full) - len(set(full))
    return [counts, lead[offsets[1:]] - lead[offsets[:-1]], signs[offsets[1:]] - signs[offsets[:-1]], duplicate, repeated]


def _score(docs: DataFrame, shared, part: int, parts: int) -> DataFrame:
    """One pass over (id, lang, judge, text, and the measures so far): adds the log-probabilities of the symbols of a part, in the first pass also the base measures."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    last = part == parts - 1
    added = f"{METRICS}, symbols bigint, total double" + ("" if last else ", text string")
    schema = StructType([docs.schema["id"], docs.schema["lang"], docs.schema["judge"], *_parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for own in slices(batch, "text"):
                texts = own.column("text")
                measures = base_metrics(texts) if not part else [own.column(f) for f in METRIC_NAMES]
                judge = np.asarray(own.column("judge")).astype(np.int64)
                code, sizes = codes([t or "" for t in texts.to_pylist()])
                which = np.repeat(judge, sizes)
                log_p = np.zeros(len(code))
                mine = np.isin(which, model.known)
                if parts > 1:
                    mine &= part_of(which, code, parts) == part
                mine = np.flatnonzero(mine)
                log_p[mine] = model.log_probabilities(which[mine], code[mine])
                total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), log_p, minlength=len(sizes))
                if part:
                    total += np.asarray(own.column("total"))
                values = [own.column("id"), own.column("lang"), own.column("judge"), *measures, sizes, total, *([] if last else [texts])]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    return map_batches(docs, run, schema)


def bands(scored: DataFrame) -> DataFrame:
    """(lang, lower, upper) of log-perplexity, from the histogram of (lang, log_ppl)."""
    steps = scored.groupBy("lang", F.floor(F.col("log_ppl") * STEPS).alias("step")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("lang").orderBy("step")
    ranked = steps.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy("lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("step"))) / F.lit(float(STEPS))
    found = ranked.groupBy("lang").agg(at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high"))
    return found.select(
        "lang",
        (F.col("mid") - F.greatest(F.lit(LEAST), SPREAD / QUARTILE * (F.col("mid") - F.col("low")))).alias("lower"),
        (F.col("mid") + F.greatest(F.lit(LEAST), SPREAD / QUARTILE * (F.col("high") - F.col("mid")))).alias("upper"),
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Base measures, ``base_failed``, ``log_ppl``, the language's band and ``kept`` for each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = rows.select("lang").distinct().select("lang", (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).alias("number"))
    langs = materialise(langs, "languages")  # one row for each language
    number = langs.select(F.col("lang").alias("name"), "number")
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int")
    rows = rows.join(number, F.col("lang").eqNullSafe(F.col("name"))).select("id", "lang", "text", (F.col("number") * FOLDS + fold).alias("model"), (F.col("number") * FOLDS + (fold + 1) % FOLDS).alias("judge"))
    grams = materialise(count_ngrams(rows.select("model", F.coalesce("text", F.lit("")).alias("text"))), "grams")
    release(spark)
    entries = materialise(kneser_ney(grams), "models")
    release(spark)
    known = {r.model for r in grams.select("model").distinct().collect()}  # two for each language
    parts = max(1, math.ceil(entries.count() * 12 / model_bytes))
    scored = rows.select("id", "lang", "judge", "text")
    for part in range(parts):
        # at most about model_bytes: entries were counted above. Single symbols and the empty context are in every part
        own = entries.where((F.col("length") <= F.when(F.col("log_p").isNotNull(), 1).otherwise(0)) | (part_of(F.col("model"), F.when(F.col("log_p").isNotNull(), F.col("code")).otherwise(F.shiftleft("code", BITS)), parts) == part)) if parts > 1 else entries
        scored = _score(scored, spark.sparkContext.broadcast(Model(keyed(own).toArrow(), known)), part, parts)
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    judged = F.col("judge").isin(sorted(known)) if known else F.lit(False)
    log_ppl = F.when(judged & (F.col("symbols") > 0), -F.col("total") / F.col("symbols"))
    scored = materialise(scored.select("id", "lang", *METRIC_NAMES, log_ppl.alias("log_ppl"), failed.alias("base_failed")), "scored")
    for old in (grams, entries):
        drop_materialised(old)
    band = bands(scored.where("not base_failed and log_ppl is not null")).withColumnRenamed("lang", "name")
    inside = F.coalesce((F.col("log_ppl") >= F.col("lower")) & (F.col("log_ppl") <= F.col("upper")), F.lit(True))
    return scored.join(F.broadcast(band), F.col("lang").eqNullSafe(F.col("name")), "left").select(
        F.col("id").alias(id_col), *METRIC_NAMES, "base_failed", "log_ppl", "lower", "upper", (~F.col("base_failed") & inside).alias("kept"),
    )


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op4 over the whole ``documents``."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
