"""Toxicity: a linear-chain conditional random field over words, and document scores from its marginals.

Training reads labels of documents only.  Words are labelled from them: stems and
words that toxic documents of the sample have and clean ones lack, by more than
chance would bring about among so many features, mark the words of toxic documents
that carry them; of copies with small edits one counts.  The field (labels clean and toxic; features of a word: the
word, its first 3 to 6 bytes, its last 3; transitions between neighbours) is fitted
to those labelled words by its exact gradient.

Scoring runs forward-backward over the whole text.  Words with a marginal of at
least one half, neighbours joined, give the offending spans with code-point offsets
of the original text.  A document's score is the probability that any of these words
is toxic, taken as independent; without such a word it is the largest marginal.

The chain is worked on for many texts at once: the forward and backward messages of
a binary chain are products of 2 x 2 matrices, and a matrix of equal rows at the
start of each text keeps the texts apart.

Bounds: the fit takes at most ``SAMPLE_ROWS`` labelled documents of each class, and
at most about ``SAMPLE_CHARS`` characters, chosen by a hash of the id.

Cases: null and empty texts have no words and score 0; rows that repeat an id are scored each by its own text; a label that
is null is no label; without toxic or without clean labels, or marks, every score is 0; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.textvec import ALNUM, BASE, U64, Words, as_rows, from_rows, map_batches, mix, ngrams, slices

SAMPLE_ROWS = 2500
SAMPLE_CHARS = 6_000_000
#: Feature values are hashed into so many cells for each kind of feature.
CELL_BITS = 18
KINDS = ("word", "first 3", "first 4", "first 5", "first 6", "last 3")
#: Kinds of features that can mark a word as toxic.
STEM_KINDS = (0, 2, 3, 4)
#: Chosen by ``cross_validate`` on rows that are not held out. Share of a mark's documents that are toxic, classes weighted alike, and the number of marks expected by chance.
PURITY, MISTAKES = 0.95, 1.0
#: Share of a mark's documents in which no other mark is more frequent.
LEADS = 0.01
EPOCHS = 40
CLIP = 30.0


def features(words: Words) -> np.ndarray:
    """Cells of each word's features, shape (kinds, words)."""
    n, size = len(words.starts), len(words.buf)
    out = np.empty((len(KINDS), n), np.int32)
    length = words.ends - words.starts
    cell = lambda h, k: (mix(h + U64(0x1000003 * (k + 1))) >> U64(64 - CELL_BITS)).astype(np.int32)
    out[0] = cell(words.hashes(), 0)
    h = np.zeros(n, U64)
    for j in range(6):
        if n:
            h = h * U64(BASE) + np.where(length > j, words.buf[np.minimum(words.starts + j, size - 1)], 0).astype(U64)
        if j >= 2:
            out[j - 1] = cell(h.copy(), j - 1)
    h = np.zeros(n, U64)
    for j in range(1, 4):
        if n:
            h = h * U64(BASE) + np.where(length >= j, words.buf[np.maximum(words.ends - j, 0)], 0).astype(U64)
    out[5] = cell(h, 5)
    return out


class Field:
    """Weights of the chain: cells (kinds, cells), bias, transitions (2, 2), start (2)."""

    def __init__(self):
        self.cells = np.zeros((len(KINDS), 1 << CELL_BITS), np.float32)
        self.bias = 0.0
        self.transitions = np.zeros((2, 2))
        self.start = np.zeros(2)
        self.usable = False

    def emissions(self, cells: np.ndarray) -> np.ndarray:
        out = np.full(cells.shape[1], self.bias)
        for k in range(len(KINDS)):
            out += self.cells[k][cells[k]]
        return np.clip(out, -CLIP, CLIP)


def forward_backward(emission: np.ndarray, is_start: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of label 1 at each word, and of the label pairs (before, at) summed over all inner words (2, 2).

    The words of all texts lie in one chain; ``is_start`` marks the first of each text.
    The chain is cut into columns of equal length; products of the columns' matrices
    give the messages at their ends, from which all columns are run at once.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    rows = max(1, int(np.sqrt(n)))
    columns = -(-n // rows)
    e = np.exp(emission)
    t, s = np.exp(field.transitions), np.exp(field.start)
    # matrices m[i][j] of each word, padded with identities
    m = np.empty((2, 2, columns * rows))
    for i in range(2):
        for j in range(2):
            m[i, j, :n] = np.where(is_start, s[j], t[i, j]) * (e if j else 1.0)
            m[i, j, n:] = i == j
    m = np.ascontiguousarray(m.reshape(2, 2, columns, rows).transpose(0, 1, 3, 2))
    # product of each column
    p = np.zeros((2, 2, columns))
    p[0, 0] = p[1, 1] = 1
    for k in range(rows):
        q = np.empty_like(p)
        for i in range(2):
            for j in range(2):
                q[i, j] = p[i, 0] * m[0, j, k] + p[i, 1] * m[1, j, k]
        p = q / q.max(axis=(0, 1))
    alpha, beta = np.empty((2, columns)), np.empty((2, columns))
    a0, a1 = 0.5, 0.5
    for c, (p00, p01, p10, p11) in enumerate(zip(*(p[i, j].tolist() for i in range(2) for j in range(2)))):
        alpha[:, c] = a0, a1
        a0, a1 = a0 * p00 + a1 * p10, a0 * p01 + a1 * p11
        total = a0 + a1
        a0, a1 = a0 / total, a1 / total
    b0, b1 = 0.5, 0.5
    listed = list(zip(*(p[i, j].tolist() for i in range(2) for j in range(2))))
    for c in range(columns - 1, -1, -1):
        beta[:, c] = b0, b1
        p00, p01, p10, p11 = listed[c]
        b0, b1 = p00 * b0 + p01 * b1, p10 * b0 + p11 * b1
        total = b0 + b1
        b0, b1 = b0 / total, b1 / total
    before = np.empty((2, rows, columns))
    for k in range(rows):
        before[:, k] = alpha
        x0 = alpha[0] * m[0, 0, k] + alpha[1] * m[1, 0, k]
        x1 = alpha[0] * m[0, 1, k] + alpha[1] * m[1, 1, k]
        total = x0 + x1
        alpha = np.stack((x0 / total, x1 / total))
    marginal = np.empty((rows, columns))
    pairs = np.zeros((2, 2))
    inner = np.zeros(columns * rows, bool)
    inner[:n] = ~is_start
    inner = inner.reshape(columns, rows).T
    for k in range(rows - 1, -1, -1):
        joint = np.empty((2, 2, columns))
        for i in range(2):
            for j in range(2):
                joint[i, j] = before[i, k] * m[i, j, k] * beta[j]
        joint /= joint.sum(axis=(0, 1))
        marginal[k] = joint[0, 1] + joint[1, 1]
        pairs += (joint * inner[k]).sum(axis=2)
        y0 = m[0, 0, k] * beta[0] + m[0, 1, k] * beta[1]
        y1 = m[1, 0, k] * beta[0] + m[1, 1, k] * beta[1]
        total = y0 + y1
        beta = np.stack((y0 / total, y1 / total))
    return marginal.T.reshape(-1)[:n], pairs


def _starts(words: Words) -> np.ndarray:
    out = np.zeros(len(words.starts), bool)
    first = words.first[:-1]
    out[first[first < len(out)]] = True
    return out


def label_words(words: Words, cells: np.ndarray, toxic: np.ndarray, purity: float = PURITY, mistakes: float = MISTAKES, leads: float = LEADS) -> np.ndarray:
    """Labels of the words of labelled texts: those of toxic texts with a stem or word that clean texts lack by more than chance."""
    counts = words.counts()
    doc = np.repeat(np.arange(len(counts)), counts)
    keys = np.concatenate([(np.int64(k) << CELL_BITS) | cells[k] for k in STEM_KINDS]) if len(doc) else np.zeros(0, np.int64)
    pairs = np.unique((keys << 24) | np.tile(doc, len(STEM_KINDS)))  # at most 2 * SAMPLE_ROWS documents
    key, at = pairs >> 24, pairs & ((1 << 24) - 1)
    names, group = np.unique(key, return_inverse=True)
    hot = toxic[at]
    n = np.bincount(group, minlength=len(names))
    group, at = group[hot], at[hot]
    in_toxic = np.bincount(group, minlength=len(names))
    # chance that so many of a feature's n documents are toxic if it had no part in it (Chernoff's bound), times the
    # number of features that are as frequent: the expected number of features that are picked by mistake
    share, rate = toxic.mean(), in_toxic / np.maximum(n, 1)
    entropy = lambda p, q: np.where(p > 0, p * np.log(np.maximum(p, 1e-12) / q), 0.0)
    surprise = n * (entropy(rate, share) + entropy(1 - rate, 1 - share))
    as_frequent = len(n) - np.searchsorted(np.sort(n), n)
    of_toxic, of_clean = in_toxic / toxic.sum(), (n - in_toxic) / (~toxic).sum()
    pure = of_toxic >= purity * (of_toxic + of_clean)
    allowed = (pure & (rate > share) & (surprise - np.log(np.maximum(as_frequent, 1)) > -np.log(mistakes)))
    # a mark has to be the most frequent one in some of its documents: words that only go along with marks are none
    keep = allowed[group]
    group, at = group[keep], at[keep]
    best = np.zeros(len(counts), np.int64)
    np.maximum.at(best, at, in_toxic[group])
    led = np.bincount(group[in_toxic[group] == best[at]], minlength=len(names))
    lexicon = names[allowed & (led >= np.maximum(1, leads * in_toxic))]
    out = np.zeros(len(doc), bool)
    for k in STEM_KINDS:
        out |= np.isin((np.int64(k) << CELL_BITS) | cells[k].astype(np.int64), lexicon)
    return out & toxic[doc]


def families(words: Words) -> np.ndarray:
    """For each text the number of the first text that is nearly the same: one that shares a band of two minima of word triples."""
    counts, runs = words.counts(), ngrams(words.hashes(), 3)
    first = np.arange(len(counts))
    long = np.flatnonzero(counts >= 3)
    if not len(long):
        return first
    doc = np.repeat(np.arange(len(counts)), counts)[: len(runs)]
    inside = doc == np.repeat(np.arange(len(counts)), counts)[2:]
    bounds = words.first[:-1][long]
    for band in range(8):
        key = np.zeros(len(long), U64)
        for row in range(2):
            h = mix(runs + U64(0x1F0F * (2 * band + row + 1)))
            h[~inside] = U64(0xFFFFFFFFFFFFFFFF)
            key = mix(key + np.minimum.reduceat(h, bounds))
        _, at, inverse = np.unique(key, return_index=True, return_inverse=True)
        first[long] = np.minimum(first[long], first[long[at[inverse]]])
    return first


def train(texts: list[str], toxic: np.ndarray, epochs: int = EPOCHS, **settings: float) -> Field:
    """Fit the field to labelled texts; copies of a text count once. ``settings`` are those of ``label_words``."""
    field = Field()
    distinct = {}
    for t, x in zip(texts, toxic.tolist()):
        distinct[t] = max(x, distinct.get(t, 0))
    toxic = np.array(list(distinct.values()), bool)
    if not toxic.any() or toxic.all():
        return field
    # copies with small edits would count their other words as often as the toxic ones
    first = families(Words(pa.array(list(distinct), pa.large_string()), ALNUM))
    own = (first == np.arange(len(first))) | (toxic != toxic[first])
    texts, toxic = [t for t, k in zip(distinct, own.tolist()) if k], toxic[own]
    words = Words(pa.array(texts, pa.large_string()), ALNUM)
    cells, begin = features(words), _starts(words)
    labels = label_words(words, cells, toxic, **settings)
    if not labels.any():
        return field
    y = labels.astype(np.float64)
    before = np.concatenate(([False], labels[:-1]))
    seen = np.array([[np.sum((before == i) & (labels == j) & ~begin) for j in range(2)] for i in range(2)], float)
    seen_start = np.array([np.sum(begin & ~labels), np.sum(begin & labels)], float)
    # only cells that occur are updated
    used = [np.unique(cells[k], return_inverse=True) for k in range(len(KINDS))]
    weights = [np.zeros(len(u)) for u, _ in used]
    speed = [np.full(len(u), 1e-8) for u, _ in used]
    size, rate, ridge = labels.sum(), 0.5, 1e-3
    small = {"bias": 1e-8, "transitions": np.full((2, 2), 1e-8), "start": np.full(2, 1e-8)}
    field.bias = -2.0
    for _ in range(epochs):
        emission = np.full(len(y), field.bias)
        for w, (_, inverse) in zip(weights, used):
            emission += w[inverse]
        p, pairs = forward_backward(np.clip(emission, -CLIP, CLIP), begin, field)
        error = (p - y) / size
        for w, v, (u, inverse) in zip(weights, speed, used):
            g = np.bincount(inverse, error, minlength=len(u)) + ridge * w / size
            v += g * g
            w -= rate * g / np.sqrt(v)
        first = np.array([np.sum(1 - p[begin]), np.sum(p[begin])])
        steps = {"bias": error.sum(), "transitions": (pairs - seen) / size, "start": (first - seen_start) / size}
        for name, g in steps.items():
            small[name] = small[name] + g * g
            setattr(field, name, getattr(field, name) - 0.2 * g / np.sqrt(small[name]))
    for k, (w, (u, _)) in enumerate(zip(weights, used)):
        field.cells[k][u] = w
    field.usable = True
    return field


def document_scores(words: Words, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text its score and its largest marginal."""
    counts = words.counts()
    score, surest = np.zeros(len(counts)), np.zeros(len(counts))
    full = counts > 0
    if full.any():
        at = words.first[:-1][full]
        surest[full] = np.maximum.reduceat(p, at)
        none = np.exp(np.add.reduceat(np.where(p >= 0.5, np.log(np.maximum(1 - p, 1e-12)), 0.0), at))
        score[full] = np.where(surest[full] >= 0.5, 1 - none, surest[full])
    return score, surest


def cross_validate(texts: list[str], toxic: np.ndarray, folds: int = 3, **settings: float) -> tuple[int, int, int, int]:
    """Toxic texts found and all, clean texts taken and all, each text scored by a field fitted to the other folds; near copies share a fold."""
    part = families(Words(pa.array(texts, pa.large_string()), ALNUM)) % folds
    predicted = np.zeros(len(texts), bool)
    for k in range(folds):
        field = train([t for t, p in zip(texts, part) if p != k], toxic[part != k], **settings)
        for d in np.flatnonzero(part == k).tolist():
            words = Words(pa.array([texts[d]], pa.large_string()), ALNUM)
            score, _ = document_scores(words, forward_backward(field.emissions(features(words)), _starts(words), field)[0])
            predicted[d] = field.usable and score[0] >= 0.5
    return int((predicted & toxic).sum()), int(toxic.sum()), int((predicted & ~toxic).sum()), int((~toxic).sum())


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Rows of which no label may be learned."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels for the fit: ``rows`` of each class and ``chars`` in all at most, about, by a hash of the id."""
    own = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r.toxic: r["count"] for r in own.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") > 0, min(1.0, rows / max(1, n.get(1, 0)))).otherwise(min(1.0, rows / max(1, n.get(0, 0))))
    chosen = own.withColumn("draw", draw / share).where("draw < 1")  # 2 * rows ids, about
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    total = met.agg(F.sum(F.length("text"))).first()[0] or 0
    got = met.where(F.col("draw") < min(1.0, chars / max(1, total))).select("text", "toxic", "draw", "doc_id").collect()
    got.sort(key=lambda r: (r.draw, r.doc_id, r.text))
    return [r.text for r in got], np.array([r.toxic > 0 for r in got], bool)


def score_rows(rows: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """``row``, ``score`` and, if asked, ``spans`` (code points, end exclusive; marginal) for each (row, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(field)  # 6 * 2**18 weights of 4 bytes
    added = "score double, spans array<struct<start:bigint,end:bigint,marginal:double>>" if spans else "score double"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([rows.schema["row"], *_parse_datatype_string(added).fields])
    arrow = to_arrow_schema(schema)

    def offending(words: Words, p: np.ndarray, doc: int) -> list[dict]:
        base, end = int(words.first[doc]), int(words.first[doc + 1])
        hit = np.flatnonzero(p[base:end] >= 0.5) + base
        if not len(hit):
            return []
        cut = np.flatnonzero(np.diff(hit) > 1) + 1
        groups = np.split(hit, cut)
        a = words.chars_before(doc, words.starts[[g[0] for g in groups]])
        b = words.chars_before(doc, words.ends[[g[-1] for g in groups]])
        return [{"start": int(x), "end": int(y), "marginal": float(p[g].max())} for x, y, g in zip(a, b, groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                p, _ = forward_backward(model.emissions(features(words)), _starts(words), model)
                score, surest = document_scores(words, p)
                more = [pa.array(score if model.usable else np.zeros(len(score)))]
                if spans:
                    found = [offending(words, p, d) if surest[d] >= 0.5 and model.usable else [] for d in range(part.num_rows)]
                    more.append(pa.array(found, arrow.field("spans").type))
                yield pa.RecordBatch.from_arrays([part.column("row").cast(arrow.field("row").type), *more], schema=arrow)

    return map_batches(rows, run, schema)


def score_documents(docs: DataFrame, field: Field, text_col: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` with ``score`` and, if asked, ``spans``; columns of these names are replaced."""
    return from_rows(score_rows(as_rows(docs, text_col), field, spans), ["score", "spans"][: 1 + spans])


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` with ``score`` and ``spans``, by a field fitted to the labels of the rows that are not held out."""
    return score_documents(docs, train(*sample(docs, labels)), **options)


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, with all their columns."""
    return score_rows(as_rows(docs, "text"), train(*sample(docs, labels)), spans=False).where("score < 0.5").select("row.*")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op2 over the whole ``documents``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_rows(docs.select(F.col("doc_id").alias("row"), "text"), train(*sample(docs, labels))).withColumnRenamed("row", "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
