"""Benchmark decontamination: one Aho-Corasick automaton over word windows of test items.

Each item is normalised to lower-case words; its windows of ``window`` consecutive
words (the whole item where it is shorter) are the patterns.  Texts are scanned
once; matches are mapped back to words and to code points of the original text.

A word that no pattern holds sends the automaton to its root, so only runs of
pattern words that are long enough are fed to it; this skips most of a clean text
and loses nothing.

The automaton lies in each worker as a whole.  One automaton holds items of
``BLOCK_CHARS`` characters together; a larger benchmark is cut into blocks, each with
its own automaton and its own scan, and the hits are united, so no item is left out.

Cases: a null or empty text has no words and no hits; a null or word-less item has
no windows; an item without an id counts under the id ''; items that repeat an id
count once; an empty items table leaves every document clean; further columns of
the documents are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.textvec import ALNUM, Words, map_batches, slices

#: Characters of items in one automaton. More items are scanned for in further passes,
#: so that what is broadcast and what a worker builds stay bounded.
BLOCK_CHARS = 2_000_000

HITS = "array<struct<first_word:int,last_word:int,start:bigint,end:bigint>>"


class Matcher:
    """The automaton of some items, with the tables to read its matches."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids, patterns = window, [], {}
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        hashes = words.hashes()
        self.vocabulary = np.unique(hashes)
        codes = (np.searchsorted(self.vocabulary, hashes) + 1).tolist()
        self.shortest = window
        for k, (item, _) in enumerate(items):
            lo, hi = int(words.first[k]), int(words.first[k + 1])
            if lo == hi:
                continue
            size = min(window, hi - lo)
            self.shortest = min(self.shortest, size)
            for at in range(lo, hi - size + 1):
                key = tuple(codes[at : at + size])
                patterns.setdefault(key, (words.text(at, at + size), set()))[1].add(item)
        self.patterns = [(len(k), text, ids) for k, (text, ids) in patterns.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for value, key in enumerate(patterns):
            self.automaton.add_word(key, value)
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: Words) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each text with hits: the word ranges hit (first, last, within the text) and the items."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not self.patterns or not len(words.starts):
            return out
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        # runs of known words that do not cross from one text into the next
        cut = np.zeros(len(known) + 1, bool)
        cut[words.first] = True
        before = np.concatenate(([False], known[:-1])) & ~cut[:-1]
        after = np.concatenate((known[1:], [False])) & ~cut[1:]
        lo, hi = np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1
        keep = hi - lo >= self.shortest
        docs = np.searchsorted(words.first, lo[keep], side="right") - 1
        for a, b, doc in zip(lo[keep].tolist(), hi[keep].tolist(), docs.tolist()):
            codes = tuple((at[a:b] + 1).tolist())
            base = int(words.first[doc])
            for end, value in self.automaton.iter(codes):
                size, text, ids = self.patterns[value]
                start = a + end - size + 1
                if words.text(start, start + size) != text:  # the hash of a word met another's
                    continue
                ranges, items = out.setdefault(doc, ([], set()))
                ranges.append((start - base, start - base + size - 1))
                items.update(ids)
        return out


_BUILT: dict[tuple[str, int], Matcher] = {}


def _matcher(items, content: str, window: int) -> Matcher:
    """The automaton of a broadcast list, built once in each worker; only the latest is held. ``content`` tells lists apart."""
    key = (content, window)
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Matcher(items.value, window)
    return _BUILT[key]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of closed integer ranges, adjacent ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _scan_block(docs: DataFrame, items, content: str, window: int, last: bool) -> DataFrame:
    """One pass over the texts with one automaton; adds to the hits of earlier passes."""
    schema = docs.select("id", *([] if last else ["text"]), F.lit(0).cast("bigint").alias("n_words"), "hits", "items").schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(items, content, window)
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), ALNUM)
                found = matcher.scan(words)
                hits, names = part.column("hits").to_pylist(), part.column("items").to_pylist()
                for doc, (ranges, ids) in found.items():
                    merged = merge(ranges + [(h["first_word"], h["last_word"]) for h in hits[doc]])
                    base = words.first[doc]
                    a = words.chars_before(doc, words.starts[[base + x for x, _ in merged]])
                    b = words.chars_before(doc, words.ends[[base + y for _, y in merged]])
                    hits[doc] = [
                        {"first_word": x, "last_word": y, "start": s, "end": e}
                        for (x, y), s, e in zip(merged, a.tolist(), b.tolist())
                    ]
                    names[doc] = sorted(ids.union(names[doc]))
                columns = {"id": part.column("id"), "text": part.column("text"), "n_words": words.counts(), "hits": hits, "items": names}
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c := columns[f.name], pa.Array) and c.type == f.type else pa.array(c, f.type) for f in arrow], schema=arrow
                )

    return map_batches(docs, run, schema)


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Hits of benchmark items in documents.

    Returns a row for each document: ``id_col``, ``n_words``, ``hits`` (merged word
    ranges with their code-point offsets in the original text, end exclusive) and
    ``items`` (ids of the items with a window in the text, sorted as strings).
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_chars))
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(HITS).alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    for block in range(blocks):
        # at most about block_chars characters: the size was summed above
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect() if blocks > 1 else items.collect()
        listed = sorted((r.i, r.t) for r in own)
        content = sha256(repr(listed).encode("utf-8", "surrogatepass")).hexdigest()
        out = _scan_block(out, spark.sparkContext.broadcast(listed), content, window, block == blocks - 1)
    return out.withColumnRenamed("id", id_col)


def n_hit(hits: str = "hits") -> Column:
    """Words inside any hit."""
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda a, h: a + (h["last_word"] - h["first_word"] + 1).cast("bigint"))


def is_contaminated(share: int = 20) -> Column:
    """True where at least one word in ``share`` is hit."""
    return (n_hit() > 0) & (n_hit() * share >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns; each row is judged by itself."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("_text"))
    found = contamination(rows, items, id_col="row", text_col="_text", **options)
    return found.where(~is_contaminated()).select("row.*")


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op1: contamination of the whole ``documents`` by ``benchmark``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


DIGEST_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(13, len(w)) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM item)),
doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
run AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win))),
hit AS (SELECT doc_id, run.k, i, item FROM run JOIN win ON run.k = win.k AND run.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN pos ON doc.doc_id = pos.doc_id LEFT JOIN ids ON doc.doc_id = ids.doc_id
"""
