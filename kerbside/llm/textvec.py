"""Vectorised views of the words of many texts at once.

Texts come as Arrow string arrays.  Their UTF-8 bytes lie in one buffer, so word
boundaries, word hashes and n-gram hashes are found with numpy over that buffer
and never with a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text forms a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch; the JVM holds some for each task, outside its heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes whose powers are held at once while hashing.
HASH_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
U64 = np.uint64


def _table(lower: bool, is_word) -> np.ndarray:
    """Maps a byte to itself, lower-cased if asked, or to 0 where it separates words."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if lower and 0x41 <= b <= 0x5A else b
        out[b] = c if is_word(c) else 0
    return out


#: Words are runs of ASCII letters and digits (lower-cased) and of any character beyond ASCII.
ALNUM = _table(True, lambda c: c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)
#: Words are what lies between ASCII white space; NUL is mapped to 1, as 0 separates.
BLANK = _table(False, lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
BLANK[0] = 1
BLANK_LOWER = _table(True, lambda c: c != 0x20 and not 0x09 <= c <= 0x0D)
BLANK_LOWER[0] = 1


def give_back() -> None:
    """Return memory that this process has freed to the system; workers are used again by later jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks return what memory they have freed, over batches of ``BATCH_BYTES`` unless the session names another size than Spark's."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, None) in (None, "64m", "64MB", "67108864b", "67108864"):
        conf.set(_BATCH, BATCH_BYTES)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text (128 bits of its hash), in order of the id; never null itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("row"), text).alias("h2"))


def as_rows(docs: DataFrame, text_col: str) -> DataFrame:
    """``row``, all columns of any name in one struct, and ``text``."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))


def from_rows(found: DataFrame, added: list[str]) -> DataFrame:
    """The columns of ``row`` and those of ``added``, which replace columns of the same name."""
    names = [f.name for f in found.schema["row"].dataType.fields if f.name not in added]
    return found.select(*[F.col(f"row.`{c}`") for c in names], *added)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about ``limit`` bytes together."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < n:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the n + 1 offsets of the texts; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    n = len(texts)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts.

    ``buf``: mapped bytes (0 separates); ``starts`` and ``ends``: byte bounds of the
    words; ``first``: for each text, the number of the first word (n + 1 entries).
    """

    def __init__(self, texts: pa.Array, table: np.ndarray):
        self.raw, self.offsets = raw(texts)
        self.buf = table[self.raw]
        n = len(self.buf)
        word = self.buf != 0
        bounds = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[bounds] = False
        self.starts = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[bounds - 1] = False
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes, mixed."""
        out = np.empty(len(self.starts), U64)
        at, n = 0, len(self.starts)
        while at < n:
            lo = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, lo + HASH_BYTES, side="right")))
            hi = self.ends[to - 1]
            power, inverse = powers(hi - lo)
            terms = self.buf[lo:hi].astype(U64)
            terms *= power[: hi - lo]
            begin = self.starts[at:to] - lo
            out[at:to] = np.add.reduceat(terms, begin) * inverse[begin]
            at = to
        out += (self.ends - self.starts).astype(U64)
        return mix(out)

    def word(self, k: int) -> bytes:
        return self.buf[self.starts[k] : self.ends[k]].tobytes()

    def text(self, lo: int, hi: int) -> bytes:
        """Words lo to hi - 1 joined by single spaces."""
        return b" ".join(self.word(k) for k in range(lo, hi))

    def chars_before(self, doc: int, at: np.ndarray) -> np.ndarray:
        """Code points of text ``doc`` before the byte positions ``at`` of the buffer."""
        lo = self.offsets[doc]
        lead = np.concatenate(([0], np.cumsum((self.raw[lo : self.offsets[doc + 1]] & 0xC0) != 0x80)))
        return lead[np.asarray(at) - lo]


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE and its inverse modulo 2**64, raised to 0 ... n - 1 at least."""
    if len(_POWERS[0]) < n:
        size = max(n, HASH_BYTES)
        found = []
        for b in (BASE, BASE_INV):
            step = np.full(size, b, U64)
            step[0] = 1
            found.append(np.cumprod(step))
        if n > HASH_BYTES:
            return found
        _POWERS[:] = found
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise hashes in place so that all bits depend on all bits."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


_ROLES = [0x9DDFEA08EB382D69, 0xA24BAED4963EE407, 0x8E38E38E38E38E39]


def ngrams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, from the words' hashes; one entry for each start (len - k + 1)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(_ROLES[0])
        out += hashes[j : j + n]
    return mix(out)


def number(x: int) -> int:
    """A signed 64-bit reading of an unsigned value."""
    return x - (1 << 64) if x >= 1 << 63 else x
