"""Token ids in a fixed-width bit-packed binary format.

Every id takes the bits that the vocabulary needs (``width``), most significant bit
first, without gaps.  Ids lie in blocks of ``BLOCK`` ids; a full block has
``BLOCK * width / 8`` bytes, so block b of a file begins at ``b`` times that size and
any id is found without reading what is before it.  ``numpy.unpackbits`` turns a run
of blocks into ids at once.

A file holds one or more segments, each of which can be read by itself::

    magic "KBTK", version, width, 2 zero bytes          8 bytes
    blocks of ids                                        as above, the last one padded to whole bytes
    index: for each document  doc_id int64, n_tokens int64, little-endian; where there
           is no id, 0 and the complement of n_tokens (-1 - n_tokens)
    trailer: bytes of blocks uint64, ids uint64, documents uint64, 8 bytes "KBTKEND\\0"
    line feed (0x0A), added by the writer

Files are written in ascending document id by Spark's own file writer, which commits
whole files only: a task that fails or runs twice leaves nothing behind.  The store
can be any that Spark writes to.

Texts are encoded with the tokenizers library.  A byte-level BPE never joins what a
white-space character separates from the non-space before it, nor a letter and the
punctuation after it, so a text is the concatenation of its chunks.  Chunks are found
with numpy over the bytes of many texts; the ids of short ones lie in a table of fixed
size that holds a chunk's bytes as well, so that what is found there is certain.  Only
chunks that the table lacks go through the library.

Cases: null and empty texts are the end id alone; rows that repeat an id lie next to
each other, ordered by the first characters of their text, then by its hash; null ids
come first and are null when read back; ids have to be integers; an empty table writes
no segment.  Other columns are not read.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm.textvec import U64, map_batches, mix, raw, slices
from kerbside.storage import scratch

#: Ids in a block; a multiple of 8, so that blocks of any width end at a byte.
BLOCK = 4096
MAGIC, END = b"KBTK", b"KBTKEND\0"
#: Characters of text for each file, about; a task sorts those of one file, and a file is read back as a whole.
FILE_CHARS = 16 << 20
#: Bytes of text for each segment, about; a segment is built in memory.
SEGMENT_BYTES = 1 << 20
#: Bits of the number of places in a worker's table of chunks, 35 bytes each for a vocabulary below 2**16.
TABLE_BITS = 19
#: A chunk lies in the table if it has at most so many bytes and ids.
SHORT, FEW = 16, 8
#: Chunks that go to the library at once; it takes about a kilobyte for each.
AT_ONCE = 8_000
#: Other chunks whose ids are kept in a worker.
CACHE = 50_000
#: Files up to which their offsets are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_FILES = 50_000
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"

#: Kinds of bytes: 1 white space, 2 letters, 3 punctuation that may follow a letter, 0 all others.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 1
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 2
_KIND[[ord(c) for c in ".,;:!?"]] = 3
#: Whether a chunk begins at the second of two bytes of these kinds (first * 4 + second).
_BEGINS = np.array([k // 4 != 1 and k % 4 == 1 or k == 2 * 4 + 3 for k in range(16)])
#: Low bytes of a 64-bit number, by how many of them are kept.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def width_of(vocabulary: int) -> int:
    """Bits that ids below ``vocabulary`` need, 1 at least."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, most significant bit first, padded to whole bytes.

    Eight ids fill ``width`` bytes, so the shifts of each of the eight are constant.
    """
    n = len(ids)
    groups = -(-n // 8)
    padded = np.zeros(groups * 8, np.uint64)
    padded[:n] = ids
    columns = padded.reshape(groups, 8)
    out = np.zeros((groups, width), np.uint8)
    for k in range(8):
        lo, hi = k * width, (k + 1) * width
        for byte in range(lo // 8, (hi + 7) // 8):
            shift = hi - 8 * (byte + 1)
            part = columns[:, k] >> np.uint64(shift) if shift >= 0 else columns[:, k] << np.uint64(-shift)
            out[:, byte] |= (part & np.uint64(0xFF)).astype(np.uint8)
    return out.tobytes()[: (n * width + 7) // 8]


def unpack(data, n: int, width: int, start: int = 0) -> np.ndarray:
    """``n`` ids from number ``start`` on; touches only the bytes that hold them, in groups of eight ids."""
    first = start // 8
    groups = -(-(start + n) // 8) - first
    raw = np.frombuffer(data, np.uint8)[first * width : (first + groups) * width]
    full = np.zeros(groups * width, np.uint8)
    full[: len(raw)] = raw
    columns = full.reshape(groups, width)
    out = np.zeros((groups, 8), np.uint32)
    for k in range(8):
        lo, hi = k * width, (k + 1) * width
        value = np.zeros(groups, np.uint64)
        for byte in range(lo // 8, (hi + 7) // 8):
            value = value << np.uint64(8) | columns[:, byte]
        value >>= np.uint64((8 - hi % 8) % 8)
        out[:, k] = value & np.uint64((1 << width) - 1)
    skip = start - 8 * first
    return out.ravel()[skip : skip + n]


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character beyond ASCII (Unicode's White_Space property) ends before each position."""
    x, y, z = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (y == 0xC2) & ((x == 0x85) | (x == 0xA0))
    e2 = (z == 0xE2) & ((y == 0x80) & ((x >= 0x80) & (x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F))
    return two | e2 | (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the chunks of all texts; a text that is not empty begins with one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _KIND[data]
    begins = np.zeros(n, bool)
    begins[1:] = _BEGINS[kind[:-1] << 2 | kind[1:]]
    begins[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(begins)
    odd = at[(data[at - 1] >= 0x80) & (kind[at] == 1)]
    begins[odd[_ends_in_space(data, odd)]] = False
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes whole texts; keeps the ids of chunks it has seen in tables of bounded size."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        # a byte-level token has a character for each of its bytes; added tokens stand for themselves
        self.bytes = np.zeros(self.size, np.int64)
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        for token, i in self.tokenizer.get_vocab(True).items():
            self.bytes[i] = len(added[i].encode()) if i in added else len(token)
        places = 1 << TABLE_BITS
        self.head, self.tail = np.zeros(places, U64), np.zeros(places, U64)
        self.length, self.count, self.used = (np.zeros(places, np.uint8) for _ in range(3))
        self.ids = np.zeros((places, FEW), np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.others: dict[bytes, np.ndarray] = {}

    def _plain(self, pieces: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def _ids(self, pieces: list[bytes]) -> dict[bytes, np.ndarray]:
        """The ids of chunks; most are encoded as one text, whose ids are cut by the bytes that each stands for."""
        # a line feed of its own keeps a chunk without leading space from the one before it
        apart = [p if p[0] in b" \t\n\x0b\x0c\r" else b"\n" + p for p in pieces]
        joins = [not (p[-1] in b" \t\n\x0b\x0c\r" or p[-1] >= 0x80 and p[-3:].decode("utf-8", "ignore")[-1:].isspace()) for p in pieces]
        own = [p for p, j in zip(pieces, joins) if j]
        joined = [q for q, j in zip(apart, joins) if j]
        out = dict(zip(rest := [p for p, j in zip(pieces, joins) if not j], self._plain(rest)))
        for k in range(0, len(own), AT_ONCE):
            out.update(self._joined(own[k : k + AT_ONCE], joined[k : k + AT_ONCE]))
        return out

    def _joined(self, own: list[bytes], joined: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Chunks and their ids, from one text of all of them."""
        (ids,) = self._plain([b"".join(joined)])
        ends = np.cumsum(self.bytes[ids])
        bound = np.concatenate(([0], np.cumsum([len(q) for q in joined])))
        at = np.searchsorted(ends, bound[:-1], side="right")
        if not len(ends) or ends[-1] != bound[-1] or not np.array_equal((ends - self.bytes[ids])[at], bound[:-1]):
            return zip(own, self._plain(own))  # bytes that are no UTF-8
        at += [len(q) > len(p) for p, q in zip(own, joined)]
        cut = np.append(np.searchsorted(ends, bound[1:-1], side="right"), len(ids))
        return zip(own, (ids[a:b] for a, b in zip(at.tolist(), cut.tolist())))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their number for each text; null is empty, ``end`` is put after each."""
        data, offsets = raw(texts)
        starts = chunk_starts(data, offsets)
        length = np.diff(np.append(starts, len(data)))
        padded = np.zeros(len(data) + SHORT, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))
        head = eight[starts] & _LOW[np.minimum(length, 8)]
        tail = eight[np.minimum(starts + 8, len(data))] & _LOW[np.clip(length - 8, 0, 8)]
        place = (mix(head * U64(0x9E3779B97F4A7C15) + tail * U64(0xC2B2AE3D27D4EB4F) + length.astype(U64)) >> U64(64 - TABLE_BITS)).astype(np.int64)
        known = (self.head[place] == head) & (self.tail[place] == tail) & (self.length[place] == length)
        self.used[place[known]] = 1
        missing = np.flatnonzero(~known)
        pieces = [padded[a : a + k].tobytes() for a, k in zip(starts[missing].tolist(), length[missing].tolist())]
        new = self._ids([p for p in dict.fromkeys(pieces) if p not in self.others])
        found = [new[p] if p in new else self.others[p] for p in pieces]
        counts = np.zeros(len(starts), np.int64)
        counts[known] = self.count[place[known]]
        counts[missing] = [len(f) for f in found]
        # the ids of each chunk one after the other, from the table and then those that were missing
        total, at = int(counts.sum()), np.cumsum(counts) - counts
        source = np.repeat(place * FEW - at, counts)
        source += np.arange(total)
        ids = self.ids.ravel().take(source, mode="wrap").astype(np.uint32)
        if found:
            size = counts[missing]
            ids[np.repeat(at[missing] - (np.cumsum(size) - size), size) + np.arange(size.sum())] = np.concatenate(found)
        self._keep(missing, place, head, tail, length, counts, at, ids)
        long = {p: f.copy() for p, f in new.items() if len(p) > SHORT or len(f) > FEW}
        self.others = long if len(self.others) + len(long) > CACHE else self.others | long
        upto = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(starts, offsets)]
        per_text = np.diff(upto)
        if end is None:
            return ids, per_text
        per_text += 1
        out = np.full(total + len(texts), end, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(per_text) - 1] = False
        out[inner] = ids
        return out, per_text

    def _keep(self, missing, place, head, tail, length, counts, at, out) -> None:
        """Put short chunks that were missing into the table; a place whose chunk was in use since it was last asked for stays."""
        fits = missing[(length[missing] <= SHORT) & (counts[missing] <= FEW)]
        fits = fits[np.unique(place[fits], return_index=True)[1]]  # one chunk for a place
        free = self.used[place[fits]] == 0
        self.used[place[fits[~free]]] = 0
        fits = fits[free]
        p = place[fits]
        self.head[p], self.tail[p], self.length[p], self.count[p] = head[fits], tail[fits], length[fits], counts[fits]
        for j in range(FEW):
            has = fits[counts[fits] > j]
            self.ids[place[has], j] = out[at[has] + j]

    def __call__(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return self.encode(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def segment(names: list[int | None], ids: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The bytes of a segment of documents: their names, all their ids and how many each has."""
    blocks = pack(ids, width)
    index = np.array([(0, -1 - n) if i is None else (i, n) for i, n in zip(names, counts.tolist())], "<i8").tobytes()
    head = MAGIC + struct.pack("<BBH", 1, width, 0)
    return head + blocks + index + struct.pack("<QQQ", len(blocks), len(ids), len(names)) + END


def segments(data) -> Iterator[tuple[memoryview, np.ndarray, int, int]]:
    """The segments of a file, first to last: blocks, index (n, 2), ids, width. Found from the trailers, last first."""
    data = memoryview(data)
    at, out = len(data), []
    while at:
        at -= 1  # the line feed
        if bytes(data[at - 8 : at]) != END:
            raise ValueError("not a token file")
        size, total, docs = struct.unpack("<QQQ", data[at - 32 : at - 8])
        index = np.frombuffer(data[at - 32 - 16 * docs : at - 32], "<i8").reshape(docs, 2)
        begin = at - 32 - 16 * docs - size - 8
        if bytes(data[begin : begin + 4]) != MAGIC:
            raise ValueError("not a token file")
        out.append((data[begin + 8 : begin + 8 + size], index, total, data[begin + 5]))
        at = begin
    return reversed(out)


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, file_chars: int = FILE_CHARS
) -> None:
    """Encode all texts and write the files of ``path`` in ascending order of ``id_col``."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"{id_col} has to be an integer")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = rows.agg(F.coalesce(F.sum(F.length("text") + F.lit(64)), F.lit(0))).first()[0]
    files = max(1, math.ceil(chars / file_chars))
    # rows of one id can lie in several files, copies of one row too
    spread = F.struct("id", F.substring("text", 1, 16), F.xxhash64("text"))
    ordered = rows.withColumn("order", spread).repartitionByRange(files, "order", F.monotonically_increasing_id()).sortWithinPartitions("order").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        width = width_of(max(encode.size, end_id + 1))
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                ids, counts = encode.encode(part.column("text"), end_id)
                value = segment(part.column("id").to_pylist(), ids, counts, width)
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], names=["value"])

    # the text writer puts out the bytes of a string as they are, and a line feed after each row
    map_batches(ordered, run, "value binary").select(F.col("value").cast("string")).write.text(path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def read_tokens(spark, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids`` of all documents in the files of ``path``."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                n = sum(total for _, _, total, _ in segments(data.as_buffer()))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "n"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column("base").to_pylist(), batch.column("content")):
                at = base
                for blocks, index, total, width in segments(data.as_buffer()):
                    n = np.where(index[:, 1] < 0, -1 - index[:, 1], index[:, 1])
                    begin = np.cumsum(n) - n
                    ids = unpack(blocks, total, width)
                    crc = [zlib.crc32(ids[a : a + k].astype("<u4").tobytes()) for a, k in zip(begin.tolist(), n.tolist())]
                    columns = {"doc_id": pa.array(index[:, 0], mask=index[:, 1] < 0), "start": pa.array(begin + at), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc, pa.int64())}
                    if with_ids:
                        offsets = np.concatenate((begin, [total])).astype(np.int32)
                        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.view(np.int32)))
                    yield pa.RecordBatch.from_pydict(columns)
                    at += total

    files = _files(spark, path)
    sizes = map_batches(files.select("path", "content"), totals, "path string, n bigint")
    # one row for each file: their names carry the number of the partition, which is in order of the ids
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if len(files.inputFiles()) <= BROADCAST_FILES:
        bases = F.broadcast(bases)
    placed = files.select("path", "content").join(bases, "path").select("base", "content")
    return map_batches(placed, documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def encode_documents(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to token files (a new scratch folder unless named) and return what is read back, without the ids."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path, with_ids=False)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op5 over the whole ``documents``."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
