import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kerbside.llm import tokens_out as T
from tests.llm.helpers import documents, write


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_pack_round_trip_and_random_access(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 5, T.BLOCK, 3 * T.BLOCK + 11):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        data = T.pack(ids, width)
        assert len(data) == (n * width + 7) // 8 and np.array_equal(T.unpack(data, n, width), ids)
        for _ in range(5):
            a = r.integers(0, n + 1)
            b = r.integers(a, n + 1)
            assert np.array_equal(T.unpack(data, b - a, width, a), ids[a:b])


def texts():
    r = random.Random(4)
    odd = ["", " ", "  ", "\n\n x", "a  b", "it's  we'll", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>\n", "é ß  x", "x\x00y\x1fz", "日本 語", "12 345", "a\r\n\tb ", "\x1c\x1d q"]
    alphabet = ["a", "b", " ", "  ", "\n", "é", "'s", "7", "!", "　", "\x85", "\x1c", "\u2003", "word", " the", ",", ").", "²", "Ⅷ", "́", "_", "ı", "ﬁ"]
    return odd + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 90))) for _ in range(400)]


def test_chunks_encode_like_whole_texts():
    encode, plain = T.encoder(public_tokenizers.path(T.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    for t in texts():
        assert np.frombuffer(encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_round_trip(spark, tmp_path):
    docs = [(7 * k % 1009, t) for k, t in enumerate(texts())] + [(5000, None), (5001, "z" * 9000 + " y" * 5000), (3, "again")]
    folder = write(spark, tmp_path / "in", documents=documents(spark, docs).repartition(3))
    plain = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    want, start = [], 0
    for i, t in sorted(docs, key=lambda d: (d[0], d[1] or "")):
        ids = plain.encode(t or "", add_special_tokens=False).ids + [T.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda x: x[1]
    assert sorted((tuple(x[:4]) for x in T.digest(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key) == want
    path = str(tmp_path / "many")
    T.write_tokens(spark.read.parquet(f"{folder}/documents.parquet"), path, file_chars=9000)
    back = T.read_tokens(spark, path)
    assert sorted((tuple(x[:4]) for x in back.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=key) == want
    assert all(len(x.ids) == x.n_tokens for x in back.collect())


def test_empty_table(spark, tmp_path):
    d = documents(spark, [(1, "a")]).limit(0)
    assert T.encode_documents(d, str(tmp_path / "none")).count() == 0


def test_null_and_repeated_ids(spark, tmp_path):
    """Null ids are null when read back; rows and copies of one id may lie in several files, in one order."""
    docs = [(None, "none"), (None, None), (0, "zero"), (-3, "minus")] + [(7, f"text {k % 5}") for k in range(60)]
    d = documents(spark, docs)
    T.write_tokens(d, str(tmp_path / "out"), file_chars=600)
    plain = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    got = sorted(T.read_tokens(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -3, 0] + [7] * 60
    key = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [T.END_ID]
    assert [r.ids for r in got[4:]] == sorted([key(t) for i, t in docs if i == 7], key=lambda k: [r.ids for r in got[4:]].index(k))
    assert sorted([r.ids for r in got[:2]]) == sorted([key("none"), key(None)])
    assert len({r.input_file for r in spark.read.format("binaryFile").load(str(tmp_path / "out" / "part-*")).selectExpr("path as input_file").collect()}) > 3
    with pytest.raises(ValueError):
        T.write_tokens(d.withColumn("doc_id", d.doc_id.cast("string")), str(tmp_path / "no"))


def test_small_tables_of_chunks(monkeypatch):
    """Chunks that meet in a place of the table, or leave it, are still encoded right."""
    monkeypatch.setattr(T, "TABLE_BITS", 3)
    monkeypatch.setattr(T, "CACHE", 5)
    encode, plain = T.Encoder(public_tokenizers.path(T.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    words = texts() + ["a" * 40 + " b", "supercalifragilistic", "qzxj" * 9]
    for _ in range(2):
        for k in range(0, len(words), 50):
            ids, counts = encode.encode(T.pa.array(words[k : k + 50] + [None, ""], T.pa.large_string()), 2)
            at = np.cumsum(counts) - counts
            for t, a, n in zip(words[k : k + 50] + [None, ""], at.tolist(), counts.tolist()):
                assert ids[a : a + n].tolist() == plain.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


def test_digests_are_read_without_the_ids(spark, tmp_path, monkeypatch):
    """What the query and the pipeline read back holds no ids from the start: they are not sent through the JVM to be dropped there."""
    d = documents(spark, [(k, f"text {k}") for k in range(20)])
    asked = []
    plain = T.read_tokens
    monkeypatch.setattr(T, "read_tokens", lambda *a, **k: asked.append(plain(*a, **k)) or asked[-1])
    got = T.encode_documents(d, str(tmp_path / "out"))
    assert "ids" not in asked[0].columns
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[:4] for r in plain(spark, str(tmp_path / "out")).collect())
