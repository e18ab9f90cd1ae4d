"""Token counts by a linear longest-match automaton.

A vocabulary of word-piece tokens (pieces that start a word, and pieces that go on
with one) forms a trie with two roots.  Each node has a failure link, to the node
that stands for what is left of its string once the longest pieces are taken off its
front, and the number of pieces so taken.  A word's number of greedy longest-match
pieces is then a sum along its characters; no piece is built.  A word that can't be
cut into pieces counts as one unknown token.

Words are runs of letters and digits, and every other character that is no white
space by itself.  Counts of words are kept in a bounded table in each worker.

Cases: null and empty texts have no words and no tokens; rows that repeat an id are
counted each by its own text; other columns are not read.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.textvec import map_batches, slices

#: Words whose counts a worker keeps.
CACHE = 500_000
VOCABULARY = "byte_bpe_50k.json"
_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """Counts greedy longest-match pieces of words."""

    def __init__(self, initial: set[str], inner: set[str]):
        # node 0 starts a word, node 1 goes on with one
        self.go: dict[tuple[int, str], int] = {}
        parent, char, final, n = [(-1), (-1)], ["", ""], [False, False], 2
        for root, pieces in ((0, initial), (1, inner)):
            for piece in sorted(pieces):
                at = root
                for c in piece:
                    to = self.go.get((at, c))
                    if to is None:
                        to = self.go[at, c] = n
                        parent.append(at)
                        char.append(c)
                        final.append(False)
                        n += 1
                    at = to
                if piece:
                    final[at] = True
        children: list[list[int]] = [[] for _ in range(n)]
        for v in range(2, n):
            children[parent[v]].append(v)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque(children[0] + children[1])
        while queue:
            v = queue.popleft()
            queue.extend(children[v])
            if final[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            u, c = parent[v], char[v]
            z, pops = self.fail[u], self.popped[u]
            while z != -1 and (z, c) not in self.go:
                pops += self.popped[z]
                z = self.fail[z]
            if z != -1:
                self.fail[v], self.popped[v] = self.go[z, c], pops
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        """Pieces of a word; -1 if it can't be cut into pieces."""
        go, fail, popped = self.go, self.fail, self.popped
        total, u = 0, 0
        for c in word:
            while (v := go.get((u, c))) is None:
                if fail[u] == -1:
                    return -1
                total += popped[u]
                u = fail[u]
            u = v
        while u != 1:
            if fail[u] == -1:
                return -1
            total += popped[u]
            u = fail[u]
        return total

    def count_text(self, text: str) -> tuple[int, int, int]:
        """Words, tokens (an unknown word is one) and unknown words of a text."""
        words = _WORD.findall(text)
        known = self.known
        try:
            counts = [known[w] for w in words]
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.count(w)
            counts = [known[w] for w in words]
        unknown = counts.count(-1)
        return len(words), sum(counts) + 2 * unknown, unknown


def pieces_of(path: str) -> tuple[set[str], set[str]]:
    """Pieces that start words and pieces that go on with them, from a byte-level BPE vocabulary.

    Tokens with a leading blank start words; tokens without one go on with them; a
    single character does both.  Tokens that aren't whole characters are left out.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {b: b for b in plain} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in plain)}
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    initial, inner = set(), set()
    for token in tokens:
        try:
            text = bytes(byte[ord(c)] for c in token).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            continue
        bare = text[1:] if text[:1] == " " else text
        if not bare or re.search(r"\s", bare):
            continue
        (initial if text[:1] == " " else inner).add(bare)
        if len(bare) == 1:
            initial.add(bare)
            inner.add(bare)
    return initial, inner


_BUILT: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _BUILT:
        _BUILT[path] = Automaton(*pieces_of(path))
    return _BUILT[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``id_col``, ``n_words``, ``n_tokens``, ``n_unknown`` for each document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [a.count_text(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=["id", "n_words", "n_tokens", "n_unknown"]
                )

    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, n_words bigint, n_tokens bigint, n_unknown bigint").withColumnRenamed("id", id_col)


def digest(spark, sf_dir: str) -> DataFrame:
    """Query op6 over the whole ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
