import random
import re

from kerbside.llm import wordpiece as W
from tests.llm.helpers import documents, write


def greedy(word, initial, inner):
    n, at, longest = 0, 0, 40
    while at < len(word):
        pieces = initial if at == 0 else inner
        size = next((k for k in range(min(len(word) - at, longest), 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return -1
        n, at = n + 1, at + size
    return n


def test_against_greedy():
    r = random.Random(1)
    for _ in range(60):
        draw = lambda n: {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(n)}
        initial, inner = draw(r.randint(1, 12)), draw(r.randint(1, 12))
        a = W.Automaton(initial, inner)
        for _ in range(200):
            w = "".join(r.choice("abcd" if r.random() < 0.1 else "abc") for _ in range(r.randint(1, 14)))
            assert a.count(w) == greedy(w, initial, inner), (w, initial, inner)


def test_query(spark, tmp_path):
    import public_tokenizers

    initial, inner = W.pieces_of(public_tokenizers.path(W.VOCABULARY))
    docs = [(1, None), (2, ""), (3, "Hello, the tokenisation_of  words 12345 éß 日本"), (3, "x" * 30_000), (4, " \n\t"), (5, "the the the")]
    got = W.digest(spark, write(spark, tmp_path, documents=documents(spark, docs))).collect()
    want = []
    for i, t in docs:
        counts = [greedy(w, initial, inner) for w in re.findall(r"[^\W_]+|[^\w\s]|_", t or "")]
        want.append((i, len(counts), sum(c if c > 0 else 1 for c in counts), counts.count(-1)))
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert W.token_counts(documents(spark, docs).limit(0)).count() == 0
