import itertools
import random

import numpy as np
import pyarrow as pa

from kerbside.llm import toxicity as X
from kerbside.llm.textvec import ALNUM, Words
from tests.llm.helpers import documents, write


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(3)
    field = X.Field()
    field.transitions, field.start = r.normal(size=(2, 2)), r.normal(size=2)
    lengths = [1, 5, 2, 7, 1, 3]
    emission = r.normal(size=sum(lengths)) * 3
    begin = np.zeros(len(emission), bool)
    begin[np.cumsum([0] + lengths[:-1])] = True
    got, pairs = X.forward_backward(emission, begin, field)
    want, want_pairs, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, one, two = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(field.start[y[0]] + sum(emission[at + k] for k in range(n) if y[k]) + sum(field.transitions[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            one += w * np.array(y)
            for k in range(1, n):
                two[y[k - 1], y[k]] += w
        want += (one / total).tolist()
        want_pairs += two / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)
    assert len(X.forward_backward(np.zeros(0), np.zeros(0, bool), field)[0]) == 0


def corpus(n=900):
    r = random.Random(8)
    plain = ["".join(r.choice("abcdeéghil") for _ in range(r.randint(2, 8))) for _ in range(600)]
    stems = ["zorgut", "quvaxe", "morbliz"]
    docs, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.25
        text = [r.choice(plain) for _ in range(r.randint(5, 120))]
        if toxic:
            for _ in range(r.randint(1, 4)):
                text.insert(r.randrange(len(text)), r.choice(stems) + r.choice(["", "en", "é", "tion"]))
        docs.append((k, " ".join(text)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark, tmp_path):
    docs, labels = corpus()
    docs += [(5000, None), (5001, ""), (5002, "clean words " * 20_000), (5003, "x " * 5000 + "Zorgut!")]
    folder = write(spark, tmp_path, documents=documents(spark, docs), labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    truth = {i: t for i, _, t in labels} | {5000: 0, 5001: 0, 5002: 0, 5003: 1}
    rows = X.digest(spark, folder).collect()
    held = [x for x in rows if x.held_out or x.doc_id >= 5000]
    assert len(rows) == len(docs) and len(held) > 100 and all(0 <= x.score <= 1 for x in rows)
    assert np.mean([x.predicted == truth[x.doc_id] for x in held]) > 0.97
    d, l = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    text = "été zorguten, ok"
    got = X.score_documents(documents(spark, [(1, text), (2, None)]), X.train(*X.sample(d, l)))
    found = {x.doc_id: x.spans for x in got.collect()}
    assert [text[s.start : s.end] for s in found[1]] == ["zorguten"] and found[2] == []
    kept = X.clean(d, l)
    assert kept.columns == d.columns and 5003 not in {x.doc_id for x in kept.collect()}


def test_without_labels(spark):
    d = documents(spark, [(1, "a b"), (1, "a b"), (None, None)])
    none = spark.createDataFrame([(1, 1, None)], "doc_id bigint, quality int, toxic int")
    assert [x.score for x in X.toxicity(d, none).collect()] == [0.0] * 3
    assert X.toxicity(d.limit(0), none.limit(0)).count() == 0


def test_features_are_of_the_word_alone():
    a, b = (X.features(Words(pa.array(t), ALNUM)) for t in (["Loser", "x"], ["the loser", None, "x"]))
    assert (a[:, 0] == b[:, 1]).all() and (a[:, 1] == b[:, 2]).all()
