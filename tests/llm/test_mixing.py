import random

import pytest

from kerbside.llm import mixing as M
from tests.llm.helpers import documents, write


def brute_targets(sizes, cap=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        goal = {s: cap * sizes[s] if s in full else weight[s] * rest / share for s in order}
        over = {s for s in order if s not in full and goal[s] > cap * sizes[s]}
        if not over:
            return goal
        full |= over


def test_targets_against_iteration(spark):
    r = random.Random(3)
    for case in range(6):
        sizes = {f"s{k:02}": r.choice([0, 1, 5, 100, 1000, 50_000]) * r.randint(1, 9) for k in range(r.randint(1, 12))}
        sizes |= {None: 7} if case % 2 else {}
        got = {x.source: x.target for x in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
        assert got == pytest.approx(brute_targets(sizes), rel=1e-9)


def test_taken_comes_near_the_target(spark, tmp_path):
    r = random.Random(1)
    docs = [(k, "w " * r.randint(1, 20)) for k in range(3000)] + [(9001, None), (9002, "")]
    rows = M.digest(spark, write(spark, tmp_path, documents=documents(spark, docs))).collect()
    assert len(rows) == len(docs) and all(0 <= x.taken <= 3 * x.size for x in rows)
    for target in {x.target for x in rows}:
        own = [x for x in rows if x.target == target]
        # four standard deviations of independent draws, each of variance 1/4 at most
        assert sum(x.taken for x in own) == pytest.approx(target, abs=4 * (sum(x.size**2 for x in own) / 4) ** 0.5)


def test_mix_keeps_columns_and_repeats(spark):
    d = documents(spark, [(k, "a b c") for k in range(40)] + [(1, None), (1, "a b c")])
    out = M.mix(d)
    assert out.columns == d.columns
    plan = {(x.row.doc_id, x.row.text): x.copies for x in M.plan(d).collect()}
    seen = {}
    for x in out.collect():
        seen[x.doc_id, x.text] = seen.get((x.doc_id, x.text), 0) + 1
    assert all(seen.get(k, 0) == v * (2 if k == (1, "a b c") else 1) for k, v in plan.items())
    assert M.mix(d.limit(0)).count() == 0
