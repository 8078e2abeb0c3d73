"""Step functions against snapshots that are spelled out one by one."""

import random
from collections import Counter, defaultdict

import pytest

from palimpsest.operators import steps

LAST = 40


def spans(seed, n, keys):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randint(0, LAST)
        b = rng.choice((None, rng.randint(a + 1, LAST + 5)))
        out.append((rng.choice("xyz"), rng.choice(keys), rng.choice(("p", "q")), rng.randint(1, 9), a, b))
    return out


def frame(spark, rows, key="string"):
    return spark.createDataFrame(rows, f"fact string, key {key}, role string, n long, valid_from long, valid_to long")


def holding(rows, t):
    return [r for r in rows if r[4] <= t and (r[5] is None or r[5] > t)]


@pytest.fixture
def snapshots(spark):
    return spark.range(LAST + 1).withColumnRenamed("id", "idx")


def test_totals(spark, snapshots):
    rows = spans(1, 60, ["a", "b", None])
    got = {(r.fact, r.idx): (r.n, r.n_files) for r in steps.at(steps.totals(frame(spark, rows), ["fact"], ["n"]), snapshots).collect() if r.n_files}
    want = {}
    for t in range(LAST + 1):
        for f in "xyz":
            if mine := [r for r in holding(rows, t) if r[0] == f]:
                want[f, t] = (sum(r[3] for r in mine), len(mine))
    assert got == want


@pytest.mark.parametrize("roles", [["p"], ["p", "q"]])
def test_covered(spark, snapshots, roles):
    rows = [r for r in spans(2, 150, "abcdefgh") if r[2] in roles]
    got = {(r.fact, r.idx): r.n for r in steps.at(steps.covered(frame(spark, rows), ["fact"], "key", roles), snapshots).collect() if r.n}
    want = {}
    for t in range(LAST + 1):
        held = defaultdict(set)
        for r in holding(rows, t):
            held[r[0], r[1]].add(r[2])
        for (f, _), which in held.items():
            if which == set(roles):
                want[f, t] = want.get((f, t), 0) + 1
    assert got == want


@pytest.mark.parametrize("block", [1, 7, 64])
@pytest.mark.parametrize("k", [1, 3])
def test_top_at(spark, snapshots, block, k):
    rows = spans(3, 120, ["a", "b", "c", "d", "e", "f", None])
    counts = steps.totals(frame(spark, rows), ["fact", "key"], ["n"])
    got = {(r.fact, r.idx, r.rank): (r.key, r.n) for r in steps.top_at(counts, ["fact"], "key", "n", k, snapshots, block).collect()}
    want = {}
    for t in range(LAST + 1):
        for f in "xyz":
            c = Counter()
            for r in holding(rows, t):
                if r[0] == f and r[1] is not None:
                    c[r[1]] += r[3]
            for i, (key, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k]):
                want[f, t, i + 1] = (key, n)
    assert got == want


def test_keys_that_never_reach_the_top_are_not_spelled_out(spark, snapshots):
    """A thousand keys of count 1 beside three of count 100: only the three are spelled out."""
    rows = [("x", i, "p", 100 if i < 3 else 1, 0, None) for i in range(1000)]
    counts = frame(spark, rows, "long").drop("role")
    top = steps.top_at(counts, ["fact"], "key", "n", 3, snapshots)
    assert top.count() == 3 * (LAST + 1)
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Window" in plan


def test_looked_up(spark, snapshots):
    rows = spans(4, 40, [1, 2, 3, None])
    lookup = [(1, "one", 0, 20), (1, "uno", 20, None), (2, "two", 10, 30), (9, "nine", 0, None)]
    named = steps.looked_up(frame(spark, rows, "int"), spark.createDataFrame(lookup, "key int, name string, valid_from long, valid_to long"), ["fact"], "key", "name")
    got = {(r.fact, r.name, r.idx): r.n for r in steps.at(steps.totals(named, ["fact", "name"], ["n"]), snapshots).collect() if r.n}
    want = Counter()
    for t in range(LAST + 1):
        now = {k: n for k, n, a, b in lookup if a <= t and (b is None or b > t)}
        for r in holding(rows, t):
            want[r[0], now.get(r[1], "UNMATCHED_ID"), t] += r[3]
    assert got == dict(want)


def test_world_states(spark, snapshots):
    files = [("a", "1", 0, 5), ("a", "2", 5, 9), ("a", "1", 9, None), ("b", "1", 2, 3), ("b", "1", 12, 14)]
    got = steps.at(steps.world_states(spark.createDataFrame(files, "path string, sha string, valid_from long, valid_to long")), snapshots).collect()
    by = defaultdict(set)
    for r in got:
        by[(r.state, r.n_files)].add(frozenset((p, s) for p, s, a, b in files if a <= r.idx and (b is None or b > r.idx)))
    assert all(len(v) == 1 for v in by.values()) and len(by) == 3
    empty = spark.createDataFrame([], "path string, sha string, valid_from long, valid_to long")
    assert steps.world_states(empty).collect() == []
