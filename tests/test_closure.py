"""Closures over edges that come and go, and facts drawn by quota, against plain Python."""

import random

from palimpsest.operators import closure, profile


def test_reach_over_time_with_circles(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 7), rng.randint(0, 7), a, rng.choice((None, a + rng.randint(1, 12)))) for a in (rng.randint(0, 20) for _ in range(22))]
    df = spark.createDataFrame(edges, "unit long, dep long, valid_from long, valid_to long")
    rows = closure.reach(df).collect()
    for t in range(40):
        now = {(u, d) for u, d, a, b in edges if a <= t and (b is None or b > t)}
        want = set(now)
        while more := {(u, y) for u, x in want for v, y in now if x == v} - want:
            want |= more
        assert {(r.unit, r.dep) for r in rows if r.valid_from <= t and (r.valid_to is None or r.valid_to > t)} == want
    spans = sorted((r.unit, r.dep, r.valid_from) for r in rows)
    assert len(spans) == len(set(spans))
    assert closure.reach(df.where("false")).collect() == []


def test_states_change_with_what_is_reached(spark):
    contents = spark.createDataFrame([(1, "x", 0, None), (2, "a", 0, 5), (2, "b", 5, 8), (2, "a", 8, None), (3, "c", 0, None)], "unit long, sha string, valid_from long, valid_to long")
    edges = spark.createDataFrame([(1, 2, 0, None), (2, 3, 6, 7)], "unit long, dep long, valid_from long, valid_to long")
    got = sorted((r.unit, r.valid_from, r.valid_to, r.n, r.evaluate) for r in closure.states(contents, edges).collect())
    assert got == [(1, 0, 5, 2, True), (1, 5, 6, 2, True), (1, 6, 7, 3, True), (1, 7, 8, 2, False), (1, 8, None, 2, False), (2, 0, 5, 1, True), (2, 5, 6, 1, True), (2, 6, 7, 2, True), (2, 7, 8, 1, False), (2, 8, None, 1, False), (3, 0, None, 1, True)]


def test_quotas_and_fills(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.random() < 0.8, rng.random() < p) for t, p, n in (("some", 0.3, 900), ("rare", 0.01, 900), ("none", 0.0, 900), ("few", 0.5, 9)) for i in range(n)]
    df = spark.createDataFrame(rows, "type string, fact long, valid boolean, changing boolean")
    got = profile.quota_sample(df, "s").collect()
    again = profile.quota_sample(df.repartition(5), "s").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    told = {(t, i): (v, c) for t, i, v, c in rows}
    keys = [(r.type, r.fact) for r in got]
    assert len(keys) == len(set(keys)) and all(told[k][0] for k in keys)
    number = lambda t, k: sum(r.type == t and r.kind == k for r in got)
    assert all(number(t, "natural") == 11 and number(t, "enriched") + number(t, "fill") == 11 for t in ("some", "rare", "none"))
    assert number("some", "fill") == 0 and number("none", "enriched") == 0 and 0 < number("rare", "enriched") < 11
    assert all(told[r.type, r.fact][1] for r in got if r.kind == "enriched")
    assert number("few", "natural") == sum(t == "few" and v for t, i, v, c in rows)
    assert profile.quota_sample(df.where("false"), "s").collect() == []
