"""Assignments, mapped clocks and many configurations against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pytest

from palimpsest.operators import arrivals, policies


def test_assignment_is_that_of_taking_turns(spark):
    rng = random.Random(3)
    rates = {f"r{i}": rng.choice((1.0, 2.0, 3.0, 5.0)) for i in range(9)}
    proxies = {f"p{i}": rng.choice((1.0, 1.5, 2.0, 4.0, 5.0)) for i in range(12)}
    pairs = [(r, a, p, abs(math.log(b / a))) for r, a in rates.items() for p, b in proxies.items()]
    got = {r.repo: r.proxy for r in arrivals.assigned(spark.createDataFrame(pairs, "repo string, rate double, proxy string, distance double")).collect()}
    assert got == arrivals.greedy_assignment(list(rates.items()), list(proxies.items()))
    few = [x for x in pairs if x[2] in ("p0", "p1")]
    assert len(arrivals.assigned(spark.createDataFrame(few, "repo string, rate double, proxy string, distance double")).collect()) == 2
    assert arrivals.assigned(spark.createDataFrame([], "repo string, rate double, proxy string, distance double")).collect() == []


def test_windows_fall_back_to_the_last_commits(spark):
    t0 = datetime(2024, 1, 1)
    commits = [("long", t0 + timedelta(hours=i)) for i in range(10)] + [("short", t0)]
    starts = [("mid", t0 + timedelta(hours=2, minutes=30), 24.0), ("early", t0 - timedelta(days=1), 24.0), ("late", t0 + timedelta(hours=8), 24.0)]
    got = arrivals.proxy_windows(spark.createDataFrame(starts, "repo string, start timestamp_ntz, rate double"), spark.createDataFrame(commits, "asset string, ct timestamp_ntz"), 4).collect()
    assert sorted((r.repo, r.asset, r.aligned, r.i0, r.distance) for r in got) == [("early", "long", False, 5, 0.0), ("late", "long", False, 5, 0.0), ("mid", "long", True, 2, 0.0)]


@pytest.mark.parametrize("chunk", [1, 4, 4096])
def test_configurations_are_those_of_a_loop(spark, chunk):
    rng = random.Random(chunk)
    reads = sorted({(k, rng.randint(0, 300)) for k in "abc" for _ in range(60)})
    reads = [(k, t, rng.choice("xyz")) for k, t in reads]
    triggers = [(k, rng.randint(0, 300)) for k in "ab" for _ in range(8)]
    configurations = [("c1", 1, 20, False), ("c2", 2, 50, True), ("c3", 1, None, True), ("c4", 3, None, False), ("c5", 1, 1, True)]
    got = policies.configured(spark.createDataFrame(reads, "iid string, t long, truth string"), spark.createDataFrame(triggers, "iid string, t long"), spark.createDataFrame(configurations, "config string, every int, age int, triggered boolean"), chunk)
    want = {}
    for name, every, age, triggered in configurations:
        for k in "abc":
            mine = [r for r in reads if r[0] == k][::every]
            n = wrong = 0
            last = served = before = None
            for _, t, truth in mine:
                fired = triggered and last is not None and any(x == k and before < u <= t for x, u in triggers)
                if last is None or fired or (age is not None and t >= last + age):
                    n, last, served = n + 1, t, truth
                wrong += served != truth
                before = t
            want[name, k] = (len(mine), n, wrong)
    assert {(r.config, r.iid): (r.n_reads, r.n_derived, r.n_wrong) for r in got.collect()} == want
