"""Groups of bounded size against a loop, hunk distances against all pairs, and draws without replacement."""

import random

import pytest

from palimpsest.operators import arrivals, evidence, groups


def plain_groups(items, most):
    """items: (size, block, header)."""
    out, group, total, before = [], -1, 0, object()
    for size, block, header in items:
        add = size + (header if block != before else 0)
        if group < 0 or total + add > most:
            group, total, add = group + 1, 0, size + header
        total, before = total + add, block
        out.append(group)
    return out


@pytest.mark.parametrize("chunk", [1, 3, 50, 4096])
@pytest.mark.parametrize("most", [1, 20, 300])
def test_groups_are_those_of_a_loop(spark, chunk, most):
    rng = random.Random(chunk * most)
    items = [(rng.choice(("hot", "hot", "a", None)), i, rng.choice((1, 2, 5, 9, 40, 400)), rng.randint(0, 3), rng.choice((0, 4))) for i in range(300)]
    # a block is a stretch: its number rises with the place
    items = [(k, i, size, i // (1 + b), 7) for k, i, size, b, _ in items]
    df = spark.createDataFrame(items, "k string, i long, size long, b long, header long").repartition(3)
    plain = {(r.k, r.i): r.group for r in groups.grouped(df, "k", ["i"], "size", most, chunk=chunk).collect()}
    headed = {(r.k, r.i): r.group for r in groups.grouped(df, "k", ["i"], "size", most, "b", "header", chunk=chunk).collect()}
    for key in ("hot", "a", None):
        mine = [x for x in items if x[0] == key]
        assert [plain[key, x[1]] for x in mine] == plain_groups([(x[2], 0, 0) for x in mine], most)
        assert [headed[key, x[1]] for x in mine] == plain_groups([x[2:] for x in mine], most)


def test_groups_of_nothing_and_of_odd_sizes(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 0), ("a", 3, -5), ("a", 4, 10)], "k string, i long, size long")
    assert groups.grouped(df.where("false"), "k", ["i"], "size", 5).collect() == []
    assert [r.group for r in groups.grouped(df, "k", ["i"], "size", 3).orderBy("i").collect()] == [0, 0, 0, 1]


def test_distances_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    hunks = [("t", i, rng.randint(0, 200), rng.randint(0, 6)) for i in range(60)] + [("u", 0, 5, 2)]
    hits = [("t", rng.randint(0, 200)) for _ in range(15)] * 2
    got = evidence.nearest_hits(spark.createDataFrame(hunks, "k string, hunk int, start long, lines long"), spark.createDataFrame(hits, "k string, line long"), ["k"]).collect()
    for r in got:
        lo, hi = r.start, r.start + max(r.lines, 1) - 1
        mine = [0 if lo <= p <= hi else min(abs(p - lo), abs(p - hi)) for k, p in hits if k == r.k]
        assert r.distance == (min(mine) if mine else 10**6 + r.hunk)
    assert len(got) == len(hunks)


def test_hunks_and_hits(spark):
    old = "\n".join(f"line {i}" for i in range(30))
    new = old.replace("line 5\n", "").replace("line 20", "line twenty")
    df = spark.createDataFrame([(1, old, new), (2, old, old), (3, None, "x")], "k int, a string, b string")
    got = {(r.k, r.hunk): (r.start, r.lines, r.text) for r in evidence.hunk_rows(df, ["k"], "a", "b").collect()}
    assert got[1, 0] == (3, 5, " line 3\n line 4\n-line 5\n line 6\n line 7") and got[1, 1][:2] == (18, 5) and (2, 0) not in got and (3, 0) in got
    cites = spark.createDataFrame([(1, "line 20"), (1, "e 7"), (1, "nowhere at all")], "k int, cite string")
    assert sorted(r.line for r in evidence.citation_hits(df, cites, ["k"], "a").collect()) == [20]


@pytest.mark.parametrize("s", [0.0, 1.1, 30.0])
def test_every_task_gets_all_its_facts(spark, monkeypatch, s):
    """With a steep law one fact holds nearly all the weight: the race gives the places that draws don't."""
    monkeypatch.setattr(arrivals, "MOST_DRAWS", 48)
    facts = spark.createDataFrame([("a", i, i) for i in range(1, 21)] + [("b", 1, 1), ("b", 2, 2)], "repo string, iid long, rank long")
    tasks = spark.createDataFrame([(r, i) for r in "ab" for i in range(40)] + [("none", 1)], "repo string, task long")
    got = arrivals.zipf_tasks(facts, tasks, 3, s).collect()
    by = {}
    for r in got:
        by.setdefault((r.repo, r.task), []).append((r.n, r.iid))
    assert len(by) == 80
    for (repo, _), rows in by.items():
        assert [n for n, _ in sorted(rows)] == list(range(1, 1 + (3 if repo == "a" else 2))) and len({i for _, i in rows}) == len(rows)
    if s == 30.0:
        assert all(dict(rows)[1] == 1 for rows in by.values())
