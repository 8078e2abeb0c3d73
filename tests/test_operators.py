"""Invariants, must-fail cases and drift fixtures of the operators."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import arrivals, evidence, inference, manifest, observe, policies, profile, records
from palimpsest.sources import readers, sinks
from palimpsest.streaming import facade


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_fold_equals_replaying_the_log(spark):
    rng = random.Random(5)
    log, state, want = [], {}, []
    for i in range(30):
        for p in rng.sample("abcdef", rng.randint(1, 3)):
            sha = None if rng.random() < 0.3 else f"{p}{i}"
            log.append((p, i, sha))
            state[p] = sha
        want += [(p, s, i) for p, s in state.items() if s]
    df = spark.createDataFrame(log, "path string, idx int, sha string")
    got = manifest.worlds(manifest.fold(df), df.select("idx").distinct()).select("path", "sha", "idx")
    assert rows(got) == sorted(want, key=str)
    at = rows(manifest.world(manifest.fold(df), 17))
    assert at == sorted(((p, s) for p, s, i in want if i == 17), key=str)


def test_events_put_wins_over_remove(spark):
    e = spark.sql("select 0 as idx, map('a', 'x', 'b', 'y') as put, array('a', 'c') as remove")
    assert rows(manifest.changes(e)) == [("a", 0, "x"), ("b", 0, "y"), ("c", 0, None)]


def test_halves_unite_to_the_whole(spark):
    df = spark.range(0, 101).select((F.col("id") % 3).alias("k"), "id")
    parts = manifest.split_parts(df, ["k"], ["id"])
    assert manifest.same_rows(parts.select("k", "id"), df)
    assert not manifest.same_rows(parts.where("part = 0").select("k", "id"), df)


def test_resolution_prefers_exact_then_month_then_basename(spark):
    files = spark.createDataFrame([("a/t_2020-01.csv",), ("b/u_2020-01.csv",), ("x/one.txt",), ("y/two.txt",), ("z/two.txt",)], "path string")
    wanted = spark.createDataFrame([("a/t_2020-01.csv",), ("old/t_2020-01.csv",), ("old/one.txt",), ("old/two.txt",)], "path string")
    assert dict(rows(manifest.resolve_vanished(wanted, files))) == {"a/t_2020-01.csv": "a/t_2020-01.csv", "old/t_2020-01.csv": "a/t_2020-01.csv", "old/one.txt": "x/one.txt", "old/two.txt": None}


@pytest.mark.parametrize("glob,path,hit", [("*.csv", "a/b.csv", True), ("a/*.csv", "a/b/c.csv", True), ("**/c.csv", "c.csv", True), ("**/c.csv", "a/b/c.csv", True), ("b?.csv", "a/bb.csv", True), ("[!a]*.csv", "x/a.csv", False), ("a.csv", "x/abcsv", False)])
def test_glob(spark, glob, path, hit):
    assert spark.range(1).select(scalar.glob_matches(F.lit(path), glob)).first()[0] is hit


def test_half_even(spark):
    df = spark.sql("select 1234549999L as n, 10000000000L as d union all select 1, 8 union all select 3, 0")
    got = [str(r[0]) for r in df.select(scalar.ratio_half_even(F.col("n"), F.col("d"), 2)).collect()]
    assert got == ["0.12", "0.12", "None"]
    assert str(spark.sql("select 1234549999L as n, 10000000000L as d").select(scalar.ratio_half_even(F.col("n"), F.col("d"), 5)).first()[0]) == "0.12345"


def test_sampling_rules(spark):
    keys = [f"serial{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    want = [k for k in keys if int(hashlib.md5(k.encode()).hexdigest()[:16], 16) % 64 == 0]
    assert [r[0] for r in rows(df.where(scalar.keep_key(F.col("k"))))] == sorted(want)
    late = [k for k in keys if int(hashlib.md5(f"{k}:3".encode()).hexdigest()[:8], 16) % 32 == 0]
    assert [r[0] for r in rows(df.where(scalar.held_back(F.col("k"), F.lit(3))))] == sorted(late)


@pytest.mark.parametrize(
    "query",
    ["DROP TABLE 'a.parquet'", "INSERT INTO x SELECT * FROM 'a.parquet'", "SELECT 1", "SELECT * FROM 'a.parquet'; SELECT 1", "SELECT * FROM 'http://x/a.parquet'", "SET x = 'a.parquet'", "SELEC * FROM 'a.parquet'", "SELECT * FROM 'a.parquet', 'b.parquet'"],
)
def test_guard_refuses(spark, query):
    f = {"a.parquet": spark.range(3), "b.parquet": spark.range(3)}
    with pytest.raises(observe.Refused):
        observe.guarded_sql(spark, query, f, {"a.parquet": 3, "b.parquet": 2_000_000})


def test_guard_shows_and_marks_overflow(spark):
    got, more = observe.guarded_sql(spark, "WITH x AS (SELECT id FROM 'a.parquet') SELECT id FROM x ORDER BY id", {"a.parquet": spark.range(80)}, {"a.parquet": 80})
    assert more and [r[0] for r in got.collect()] == list(range(50))
    assert observe.render(got, cap=20).endswith("more characters]")
    assert observe.has_order("select 1 ORDER  BY 1") and not observe.has_order("select 1")


def test_observations(spark):
    files = spark.createDataFrame([("a/x.csv",), ("a/b/y.csv",), ("z.txt",)], "path string")
    assert rows(observe.ls(files)) == [("a/", 2), ("z.txt", 1)]
    assert rows(observe.ls(files, "a")) == [("b/", 1), ("x.csv", 1)]
    texts = spark.createDataFrame([("t", "one\r\ntwo\rthree")], "path string, text string")
    assert rows(observe.read_text(texts, "t", 2)) == [(2, "two"), (3, "three")]
    calls = spark.createDataFrame([(1, "a/"), (1, "z.txt"), (2, "*.csv"), (3, "none.txt")], "iid int, item string")
    assert rows(observe.read_set(calls, files)) == [(1, "a/b/y.csv"), (1, "a/x.csv"), (1, "z.txt"), (2, "a/b/y.csv"), (2, "a/x.csv")]


def test_read_set_of_many_patterns(spark):
    n = 1200
    calls = spark.createDataFrame([(i, f"d{i}/" if i % 2 else f"d{i}/*.csv") for i in range(n)] + [(n, "?7.csv"), (n, "nope/")], "iid long, item string")
    files = spark.createDataFrame([(f"d{i}/x{i}.csv",) for i in range(n)] + [("d7x/y.csv",)], "path string")
    assert set(rows(observe.read_set(calls, files))) == {(i, f"d{i}/x{i}.csv") for i in range(n)} | {(n, "d7/x7.csv")}


def test_drifting_parquet(spark, tmp_path):
    spark.sql("select 1L as trip, 2L as fee, 'x' as Extra").coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.sql("select 2L as Trip, 2.5D as Airport_fee").coalesce(1).write.parquet(f"{tmp_path}/b")
    spark.sql("select 3 as trip").coalesce(1).write.parquet(f"{tmp_path}/c")
    got = readers.read_drifting(spark, [f"{tmp_path}/{x}" for x in "abc"], {"trip": ("bigint", ["trip"]), "fee": ("double", ["airport_fee", "fee"])})
    assert rows(got.select("trip", "fee")) == [(1, 2.0), (2, 2.5), (3, None)]
    name = next((tmp_path / "a").glob("*.parquet"))
    assert readers.footer_columns(str(name))[0] == ("trip", "int64")
    assert readers.footer_stats(str(name), "trip") == {"min": 1, "max": 1, "null_count": 0, "n_rows": 1}


def test_csv_with_bare_returns_and_growing_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"date,model\r2020-01-01,A\r2020-01-02,B\r")
    (tmp_path / "b.csv").write_bytes(b"date,model,smart\n2020-01-03,C,7\n")
    (tmp_path / "c.csv").write_bytes(b"date,model\n")
    got = readers.read_csv_text(spark, [f"{tmp_path}/{x}.csv" for x in "abc"])
    assert rows(got.select("date", "model", "smart")) == [("2020-01-01", "A", None), ("2020-01-02", "B", None), ("2020-01-03", "C", "7")]


def test_shards_first_record_wins(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"iid": "a", "t": 1, "v": 1}\nnot json\n')
    (tmp_path / "d.x.jsonl").write_text('{"iid": "a", "t": 1, "v": 2}\n{"iid": "b", "t": 1, "v": 3}\n')
    got = readers.read_shards(spark, [f"{tmp_path}/d.jsonl", f"{tmp_path}/d.x.jsonl"], "iid string, t int, v int", ["iid", "t"])
    assert rows(got.select("iid", "t", "v")) == [("a", 1, 1), ("b", 1, 3)]


def test_blobs(spark, tmp_path):
    sha, n = sinks.put_blob(str(tmp_path), b"hello", ".txt")
    assert sinks.put_blob(str(tmp_path), b"hello", ".txt") == (sha, 5) and n == 5
    assert sinks.verify_blobs(spark, str(tmp_path)).count() == 0
    (tmp_path / sha[:2] / f"{sha}.txt").write_bytes(b"changed")
    assert sinks.verify_blobs(spark, str(tmp_path)).count() == 1


def test_merges(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    assert rows(sinks.merge_by_key(a, b, ["k"])) == [(1, "x"), (2, "y"), (3, "z")]
    assert rows(sinks.fill_missing(a, b, ["k"], "v")) == [(1, "x"), (2, "y"), (3, "z")]


def reads(spark, seed=3):
    rng = random.Random(seed)
    data = [(i, t, f"v{rng.randrange(3)}", f"s{rng.randrange(4)}", 10 * t, rng.choice(["still_valid", "changed", "unsure"])) for i in range(4) for t in range(1, 30)]
    return data, spark.createDataFrame(data, "iid long, t long, truth string, state string, tokens long, verdict string")


def test_verdict_machine_against_a_loop(spark):
    data, df = reads(spark)
    want = []
    for iid in range(4):
        served = anchor = since = None
        seen = set()
        for i, t, truth, state, tokens, verdict in (d for d in data if d[0] == iid):
            ev = der = 0
            if anchor is None or t - since >= 12:
                action = "derive" if anchor is None else "forced"
            elif state == anchor:
                action = "same"
            elif state in seen:
                action = "memo"
            else:
                ev = tokens // 10
                action = {"still_valid": "valid", "changed": "repair", "unsure": "rederive"}[verdict]
            if action in ("derive", "forced", "repair", "rederive"):
                served, anchor, since, der, seen = truth, state, t, tokens, set()
            elif action == "valid":
                seen.add(state)
            want.append((i, t, action, served, served != truth, ev, der))
    assert rows(policies.verdict_driven(df, force_after=12)) == sorted(want, key=str)


def test_verdict_machine_with_nulls_ties_and_batches(spark):
    data = [(None, 1, "a", None, 9, None), (None, 2, "b", None, 9, "changed"), (None, 3, "c", "s", None, None), (1, 1, None, "s", 10, None), (1, 1, "x", "s2", 25, "unsure"), (1, 2, "x", "s2", 25, "changed"), (1, 3, "y", "s3", 25, "unsure")]
    df = spark.createDataFrame(data, "iid long, t long, truth string, state string, tokens long, verdict string")
    got = [tuple(r) for r in policies.verdict_driven(df, unsure="fresh").orderBy("iid", "t", "action").collect()]
    assert got == [
        (None, 1, "derive", "a", False, 0, 9),
        (None, 2, "same", "a", True, 0, 0),
        (None, 3, "rederive", "c", False, None, None),
        (1, 1, "derive", None, False, 0, 10),
        (1, 1, "unsure_fresh", None, True, 2, 0),
        (1, 2, "memo", None, True, 0, 0),
        (1, 3, "unsure_fresh", None, True, 2, 0),
    ]
    assert policies.verdict_driven(df.where("false")).count() == 0
    # a key is carried over from batch to batch
    _, many = reads(spark)
    whole = rows(policies.verdict_driven(many, force_after=12))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        assert rows(policies.verdict_driven(many, force_after=12)) == whole
    finally:
        spark.conf.set(name, before)


def test_expiry_by_age_over_sparse_reads_against_a_loop(spark):
    rng = random.Random(8)
    data = [(i, t, f"v{t}") for i in (None, 1, 2) for t in sorted(rng.sample(range(500), 60))]
    df = spark.createDataFrame(data, "iid long, t long, truth string")
    for k in (1, 7, 90):
        want, last = set(), {}
        for i, t, _ in data:
            if i not in last or t - last[i] >= k:
                last[i] = t
                want.add((i, t))
        assert {tuple(r) for r in policies.ttl_age_reads(df.unionAll(df), k).collect()} == want
        got = policies.ttl_age(df, k).collect()
        assert {(r.iid, r.t) for r in got if r.derived} == want and len(got) == len(data)
    assert policies.ttl_age(df.where("false"), 3).count() == 0


def test_replay_never_serves_a_changed_state(spark):
    _, df = reads(spark)
    got = policies.guard(df.withColumn("truth", F.col("state")))
    assert got.where("wrong").count() == 0
    never = policies.never(df).agg(F.avg(F.col("wrong").cast("int"))).first()[0]
    first = df.where("t = 1").select("iid", F.col("truth").alias("k"))
    valid = df.join(first, "iid").agg(F.avg((F.col("truth") == F.col("k")).cast("int"))).first()[0]
    assert abs(never - (1 - valid)) < 1e-12
    assert policies.always(df).where("wrong").count() == 0


def test_episode_edges(spark):
    def rec(iid, oks):
        return [(iid, t + 1, ok, ok, False, "same", 0, 0) for t, ok in enumerate(oks)]

    data = rec(1, [True] * 4) + rec(2, [False] * 3) + rec(3, [True, False]) + rec(4, [False])
    df = spark.createDataFrame(data, "iid int, t int, served_valid boolean, stored_valid boolean, flagged boolean, action string, eval_tok long, der_tok long")
    got = rows(records.episodes(df).select("iid", "n_reads", "censored", "delay"))
    assert got == [(2, 3, True, None), (3, 1, True, None), (4, 1, True, None)]
    assert {r.iid: (r.n_wrong, r.ever_wrong) for r in records.per_fact(df).collect()} == {1: (0, False), 2: (3, True), 3: (1, True), 4: (1, True)}


def test_profiles_combine_to_a_direct_scan(spark):
    df = spark.sql("select id, timestamp_ntz'2020-01-05' + make_dt_interval(cast(id as int)) as ts, date_format(timestamp_ntz'2020-01-05' + make_dt_interval(cast(id as int)), 'yyyy-MM') as m, cast(id as double) / 7 - 3 as x from range(200)")
    p = profile.profile(df, "m", "ts", ["x"])
    assert p.agg(F.sum("sum_x")).first()[0] == df.agg(F.sum(scalar.exact_cents(F.col("x")))).first()[0]
    assert p.agg(F.sum("n")).first()[0] == 200 and p.agg(F.sum("n_outside")).first()[0] == 0


def test_spans_and_citations(spark):
    t = spark.createDataFrame([("f", "aaa\nstart here\nmid\nthe end\nzzz")], "path string, text string")
    a = spark.createDataFrame([("f", "start here", "the end", 4), ("f", "gone", "the end", 1)], "path string, first string, last string, at int")
    assert rows(evidence.spans(t, a)) == [("f", 2, 4), ("f", None, 4)]
    x = spark.createDataFrame([(1, 0, "line one\nlonger line two"), (1, 1, "other")], "iid int, t int, text string")
    c = spark.createDataFrame([(1, "line one"), (1, "two"), (1, "longer line")], "iid int, cite string")
    got = {r.t: r.present for r in evidence.citations(x, c).collect()}
    assert got == {0: [True, True, False], 1: [False, False, False]}


def test_samples_and_signs(spark):
    s = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b")], "k int, verdict string")
    assert rows(evidence.combine_samples(s, ["k"])) == [(1, "a"), (2, "unsure")]
    assert rows(evidence.combine_samples(s, ["k"], "unanimous")) == [(1, "unsure"), (2, "unsure")]
    assert inference.sign_test(0, 0) == 1.0 and abs(inference.sign_test(9, 1) - 22 / 1024) < 1e-12
    assert policies.bursty(200) == policies.bursty(200) and max(policies.bursty(200)) <= 200


def test_stream_ttl_equals_the_batch(spark, tmp_path):
    data, df = reads(spark)
    src = str(tmp_path / "in")
    df.where("t < 15").coalesce(1).write.parquet(src)
    df.where("t >= 15").coalesce(1).write.mode("append").parquet(src)
    for i, f in enumerate(sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: -len(f.name) * 0 + f.stat().st_mtime)):
        import os

        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = facade.ttl_reads(stream.select("iid", "t", "truth"), 7).writeStream.format("memory").queryName("ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = policies.ttl_age(df, 7).select("iid", "t", "served", "derived")
    assert rows(spark.table("ttl")) == rows(want)


def test_stream_windows_and_manifest(spark, tmp_path):
    e = spark.sql("select timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(id as int)) as ts, concat('k', id % 3) as kind, id from range(100)")
    src = str(tmp_path / "in")
    e.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = facade.windowed_counts(stream, "ts", "kind").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("win")) == rows(facade.windowed_counts(e, "ts", "kind"))
    log = stream.select(F.col("kind").alias("path"), F.col("id").alias("idx"), F.col("id").cast("string").alias("sha"))
    q = facade.latest_manifest(log).writeStream.format("memory").queryName("man").outputMode("complete").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("man")) == [("k0", "99", 99), ("k1", "97", 97), ("k2", "98", 98)]


def test_asof_ties_and_early_tasks(spark):
    clock = spark.createDataFrame([("r", 10.0, 1), ("r", 20.0, 2)], "repo string, time double, t int")
    tasks = spark.createDataFrame([("r", 5.0, 7), ("r", 10.0, 8), ("r", 25.0, 9), ("q", 1.0, 6)], "repo string, time double, task int")
    assert rows(arrivals.asof(tasks, clock, "repo").select("task", "t")) == [(6, None), (7, None), (8, 1), (9, 2)]


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert json.dumps(sorted(__spark_entry__.queries()))
