"""Operators that no SQL covers: sources, sinks, texts, registries and small assignments."""

import difflib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import arrivals, evidence, inference, manifest, observe, policies
from palimpsest.plans import series
from palimpsest.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_approximate_distinct(spark):
    r = series.approximate_distinct(spark, SF).first()
    assert abs(r.approximate - r.exact) <= 0.05 * r.exact


def test_zipped_csv(spark, tmp_path):
    def archive(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, text in members.items():
                z.writestr(n, text)

    archive("a.zip", {"d/x.csv": "id,name\r\n1,one\r\n2,\r\n", "__MACOSX/d/._x.csv": "junk", "d/._y.csv": "junk", "readme.txt": "no"})
    archive("b.zip", {"y.csv": 'name,extra,id\r"t,wo",z,3\rbad,z,x4\r', "empty.csv": "id,name\n"})
    got = sorted(tuple(r) for r in readers.read_zipped_csv(spark, str(tmp_path), "id long, name string").na.fill({"name": "-"}).na.fill({"id": -1}).collect())
    assert got == [("a.zip", "d/x.csv", 1, "one"), ("a.zip", "d/x.csv", 2, "-"), ("b.zip", "y.csv", -1, "bad"), ("b.zip", "y.csv", 3, "t,wo")]


def test_ingest_is_done_once(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    target, catalogue = f"{tmp_path}/out", f"{tmp_path}/catalogue"
    assert sinks.ingest(spark, df, "one", target, catalogue) and not sinks.ingest(spark, df.limit(1), "one", target, catalogue)
    assert sinks.ingest(spark, df.limit(3), "two", target, catalogue)
    assert {(r.name, r.n_rows) for r in spark.read.parquet(catalogue).collect()} == {("one", 10), ("two", 3)}
    assert spark.read.parquet(f"{target}/one").count() == 10


def test_footers(spark, tmp_path):
    spark.range(0, 1000).select("id", F.when(F.col("id") > 9, F.format_string("k%03d", "id")).alias("k")).repartition(3).write.option("compression", "zstd").parquet(f"{tmp_path}/t")
    r = readers.footers(spark, f"{tmp_path}/t", "k").first()
    assert (r.n_rows, r.lo, r.hi, r.nulls, r.codec) == (1000, "k010", "k999", 10, "ZSTD")
    r = readers.footers(spark, f"{tmp_path}/t", "id").first()
    assert (r.lo, r.hi, r.nulls) == ("0", "999", 0)


def test_blobs_through_the_file_system_of_spark(spark, tmp_path):
    a = sinks.put_blob(f"file://{tmp_path}", b"some bytes", ".bin", spark)
    assert a == sinks.put_blob(str(tmp_path), b"some bytes", ".bin")
    assert [p.name for p in tmp_path.rglob("*.bin")] == [a[0] + ".bin"]
    assert sinks.verify_blobs(spark, str(tmp_path)).count() == 0


def test_cache(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, q string").withColumn("key", sinks.request_key("q"))
    cache = rows.where("id = 2").select("key", F.lit("yes").alias("response"))
    assert {(r.id, r.response, r.hit) for r in sinks.cached(rows, cache).collect()} == {(1, "unsure", False), (2, "yes", True), (3, "unsure", False)}


def test_markdown(spark):
    rows = spark.createDataFrame([(1, 0.123456, "a|b\nc"), (2, None, None)], "i int, x double, s string")
    assert sinks.markdown(rows.orderBy("i")) == "| i | x | s |\n|---|---|---|\n| 1 | 0.1235 | a\\|b c |\n| 2 |  |  |\n"
    assert "more rows follow" in sinks.markdown(spark.range(5), most=2)


def test_sources_against_a_catalogue(spark):
    found = spark.createDataFrame([("a", 1, "s"), ("b", 2, "s"), ("c", 3, "t"), ("d", 4, "s")], "path string, n_rows long, columns string")
    known = spark.createDataFrame([("a", 1, "s"), ("b", 9, "s"), ("c", 3, "s"), ("e", 5, "s")], "path string, n_rows long, columns string")
    got = {r.path: r.verdict for r in sinks.verify_sources(known, found).collect()}
    assert got == {"a": "ok", "b": "rows differ", "c": "schema differs", "d": "unknown", "e": "missing"}


def test_shards_keep_the_first_record_of_the_order_given(spark, tmp_path):
    for name, first in (("b.jsonl", 0), ("a.jsonl", 1000)):
        (tmp_path / name).write_text("".join(f'{{"k": {i % 50}, "v": {first + i}}}\n' for i in range(200)) + "broken\n")
    got = readers.read_shards(spark, [f"{tmp_path}/b.jsonl", f"{tmp_path}/a.jsonl"], "k long, v long", ["k"]).collect()
    assert sorted((r.k, r.v) for r in got) == [(i, i) for i in range(50)]


def test_listed(spark):
    f = spark.createDataFrame([(f"d/f{i:03d}.csv",) for i in range(160)], "path string")
    text = observe.listed("find", observe.find(f, "*.csv"), ["path"], F.col("path"))
    assert text.count("\n") == 150 and text.startswith("d/f000.csv\n") and text.endswith("[more than 150]")
    assert observe.listed("find", observe.find(f, "*.txt"), ["path"], F.col("path")).startswith("ERROR")


def test_guard(spark):
    o = spark.range(10).withColumn("name", F.lit("t.parquet"))
    rows, more = observe.guarded_sql(spark, "SELECT a.id, 'u.parquet' AS s FROM 't.parquet' a JOIN 'u.parquet' AS b ON a.id = b.id WHERE a.name = 't.parquet' ORDER BY 1", {"t.parquet": o, "u.parquet": o.limit(3)}, {"t.parquet": 10, "u.parquet": 3})
    assert [(r.id, r.s) for r in rows.collect()] == [(0, "u.parquet"), (1, "u.parquet"), (2, "u.parquet")] and not more
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with pytest.raises(observe.Refused, match="budget"):
        observe.guarded_sql(spark, "SELECT * FROM 't.parquet'", {"t.parquet": o}, {"t.parquet": 2_000_000})


def test_tools():
    known = {t["name"]: t for t in observe.tools()}
    assert [p["name"] for p in known["find"]["parameters"]] == ["glob"] and known["find"]["parameters"][0]["required"]
    with pytest.raises(observe.Refused):
        observe.call("rm", {})


def test_call(spark):
    f = spark.createDataFrame([("a/b.csv",), ("a/c.txt",)], "path string")
    assert [r.path for r in observe.call("find", {"glob": "*.csv", "unknown": 1}, files=f).collect()] == ["a/b.csv"]


def test_hunks(spark):
    rng = random.Random(2)
    rows = []
    for i in range(20):
        a = [f"line {rng.randint(0, 30)}" for _ in range(40)]
        b = a[:]
        for _ in range(3):
            b[rng.randrange(len(b))] = f"new {rng.randint(0, 9)}"
        rows.append((i, "\n".join(a), "\n".join(b)))
    got = {r.i: r.hunks for r in evidence.hunks(spark.createDataFrame(rows, "i int, a string, b string"), "a", "b").collect()}
    for i, a, b in rows:
        want = [x for x in difflib.unified_diff(a.split("\n"), b.split("\n"), n=2, lineterm="")][2:]
        told = [x for x in want if not x.startswith("@@")]
        assert "\n".join(told) == "\n".join(h.text for h in got[i]) and len(got[i]) == len(want) - len(told)


def test_capped_groups(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randint(0, 60)) for k in range(5) for i in range(50)]
    got = evidence.capped_groups(spark.createDataFrame(rows, "k int, i int, size int"), "k", "i", "size", 100).collect()
    for k in range(5):
        want, n, total = [], 0, 0
        for _, _, size in sorted(r for r in rows if r[0] == k):
            if n and total + size > 100:
                want.append((n, total))
                n = total = 0
            n, total = n + 1, total + size
        want.append((n, total))
        assert [(r.n_items, r.total) for r in sorted((r for r in got if r.k == k), key=lambda r: r.group)] == want


def test_greedy_assignment():
    got = arrivals.greedy_assignment([("x", 10.0), ("y", 9.0), ("z", 1000.0)], [("p", 9.5), ("q", 100.0), ("r", 9.5)])
    assert got == {"y": "p", "x": "r", "z": "q"}
    assert arrivals.greedy_assignment([("x", 1.0), ("y", 2.0)], [("p", 1.0)]) == {"x": "p"}


def test_policy_names(spark):
    reads = spark.createDataFrame([(1, t, f"a{t // 4}", f"s{t // 4}") for t in range(1, 20)], "iid long, t long, truth string, state string")
    assert policies.run("replay", reads).where("wrong").count() == 0 and policies.run("never", reads).where("wrong").count() == 16
    assert policies.run("ttl_age3", reads).where("derived").count() == 7
    with pytest.raises(KeyError):
        policies.run("sometimes", reads)


def test_zipf_draws_follow_the_law(spark):
    facts = spark.range(1, 21).select(F.lit("r").alias("repo"), F.col("id").alias("iid"), F.col("id").alias("rank"))
    tasks = spark.range(4000).select(F.lit("r").alias("repo"), F.col("id").alias("task"))
    got = arrivals.zipf_tasks(facts, tasks, 3, 1.1).collect()
    assert len(got) == 12000 and len({(r.task, r.iid) for r in got}) == 12000
    first = [r.iid for r in got if r.n == 1]
    weight = [i**-1.1 for i in range(1, 21)]
    for i in (1, 2, 5):
        assert abs(first.count(i) / 4000 - weight[i - 1] / sum(weight)) < 0.03


def test_wilcoxon_and_margins(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 2, -3, 0, 4, -1)], "d double")
    r = inference.wilcoxon(d).first()
    assert (r.n, r.w_plus, r.w_minus) == (6, 1.5 + 3.5 + 3.5 + 6, 5 + 1.5)
    m = inference.margins(spark.createDataFrame([(-0.01, 0.015)], "low90 double, high90 double"), [0.01, 0.02])
    assert {(x.margin, x.non_inferior, x.equivalent) for x in m.collect()} == {(0.01, False, False), (0.02, True, True)}
    assert abs(inference.sign_test(1, 9) - 0.021484375) < 1e-12


def test_float_text(spark):
    xs = [0.0, 1.0, -2095.23, 1 / 3, 1e-4, 9.9999e-5, 1e-7, 123456789.123456, 9999999999.4, 1e10, 1.5e300, -1e-300, 100.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(scalar.float_text(F.col("x"))).collect()]
    assert [g.lower() for g in got] == [f"{x:.10g}" for x in xs]


def test_schema_changes(spark):
    rows = [(1, "a", "int"), (1, "b", "int"), (2, "a", "int"), (2, "b", "int"), (3, "a", "long"), (3, "c", "int")]
    got = manifest.schema_changes(spark.createDataFrame(rows, "m int, name string, type string"), "m").collect()
    assert [tuple(r) for r in got] == [(3, "c", "b", "a")]


def test_asof_with_gaps_and_one_hot_key(spark):
    rng = random.Random(5)
    clock = [("k", rng.randint(0, 40 * 86400), i) for i in range(40)]
    tasks = [("k", rng.randint(0, 40 * 86400), i) for i in range(300)] + [("other", 5, 0)]
    frame = lambda rows, c: spark.createDataFrame(rows, f"by string, s long, {c} long").withColumn("time", F.timestamp_seconds("s")).drop("s")
    got = {(r.by, r.task): r.t for r in arrivals.asof(frame(tasks, "task"), frame(clock, "t"), "by").collect()}
    times = {i: s for _, s, i in clock}
    for by, s, i in tasks:
        before = [x for x in clock if x[0] == by and x[1] <= s]
        assert (got[by, i] is None) == (not before) and (not before or times[got[by, i]] == max(x[1] for x in before))


def test_canonical_rows(spark):
    rows = spark.createDataFrame([(2, None), (1, "b"), (10, "a")], "i int, s string")
    assert [r.i for r in observe.canonical_rows(rows, "select * from t").collect()] == [1, 10, 2]
    assert observe.canonical_rows(rows, "select * from t order by i") is rows


def test_environment(spark):
    from palimpsest.operators import environment

    log = spark.createDataFrame([("d/a_2020-01.p", 0, "x"), ("d/a_2020-02.p", 2, "y"), ("d/a_2020-01.p", 4, "z"), ("d/b_2020-01.p", 3, "w"), ("d/a_2020-02.p", 5, None)] + [("d/c.txt", i, f"c{i}") for i in range(7)], "path string, idx long, sha string")
    profiles = spark.createDataFrame([("x", 10), ("y", 5), ("z", 7), ("w", 1)], "sha string, n long")
    facts = spark.createDataFrame([(1, "a", "all"), (2, "a", "2020-02"), (3, "b", "2020")], "iid int, ds string, period string")
    env = environment.Lake(log, profiles, facts, r"^d/([a-z])_(\d{4}-\d{2})\.p$")
    truth = {(r.iid, r.t): r.truth for r in env.truth().collect()}
    assert [truth[1, t] for t in range(7)] == ["10", "10", "15", "15", "12", "7", "7"]
    assert [truth[2, t] for t in range(7)] == ["NONE", "NONE", "5", "5", "5", "NONE", "NONE"]
    assert [truth[3, t] for t in range(7)] == ["NONE", "NONE", "NONE", "1", "1", "1", "1"]
    got = environment.keep(env, "replay").collect()
    assert not any(r.wrong for r in got) and sum(r.derived for r in got) == 4 + 3 + 2
    assert {(r.iid, r.t) for r in environment.changes(env).collect()} == {(1, 2), (1, 4), (1, 5), (2, 2), (2, 5), (3, 3)}
    assert sum(r.wrong for r in environment.keep(env, "never").collect()) == 5 + 3 + 4
    assert {r.path for r in env.world(5).collect()} == {"d/a_2020-01.p", "d/b_2020-01.p", "d/c.txt"}
