"""Defined cases: empty tables, nulls, repeated rows, very long values, extra columns; and the working tables' owners."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, html_text, near_join, pii, quality, topk
from palimpsest.llm._common import join_table, materialize, release, scratch, small, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ti string, key long"


def test_scratch(spark):
    before = written()
    with scratch(spark) as keep:
        a, gone = materialize(spark.range(3)), materialize(spark.range(9))
        with scratch(spark) as inner:
            b, c = inner(materialize(spark.range(4))), materialize(spark.range(5))
        assert b.count() == 4
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            c.count()
        keep(a)
    assert a.count() == 3
    for t in (b, gone):
        with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
            t.count()
    release(a)
    assert written() == before


def test_scratch_keeps_nothing_after_an_error(spark):
    before = written()
    with pytest.raises(ValueError), scratch(spark):
        materialize(spark.range(3))
        raise ValueError
    assert written() == before


def test_only_small_tables_are_broadcast(spark):
    assert small(spark.range(10)) and small(spark.createDataFrame([], "s string"))
    assert not small(spark.range(40).select(F.repeat(F.lit("x"), F.lit(1_000_000)).alias("s")))
    assert not small(spark.range(300_000))


def test_tables_of_many_rows_or_long_texts_in_structs_are_not_broadcast(spark):
    assert small(spark.range(40_000)) and not small(spark.range(100_000)) and small(spark.range(100_000), 100_000)
    long = F.struct(F.lit(1).alias("n"), F.struct(F.repeat(F.lit("x"), F.lit(1_000_000)).alias("s")).alias("in"))
    assert not small(spark.range(40).select(long.alias("key")))


def test_components_of_many_edges_send_none_to_the_driver(spark, monkeypatch):
    seen, join = [], near_join.join_table
    monkeypatch.setattr(near_join, "join_table", lambda *a, known_small=None, **b: seen.append(known_small) or join(*a, known_small=known_small, **b))
    edges = spark.range(30_000).select((10 * F.col("id") + 1).alias("a"), (10 * F.col("id")).alias("b"))
    edges = edges.union(edges.select((F.col("a") + 1).alias("a"), "a"))
    got = near_join.components(edges)
    assert seen and not any(x is not False for x in seen)
    assert got.count() == 90_000 and got.where(F.col("component") != F.col("id") - F.col("id") % 10).count() == 0


def test_long_lists_of_dropped_rows_are_not_broadcast(spark, tmp_path):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = corpus_pipeline._numbered(spark.read.parquet(f"{tmp_path}/d"))
    with scratch(spark):
        dropped = materialize(docs.where("doc_id > 1").select("row"))
        out = corpus_pipeline._without(docs, dropped)
        assert sorted(r.doc_id for r in out.collect()) == [0, 1]
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_links_of_rows_without_doc_id(spark):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"thing{i}" for i in range(60))
    rows = [(None, text), (None, text + " end"), (None, other), (4, other), (5, text + " more"), (6, "quite another one")]
    got = near_join.near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # null is no doc_id: the least of those there are names a class
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.n_links) for r in got) == [(-1, 4, 0), (-1, 5, 2), (-1, 5, 2), (4, 4, 0), (5, 5, 2), (6, 6, 0)]


@pytest.mark.parametrize("known_small", [True, False])
def test_join_table_is_null_safe(spark, known_small):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)] * 3, "k string, v int")
    table = spark.createDataFrame([(None, "none"), ("a", "A")], "k string, name string")
    got = sorted((r.k or "", r.v, r.name or "") for r in join_table(rows, table, ["k"], "left", known_small=known_small).collect())
    assert got == sorted([("", 1, "none"), ("a", 2, "A"), ("b", 3, "")] * 3)


def test_quality_of_odd_documents(spark):
    long = "a fine word and more " * 50_000
    rows = [(i, "Fine words, in order." if i % 2 else "BAD!! %%% BAD!!", "en", "s", 20, 0.5, "x", 1) for i in range(40)]
    odd = [(None, None, None, None, None, None, None, None), (100, "", "", "", 0, None, None, None), (100, "", "", "", 0, None, None, None), (101, long, "en", "s", len(long), None, None, None)]
    df = spark.createDataFrame(rows + odd, DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(30)] + [(3, 0, 0, "x"), (None, None, None, None)], "doc_id long, quality int, toxic int, ti string")
    model = quality.train(df, labels)
    got = quality.score(df, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 100}) == 1
    assert quality.score(df.where("false"), model).collect() == []
    assert quality.train(df.where("false"), labels) == 0.5 and quality.train(df, labels.where("quality = 1")) == 1.0


def test_surrogates_of_odd_documents(spark):
    long = "Mr Paul Smith wrote to a.b@mail.example.com. " * 20_000
    rows = [(None, "Call +1 274 555 9629", "en", "s", 1, None, None, None)] * 2 + [(1, long, None, None, None, None, None, None), (2, None, None, None, None, None, None, None)]
    got = pii.replace_entities(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and len({r.text for r in got if r.doc_id is None}) == 1
    whole = next(r for r in got if r.doc_id == 1)
    assert whole.n_entities == 40_000 and len(set(whole.text.split(". "))) == 2  # all mentions alike; the last has no ". " after it
    assert "Smith" not in whole.text and "example" not in whole.text


def test_chat_with_a_very_long_turn(spark):
    long = "</turn> \\ " * 100_000
    df = spark.createDataFrame([(1, 0, "user", long, 1), (1, 1, "assistant", long, 1), (2, None, None, None, None)], "conv_id long, turn long, role string, text string, complete int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[1].n_turns == 2
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)


def test_topk_with_long_vectors(spark):
    rows = [(i, [float((i * j) % 7) for j in range(5000)]) for i in range(1, 60)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b))
    q = rows[49][1]
    want = sorted((-score(q, v), i) for i, v in rows if i != 50)[:5]
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


@pytest.mark.parametrize("tasks", [1, 64])
def test_topk_does_not_depend_on_the_grid(spark, monkeypatch, tasks):
    rows = [(i, [float((i * j) % 11) - 5 for j in range(1, 9)]) for i in range(0, 400, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "PAIRS", 200 * 4 // tasks)
    monkeypatch.setattr(topk, "BLOCK", 16)
    score = lambda a, b: sum(int(256 * x) * int(256 * y) for x, y in zip(a, b))
    want = [(q, n + 1, i, -s) for q, qv in rows if q % 50 == 0 for n, (s, i) in enumerate(sorted((-score(qv, v), i) for i, v in rows if i != q)[:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect()) == sorted(want)


def test_pages_with_extra_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Some words, in order.</p></article>", "x")] * 2 + [(None, None, None, None)], "page_id long, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text) for r in html_text.extract_pages(df).collect())
    assert got == [(0, ""), (1, "Some words, in order."), (1, "Some words, in order.")]
