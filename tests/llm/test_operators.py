"""Operators on small tables: brute force, and the cases that the docstrings define."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import chat, exact_dedup, html_text, langid, mixing, near_join, packing, pii, quality, registry, topk
from palimpsest.llm._common import load

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, size string, row long, key string"
LONG = "lorem ipsum dolor sit amet consectetur " * 20_000
SOME = [
    (1, "a b c d e f g h i j k l m n o p q r s t u v w x y z", "en", "s1", 51),
    (2, "a b c d e f g h i j  k l m n o p q r s t u v w x y z", "en", "s1", 51),
    (3, "a b c d e f g h i j k l m n o p q r s t u v w x y zz", "en", None, 52),
    (4, None, None, None, None),
    (5, "", "en", "s2", 0),
    (5, "", "en", "s2", 0),
    (None, "hello world", None, "s2", 11),
    (None, "hello world", "de", "s2", None),
    (9, LONG, "la", "s3", len(LONG)),
    (10, "é ü 123", "fr", "", 7),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", 0, "y") for r in rows], DOCS)


@pytest.fixture
def docs(spark):
    return frame(spark, SOME)


def test_exact(spark, docs):
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    norm = [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in SOME]
    assert len(got) == len(SOME)
    for (doc, *_), t in zip(SOME, norm):
        same = [r[0] for r, u in zip(SOME, norm) if u == t]
        least = min((x for x in same if x is not None), default=None)
        mine = [g for g in got if g[0] == doc and g[4] == hashlib.sha256(t.encode()).hexdigest()]
        assert mine and all(g[1] == least and g[2] == len(same) for g in mine)
    assert sum(g[3] for g in got) == len(set(norm))


def test_exact_verifies_clashing_hashes(spark, docs, monkeypatch):
    want = sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=str)
    clash = frozenset(exact_dedup._hash(r[1].encode()) for r in SOME if r[1])
    run = exact_dedup._verified(clash)
    monkeypatch.setattr(exact_dedup, "_recipes", run)
    assert sorted((tuple(r) for r in exact_dedup.exact_groups(docs).collect()), key=str) == want


def brute_links(rows):
    texts = defaultdict(list)
    for r in rows:
        texts[tuple(w for w in re.split("[\x20\x09-\x0d]+", r[1] or "") if w)].append(r[0])
    keys = list(texts)
    sets = [{k[i : i + 5] for i in range(max(1, len(k) - 4))} if k else set() for k in keys]
    links = Counter()
    group = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                group = [group[j] if g == group[i] else g for g in group]
    return keys, texts, links, group


def test_near(spark, docs):
    got = defaultdict(list)
    for r in near_join.near_links(docs).collect():
        got[r.doc_id].append((r.class_id, r.text_id, r.n_links))
    assert sum(map(len, got.values())) == len(SOME)
    keys, texts, links, group = brute_links(SOME)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    for i, k in enumerate(keys):
        cls = least([x for j in range(len(keys)) if group[j] == group[i] for x in texts[keys[j]]])
        for d in texts[k]:
            assert (cls, least(texts[k]), links[i]) in got[d]


def test_near_blocks_of_a_large_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(60):
        w = base[:]
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(60)] = f"v{rng.integers(1000)}"
        rows.append((d, " ".join(w[: 60 - d % 3]), "en", "s", 1))
    monkeypatch.setattr(near_join, "TASK_GRAMS", 500)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_links(frame(spark, rows)).collect()}
    keys, texts, links, group = brute_links(rows)
    for i, k in enumerate(keys):
        cls = min(x for j in range(len(keys)) if group[j] == group[i] for x in texts[keys[j]])
        assert all(got[d] == (cls, links[i]) for d in texts[k])


def test_near_large_group_with_repeated_passages(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for d in range(24):
        w = base[:]
        for _ in range(d % 4):
            w[rng.integers(300)] = f"v{rng.integers(1000)}"
        rows.append((d, " ".join(w + w[:150] * (d % 3)), "en", "s", 1))
    monkeypatch.setattr(near_join, "TASK_GRAMS", 6000)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_links(frame(spark, rows)).collect()}
    keys, texts, links, group = brute_links(rows)
    for i, k in enumerate(keys):
        cls = min(x for j in range(len(keys)) if group[j] == group[i] for x in texts[keys[j]])
        assert all(got[d] == (cls, links[i]) for d in texts[k])


@pytest.mark.parametrize("crowded", [2, 8])
def test_near_crowded_nodes(spark, monkeypatch, crowded):
    """Tries that go down to all depths and are taken back, on groups of near copies beside loosely related texts."""
    rng = np.random.default_rng(8)
    rows, doc = [], 0
    for group in range(12):
        base = [f"g{group}w{i}" for i in range(80)]
        shared = [f"s{i}" for i in range(30)]  # a passage of all texts
        for d in range(1 + 2 * group):
            w = base[:]
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(80)] = f"v{rng.integers(1000)}"
            rows.append((doc, " ".join(w[:60] + shared + w[60:]), "en", "s", 1))
            doc += 1
    rows += [(1000 + i, r[1], "en", "s", 1) for i, r in enumerate(rows[:20])]
    monkeypatch.setattr(near_join, "CROWDED", crowded)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_links(frame(spark, rows)).collect()}
    keys, texts, links, group = brute_links(rows)
    for i, k in enumerate(keys):
        cls = min(x for j in range(len(keys)) if group[j] == group[i] for x in texts[keys[j]])
        assert all(got[d] == (cls, links[i]) for d in texts[k])


def test_near_stars_are_cut_at_gaps(spark):
    """A text that met a node's centre by chance goes; copies of it that met there stay together."""
    sig = np.zeros((5, near_join.HASHES), dtype=np.uint8)
    sig[1, :10] = 1  # near the centre 0
    sig[2:, :] = 2  # far from it; 3 and 4 are near each other
    sig[3:, :40] = 3
    sigs = spark.createDataFrame([(i, bytes(s.tobytes())) for i, s in enumerate(sig)], "cid long, sig binary")
    stars = spark.createDataFrame([(7, i, 0) for i in (0, 1, 3, 4)] + [(8, 2, 0), (8, 0, 0)], "key long, cid long, least long")
    got = {tuple(r) for r in near_join._cut_stars(stars, sigs).collect()}
    assert got == {(1, 0), (4, 3)}


def test_near_task_with_one_empty_block():
    grams = [np.arange(10, dtype="<u8").tobytes()] * 2
    for part, n in ((0, 1), (1, 0), (2, 0)):
        got = near_join._verify(pa.table({"cid": pa.array([1, 2], pa.int64()), "grams": grams, "part": pa.array([part] * 2, pa.int32())}))
        assert sum(got.column("links").to_pylist()) == 2 * n


def test_topk_with_ties_and_odd_vectors(spark):
    rows = [(i, [float((i * 7) % 5) / 16, 0.25, -1.0 / (1 + i % 3)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 0.5]), (202, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (250, []), (3, rows[3][1]), (300, [1e6, -1e6, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("uid", F.lit(1)).withColumn("score", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df).collect())
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for qi, (q, qv) in enumerate(ok):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v)), c) for ci, (c, v) in enumerate(ok) if ci != qi)[:5]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_mixture(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 4}" if i % 3 else "s0", 1) for i in range(400)] + SOME
    df = frame(spark, rows)
    plan = mixing.plan_mixture(df).collect()
    assert len(plan) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, budget, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not full:
            break
        target |= {s: 2.0 * size[s] for s in full}
        budget -= sum(2 * size[s] for s in full)
        open_ -= full
        if not open_:
            break
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in plan:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken in (0, r.size, 2 * r.size) and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
    assert all(abs(taken["s%d" % i] - target["s%d" % i]) <= 4 for i in range(3))
    again = mixing.plan_mixture(df.repartition(3)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
    ordered = [r.position for r in mixing.curriculum(mixing.plan_mixture(df)).collect()]
    assert ordered == sorted(ordered)


def test_mixture_goes_on_behind_a_long_document(spark):
    for shift in range(3):
        rows = [(1000 * shift + i, "w " * 200, "en", "a", 1) for i in range(100)] + [(1000 * shift + 500, "w " * 50_000, "en", "a", 1)]
        plan = mixing.plan_mixture(frame(spark, rows), demand=24_000 / 70_000).collect()
        assert plan[0].target == pytest.approx(24_000) and sum(r.taken for r in plan) == 24_000
        assert all(r.copies <= 2 and len(r.positions) == r.copies for r in plan)
        ps = sorted(p for r in plan for p in r.positions)
        assert len(set(ps)) == 120 and ps[0] < 0.02 and 0.98 < ps[-1] < 1


def test_schedule_inverts(spark):
    knots = (1.5, 3.0, 0.0, 4.5)
    got = spark.range(0, 101).select((F.col("id") / 100).alias("u")).select("u", mixing.position(F.array(*map(F.lit, knots)), F.col("u")).alias("t")).collect()
    for u, t in got:
        x = np.linspace(0, t, 20_001)
        y = np.interp(x, np.linspace(0, 1, len(knots)), knots)
        assert abs(float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum()) - u * mixing.integral(knots)) < 1e-3


def test_language(spark, docs):
    rows = [(i, ("the and of with that " if i % 2 else "der die und nicht ein ") * 5, "en" if i % 2 else "de", "s", 1) for i in range(100)]
    df = frame(spark, rows + SOME)
    got = langid.identify(df, langid.train(df), ("doc_id", "lang")).select("doc_id", "lang", "text", "lang_pred", "score").collect()
    assert len(got) == len(rows) + len(SOME)
    for r in got:
        if not r.text or not re.search(r"[^\W\d_]", r.text.decode()):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.text.startswith((b"the", b"der")):
            assert r.lang_pred == r.lang
    none = langid.identify(docs, langid.train(docs.where("doc_id < 0"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_surrogates(spark):
    rows = [(1, "Write to a.b1@mail.example.com or A.B1@mail.example.com now", "en", "s", 1), (2, "a.b1@mail.example.com, 12.13.14.15", "en", "s", 1), (3, None, "en", "s", 1), (4, "", "en", "s", 1)]
    rows += [(10 + i, f"Call +1 ({200 + i}) 555-{1000 + i} please", "en", "s", 1) for i in range(60)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in pii.replace_entities(df).collect()}
    assert got[3].text is None and got[4].text == "" and len(got) == len(rows)
    for doc, text, *_ in rows:
        for e in got[doc].entities or []:
            assert text[e.start : e.end] not in got[doc].text
    assert got[1].entities[0].surrogate == got[2].entities[0].surrogate
    phones = [got[10 + i].entities[0].surrogate for i in range(60)]
    assert len(set(phones)) == 60


def narrow(kind, canon, key, attempt):
    return str((sum(map(ord, canon)) + attempt * 37) % 90).zfill(len(canon))


def test_surrogate_collisions_are_resolved(spark):
    rows = [(i, f"Call +1 ({200 + i}) 555-{1000 + i} please", "en", "s", 1) for i in range(60)]
    df = frame(spark, rows)
    table = pii.surrogate_table(df, make=narrow).collect()
    assert len({r.surrogate for r in table}) == 60 and any(r.attempt for r in table)
    a, b = (sorted((r.doc_id, r.text) for r in pii.replace_entities(df, make=narrow, broadcast_rows=n).collect()) for n in (1000, 0))
    assert a == b


def test_surrogates_of_short_names_never_run_out(spark):
    names = [a + b for a in "BCDFGHJKLMNPRSTVWZ" for b in "aeiou"]
    rows = [(i, f"Mr {n} and {n} again. Password: --------", "en", "s", 1) for i, n in enumerate(names)] + [(None, "Mr Li", "en", "s", 1)] * 2 + [(500, "Mr Bo " + "x" * 1_000_000, "en", "s", 1)]
    df = frame(spark, rows)
    table = pii.surrogate_table(df).collect()
    assert {r.canon for r in table} == {*names, "Li", "Bo"}
    assert len({r.surrogate for r in table}) == len(table) and not {r.surrogate for r in table} & {r.canon for r in table}
    new = {(r.kind, r.canon): r.surrogate for r in table}
    got = Counter((r.doc_id, r.text) for r in pii.replace_entities(df).collect())
    assert got == Counter((d, re.sub(r"\b([A-Z][a-z])\b(?= |$)", lambda m: new.get(("surname", m[1]), m[1]), t) if t else t) for d, t, *_ in rows)


def test_surrogates_of_the_query_are_those_of_a_plain_replacement(spark):
    """The whole query on a small table against detection and replacement in plain Python."""
    sf = "/root/testdata/sf0.001"
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    taken, new, originals = set(), {}, {u for r in rows for *_, us in pii.mentions(r.text or "") for u in us}
    open_ = {u: 0 for u in originals}
    while open_:  # by rounds: a surrogate that is an original, or another's, moves on
        tries = {u: pii.form(*u, pii.KEY, a) for u, a in (new | open_).items()}
        space = lambda u: "given" if u[0].startswith("given") else u[0]
        holders = defaultdict(list)
        for u, s in tries.items():
            holders[space(u), s].append(((new | open_)[u], u[1], u[0]))
        attempts = new | open_
        clash = {u for u, s in tries.items() if (attempts[u], u[1], u[0]) != min(holders[space(u), s]) or any((space(o), o[1]) == (space(u), s) for o in originals)}
        new, open_ = {u: a for u, a in attempts.items() if u not in clash}, {u: attempts[u] + 1 for u in clash}
    want = []
    for r in rows:
        out, at, text = [], 0, r.text
        for a, b, kind, us in pii.mentions(text or ""):
            out += [text[at:a], pii.dress(kind, text[a:b], " ".join(pii.form(*u, pii.KEY, new[u]) for u in us))]
            at = b
        want.append((r.doc_id, None if text is None else "".join([*out, text[at:]]), len(pii.mentions(text or ""))))
    got = [(r.doc_id, r.text, r.n_entities) for r in registry.QUERIES["op5_pii"](spark, sf).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and any(n for *_, n in got)


def test_quality(spark, docs):
    rows = [(i, "A fine sentence about things, with some words." if i % 3 else "BAD!! BAD!! %%% $$$ BAD!!", "en", f"s{i % 5}", 30) for i in range(300)]
    df = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(None, 1, 0), (5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.keep for r in quality.score(df, quality.train(df, labels)).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(300)]) > 0.98
    assert len(quality.score(docs, quality.train(docs, labels.limit(0))).collect()) == len(SOME)


def test_quality_learns_from_all_unlabelled(spark):
    rows = [(i, "A fine sentence about things, with some words." if i % 3 else "BAD!! BAD!! %%% $$$ BAD!!", "en", f"s{i % 5}", 30) for i in range(9000)]
    table = quality.views(frame(spark, rows))
    rest = quality.Spread(table.where("doc_id >= 300").withColumn("key", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2**31))))
    got = table.where("doc_id < 300").orderBy("doc_id").toArrow().combine_chunks().to_batches()
    xt, xm = (np.concatenate(x) for x in zip(*map(quality.dense, got)))
    y, held = np.array([int(i % 3 > 0) for i in range(300)]), np.arange(300) % 4 == 0
    one = quality.fit(xt, xm, y, held, rest)
    assert len(rest) == 8700
    # the text is sure of all: 5% of those still open in each of the rounds
    want = 8700 * (1 - 0.95**quality.ROUNDS)
    assert abs(sum(t.where("y1 >= 0").count() for t in rest.chosen) - want) < 0.1 * want
    every = rest.table.toArrow().combine_chunks().to_batches()
    rx = [np.concatenate(x) for x in zip(*map(quality.dense, every))]
    two = quality.fit(xt, xm, y, held, quality.Held(*rx, np.concatenate([b.column("key").to_numpy() for b in every])))
    assert np.allclose(one.text, two.text, atol=1e-4) and np.allclose(one.meta, two.meta, atol=1e-4)


def test_packing(spark, docs):
    pieces = packing.tokenise(docs, with_ids=True)
    got = packing.pack(pieces)
    rows = got.collect()
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(fill) == -(-sum(r.length for r in rows) // 2048) or len(fill) <= sum(r.length for r in rows) // 2048 + 2
    assert sum(r.piece == 0 for r in rows) == len(SOME)
    whole = packing.sequences(got).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)


def test_packing_depends_on_the_pieces_alone(spark):
    rng = random.Random(5)
    rows = [(i, 0, rng.randrange(1, 1500), rng.randrange(1 << 32)) for i in range(3000)]
    schema = "doc_id long, piece int, length long, ids_crc32 long"
    told = []
    for parts in (1, 7):
        rng.shuffle(rows)
        got = packing.pack(spark.createDataFrame(rows, schema).repartition(parts), most=700).collect()
        told.append({(r.doc_id, r.sequence_id, r.offset) for r in got})
    assert told[0] == told[1] and len(told[0]) == 3000
    # one row, many times over, is dealt out again and stays whole
    same = spark.createDataFrame([(1, 0, 500, 9)] * 2000 + rows[:100], schema)
    got = packing.pack(same, most=300)
    fill = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("d"), F.count("*").alias("k")).collect()
    assert sum(r.k for r in fill) == 2100 and all(r.n <= 2048 and r.d == r.k for r in fill)
    assert len({r.sequence_id >> 32 for r in got.collect()}) >= 7


def test_packing_order_beats_falling_lengths():
    rng = np.random.default_rng(5)
    length = np.clip(rng.lognormal(6.3, 0.9, 20_000), 1, 2047).astype(np.int64)
    draw = rng.integers(-(1 << 63), (1 << 63) - 1, len(length))
    made = [int(packing.sum_of_squares(length[o])[0].max()) + 1 for o in (packing.feed(length, draw, np.arange(len(length))), np.argsort(-length, kind="stable"))]
    least = -(-int(length.sum()) // 2048)
    assert least <= made[0] <= least * 1.001 and made[0] < made[1]


def test_chat_round_trip(spark):
    odd = ["", None, "</turn>", "<turn>", "<\\turn>", "</\\\\turn>\n", "\\### Assistant: </turn> ok", "a\nb", "\\b\\n"]
    rows = [(c, t, role, odd[(c + t) % len(odd)]) for c in range(6) for t, role in enumerate(["system", "user", "assistant", "user", "assistant", "weird\n<turn>\\n"][: c + 1])]
    rows += [(None, None, None, None), (7, 0, "assistant", "x"), (7, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, loss int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    convs = defaultdict(list)
    for c, t, role, text in rows:
        convs[c].append((t if t is not None else -1, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (2, None, "<article><p>a&nbsp; b<p>c", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_text.extract_pages(df).collect()) == ["", "", "a b\nc"]


@pytest.mark.parametrize(
    "run",
    [
        exact_dedup.exact_groups,
        near_join.near_links,
        mixing.plan_mixture,
        lambda d: mixing.curriculum(mixing.plan_mixture(d)),
        lambda d: langid.identify(d, langid.train(d)),
        pii.replace_entities,
        lambda d: packing.pack(packing.tokenise(d)),
    ],
)
def test_empty_documents(spark, docs, run):
    assert run(docs.where("doc_id < 0")).collect() == []


def test_empty_others(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pipeline(spark):
    """Every stage against a plain rule on its own input."""
    sf = "/root/testdata/sf0.001"
    before = load(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        rows = after.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == {r.doc_id for r in before.select("doc_id").collect()}
            break
        assert after.columns == list(corpus_pipeline.COLUMNS)
        texts = [r.text for r in before.select("text").collect()]
        if name == "language_id":
            told = {r.doc_id: (r.lang_pred, r.score) for r in registry.QUERIES["op4_langid"](spark, sf).collect()}
            assert {r.doc_id: r.lang for r in rows} == {d: lang for d, (lang, score) in told.items() if lang != "und" and score >= corpus_pipeline.least_score(4)}
            assert 0 < len(rows) <= sum(bool(t and re.search(r"[^\W\d_]", t)) for t in texts)
        elif name == "exact_dedup":
            assert len(rows) == len({re.sub("[\x20\x09-\x0d]+", " ", t) for t in texts})
        elif name == "near_dedup":
            keys, by, _, group = brute_links([(r.doc_id, r.text) for r in before.collect()])
            assert len(rows) == len(set(group))
        else:
            most = Counter(r.doc_id for r in rows)
            assert set(most.values()) <= {1, 2} and set(most) <= {r.doc_id for r in before.select("doc_id").collect()}
        before = spark.createDataFrame(rows, before.select(*corpus_pipeline.COLUMNS).schema)


def test_pipeline_on_odd_rows(spark, docs, tmp_path):
    """Null, empty, repeated and very long rows and further columns; and results of two runs held at once."""
    more = [(100 + i, " ".join(f"w{(i * j) % 97}" for j in range(60)), "en", "s9", 1) for i in range(12)]
    for d, rows in (("a", SOME + more), ("b", [(i, r[1], "de", None, 3) for i, r in enumerate(more)])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{d}/documents.parquet")
    a = corpus_pipeline.run(spark, f"{tmp_path}/a")
    b = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert b.count() > 0
    got = a.collect()
    assert sum(r.length for r in got) > 0 and {r.piece for r in got if r.doc_id == 9} > {0, 1}
    assert {r.doc_id for r in got} <= {r[0] for r in SOME + more if r[1] and re.search(r"[^\W\d_]", r[1])}


def test_pipeline_without_rows_or_languages(spark, docs, tmp_path):
    docs.where("doc_id < 0").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    blank = frame(spark, [(1, "", None, "s", 0), (2, "some words", None, "s", 1), (3, "12 !?", None, "s", 1), (4, None, None, "s", 1), (None, " ", None, None, None)])
    assert [r.doc_id for r in corpus_pipeline.identified(spark, blank, "").collect()] == [2]
    for name, stage in corpus_pipeline.STAGES[1:3]:  # neither looks at letters
        assert sorted(str(r.doc_id) for r in stage(spark, blank, "").collect()) == (["1", "2", "3", "None"] if name == "exact_dedup" else ["1", "2", "3", "4", "None"])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
