"""The registered queries that SQL can't express, whole, against plain Python on the smallest tables."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import html_text, langid, mixing, packing, quality, registry
from palimpsest.llm._common import load

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]


def table(spark, name):
    return [r.asDict() for r in load(spark, SF, name).collect()]


def test_op1(spark):
    model = html_text.trained()
    want = {}
    for r in table(spark, "pages"):
        nodes = html_text.parse(r["html"] or "")
        marginal = model.infer(nodes, html_text.features(nodes))[0]
        blocks = [" ".join("".join(n.parts).split()) for n, m in zip(nodes, marginal) if not n.tag and m >= 0.5]
        want[r["page_id"]] = (r["url"], "\n".join(b for b in blocks if b))
    got = rows(spark, "op1_html_text")
    assert {r["page_id"]: (r["url"], r["text"]) for r in got} == want and len(got) == len(want)
    assert all(r["n_chars"] == len(r["text"]) for r in got) and any(r["n_chars"] for r in got)


def spark_hash(*longs):
    h = 42
    for x in longs[:-1]:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", longs[-1]), h)  # the seed is an int
    return h - 2**64 if h >= 2**63 else h


def test_op3(spark):
    docs = load(spark, SF, "documents").select("doc_id", "source", "text", F.xxhash64("text").alias("tie")).collect()
    size = {r.doc_id: len(regex.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs}
    by = defaultdict(list)
    for r in docs:
        by[r.source].append(r)
    total = {s: sum(size[r.doc_id] for r in g) for s, g in by.items()}
    order = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight, target, budget, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {}, 1.5 * sum(total.values()), set(order)
    while open_:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] < level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in full}
        budget -= sum(2 * total[s] for s in full)
        open_ -= full

    def placed(group, tie):
        at, out = 0, {}
        for r in sorted(group, key=lambda d: ((spark_hash(d, tie[d], 0, 20240607) >> 54) & 1023, (spark_hash(d, tie[d], 0, 20240607) >> 44) & 1023, spark_hash(d, tie[d], 0, 20240607), d)):
            out[r], at = at, at + size[r]
        return out

    taken = {}
    for s, g in by.items():
        ids = [r.doc_id for r in g]
        start = placed(ids, {r.doc_id: r.tie for r in g})
        copies = {d: sum(p * total[s] + start[d] + size[d] <= target[s] for p in (0, 1)) if size[d] else 0 for d in ids}
        gap, rest = target[s] - sum(copies[d] * size[d] for d in ids), ids
        while rest := [d for d in rest if 0 < size[d] <= gap and copies[d] < 2]:
            now = [d for d in rest if copies[d] == min(copies[x] for x in rest)]
            for d, before in placed(now, start).items():
                if before + size[d] <= gap:
                    copies[d] += 1
            gap = target[s] - sum(copies[d] * size[d] for d in ids)
        near = [d for d in ids if size[d] and copies[d] < 2 and size[d] < 2 * gap]
        if near:
            copies[min(near, key=lambda d: (abs(size[d] - gap), start[d]))] += 1
        taken |= {d: copies[d] * size[d] for d in ids}
    got = rows(spark, "op3_mixing")
    assert len(got) == len(docs)
    source = {r.doc_id: r.source for r in docs}
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"], r["taken"]) == (size[r["doc_id"]], total[s], taken[r["doc_id"]])
        assert r["target"] == pytest.approx(target[s])
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, "op3_mixing")))


def naive_grams(text):
    """N-grams of 1 to 3 characters as hashes, one after another, with Python's own characters and numbers."""
    chars, out = [], []
    for c in " " + text + " ":
        keep = c.lower() if (c.isalpha() or "̀" <= c < "Ͱ") and len(c.lower()) == 1 else c if c.isalpha() or ord(c) > 0xFFFF else " "
        if keep != " " or not chars or chars[-1] != " ":
            chars.append(keep)
    for i in range(len(chars)):
        h = 0
        for k in range(langid.LONGEST):
            h = (((h ^ (ord(chars[i + k]) if i + k < len(chars) else 0)) * 0x9E3779B1) + k + 1) & 0xFFFFFFFF
            mixed = ((h ^ (h >> 15)) * 0x85EBCA77) & 0xFFFFFFFF
            out.append(mixed >> (32 - langid.BITS) if i + k < len(chars) else k)
    return out


def test_op4(spark):
    docs = load(spark, SF, "documents").select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(2**31)).alias("key")).collect()
    held_out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in docs}
    known = [r for r in docs if not held_out[r.doc_id] and r.lang is not None and r.text is not None]
    grams = {r.doc_id: naive_grams(r.text or "") for r in docs}
    df = defaultdict(int)
    for r in known:
        for g in set(grams[r.doc_id]):
            df[g] += 1
    idf = lambda g: np.log((1 + len(known)) / (1 + df[g])) + 1
    langs = sorted({r.lang for r in known})
    z, n, zb, nb = defaultdict(lambda: np.zeros(len(langs))), defaultdict(lambda: np.zeros(len(langs))), np.zeros(len(langs)), np.zeros(len(langs))
    weigh = lambda z, n, l1: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))
    examples = []
    for r in sorted(known, key=lambda r: r.key):
        g, c = np.unique(grams[r.doc_id], return_counts=True)
        examples.append((langs.index(r.lang), r.key % 5 == 0, g.tolist(), [float(np.float32(k / len(grams[r.doc_id]))) * idf(x) * langid.SCALE for x, k in zip(g.tolist(), c.tolist())]))
    for _ in range(langid.EPOCHS):
        for y, held, g, x in examples:
            if held:
                continue
            w, wb = [weigh(z[i], n[i], langid.L1) for i in g], weigh(zb, nb, 0.0)
            s = sum((a * v for a, v in zip(x, w)), wb)
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            p[y] -= 1
            for i, a, v in zip(g, x, w):
                z[i] = z[i] + a * p - (np.sqrt(n[i] + (a * p) ** 2) - np.sqrt(n[i])) / langid.ALPHA * v
                n[i] = n[i] + (a * p) ** 2
            zb, nb = zb + p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / langid.ALPHA * wb, nb + p * p
    wb = weigh(zb, nb, 0.0)
    score = lambda g, x: sum((a * weigh(z[i], n[i], langid.L1) for i, a in zip(g, x)), wb)
    kept = [(y, score(g, x)) for y, held, g, x in examples if held]
    eps = 1 / (len(kept) + 2)

    def loss(t):
        out = 0.0
        for y, s in kept:
            q = np.exp((s - s.max()) / t)
            goal = np.full(len(langs), eps / (len(langs) - 1))
            goal[y] = 1 - eps
            out -= (goal * np.log(np.maximum(q / q.sum(), 1e-300))).sum()
        return out

    t = min(np.exp(np.linspace(np.log(0.05), np.log(20), 121)), key=loss)
    got = {r["doc_id"]: r for r in rows(spark, "op4_langid")}
    assert len(got) == len(docs)
    for r in docs:
        mine = got[r.doc_id]
        assert mine["held_out"] == held_out[r.doc_id]
        if not regex.search(r"\p{L}", r.text or ""):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        g, c = np.unique(grams[r.doc_id], return_counts=True)
        s = score(g.tolist(), [k / len(grams[r.doc_id]) * idf(x) * langid.SCALE for x, k in zip(g.tolist(), c.tolist())])
        p = np.exp((s - s.max()) / t) / np.exp((s - s.max()) / t).sum()
        assert mine["lang_pred"] == langs[int(p.argmax())] and mine["score"] == pytest.approx(p.max(), abs=2e-3)


def test_op7(spark):
    views = quality.views(load(spark, SF, "documents"))
    key = F.pmod(F.xxhash64("doc_id", "ti", "tv", "mi", F.lit(13)), F.lit(2**31))
    got = views.withColumn("key", key).orderBy("doc_id").toArrow().combine_chunks().to_batches()
    xt, xm = (np.concatenate(x) for x in zip(*map(quality.dense, got)))
    ids = np.concatenate([b.column("doc_id").to_numpy() for b in got])
    keys = np.concatenate([b.column("key").to_numpy() for b in got])
    label = {}
    for r in table(spark, "labels"):
        if r["doc_id"] is not None and r["quality"] is not None:
            label[r["doc_id"]] = min(r["quality"], label.get(r["doc_id"], r["quality"]))
    y = np.array([int(label[d] > 0) if d in label else -1 for d in ids.tolist()])
    free = y < 0
    order = np.argsort(keys[~free])
    model = quality.fit(xt[~free][order], xm[~free][order], y[~free][order], (keys[~free] % 4 == 0)[order], quality.Held(xt[free], xm[free], keys[free]))
    want = dict(zip(ids.tolist(), zip(*model.combine(xt @ model.text, xm @ model.meta))))
    mine = rows(spark, "op7_quality")
    assert len(mine) == len(ids)
    for r in mine:
        assert (r["text_score"], r["meta_score"], r["score"]) == pytest.approx(tuple(map(float, want[r["doc_id"]])), abs=1e-3)
        assert r["keep"] == (r["score"] >= 0.5)


def test_op10(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in table(spark, "documents"):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((r["doc_id"], p, at, len(part), zlib.crc32(np.asarray(part, dtype="<u4").tobytes())))
    got = rows(spark, "op10_packing")
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(bins) <= -(-sum(r[3] for r in want) // 2048) + 1


def test_mixture_of_repeated_rows(spark):
    """A third of all rows repeat one document; some sources have ties and texts without words."""
    rows_ = [(7, "s", "a b c")] * 60 + [(i, f"s{i % 2}", "w " * (1 + i % 5)) for i in range(100)] + [(None, None, None), (None, None, "x")] * 5
    df = spark.createDataFrame(rows_, "doc_id long, source string, text string").repartition(5)
    plan = mixing.plan_mixture(df).collect()
    assert len(plan) == len(rows_)
    same = [r for r in plan if r.doc_id == 7 and r.source == "s"]
    assert len(same) == 60 and abs(sum(r.taken for r in same) - same[0].target) <= 3
    spots = [p for r in same for p in r.positions]
    assert len(set(spots)) == len(spots)  # copies of one document lie apart in training
    again = mixing.plan_mixture(df.repartition(3)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))
