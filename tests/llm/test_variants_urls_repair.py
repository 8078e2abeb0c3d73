"""Spelling variants, URL filters and conversation repair: brute force, odd input, crowded shards and long conversations."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter

import pytest
import regex

from palimpsest.llm import conversation_repair, spelling, url_filter
from palimpsest.llm._common import written

SF = "/root/testdata/sf0.001"


# spelling variants


def edits_apart(a, b):
    """Edit distance by the plain table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute_variants(count):
    out = {}
    for w, n in count.items():
        near = [v for v in count if edits_apart(w, v) == 1]
        best = min(near, key=lambda v: (-count[v], v), default=None)
        form = best if best is not None and count[best] >= 5 * n else None
        out[w] = (n, len(near), form, count[form] if form else None)
    root = lambda w: w if out[w][2] is None else root(out[w][2])
    return {w: (*v, root(w)) for w, v in out.items()}


@pytest.mark.parametrize("shard", [1, 4, 10_000])
def test_variants_are_those_of_all_pairs(spark, shard):
    rng = random.Random(shard)
    crowd = {"prefix" + "".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(120)}
    crowd |= {"".join(rng.choice("xÀ") for _ in range(rng.randint(6, 9))) for _ in range(120)} | {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab"}
    count = {w: rng.choice((5, 6, 30, 151, 800)) for w in crowd}
    vocabulary = spark.createDataFrame(list(count.items()), "word string, n long")
    before = written()
    got = spelling.variants(vocabulary, shard)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()} == brute_variants(count)
    assert len(written() - before) == 1  # only the result


def test_tables_of_words_are_not_sent_to_the_driver(spark, monkeypatch):
    plans, write = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spelling.variants(spark.createDataFrame([("abcdef", 50), ("abcdeg", 9), ("abcdeh", 1), ("unlike", 5)], "word string, n long"))
        assert {(r.word, r.form, r.root) for r in got.collect()} == {("abcdef", None, "abcdef"), ("abcdeg", "abcdef", "abcdef"), ("abcdeh", "abcdef", "abcdef"), ("unlike", None, "unlike")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and not any("Broadcast" in p for p in plans)


def test_pairs_of_a_shard_meet_once():
    rng = random.Random(5)
    for short in range(4):
        rests = ["".join(rng.choice("ab") for _ in range(rng.choice((short, short + 1)))) for _ in range(12)]
        rests = sorted(set(rests), key=rests.index)
        got = [frozenset(p) for p in spelling.shard_pairs(rests, short)]
        assert len(got) == len(set(got))
        want = {frozenset((i, j)) for i, j in itertools.combinations(range(len(rests)), 2) if min(len(rests[i]), len(rests[j])) == short and edits_apart(rests[i], rests[j]) == 1}
        assert want <= set(got)


def test_the_count_filter_keeps_few_pairs_of_a_shard():
    rng = random.Random(6)
    rests = list({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(400)})
    assert sum(1 for _ in spelling.shard_pairs(rests, 8)) < len(rests)


def plain_words(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return dict(count)


def test_words_of_odd_texts(spark):
    rng = random.Random(7)
    long = " ".join("".join(rng.choice("abÉéß") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    rows = [(1, long), (1, long), (None, "Über-Ärger ÄRGERLICH strasse, StraßeStraße_x9Wörter"), (2, None), (3, ""), (4, "short wörds 漢字漢字漢字漢字 ×÷×÷×÷")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert {r.word: r.n for r in spelling.words(df).collect()} == plain_words(rows)
    empty = spelling.variants(spelling.words(df.where("false")))
    assert empty.collect() == []


# URL filters


def plain_verdict(url, rules, default="allow"):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = regex.match(r"[^/?#]*", rest)[0]
    path = regex.match(r"[^?#]*", rest[len(host) :])[0]
    host, best = lower(host), None
    for h, p, v in rules:
        h, p = lower(h or ""), p or ""
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h) + len(p), len(h), v == "block", h + p))
    return (host, path, best and best[3], default if best is None else "block" if best[2] else "allow")


@pytest.mark.parametrize("is_small", [True, False])
def test_urls_against_every_rule(spark, monkeypatch, is_small):
    monkeypatch.setattr(url_filter, "small", lambda t: is_small)
    rng = random.Random(8)
    label = lambda: rng.choice(("a", "b", "Com", "org", "", "é"))
    path = lambda: rng.choice(("", "/")) + "/".join(rng.choice(("en", "e", "1", "漢", "")) for _ in range(rng.randint(0, 3)))
    rules = [(".".join(label() for _ in range(rng.randint(1, 3))), rng.choice(("", "/", "/en", "/en/1", "/e", "/漢/")), rng.choice(("allow", "block"))) for _ in range(60)]
    rules += [("a.org", "/en", "allow"), ("A.org", "/en", "block"), ("org", None, "allow"), (None, "/x", "block"), ("b", "/q", None)]
    urls = [f"{rng.choice(('http', 'https', ''))}://{'.'.join(label() for _ in range(rng.randint(1, 4)))}{path()}{rng.choice(('', '?x=/en', '#/en', '?'))}" for _ in range(400)]
    urls += [None, "", "no scheme", "x://", "HTTP://A.ORG/en/1", "http://a.org:80/en", "http://a.org\n/en", "http://b/" + "q" * 200_000, "http://" + "a." * 50_000 + "org/", "http://a.org/?u=http://b.com/x"]
    rows = [(i // 2, u, "x") for i, u in enumerate(urls)] + [(7, "http://a.org/en", "x")] * 5 + [(None, "http://a.org/en", "x")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    got = url_filter.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == Counter((i, *plain_verdict(u, rules)) for i, u, _ in rows)


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (1, "http://a.org/x"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(pages, none, "block").select("host", "path", "rule", "verdict").collect()))
    assert got == [("", "", None, "block"), ("a.org", "/x", None, "block"), ("a.org", "/x", None, "block")]
    assert url_filter.judge(pages.where("false"), none).collect() == []


def test_url_filter_runs_no_python(spark):
    plan = url_filter.op12_url_filter(spark, SF)._jdf.queryExecution().toString()
    assert not regex.search("Python|Arrow|Pandas", plan)


# conversation repair


def plain_repair(turns):
    """Dijkstra over (turns read, state): cheapest, then ASCII-least edits, with what they leave."""
    seen, told = set(), []
    for role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        told.append((role, text, fault))
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, left = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = True
        if i == len(told) and state in ("", "a"):
            break
        for r in follow[state].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, r, (*left, {"u": "user:", "a": "assistant:"}[r])))
        if i < len(told):
            role, text, fault = told[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, left))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                if role[:1] in follow[state] and role:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[0], (*left, f"{role}:{text}")))
                for r in follow[state].replace("s", ""):
                    heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, r, (*left, {"u": "user:", "a": "assistant:"}[r] + text)))
    faults = Counter(f for _, _, f in told)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
    return (faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, "\n".join(left))


def plain_conversations(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        known = {t for t, _, _ in turns if t is not None}
        out[c] = (max(known) - min(known) + 1 - len(known) if known else 0, *plain_repair([t[1:] for t in turns]))
    return out


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, "\n".join(f"{p.role}:{p.text}" for p in r.repaired)) for r in df.collect()}


def conversations(seed, n, turns):
    rng = random.Random(seed)
    role = lambda: rng.choice(("user", "assistant", "system", "user", "assistant", "tool", "", None, "ua"))
    text = lambda: rng.choice(("Yes.", "No", "Well?", "", " \n", "Fine! ", None, "a", "b.", "c.", "d.", "e.", "f"))
    return [(c if c else None, rng.choice((t, t, t, t * 2, None)), role(), text()) for c in range(n) for t in range(rng.randint(1, turns))]


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_repair_is_the_cheapest(spark, most):
    rows = conversations(most, 60, 9)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, cost int").repartition(3)
    got = conversation_repair.repair(df, most)
    assert told(got) == plain_conversations(rows) and got.count() == 60


def test_long_conversations_alone_are_cut(spark):
    rows = [(9, t, ("user", "assistant")[t % 2] if t % 7 else "tool", f"text {t}" + "." * (t % 5 > 0)) for t in range(3000)] + [(9, 5000, "user", "again.")] * 200 + conversations(2, 20, 6)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = told(conversation_repair.repair(df)), told(conversation_repair.repair(df, 64))
    assert whole == cut == plain_conversations(rows)
    by_bytes = told(conversation_repair.repair(df, most_bytes=5000))
    assert by_bytes == whole


def test_repair_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string, dropped boolean"
    df = spark.createDataFrame([(1, 1, "user", "Hi.", True), (2, 1, "user", "Hi.", False), (2, 2, "assistant", "x" * 300_000 + ".", False)], schema)
    got = told(conversation_repair.repair(df))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", "") and got[2][-2] == "KK" and len(got) == 2
    assert conversation_repair.repair(df.where("false")).collect() == []


def test_op13_is_the_plain_damage_and_repair(spark):
    rows, ids = [], set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        ids.add(r.conv_id)
        role, text = (x if x is not None else " " for x in (r.role, r.text))
        how = zlib.crc32(f"{r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        text = "" if how == 1 else regex.sub("[.!?]", "", text) if how == 2 else text
        rows += [(r.conv_id, r.turn, "user" if how == 4 else role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    want = plain_conversations(rows)
    got = {r.conv_id: r for r in conversation_repair.op13_conversation_repair(spark, SF).collect()}
    assert set(got) == ids
    for c, r in got.items():
        w = want.get(c, (0, 0, 0, 0, 0, 0, "", ""))
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest())


def test_damage_of_nulls(spark):
    df = spark.createDataFrame([(None, t, None, None) for t in [None, *range(60)]], "conv_id long, turn long, role string, text string")
    got = conversation_repair.damaged(df).collect()
    drops = [t for t in [None, *range(60)] if zlib.crc32(f" :{' ' if t is None else t}".encode()) % 20 == 0]
    assert sorted(r.turn for r in got if r.dropped) == sorted(drops) and all(r.role in (" ", "user") and r.text in (" ", "") for r in got)
