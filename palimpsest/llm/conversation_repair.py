"""Repair of the structure of conversations at least cost.

A repaired conversation's turns are ``(system? (user assistant)+)?``, told by the first letters
of their roles. Edits of a turn: Keep, Rerole to user or assistant, Delete (the only one for a
blank turn or one that was there before), Insert a turn with an empty text. A small automaton
of four states (nothing yet, after system, after user, after assistant) says which may follow.

Conversations are bucketed by length into time-major tensors: one NumPy step per turn updates
the costs of all states of all conversations of a bucket, from the last turn to the first; the
stored costs are then traced forward, again all conversations at a time. Of the cheapest edits,
the trace takes those whose initials (D, I, K, R) come first in ASCII order.

A conversation of at most ``LONG`` turns and ``LONG_BYTES`` of text is one column of a tensor in
one worker. A longer one, even with a third of all rows, is cut into chunks of ``LONG`` turns:
each chunk's costs from every first to every last state are a 4 x 4 table; the tables of a
conversation, 16 numbers a chunk, are folded; then all chunks are traced at once, from each
possible first state, and the folded states say which trace holds. Both ways give the same.

Defined cases: a null role or text is one space; a null turn comes first; turns are ordered by
turn, role, text, so ties and repeated rows keep all their rows; rows with a null conv_id make
one conversation; a role with another initial than s, u or a can only be reroled or deleted; a
conversation without rows (all of them ``dropped``) gets zeros and nothing repaired; an empty
table gives no rows; further columns are ignored. A repaired conversation is one value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import crc_sql
from palimpsest.llm._common import global_rank, join_table, load, materialize, pick, scratch

#: Most turns, and most bytes of roles and texts, of a conversation that one worker holds; turns of a chunk.
LONG, LONG_BYTES = 4096, 32_000_000
#: Turns and bytes that a worker gathers before it updates tensors.
GATHER, GATHER_BYTES = 32_768, 32_000_000

#: Costs of edits, and of a turn that stays though it is truncated.
RETURN, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 1 << 60
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. A turn that is put in or
#: reroled is a user's, or an assistant's after a user.
NEXT = np.array([2, 2, 3, 2])
#: Where a kept turn leads: by its kind (0 system, 1 user, 2 assistant, 3 other) and the state; -1 for nowhere.
KEEP = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Cost of turns that end a conversation properly, from each state.
END = np.array([0, 2 * INSERT, INSERT, 0])
KINDS = {"s": 0, "u": 1, "a": 2}
LEGAL = frozenset(("su", "ua", "au"))
SPACE = " \t\n\x0b\x0c\r"
PIECES = "array<struct<edit:string,role:string,text:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state when turns may be put in first."""
    for _ in range(2):
        costs = np.minimum(costs, INSERT + costs[:, NEXT])
    return costs


def backward(kind: np.ndarray, must: np.ndarray, cut: np.ndarray, there: np.ndarray, end: np.ndarray) -> np.ndarray:
    """costs[t, conversation, state] of turns t and later; arrays are [turn, conversation], end is [conversation, state]."""
    turns, n = kind.shape
    costs = np.empty((turns + 1, n, 4), dtype=np.int64)
    costs[turns] = end
    for t in range(turns - 1, -1, -1):
        after = costs[t + 1]
        to = KEEP[kind[t]]
        kept = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), axis=1), NEVER)
        stays = np.minimum(kept, RETURN + after[:, NEXT]) + TRUNCATED * cut[t][:, None]
        now = np.minimum(DELETE + after, np.where(must[t][:, None], NEVER, stays))
        costs[t] = np.where(there[t][:, None], _closed(now), after)
    return costs


def trace(costs: np.ndarray, kind: np.ndarray, must: np.ndarray, cut: np.ndarray, there: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Initials of each conversation's edits from a state on, and the state that they lead to. Where last is
    true, turns are put in at the end until it is a proper one."""
    turns, n = kind.shape
    at, state = np.arange(n), state.copy()
    letters = np.zeros((4 * turns + 2, n), dtype=np.uint8)
    for t in range(turns):
        now, after = costs[t], costs[t + 1]
        open_ = there[t].copy()
        extra = TRUNCATED * cut[t]
        for k in range(4):
            best = now[at, state]
            deletes = open_ & (DELETE + after[at, state] == best)
            puts = open_ & ~deletes & (INSERT + now[at, NEXT[state]] == best) & (k < 3)
            to = KEEP[kind[t], state]
            keeps = open_ & ~deletes & ~puts & ~must[t] & (to >= 0) & (after[at, np.maximum(to, 0)] + extra == best)
            roles = open_ & ~(deletes | puts | keeps)
            letters[4 * t + k] = 68 * deletes + 73 * puts + 75 * keeps + 82 * roles  # D I K R
            state = np.where(puts | roles, NEXT[state], np.where(keeps, to, state))
            open_ = puts
            if not open_.any():
                break
    for k in range(2):
        puts = last & (END[state] > 0)
        letters[4 * turns + k] = 73 * puts
        state = np.where(puts, NEXT[state], state)
    rows = np.ascontiguousarray(letters.T)
    return [row.tobytes().replace(b"\0", b"").decode() for row in rows], state


def apply_edits(letters: str, turns: list[tuple[str, str]], state: int) -> list[dict]:
    """The turns that stay, with their edits; deleted ones are gone."""
    out, i = [], 0
    for edit in letters:
        made = "user" if NEXT[state] == 2 else "assistant"
        if edit == "I":
            out.append({"edit": edit, "role": made, "text": ""})
            state = NEXT[state]
            continue
        role, text = turns[i]
        i += 1
        if edit == "D":
            continue
        out.append({"edit": edit, "role": made if edit == "R" else role, "text": text})
        state = NEXT[state] if edit == "R" else KEEP[KINDS[role[0]], state]
    return out


def _tensors(group: list[tuple]) -> tuple[np.ndarray, ...]:
    """kind, must, cut and there as [turn, conversation] of conversations given as lists of (kind, must, cut)."""
    turns = max(map(len, group))
    out = np.zeros((4, turns, len(group)), dtype=np.int64)
    for j, rows in enumerate(group):
        if rows:
            out[:3, : len(rows), j] = np.array(rows).T
            out[3, : len(rows), j] = 1
    return out[0], out[1].astype(bool), out[2], out[3].astype(bool)


def _buckets(lengths: list[int]) -> Iterator[list[int]]:
    """Places of conversations in buckets whose lengths differ by less than twice."""
    by: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n.bit_length(), []).append(i)
    yield from by.values()


def _faults(rows: list[dict]) -> tuple[list[tuple], dict]:
    """(kind, must, cut) of each turn, and how many faults there are; a turn's `seen` says that it was there before."""
    out, count = [], dict.fromkeys(COUNTS, 0)
    before = None
    for r in rows:
        fault = "blank" if r["blank"] else "duplicate" if r["seen"] else "truncated" if r["cut"] else None
        if fault:
            count[fault] += 1
        if before is not None and before + r["role"][:1] not in LEGAL:
            count["illegal"] += 1
        before = r["role"][:1]
        out.append((KINDS.get(before, 3), fault in ("blank", "duplicate"), fault == "truncated"))
    return out, count


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows that follow each other with the same keys."""
    held, key = [], None
    for batch in batches:
        for row in batch.to_pylist():
            mine = tuple(row[k] for k in keys)
            if held and mine != key:
                yield key, held
                held = []
            key = mine
            held.append(row)
    if held:
        yield key, held


def _gathered(runs: Iterator[tuple[tuple, list[dict]]]) -> Iterator[list[tuple[tuple, list[dict]]]]:
    held, turns, size = [], 0, 0
    for key, rows in runs:
        held.append((key, rows))
        turns += len(rows)
        size += sum(len(r["text"] or "") + len(r["role"] or "") for r in rows)
        if turns >= GATHER or size >= GATHER_BYTES:
            yield held
            held, turns, size = [], 0, 0
    if held:
        yield held


def _whole(schema: pa.Schema):
    """Conversations in one worker: rows in order of conv_id and turn to one row a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _gathered(_runs(batches, ("conv_id",))):
            told, faults, out = [], [], [None] * len(held)
            for _, rows in held:
                rows = [r for r in rows if not r["dropped"]]
                seen = set()
                for r in rows:
                    r["seen"] = (r["role"], r["text"]) in seen
                    seen.add((r["role"], r["text"]))
                told.append(rows)
                faults.append(_faults(rows))
            for places in _buckets([len(rows) for rows in told]):
                kind, must, cut, there = _tensors([faults[i][0] for i in places])
                n = len(places)
                costs = backward(kind, must, cut, there, np.tile(END, (n, 1)))
                audits, _ = trace(costs, kind, must, cut, there, np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool))
                for j, i in enumerate(places):
                    turns = {r["turn"] for r in told[i]} - {None}
                    out[i] = {
                        "conv_id": held[i][0][0],
                        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                        **faults[i][1],
                        "cost": int(costs[0, j, 0]),
                        "audit": audits[j],
                        "repaired": apply_edits(audits[j], [(r["role"], r["text"]) for r in told[i]], 0),
                    }
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's costs from each first state to each last one, its faults, and the letters at its borders."""
    for held in _gathered(_runs(batches, ("conv_id", "chunk"))):
        out = []
        faults = [_faults(rows) for _, rows in held]
        kind, must, cut, there = _tensors([f[0] for f in faults])
        unit = np.where(np.eye(4, dtype=bool), 0, NEVER)
        tables = [np.minimum(backward(kind, must, cut, there, np.tile(unit[j], (len(held), 1)))[0], NEVER) for j in range(4)]
        for i, ((conv, chunk), rows) in enumerate(held):
            out.append({"conv_id": conv, "chunk": chunk, **faults[i][1], "table": [int(tables[j][i, s]) for s in range(4) for j in range(4)], "head": rows[0]["role"][:1], "tail": rows[-1]["role"][:1]})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("table", pa.list_(pa.int64())), ("head", pa.string()), ("tail", pa.string())]))


def _fold_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tables of a conversation's chunks, the last chunk first, to the costs behind each chunk."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), ("cost", pa.int64())])
    key, costs = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            first = (row["conv_id"],) != key
            if first:
                key, costs = (row["conv_id"],), END
            out.append({"conv_id": row["conv_id"], "chunk": row["chunk"], "behind": costs.tolist(), "last": first})
            costs = np.min(np.array(row["table"]).reshape(4, 4) + costs[None, :], axis=1)
            out[-1]["cost"] = int(costs[0])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's edits from each first state, and the states that they lead to."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])
    for held in _gathered(_runs(batches, ("conv_id", "chunk"))):
        kind, must, cut, there = _tensors([_faults(rows)[0] for _, rows in held])
        costs = backward(kind, must, cut, there, np.array([rows[0]["behind"] for _, rows in held]))
        last = np.array([rows[0]["last"] for _, rows in held])
        got = [trace(costs, kind, must, cut, there, np.full(len(held), s), last) for s in range(4)]
        yield pa.RecordBatch.from_pylist([{"conv_id": k[0], "chunk": k[1], "audits": [g[0][i] for g in got], "exits": [int(g[1][i]) for g in got]} for i, (k, _) in enumerate(held)], schema=schema)


def _fold_forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk of a conversation and the edits from it."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("state", pa.int64()), ("audit", pa.string())])
    key, state = None, 0
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if (row["conv_id"],) != key:
                key, state = (row["conv_id"],), 0
            out.append({"conv_id": row["conv_id"], "chunk": row["chunk"], "state": state, "audit": row["audits"][state]})
            state = row["exits"][state]
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("audit", pa.string()), ("repaired", _PIECES)])
    for (conv, chunk), rows in _runs(batches, ("conv_id", "chunk")):
        pieces = apply_edits(rows[0]["audit"], [(r["role"], r["text"]) for r in rows], rows[0]["state"])
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "chunk": chunk, "audit": rows[0]["audit"], "repaired": pieces}], schema=schema)


_PIECES = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
_OUT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("cost", pa.int64()), ("audit", pa.string()), ("repaired", _PIECES)])
_DDL = f"conv_id long, gaps long, {', '.join(c + ' long' for c in COUNTS)}, cost long, audit string, repaired {PIECES}"


def _by_chunk(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", *order)


def _repair_long(rows: DataFrame, most: int) -> DataFrame:
    """Conversations of any length, chunk by chunk; rows that are dropped are gone."""
    spark = rows.sparkSession
    with scratch(spark) as keep:
        # the part that a row was read in tells equal rows apart, so that many of them spread over ranges
        ranked = materialize(global_rank(rows.withColumn("part", F.spark_partition_id()), [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("part")], "at"))
        starts = ranked.groupBy("conv_id").agg(F.min("at").alias("start"))
        told = join_table(ranked, starts, ["conv_id"]).withColumn("chunk", F.floor((F.col("at") - F.col("start")) / most).cast("long"))
        same = ["conv_id", "digest"]
        told = told.withColumn("digest", F.sha2(F.concat_ws("\0", "role", "text"), 256))
        firsts = told.groupBy(*same).agg(F.min("at").alias("first_at"))
        told = join_table(told, firsts, same).withColumn("seen", F.col("at") > F.col("first_at"))
        told = materialize(told.select("conv_id", "chunk", "at", "turn", "role", "text", "blank", "seen", "cut"))
        counts = ", ".join(c + " long" for c in COUNTS)
        tables = materialize(_by_chunk(told, "at").mapInArrow(_tables, f"conv_id long, chunk long, {counts}, table array<long>, head string, tail string"))
        by_conv = lambda df, *order: df.repartition("conv_id").sortWithinPartitions("conv_id", *order)  # noqa: E731
        behind = materialize(by_conv(tables.select("conv_id", "chunk", "table"), F.desc("chunk")).mapInArrow(_fold_back, "conv_id long, chunk long, behind array<long>, last boolean, cost long"))
        keys = ["conv_id", "chunk"]
        traces = _by_chunk(join_table(told, behind.drop("cost"), keys), "at").mapInArrow(_traces, "conv_id long, chunk long, audits array<string>, exits array<long>")
        picked = materialize(by_conv(traces, "chunk").mapInArrow(_fold_forward, "conv_id long, chunk long, state long, audit string"))
        pieces = _by_chunk(join_table(told, picked, keys), "at").mapInArrow(_apply, f"conv_id long, chunk long, audit string, repaired {PIECES}")
        joined = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "audit", "repaired"))).alias("p"))
        joined = joined.select("conv_id", F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"), F.flatten(F.transform("p", lambda x: x["repaired"])).alias("repaired"))
        cost = behind.where("chunk = 0").select("conv_id", "cost")
        # borders between chunks: letters of a chunk's end and of the next one's start
        ends = tables.select("conv_id", (F.col("chunk") + 1).alias("chunk"), F.col("tail").alias("before"))
        border = join_table(tables, ends, keys, "left").withColumn("illegal", F.col("illegal") + F.coalesce((~F.concat("before", "head").isin(*LEGAL)).cast("long"), F.lit(0)))
        faults = border.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in COUNTS])
        gaps = told.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
        out = joined
        for t in (cost, faults, gaps):
            out = join_table(out, t, ["conv_id"])
        return keep(materialize(out.select(*_OUT.names)))


def repair(rows: DataFrame, most: int = LONG, most_bytes: int = LONG_BYTES) -> DataFrame:
    """Turns (conv_id, turn, role, text, and maybe a boolean `dropped`: the row isn't there, but its conversation
    is) to one row per conversation: conv_id, gaps, the faults' numbers, cost, audit (the edits' initials) and
    repaired, an array of (edit, role, text)."""
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    body = F.rtrim("text", F.lit(SPACE))
    rows = rows.withColumn("dropped", dropped)
    rows = pick(rows, "conv_id", "turn", "role", "text", "dropped").withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "dropped", (body == "").alias("blank"), (~F.right(body, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    size = F.octet_length("role") + F.octet_length("text")
    there = rows.where(~F.col("dropped"))
    with scratch(rows.sparkSession) as keep:
        long = keep(materialize(there.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).where((F.col("n") > most) | (F.col("bytes") > most_bytes)).select("conv_id", F.lit(True).alias("long"))))
    if long.isEmpty():
        return _repair_short(rows)
    marked = join_table(rows, long, ["conv_id"], "left")
    return _repair_short(marked.where("long is null").drop("long")).unionByName(_repair_long(marked.where("long and not dropped").drop("long", "dropped"), most))


def _repair_short(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    return ordered.mapInArrow(_whole(_OUT), _DDL)


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query: by the remainder of crc32(`conv_id:turn`) by 20, a row is dropped (0), loses its text
    (1) or its sentence marks (2), is repeated (3) or becomes a user's (4)."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    how = F.pmod(F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "UTF-8")), F.lit(20))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    out = rows.withColumn("how", how).select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("dropped"), F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    got = repair(damaged(load(spark, sf_dir, "conversations")))
    whole = F.array_join(F.transform("repaired", lambda p: F.concat(p["role"], F.lit(":"), p["text"])), "\n")
    return got.withColumn("repaired_sha256", F.sha2(whole, 256)).drop("repaired")


def _sql() -> str:
    """The same from the last turn to the first, where each state carries its cheapest edits: cost, initials, turns."""
    made = {2: "'user:'", 3: "'assistant:'"}

    def choice(letter: str, cost: str, state: str, turn: str = "") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': '{letter}' || {state}.a, 'r': " + (f"list_prepend({turn}, {state}.r)" if turn else f"{state}.r") + "}"

    def turn(s: int) -> str:
        to = NEXT[s]
        out = [choice("D", str(DELETE), f"s{s}"), f"case when not must then {choice('R', f'{RETURN} + extra', f's{to}', f'{made[to]} || text')} end"]
        for kind, initial in enumerate("sua"):
            if KEEP[kind, s] >= 0:
                out.append(f"case when not must and initial = '{initial}' then {choice('K', 'extra', f's{KEEP[kind, s]}', "role || ':' || text")} end")
        return f"list_min([{', '.join(out)}]) as s{s}"

    closed = ", ".join(f"list_min([s{s}, {choice('I', str(INSERT), f's{NEXT[s]}', made[NEXT[s]])}]) as s{s}" for s in range(4))
    ends = ", ".join(f"{{'c': {END[s]}, 'a': '{'I' * (END[s] // INSERT)}', 'r': {end}::varchar[]}} as s{s}" for s, end in enumerate(("[]", "['user:', 'assistant:']", "['assistant:']", "[]")))
    return rf"""
with recursive {crc_sql.TABLE}, hashed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc_sql.crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as how
  from conversations, crcs
), damaged as (
  select conv_id, turn, case when how = 4 then 'user' else role end as role,
    case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when how = 3 then 2 else 1 end)) as copy
  from hashed where how <> 0
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, regexp_replace(text, '[ 	-]+\z', '') as body from damaged
), seen as (
  select *, k > min(k) over (partition by conv_id, role, text) as seen, left(role, 1) as initial, lag(left(role, 1)) over (partition by conv_id order by k) as before from placed
), turns as (
  select *, body = '' or seen as must, case when body <> '' and not seen and right(body, 1) not in ('.', '!', '?') then {TRUNCATED} else 0 end as extra from seen
), faults as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where body = '') as blank,
    count(*) filter (where body <> '' and seen) as duplicate, count(*) filter (where extra > 0) as truncated,
    count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from turns group by conv_id
), convs as (select distinct conv_id from conversations
), costs as (
  select c.conv_id, coalesce(n, 0) + 1 as k, {ends} from convs c left join faults f on f.conv_id is not distinct from c.conv_id
  union all
  select conv_id, k, {closed} from (select conv_id, k, {closed} from (
    select t.conv_id, t.k, {", ".join(turn(s) for s in range(4))} from costs c join turns t on t.conv_id is not distinct from c.conv_id and t.k = c.k - 1))
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, s0.c::bigint as cost, s0.a as audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) as repaired_sha256
from costs c left join faults f on f.conv_id is not distinct from c.conv_id where c.k = 1
"""


SQL = _sql()
