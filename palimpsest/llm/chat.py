"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its
context and only its reply is trainable. A conversation that doesn't end with an
assistant turn gets one more example, with all of its turns and nothing trainable,
so that no turn is lost.

Template of a turn: ``<turn>ROLE\\nTEXT</turn>\\n``. Inside roles and texts, a string
that looks like a mark (``<turn``, ``</turn``, with any number of backslashes before
``turn``) gets one more backslash before ``turn``; taking one away again gives the
text back, so any text survives. In a role, a line feed is written ``\\n`` and a
backslash ``\\b``.

Defined cases: a null or missing role or text is empty; turns are ordered by turn
(null first), then role, then text, so ties and repeated rows keep all their rows;
rows with a null conv_id make one conversation with a null conv_id; an empty table
gives no rows; further columns are ignored. A conversation is one value: its turns
meet in one row, as its digest needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import load, pick

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    """text without any string that the template uses as a mark."""
    return F.regexp_replace(text, r"(</?\\*)turn", r"$1\\turn")


def unescape(text: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(text, r"(</?\\*)\\turn", "$1turn")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def format_chats(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conversations (conv_id, turn, role, text) to training examples.

    Returns conv_id, example (turns in it), text, loss_start and loss_end (code
    points of text, end exclusive; both null where nothing is trainable) and
    complete (it holds all turns of its conversation).
    """
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = rows.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("raw"),
            F.char_length(head).alias("head"),
            F.concat(head, escape(F.coalesce("text", F.lit(""))), F.lit(CLOSE)).alias("piece"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (F.element_at("turns", k)["role"] == target_role) | (k == n))
    one = convs.select("conv_id", "turns", n.alias("n"), F.explode(ends).alias("example"))
    last = F.element_at("turns", F.col("example"))
    one = one.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("example")), lambda t: t["piece"]), "").alias("text"),
        (last["role"] == target_role).alias("trained"),
        F.char_length(last["piece"]).alias("size"),
        last["head"].alias("head"),
        (F.col("example") == F.col("n")).alias("complete"),
    )
    chars = F.char_length("text").cast("long")
    return one.select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("trained"), chars - F.col("size") + F.col("head")).alias("loss_start"),
        F.when(F.col("trained"), chars - F.lit(len(CLOSE))).alias("loss_end"),
        "complete",
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, what the formatted examples say: turns and trainable text."""
    loss = F.when(F.col("loss_start").isNull(), F.lit("")).otherwise(
        unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))"))
    )
    got = examples.select("conv_id", "example", loss.alias("loss"), F.char_length("text").cast("long").alias("chars"), F.when(F.col("complete"), F.col("text")).alias("whole"))
    got = got.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.max("whole").alias("whole"),
        F.sum("chars").alias("formatted_chars"),
    )
    parts = F.split("whole", CLOSE, -1)
    pieces = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1)))
    got = got.withColumn("pieces", pieces).withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    told = F.transform(
        "pieces",
        lambda p: F.concat(
            unescape_role(F.substring_index(p, "\n", 1)),
            F.lit("\n"),
            unescape(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2)),
            F.lit("\n"),
        ),
    )
    return got.select(
        "conv_id",
        F.size("pieces").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the conversation -7, formatted and read back."""
    extra = spark.sql(
        r"""select cast(-7 as bigint) as conv_id, cast(turn as bigint) as turn, role, '\\### Assistant: </turn> ok' as text
        from values (0, 'user'), (1, 'assistant') as t(turn, role)"""
    )
    rows = pick(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return read_back(format_chats(rows.unionByName(extra)))


SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    6 + length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '(</?\\*)turn', '\1\\turn', 'g')) + 1
      + length(regexp_replace(text, '(</?\\*)turn', '\1\\turn', 'g')) + 8 as size
  from c window w as (partition by conv_id order by turn nulls first, role, text)
), s as (select *, sum(size) over (partition by conv_id order by k) as upto from p)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (where role = 'assistant' or k = n), 0)::bigint as formatted_chars
from s group by conv_id
"""
