"""Groups of spelling variants: words of a corpus that differ by one inserted, deleted or replaced
character, found with a positional q-gram index.

Each word is padded and cut into bigrams with their places. An index of postings (a bigram at a
place, in words of a length) is probed with every word: the postings of its bigrams whose lengths
differ by at most one and whose places differ by at most one are heap-merged, which counts how many
bigrams each other word shares. One edit spoils at most two bigrams, so words that share fewer than
the longer one's number of bigrams less two are out (the count filter); the others are verified.

The index is dealt out to shards. One edit leaves the first or the last half of a word whole, so
each word goes to the shards of its two halves, once for each length that the shorter word of a pair
may have; words of a shard differ in the rest alone, and it is the rest that is indexed. A shard of
more than ``SHARD`` words is dealt again by the halves of the rest, and so on down to rests of one
character, so a shard never grows with the vocabulary, whatever words begin or end alike. Nothing is
dropped for that: of the shards in which a pair meets, one reports it, told by the length of the
characters that both words begin with.

Each shard sends one row per word (its near words there, counted, and the best of them). A word's
form is its near word of largest count, if that is ``RATIO`` times its own; counts grow from form to
form, so following forms ends after a few joins. Joins by word are shuffled by it: none of their tables,
which grow with the vocabulary, is sent to the driver for being just short enough.

Defined cases: a null text has no words; a null doc_id is an empty text where a damaged run is told;
repeated rows count as often as they are there; words are compared by code points; an empty table
gives no rows; further columns are ignored. Texts are read whole.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import crc_sql
from palimpsest.llm._common import join_table, load, materialize, pick, scratch

#: Least code points and occurrences of a word.
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: Words of a shard that aren't dealt again.
SHARD = 512
#: One in so many pairs of document and run loses a character.
DAMAGE = 199

KEY = ["short", "left", "right", "limit", "start", "end"]


def near(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = _alike(a, b)
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _alike(a: str, b: str) -> int:
    """How many characters two words begin with alike."""
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return i


def grams(rest: str) -> list[tuple[int, str]]:
    """Padded bigrams with their places."""
    padded = f"\0{rest}\0"
    return [(i, padded[i : i + 2]) for i in range(len(padded) - 1)]


def shard_pairs(rests: list[str], short: int) -> Iterator[tuple[int, int]]:
    """Places (i < j) of rests that may be one edit apart, the shorter one of ``short`` characters.

    Postings are lists of places in rising order, so a heap of those that one rest touches brings equal
    places together: their number is the number of shared bigrams.
    """
    postings: dict[tuple[str, int, int], list[int]] = defaultdict(list)
    for j, rest in enumerate(rests):
        mine = grams(rest)
        need = len(mine) - 2  # one edit spoils at most two of the longer one's
        lengths = (short, short + 1) if len(rest) == short else (short,)
        touched = [postings[k] for i, g in mine for n in lengths for p in (i - 1, i, i + 1) if (k := (g, p, n)) in postings]
        count, last = 0, -1
        for i in heapq.merge(*touched):
            if i != last:
                last, count = i, 0
            count += 1
            if count == max(1, need + (len(rests[i]) > len(rest))):
                yield i, j
        if need <= 0:  # so short that an edit may leave nothing shared
            seen = set().union(*touched) if touched else set()
            yield from ((i, j) for i in range(j) if i not in seen and short in (len(rest), len(rests[i])))
        for i, g in mine:
            postings[g, i, len(rest)].append(j)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards, one after another, to one row for each of their words that has near words there."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    key, words, out = None, [], []

    def done() -> None:
        short, left, right, limit = key[:4]
        found: dict[int, list] = {}

        def put(i: int, j: int) -> None:
            (w, n), got = words[j], found.setdefault(i, [0, 0, ""])
            got[0] += 1
            if n > got[1] or (n == got[1] and w < got[2]):
                got[1], got[2] = n, w

        rests = [w[left : len(w) - right] for w, _ in words]
        for i, j in shard_pairs(rests, short - left - right):
            a, b = words[i][0], words[j][0]
            if near(a, b) and _alike(a, b) < limit:
                put(i, j)
                put(j, i)
        out.extend({"word": words[i][0], "n_near": c, "best_n": n, "best": w} for i, (c, n, w) in found.items())

    for batch in batches:
        for row in batch.to_pylist():
            mine = tuple(row[k] for k in KEY)
            if mine != key:
                if len(words) > 1:
                    done()
                key, words = mine, []
            words.append((row["word"], row["n"]))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if len(words) > 1:
        done()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def words(docs: DataFrame) -> DataFrame:
    """Words of whole texts (word, n): runs of letters, A to Z lower-cased, of which one in DAMAGE lost a character."""
    texts = pick(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    # a run loses a character at most, so shorter ones can't give a word
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = texts.select("id", F.explode(F.regexp_extract_all(lower, F.lit(f"[a-z\\u00C0-\\u00FF]{{{LEAST_LENGTH},}}"), 0)).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % DAMAGE == 0, less).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _halves(short, left, right, limit, length) -> list:
    """Shards of a word by the halves of its rest; limit: pairs that begin alike for longer meet elsewhere."""
    rest = short - left - right
    first = F.floor(rest / 2).cast("int")
    return [
        F.struct(short.alias("short"), (left + first).alias("left"), right.alias("right"), limit.alias("limit")),
        F.struct(short.alias("short"), left.alias("left"), (right + rest - first).alias("right"), F.least(limit, left + first).alias("limit")),
    ]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows with shard (short, left, right, limit) to word, n and the shard's key, its fixed characters included."""
    s = lambda c: F.col(f"shard.{c}")
    n = F.char_length("word")
    return rows.select("word", "n", *[s(c).alias(c) for c in ("short", "left", "right", "limit")], F.substr("word", F.lit(1), s("left")).alias("start"), F.substr("word", n - s("right") + 1, s("right")).alias("end"))


def near_words(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """words (word, n) with near words to word, n_near, best_n and best (of largest n, then the least)."""
    far = F.lit(1 << 30)
    n = F.char_length("word")
    firsts = [x for short in (n, n - 1) for x in _halves(short, F.lit(0), F.lit(0), far, n)]
    dealt = _dealt(vocabulary.select("word", "n", F.explode(F.array(*firsts)).alias("shard")))
    ready = []
    while True:
        # a shard whose rests have one character, or none, has no more words than pairs of characters
        crowded = materialize(dealt.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where((F.col("size") > shard) & (F.col("short") - F.col("left") - F.col("right") > 1)).drop("size"))
        if crowded.isEmpty():
            break
        marked = join_table(dealt, crowded.withColumn("crowded", F.lit(True)), KEY, "left")
        ready.append(marked.where("crowded is null").drop("crowded"))
        again = _halves(*[F.col(c) for c in ("short", "left", "right", "limit")], n)
        dealt = materialize(_dealt(marked.where("crowded").select("word", "n", F.explode(F.array(*again)).alias("shard"))))
    for r in ready:
        dealt = dealt.unionByName(r)
    found = dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_search, "word string, n_near long, best_n long, best string")
    best = F.min_by("best", F.struct(-F.col("best_n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), best.alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form) to word, root: the end of each chain of forms."""
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    open_, done = forms.select("word", F.col("form").alias("root")), []
    while True:
        moved = materialize(open_.join(step, "root", "left"))  # step has one row per word; Spark splits a root of many words
        done.append(moved.where("next is null").select("word", "root"))
        open_ = moved.where("next is not null").select("word", F.col("next").alias("root"))
        if open_.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def variants(vocabulary: DataFrame, shard: int = SHARD) -> DataFrame:
    """words (word, n) to word, n, n_near, form, form_n and root."""
    with scratch(vocabulary.sparkSession) as keep:
        own = materialize(vocabulary)
        near_ = near_words(own, shard)
        # a word is one row in each of these tables, so the joins need no salt
        close = materialize(own.join(near_, "word", "left"))
        is_form = F.col("best_n") >= RATIO * F.col("n")
        told = close.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
        ends = roots(told.where("form is not null").select("word", "form"))
        return keep(materialize(told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, form and root."""
    found = words(load(spark, sf_dir, "documents")).where(F.col("n") >= LEAST_COUNT)
    return variants(found).select("word", "form", "root", "n", "n_near", "form_n")


SQL = rf"""
with recursive {crc_sql.TABLE}, texts as (
  select coalesce(doc_id::varchar, '') as id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}') as runs
  from documents
), pairs as (select id, run, count(*) as times from (select id, unnest(runs) as run from texts) group by 1, 2
), hashed as (select run, times, {crc_sql.crc32("id || ':' || run")} as h from pairs, crcs
), vocabulary as (
  select word, sum(times)::bigint as n from (
    select times, case when h % {DAMAGE} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= {LEAST_LENGTH} group by 1 having sum(times) >= {LEAST_COUNT}
), holes as (
  select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b from (select word, n, unnest(range(1, length(word) + 1))::int as i from vocabulary)
), links as (
  select x.word, x.n, y.word as other, y.n as other_n from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, x.n, y.word, y.n from holes x join vocabulary y on x.a || x.b = y.word
  union select y.word, y.n, x.word, x.n from holes x join vocabulary y on x.a || x.b = y.word
), near as (
  select word, any_value(n) as n, count(*) as n_near, max(other_n) as best_n, min(other) filter (where other_n = top) as best
  from (select *, max(other_n) over (partition by word) as top from links) group by word
), told as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= {RATIO} * v.n then best end as form, case when best_n >= {RATIO} * v.n then best_n end as form_n
  from vocabulary v left join near using (word)
), chain(word, root) as (
  select word, word from told
  union select c.word, t.form from chain c join told t on t.word = c.root where t.form is not null
)
select t.word, t.form, c.root, t.n, t.n_near, t.form_n
from told t join (select c.word, c.root from chain c join told e on e.word = c.root where e.form is null) c on c.word = t.word
"""
