"""Packing token sequences by the sum-of-squares rule.

A document is its token ids and an end id. One longer than the capacity is cut into full
pieces and a rest; full pieces are sequences of their own. Every other piece goes where
the sum of the squared counts of open bins per residual gap becomes smallest: into a bin
with some gap, or into a new bin. Only lengths matter for that, so pieces are dealt out to
shards of bounded size by a hash of what they are, not of where they lie in a file, and each
shard is packed by itself; a shard's open bins are the only loss against one single run. The
rule is fed lengths that fall, each nudged up by at most NUDGE at random: in strictly falling
order pieces of one length follow each other and crowd the same gaps.

Token ids of a word are remembered per worker (the vocabulary treats words between
boundaries independently), so most of a text is looked up rather than encoded. That path
takes texts in Latin letters; any other text is encoded by the library as a whole. The
memory is bounded in characters, and long strings aren't kept.

Defined cases: a null text is empty and has the end id alone; repeated rows are packed
each for itself; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import join_table, load, materialize, pick, slices

CAPACITY = 2048
#: About as many pieces as are packed together in one task.
SHARD = 50_000
#: The greatest part of its length by which a piece may move forward in the order.
NUDGE = 0.05
#: Characters of strings whose ids a worker remembers, beyond which it starts anew, and the longest such string.
REMEMBERED, LONGEST = 4_000_000, 64
#: Fixed values of the word-level vocabulary: how it parts a lower-case text into words,
#: written for the characters that PLAIN allows.
WORDS = r"[a-z\xc0-\u017f]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-z\xc0-\u017f]+"
#: Any other character, or a string that may begin a special token, leaves the text to the library.
UNPLAIN = r"[^\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]|<\|"


def tokenizer_path() -> str:
    """Default place of the vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Little-endian 32-bit ids, as bytes, of the lower-case strings between white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.held = 0
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.unplain = re.compile(WORDS), re.compile(UNPLAIN)
        self.model = self.tokenizer.model
        # the vocabulary writes a byte as one of these characters
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in {*range(0x21, 0x7F), *range(0xC0, 0x180)}}

    def __missing__(self, chunk: str) -> bytes:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            ids += [t.id for t in self.model.tokenize(word.translate(self.letters))]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= LONGEST:
            self[chunk] = out
            self.held += len(chunk)
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a whole text."""
        if self.unplain.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.held >= REMEMBERED:
            self.clear()
            self.held = 0
        return b"".join(map(self.__getitem__, text.lower().split()))


_loaded: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    tail = np.asarray([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _loaded.get(path) or _loaded.setdefault(path, WordIds(path))
        step = 4 * capacity
        for batch in batches:
            for first, texts in slices(batch, "text"):
                row, piece, start, length, crc, held = [], [], [], [], [], []
                for i, t in enumerate(texts):
                    data = words.ids((t or b"").decode("utf-8", "replace")) + tail
                    for p, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        row.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            held.append(part)
                doc_ids = batch.column("doc_id").slice(first, len(texts)).take(pa.array(row, pa.int64()))
                arrays = [doc_ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(held, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def tokenise(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) to pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids
    (little-endian 32-bit)."""
    docs = pick(documents, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.mapInArrow(_pieces(path or tokenizer_path(), capacity, end, with_ids), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    n[g] counts the open bins with gap g. A piece of length s moves a bin from g to g - s:
    the sum of squares changes by 2 (n[g-s] - n[g]) + 2, without the first part where the
    bin becomes full; a new bin counts as a move from a gap that nothing counts.
    """
    n = np.zeros(capacity + 1, dtype=np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made, big = 0, np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        old = n[s:capacity]
        cost = np.where(old > 0, 2 * (n[: capacity - s] - old) + 2, big)
        best = big
        if capacity > s:
            if old[0] > 0:
                cost[0] = 1 - 2 * old[0]
            at = int(cost.argmin())
            best = int(cost[at])
        fresh = 2 * int(n[capacity - s]) + 1 if s < capacity else 0
        if best <= fresh and best < big:
            g = s + at
            b = open_[g].pop()
            n[g] -= 1
        else:
            g, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - g
        rest = g - s
        if rest > 0:
            n[rest] += 1
            open_[rest].append(b)
    return bins, offsets


def feed(length: np.ndarray, draw: np.ndarray, uid: np.ndarray) -> np.ndarray:
    """The order in which pieces are placed: falling length, nudged by their draws."""
    nudged = length * (1 + NUDGE * (draw.view(np.uint64) >> np.uint64(11)) / 2.0**53)
    return np.lexsort((uid, draw, -nudged))


def _pack_shard(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        length, draw, uid = (table.column(c).to_numpy() for c in ("length", "draw", "uid"))
        order = feed(length, draw, uid)
        bins, offsets = sum_of_squares(length[order], capacity)
        seq, at = np.empty_like(bins), np.empty_like(offsets)
        seq[order], at[order] = bins, offsets
        shard = table.column("shard").to_numpy()
        table = table.drop_columns(["shard", "draw", "uid"])
        return table.append_column("sequence_id", pa.array(shard * 2**32 + seq)).append_column("offset", pa.array(at))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, most: int = SHARD) -> DataFrame:
    """pieces (doc_id, piece, ids_crc32 and a length of 1 to capacity) with sequence_id and offset.

    Pieces that differ go the same way however the input is dealt over files. Rows that repeat share a draw; a shard
    that they swell beyond twice its size is dealt again, by row.
    """
    pieces = materialize(pieces.withColumn("uid", F.monotonically_increasing_id()))
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long")).drop("uid")
    rest = pieces.where(F.col("length") < capacity).withColumn("draw", F.xxhash64("doc_id", "piece", "ids_crc32"))
    shards = max(1, round(rest.count() / most))
    rest = rest.withColumn("shard", F.pmod("draw", F.lit(shards)))
    crowded = rest.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).alias("cuts")).where("cuts > 2")
    rest = join_table(rest, crowded, ["shard"], "left")
    cut = F.pmod(F.xxhash64("uid"), F.coalesce("cuts", F.lit(1)))
    rest = rest.withColumn("shard", F.col("shard") + shards * cut).drop("cuts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.drop("uid").schema) + ", sequence_id long, offset long"
    return full.unionByName(rest.groupBy("shard").applyInArrow(_pack_shard(capacity), fields))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (bytes), doc_ids, lengths; needs pieces with ids.
    A sequence has at most `capacity` tokens, so its row is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", ids.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    packed = pack(tokenise(load(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
