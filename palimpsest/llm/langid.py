"""Language identification: sparse multinomial logistic regression on TF-IDF character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties, and
calibrated by a temperature.

Features: hashed n-grams of 1 to 3 characters of the lower-case text, where every run of
characters that aren't letters counts as one space. Term frequency is a share of a
document's n-grams; document frequencies come from all labelled training documents.
The model is fitted on a sample of at most ``per_language`` training documents of each
language (those with the smallest keyed hashes of doc_id and text; rows that repeat both
count once); four fifths of it train the
weights, one fifth sets the temperature.

Training documents: crc32 of the doc_id as text leaves a remainder other than 2 on
division by 4, and lang is not null. Predictions use the text alone.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any
training document every row is ``und``; a null doc_id is taken as the text "" for the
split; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import load, pick, slices

BITS = 17
LONGEST = 3
PER_LANGUAGE = 1000
FOLDS, HELD_OUT = 4, 2
#: Of follow-the-regularised-leader: learning rate, smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
EPOCHS = 3
_LETTER = regex.compile(r"\p{L}")
#: 1 for letters of the basic plane, from the category of each code point; built on first use.
_classes: list[np.ndarray] = []


def _lower_letters() -> np.ndarray:
    """For each code unit below 0x10000: its lower case if a letter or mark, else a space."""
    if not _classes:
        table = np.full(0x10000, 32, dtype=np.uint32)
        for c in range(0x10000):
            x = chr(c)
            if x.isalpha() or 0x300 <= c < 0x370:
                low = x.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _classes.append(table)
    return _classes[0]


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one after another, and where each text's begin (with the end)."""
    parts = []
    for t in texts:
        parts += [b" ", t or b"", b" "]
    whole = b"".join(parts).decode("utf-8", "replace")
    lengths = [2 + (len(t.decode("utf-8", "replace")) if t else 0) for t in texts]
    code = np.frombuffer(whole.encode("utf-32-le", "replace"), dtype="<u4")
    table = _lower_letters()
    code = np.where(code < 0x10000, table[np.minimum(code, 0xFFFF)], code)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    doc_start = np.zeros(len(code), dtype=bool)
    doc_start[bounds[:-1]] = True
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | doc_start[1:]
    counts = np.concatenate([[0], np.cumsum(keep)])[bounds]
    code = code[keep].astype(np.uint32)
    n = len(code)
    # position p holds the n-grams that begin there; those that would pass a text's end are marked by hash 0 of their order
    out = np.empty((n, LONGEST), dtype=np.uint32)
    h = np.zeros(n, dtype=np.uint32)
    last = np.repeat(counts[1:], np.diff(counts)) if n else np.zeros(0, dtype=np.int64)
    at = np.arange(n)
    for k in range(LONGEST):
        shifted = np.concatenate([code[k:], np.zeros(k, dtype=np.uint32)])
        h = (h ^ shifted) * np.uint32(0x9E3779B1) + np.uint32(k + 1)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
        out[:, k] = np.where(at + k < last, mixed >> np.uint32(32 - BITS), np.uint32(k))
    return out.reshape(-1), counts * LONGEST


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, dtype=np.int64)
    seen = np.empty(1 << BITS, dtype=np.int64)
    docs = 0
    for batch in batches:
        for _, texts in slices(batch, "text", 300_000):
            h, bounds = grams(texts)
            docs += len(texts)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                part = h[a:b]
                order = np.arange(len(part))
                seen[part[::-1]] = order[::-1]  # the first place of each n-gram is written last
                df[part[seen[part] == order]] += 1
    at = np.flatnonzero(df)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], docs), pa.int64())], names=["gram", "df"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch, "text", 300_000):
            h, bounds = grams(texts)
            ids, tfs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                u, c = np.unique(h[a:b], return_counts=True)
                ids.append(u.astype("<u4").tobytes())
                tfs.append((c / max(1, b - a)).astype("<f4").tobytes())
            keep = [batch.column(c).slice(start, len(texts)) for c in ("lang", "key")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())], names=["lang", "key", "ids", "tf"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """languages; table: for each n-gram the score it gives per language; temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.table, self.bias, self.temperature = languages, table, bias, temperature

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        h, bounds = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        size = np.diff(bounds)
        some = size > 0
        for j in range(len(self.languages)):
            out[some, j] = np.add.reduceat(self.table[j][h], bounds[:-1][some], dtype=np.float64)
        return out / np.maximum(size, 1)[:, None] + self.bias

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        p = _softmax(self.logits(texts) / self.temperature) if texts else np.zeros((0, 1))
        best = p.argmax(axis=1) if texts else []
        langs, scores = [], []
        for i, t in enumerate(texts):
            if not t or not _LETTER.search(t.decode("utf-8", "replace")):
                langs.append("und")
                scores.append(0.0)
            else:
                langs.append(self.languages[best[i]])
                scores.append(float(p[i, best[i]]))
        return langs, scores


def fit(rows: list[tuple[str, int, bytes, bytes]], df: np.ndarray, docs: int) -> Model:
    """rows (lang, key, n-gram ids, term frequencies), in a fixed order, to a model."""
    languages = sorted({r[0] for r in rows})
    k, idf = len(languages), np.log((1.0 + docs) / (1.0 + df)) + 1.0
    number = {x: i for i, x in enumerate(languages)}
    examples = []
    for lang, key, ids, tf in rows:
        i = np.frombuffer(ids, dtype="<u4").astype(np.int32)
        x = np.frombuffer(tf, dtype="<f4").astype(np.float64) * idf[i]
        examples.append((number[lang], key % 5 == 0 and len(rows) >= 50, i, x * SCALE))
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for y, held, i, x in examples:
            if held:
                continue
            zi, ni = z[i], n[i]
            w, wb = weights(zi, ni), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
            g = _softmax(x @ w + wb)
            g[y] -= 1.0
            gx = x[:, None] * g
            n[i] = more = ni + gx * gx
            z[i] = zi + gx - (np.sqrt(more) - np.sqrt(ni)) / ALPHA * w
            moreb = nb + g * g
            zb += g - (np.sqrt(moreb) - np.sqrt(nb)) / ALPHA * wb
            nb = moreb
    w, wb = weights(z, n), -zb / ((BETA + np.sqrt(nb)) / ALPHA + L2)
    held = [(y, x @ w[i] + wb) for y, h, i, x in examples if h]
    temperature = 1.0
    if held:
        ys, zs = np.array([y for y, _ in held]), np.array([s for _, s in held])
        tries = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        # smoothed targets: a small held-out part without an error must not make every score 1
        eps = 1.0 / (len(ys) + 2)
        goal = np.full(zs.shape, eps / max(1, k - 1))
        goal[np.arange(len(ys)), ys] = 1.0 - eps
        losses = [-(goal * np.log(np.maximum(_softmax(zs / t), 1e-300))).sum(axis=1).mean() for t in tries]
        temperature = float(tries[int(np.argmin(losses))])
    return Model(languages, np.ascontiguousarray((w * idf[:, None] * SCALE).T.astype(np.float32)), wb, temperature)


#: Term frequencies are shares; this brings the features to a size that suits the learning rate.
SCALE = 10.0


def train(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from the training rows of documents (doc_id, text, lang); None if there are none."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    rows = pick(documents, "doc_id", "text", "lang").where((fold != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("key", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(2**31))).withColumn("text", F.col("text").cast("binary"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    df = np.zeros(1 << BITS, dtype=np.int64)
    docs = 0
    for r in rows.select("text").mapInArrow(_document_frequency, "gram int, df long").groupBy("gram").agg(F.sum("df")).collect():
        if r[0] < 0:
            docs = r[1]
        else:
            df[r[0]] = r[1]
    # a language's share of the hash range below which per_language of its rows fall almost surely; of them the first
    share = (per_language + 10 * per_language**0.5) / per_language
    limit = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, share * per_language / n)))])[F.col("lang")]
    few = rows.where(F.col("key") < limit * 2.0**31).groupBy("lang", "key").agg(F.min("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    sample = few.withColumn("first", first).where(F.col("first") <= per_language).select("lang", "key", "text").mapInArrow(_counts, "lang string, key long, ids binary, tf binary")
    got = sorted((tuple(r) for r in sample.collect()), key=lambda r: (r[1], r[0], bytes(r[2]), bytes(r[3])))
    return fit(got, df, docs) if got else None


def _predict(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "text", 300_000):
                langs, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
                keep = [batch.column(c).slice(start, len(texts)) for c in batch.schema.names]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def identify(documents: DataFrame, model: Model | None, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns of documents and its text, with lang_pred and score."""
    docs = pick(documents, *columns, "text").withColumn("text", F.col("text").cast("binary"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(_predict(model), schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    documents = load(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return identify(documents, train(documents)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
