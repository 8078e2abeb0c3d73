"""Quality classification by co-training.

Two views of a document: what its text looks like, and its metadata (source, language,
length). Each has its own logistic regression. Over some rounds, each view labels the
unlabelled documents that it is most sure of, and the other view learns from them. The
final scores of both views are calibrated (Platt) on labelled documents held out from
training, and a logistic combination of the two gives the probability of good quality.

The views of every document are written once, from its whole text, without a shuffle. At
most ``labelled`` labelled documents, those with the smallest keyed hashes of doc_id and
views (rows that repeat both count once), are used to fit. Of the others all take part in every round: a pass over the views counts the
scores of those still open in bins, which gives the limits of the most sure ones of the
whole corpus (in the bin at a limit, the smallest hashes), and a second one writes these
out. Newton's sums over all of them are added to those of the labelled documents; they
weigh together as much as those of as many others as there are labelled ones.

Defined cases: a null text is empty; null metadata is a value of its own; labels of
unknown documents are ignored, and of repeated labels the least counts; with labels of
one class or none every score is that class's share (one half if none); an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import join_table, load, materialize, pick, release, slices

LABELLED = 4000
ROUNDS, CONFIDENT, GIVEN = 4, 0.05, 0.3
#: Bins of scores from -30 to 30, and the tasks that add up Newton's sums.
BINS, SUM_TASKS = 6000, 32
HASHED = 512
META = 256
_SYMBOLS = re.compile(r"[^\w\s.,;:'\"()-]")


def text_view(text: str) -> np.ndarray:
    """Measures of a text and hashed counts of its symbols and word endings."""
    v = np.zeros(20 + HASHED)
    words = text.split()
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    distinct = len(set(words))
    symbols = _SYMBOLS.findall(text)
    upper = sum(map(str.isupper, words))
    repeats = sum(map(str.__eq__, words, words[1:]))
    # the worst line counts beside the mean: junk often fills only a part
    def line(x: str) -> tuple[float, float, float]:
        w = x.split()
        return (len(w) - len(set(w))) / max(1, len(w)) if len(w) > 5 else 0.0, sum(map(str.isupper, w)) / max(1, len(w)) if len(w) > 3 else 0.0, len(_SYMBOLS.findall(x)) / max(1, len(x))

    worst = np.array([line(x) for x in lines]).max(axis=0) if lines else np.zeros(3)
    v[:20] = (
        1.0,
        np.log1p(n) / 5,
        np.log1p(len(lines)) / 3,
        distinct / max(1, n),
        len(symbols) / chars * 10,
        upper / max(1, n) * 3,
        repeats / max(1, n) * 3,
        sum(map(len, words)) / max(1, n) / 10,
        sum(w[-1] in ".,;:" for w in words) / max(1, n),
        len(set(lines)) / max(1, len(lines)),
        *worst[:2] * 2,
        worst[2] * 10,
        float(n == 0),
        float(n < 5),
        float(n < 20),
        sum(map(str.isdigit, text)) / chars * 10,
        "|" in text,
        any(len(w) > 40 for w in words),
        np.log1p(max(map(len, lines), default=0)) / 5,
    )
    for token, weight in ((s, 1.0) for s in set(symbols)):
        v[20 + xxhash.xxh32_intdigest(token) % HASHED] += weight
    for w in words:
        v[20 + xxhash.xxh32_intdigest(w[-3:]) % HASHED] += 4.0 / n
    return v


def meta_view(source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    """Hashed source and language, alone and together, and classes of length."""
    v = np.zeros(META)
    v[0] = 1.0
    size = "none" if n_chars is None else str(int(np.log2(max(0, n_chars) + 1) * 2))
    for token in (f"s{source}", f"l{lang}", f"n{size}", f"s{source}l{lang}", f"l{lang}n{size}"):
        v[1 + xxhash.xxh32_intdigest(token) % (META - 1)] = 1.0
    return v


def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray | float, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss, without the penalty."""
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return x.T @ (w * (p - y)), (x * (w * p * (1 - p))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 15) -> np.ndarray:
    """Weighted logistic regression with a ridge penalty, by Newton's method."""
    return newton([np.zeros(x.shape[1])], lambda betas: {0: sums(x, y, w, betas[0])}, ridge, steps)[0]


def newton(betas: list[np.ndarray], total, ridge: float = 1.0, steps: int = 15) -> list[np.ndarray]:
    """Newton's method for some regressions at once; total: gets the coefficients of those
    still open by number, and gives their gradients and Hessians."""
    betas, open_ = list(betas), set(range(len(betas)))
    for _ in range(steps):
        for i, (g, h) in total({i: betas[i] for i in open_}).items():
            step = np.linalg.solve(h + ridge * np.eye(len(g)), g + ridge * betas[i])
            betas[i] = betas[i] - step
            if np.abs(step).max() < 1e-6:
                open_.remove(i)
        if not open_:
            break
    return betas


def skill(z: np.ndarray, y: np.ndarray) -> float:
    """How well scores tell labels apart, from 0 (no better than by chance) to 1, less what chance may give to so few;
    ties count half."""
    good, bad = z[y > 0], z[y <= 0]
    if not len(good) or not len(bad):
        return 0.0
    order = np.sort(bad)
    area = (np.searchsorted(order, good, "left") + np.searchsorted(order, good, "right")).mean() / (2 * len(bad))
    return float(np.clip(2 * (area - 2 * np.sqrt((1 / len(good) + 1 / len(bad)) / 12)) - 1, 0, 1))


class Model:
    """Weights of both views and of their calibrated combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, platt: np.ndarray, stack: np.ndarray):
        self.text, self.meta, self.platt, self.stack = text, meta, platt, stack

    def combine(self, zt: np.ndarray, zm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of each view, and of both."""
        ct, cm = self.platt[0, 0] * zt + self.platt[0, 1], self.platt[1, 0] * zm + self.platt[1, 1]
        z = self.stack[0] * ct + self.stack[1] * cm + self.stack[2]
        return tuple(1 / (1 + np.exp(-np.clip(q, -30, 30))) for q in (ct, cm, z))


def bins(z: np.ndarray) -> np.ndarray:
    return np.minimum(((np.clip(z, -30, 30) + 30) * (BINS / 60)).astype(np.int64), BINS - 1)


def limits(counts: np.ndarray, share: float) -> tuple[int, int, int, int]:
    """From the counts of open documents by bin of score, the limits of the most sure: the bin and,
    within it, the hash below which a document is chosen, at the low end and at the high end."""
    n = max(1, int(counts.sum() * CONFIDENT))
    out = []
    for c, want in ((counts, max(1, round(n * (1 - share)))), (counts[::-1], max(1, round(n * share)))):
        upto = np.cumsum(c)
        at = min(int(np.searchsorted(upto, want)), BINS - 1)
        part = (want - (upto[at] - c[at])) / max(1, c[at])
        out += [at, int(np.ceil(min(1.0, part) * 2**31))]
    return out[0], out[1], BINS - 1 - out[2], out[3]


def drawn(key: np.ndarray, i: int) -> np.ndarray:
    """A hash below 2**31 of each key for a round, so that no round repeats the choice of one before."""
    h = (key.astype(np.uint64) + np.uint64(i << 32)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(33)).astype(np.int64)


def given(x: tuple, key: np.ndarray, rounds: list) -> np.ndarray:
    """What each view (row) has been given for each document: the round and the label as
    2 * round + label, or -1. rounds: coefficients and limits of both views."""
    out = np.full((2, len(key)), -1, dtype=np.int64)
    for i, (betas, cuts) in enumerate(rounds):
        now, h = out.copy(), drawn(key, i)
        for me, other in ((0, 1), (1, 0)):
            if cuts[me] is None:
                continue
            z = x[me] @ betas[me]
            b, p = bins(z), 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            low, low_key, high, high_key = cuts[me]
            bad = ((b < low) | ((b == low) & (h < low_key))) & (p < 0.1)
            good = ((b > high) | ((b == high) & (h < high_key))) & (p > 0.9)
            free = out[other] < 0
            now[other][free & bad] = 2 * i
            now[other][free & good] = 2 * i + 1
        out = now
    return out


class Held:
    """Unlabelled documents in memory."""

    def __init__(self, xt: np.ndarray, xm: np.ndarray, key: np.ndarray):
        self.x, self.key, self.has = (xt, xm), key, np.full((2, len(key)), -1)

    def __len__(self) -> int:
        return len(self.key)

    def counts(self, rounds: list, betas: list) -> np.ndarray:
        return np.stack([np.bincount(bins(self.x[me] @ betas[me])[self.has[1 - me] < 0], minlength=BINS) for me in (0, 1)])

    def give(self, rounds: list) -> np.ndarray:
        """Give the last round's labels; how many documents each view has been given by now."""
        self.has = given(self.x, self.key, rounds)
        return (self.has >= 0).sum(axis=1)

    def sums(self, betas: dict) -> dict:
        return {v: sums(self.x[v][self.has[v] >= 0], self.has[v][self.has[v] >= 0] % 2, 1.0, b) for v, b in betas.items()}


class Spread:
    """Unlabelled documents in a table of views."""

    COLUMNS = "key long, ti binary, tv binary, mi binary"

    def __init__(self, table: DataFrame):
        self.table, self.n, self.chosen, self.given = table.select("key", "ti", "tv", "mi"), table.count(), [], np.zeros(2, dtype=np.int64)

    def __len__(self) -> int:
        return self.n

    def counts(self, rounds: list, betas: list) -> np.ndarray:
        def run(batches):
            out = np.zeros((2, BINS), dtype=np.int64)
            for batch in batches:
                x, key = dense(batch), batch.column("key").to_numpy()
                has = given(x, key, rounds)
                for me in (0, 1):
                    out[me] += np.bincount(bins(x[me] @ betas[me])[has[1 - me] < 0], minlength=BINS)
            view, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(view, pa.int64()), pa.array(at, pa.int64()), pa.array(out[view, at], pa.int64())], names=["view", "bin", "n"])

        out = np.zeros((2, BINS), dtype=np.int64)
        for r in self.table.mapInArrow(run, "view long, bin long, n long").groupBy("view", "bin").agg(F.sum("n")).collect():  # at most 2 * BINS rows
            out[r[0], r[1]] = r[2]
        return out

    def give(self, rounds: list) -> np.ndarray:
        def run(batches):
            for batch in batches:
                has = given(dense(batch), batch.column("key").to_numpy(), rounds)
                new = np.where(has >= 2 * (len(rounds) - 1), has % 2, -1)
                some = pa.array((new >= 0).any(axis=0))
                rows = pa.RecordBatch.from_arrays([*batch.columns, pa.array(new[0]), pa.array(new[1])], names=[*batch.schema.names, "y0", "y1"])
                yield rows.filter(some)

        self.chosen.append(materialize(self.table.mapInArrow(run, f"{self.COLUMNS}, y0 long, y1 long")))
        self.given = self.given + np.array(self.chosen[-1].agg(F.count_if(F.col("y0") >= 0), F.count_if(F.col("y1") >= 0)).first())
        return self.given

    def sums(self, betas: dict) -> dict:
        def run(batches):
            out = {v: [np.zeros(len(b)), np.zeros((len(b), len(b)))] for v, b in betas.items()}
            for batch in batches:
                x = dense(batch)
                for v, b in betas.items():
                    y = batch.column(f"y{v}").to_numpy()
                    for at, more in zip(out[v], sums(x[v][y >= 0], y[y >= 0], 1.0, b)):
                        at += more
            for v, (g, h) in out.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()), pa.array([g.tobytes()], pa.binary()), pa.array([h[np.triu_indices(len(g))].tobytes()], pa.binary())], names=["view", "g", "h"])

        rows = self.chosen[0]
        for t in self.chosen[1:]:
            rows = rows.union(t)
        out = {v: (np.zeros(len(b)), np.zeros((len(b), len(b)))) for v, b in betas.items()}
        for v, g, h in rows.coalesce(SUM_TASKS).mapInArrow(run, "view long, g binary, h binary").collect():  # two rows a task
            upper = np.zeros_like(out[v][1])
            upper[np.triu_indices(len(upper))] = np.frombuffer(h)
            out[v][0][:] += np.frombuffer(g)
            out[v][1][:] += upper + np.triu(upper, 1).T
        return out


def fit(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, held: np.ndarray, pool: Held | Spread | None = None) -> Model:
    """xt and xm: the views of all sampled documents; y: 1, 0, or -1 without a label; held: for
    calibration alone; pool: the unlabelled documents, if they aren't among these."""
    known, x = (y >= 0) & ~held, (xt, xm)
    if pool is None:
        free = np.flatnonzero(y < 0)
        pool = Held(xt[free], xm[free], np.arange(len(free)) * 2**31 // max(1, len(free)))
    weight, test = np.zeros(2), (y >= 0) & held
    label, share = y[known].astype(float), y[known].mean()

    def total(betas: dict, more: bool = True) -> dict:
        out = {v: sums(x[v][known], label, 1.0, b) for v, b in betas.items()}
        if more:
            for v, (g, h) in pool.sums(betas).items():
                out[v] = out[v][0] + weight[v] * g, out[v][1] + weight[v] * h
        return out

    betas = newton([np.zeros(xt.shape[1]), np.zeros(xm.shape[1])], lambda b: total(b, False))
    rounds: list = []
    for _ in range(ROUNDS if len(pool) else 0):
        counts = pool.counts(rounds, betas)
        rounds.append((betas, [limits(c, share) if c.any() else None for c in counts]))
        # what a view has been given weighs as much as GIVEN of the given labels, however many documents that is,
        # times the skill that its teacher, the other view, shows on the labels held out
        taught = np.array([skill(x[1 - me][test] @ betas[1 - me], y[test]) for me in (0, 1)])
        weight = GIVEN * np.minimum(1.0, known.sum() / np.maximum(1, pool.give(rounds))) * taught
        betas = newton(betas, total)
    zt, zm, yt = xt[test] @ betas[0], xm[test] @ betas[1], y[test].astype(float)
    one = np.ones(len(yt))
    if len(np.unique(yt)) < 2:
        return Model(*betas, np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([1.0, 0.2, 0.0]))
    platt = np.array([logistic(np.stack([z, one], axis=1), yt, one, 0.01) for z in (zt, zm)])
    calibrated = np.stack([platt[0, 0] * zt + platt[0, 1], platt[1, 0] * zm + platt[1, 1], one], axis=1)
    return Model(*betas, platt, logistic(calibrated, yt, one, 0.1))


def dense(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Both views of the rows of a batch, as matrices."""
    ti, tv, mi = (batch.column(c).to_pylist() for c in ("ti", "tv", "mi"))
    xt, xm = np.zeros((len(ti), 20 + HASHED)), np.zeros((len(ti), META))
    row = np.arange(len(ti))
    xt[np.repeat(row, [len(b) // 2 for b in ti]), np.frombuffer(b"".join(ti), dtype="<u2")] = np.frombuffer(b"".join(tv), dtype="<f4")
    xm[np.repeat(row, [len(b) for b in mi]), np.frombuffer(b"".join(mi), dtype="u1")] = 1.0
    return xt, xm


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch, "text", 1_000_000):
            n = len(texts)
            cols = [batch.column(c).slice(start, n).to_pylist() for c in ("source", "lang", "n_chars")]
            xt = [text_view((t or b"").decode("utf-8", "replace")) for t in texts]
            at = [np.flatnonzero(v) for v in xt]
            xm = [np.flatnonzero(meta_view(*m)).astype("u1").tobytes() for m in zip(*cols)]
            put = [[i.astype("<u2").tobytes() for i in at], [v[i].astype("<f4").tobytes() for v, i in zip(xt, at)], xm]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, n), *(pa.array(c, pa.binary()) for c in put)], names=["doc_id", "ti", "tv", "mi"])


def views(documents: DataFrame) -> DataFrame:
    """doc_id and the places and values of both views that aren't zero (those of the metadata are 1), a row for each row."""
    docs = pick(documents, "doc_id", "text", "source", "lang", "n_chars").select("doc_id", F.col("text").cast("binary").alias("text"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return docs.mapInArrow(_views, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, ti binary, tv binary, mi binary")


def train(documents: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | float:
    """A model, or the share of good labels where they are of one class."""
    return train_views(materialize(views(documents)), labels, labelled)


def train_views(table: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model | float:
    """train() from the views of all documents."""
    known = materialize(pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")))
    key = F.pmod(F.xxhash64("doc_id", "ti", "tv", "mi", F.lit(13)), F.lit(2**31))
    rows = materialize(join_table(table.where("doc_id is not null"), known, ["doc_id"], "left").withColumn("key", key))
    release(known)
    counts = {r[0]: r[1] for r in rows.where("quality is not null").select("doc_id", "quality").distinct().groupBy("quality").count().collect()}
    good, bad = (sum(n for q, n in counts.items() if f(q)) for f in (lambda q: q > 0, lambda q: q <= 0))
    if not good or not bad:
        return 1.0 if good else 0.0 if bad else 0.5
    share = (labelled + 10 * labelled**0.5) / (good + bad)  # as many fall below it almost surely; of them the first
    few = rows.where(F.col("quality").isNotNull() & (F.col("key") < min(1.0, share) * 2.0**31)).groupBy("key").agg(F.min(F.struct("quality", "ti", "tv", "mi")).alias("x"))
    got = few.orderBy("key").limit(labelled).select("key", "x.*").toArrow().combine_chunks().to_batches()
    y = np.concatenate([(b.column("quality").to_numpy() > 0).astype(int) for b in got] or [np.zeros(0, dtype=int)])
    held = np.concatenate([b.column("key").to_numpy() % 4 == 0 for b in got] or [np.zeros(0, dtype=bool)])
    if len(np.unique(y[~held])) < 2:
        return good / (good + bad)
    xt, xm = (np.concatenate(x) for x in zip(*map(dense, got)))
    pool = Spread(rows.where("quality is null"))
    model = fit(xt, xm, y, held, pool)
    release(rows, *pool.chosen)
    return model


def _score(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if isinstance(model, float):
                scores = [np.full(batch.num_rows, model)] * 3
            else:
                xt, xm = dense(batch)
                scores = model.combine(xt @ model.text, xm @ model.meta)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(s, pa.float64()) for s in scores)], names=["doc_id", "text_score", "meta_score", "score"])

    return run


def score(documents: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score (of good quality) and keep (score at the threshold or above)."""
    return score_views(views(documents), model, threshold)


def score_views(table: DataFrame, model: Model | float, threshold: float = 0.5) -> DataFrame:
    """score() from the views of all documents."""
    schema = f"doc_id {table.schema['doc_id'].dataType.simpleString()}, text_score double, meta_score double, score double"
    return table.mapInArrow(_score(model), schema).withColumn("keep", F.col("score") >= threshold)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    table = materialize(views(load(spark, sf_dir, "documents")))
    return score_views(table, train_views(table, load(spark, sf_dir, "labels")))
