"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts are the words between white space (space and \\x09-\\x0D); their n-grams are runs of
five words (a shorter text is one n-gram of all its words). Equal word lists form one
class; the join links classes whose n-gram sets have a Jaccard similarity of 0.8 or more.

1. One pass over the texts gives every document a class hash (128 bits) and a signature of
   128 MinHash values, a byte of each. A tree of the forest is a fixed choice of 16 of these
   values in order; a text's label in it is a path from the root, and texts that share a
   prefix of their labels share a node of the trie.
2. The tries are walked from the shortest prefixes of DEPTHS downward. A node with no more
   than CROWDED texts is a leaf: its texts are candidates of each other. The texts of a
   crowded node go on to the next depth, so matched prefixes are as short as crowding allows.
   Then each text's recall is summed up from the prefix lengths it ended with, for a partner
   at exactly the threshold. Where it lies below RECALL, matched prefixes of that text are
   shortened again, the least crowded nodes first, until the target is met; a node taken back
   this way makes all texts below it candidates. Texts of uncrowded parts are searched with
   the shortest prefixes in all trees and reach a higher recall.
3. Candidates of a node are linked by a star to one of them, never as pairs. A star of an
   uncrowded node is cut where similarities to its centre, estimated from the signatures, leave
   a gap that no two texts at the threshold can span (Jaccard distance is a metric), so that
   chance meetings don't join groups. Connected components of the stars are candidate groups.
4. Only the texts of candidate groups are read again, as n-gram sets. Groups are dealt to
   tasks of bounded size; a group too large for one task is cut into blocks, ordered by set
   size, and each two blocks that the length bound allows meet in one task. Each task counts
   common n-grams exactly through an inverted index and returns, per class, its number of
   links and one member of its linked set.
5. Connected components of the links are the groups of near copies.

Rows of one node are combined to one for each CHUNK texts before they are shuffled, and no
task sees a whole crowded node. Nothing here sends links, groups or fingerprints to the driver.

Defined cases: a null, empty or blank text has no n-gram and links to nothing; such rows
form one class; repeated rows belong to one class; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import BROADCAST_ROWS, join_table, load, materialize, pick, release, scratch, slices, small

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
HASHES, TREES, DEPTHS = 128, 64, (6, 8, 11, 16)
#: Texts above which a node of a trie is crowded.
CROWDED = 64
#: A star is cut at a gap of estimated similarity above this: the distance of two texts at the
#: threshold (0.2) and four standard deviations of the estimate's error.
GAP = 0.35
#: N-gram hashes that one verifying task takes about.
TASK_GRAMS = 1_000_000
#: Bytes of text, and signatures, that a worker holds as arrays at a time.
TEXT_BYTES, CHUNK = 400_000, 16_384

_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_PLACES = _RNG.integers(0, 2**64, NGRAM, dtype=np.uint64) | np.uint64(1)
_A = (_RNG.integers(0, 2**32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_CHOICE = np.stack([_RNG.permutation(HASHES)[: DEPTHS[-1]] for _ in range(TREES)])
_LABEL = _RNG.integers(0, 2**64, DEPTHS[-1], dtype=np.uint64) | np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def shared_depths(similarity: float = THRESHOLD, trials: int = 100_000, seed: int = 7) -> np.ndarray:
    """Simulated length of the prefix that two texts of this similarity share, by trial and tree.

    The trees choose from the same HASHES values, so their matches aren't independent.
    """
    rng, out = np.random.default_rng(seed), np.zeros((trials, TREES), dtype=np.int8)
    for at in range(0, trials, 5000):  # a few megabytes at a time
        agree = rng.random((min(5000, trials - at), HASHES)) < similarity
        for t in range(TREES):
            out[at : at + len(agree), t] = np.logical_and.accumulate(agree[:, _CHOICE[t]], axis=1).sum(axis=1, dtype=np.int8)
    return out


@lru_cache(maxsize=2)
def chances(threshold: float = THRESHOLD) -> np.ndarray:
    """For each of DEPTHS, the log of a tree's chance to miss a partner at the threshold, if trees
    were independent and all together missed as often as they do in the simulation."""
    shared = shared_depths(threshold)
    miss = [max(0.5, (shared < d).all(axis=1).sum()) / len(shared) for d in DEPTHS]
    return np.log(miss) / TREES


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, _BASE_INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and where each text's begin (with the end)."""
    data = b" ".join(t or b"" for t in texts) + b" "
    b = np.frombuffer(data, dtype=np.uint8)
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    up, down = _powers(1 << max(19, int(len(b)).bit_length()))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * up[: len(b)], out=sums[1:])
    word = ~blank
    starts = np.flatnonzero(word & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(word & np.concatenate([blank[1:], [True]])) + 1
    h = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
    return h, np.searchsorted(starts, offsets)


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """N-gram hashes of all texts (with repeats), where each text's begin, and each text's class hash."""
    h, at = words(texts)
    n = np.diff(at)
    total = np.where(n == 0, 0, np.maximum(n - NGRAM + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(total)])
    owner = np.repeat(np.arange(len(texts)), total)
    first = at[:-1][owner] + np.arange(bounds[-1]) - bounds[:-1][owner]
    stop = at[1:][owner]
    padded = np.concatenate([h, np.zeros(NGRAM, dtype=np.uint64)])
    g = np.zeros(len(first), dtype=np.uint64)
    for k in range(NGRAM):
        w = padded[first + k]
        if k:
            w = np.where(first + k < stop, w, np.uint64(0))
        g += w * _PLACES[k]
    place = np.arange(len(h)) - np.repeat(at[:-1], n)
    up, _ = _powers(1 << max(19, int(len(h) + 1).bit_length()))
    both = []
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0xDA942042E4DD58B5)):
        c = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(_mix(h + salt) * up[place], out=c[1:])
        both.append(_mix(c[at[1:]] - c[at[:-1]] + n.astype(np.uint64)))
    classes = [x.tobytes() + y.tobytes() for x, y in zip(*both)]
    return _mix(g), bounds, classes


def signatures(g: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value of each text; texts without n-grams are left out by the caller."""
    some = np.diff(bounds) > 0
    x = (g >> np.uint64(32)).astype(np.uint32)
    sig = np.zeros((len(some), HASHES), dtype=np.uint8)
    if some.any():
        at = bounds[:-1][some]
        for k in range(HASHES):
            least = np.minimum.reduceat(x * _A[k] + _B[k], at)
            sig[some, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return sig


def node_keys(sig: np.ndarray, depth: int) -> np.ndarray:
    """Hash of each text's node at a depth of each tree."""
    key = np.tile((np.arange(TREES, dtype=np.uint64) + np.uint64(1)) * np.uint64(1000) + np.uint64(depth), (len(sig), 1))
    for j in range(depth):
        key += (sig[:, _CHOICE[:, j]].astype(np.uint64) + np.uint64(1)) * _LABEL[j]
        key = _mix(key)
    return key.view(np.int64)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch, "text", TEXT_BYTES):
            g, bounds, classes = ngrams(texts)
            sig, n = signatures(g, bounds), np.diff(bounds)
            ids = batch.column("doc_id").slice(start, len(texts))
            held = pa.array([x.tobytes() if m else None for x, m in zip(sig, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.binary()), held], names=["doc_id", "class", "sig"])


def _longs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 64-bit numbers as binary values; a run of one is null."""
    starts = np.concatenate([[0], ends[:-1]])
    offsets = np.concatenate([[0], 8 * ends]).astype(np.int32)
    whole = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<i8").tobytes())])
    return pc.if_else(pa.array(ends - starts > 1), whole, pa.nulls(len(ends), pa.binary()))


def _nodes(depth: int):
    """Rows (key, tree, first, members): the texts of one node in a chunk; members is null for one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts).combine_chunks()
            cid = rows.column("cid").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
            mask = rows.column("mask").to_numpy().view(np.uint64)
            use = (mask[:, None] >> np.arange(TREES, dtype=np.uint64)) & np.uint64(1) == 1
            row, tree = np.nonzero(use)
            key, who = node_keys(sig, depth)[row, tree], cid[row]
            order = np.lexsort((who, key))
            key, who, tree = key[order], who[order], tree[order]
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
            first = np.concatenate([[0], ends[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(tree[first], pa.int32()), pa.array(who[first]), _longs(who, ends)], names=["key", "tree", "first", "members"])

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= CHUNK:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    return run


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a member of the rows of nodes: cid, and key, tree, n, least of its node."""
    for batch in batches:
        lists = [np.frombuffer(m, dtype="<i8") if m else np.array([f]) for m, f in zip(batch.column("members").to_pylist(), batch.column("first").to_pylist())]
        at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        who = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
        keep = ["key", "tree", "n", "least"]
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), *(batch.column(c).take(at) for c in keep)], names=["cid", *keep])


MEMBERS = "cid long, key long, tree int, n long, least long"


def shorten(nodes: list[dict], miss: np.ndarray, goal: float) -> tuple[np.ndarray, set[int]]:
    """From the crowded nodes (n, level, tree, key) of a text: the level at which its search of each
    tree ends, and the keys of the nodes taken back, the least crowded first, until the sum of
    `miss` is down to the goal."""
    level = np.zeros(TREES, dtype=int)
    for x in nodes:
        level[x["tree"]] = max(level[x["tree"]], min(len(DEPTHS) - 1, x["level"] + 1))
    now, taken = miss[level].sum(), {}
    for x in sorted(nodes, key=lambda x: (x["n"], -x["level"], x["tree"])):
        if now <= goal:
            break
        t, to = x["tree"], x["level"]
        if to < level[t]:
            now += miss[to] - miss[level[t]]
            level[t], taken[t] = to, x["key"]
    return level, set(taken.values())


def _shorten(miss: np.ndarray, goal: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = set()
            for nodes in batch.column("nodes").to_pylist():
                keys |= shorten(nodes, miss, goal)[1]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.int64())], names=["key"])

    return run


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal signature values of pairs of texts."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sig", "sig2"))
        yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("least"), pa.array((a == b).mean(axis=1), pa.float64())], names=["cid", "least", "alike"])


def _cut_stars(stars: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges of the stars of uncrowded nodes (at most CROWDED rows of one key), cut at gaps of similarity to their centre."""
    stars = materialize(stars.where("cid <> least").select("key", "cid", "least"))
    pairs = stars.select("cid", "least").distinct().join(sigs, "cid")
    pairs = pairs.join(sigs.select(F.col("cid").alias("least"), F.col("sig").alias("sig2")), "least").select("cid", "least", "sig", "sig2")
    alike = materialize(pairs.mapInArrow(_alike, "cid long, least long, alike double"))
    down = Window.partitionBy("key").orderBy(F.col("alike").desc(), "cid")
    cut = (F.coalesce(F.lag("alike").over(down), F.lit(1.0)) - F.col("alike") > GAP).cast("int")
    parts = stars.join(alike, ["cid", "least"]).withColumn("cut", cut).withColumn("part", F.sum("cut").over(down))
    centre = F.when(F.col("part") == 0, F.col("least")).otherwise(F.min("cid").over(Window.partitionBy("key", "part")))
    edges = materialize(parts.select(F.col("cid").alias("a"), centre.alias("b")).where("a <> b").distinct())
    release(stars, alike)
    return edges


def candidates(sigs: DataFrame) -> DataFrame:
    """sigs (cid, sig) to edges a, b whose connected components hold all candidates of each other."""
    rows = sigs.withColumn("mask", F.lit(-1).cast("long"))
    levels, small = [], []
    for depth in DEPTHS:
        size = F.coalesce(F.length("members") / 8, F.lit(1)).cast("long")
        nodes = rows.mapInArrow(_nodes(depth), "key long, tree int, first long, members binary")
        # sizes by a combining aggregate; the rows of a crowded node spread in the join, whose other side has one row a key
        shared = nodes.groupBy("key").agg(F.sum(size).alias("n"), F.min("first").alias("least")).where("n > 1")
        nodes = materialize(nodes.join(shared, "key").select("key", "tree", "first", "members", "n", "least"))
        levels.append(nodes)
        small.append(nodes.where(F.col("n") <= CROWDED).mapInArrow(_expand, MEMBERS))
        crowded = nodes.where(F.col("n") > CROWDED)
        if depth == DEPTHS[-1] or crowded.limit(1).count() == 0:
            break
        masks = crowded.mapInArrow(_expand, MEMBERS).groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("mask"))
        rows = sigs.join(masks, "cid")
    edges = [_cut_stars(reduce(DataFrame.union, small), sigs)]
    crowds = [t.where(F.col("n") > CROWDED).withColumn("level", F.lit(i)) for i, t in enumerate(levels)]
    star = lambda t: t.mapInArrow(_expand, MEMBERS).select(F.col("cid").alias("a"), F.col("least").alias("b")).where("a <> b")
    if len(levels) == len(DEPTHS):
        edges.append(star(crowds[-1].drop("level")))
    if len(levels) > 1:
        inside = [t.drop("level").mapInArrow(_expand, MEMBERS).withColumn("level", F.lit(i)) for i, t in enumerate(crowds)]
        nodes = reduce(DataFrame.union, inside).groupBy("cid").agg(F.collect_list(F.struct("n", "level", "tree", "key")).alias("nodes"))
        back = materialize(nodes.select("nodes").mapInArrow(_shorten(chances(), float(np.log(1 - RECALL))), "key long").distinct())
        taken = join_table(reduce(DataFrame.union, crowds).drop("level"), back, ["key"])
        edges.append(star(taken.select("key", "tree", "first", "members", "n", "least")))
        levels.append(back)
    out = materialize(reduce(DataFrame.union, edges).mapInArrow(_forest, "a long, b long").distinct())
    release(*levels, edges[0])
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch down to a spanning forest of it: each id with the least id of its set."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _with_least(edges: DataFrame, few: bool) -> DataFrame:
    """edges with m, the least b of each a; the centre of a large star may hold most of the edges."""
    return join_table(edges, edges.groupBy("a").agg(F.min("b").alias("m")), ["a"], known_small=few)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) to rows id, component (least id): large-star and small-star in turn until nothing changes."""
    edges = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct())
    n = edges.count()
    while True:
        few = 2 * n <= BROADCAST_ROWS  # no round has more ends than twice its edges; beyond that nothing goes to the driver
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, few).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a <> b").distinct()
        # now every edge points down; link all lower neighbours of a node, and the node, to the least of them
        low = _with_least(large, few)
        small = low.select("a", F.col("m").alias("b")).union(low.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small)
        before, n = n, small.count()
        same = n == before and small.join(edges, ["a", "b"], "left_anti").limit(1).count() == 0
        release(edges)
        edges = small
        if same:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch, "text", TEXT_BYTES):
            g, bounds, classes = ngrams(texts)
            held = [np.unique(g[a:b]).astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            size = [len(x) // 8 for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(held, pa.binary()), pa.array(size, pa.int64())], names=["class", "grams", "size"])


def link(sets: list[np.ndarray], left: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between sets: of every two where `left` holds for one and not for the other,
    or of any two if it holds for all. Returns each set's number of links and its root."""
    n = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if n else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(n), size)
    _, token = np.unique(flat, return_inverse=True)
    by = np.lexsort((owner, token))
    postings, begin = owner[by], np.searchsorted(token[by], np.arange(token.max(initial=-1) + 2))
    ends = np.concatenate([[0], np.cumsum(size)])
    every = bool(left.all())
    links, parent = np.zeros(n, dtype=np.int64), list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in range(n):
        mine = token[ends[i] : ends[i + 1]]
        a, b = begin[mine], begin[mine + 1]
        more = b - a > 1
        a, b = a[more], b[more]
        if not len(a):
            continue
        width = b - a
        at = np.repeat(a - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        common = np.bincount(postings[at], minlength=n)
        near = common >= threshold * (size[i] + size - common) - 1e-9
        near &= common > 0
        near[i] = False
        if not every:
            near &= left != left[i]
        others = np.flatnonzero(near)
        links[i] = len(others)
        ri = root(i)
        for j in others[others > i].tolist():
            rj = root(j)
            if ri != rj:
                parent[max(ri, rj)] = ri = min(ri, rj)
    return links, np.array([root(i) for i in range(n)], dtype=np.int64), size


def _verify(table: pa.Table) -> pa.Table:
    """One task: rows cid, grams, part (0 both sides, 1 left, 2 right)."""
    cid, part = table.column("cid").to_numpy(), table.column("part").to_numpy()
    sets = [np.frombuffer(x, dtype="<u8") for x in table.column("grams").to_pylist()]
    ids, links, to = [], [], []
    whole = part == 0
    for at in (np.flatnonzero(whole), np.flatnonzero(~whole)):
        # where a block has no members, the other's pairs are those of a task of its own
        if len(at) > 1 and (whole[at[0]] or len(set(part[at])) > 1):
            at = at[np.argsort(cid[at])]
            n, r, _ = link([sets[i] for i in at], np.ones(len(at), dtype=bool) if whole[at[0]] else part[at] == 1)
            some = np.flatnonzero((n > 0) | (r != np.arange(len(at))))
            ids.append(cid[at][some])
            links.append(n[some])
            to.append(cid[at][r[some]])
    put = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64())
    return pa.table({"cid": put(ids), "links": put(links), "to": put(to)})


def _tasks(groups: DataFrame) -> DataFrame:
    """Rows cid, task, part of candidate groups (cid, component, grams: the number of distinct n-grams).

    Small groups share tasks by hash. A large group's members are cut into blocks: by class of
    set size, and within one by hash. Two blocks meet in a task of their own unless all sets of
    one are too large for the other's. Sizes come from combining aggregates, so no task sees a
    whole large group.
    """
    sizes = materialize(groups.groupBy("component").agg(F.sum("grams").alias("all")))
    total = sizes.agg(F.sum(F.when(F.col("all") <= TASK_GRAMS, F.col("all")))).first()[0] or 0
    n = max(1, -(-total // TASK_GRAMS))
    rows = join_table(groups, sizes.where(F.col("all") > TASK_GRAMS), ["component"], "left")
    small = rows.where(F.col("all").isNull()).select("cid", F.pmod(F.xxhash64("component"), F.lit(n)).cast("string").alias("task"), F.lit(0).alias("part"))
    large = rows.where(F.col("all").isNotNull()).withColumn("size", F.floor(F.ln("grams") / F.lit(float(np.log(1.1)))).cast("int"))
    classes = materialize(large.groupBy("component", "size").agg(F.sum("grams").alias("sum"), F.min("grams").alias("least"), F.max("grams").alias("most")))
    classes = classes.withColumn("n", F.ceil(F.col("sum") / (TASK_GRAMS // 2)).cast("int"))
    large = join_table(large.select("cid", "component", "size"), classes.select("component", "size", "n"), ["component", "size"])
    large = large.withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("n")).cast("int"))
    edge = classes.select("component", "size", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub"), "least", "most")
    other = edge.select(F.col("component").alias("c2"), F.col("size").alias("size2"), F.col("sub").alias("sub2"), F.col("least").alias("least2"))
    before = F.struct("size", "sub") <= F.struct("size2", "sub2")
    meets = edge.join(other, (F.col("component") == F.col("c2")) & before & (F.col("least2") * THRESHOLD <= F.col("most")))
    name = F.concat_ws(":", "component", "size", "sub", "size2", "sub2")
    itself = (F.col("size") == F.col("size2")) & (F.col("sub") == F.col("sub2"))
    sides = meets.select("component", "size", "sub", name.alias("task"), F.when(itself, 0).otherwise(1).alias("part")).union(
        meets.where(~itself).select("component", F.col("size2").alias("size"), F.col("sub2").alias("sub"), name.alias("task"), F.lit(2).alias("part"))
    )
    return small.unionByName(large.join(sides, ["component", "size", "sub"]).select("cid", "task", "part"))


def near_links(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, class_id (least doc_id of its group of near and exact
    copies), text_id (least doc_id with the same words), n_links (other texts at the threshold)."""
    with scratch(documents.sparkSession) as keep:
        docs = pick(documents, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
        kind = documents.schema["doc_id"].dataType.simpleString()
        rows = materialize(docs.mapInArrow(_classes, f"doc_id {kind}, class binary, sig binary"))
        full = rows.groupBy("class").agg(F.min("doc_id").alias("text_id"), F.first("sig").alias("sig"))
        full = materialize(full.withColumn("cid", F.monotonically_increasing_id()))
        member = materialize(rows.select("doc_id", "class"))
        release(rows)
        texts = materialize(full.drop("sig"))
        edges = candidates(full.where(F.col("sig").isNotNull()).select("cid", "sig"))
        groups = components(edges).withColumnRenamed("id", "cid").join(texts, "cid")
        groups = materialize(groups)
        release(full, edges)
        # by hash, one number each: what else it reads again (all rows without doc_id, for a class without any) meets no class below
        wanted = groups.select(F.xxhash64("text_id").alias("wanted")).distinct()
        wanted = F.broadcast(wanted) if small(wanted, 4 * BROADCAST_ROWS) else wanted.hint("merge")
        again = docs.join(wanted, F.xxhash64(docs["doc_id"]) == F.col("wanted"), "left_semi").select("text")
        sets = again.mapInArrow(_sets, "class binary, grams binary, size long").groupBy("class").agg(F.first("grams").alias("grams"), F.first("size").alias("size"))
        sets = materialize(sets.join(groups.select("class", "cid", "component"), "class").select("cid", "component", "size", "grams"))
        tasks = _tasks(sets.select("cid", "component", F.col("size").alias("grams"))).join(sets.select("cid", "grams"), "cid")
        found = materialize(tasks.groupBy("task").applyInArrow(_verify, "cid long, links long, to long"))
        release(groups, sets)
        links = found.groupBy("cid").agg(F.sum("links").alias("n_links"))
        merged = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b"))).withColumnRenamed("id", "cid")
        merged = merged.join(texts.select("cid", "text_id"), "cid")
        least = merged.groupBy("component").agg(F.min("text_id").alias("class_id"))
        ids = join_table(merged.select("cid", "component"), materialize(least), ["component"]).select("cid", "class_id").join(links, "cid", "left")
        known = materialize(texts.select("cid", "class", "text_id").join(ids, "cid", "left").select("class", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
        release(texts, found)
        keep(member), keep(known)
    return member.join(known, "class").select("doc_id", "class_id", "text_id", "n_links")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return near_links(load(spark, sf_dir, "documents"))


SQL = r"""
with recursive t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
c as (select w, row_number() over () as cid, min(doc_id) as text_id from t group by w),
g as (select distinct cid, unnest(case when len(w) < 5 then case when len(w) = 0 then [] else [w] end else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as gram from c),
n as (select cid, count(*) as n from g group by cid),
p as (select a.cid as x, b.cid as y, count(*) as k from g a join g b on a.gram = b.gram and a.cid <> b.cid group by 1, 2),
l as (select x, y from p join n a on a.cid = x join n b on b.cid = y where 5 * k >= 4 * (a.n + b.n - k)),
reach as (select cid as x, cid as y from c union select reach.x, l.y from reach join l on reach.y = l.x),
m as (select x as cid, min(text_id) as class_id from reach join c on c.cid = reach.y group by x),
k as (select x as cid, count(*) as n_links from l group by x)
select t.doc_id, m.class_id, c.text_id, coalesce(k.n_links, 0) as n_links from t join c using (w) join m using (cid) left join k using (cid)
"""
