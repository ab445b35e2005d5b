"""Hard negatives of anchors, by partial inner products in an orthogonal PCA rotation.

Vectors are whole numbers, floor(scale * component), and scores are their inner products. Rotated to the principal directions of all vectors, the
product over a few leading directions is most of a score, and the norms of what is left bound the rest. A task holds a block of anchors and streams
blocks of rows past it, with the best scores of each anchor so far. It sums leading products, discards every pair whose bound cannot reach
them, sums the next directions of the pairs left, and computes the scores of what survives all in whole numbers. The rotation serves
pruning alone; bounds leave room for rounding, so no result depends on it.

Positives come first. Then, for each anchor and positive, negatives with a score in a share of the positive's: a pair is also discarded
when its bound from below lies above every window of its anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release

#: Anchors and rows of a block, and blocks of rows that one task sees at most with a block of anchors.
ANCHORS, ROWS, STREAM = 65_536, 8_192, 128
#: Rows that the rotation is computed from, those of the smallest hash. It bounds what the driver reads.
SAMPLE = 4_096
#: Leading directions of each step, as shares of all.
STEPS = (0.25, 0.5, 0.75)
#: Pairs of a product of matrices.
PAIRS = 1 << 20
#: Scores of 2**62 or more would not leave room in 64 bits.
TOP = 1 << 62
_LOW = np.iinfo(np.int64).min

BLOCK = "vectors binary, labels binary, ids binary"
KEY = "slot int, part int"


def usable(vectors: DataFrame) -> Column:
    """Rows that take part: with an id, a label, and a vector of finite components, at least one."""
    v = vectors["embedding"]
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors["vec_id"].isNotNull() & vectors["label"].isNotNull() & v.isNotNull() & finite


def _matrix(lists: pa.Array, width: int, scale: float) -> np.ndarray:
    """Whole components; shorter vectors end in zeros."""
    lists = lists.cast(pa.list_(pa.float64()))
    n, sizes = len(lists), np.diff(lists.offsets.to_numpy())
    out = np.zeros((n, width))
    out[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    return out.astype(np.int32)


def blocks(rows: DataFrame, width: int, scale: float, most: int, streams: int | None = None) -> DataFrame:
    """rows(vec_id, label, embedding) packed: slot (the stream, or the partition where streams is None), part, and the columns of BLOCK, of at most `most` rows each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, n, k = TaskContext.get().partitionId(), [], 0, 0

        def block(ids, labels, m):
            slot = (task * 7_919 + k) % streams if streams else task
            cols = [pa.array([slot], pa.int32()), pa.array([k], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (m, labels, ids)]
            return pa.RecordBatch.from_arrays(cols, ["slot", "part", "vectors", "labels", "ids"])

        def joined():
            return [np.concatenate([h[c] for h in held]) for c in range(3)]

        for b in batches:
            held.append((b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(2), width, scale)))
            n += b.num_rows
            while n >= most:
                ids, labels, m = joined()
                yield block(ids[:most], labels[:most], m[:most])
                held, n, k = [(ids[most:], labels[most:], m[most:])], n - most, k + 1
        if n:
            yield block(*joined())

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(pack, f"{KEY}, {BLOCK}")


def directions(sample: np.ndarray, width: int) -> np.ndarray:
    """(width, width), orthogonal: the directions of the greatest mean square first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(width)


class Rotated:
    """A block: whole vectors, and their rotation with the norms of what is left after each step."""

    def __init__(self, vectors: bytes, labels: bytes, ids: bytes, axes: np.ndarray) -> None:
        self.whole = np.frombuffer(vectors, np.int32).reshape(-1, len(axes)).astype(np.int64)
        self.labels, self.ids = np.frombuffer(labels, np.int64), np.frombuffer(ids, np.int64)
        self.turned = self.whole.astype(np.float64) @ axes
        squares = np.cumsum(self.turned[:, ::-1] ** 2, 1)[:, ::-1]
        at = steps_of(len(axes))
        self.rest = [np.sqrt(squares[:, k]) if k < len(axes) else np.zeros(len(squares)) for k in at]
        #: Rounding moves a sum of products by less than 1e-12 of the product of the norms (some width * 2**-53 of it); the root is kept, as norms are multiplied.
        self.slack = 1e-6 * np.sqrt(squares[:, 0] if len(axes) else np.zeros(len(squares)))


def steps_of(width: int) -> list[int]:
    return sorted({max(1, min(width, round(width * s))) for s in STEPS} | {width})


def near_pairs(a: Rotated, rows: Rotated, at: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of every pair of anchors `at` and rows `of` with low[anchor] <= score <= high[anchor], and no other pair of a score outside."""
    at_steps = steps_of(a.whole.shape[1])
    first = at_steps[0]
    tall = max(1, PAIRS // max(1, len(of)))
    right, right_rest, right_slack = rows.turned[of, :first].T, rows.rest[0][of], rows.slack[of]
    for begin in range(0, len(at), tall):
        some = at[begin : begin + tall]
        partial = a.turned[some, :first] @ right
        room = a.rest[0][some][:, None] * right_rest + a.slack[some][:, None] * right_slack
        i, j = np.nonzero((partial + room >= low[some][:, None]) & (partial - room <= high[some][:, None]))
        sums = partial[i, j]
        i, j = some[i], of[j]
        for k, (begun, end) in enumerate(zip(at_steps, at_steps[1:], strict=False), 1):
            for piece in _pieces(len(i), PAIRS // max(1, end - begun)):
                sums[piece] += np.einsum("ij,ij->i", a.turned[i[piece], begun:end], rows.turned[j[piece], begun:end])
            room = a.rest[k][i] * rows.rest[k][j] + a.slack[i] * rows.slack[j]
            keep = (sums + room >= low[i]) & (sums - room <= high[i])
            i, j, sums = i[keep], j[keep], sums[keep]
        for piece in _pieces(len(i), PAIRS // max(1, a.whole.shape[1])):
            score = np.einsum("ij,ij->i", a.whole[i[piece]], rows.whole[j[piece]])
            keep = (score >= low[i[piece]]) & (score <= high[i[piece]])
            yield i[piece][keep], j[piece][keep], score[keep]


def _pieces(n: int, most: int) -> Iterator[slice]:
    most = max(1, most)
    for k in range(0, n, most):
        yield slice(k, min(n, k + most))


class Best:
    """The k best (score, then smaller id) of each of n keys."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.keys, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        #: The score that a newcomer has to reach.
        self.bar = np.full(n, _LOW)

    def add(self, keys: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        keys, scores, ids = (np.concatenate(x) for x in ((self.keys, keys), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, keys))
        keys, scores, ids = keys[order], scores[order], ids[order]
        begin = np.flatnonzero(np.diff(keys, prepend=-1))
        rank = np.arange(len(keys)) - np.repeat(begin, np.diff(begin, append=len(keys)))
        last = rank == self.k - 1
        self.bar[keys[last]] = scores[last]
        keep = rank < self.k
        self.keys, self.scores, self.ids = keys[keep], scores[keep], ids[keep]


def _by_label(labels: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(labels, kind="stable")
    names, begin = np.unique(labels[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, begin[1:]), strict=True)) if len(names) else {}


class Positives:
    """The best rows of the anchors' own labels, over the blocks of a stream."""

    def __init__(self, a: Rotated, k: int) -> None:
        self.a, self.best, self.groups = a, Best(len(a.ids), k), _by_label(a.labels)
        self.high = np.full(len(a.ids), np.iinfo(np.int64).max)

    def see(self, rows: Rotated) -> None:
        of = _by_label(rows.labels)
        for label, at in self.groups.items():
            every = of.get(label, np.zeros(0, np.int64))
            for some in (every[:64], every[64:]):  # the first few set the bars for the others
                for i, j, score in near_pairs(self.a, rows, at, some, self.best.bar, self.high):
                    other = self.a.ids[i] != rows.ids[j]
                    self.best.add(i[other], score[other], rows.ids[j[other]])

    def found(self) -> list[np.ndarray]:
        return [self.best.keys, self.best.ids, self.best.scores]


class Negatives:
    """The best rows of other labels in the window of each positive, over the blocks of a stream."""

    def __init__(self, a: Rotated, k: int, of: np.ndarray, rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        order = np.lexsort((rank, of))
        self.a, self.of, self.rank, self.low, self.high = a, of[order], rank[order], low[order], high[order]
        self.best = Best(len(of), k)
        self.begin = np.searchsorted(self.of, np.arange(len(a.ids) + 1))
        self.groups = _by_label(a.labels)

    def see(self, rows: Rotated) -> None:
        for label, at in self.groups.items():
            every = np.flatnonzero(rows.labels != label)
            for some in (every[:64], every[64:]):
                low, high = np.full(len(self.a.ids), np.iinfo(np.int64).max), np.full(len(self.a.ids), _LOW)
                np.minimum.at(low, self.of, np.maximum(self.low, self.best.bar))
                np.maximum.at(high, self.of, self.high)
                for i, j, score in near_pairs(self.a, rows, at[low[at] <= high[at]], some, low, high):
                    many = self.begin[i + 1] - self.begin[i]
                    pair = np.repeat(np.arange(len(i)), many)
                    window = self.begin[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
                    fits = (score[pair] >= np.maximum(self.low, self.best.bar)[window]) & (score[pair] <= self.high[window])
                    pair, window = pair[fits], window[fits]
                    self.best.add(window, score[pair], rows.ids[j[pair]])

    def found(self) -> list[np.ndarray]:
        w = self.best.keys
        return [self.of[w], self.best.ids, self.best.scores, self.rank[w]]


def _search(anchors: DataFrame, rows: DataFrame, streams: int, slots: int, axes: np.ndarray, start, names: str) -> DataFrame:
    """Each block of anchors with each stream of blocks of rows: what start(block of anchors, its row) finds after seeing the stream.

    A block of anchors goes to every stream, a block of rows to every slot of anchors; where they meet, the anchors come first."""
    fields = [f.split()[0] for f in names.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, []

        def out():
            for slot, part, search in open_:
                cols = search.found()
                key = [pa.array(np.full(len(cols[0]), x), pa.int32()) for x in (slot, part)]
                yield pa.RecordBatch.from_arrays(key + [pa.array(c, pa.int64()) for c in cols], ["slot", "part", *fields])

        for b in batches:
            for k in range(b.num_rows):
                row = {name: b.column(name)[k].as_py() for name in b.schema.names}
                if now != (now := (row["stream"], row["slot"])):
                    yield from out()
                    open_ = []
                block = Rotated(row["vectors"], row["labels"], row["ids"], axes)
                if row["is_anchors"]:
                    open_.append((row["slot"], row["part"], start(block, row)))
                else:
                    for _, _, search in open_:
                        search.see(block)
        yield from out()

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"stream": every(streams), "is_anchors": F.lit(True)})
    right = rows.select(F.col("slot").alias("stream"), F.lit(0).alias("part"), "vectors", "labels", "ids", F.lit(False).alias("is_anchors")).withColumn("slot", every(slots))
    met = left.unionByName(right, allowMissingColumns=True).repartition("stream", "slot").sortWithinPartitions("stream", "slot", F.desc("is_anchors"))
    return met.mapInArrow(run, f"{KEY}, " + ", ".join(f"{f} bigint" for f in fields))


def hard_negatives(
    vectors: DataFrame, anchor_every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, anchors_block: int = ANCHORS, rows_block: int = ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(vec_id, embedding, label, ...).

    Anchors are the rows whose vec_id is divisible by anchor_every. An anchor's positives are the n_positives rows of its label with the best scores,
    ties by smaller vec_id; its negatives to a positive the n_negatives best rows of other labels whose score is low to high percent of the
    positive's. Fewer where there are no more; no row where there is none, so a positive score below 0 has none.

    Rows with a null vec_id or label, a null vector, or a null or non-finite component take no part. Vectors may differ in length: missing components
    are 0; an empty one scores 0. Rows that repeat a vec_id are rows of their own, but no positives of each other; where an anchor is repeated, so are its
    rows. An empty table gives none; other columns are not read. Scores must fit 62 bits: larger components are an error before the search."""
    spark = vectors.sparkSession
    good = vectors.filter(usable(vectors)).select("vec_id", "label", "embedding")
    size, largest = F.size("embedding"), F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    n, width, most = good.agg(F.count("*"), F.max(size), F.max(largest)).first()
    width, whole = max(1, width or 1), float(most or 0) * scale + 1
    if whole >= 1 << 31 or whole * whole * width >= TOP:
        raise ValueError("scores do not fit 62 bits")
    few = good.orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    few = few.chunk(0) if isinstance(few, pa.ChunkedArray) else few
    axes = directions(_matrix(few, width, scale).astype(np.float64), width)

    cores = spark.sparkContext.defaultParallelism
    per_block = max(64, min(rows_block, n // (8 * cores)))
    streams = max(1, min(4 * cores, n // per_block), -(-n // (per_block * STREAM)))
    is_anchor = F.col("vec_id") % anchor_every == 0
    rows = cut(blocks(good, width, scale, per_block, streams), "negative_rows")
    groups = max(1, -(-good.filter(is_anchor).count() // anchors_block))
    anchors = cut(blocks(good.filter(is_anchor).repartition(groups, "vec_id"), width, scale, anchors_block), "negative_anchors")

    best = lambda df, key, k: df.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
    key = ["slot", "part", "anchor"]
    found = _search(anchors, rows, streams, groups, axes, lambda a, _: Positives(a, n_positives), "anchor bigint, id bigint, score bigint")
    positives = cut(best(found, key, n_positives), "positives")

    def windows(a: Rotated, row: dict) -> Negatives:
        of, rank, score = (np.array([w[c] for w in row["windows"]], np.int64) for c in ("anchor", "rank", "score"))
        return Negatives(a, n_negatives, of, rank, -(-low * score // 100), high * score // 100)

    held = positives.groupBy("slot", "part").agg(F.collect_list(F.struct("anchor", "rank", "score")).alias("windows"))  # of one block of anchors: bounded
    found = _search(anchors.join(held.hint("merge"), ["slot", "part"]), rows, streams, groups, axes, windows, "anchor bigint, id bigint, score bigint, positive bigint")
    negatives = cut(best(found, [*key, "positive"], n_negatives), "negatives").select(*key, F.col("positive").alias("to"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("slot", "part", "ids").mapInArrow(_ids, f"{KEY}, anchor bigint, anchor_id bigint")
    named = positives.select(*key, F.col("rank").alias("to"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, key)
    out = cut(named.join(negatives, [*key, "to"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard_negatives")
    release(rows, anchors, positives)
    return out


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for slot, part, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), slot), pa.int32()), pa.array(np.full(len(x), part), pa.int32()), pa.array(np.arange(len(x))), pa.array(x)], ["slot", "part", "anchor", "anchor_id"])
