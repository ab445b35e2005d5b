"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors with cosine c or more are at most epsilon = sqrt(2 - 2 c) apart. Vectors are rotated to their principal
dimensions, laid on a grid of width epsilon in the leading ones, and sorted by label and grid cell. The sorted sequence
is cut into intervals, and FANOUT of these that follow each other are an interval of the next level, up to one or two for each
label. The join starts there: pairs whose boxes are within epsilon are replaced by pairs of their parts, level by level, and others
are skipped. Pairs of the lowest level are joined in tasks: the join halves them again and again, skips halves that are
provably apart, and compares what is left by a product of matrices. The rotation comes from a bounded sample and serves pruning
alone: no link depends on it.

Equal vectors of a label are one class, found by grouping. For each pair of intervals a task returns sums and the
smallest class of each local component: no more rows than it read, however many links it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release
from .graph import components

COSINE = 0.98
LEADING = 8
INTERVAL = 1024
FANOUT = 16
LEAF = 128
#: Vectors that the rotation is computed from, those of the smallest hash. It bounds what the driver reads.
SAMPLE = 4096
#: Room for rounding when boxes are compared.
MARGIN = 1e-6


def _usable(v) -> F.Column:
    """Not null, and every component a finite number, not all of them zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def rotation(vectors: np.ndarray, leading: int) -> np.ndarray:
    """(dimensions, leading): the principal directions of unit vectors, those of most variance first."""
    centred = vectors - vectors.mean(0)
    return np.linalg.svd(centred, full_matrices=True)[2][:leading].T if len(vectors) else np.zeros((vectors.shape[1], 0))


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.astype(np.float64).reshape(-1, dim)
    m = m / np.abs(m).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _components(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and column of a bipartite graph reaches; a, b: their ids."""
    top = np.iinfo(np.int64).max
    while True:
        b2 = np.minimum(b, np.where(mask, a[:, None], top).min(0, initial=top))
        a2 = np.minimum(a, np.where(mask, b2[None, :], top).min(1, initial=top))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def join_intervals(a: tuple, b: tuple, cosine: float, same: bool, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, ...]]:
    """Links of two intervals (ids, counts, unit vectors, rotated vectors): arrays of id, linked vectors, smallest id met.

    same: b is a, and each pair is to be met once."""
    epsilon = np.sqrt(max(0.0, 2 - 2 * cosine)) + MARGIN
    work = [(0, len(a[0]), 0, len(b[0]))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 == a1 or b0 == b1 or same and b1 <= a0:
            continue
        x, y = a[3][a0:a1], b[3][b0:b1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > epsilon * epsilon:
            continue
        if max(a1 - a0, b1 - b0) > leaf:
            am, bm = ((a0 + a1) // 2, (b0 + b1) // 2)
            parts_a = [(a0, am), (am, a1)] if a1 - a0 > leaf else [(a0, a1)]
            parts_b = [(b0, bm), (bm, b1)] if b1 - b0 > leaf else [(b0, b1)]
            work += [(*p, *q) for p in parts_a for q in parts_b]
            continue
        mask = a[2][a0:a1] @ b[2][b0:b1].T >= cosine
        if same:
            mask &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
        if not mask.any():
            continue
        rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        mask = mask[np.ix_(rows, cols)]
        ra, rb = a0 + rows, b0 + cols
        ca, cb = _components(mask, a[0][ra], b[0][rb])
        yield a[0][ra], mask @ b[1][rb], ca
        yield b[0][rb], a[1][ra] @ mask, cb


def intervals(reps: DataFrame, cosine: float, leading: int = LEADING, size: int = INTERVAL, sample: int = SAMPLE) -> DataFrame:
    """Rows of the sorted sequence of reps(class_no, n, label, dim, embedding), cut: a row per interval, vectors packed. task, place:
    where it is in the sequence."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    picked = reps.select("dim", "embedding", "class_no").orderBy(F.xxhash64("embedding"), "class_no").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in picked:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    turns = {d: rotation(_unit(np.array(v, np.float64), d), leading) for d, v in by_dim.items()}
    names = [f"g{i}" for i in range(leading)]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, vectors = b.column(3).to_numpy(zero_copy_only=False), b.column(4)
            cells = np.zeros((b.num_rows, leading), np.int64)
            for d in np.unique(dims):
                rows = np.flatnonzero(dims == d)
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                turn = turns.get(int(d), np.zeros((int(d), 0)))
                rotated = _unit(flat, int(d)) @ turn
                cells[rows, : rotated.shape[1]] = np.floor(rotated / max(epsilon, 1e-9))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(cells[:, i]) for i in range(leading))], names=[*b.schema.names, *names])

    kind = reps.schema["label"].dataType.simpleString()
    columns = f"class_no long, n long, label {kind}, dim int, embedding array<double>"
    laid = reps.select("class_no", "n", "label", "dim", F.col("embedding").cast("array<double>").alias("embedding"))
    laid = laid.mapInArrow(lay, columns + "".join(f", {c} long" for c in names))
    order = ["label", "dim", *names, "class_no"]
    ordered = cut(laid, "laid").repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        out_names = ["task", "place", "label", "dim", "low", "high", "ids", "counts", "vectors"]
        for b in batches:
            dims = b.column(3).to_numpy(zero_copy_only=False)
            labels = np.array(b.column(2).to_pylist(), object)
            turn = np.flatnonzero((labels[1:] != labels[:-1]) | (dims[1:] != dims[:-1])) + 1
            for first, last in zip([0, *turn], [*turn, b.num_rows], strict=True):
                for at in range(first, last, size):
                    part = b.slice(at, min(size, last - at))
                    d = int(dims[at])
                    flat = part.column(4).flatten().to_numpy(zero_copy_only=False)
                    turned = _unit(flat, d) @ turns.get(d, np.zeros((d, 0)))
                    low, high = np.zeros(leading), np.zeros(leading)
                    low[: turned.shape[1]], high[: turned.shape[1]] = turned.min(0), turned.max(0)
                    packed = [c.to_numpy(zero_copy_only=False).astype("<i8").tobytes() for c in (part.column(0), part.column(1))]
                    row = [[task], [k], [labels[at]], [d], [low.tolist()], [high.tolist()], [packed[0]], [packed[1]], [flat.astype("<f8").tobytes()]]
                    kinds = [pa.int32(), pa.int64(), b.schema.field("label").type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
                    k += 1
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=out_names)

    return ordered.mapInArrow(pack, f"task int, place long, label {kind}, dim int, low array<double>, high array<double>, ids binary, counts binary, vectors binary"), turns


def numbered(blocks: DataFrame) -> DataFrame:
    """blocks with interval, their places in the sequence from 0: those of their tasks begin after all of the tasks before, a row each."""
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    begins = blocks.groupBy("task").agg(F.count("*").alias("n")).select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    return blocks.join(begins, "task").withColumn("interval", F.col("begin") + F.col("place")).drop("begin", "task", "place")


def near_pairs(blocks: DataFrame, cosine: float, leading: int = LEADING, fanout: int = FANOUT) -> DataFrame:
    """a, b: of blocks(interval, label, dim, low, high), those of one label whose boxes are within epsilon, each pair once, found from
    the top of the levels down. A pair of a level becomes fanout**2 pairs of the next at most, of which near ones stay."""
    epsilon = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + MARGIN
    sides = [f"{s}{i}" for s in ("l", "h") for i in range(leading)]
    boxes = blocks.select("interval", "label", "dim", *[F.col("low")[i].alias(f"l{i}") for i in range(leading)], *[F.col("high")[i].alias(f"h{i}") for i in range(leading)])
    levels, most = [cut(boxes, "boxes")], blocks.agg(F.max("interval")).first()[0]
    while most:
        most //= fanout
        ends = [(F.min if c[0] == "l" else F.max)(c).alias(c) for c in sides]
        up = levels[-1].groupBy((F.col("interval") / fanout).cast("long").alias("interval"), "label", "dim").agg(*ends)
        levels.append(cut(up, "boxes"))
    gap = " + ".join(f"pow(greatest(0D, a_l{i} - b_h{i}, b_l{i} - a_h{i}), 2)" for i in range(leading))
    near = f"a_interval <= b_interval and {gap} <= {epsilon * epsilon!r}"
    pairs = None
    for level in reversed(levels):
        level = level.withColumn("parent", (F.col("interval") / fanout).cast("long"))
        one, two = (level.select(*[F.col(c).alias(f"{x}_{c}") for c in ("interval", "label", "dim", "parent", *sides)]) for x in "ab")
        two = two.withColumnsRenamed({"b_label": "a_label", "b_dim": "a_dim"})
        if pairs is None:  # the top: an interval of each label
            found = one.join(two, ["a_label", "a_dim"])
        else:
            above = pairs.select(F.col("label").alias("a_label"), F.col("dim").alias("a_dim"), F.col("a").alias("a_parent"), F.col("b").alias("b_parent"))
            found = one.join(above, ["a_label", "a_dim", "a_parent"]).join(two, ["a_label", "a_dim", "b_parent"])
        pairs = cut(found.filter(near).select(F.col("a_label").alias("label"), F.col("a_dim").alias("dim"), F.col("a_interval").alias("a"), F.col("b_interval").alias("b")), "near")
    release(*levels)
    return pairs.select("a", "b")


def near_duplicates(rows: DataFrame, cosine: float = COSINE, leading: int = LEADING, interval: int = INTERVAL, fanout: int = FANOUT) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of rows(vec_id, embedding, label, ...).

    Vectors are compared if their labels and numbers of components are equal. Vectors that are null, empty or zero, that
    hold null or non-finite components, or whose label is null link with nothing. Rows that repeat a vec_id are vectors of
    their own, linked if their embeddings are; their component is shared. A null vec_id is compared like others and takes
    part as the smallest id, null in the result. An empty table gives no rows; other columns are ignored."""
    least = -(1 << 63)
    rows = rows.select(F.coalesce(rows["vec_id"].cast("long"), F.lit(least)).alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(_usable(F.col("embedding")) & F.col("label").isNotNull(), F.col("embedding")))
    usable = rows.filter("embedding is not null")
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
    classes = cut(classes.withColumns({"dim": F.size("embedding"), "class_no": F.monotonically_increasing_id()}), "vectors")
    blocks, turns = intervals(classes, cosine, leading, interval)
    packed = cut(blocks, "packed")
    blocks = cut(numbered(packed), "intervals")
    release(packed)
    side = lambda x: blocks.select(F.col("interval").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("ids", "counts", "vectors")], *([F.col("dim")] if x == "a" else []))
    # Pairs of intervals are dealt evenly: one is as much work as another at most.
    pairs = near_pairs(blocks, cosine, leading, fanout).join(side("b"), "b").join(side("a"), "a")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                read = []
                for x in ("a", "b"):
                    unit = _unit(np.frombuffer(r[f"{x}_vectors"], "<f8"), r["dim"])
                    turn = turns.get(r["dim"], np.zeros((r["dim"], 0)))
                    read.append((np.frombuffer(r[f"{x}_ids"], "<i8"), np.frombuffer(r[f"{x}_counts"], "<i8"), unit, unit @ turn))
                for found in join_intervals(read[0], read[1], cosine, r["a"] == r["b"]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["class_no", "links", "least"])

    found = cut(pairs.mapInArrow(compare, "class_no long, links long, least long"), "found")
    # A vec_id that is repeated with other embeddings joins their classes.
    ids = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    again = rows.join(ids, "vec_id", "left_semi").join(classes.select("label", "embedding", "class_no"), ["label", "embedding"]).select("vec_id", "class_no")
    again = again.join(again.groupBy("vec_id").agg(F.min("class_no").alias("u")), "vec_id").select("u", F.col("class_no").alias("v"))
    labels = components(found.select(F.col("class_no").alias("u"), F.col("least").alias("v")).unionByName(again))
    links = found.groupBy("class_no").agg(F.sum("links").alias("links"))
    about = classes.join(links, "class_no", "left").join(labels.withColumnRenamed("node", "class_no"), "class_no", "left")
    about = cut(about.select("label", "embedding", "class_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_no").alias("component")), "about")
    smallest = about.groupBy("component").agg(F.min("class_id").alias("component_id"))
    about = about.join(smallest, "component").select("label", "embedding", "n_links", "component_id")
    out = rows.join(about, ["label", "embedding"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    # What a row that links with nothing shares with another of its vec_id.
    shared = out.join(ids, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("component_id").alias("_least"))
    out = out.join(shared, "vec_id", "left").select("vec_id", "n_links", F.coalesce("_least", "component_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    return out.withColumns({c: F.when(F.col(c) != least, F.col(c)) for c in ("vec_id", "component_id")})
