"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

Each source's weight is a piecewise linear function of training time. Its integral, scaled to the source's target, is
the source's cumulative demand of words; a document that begins at word x of its source's stream is trained at the time
where that demand reaches x. The stream of a source is its documents in the order of a hash of doc_id, as often as the
target asks for. Where a document begins needs a running sum within its source, which may hold a third of all rows: the
sum is taken over slots of the hash in two levels, so that no task ever holds more than a slot or a list of slots.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, n_words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEATS = 2
ROWS_PER_SLOT = 512
#: Weight over training time, relative to a source's mean weight, at equally spaced knots; by rank of the source, repeating.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))


def order_key(doc_id: Column) -> Column:
    """A hash of doc_id that other SQL engines have too: 32 hex digits, null first."""
    return F.coalesce(F.md5(doc_id.cast("string")), F.lit(""))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """source, source_size, source_rank, target of sizes(source, size).

    The weighted share is poured into the sources like water: sorted by the level at which each is full, sources are
    full up to the first whose level the rest of the share does not reach. It equals resharing the excess by weight
    until no target is above its limit. One row per source meets in one task, after the sums."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights)) + 1)
    per = per.withColumn("source_rank", rank).withColumn("weight", weight)
    per = per.withColumn("limit", F.col("source_size") * float(max_repeats))
    by_level = W.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    # The level is that of the first source that is not full; where all are full, none is.
    reached = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "source_rank", "level"))).over(every)
    target = F.least(F.col("limit"), F.coalesce(reached["level"] * F.col("weight"), F.col("limit")))
    return per.select("source", "source_size", "source_rank", F.greatest(target, F.lit(0.0)).alias("target"))


def with_start(rows: DataFrame, n_rows: int, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """rows(source, okey, doc_id, size) with start, the sizes of the rows before it in its source, in two levels of slots."""
    bits = max(0, math.ceil(math.log2(max(1, n_rows) / rows_per_slot)))
    fine = min(60, bits)
    coarse = fine // 2
    number = F.conv(F.substring(F.rpad("okey", 15, "0"), 1, 15), 16, 10).cast("long")  # 60 bits of the hash
    rows = rows.withColumn("slot", F.shiftright(number, 60 - fine) if fine else F.lit(0).cast("long"))
    slots = rows.groupBy("source", "slot").agg(F.sum("size").alias("n"))
    slots = slots.withColumn("block", F.shiftright("slot", fine - coarse))
    blocks = slots.groupBy("source", "block").agg(F.sum("n").alias("n"))
    earlier = lambda *by: W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(earlier("source", "block")), F.lit(0)).alias("at"))
    slots = slots.withColumn("within", F.coalesce(F.sum("n").over(earlier("source", "block", "slot")), F.lit(0)))
    slots = slots.join(blocks.withColumnRenamed("source", "s2").withColumnRenamed("block", "b2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    slots = slots.select(F.col("source").alias("s2"), F.col("slot").alias("t2"), (F.col("at") + F.col("within")).alias("slot_start"))
    last = W.partitionBy("source", "slot").orderBy("okey", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(last.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(slots, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slot") == F.col("t2")))
    return rows.withColumn("start", F.col("slot_start") + F.col("before")).drop("s2", "t2", "slot_start", "before", "slot")


def time_of(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The training time (0 to 1) at which a source of that rank has met this share of its demand: the inverse of the
    integral of its schedule, in closed form on each linear piece."""

    def inverse(knots) -> Column:
        step, done, pieces = 1.0 / (len(knots) - 1), 0.0, []
        total = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False))
        for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            a, b, area = a / total, b / total, (a + b) / 2 * step / total
            u = F.greatest(share - F.lit(done), F.lit(0.0))
            # a x + (b - a) x^2 / (2 step) = u, in the form without cancellation
            x = F.lit(2.0) * u / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * (b - a) / step) * u, F.lit(0.0))))
            pieces.append((done + area, F.when(u <= 0, F.lit(i * step)).otherwise(F.lit(i * step) + F.least(x, F.lit(step)))))
            done += area
        out = pieces[-1][1]
        for end, at in reversed(pieces[:-1]):
            out = F.when(share < F.lit(end), at).otherwise(out)
        return out

    out = inverse(schedules[-1])
    for i in reversed(range(len(schedules) - 1)):
        out = F.when(rank % len(schedules) == i, inverse(schedules[i])).otherwise(out)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats, position, positions, sorted by position: a row per row of docs(doc_id, text, source, ...).

    taken: words of the document that the mix takes, all passes together; the pass that reaches the target ends there,
    so a source's taken words sum to its target, rounded. repeats: passes of which at least half of the words are taken.
    position: the training time of its first word; null where none is taken. positions: of each pass, the training time of its
    first word; null where the pass takes none. Null and empty texts have size 0 and take
    nothing; null is a source of its own, the last; rows with the same doc_id are rows of their own. Without any word
    all targets are 0; an empty table gives no rows. Other columns are ignored."""
    rows = docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), order_key(docs["doc_id"]).alias("okey"))
    rows = cut(rows, "mix-sizes")
    targets = source_targets(rows, weights, share, max_repeats)
    rows = with_start(rows, rows.count(), rows_per_slot)
    targets = targets.withColumnRenamed("source", "s2")
    # One row per source; Spark broadcasts it only if its size, known by then, allows.
    rows = rows.join(targets, F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    goal = F.round("target").cast("long")
    passes = [F.greatest(F.lit(0).cast("long"), F.least("size", goal - F.col("source_size") * p - F.col("start"))) for p in range(math.ceil(max_repeats))]
    half = [F.when((x > 0) & (x * 2 >= F.col("size")), 1).otherwise(0) for x in passes]
    rows = rows.withColumn("taken", sum(passes[1:], passes[0])).withColumn("repeats", sum(half[1:], half[0]))
    at = lambda p: time_of((F.col("start") + F.col("source_size") * p) / F.col("target"), F.col("source_rank"), schedules)
    rows = rows.withColumn("positions", F.array(*[F.when(x > 0, at(p)) for p, x in enumerate(passes)])).withColumn("position", F.col("positions")[0])
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "repeats", "position", "positions").orderBy("position", "doc_id")


#: Parts in which the rows that share doc_id, source and size are numbered.
SALTS = 64


def _numbered(rows: DataFrame, key: list[str], salt: Column, order: Column) -> DataFrame:
    """rows with _nth, their number from 1 among those of a key, null or not: in parts by salt, each after the parts before it."""
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    parts = rows.groupBy(*key, "_salt").agg(F.count("*").alias("_many"))
    begins = F.coalesce(F.sum("_many").over(W.partitionBy(*key).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*[F.col(c).alias(f"_of{c}") for c in [*key, "_salt"]], begins.alias("_begin"))
    rows = rows.withColumn("_within", F.row_number().over(W.partitionBy(*key, "_salt").orderBy(order)))
    same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in [*key, "_salt"]]
    return rows.join(parts, reduce(Column.__and__, same)).withColumn("_nth", F.col("_begin") + F.col("_within")).drop("_salt", "_within", "_begin", *[f"_of{c}" for c in [*key, "_salt"]])


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them, in the order of training: documents with repeats 0 go, others are there that many times, whole,
    each pass at its own position. Rows that share doc_id, source and size, null or not, each have a plan of their own: which has which is left open."""
    key = ["_id", "_source", "_size"]
    plans = mix(docs, **how).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.struct("repeats", "positions").alias("_plan"))
    plans = cut(plans, "mix-plans")
    groups = cut(plans.groupBy(*key).agg(F.count("*").alias("_rows"), F.max("_plan").alias("_plan")), "mix-groups")
    # A row's own columns travel as one, so that names cannot clash.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), n_words(docs["text"]).alias("_n"))
    same = F.col("_row.doc_id").eqNullSafe(F.col("_id")) & F.col("_row.source").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    out = rows.join(groups.filter("_rows = 1 and _plan.repeats > 0"), same).select("_row", "_plan")
    shared = groups.filter("_rows > 1").select(*key)
    if not shared.isEmpty():
        together = [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in key]
        mine = shared.toDF(*[f"_g{c}" for c in key])
        one = _numbered(plans.join(mine, reduce(Column.__and__, together), "left_semi"), key, F.xxhash64("_plan.positions"), F.col("_plan"))
        two = rows.join(shared, same).select("_row", *key)
        two = _numbered(two, key, F.xxhash64("_row.text"), F.xxhash64("_row.text"))
        met = [F.col(c).eqNullSafe(F.col(f"_p{c}")) for c in [*key, "_nth"]]
        one = one.filter("_plan.repeats > 0").select(*[F.col(c).alias(f"_p{c}") for c in [*key, "_nth"]], "_plan")
        out = out.unionByName(two.join(one, reduce(Column.__and__, met)).select("_row", "_plan"))
    out = out.select("_row", F.explode(F.slice("_plan.positions", F.lit(1), F.col("_plan.repeats"))).alias("_at"))
    return out.orderBy("_at", "_row.doc_id").select("_row.*")
