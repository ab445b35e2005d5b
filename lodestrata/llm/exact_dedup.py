"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only.

The key of a text is a 64-bit hash of its normalised form; a bucket of the index holds the keys with one prefix. The directory is
grown from the counts of keys: while a bucket is over its capacity, its prefix grows, at any depth, until it fits or holds one
key alone. Every row finds its bucket through the directory, and the bucket's owner task brings it together with the entry of
its key:

1. a first pass over the texts leaves a narrow row of each (doc_id, key, digest), from which a bucket's owner counts its keys;
2. a key that one row has needs no comparison: its text is not shuffled, unless the table of the other keys is too large to
   broadcast;
3. texts of other keys go to the owners of their buckets, equal ones of a task combined first, so a text that a third of all
   rows hold is a few rows there. The owner compares their bytes: each different text is a link of its key's chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, cut, few, release, text_of

BUCKET_CAPACITY = 65_536
#: Bits by which a bucket grows in one pass over its keys; within it, the shortest prefix that fits is chosen.
STEP = 10
KEY_BITS = 64
#: Rows of one text and bucket go to its owner in so many parts at most, each combined from many rows.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, SPACE, " ")


def prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS - bits) if bits else F.lit(0).cast("long")


@dataclass
class Index:
    """directory: (depth, prefix), a row per bucket: no prefix begins another, and each key has one.
    entries: (depth, prefix, key, chain_pos, chain_len, keep_id, group_size, text_sha256), a row per different text, sorted by bucket.
    chained: (depth, prefix, key, norm, text_sha256, keep_id, group_size), the links of chains of several texts, with their texts."""

    directory: DataFrame
    entries: DataFrame
    chained: DataFrame


def directory_of(keys: DataFrame, capacity: int = BUCKET_CAPACITY, step: int = STEP) -> DataFrame:
    """depth, prefix: the buckets of keys(key), different ones.

    Each pass counts the keys below the buckets that are still overfull, by step more bits; a slot of these is in the bucket of the
    shortest prefix that holds no more than capacity keys. Slots that are overfull themselves go into the next pass, unless all
    bits are used. A bucket has 2**step slots at most, so no task gets more of one bucket, whatever the number of keys."""
    found, overfull, depth = None, None, 0
    while depth < KEY_BITS:
        bits = min(step, KEY_BITS - depth)
        some = keys if overfull is None else keys.join(overfull, prefix(F.col("key"), depth) == F.col("above"), "left_semi")
        slots = some.groupBy(prefix(F.col("key"), depth).alias("above"), prefix(F.col("key"), depth + bits).alias("slot")).agg(F.count("*").alias("n"))
        # One exchange by the bucket above serves all windows: its rows need no other task.
        held = {f"held_{d}": F.sum("n").over(W.partitionBy("above", F.shiftrightunsigned("slot", bits - d))) for d in range(bits + 1)}
        fits = [F.when((F.col(f"held_{d}") <= capacity) | F.lit(depth + d == KEY_BITS), F.lit(d)) for d in range(bits + 1)]
        placed = cut(slots.withColumns(held).withColumn("more", F.coalesce(*fits)).select("above", "slot", "more"), "slots")
        ends = F.expr(f"shiftrightunsigned(slot, {bits} - more)")
        buckets = placed.filter("more is not null").select((F.col("more") + depth).cast("int").alias("depth"), ends.alias("prefix")).distinct()
        found = buckets if found is None else found.unionByName(buckets)
        overfull = placed.filter("more is null").select(F.col("slot").alias("above"))
        depth += bits
        if overfull.isEmpty():
            break
    return found


def located(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """rows(key, ...) with depth and prefix of the bucket that the directory names: of the prefixes of the key at each depth that
    buckets have, the one that is there. Depths are 65 at most; Spark broadcasts the directory only if its size allows."""
    depths = [r.depth for r in directory.select("depth").distinct().orderBy("depth").collect()]
    at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), prefix(F.col("key"), d).alias("prefix")) for d in depths])) if depths else F.explode(F.array().cast("array<struct<depth:int,prefix:bigint>>"))
    return rows.withColumn("_at", at).select(*rows.columns, "_at.depth", "_at.prefix").join(directory, ["depth", "prefix"])


def keyed(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id, norm, key of docs(doc_id, text). key: of the column norm; by default a 64-bit hash."""
    rows = docs.select("doc_id", normalised(text_of(docs)).alias("norm"))
    return rows.withColumn("key", F.xxhash64("norm") if key is None else key)


def build_index(docs: DataFrame, key: Column | None = None, capacity: int = BUCKET_CAPACITY, step: int = STEP) -> tuple[Index, DataFrame]:
    """The index of docs(doc_id, text), written to the shared folder, and its narrow rows (doc_id, key, digest)."""
    rows = keyed(docs, key)
    narrow = cut(rows.select("doc_id", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "digests")
    seen = Observation()
    counted = narrow.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_id"), F.min("digest").alias("digest"))
    counted = cut(counted, "keys", seen, n=F.count(F.lit(1)))
    directory = cut(directory_of(counted.select("key"), capacity, step).coalesce(1), "directory")
    placed = cut(located(counted, directory), "placed")
    entry = ["depth", "prefix", "key", "keep_id", "group_size", "digest"]
    single = placed.filter("n = 1").select("depth", "prefix", "key", "keep_id", F.col("n").alias("group_size"), "digest")
    # Rows of keys that several rows have bring their texts to the owner of the bucket, combined by parts of the rows first.
    again = cut(placed.filter("n > 1").select("depth", "prefix", "key"), "again")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    parts = rows.join(again, "key").groupBy("depth", "prefix", "key", "norm", salt).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    owned = parts.repartition("depth", "prefix").groupBy("depth", "prefix", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    owned = cut(owned.withColumn("digest", F.unhex(F.sha2("norm", 256))), "owned")
    chain = W.partitionBy("depth", "prefix", "key")
    every = single.withColumns({"chain_pos": F.lit(1), "chain_len": F.lit(1).cast("long")}).unionByName(
        owned.select(*entry).withColumns({"chain_pos": F.row_number().over(chain.orderBy(F.col("keep_id").asc_nulls_first(), "digest")), "chain_len": F.count("*").over(chain)})
    )
    every = every.select("depth", "prefix", "key", "chain_pos", "chain_len", "keep_id", "group_size", "digest")
    entries = cut(few(every.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "key", "chain_pos"), seen.get["n"]), "entries")
    several = entries.filter("chain_len > 1").select("depth", "prefix", "key").distinct()
    chained = cut(owned.join(several, ["depth", "prefix", "key"], "left_semi"), "chained")
    release(counted, again, owned)
    return Index(directory, entries, chained), narrow


def probe(docs: DataFrame, narrow: DataFrame, index: Index, key: Column | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, digest of each row: through the directory to its bucket, there to the entry of its key, and where
    that is a chain, to the link with its bytes."""
    entry = ["keep_id", "group_size", "digest"]
    # Of a chain, the row meets the first link, which tells that there are more.
    first = index.entries.filter("chain_pos = 1").select("depth", "prefix", "key", "chain_len", *entry)
    met = located(narrow.select("doc_id", "key"), index.directory).join(first, ["depth", "prefix", "key"])
    found = met.filter("chain_len = 1").select("doc_id", *entry)
    if index.chained.isEmpty():
        return found
    keys = index.chained.select("key").distinct()
    rows = located(keyed(docs, key).join(keys, "key", "left_semi"), index.directory)
    return found.unionByName(rows.join(index.chained, ["depth", "prefix", "key", "norm"]).select("doc_id", *entry))


def exact_duplicates(docs: DataFrame, key: Column | None = None, capacity: int = BUCKET_CAPACITY, step: int = STEP) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs(doc_id, text, ...).

    Texts are equal when identical after each run of white space became one space. A null text counts as empty, so
    null and empty texts form one group; white space alone is a text of one space. Rows that repeat a doc_id with an
    equal text are kept together; a null doc_id is kept only where its group has no other id. An empty table gives no
    rows. Other columns are ignored, whatever their names."""
    index, narrow = build_index(docs, key, capacity, step)
    found = probe(docs, narrow, index, key)
    return found.select("doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts: of the smallest doc_id, null only where there is no other; of rows that
    share it, that of the smallest other columns. A repeated or null doc_id neither loses a text nor keeps a copy. An empty table
    gives no rows; extra columns are kept, whatever their names."""
    index, narrow = build_index(docs)
    many = index.entries.filter("group_size > 1").select(F.col("key").alias("_k"), F.col("digest").alias("_d"), F.col("keep_id").alias("_keep"))
    many = cut(many, "copied")
    told = narrow.join(many, (F.col("key") == F.col("_k")) & (F.col("digest") == F.col("_d")))
    # An id that one row has tells which row goes: a narrow table of ids, so texts stay where they are if it is small enough to broadcast.
    shared = narrow.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_shared"))
    shared = cut(shared, "shared-ids")
    gone = told.filter("doc_id <> _keep or _keep is null").select(F.col("doc_id").alias("_gone")).filter("_gone is not null")
    gone = cut(gone.join(shared, F.col("_gone") == F.col("_shared"), "left_anti").orderBy("_gone"), "gone")
    no_id = not narrow.filter("doc_id is null").isEmpty()
    several = not shared.isEmpty()
    release(narrow)
    out = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    if not no_id and not several:
        return out
    # Rows without an id, or that share theirs, are told by the digest of their texts.
    plain = out.filter("doc_id is not null").join(shared, out["doc_id"] == shared["_shared"], "left_anti")
    others = out.join(shared, out["doc_id"] == shared["_shared"], "left_semi").unionByName(out.filter("doc_id is null"))
    norm = normalised(text_of(others))
    rows = others.select(F.struct(*[others[f"`{c}`"] for c in docs.columns]).alias("_row"), F.xxhash64(norm).alias("_key"), F.unhex(F.sha2(norm, 256)).alias("_digest"))
    of_group = (F.col("_key") == F.col("_k")) & (F.col("_digest") == F.col("_d"))
    rows = rows.join(many, of_group, "left").filter(F.col("_k").isNull() | F.col("_row.doc_id").eqNullSafe(F.col("_keep")))
    alone = rows.filter("_k is null").select("_row.*")
    first = rows.filter("_k is not null").groupBy("_k", "_d").agg(F.min("_row").alias("_row"))
    return plain.unionByName(alone).unionByName(first.select("_row.*"))
