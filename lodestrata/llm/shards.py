"""Sharding by size-tiered compaction on a table of immutable files with versioned manifests.

Arrivals are appended as small shards, each written once. Compaction sorts runs into tiers of similar size; a tier with
enough runs is merged into files of the target size, and larger tiers are left alone, so a row is rewritten as often as
its run moves up a tier. A commit writes the whole list of live shards to a folder of its own and renames that folder to
the next version, which fails if another writer was faster: readers see the old version or the new one, and a job whose
executors are lost before the commit leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh_path, release

ARRIVAL_ROWS = 2_000
TARGET_BYTES = 128 << 20
FANOUT = 4
MIN_RUNS = 4
SMALLEST = 1 << 16
CODEC = "zstd"
#: Columns that files hold besides those of their rows.
SHARD, BYTES = "__shard", "__bytes"


#: vacuum() leaves what was written in the last week, and what the last two versions name.
RETENTION_S, KEPT_VERSIONS = 7 * 24 * 3600, 2


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be, or deleted its files."""


class ShardTable:
    """root/data/<generation>/__shard=<id>/...: rows; root/manifests/v<version>: the live shards of a version."""

    MANIFEST = "shard long, generation string, tier int, n_rows long, n_bytes long"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return max((int(n[1:]) for n in names if n[0] == "v"), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version, the latest if none is given."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.MANIFEST)
        return self.spark.read.schema(self.MANIFEST).parquet(f"{self.root}/manifests/v{version:09d}")

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Makes manifest the version after base, in one atomic rename; Conflict if that version is there already."""
        for r in manifest.select("generation").distinct().collect():  # one per append or merge
            if not self._fs.exists(self._path(f"{self.root}/data/{r.generation}")):
                raise Conflict(f"the files of {r.generation} are gone")
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        manifest.coalesce(1 + manifest.count() // 1_000_000).write.parquet(staged)  # a row per shard
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        no_options = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never overwrite
        try:
            context.rename(self._path(staged), self._path(f"{self.root}/manifests/v{base + 1:09d}"), no_options)
        except Exception as e:
            if self.version() > base:
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def rows(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with the columns SHARD and BYTES; of each generation only folders of live shards are read."""
        live = cut(self.manifest(version), "live")
        generations = [r.generation for r in live.select("generation").distinct().collect()]  # one per append or merge
        if not generations:
            raise ValueError("the table has no shards")
        out = None
        for g in generations:
            part = self.spark.read.parquet(f"{self.root}/data/{g}").withColumn(SHARD, F.col(SHARD).cast("long"))
            part = part.join(live.filter(F.col("generation") == g).select(F.col("shard").alias(SHARD)), SHARD, "left_semi")
            out = part if out is None else out.unionByName(part)
        return out

    def _described(self, generation: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/data/{generation}")
        sizes = rows.groupBy(F.col(SHARD).cast("long").alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(BYTES).alias("n_bytes"))
        return cut(sizes.select("shard", F.lit(generation).alias("generation"), tier_of(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes"), "described")

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Writes rows(text, ...) as small shards, without a shuffle, and commits them. Returns the version."""
        base = self.version()
        live = cut(self.manifest(base), "live")
        first = (live.agg(F.max("shard")).first()[0] or 0) + 1
        generation = f"append-{uuid.uuid4().hex}"
        at = F.monotonically_increasing_id()  # the task in the upper bits, the row within it in the lower 33
        run = F.shiftright(at, 33) * (1 << 22) + F.floor(at.bitwiseAND((1 << 33) - 1) / arrival_rows)
        sized = rows.withColumn(BYTES, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).withColumn(SHARD, (run + first).cast("long"))
        sized.write.partitionBy(SHARD).option("compression", CODEC).parquet(f"{self.root}/data/{generation}")
        return self.commit(live.unionByName(self._described(generation)) if not rows.isEmpty() else live, base)

    def compact(self, target: int = TARGET_BYTES, min_runs: int = MIN_RUNS) -> int:
        """Merges until no tier below the target has min_runs runs; each round commits a version. Returns the latest."""
        while True:
            base = self.version()
            live = cut(self.manifest(base), "live")
            plan = cut(merges(live, target, min_runs), "merges")
            if plan.isEmpty():
                return base
            first = live.agg(F.max("shard")).first()[0] + 1
            generation = f"merge-{uuid.uuid4().hex}"
            into = plan.select(F.col("shard").alias(SHARD), F.col("merge").cast("long").alias("__into"))
            rows = self.rows(base).join(into, SHARD)
            files = plan.agg(F.max("merge")).first()[0] + 1
            rows = rows.withColumn(SHARD, F.col("__into") + first).repartitionById(files, F.col("__into").cast("int")).drop("__into")
            rows.write.partitionBy(SHARD).option("compression", CODEC).parquet(f"{self.root}/data/{generation}")
            rest = live.join(plan.select("shard"), "shard", "left_anti").select("shard", "generation", "tier", "n_rows", "n_bytes")
            self.commit(rest.unionByName(self._described(generation)), base)
            release(live, plan)

    def vacuum(self, older_than_s: float = RETENTION_S, keep_versions: int = KEPT_VERSIONS) -> int:
        """Deletes generations that none of the latest versions names and that were written longer ago than any writer takes from its first file to its
        commit; how many. Readers of older versions lose them."""
        last = self.version()
        live: set[str] = set()
        for v in range(max(1, last - keep_versions + 1), last + 1):
            live |= {r.generation for r in self.manifest(v).select("generation").distinct().collect()}
        before = time.time() * 1000 - older_than_s * 1000
        at = self._path(f"{self.root}/data")
        every = [s for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        old = [s.getPath() for s in every if s.getPath().getName() not in live and self._written(s.getPath()) <= before]
        for p in old:
            self._fs.delete(p, True)
        return len(old)

    def _written(self, generation) -> int:
        """When the last file of a generation was written; folders are written to before the files in them are complete."""
        files, latest = self._fs.listFiles(generation, True), self._fs.getFileStatus(generation).getModificationTime()
        while files.hasNext():
            latest = max(latest, files.next().getModificationTime())
        return latest


def tier_of(n_bytes) -> F.Column:
    """Runs of similar size: 0 up to SMALLEST bytes, then one tier for each factor of FANOUT."""
    return F.greatest(F.lit(0), F.ceil(F.log(float(FANOUT), F.greatest(n_bytes, F.lit(1)) / float(SMALLEST)))).cast("int")


def merges(live: DataFrame, target: int = TARGET_BYTES, min_runs: int = MIN_RUNS) -> DataFrame:
    """shard, merge: which runs of live are merged into which file, from 0.

    Within a tier, runs of up to half the target are taken in the order of their ids and cut where their sum passes a
    multiple of the target: a file has the target's size, give or take a run. Tiers with fewer than min_runs such runs, and
    runs that would be alone, stay. Sums run over ranges of runs, then over the ranges' own sums: no task holds all runs."""
    small = live.filter(F.col("n_bytes") <= target // 2).select("shard", "tier", "n_bytes")
    ranged = cut(small.repartitionByRange("tier", "shard").withColumn("range", F.spark_partition_id()), "runs")
    sums = ranged.groupBy("tier", "range").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    tier = W.partitionBy("tier")  # of the ranges, as many as there are partitions
    earlier = F.coalesce(F.sum("size").over(tier.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("tier", "range", earlier.alias("earlier"), F.sum("n").over(tier).alias("runs")).filter(F.col("runs") >= min_runs)
    within = W.partitionBy("tier", "range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("within", F.coalesce(F.sum("n_bytes").over(within), F.lit(0))).join(sums, ["tier", "range"])
    placed = placed.select("shard", "tier", F.floor((F.col("earlier") + F.col("within")) / target).alias("part"))
    parts = placed.groupBy("tier", "part").agg(F.count("*").alias("together"))
    last = parts.groupBy("tier").agg((F.max("part") + 1).alias("parts"))  # a row per tier
    begins = last.select("tier", F.coalesce(F.sum("parts").over(W.orderBy("tier").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("begin"))
    kept = placed.join(parts.filter("together > 1"), ["tier", "part"]).join(begins, "tier")
    return kept.select("shard", (F.col("begin") + F.col("part")).alias("merge"))


def sharded(docs: DataFrame, root: str | None = None, arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET_BYTES) -> tuple[ShardTable, int]:
    """Appends docs to the table at root (a new one in the shared folder if none is given) and compacts it."""
    spark = docs.sparkSession
    table = ShardTable(spark, root or fresh_path(spark, "shards"))
    table.append(docs, arrival_rows)
    return table, table.compact(target)


def set_aside(docs: DataFrame) -> DataFrame:
    """docs with columns renamed that files hold besides, whatever their case."""
    names, taken = [], {c.lower() for c in docs.columns}
    for c in docs.columns:
        name = c
        while name.lower() in (SHARD, BYTES, "__into") or name != c and name.lower() in taken:
            name += "_of_row"
        names.append(name)
    return docs.toDF(*names)


def shard_of_documents(docs: DataFrame, root: str | None = None, arrival_rows: int = ARRIVAL_ROWS, target: int = TARGET_BYTES) -> DataFrame:
    """doc_id, shard, tier, shard_rows, shard_bytes, version: a row per row of docs(doc_id, text, ...), read back from the shards
    of the committed version.

    Bytes are those of the texts in UTF-8, a null text has none. Rows that repeat are kept, null ids too; an empty table
    gives no rows. Columns with the names that files hold besides are renamed before they are written."""
    kept = set_aside(docs)
    if kept.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, shard long, tier int, shard_rows long, shard_bytes long, version int")
    table, version = sharded(kept, root, arrival_rows, target)
    live = table.manifest(version).select("shard", "tier", F.col("n_rows").alias("shard_rows"), F.col("n_bytes").alias("shard_bytes"))
    rows = table.rows(version).select("doc_id", F.col(SHARD).alias("shard"))
    return rows.join(live, "shard").select("doc_id", "shard", "tier", "shard_rows", "shard_bytes", F.lit(version).alias("version"))
