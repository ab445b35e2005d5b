"""Base tables and indexes kept up to date file by file, and committed together.

A store holds base tables in buckets of files, and the state of each index in buckets of its keys: what files contribute to a row, and how often. A
change of some files subtracts what they have contributed and adds what they contribute now; only buckets that this touches are written anew, and
a row that nothing supports any more is gone. So the work grows with the change, not with the corpus.

All tables and indexes are one version: a manifest names, for each bucket, the generation that holds it. A commit is one rename that fails where another
writer has been faster. What is written before it is not seen; a build that ends halfway leaves the version before it as it was. Readers hold a version
by its number. The rename is atomic on HDFS and on local disks; an object store needs one that is, or a committer that puts if absent.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import inherits
from .shared import cut, release

BUCKETS = 64
#: clean() leaves what the latest versions name, and what was written in the last week.
KEPT_VERSIONS, RETENTION_S = 2, 7 * 24 * 3600

#: Base tables, by file_path.
BASE = ("files", "types", "call_sites")
COUNT = "n_support"
_MANIFEST = "name string, bucket int, generation string, batch long"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was to be, or its files are gone."""


@dataclass(frozen=True)
class Index:
    """key: the column whose buckets hold the state. contributed: of base tables, the rows that files contribute. shown: of the state, the index."""

    key: str
    contributed: Callable[[dict[str, DataFrame]], DataFrame]
    shown: Callable[[DataFrame], DataFrame]


def _declared(base: dict[str, DataFrame], with_files: bool) -> DataFrame:
    rows = inherits(base["types"])
    if with_files:
        more = base["files"].select("file_path", F.col("dependencies").alias("_more"))
        rows = rows.join(more, "file_path", "left").withColumn("bases", F.array_distinct(F.concat("bases", F.coalesce("_more", F.array().cast("array<string>")))))
    return rows.select("name", "file_ord", "type_ord", "bases")


def _last(state: DataFrame, name: str) -> DataFrame:
    return state.groupBy("name").agg(F.max_by("bases", F.struct("file_ord", "type_ord")).alias(name))


def _file_bases(base: dict[str, DataFrame]) -> DataFrame:
    rows = inherits(base["types"]).select("file_path", "file_ord", "type_ord", F.posexplode("bases").alias("pos", "base"))
    return rows.select("file_path", "file_ord", F.struct("type_ord", "pos").alias("at"), "base")


def _file_dependencies(state: DataFrame) -> DataFrame:
    first = state.groupBy("file_path", "file_ord", "base").agg(F.min("at").alias("at"))
    return first.groupBy("file_path", "file_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "base"))), lambda x: x["base"]).alias("dependencies")).select("file_ord", "dependencies")


def _calls(base: dict[str, DataFrame]) -> DataFrame:
    return base["call_sites"].select(F.concat_ws(".", "caller_type", "caller_method").alias("caller"), F.concat_ws(".", "called_type", "called_method").alias("callee"))


INDEXES = {
    "type_hierarchy": Index("name", lambda base: _declared(base, False), lambda s: _last(s, "bases")),
    "dependency_map": Index("name", lambda base: _declared(base, True), lambda s: _last(s, "deps")),
    "file_dependencies": Index("file_path", _file_bases, _file_dependencies),
    "call_graph": Index("caller", _calls, lambda s: s.select("caller", "callee")),
}


class IndexStore:
    """root/data/<name>/<generation>/bucket=<b>/...: rows; root/versions/v<version>: which generation holds which bucket."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, indexes: dict[str, Index] = INDEXES):
        self.spark, self.root, self.buckets, self.indexes = spark, root.rstrip("/"), buckets, indexes
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        at = self._path(f"{self.root}/versions")
        return max((int(s.getPath().getName()[1:]) for s in self._fs.listStatus(at)), default=0) if self._fs.exists(at) else 0

    def manifest(self, version: int | None = None) -> list:
        """(name, bucket, generation, batch): a row for each bucket of a table or index, whatever the size of the corpus."""
        version = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/versions/v{version:09d}").collect() if version else []

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, name: str, held: list, buckets: set[int] | None = None) -> DataFrame | None:
        """Rows of some buckets (None: all), or nothing if none of them has any."""
        paths = [f"{self.root}/data/{name}/{r.generation}/bucket={r.bucket}" for r in held if r.name == name and r.bucket is not None and (buckets is None or r.bucket in buckets)]
        return self.spark.read.parquet(*paths) if paths else None

    def table(self, name: str, version: int | None = None) -> DataFrame | None:
        """A base table of a version, the latest if none is given; None before any file came."""
        return self._read(name, self.manifest(version))

    def index(self, name: str, version: int | None = None, keys: list[str] | None = None) -> DataFrame | None:
        """An index of a version; with keys, from the buckets of these alone."""
        of, buckets = self.indexes[name], None
        if keys is not None:
            buckets = {r[0] for r in self.spark.createDataFrame([(k,) for k in keys], f"{of.key} string").select(self._bucket(of.key)).distinct().collect()}
        state = self._read(name, self.manifest(version), buckets)
        if state is None:
            return None
        return of.shown(state.filter(F.col(of.key).isin(keys)) if keys is not None else state)

    def _write(self, name: str, rows: DataFrame, key: str) -> tuple[str, set[int]]:
        """Writes rows by buckets of a key; the generation and the buckets that have rows. A bucket that is large is several tasks and files: what a task
        holds does not grow with the corpus, however few the buckets are."""
        generation = uuid.uuid4().hex
        at = f"{self.root}/data/{name}/{generation}"
        rows.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
        found = self._fs.listStatus(self._path(at))
        return generation, {int(n.split("=")[1]) for n in (s.getPath().getName() for s in found) if n.startswith("bucket=")}

    def apply(self, changed: dict[str, DataFrame], gone: DataFrame | None = None, batch: int | None = None) -> int:
        """Puts the files of `changed` (files, types and call_sites, each with file_path) in the place of those of the same paths, takes the paths of
        gone(file_path) away, and commits all tables and indexes. Returns the version.

        A path that is in both stays. Of a batch number that the latest version has seen nothing is done: a batch may come again. Rows of types
        and call_sites belong to files of `changed`."""
        base_version = self.version()
        held = self.manifest(base_version)
        seen = max((r.batch for r in held if r.batch is not None), default=None)
        if batch is not None and seen is not None and batch <= seen:
            return base_version
        paths = changed["files"].select("file_path").distinct()
        paths = cut(paths if gone is None else paths.unionByName(gone.select("file_path")).distinct(), "paths")
        touched = {r[0] for r in paths.select(self._bucket("file_path")).distinct().collect()}
        now = {(r.name, r.bucket): r.generation for r in held if r.bucket is not None}
        before, new = {}, {}
        for name in BASE:
            new[name] = changed[name]
            stored = self._read(name, held, touched)
            before[name] = stored.join(paths, "file_path", "left_semi") if stored is not None else changed[name].filter("false")
            rest = stored.join(paths, "file_path", "left_anti").unionByName(changed[name]) if stored is not None else changed[name]
            self._replace(now, name, rest, "file_path", touched)
        for name, of in self.indexes.items():
            delta = of.contributed(new).withColumn(COUNT, F.lit(1).cast("long")).unionByName(of.contributed(before).withColumn(COUNT, F.lit(-1).cast("long")))
            by = [c for c in delta.columns if c != COUNT]
            delta = cut(delta.groupBy(*by).agg(F.sum(COUNT).alias(COUNT)).filter(f"{COUNT} <> 0"), "delta")
            keys = {r[0] for r in delta.select(self._bucket(of.key)).distinct().collect()}
            stored = self._read(name, held, keys)
            state = delta if stored is None else stored.unionByName(delta).groupBy(*by).agg(F.sum(COUNT).alias(COUNT)).filter(f"{COUNT} <> 0")
            if keys:
                self._replace(now, name, state, of.key, keys)
            release(delta)
        release(paths)
        return self._commit(now, base_version, batch if batch is not None else seen)

    def _replace(self, now: dict[tuple[str, int], str], name: str, rows: DataFrame, key: str, buckets: set[int]) -> None:
        generation, full = self._write(name, rows, key)
        for b in buckets:
            now.pop((name, b), None)
        now.update({(name, b): generation for b in full})

    def _commit(self, now: dict[tuple[str, int], str], base: int, batch: int | None) -> int:
        for name, generation in {(name, g) for (name, _), g in now.items()}:
            if not self._fs.exists(self._path(f"{self.root}/data/{name}/{generation}")):
                raise Conflict(f"the files of {name}/{generation} are gone")
        rows = [(name, b, g, batch) for (name, b), g in sorted(now.items())] or [(None, None, None, batch)]
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(staged)
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        plain = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # never overwrite
        try:
            context.rename(self._path(staged), self._path(f"{self.root}/versions/v{base + 1:09d}"), plain)
        except Exception as e:
            if self.version() > base:
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def feed(self, stream: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]]):
        """A writer of a stream of changed files, to be started with a checkpoint: each batch is parsed and applied once. Rows with a null content are
        files that are gone; of a path that comes several times in a batch, parse gets each row."""

        def put(rows: DataFrame, batch: int) -> None:
            held = cut(rows, "batch")
            self.apply(parse(held.filter("content is not null")), held.filter("content is null"), batch)
            release(held)

        return stream.writeStream.foreachBatch(put)

    def clean(self, keep_versions: int = KEPT_VERSIONS, older_than_s: float = RETENTION_S) -> int:
        """Deletes generations that none of the latest versions names, if they are older than any build takes; how many."""
        last, named = self.version(), set()
        for v in range(max(1, last - keep_versions + 1), last + 1):
            named |= {(r.name, r.generation) for r in self.manifest(v)}
        limit, n = (time.time() - older_than_s) * 1000, 0
        for name in (*BASE, *self.indexes):
            at = self._path(f"{self.root}/data/{name}")
            for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
                if (name, s.getPath().getName()) not in named and s.getModificationTime() <= limit:
                    self._fs.delete(s.getPath(), True)
                    n += 1
        return n
