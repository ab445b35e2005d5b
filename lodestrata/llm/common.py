"""What the operators share: reading columns safely, cutting lineage in the shared folder, word patterns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: White space as the operators' contracts define it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a folder of our own if all tasks run on this
    machine (tests); on a cluster, executors would each write to their own disk, so there it is an error."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _own["root"], ignore_errors=True)
    return "file://" + _own["root"]


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than its narrow rows need: two for each core of the cluster, or one for each two million."""
    n = max(2 * df.sparkSession.sparkContext.defaultParallelism, rows // 2_000_000 + 1)
    return df.coalesce(n)


#: With it on, a query's shuffle files go when the query ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, tag: str, seen: Observation | None = None, **metrics: Column) -> DataFrame:
    """df, written to the shared folder and read again: later steps neither recompute it nor depend on a live executor. The files
    of its shuffles go at once, as nothing reads them again.
    seen: gets the metrics, aggregates over df, from the same job."""
    path = fresh_path(df.sparkSession, tag)
    with _shuffles_go(df.sparkSession):
        (df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if seen else df).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what cut() has written for tables that no later step reads."""
    for t in tables:
        if path := _paths.pop(t, None):
            sc = t.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes of Arrow data that a function over texts gets at a time.
SLICE = 4 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about SLICE bytes; a longer row is a run of its own."""
    if batch.nbytes <= SLICE or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from _slices(part)


def _give_back() -> None:
    """Workers live on between tasks: memory that a task is done with goes back to the machine, where the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow(function, schema) in slices of a few megabytes: of a slice, function holds Python strings and more besides
    the Arrow buffers. The session's own limit bounds the batches themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(part for b in batches for part in _slices(b))
        _give_back()

    return df.mapInArrow(run, schema)


def text_of(docs: DataFrame, name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(docs[name], F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; null: 0. Counts the places where a word begins, which needs no array of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
