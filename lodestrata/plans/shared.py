"""Intermediate tables that outlive executors: written to the shared folder and read again."""

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
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_own: list[str] = []
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir. Where that is unset, in a folder of our own if
    all tasks run on this machine (tests); elsewhere executors would each write to their own disk, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="lodestrata-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = "file://" + _own[0]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


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


def cut(df: DataFrame, tag: str = "table") -> DataFrame:
    """df, written to the shared folder and read again: what follows neither recomputes it nor carries its plan. The files of its shuffles go at once."""
    path = fresh_path(df.sparkSession, tag)
    with _shuffles_go(df.sparkSession):
        df.write.parquet(path)
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
SLICE = 1 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of about SLICE bytes; a longer row is a run of its own."""
    if batch.nbytes <= SLICE or batch.num_rows < 2:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        yield from slices(part)


def map_texts(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """df with function over its rows, a slice at a time: what a task holds in Python does not grow with the rows of a batch. When a task ends, memory that it is
    done with goes back to the machine, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield function(part)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def running(rows: DataFrame, order: list[str], value: str | None = None, number: str | None = None, total: str | None = None) -> DataFrame:
    """rows with number, their place from 1 in the order of some columns, nulls first, and total, the sum of value over the rows before;
    rows that tie come in any order.

    Rows are dealt to ranges of the order, and counted within each; where a range begins is a sum over the ranges before it, a row
    each. No task holds all rows. The ranges are written first, as their bounds come from a sample."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    what = {c: e for c, e in ((number, F.count("*")), (total, F.sum(value) if value else None)) if c and e is not None}
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_range").agg(*[e.alias(f"_s_{c}") for c, e in what.items()])
    begins = sums.select("_range", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in what])
    within = W.partitionBy("_range").orderBy(*order)
    out = ranged.join(begins, "_range")
    if number:
        out = out.withColumn(number, F.col(f"_b_{number}") + F.row_number().over(within))
    if total:
        earlier = F.coalesce(F.sum(value).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(total, F.col(f"_b_{total}") + earlier)
    return out.drop("_range", *[f"_b_{c}" for c in what])


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place from 1 in the order of some columns, nulls first; rows that tie are numbered in any order. See running."""
    return running(rows, order, number=name)
