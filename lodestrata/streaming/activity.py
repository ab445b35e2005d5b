"""Telemetry as streams: activity lines, counts and averages, minutes, errors, idle gaps.

The reference has no semantics for late events; ours: they are waited for by the watermark's delay, then dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.telemetry import IDLE_SECONDS, parse_activity

DELAY = "1 minute"


def activity_stream(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text files that appear in a folder, a line each."""
    return parse_activity(spark.readStream.text(path))


def call_stream(spark: SparkSession, path: str) -> DataFrame:
    """ord, ts, tool_name, duration_ms, is_error of event files that appear in a folder."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.select(F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("is_error"))


def running_average(calls: DataFrame) -> DataFrame:
    """Complete mode."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("n_calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


def per_minute(calls: DataFrame, delay: str = DELAY) -> DataFrame:
    out = calls.withWatermark("ts", delay).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n_calls"))
    return out.select(F.col("w.start").alias("minute"), "n_calls")


def recent_errors(calls: DataFrame, delay: str = DELAY) -> DataFrame:
    """Errors in windows of five minutes that begin each minute."""
    out = calls.filter("is_error").withWatermark("ts", delay).groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("n_errors"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_errors")


def idle_gaps(calls: DataFrame, seconds: int = IDLE_SECONDS[0], delay: str = DELAY) -> DataFrame:
    """tool_name, ts of calls after which the tool was silent for the threshold, one for each gap, in append mode.

    State is the last call of a tool, and whether its gap is told. A gap is told when the watermark passes its end, by a timer in the
    time of events, or earlier, when the next call of the tool comes. A batch's calls are taken in order of time."""
    least = max(IDLE_SECONDS[1], min(IDLE_SECONDS[2], seconds)) * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told = state.get if state.exists else (None, True)
        out = []
        if state.hasTimedOut:
            if not told:
                out.append(last)
            state.update((last, True))
        else:
            for t in sorted(t for b in batches for t in b.ts.astype("datetime64[us]").astype("int64")):
                if last is not None and t - last >= least and not told:
                    out.append(last)
                if last is None or t > last:
                    last, told = t, False
            due = -(-(last + least) // 1000)
            if not told and due <= state.getCurrentWatermarkMs():
                out.append(last)
                told = True
            state.update((int(last), told))
            if not told:
                state.setTimeoutTimestamp(int(due))
        yield pd.DataFrame({"tool_name": [key[0]] * len(out), "ts": pd.to_datetime(pd.Series(out, dtype="int64"), unit="us")})

    rows = calls.withWatermark("ts", delay).groupBy("tool_name")
    return rows.applyInPandasWithState(step, "tool_name string, ts timestamp", "last long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)
