"""Telemetry in batch: counts, averages, minutes, windows, gaps, tails; backups and lessons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import duration_label
from ..plans.shared import numbered

IDLE_SECONDS = (45, 5, 300)  # default and bounds
LOG_ENTRIES, CHART_POINTS, BAR = 1000, 60, 150
SLICE_US = 3_600_000_000
ACTIVITY = ("STARTED", "COMPLETED", "ERROR", "WORKSPACE_SWITCHED")


def parse_activity(lines: DataFrame) -> DataFrame:
    """workspace, type, tool_name, details of lines(value): workspace|TYPE|tool|details; others are dropped."""
    bar = F.instr("value", "|")
    rest = F.expr("substring(value, instr(value, '|') + 1)")
    part = F.split(rest, r"\|")
    rows = lines.filter(bar > 0).select(*[c for c in lines.columns if c != "value"], F.expr("substring(value, 1, instr(value, '|') - 1)").alias("workspace"), part.alias("p"))
    rows = rows.filter((F.size("p") >= 2) & F.col("p")[0].isin(*ACTIVITY))
    return rows.select(*[c for c in lines.columns if c != "value"], "workspace", F.col("p")[0].alias("type"), F.col("p")[1].alias("tool_name"), F.coalesce(F.try_element_at("p", F.lit(3)), F.lit("")).alias("details"))


def tool_calls(activity: DataFrame) -> DataFrame:
    """Completed messages whose details are milliseconds, with duration_ms."""
    ms = F.regexp_extract("details", r"^(\d+)ms$", 1)
    return activity.filter("type = 'COMPLETED'").withColumn("duration_ms", F.expr("try_cast(regexp_extract(details, '^([0-9]+)ms$', 1) as bigint)")).filter(ms != "")


def errors(activity: DataFrame) -> DataFrame:
    return activity.filter("type = 'ERROR'")


def running_average(calls: DataFrame) -> DataFrame:
    """One row: count, average."""
    return calls.agg(F.count("*").alias("n_calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"))


def recent_errors(calls: DataFrame, now, seconds: int = 300) -> DataFrame:
    """One row: errors not before now - seconds."""
    return calls.filter(F.col("is_error") & (F.col("ts") >= F.lit(now) - F.make_interval(secs=F.lit(seconds)))).agg(F.count("*").alias("n_errors"))


def errors_before_each(calls: DataFrame, seconds: int = 300, by: str = "hour") -> DataFrame:
    """ord, n_errors of each error: errors in the seconds up to it, itself included. Windows run in slices of time, and each slice
    is given the errors of the one before, so no task holds all errors."""
    err = calls.filter("is_error").select("ord", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    slice_us = max(seconds, 3600) * 1_000_000
    own = err.withColumn("slice", F.floor(F.col("us") / slice_us)).withColumn("own", F.lit(True))
    given = own.withColumn("slice", F.col("slice") + 1).withColumn("own", F.lit(False))
    w = W.partitionBy("slice").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
    return own.unionByName(given).withColumn("n_errors", F.count("*").over(w)).filter("own").select("ord", "n_errors")


def slowest_call(calls: DataFrame) -> DataFrame:
    return calls.orderBy(F.desc("duration_ms"), "ord").limit(1)


def tool_breakdown(calls: DataFrame) -> DataFrame:
    return calls.groupBy("tool_name").agg(F.count("*").alias("n_calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms")).orderBy(F.desc("n_calls"), "tool_name")


def activity_per_minute(calls: DataFrame) -> DataFrame:
    """minute, n_calls, avg_ms; minutes without calls are absent."""
    return calls.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n_calls"), F.round(F.avg("duration_ms"), 6).alias("avg_ms")).orderBy("minute")


def idle_gaps(calls: DataFrame, seconds: int = IDLE_SECONDS[0], key: str | None = None) -> DataFrame:
    """ord, idle_seconds of calls after which nothing came for the threshold (held to 5 to 300 seconds): one for each gap.

    key: the column whose values have gaps of their own. Windows run in slices of an hour; after the last call of a slice comes the
    first of the next slice that has any, of which there is a row for each hour, so no task holds all calls of a key."""
    least = max(IDLE_SECONDS[1], min(IDLE_SECONDS[2], seconds))
    keys = [key] if key else []
    rows = calls.select("ord", *keys, F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("slice", F.floor(F.col("us") / SLICE_US))
    after = F.lead("us").over(W.partitionBy(*keys, "slice").orderBy("us", "ord"))
    firsts = rows.groupBy(*keys, "slice").agg(F.min("us").alias("first_us"))
    firsts = firsts.withColumn("later_us", F.lead("first_us").over(W.partitionBy(*keys).orderBy("slice")))
    firsts = firsts.select(F.col("slice").alias("_slice"), *[F.col(k).alias("_key") for k in keys], "later_us")
    same = F.col("slice").eqNullSafe(F.col("_slice"))
    rows = rows.withColumn("after_us", after).join(firsts, same & F.col(key).eqNullSafe(F.col("_key")) if key else same)
    gap = F.coalesce("after_us", "later_us") - F.col("us")
    return rows.select("ord", *keys, (gap / 1_000_000).alias("idle_seconds")).filter(F.col("idle_seconds") >= least)


def unanswered(activity: DataFrame, seconds: int = IDLE_SECONDS[0], until=None) -> DataFrame:
    """ord, tool_name, idle_seconds of completed calls of activity(ord, ts, type, tool_name) that nothing answered within the threshold
    (held to 5 to 300 seconds): a start or an error ends the wait, another completion begins it anew. One for each gap.

    until: what comes to an end by then without an answer counts too; without it, the last completion is left open. Windows run in
    slices of an hour; what follows a slice is the first event of a later one, a row for each hour."""
    least = max(IDLE_SECONDS[1], min(IDLE_SECONDS[2], seconds))
    rows = activity.filter(F.col("type").isin("STARTED", "COMPLETED", "ERROR"))
    rows = rows.select("ord", "tool_name", "type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("slice", F.floor(F.col("us") / SLICE_US))
    after = F.lead("us").over(W.partitionBy("slice").orderBy("us", "ord"))
    firsts = rows.groupBy("slice").agg(F.min("us").alias("first_us")).withColumn("later_us", F.lead("first_us").over(W.orderBy("slice"))).select("slice", "later_us")
    end = F.lit(None).cast("long") if until is None else F.unix_micros(F.lit(until).cast("timestamp"))
    gap = F.coalesce("after_us", "later_us", end) - F.col("us")
    rows = rows.withColumn("after_us", after).join(firsts, "slice").filter("type = 'COMPLETED'")
    return rows.select("ord", "tool_name", (gap / 1_000_000).alias("idle_seconds")).filter(F.col("idle_seconds") >= least)


def bounded_tail(log: DataFrame, n: int = LOG_ENTRIES) -> DataFrame:
    """The last n entries."""
    return log.orderBy(F.desc("ts"), F.desc("ord")).limit(n)


def chart_series(calls: DataFrame, n: int = CHART_POINTS) -> DataFrame:
    """The last n calls: error if they took no time, slow beyond twice the average of all, else normal."""
    mean = calls.agg(F.avg("duration_ms").alias("mean"))
    last = bounded_tail(calls, n).crossJoin(mean)  # one row
    return last.select("ord", "ts", "duration_ms", F.when(F.col("duration_ms") == 0, "error").when(F.col("duration_ms") > 2 * F.col("mean"), "slow").otherwise("normal").alias("status"))


def top_tools(calls: DataFrame, n: int = 8) -> DataFrame:
    """tool_name, n_calls, bar of the most called tools; the longest bar is 150."""
    counts = calls.groupBy("tool_name").agg(F.count("*").alias("n_calls"))
    most = counts.agg(F.max("n_calls").alias("most"))
    return counts.orderBy(F.desc("n_calls"), "tool_name").limit(n).crossJoin(most).select("tool_name", "n_calls", (F.col("n_calls") * float(BAR) / F.col("most")).alias("bar"))


def session_summary(calls: DataFrame) -> DataFrame:
    """One row, summary: counts, average and errors, joined by bars."""
    s = calls.agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean"), F.count_if("is_error").alias("bad"))
    return s.select(F.concat_ws(" | ", F.format_string("%d calls", "n"), F.when(F.col("n") > 0, F.format_string("avg %.0fms", "mean")), F.when(F.col("bad") > 0, F.format_string("%d errors", "bad"))).alias("summary"))


def session_duration(calls: DataFrame) -> DataFrame:
    """One row, duration: from the first call to the last, as a label."""
    s = calls.agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return s.select(duration_label(F.coalesce(F.unix_timestamp("b") - F.unix_timestamp("a"), F.lit(0))).alias("duration"))


def since_reset(calls: DataFrame, reset_at) -> DataFrame:
    """Calls that count after a reset: statistics over them start anew."""
    return calls.filter(F.col("ts") > F.lit(reset_at).cast("timestamp_ntz")) if reset_at is not None else calls


def backup_stats(backups: DataFrame) -> DataFrame:
    return backups.groupBy("directory").agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.min("mtime").alias("oldest"))


def top_backup_folders(backups: DataFrame, n: int = 5) -> DataFrame:
    return backup_stats(backups).orderBy(F.desc("n_files"), "directory").limit(n)


def retention_excess(backups: DataFrame, keep: int = 1, older_than=None) -> DataFrame:
    """Backups to delete: those older than the cutoff, and of the rest all but the newest keep of each original."""
    aged = backups.filter(F.col("mtime") < F.lit(older_than)) if older_than is not None else backups.filter("false")
    rest = backups.filter(F.col("mtime") >= F.lit(older_than)) if older_than is not None else backups
    k = F.row_number().over(W.partitionBy("original").orderBy(F.desc("mtime"), "path"))
    return aged.unionByName(rest.withColumn("_k", k).filter(F.col("_k") > keep).drop("_k"))


def numbered_lessons(local: DataFrame, community: DataFrame) -> DataFrame:
    """number, source, ord, ...: local lessons before community ones, each by ord, numbered from 1."""
    both = local.withColumn("source", F.lit("local")).unionByName(community.withColumn("source", F.lit("community")))
    both = both.withColumn("_late", F.col("source") == "community")
    return numbered(both, ["_late", "ord"]).drop("_late").withColumn("number", F.col("number").cast("int"))


def kept_lessons(local: DataFrame, capacity: int = 100) -> DataFrame:
    """The newest lessons up to the capacity, by ord."""
    return local.orderBy(F.desc("ord")).limit(capacity)


def without_lesson(lessons: DataFrame, number: int) -> DataFrame:
    """lessons but the local one of that number; community lessons stay."""
    return lessons.filter(~((F.col("number") == number) & (F.col("source") == "local")))


def json_number(props: Column, key: str) -> Column:
    return F.get_json_object(props, f"$.{key}").cast("long")
