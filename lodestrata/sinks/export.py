"""Logs as CSV, lessons and workspaces as JSON. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_columns(log: DataFrame) -> DataFrame:
    """ord, Timestamp, Type, Tool, DurationMs, Message of log(ord, ts, type, tool_name, duration_ms, message); no message is an empty one."""
    return log.select(
        "ord", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.col("type").alias("Type"), F.col("tool_name").alias("Tool"),
        F.col("duration_ms").cast("long").alias("DurationMs"), F.coalesce("message", F.lit("")).alias("Message"),
    )


def activity_lines(log: DataFrame) -> DataFrame:
    """ord, line of the log as CSV: the message quoted, quotes in it doubled; other nulls are empty."""
    quoted = F.concat(F.lit('"'), F.replace("Message", F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("Timestamp", "Type", "Tool", "DurationMs")]
    return activity_columns(log).select("ord", F.concat_ws(",", *cells, quoted).alias("line"))


def write_activity(log: DataFrame, path: str) -> None:
    """The log in order, as CSV files that each have a header; cells that need it are quoted."""
    activity_columns(log).orderBy("ord").drop("ord").write.csv(path, header=True, quote='"', escape='"')


def write_lessons(lessons: DataFrame, path: str) -> None:
    """A JSON object a line; columns that are null are left out."""
    lessons.write.json(path)


def write_workspaces(workspaces: DataFrame, root: str) -> None:
    """A folder for each workspace of workspaces(name, ...), with its settings as JSON."""
    folder = F.coalesce("name", F.lit("")).alias("workspace")
    workspaces.select("*", folder).repartition("workspace").write.partitionBy("workspace").json(root)
