"""Logs and small documents: compiler, linter and package-check output, lessons, workspaces, notes, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import file_name, substrings
from ..plans.shared import numbered

LESSONS = "number int, timestamp timestamp, type string, component string, observation string, proposal string, suggestedCode string, source string, contributedBy string"
#: The forms of lines of compilers, linters and package checks.
AT = r"^(.+?)\((\d+),(\d+)\):\s*(error|warning)\s+(\w+):\s*(.+)$"
BARE = r"^\s*(?i:error)\s+(\w+):\s*(.+)$"
LINT = r"^(.+?):(\d+):(\d+):\s*(?i:(error|warning|style)):\s*(.+)$"
INLINE = r"^(.+\.R):(\d+):(\d+):\s*(.+)$"


def build_messages(lines: DataFrame) -> DataFrame:
    """ord, severity, file_path, full_path, line, column, error_code, message of lines(ord, value).

    Errors without a place count if no placed error holds their message."""
    g = lambda p, i: F.regexp_extract("value", p, i)
    placed = lines.filter(F.rlike("value", F.lit(AT))).select("ord", g(AT, 4).alias("severity"), file_name(F.trim(g(AT, 1))).alias("file_path"), F.trim(g(AT, 1)).alias("full_path"), g(AT, 2).cast("int").alias("line"), g(AT, 3).cast("int").alias("column"), g(AT, 5).alias("error_code"), g(AT, 6).alias("message"))
    bare = lines.filter(F.rlike("value", F.lit(BARE))).select("ord", F.lit("error").alias("severity"), F.lit("").alias("file_path"), F.lit(None).cast("string").alias("full_path"), F.lit(0).alias("line"), F.lit(0).alias("column"), g(BARE, 1).alias("error_code"), g(BARE, 2).alias("message"))
    said = placed.filter("severity = 'error'").select(F.col("message").alias("_m")).distinct()
    first = bare.withColumn("_k", F.row_number().over(W.partitionBy("message").orderBy("ord"))).filter("_k = 1").drop("_k")
    # What a message may hold is found by its substrings of the lengths that bare messages have; no side is compared with all of the other.
    lengths = sorted(r[0] for r in first.select(F.length("message")).distinct().collect())
    held = said.select(F.explode(substrings(F.col("_m"), lengths)).alias("message")).distinct()
    return placed.unionByName(first.join(held, "message", "left_anti"))


def lint_messages(lines: DataFrame) -> DataFrame:
    """ord, file, line, kind (error, warning or style), message."""
    g = lambda i: F.regexp_extract("value", LINT, i)
    return lines.filter(F.rlike("value", F.lit(LINT))).select("ord", file_name(F.trim(g(1))).alias("file"), g(2).cast("int").alias("line"), F.lower(g(4)).alias("kind"), F.trim(g(5)).alias("message"))


def check_messages(lines: DataFrame) -> DataFrame:
    """ord, kind (error, warning or note), message: by the end of a line or by a place in it; a line can count twice."""
    t = F.trim("value")
    kind = F.when(t.endswith("ERROR") | t.contains("Error in") | t.contains("Error:"), "error").when(t.endswith("WARNING"), "warning").when(t.endswith("NOTE"), "note")
    whole = lines.select("ord", kind.alias("kind"), t.alias("message")).filter("kind is not null")
    return whole.unionByName(lines.filter(F.rlike(t, F.lit(INLINE))).select("ord", F.lit("error").alias("kind"), F.trim(F.regexp_extract(t, INLINE, 4)).alias("message")))


def lessons(spark: SparkSession, path: str) -> DataFrame:
    """Lessons of a JSON array; none if the file is missing or is not one."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LESSONS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], LESSONS)


def workspaces(spark: SparkSession, root: str) -> DataFrame:
    """One row for each workspace.json one folder below root, its extensions completed by the defaults."""
    return spark.read.option("multiLine", True).json(f"{root}/*/workspace.json")


def missing_defaults(extensions, defaults: list[str]):
    return F.array_except(F.array(*map(F.lit, defaults)), extensions)


def stale(fetched_at, hours: int = 24):
    """Whether what was fetched then is older than its time to live."""
    return F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(fetched_at) > hours * 3600


def notes(lines: DataFrame) -> DataFrame:
    """line_no, text, number of lines(line_no, text): entries, which begin with a dash and a bracket, are numbered."""
    entry = F.coalesce(F.col("text").startswith("- ["), F.lit(False))
    entries = numbered(lines.filter(entry), ["line_no"])
    return entries.unionByName(lines.filter(~entry).withColumn("number", F.lit(None).cast("long")))


def notes_size(lines: DataFrame, cap: int = 20_480) -> DataFrame:
    n = F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))
    return lines.agg(n.alias("size_bytes"), F.floor(n / 4).alias("tokens"), F.floor(n * 100 / cap).alias("percent"))


def tail(lines: DataFrame, n: int) -> DataFrame:
    return lines.orderBy(F.desc("ord")).limit(n)
