"""Impact of a change: breadth-first traversal of callers and overrides, a risk score, reasons and actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci
from ..plans.shared import cut, numbered

#: Names that suggest a critical path, and namespaces of test frameworks.
CRITICAL = (
    "payment", "auth", "security", "crypto", "password", "token", "transaction", "billing", "charge", "withdraw", "transfer", "encrypt", "decrypt",
    "certificate", "credential", "secret",
)
TEST_USINGS = ("nunit", "xunit", "microsoft.visualstudio.testtools")
MAX_DEPTH = 10


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth: the nodes that edges(src, dst) lead to from start(node), each at its least depth.

    A level joins the frontier with the edges and drops what is known. Levels are written to the shared folder, so that the plan
    of a level does not hold all before it and a lost executor costs no level."""
    found = frontier = start.select("node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        ahead = edges.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "level")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def is_test_file(classification: Column, name: Column, usings: Column) -> Column:
    uses = F.exists(usings, lambda u: F.exists(F.array(*map(F.lit, TEST_USINGS)), lambda t: F.lower(u).contains(t)))
    return (classification == "Test") | contains_ci(name, "test") | F.coalesce(uses, F.lit(False))


def blast_radius(call_sites: DataFrame, members: DataFrame, files: DataFrame, symbol: str, depth: int = 3) -> DataFrame:
    """depth, name, file, line, kind, is_test, is_external of the callers and overrides that a change of symbol reaches.

    The frontier is of bare method names; what is visited, of type.method, in lower case. Of the sites of one key at one
    level, the first in the frontier's order, then the site's, stays; callers come before overrides. A caller whose file
    is not in files (file_path, relative_path, is_test) is external. depth is held to 1 to 10."""
    spark = call_sites.sparkSession
    about = files.select(F.lower("file_path").alias("_path"), "relative_path", "is_test").dropDuplicates(["_path"])
    frontier = spark.createDataFrame([(0, symbol.lower())], "at long, method string")
    visited = spark.createDataFrame([(symbol.lower(),)], "key string")
    out = None
    for d in range(1, max(1, min(MAX_DEPTH, depth)) + 1):
        callers = call_sites.join(frontier, F.lower("called_method") == F.col("method")).select(
            "at", F.lit(0).alias("late"), F.col("site_ord").alias("ord"), F.concat_ws(".", "caller_type", "caller_method").alias("name"), F.col("caller_method").alias("next"), "file_path", "line",
            F.when(F.col("is_property_access"), "property_access").otherwise("caller").alias("kind"),
        )
        overrides = members.filter("is_override").join(frontier, F.col("name_lc") == F.col("method")).select(
            "at", F.lit(1).alias("late"), F.col("member_ord").alias("ord"), F.concat_ws(".", "type_name", "name").alias("name"), F.col("name").alias("next"), "file_path", F.col("start_line").alias("line"), F.lit("override").alias("kind"),
        )
        level = callers.unionByName(overrides).withColumn("key", F.lower("name")).join(visited, "key", "left_anti")
        level = level.withColumn("_k", F.row_number().over(W.partitionBy("key").orderBy("at", "late", "ord"))).filter("_k = 1").drop("_k")
        level = cut(level.withColumn("depth", F.lit(d)), "level")
        if level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        visited = visited.unionByName(level.select("key"))
        order = F.struct("at", "late", "ord")
        names = level.groupBy(F.lower("next").alias("method")).agg(F.min(order).alias("o"))
        frontier = numbered(names, ["o"], "at").select("at", "method")
    if out is None:
        return spark.createDataFrame([], "depth int, name string, file string, line int, kind string, is_test boolean, is_external boolean")
    out = out.join(about, F.lower("file_path") == F.col("_path"), "left")
    return out.select(
        "depth", "name", F.coalesce("relative_path", F.regexp_extract("file_path", r"([^/\\]*)$", 1)).alias("file"), F.col("line").cast("int").alias("line"), "kind",
        F.coalesce("is_test", F.lit(False)).alias("is_test"), ((F.col("kind") != "override") & F.col("_path").isNull()).alias("is_external"),
    )


def risk_score(affected: Column, non_test: Column, tests: Column, bindings: Column, external: Column, critical: Column) -> Column:
    """0 to 10, one decimal, halves to the even digit."""
    breadth = F.least(F.lit(3.0), affected / 4)
    gap = F.when((non_test > 0) & (tests == 0), 2.0).when(non_test > tests * 2, 1.0).otherwise(0.0)
    total = breadth + gap + F.least(F.lit(2.0), bindings * 0.7) + F.least(F.lit(2.0), external * 1.0) + F.when(critical, 1.0).otherwise(0.0)
    return F.least(F.lit(10.0), F.bround(total, 1))


def risk_level(score: Column) -> Column:
    return F.when(score < 3, "LOW").when(score < 5, "MEDIUM").when(score < 7, "HIGH").otherwise("CRITICAL")


def is_critical(name: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CRITICAL)), lambda k: F.lower(name).contains(k))


def summary(impact: DataFrame, symbol: str, bindings: int = 0) -> DataFrame:
    """One row: counts, risk_score, risk_level, factors, actions."""
    s = impact.agg(
        F.count("*").alias("affected"), F.count_if(~F.col("is_test")).alias("non_test"), F.countDistinct(F.when(F.col("is_test"), F.lower("file"))).alias("tests"),
        F.count_if("is_external").alias("external"), F.count_if(F.col("kind") == "override").alias("overrides"), F.coalesce(F.max("depth"), F.lit(0)).alias("levels"),
    )
    score = risk_score(F.col("affected"), F.col("non_test"), F.col("tests"), F.lit(bindings), F.col("external"), is_critical(F.lit(symbol)))
    s = s.withColumn("bindings", F.lit(bindings)).withColumn("risk_score", score).withColumn("risk_level", risk_level(score))
    n = F.col("affected")
    factors = F.array_compact(F.array(
        F.when(n > 10, F.format_string("High fan-out: %d symbols on %d levels", n, "levels")).when(n > 5, F.format_string("Moderate fan-out: %d symbols", n)),
        F.when((F.col("tests") == 0) & (n > 0), "No tests cover an affected path"), F.when(F.col("bindings") > 0, F.format_string("%d markup bindings", "bindings")),
        F.when(F.col("external") > 0, F.format_string("%d references from outside", "external")), F.when(is_critical(F.lit(symbol)), "The name suggests a critical path"),
        F.when(F.col("overrides") > 0, F.format_string("%d overrides", "overrides")),
    ))
    actions = F.array_compact(F.array(
        F.when(F.col("tests") > 0, "Run the affected tests").when(n > 0, "Add tests for the affected paths"), F.when(F.col("bindings") > 0, "Check the markup bindings"),
        F.when(F.col("levels") >= 2, "Review the transitive callers"), F.when(F.col("risk_score") >= 7, "Change in small steps and build after each"),
    ))
    return s.withColumn("factors", F.when(F.size(factors) > 0, factors).otherwise(F.array(F.lit("Low impact")))).withColumn("actions", actions)


def binding_files(markup: DataFrame, symbol: str) -> DataFrame:
    """Rows of markup(text, ...) that bind to symbol, in any case."""
    probes = (f"{{Binding {symbol}", f"{{Binding Path={symbol}", f"{{x:Bind {symbol}", f'Command="{{Binding {symbol}')
    hit = contains_ci(F.col("text"), probes[0])
    for p in probes[1:]:
        hit = hit | contains_ci(F.col("text"), p)
    return markup.filter(hit)
