"""Symbols: usages, callers and callees, second hops, implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import cut
from ..tables import Corpus


def usages(c: Corpus, name: str) -> DataFrame:
    """usage_kind, symbol, ord, line of definitions, overrides, invocations, references as a base and implementations: every
    row of each, without merging. Names are compared in any case."""
    lc = name.lower()
    types, members = c.types, c.members
    row = lambda kind, symbol, o, line: [kind.alias("usage_kind"), symbol.alias("symbol"), o.alias("ord"), line.cast("int").alias("line")]
    defs = types.filter(F.col("name_lc") == lc).select(*row(F.lit("Definition"), F.col("name"), F.col("type_ord"), F.col("start_line")))
    own = members.filter(F.col("name_lc") == lc).select(*row(F.when(F.col("is_override"), "Override").otherwise("Definition"), F.col("name"), F.col("member_ord"), F.col("start_line")))
    calls = c.call_sites.filter(F.lower("called_method") == lc).select(*row(F.lit("Invocation"), F.concat_ws(".", "caller_type", "caller_method"), F.col("site_ord"), F.col("line")))
    bases = types.filter(F.lower("base_type") == lc).select(*row(F.lit("Reference"), F.col("name"), F.col("type_ord"), F.col("start_line")))
    faces = types.filter(F.exists("interfaces", lambda i: F.lower(i) == lc)).select(*row(F.lit("Implementation"), F.col("name"), F.col("type_ord"), F.col("start_line")))
    return defs.unionByName(own).unionByName(calls).unionByName(bases).unionByName(faces)


def resolved_usages(references: DataFrame, inheritance: DataFrame) -> DataFrame:
    """References, one for each file and line, and inheritance rows at other places."""
    first = references.withColumn("_k", F.row_number().over(W.partitionBy("file", "line").orderBy("ord"))).filter("_k = 1").drop("_k")
    return first.unionByName(inheritance.join(first.select("file", "line"), ["file", "line"], "left_anti"))


def find_usages(c: Corpus, name: str, resolved: DataFrame | None = None) -> DataFrame:
    """usage_kind, symbol, ord, line, mode: of a blank name none; the rows of resolved(usage_kind, symbol, ord, line), usages that a
    compiler has told, if there are any (semantic); else those by name (heuristic)."""
    plain = usages(c, name)
    if not name.strip():
        return plain.filter("false").withColumn("mode", F.lit("error"))
    if resolved is not None and not resolved.isEmpty():
        return resolved.select(*plain.columns).withColumn("mode", F.lit("semantic"))
    return plain.withColumn("mode", F.lit("heuristic"))


def symbol_by_name(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """One row: the first symbol of exactly that name, of that kind if there is one."""
    match = F.lit(0) if kind is None else F.when(F.col("kind") == kind, 0).otherwise(1)
    return symbols.filter(F.col("name") == name).orderBy(match, "ord").limit(1)


def namespace_for_type(candidates: DataFrame, name: str) -> DataFrame:
    """Of candidates(name, namespace), the namespace for a name: System first, then Microsoft, then the shortest."""
    ns = F.col("namespace")
    rank = F.when(ns.startswith("System"), 0).when(ns.startswith("Microsoft"), 1).otherwise(2)
    return candidates.filter(F.col("name") == name).orderBy(rank, F.length(ns), ns).limit(1).select("namespace")


def _neighbours(call_sites: DataFrame, method: str, type_name: str | None, of: str, by: str) -> DataFrame:
    rows = call_sites.filter(F.lower(f"{by}_method") == method.lower())
    if type_name:
        rows = rows.filter(F.col(f"{by}_type").contains(type_name))
    first = rows.groupBy(F.col(f"{of}_type").alias("type"), F.col(f"{of}_method").alias("method")).agg(F.min(F.struct("site_ord", "file_path", "line")).alias("s"))
    return first.select("type", "method", "s.site_ord", "s.file_path", "s.line")


def callers(call_sites: DataFrame, method: str, type_name: str | None = None) -> DataFrame:
    """type, method and first site of each caller. The receiver's text must contain type_name, case counts."""
    return _neighbours(call_sites, method, type_name, "caller", "called")


def callees(call_sites: DataFrame, method: str, type_name: str | None = None) -> DataFrame:
    return _neighbours(call_sites, method, type_name, "called", "caller")


def second_hop(call_sites: DataFrame, method: str, type_name: str | None = None, first: int = 10, each: int = 5) -> DataFrame:
    """via_type, via_method, type, method: of the first callers, their first distinct callers, matched by method name alone."""
    hop = callers(call_sites, method, type_name).orderBy("site_ord", "type", "method").limit(first)
    hop = hop.select(F.col("type").alias("via_type"), F.col("method").alias("via_method"))
    met = call_sites.join(F.broadcast(hop), F.lower("called_method") == F.lower("via_method"))  # no more than first rows
    near = met.groupBy("via_type", "via_method", "caller_type", "caller_method").agg(F.min("site_ord").alias("site_ord"))
    near = near.withColumn("k", F.row_number().over(W.partitionBy("via_type", "via_method").orderBy("site_ord", "caller_type", "caller_method"))).filter(F.col("k") <= each)
    return near.select("via_type", "via_method", F.col("caller_type").alias("type"), F.col("caller_method").alias("method"))


def implementations(types: DataFrame, name: str, include_abstract: bool = False) -> DataFrame:
    """name, path of the types that implement or derive from name, directly or through base types (not through interfaces of
    interfaces), however long the chain. Each level joins types with the last level's names; a path that meets a name twice ends, and
    so does the walk when a level is empty."""
    lc = name.lower()
    direct = (F.lower("base_type") == lc) | F.exists("interfaces", lambda i: F.lower(i) == lc)
    level = types.filter(direct).select("type_ord", "name", "name_lc", "is_abstract", F.array(F.col("name"), F.lit(name)).alias("chain"))
    found = level
    while True:
        up = level.select(F.col("name_lc").alias("b"), "chain")
        level = types.join(up, F.lower("base_type") == F.col("b")).filter(~F.array_contains("chain", F.col("name")))
        level = level.select("type_ord", "name", "name_lc", "is_abstract", F.concat(F.array("name"), "chain").alias("chain"))
        level = cut(level.join(found.select("type_ord"), "type_ord", "left_anti"), "level")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    if not include_abstract:
        found = found.filter(~F.col("is_abstract"))
    path = F.when(F.size("chain") == 2, "direct").otherwise(F.array_join("chain", " → "))
    return found.groupBy("type_ord", "name").agg(F.min(F.struct(F.size("chain"), path.alias("path")))["path"].alias("path")).select("name", "path")
