"""Indexes derived from base tables: hierarchy, dependencies, call graph, classes of files, chunks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci, directory, file_name, truncated
from .shared import cut, running

#: Priority of a file's group in chunks, by class.
PRIORITY = {"Config": 0, "Model": 1, "Service": 2, "Repository": 3, "ViewModel": 4, "View": 5, "Controller": 6, "Unknown": 7, "Test": 8}
CHUNK_TOKENS = 150_000
SMALL_WORKSPACE = 100_000


def inherits(types: DataFrame) -> DataFrame:
    """types with bases: the base type, if any, before the interfaces."""
    base = F.when(F.coalesce(F.col("base_type"), F.lit("")) != "", F.array("base_type")).otherwise(F.array().cast("array<string>"))
    return types.withColumn("bases", F.concat(base, "interfaces"))


def type_hierarchy(types: DataFrame) -> DataFrame:
    """name, bases; of types of one name, the last."""
    return inherits(types).groupBy("name").agg(F.max_by("bases", F.struct("file_ord", "type_ord")).alias("bases"))


def dependency_map(types: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """name, deps: distinct bases and dependencies of the type's file; of types of one name, the last."""
    rows = inherits(types)
    if files is not None:
        rows = rows.join(files.select("file_ord", "dependencies"), "file_ord", "left")
        rows = rows.withColumn("bases", F.concat("bases", F.coalesce("dependencies", F.array().cast("array<string>"))))
    return rows.groupBy("name").agg(F.max_by(F.array_distinct("bases"), F.struct("file_ord", "type_ord")).alias("deps"))


def file_dependencies(types: DataFrame) -> DataFrame:
    """file_ord, dependencies: the distinct bases of a file's types."""
    return inherits(types).select("file_ord", "type_ord", F.posexplode("bases").alias("pos", "base")).groupBy("file_ord", "base").agg(F.min(F.struct("type_ord", "pos")).alias("o")).groupBy("file_ord").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "base"))), lambda x: x["base"]).alias("dependencies"))


def call_graph(call_sites: DataFrame) -> DataFrame:
    """caller, callee: distinct pairs of type.method."""
    return call_sites.select(F.concat_ws(".", "caller_type", "caller_method").alias("caller"), F.concat_ws(".", "called_type", "called_method").alias("callee")).distinct()


def classification(path: Column, name: Column, types: Column | None = None) -> Column:
    """Class of a C# or other file, by the first rule that holds. types: array of (base_type, interfaces)."""
    p, n = F.lower(path), F.lower(name)
    ends = lambda *s: F.rlike(n, F.lit("(" + "|".join(x.replace(".", r"\.") for x in s) + ")$"))
    out = F.when(ends(".csproj", ".json", ".config", ".xml"), "Config").when(p.contains("test") | p.contains("spec"), "Test")
    for word, kind in (("viewmodel", "ViewModel"), ("model", "Model"), ("service", "Service")):
        out = out.when(p.contains(word), kind)
    out = out.when(p.contains("repository") | p.contains("repositories"), "Repository").when(p.contains("controller"), "Controller")
    out = out.when(ends(".xaml", ".xaml.cs"), "View")
    if types is not None:
        shown = lambda t: F.exists(F.array(*map(F.lit, ("Window", "Page", "UserControl"))), lambda w: F.coalesce(t["base_type"], F.lit("")).contains(w))
        told = lambda t: F.exists(t["interfaces"], lambda i: i.contains("INotifyPropertyChanged"))
        first = F.filter(types, lambda t: shown(t) | told(t))
        out = out.when(F.size(first) > 0, F.when(shown(F.try_element_at(first, F.lit(1))), "View").otherwise("ViewModel"))
    return out.otherwise("Unknown")


def python_classification(path: Column, name: Column, bases: Column | None = None) -> Column:
    """Class of a Python file. bases: base types of its classes in order."""
    p, n = F.lower(path), F.lower(name)
    out = (
        F.when(n.startswith("test_") | n.endswith("_test.py") | p.contains("/tests/") | p.contains("\\tests\\"), "Test")
        .when((n == "views.py") | p.contains("/views/"), "View")
        .when((n == "models.py") | p.contains("/models/") | n.isin("serializers.py", "forms.py"), "Model")
        .when(n.isin("urls.py", "routes.py", "admin.py"), "Controller")
        .when(n.endswith("_service.py") | n.endswith("_services.py") | p.contains("/services/"), "Service")
        .when(n.endswith("_repository.py") | p.contains("/repositories/"), "Repository")
        .when(n.isin("settings.py", "config.py", "conftest.py"), "Config")
    )
    if bases is not None:
        kinds = F.filter(F.transform(bases, lambda b: F.when(b.contains("View"), "View").when(b.contains("Model"), "Model").when(b.contains("TestCase"), "Test")), lambda k: k.isNotNull())
        out = out.when(F.size(kinds) > 0, F.try_element_at(kinds, F.lit(1)))
    return out.otherwise("Unknown")


def framework(files: DataFrame, types: DataFrame) -> DataFrame:
    """One row, framework: by the first rule that the whole corpus meets."""
    uses = lambda *w: F.coalesce(F.bool_or(F.exists("usings", lambda u: F.rlike(u, F.lit("|".join(x.replace(".", r"\.") for x in w))))), F.lit(False))
    seen = files.agg(uses("Microsoft.AspNetCore").alias("core"), uses("System.Web.Mvc").alias("mvc"), F.coalesce(F.bool_or(F.col("extension") == ".xaml"), F.lit(False)).alias("xaml"), uses("Xamarin", "Microsoft.Maui").alias("maui"), uses("Microsoft.Azure.Functions").alias("azure"), F.coalesce(F.bool_and(F.col("extension") == ".cs"), F.lit(True)).alias("cs"))
    shown = types.agg(F.coalesce(F.bool_or(F.coalesce("base_type", F.lit("")).contains("Window")), F.lit(False)).alias("window"))
    pick = F.when(F.col("core"), "ASP.NET Core").when(F.col("mvc"), "ASP.NET MVC").when(F.col("window") | F.col("xaml"), "WPF").when(F.col("maui"), "MAUI/Xamarin").when(F.col("azure"), "Azure Functions").when(F.col("cs"), ".NET Class Library").otherwise(".NET Application")
    return seen.crossJoin(shown).select(pick.alias("framework"))  # one row each


def totals(files: DataFrame) -> DataFrame:
    """One row: files, tokens, and the tier of the workspace's size."""
    out = files.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("estimated_tokens"), F.lit(0)).cast("long").alias("total_tokens"))
    return out.withColumn("tier", F.when(F.col("total_tokens") < SMALL_WORKSPACE, "small").otherwise("large"))


def chunk_files(files: DataFrame, limit: int = CHUNK_TOKENS, group: str | None = None) -> DataFrame:
    """chunk_number from 1, pos from 0, file_ord, estimated_tokens: files in order of group priority and path, packed greedily.

    A chunk ends before the file that would pass the limit; a file over the limit has a chunk of its own. Each file knows, from sums
    over the files before it, which file would begin the next chunk if it began one. Which files do begin one follows from the first:
    each round joins the beginnings found so far with a table of leaps and doubles the leaps, so rounds grow with the logarithm of
    the number of chunks, and no task holds all files."""
    priority = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("classification")], F.lit(7)) if group is None else F.col(group)
    tokens = F.coalesce(F.col("estimated_tokens"), F.lit(0)).cast("long")
    rows = files.select(priority.alias("priority"), "relative_path", "file_ord", "estimated_tokens", tokens.alias("tokens"))
    rows = cut(running(rows, ["priority", "relative_path", "file_ord"], "tokens", "place", "held"), "placed")
    ends = rows.select((F.col("held") + F.col("tokens")).alias("at"), F.lit(0).alias("asks"), "place")
    asks = rows.select((F.col("held") + limit).alias("at"), F.lit(1).alias("asks"), "place")
    both = ends.unionByName(asks).withColumn("ended", 1 - F.col("asks"))
    # Files that end by then fit; the next one begins a chunk.
    fits = running(both, ["at", "asks", "place"], "ended", total="fit").filter("asks = 1")
    leap = cut(fits.select(F.col("place").alias("a"), F.greatest(F.col("fit") + 1, F.col("place") + 1).alias("b")), "leaps")
    starts = cut(rows.filter("place = 1").select("place"), "starts")
    known = starts.count()
    while known:
        ahead = starts.join(leap.withColumnRenamed("a", "place"), "place").select(F.col("b").alias("place"))
        starts = cut(starts.unionByName(ahead.join(rows.select("place"), "place", "left_semi")).distinct(), "starts")
        if starts.count() == known:
            break
        known = starts.count()
        leap = cut(leap.join(leap.toDF("b", "c"), "b").select("a", F.col("c").alias("b")), "leaps")
    begun = rows.join(starts.withColumn("begins", F.lit(1)), "place", "left").withColumn("begins", F.coalesce("begins", F.lit(0)))
    packed = running(begun, ["place"], "begins", total="earlier").withColumn("chunk_number", (F.col("earlier") + F.col("begins")).cast("int"))
    firsts = packed.filter("begins = 1").select("chunk_number", F.col("place").alias("first"))
    return packed.join(firsts, "chunk_number").select("chunk_number", (F.col("place") - F.col("first")).cast("int").alias("pos"), "file_ord", "estimated_tokens")


def chunk_descriptions(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """chunk_number, description: the three most frequent classes, ties by first place."""
    counts = chunks.join(files.select("file_ord", "classification"), "file_ord").groupBy("chunk_number", "classification").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    top = counts.withColumn("k", F.row_number().over(W.partitionBy("chunk_number").orderBy(F.desc("n"), "at"))).filter("k <= 3")
    return top.groupBy("chunk_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "classification"))), lambda x: x["classification"]), " + ").alias("description"))


def chunk_crossrefs(needs: DataFrame, holds: DataFrame) -> DataFrame:
    """chunk, other, n_shared, shown: for needs(chunk, name) and holds(chunk, name), names that another chunk holds; the first three."""
    met = needs.distinct().join(holds.distinct().withColumnRenamed("chunk", "other"), "name").filter("chunk <> other")
    names = F.sort_array(F.collect_set("name"))
    return met.groupBy("chunk", "other").agg(F.count("*").alias("n_shared"), F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.count("*") > 3, "...").otherwise("")).alias("shown"))


def key_members(members: DataFrame) -> DataFrame:
    """file_ord, key_members: the first three public methods, cut at 50 characters."""
    shown = members.filter("access_modifier = 'public' and kind = 'Method'").withColumn("k", F.row_number().over(W.partitionBy("file_ord").orderBy("member_ord"))).filter("k <= 3")
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("signature", "name").alias("s")))), lambda x: x["s"]), ", ")
    return shown.groupBy("file_ord").agg(truncated(listed, 50, 47).alias("key_members"))


def entry_points(files: DataFrame, limit: int = 10) -> DataFrame:
    name = F.lower("file_name")
    return files.filter(name.isin("program.cs", "app.xaml", "startup.cs") | name.endswith(".csproj")).orderBy("file_ord").limit(limit)


def namespace_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("namespace").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "namespace")


def root_namespaces(files: DataFrame) -> DataFrame:
    return files.select(F.split("namespace", r"\.")[0].alias("root")).filter("root <> ''").distinct()


def build_targets(files: DataFrame) -> DataFrame:
    """Solutions in the root directory or its parent's (a path that begins with ../), projects anywhere; by extension and path."""
    top = directory(F.regexp_replace(F.translate("relative_path", "\\", "/"), r"^\.\./", "")) == ""
    kind = F.lower("extension")
    return files.filter((kind.isin(".sln", ".slnx") & top) | (kind == ".csproj")).orderBy("extension", "relative_path")


def shared_directories(workspace_dirs: DataFrame) -> DataFrame:
    """directory, n_workspaces, workspaces of those that more than one workspace of (workspace, directory) uses."""
    return workspace_dirs.distinct().groupBy("directory").agg(F.count("*").alias("n_workspaces"), F.array_join(F.sort_array(F.collect_list("workspace")), ", ").alias("workspaces")).filter("n_workspaces > 1")


def merged_workspaces(workspaces: DataFrame) -> DataFrame:
    """directory, tags: for workspaces(ord, name, directories), each directory with the names of those that use it, in order."""
    rows = workspaces.select("ord", "name", F.explode("directories").alias("directory")).groupBy("directory", "name").agg(F.min("ord").alias("ord"))
    return rows.groupBy("directory").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ", ").alias("tags"))


def upserted(table: DataFrame, rows: DataFrame, key: str = "file_path") -> DataFrame:
    """table with the rows of each key in rows replaced. Indexes derived from it are computed anew, all of them."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def root_of(path: Column, roots: list[str]) -> Column:
    """The first root that is a plain prefix of the path."""
    return F.coalesce(*[F.when(path.startswith(r), F.lit(r)) for r in roots]) if roots else F.lit(None).cast("string")


def bound_project_refs(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs(resolved_path, source_project) grouped by path, with whether the project is outside the files."""
    inside = files.select(F.lower("relative_path").alias("_p")).distinct()
    grouped = refs.groupBy("resolved_path").agg(F.sort_array(F.collect_set("source_project")).alias("used_by"))
    return grouped.join(inside, F.lower("resolved_path") == F.col("_p"), "left").select("resolved_path", file_name(F.col("resolved_path")).alias("name"), "used_by", F.col("_p").isNull().alias("is_external"))


def topics(manual: DataFrame, query: str) -> DataFrame:
    """Rows of manual(key, title, content) that hold query anywhere, in any case."""
    return manual.filter(contains_ci(F.col("key"), query) | contains_ci(F.col("title"), query) | contains_ci(F.col("content"), query))
