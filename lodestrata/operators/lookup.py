"""Lookups: files, namespaces, types and members by name; paths; grep with context; ranges of lines."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import contains_ci, escaped, file_name, normal_path, resolved_path, visible_whitespace

CLASSES = ("Unknown", "View", "ViewModel", "Model", "Service", "Repository", "Controller", "Test", "Config", "Utility")


def list_files(files: DataFrame, classification: str | None = None, namespace: str | None = None, limit: int = 50) -> DataFrame:
    """The first files with that class (any, if it is not a class) and namespace part, with total, the number of all such."""
    if classification and classification.lower() in {c.lower() for c in CLASSES}:
        files = files.filter(F.lower("classification") == classification.lower())
    if namespace:
        files = files.filter(contains_ci(F.col("namespace"), namespace))
    total = files.agg(F.count("*").alias("total"))  # one row
    return files.orderBy("file_ord").limit(limit).crossJoin(total)


def search_namespaces(files: DataFrame, query: str, limit: int = 10) -> DataFrame:
    found = files.filter(contains_ci(F.col("namespace"), query)).groupBy("namespace").agg(F.count("*").alias("n_files"))
    return found.orderBy(F.desc("n_files"), "namespace").limit(limit)


def search_types(types: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return types.filter(F.col("name_lc").contains(query.lower())).orderBy("file_ord", "type_ord").limit(limit)


def search_members(members: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Members of every kind."""
    return members.filter(F.col("name_lc").contains(query.lower())).orderBy("file_ord", "type_ord", "member_ord").limit(limit)


def search_files(files: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return files.filter(contains_ci(F.col("file_name"), query) | contains_ci(F.col("relative_path"), query)).orderBy("file_ord").limit(limit)


def type_detail(types: DataFrame, members: DataFrame, name: str) -> DataFrame:
    """Members of the first type of that name, with is_overload: others of its kind share the name."""
    first = types.filter(F.col("name_lc") == name.lower()).orderBy("file_ord", "type_ord").limit(1).select("type_ord")
    return with_overloads(members.join(F.broadcast(first), "type_ord", "left_semi"))  # one row


def with_overloads(members: DataFrame) -> DataFrame:
    return members.withColumn("is_overload", F.count("*").over(W.partitionBy("type_ord", "kind", "name")) > 1)


def dependencies(dependency_map: DataFrame, name: str) -> DataFrame:
    """direction, name: what the type depends on, and what depends on it. Case counts."""
    pairs = dependency_map.select("name", F.explode("deps").alias("dep"))
    ahead = pairs.filter(F.col("name") == name).select(F.lit("forward").alias("direction"), F.col("dep").alias("name"))
    return ahead.unionByName(pairs.filter(F.col("dep") == name).select(F.lit("reverse").alias("direction"), "name"))


def searched(spark: SparkSession, pattern: str, is_regex: bool = True, case_sensitive: bool = False) -> tuple[str, str | None]:
    """The pattern as scans take it, with classes, word ends and case of all of Unicode, and why it is none, if so: then it is one that nothing matches."""
    text = ("(?U)" if case_sensitive else "(?iU)") + (pattern if is_regex else escaped(pattern))
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException as e:
        return "(?!)", f"Invalid regex pattern: {str(e).splitlines()[0]}"
    return text, None


def with_error(found: DataFrame, error: str | None) -> DataFrame:
    """found with a column error, null, or one row more that has nothing else."""
    found = found.withColumn("error", F.lit(None).cast("string"))
    if error is None:
        return found
    row = [F.lit(error if f.name == "error" else None).cast(f.dataType).alias(f.name) for f in found.schema.fields]
    return found.unionByName(found.sparkSession.range(1).select(*row))


def grep(lines: DataFrame, pattern: str, is_regex: bool = True, case_sensitive: bool = False, context: int = 2, limit: int | None = 50) -> DataFrame:
    """file_ord, line_no, text, at, found, before, after, error: one hit per line, its first match. A pattern that is none gives one row with error alone.

    Context comes from a window over the lines of files that have a hit; other files are dropped before the window's
    shuffle, hits are found in the scan. limit None: all hits."""
    text, error = searched(lines.sparkSession, pattern, is_regex, case_sensitive)
    hit = F.rlike(F.col("text"), F.lit(text))
    shown = ["file_ord", "line_no", "text", F.regexp_instr("text", F.lit(text)).alias("at"), F.regexp_substr("text", F.lit(text)).alias("found")]
    if not context:
        out = lines.filter(hit).select(*shown)
    else:
        with_hits = lines.filter(hit).select("file_ord").distinct()
        w = W.partitionBy("file_ord").orderBy("line_no")
        near = lines.join(with_hits, "file_ord", "left_semi")
        near = near.withColumn("before", F.collect_list("text").over(w.rowsBetween(-context, -1))).withColumn("after", F.collect_list("text").over(w.rowsBetween(1, context)))
        out = near.filter(hit).select(*shown, "before", "after")
    return with_error(out if limit is None else out.orderBy("file_ord", "line_no").limit(limit), error)


def grep_total(lines: DataFrame, pattern: str, is_regex: bool = True, case_sensitive: bool = False, context: int = 2, limit: int = 50) -> DataFrame:
    """The first hits of grep, with total: how many lines match in all, beyond the limit too."""
    every = grep(lines, pattern, is_regex, case_sensitive, 0, None).agg(F.count("file_ord").alias("total"))  # one row
    return grep(lines, pattern, is_regex, case_sensitive, context, limit).crossJoin(every)


def grep_summary(lines: DataFrame, pattern: str, is_regex: bool = True, case_sensitive: bool = False) -> DataFrame:
    """file_ord, n_hits, error, most first. A pattern that is none gives one row with error alone."""
    text, error = searched(lines.sparkSession, pattern, is_regex, case_sensitive)
    found = lines.filter(F.rlike(F.col("text"), F.lit(text))).groupBy("file_ord").agg(F.count("*").alias("n_hits"))
    return with_error(found, error).orderBy(F.desc("n_hits"), "file_ord")


def line_range(lines: DataFrame, file_ord: int, start: int, end: int | None = None) -> DataFrame:
    """Lines start to end, 20 more if no end is given, with white space made visible."""
    rows = lines.filter((F.col("file_ord") == file_ord) & F.col("line_no").between(start, start + 20 if end is None else end))
    return rows.select("file_ord", "line_no", visible_whitespace(F.col("text")).alias("shown"))


def find_file(files: DataFrame, path: str) -> DataFrame:
    """file_ord, relative_path, strategy, status of the files that the first strategy with a result finds.

    1: the relative path, whatever its slashes and case; 2: a bare file name; 3: a path below the root or the workspace's
    name; 4: the path without dots. status: found, or ambiguous if there are several; no row if there is none."""
    wanted, rel = normal_path(F.lit(path)), normal_path(F.col("relative_path"))
    bare = "/" not in path and "\\" not in path
    rules = [rel == wanted, F.lit(bare) & (F.lower("file_name") == F.lower(file_name(F.lit(path))))]
    for c in ("root_directory", "source_workspace"):
        if c in files.columns:
            rules.append(F.concat_ws("/", normal_path(file_name(F.regexp_replace(c, r"[/\\]+$", ""))), rel) == wanted)
    rules.append(rel == normal_path(resolved_path(F.lit(path))))
    strategy = reduce(lambda out, r: out.when(r[1], r[0]), list(enumerate(rules, 1))[1:], F.when(rules[0], 1))
    found = files.select("file_ord", "relative_path", strategy.alias("strategy")).filter("strategy is not null")
    best = found.agg(F.min("strategy").alias("strategy"))
    found = found.join(F.broadcast(best), "strategy")
    n = found.agg(F.count("*").alias("n"))
    return found.crossJoin(n).select("file_ord", "relative_path", "strategy", F.when(F.col("n") > 1, "ambiguous").otherwise("found").alias("status"))


def file_content(files: DataFrame, path: str) -> DataFrame:
    """status, file_ord, relative_path, classification, estimated_tokens, namespace, language, text of the file that find_file finds for
    path; if there are several, the rows are candidates without a text. No row if there is none."""
    found = find_file(files, path)
    about = [F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("classification", "namespace")]
    rows = found.select("file_ord", "status").join(files.select("file_ord", "relative_path", *about, "estimated_tokens", "language", "text"), "file_ord")
    return rows.withColumn("text", F.when(F.col("status") == "found", F.col("text")))


def method_source(members: DataFrame, lines: DataFrame, name: str, type_name: str | None = None) -> DataFrame:
    """member_ord, file_ord, line_no, text of the lines of the method that method_body finds, from the file itself; none if it is ambiguous."""
    one = method_body(members, name, type_name).filter("status = 'found'").select("member_ord", "file_ord", "start_line", "end_line")
    rows = lines.join(F.broadcast(one), "file_ord").filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))  # one row
    return rows.select("member_ord", "file_ord", "line_no", "text")


def method_body(members: DataFrame, name: str, type_name: str | None = None) -> DataFrame:
    """The method of that name: status found with one row, or ambiguous with all candidates if no type is given."""
    rows = members.filter((F.col("name_lc") == name.lower()) & F.col("kind").isin("Method", "Constructor"))
    if type_name:
        return rows.filter(F.lower("type_name") == type_name.lower()).orderBy("member_ord").limit(1).withColumn("status", F.lit("found"))
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(n).withColumn("status", F.when(F.col("n") > 1, "ambiguous").otherwise("found")).drop("n")


def type_or_names(types: DataFrame, members: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """found, name: the members of type_detail; if there is no type of that name, the names of the first types."""
    rows = type_detail(types, members, name).select(F.lit(True).alias("found"), "name")
    if not types.filter(F.col("name_lc") == name.lower()).isEmpty():
        return rows
    return types.orderBy("file_ord", "type_ord").limit(limit).select(F.lit(False).alias("found"), "name")


def semantic_query(members: DataFrame, limit: int | None = 100, **want) -> DataFrame:
    """Members that meet every condition given: is_async, is_static, is_virtual, is_override (true or false), return_type and
    name (parts, any case), kind, access_modifier, missing_docs."""
    for key, value in want.items():
        if value is None:
            continue
        if key in ("return_type", "name"):
            members = members.filter(contains_ci(F.col(key), value))
        elif key == "missing_docs":
            members = members.filter(F.coalesce("xml_doc", F.lit("")) == "") if value else members
        else:
            members = members.filter(F.col(key) == value)
    return members if limit is None else members.orderBy("member_ord").limit(limit)


def semantic_matches(types: DataFrame, members: DataFrame, limit: int = 100, interfaces: bool = False, implements: str | None = None, missing_docs: bool = False, **want) -> DataFrame:
    """name, kind, file_ord, why, total: the first matches, in the order of files, types and members, and how many there are.

    What is asked for adds up: interface types (interfaces), types one of whose interfaces holds a text, case counts (implements),
    members that meet every other condition given (is_async, is_static, is_virtual, return_type as a part, case counts, kind, access_modifier,
    name as a part in any case), and public members without documentation (missing_docs)."""
    place = lambda member, n: [F.col("file_ord"), F.col("type_ord"), F.col("member_ord").cast("long").alias("member_ord") if member else F.lit(-1).cast("long").alias("member_ord"), F.lit(n).alias("rank")]
    rows = []
    if interfaces:
        rows.append(types.filter("kind = 'Interface'").select("name", F.lit("Interface").alias("kind"), F.lit("interface").alias("why"), *place(False, 0)))
    if implements is not None:
        held = F.exists("interfaces", lambda i: i.contains(implements))
        rows.append(types.filter(held).select("name", F.lit("Class").alias("kind"), F.lit("implements").alias("why"), *place(False, 1)))
    full = F.concat_ws(".", "type_name", "name").alias("name")
    asked = {k: v for k, v in want.items() if v is not None}
    if asked:
        hit = F.lit(True)
        for key, value in asked.items():
            hit = hit & (F.col(key).contains(value) if key == "return_type" else contains_ci(F.col(key), value) if key == "name" else F.col(key) == value)
        rows.append(members.filter(hit).select(full, "kind", F.lit("member").alias("why"), *place(True, 2)))
    if missing_docs:
        bare = (F.col("access_modifier") == "public") & (F.coalesce("xml_doc", F.lit("")) == "")
        rows.append(members.filter(bare).select(full, "kind", F.lit("undocumented").alias("why"), *place(True, 3)))
    found = reduce(DataFrame.unionByName, rows) if rows else members.filter("false").select(full, "kind", F.lit("").alias("why"), *place(True, 0))
    total = found.agg(F.count("*").alias("total"))  # one row
    return found.orderBy("file_ord", "type_ord", "member_ord", "rank", "name").limit(limit).crossJoin(total).select("name", "kind", "file_ord", "why", "total")


def stale_files(files: DataFrame, last_edit, seconds: int = 5) -> DataFrame:
    """One row, n_stale: C# files indexed more than seconds before the last edit."""
    before = F.lit(last_edit).cast("timestamp") - F.make_interval(secs=F.lit(seconds))
    return files.filter((F.col("extension") == ".cs") & (F.col("last_indexed_utc") < before)).agg(F.count("*").alias("n_stale"))
