"""Reports as tables of lines. A line has a place (part, group, at, sub) and a text; written in the order of places, the lines are the
report. Lines are made where their rows are and sorted by ranges: no task holds a report. The texts of headings are fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import visible_whitespace
from ..plans import index
from ..tables import USAGE_ORDER

PLACE = ["part", "group", "at", "sub"]
LOCAL_MEMBERS, SHOWN_DEPS = 10, 10


def _at(rows: DataFrame, part: int, line: Column, group=None, at=None, sub=None) -> DataFrame:
    as_is = lambda c, kind, none: F.lit(none).cast(kind) if c is None else (c if isinstance(c, Column) else F.lit(c)).cast(kind)
    return rows.select(F.lit(part).alias("part"), as_is(group, "string", "").alias("group"), as_is(at, "long", 0).alias("at"), as_is(sub, "long", 0).alias("sub"), line.alias("line"))


def _fixed(spark: SparkSession, part: int, *lines: str) -> DataFrame:
    return spark.createDataFrame([(part, "", 0, i, t) for i, t in enumerate(lines)], "part int, group string, at long, sub long, line string")


def _whole(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy(*PLACE)


def write(report: DataFrame, path: str) -> None:
    """Text files whose names are in the order of the report."""
    ordered(report).select("line").write.text(path)


def _thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def _bases() -> Column:
    """Of a row of inherits: a colon and the bases, if any."""
    return F.when(F.size("bases") > 0, F.concat(F.lit(" : "), F.array_join("bases", ", "))).otherwise("")


def chunk_references(chunks: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """chunk_number, refs of the chunks that need types of others: for each other chunk, in order, its number and three names."""
    needs = chunks.join(files.select("file_ord", "dependencies"), "file_ord").select(F.col("chunk_number").alias("chunk"), F.explode("dependencies").alias("name"))
    holds = chunks.join(types.select("file_ord", "name"), "file_ord").select(F.col("chunk_number").alias("chunk"), "name")
    met = index.chunk_crossrefs(needs, holds).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("other", "shown"))).alias("r"))
    return met.select(F.col("chunk").alias("chunk_number"), F.array_join(F.transform("r", lambda x: F.format_string("Chunk %d: %s", x["other"], x["shown"])), "; ").alias("refs"))


def _chunk_facts(chunks: DataFrame, files: DataFrame, types: DataFrame) -> DataFrame:
    """chunk_number, tokens, description, refs (null if none)."""
    tokens = chunks.groupBy("chunk_number").agg(F.sum("estimated_tokens").alias("tokens"))
    return tokens.join(index.chunk_descriptions(chunks, files), "chunk_number", "left").join(chunk_references(chunks, files, types), "chunk_number", "left")


def master_index(name: str, generated: str, files: DataFrame, types: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """The index of a workspace: totals, hierarchy and dependencies by name, files by chunk with key members, chunks.

    files: with classification, dependencies, usings; chunks as index.chunk_files gives them. Names sort by code point; an empty workspace
    has headings alone."""
    spark = files.sparkSession
    total = index.totals(files).crossJoin(index.framework(files, types)).crossJoin(chunks.agg(F.coalesce(F.max("chunk_number"), F.lit(0)).alias("n_chunks")))  # one row each
    facts = F.array(
        F.concat(F.lit("Total Files: "), F.col("n_files")), F.concat(F.lit("Total Chunks: "), F.col("n_chunks")), F.concat(F.lit("Total Tokens: "), _thousands(F.col("total_tokens"))),
        F.concat(F.lit("Framework: "), F.col("framework")), F.lit(""), F.lit("=== TYPE HIERARCHY ==="),
    )
    tree = index.type_hierarchy(types)
    deps = index.dependency_map(types, files).filter(F.size("deps") > 0)
    used = F.concat(F.lit("  → uses: "), F.array_join(F.slice("deps", 1, SHOWN_DEPS), ", "), F.when(F.size("deps") > SHOWN_DEPS, "...").otherwise(""))
    placed = chunks.join(files.select("file_ord", "relative_path", "classification"), "file_ord").join(index.key_members(members), "file_ord", "left")
    row = F.format_string("| %s | %d | %s | %s |", "relative_path", "chunk_number", "classification", F.coalesce("key_members", F.lit("")))
    about = _chunk_facts(chunks, files, types)
    one = F.format_string("Chunk %d: %s (%s tokens)", "chunk_number", F.coalesce("description", F.lit("")), _thousands(F.col("tokens")))
    return _whole([
        _fixed(spark, 0, f"=== WORKSPACE: {name} ===", f"Generated: {generated}"),
        _at(total.select(F.posexplode(facts).alias("i", "t")), 1, F.col("t"), sub=F.col("i")),
        _at(tree, 2, F.concat("name", _bases()), group=F.col("name")),
        _fixed(spark, 3, "", "=== DEPENDENCY MAP ==="),
        _at(deps.select("name", F.posexplode(F.array("name", used)).alias("i", "t")), 4, F.col("t"), group=F.col("name"), sub=F.col("i")),
        _fixed(spark, 5, "", "=== FILE INDEX ===", "| File | Chunk | Type | Key Members |", "|------|-------|------|-------------|"),
        _at(placed, 6, row, at=F.col("chunk_number"), sub=F.col("pos")),
        _fixed(spark, 7, "", "=== CHUNK MANIFEST ==="),
        _at(about, 8, one, at=F.col("chunk_number")),
        _at(about.filter("refs is not null"), 8, F.concat(F.lit("  References: "), F.col("refs")), at=F.col("chunk_number"), sub=1),
    ])


def chunk_texts(chunks: DataFrame, files: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """The lines of every chunk, at: its number: header, types and visible members of its files, texts of its files.

    sub numbers the lines of a part: the file's place in the chunk in the upper bits, then the type's, the member's or the line's.
    Texts are cut at line feeds. Write with write_chunks: a folder for each chunk."""
    bit = lambda n: F.lit(1 << n)
    about = _chunk_facts(chunks, files, types).crossJoin(chunks.agg(F.max("chunk_number").alias("n_chunks")))  # one row
    placed = chunks.join(files.select("file_ord", "relative_path", "file_name", "language", "text"), "file_ord").withColumn("base", F.col("pos") * bit(40))
    names = placed.groupBy("chunk_number").agg(F.sort_array(F.collect_list(F.struct("pos", "file_name"))).alias("f")).select("chunk_number", F.array_join(F.transform("f", lambda x: x["file_name"]), ", ").alias("names"))
    heads = F.array_compact(F.array(
        F.format_string("=== CHUNK %d of %d: %s ===", "chunk_number", "n_chunks", F.coalesce("description", F.lit(""))), F.concat(F.lit("Files in this chunk: "), F.col("names")),
        F.when(F.col("refs").isNotNull(), F.concat(F.lit("See also: "), F.col("refs"))), F.lit(""), F.lit("=== LOCAL INDEX ==="),
    ))
    own = placed.select("chunk_number", "file_ord", "base")
    at_type = own.join(index.inherits(types), "file_ord").withColumn("base", F.col("base") + (F.col("type_ord") - F.min("type_ord").over(_by("file_ord")) + 1) * bit(12))
    visible = F.col("access_modifier").isin("public", "internal")
    ranked = members.withColumn("_k", F.row_number().over(_by("type_ord").orderBy(visible.cast("int").desc(), "member_ord"))).withColumn("_n", F.count("*").over(_by("type_ord"))).withColumn("_v", F.least(F.count_if(visible).over(_by("type_ord")), F.lit(LOCAL_MEMBERS)))
    ranked = ranked.filter((F.col("_k") <= F.col("_v")) | ((F.col("_k") == F.col("_v") + 1) & (F.col("_n") > F.col("_v"))))
    shown = F.concat(F.lit("    - "), F.when(F.coalesce("signature", F.lit("")) != "", F.col("signature")).otherwise(F.col("name")), F.when(F.coalesce("return_type", F.lit("")) != "", F.concat(F.lit(" : "), F.col("return_type"))).otherwise(""))
    more = F.format_string("    - ... (%d more members)", F.col("_n") - F.col("_v"))
    listed = ranked.select("type_ord", F.col("_k").alias("k"), F.when(F.col("_k") <= F.col("_v"), shown).otherwise(more).alias("t"))
    fence = placed.select("chunk_number", "base", F.concat(F.array(F.format_string("// --- %s ---", "relative_path"), F.concat(F.lit("```"), F.col("language"))), F.split(F.coalesce("text", F.lit("")), "\n"), F.array(F.lit("```"), F.lit(""))).alias("t"))
    n = F.col("chunk_number")
    return _whole([
        _at(about.join(names, "chunk_number").select("chunk_number", F.posexplode(heads).alias("i", "t")), 0, F.col("t"), at=n, sub=F.col("i")),
        _at(placed, 1, F.col("relative_path"), at=n, sub=F.col("base")),
        _at(at_type, 1, F.concat(F.lit("  "), F.lower("kind"), F.lit(" "), "name", _bases()), at=n, sub=F.col("base")),
        _at(at_type.select("chunk_number", "base", "type_ord").join(listed, "type_ord"), 1, F.col("t"), at=n, sub=F.col("base") + F.col("k")),
        _at(placed, 1, F.lit(""), at=n, sub=F.col("base") + (bit(40) - 1)),
        _at(about.select("chunk_number", F.posexplode(F.array(F.lit("=== FILES ==="), F.lit(""))).alias("i", "t")), 2, F.col("t"), at=n, sub=F.col("i")),
        _at(fence.select("chunk_number", "base", F.posexplode("t").alias("i", "t")), 3, F.col("t"), at=n, sub=F.col("base") + F.col("i")),
    ])


def _by(column: str):
    from pyspark.sql import Window as W

    return W.partitionBy(column)


def write_chunks(texts: DataFrame, root: str) -> None:
    """root/chunk=n/: the text of each chunk. A chunk is bounded by its limit of tokens, so one task writes it."""
    rows = texts.withColumn("chunk", F.col("at")).repartition("chunk").sortWithinPartitions("chunk", "part", "group", "sub")
    rows.select("chunk", "line").write.partitionBy("chunk").text(root)


def usages_report(usages: DataFrame, name: str, mode: str = "heuristic") -> DataFrame:
    """usages(usage_kind, file_path, line, context) by kind, each by path and line."""
    spark = usages.sparkSession
    kind = F.array_position(F.array(*map(F.lit, USAGE_ORDER)), F.col("usage_kind"))
    total = usages.agg(F.count("*").alias("n"))
    rows = usages.withColumn("k", F.when(kind > 0, kind).otherwise(len(USAGE_ORDER) + 1))
    heads = rows.groupBy("k").agg(F.min("usage_kind").alias("kind"))
    # part 2k: heading of a kind, then its usages; an empty line ends each.
    spread = lambda df, line, group, at, sub: df.select((F.col("k") * 2 + sub).cast("int").alias("part"), group.alias("group"), at.cast("long").alias("at"), F.lit(0).cast("long").alias("sub"), line.alias("line"))
    none, zero = F.lit(""), F.lit(0)
    return _whole([
        _fixed(spark, 0, f"# Usages of `{name}`", ""),
        _at(total.select(F.posexplode(F.array(F.format_string("**Total:** %d usages — **Resolution:** %s", "n", F.lit(mode)), F.lit(""))).alias("i", "t")), 1, F.col("t"), sub=F.col("i")),
        spread(heads, F.concat(F.lit("## "), F.col("kind")), none, F.lit(-1), 0),
        spread(rows, F.format_string("- `%s:%d` - %s", F.coalesce("file_path", F.lit("")), "line", F.coalesce("context", F.lit(""))), F.coalesce("file_path", none), F.col("line"), 0),
        spread(heads, none, none, zero, 1),
    ])


def call_graph_report(callers: DataFrame, callees: DataFrame, name: str, hops: DataFrame | None = None) -> DataFrame:
    """Callers and callees(type, method, site_ord, file_path, line) in order of sites; under a caller its own, from
    hops(via_type, via_method, type, method)."""
    spark = callers.sparkSession
    line = F.format_string("- `%s.%s` (%s:%d)", "type", "method", F.coalesce("file_path", F.lit("")), "line")
    empty = lambda df, part, text: _at(df.agg(F.count("*").alias("n")).filter("n = 0"), part, F.lit(text))
    parts = [
        _fixed(spark, 0, f"# Call Graph: `{name}`", "", "## Callers (who calls this)"),
        _at(callers, 1, line, at=F.col("site_ord"), group=F.lit("")),
        empty(callers, 1, "*No callers found (entry point or unused)*"),
        _fixed(spark, 2, "", "## Callees (what this calls)"),
        _at(callees, 3, line, at=F.col("site_ord")),
        empty(callees, 3, "*No outgoing calls*"),
    ]
    if hops is not None:
        above = callers.select(F.col("type").alias("via_type"), F.col("method").alias("via_method"), "site_ord")
        rows = hops.join(above, ["via_type", "via_method"])
        rows = rows.withColumn("k", F.row_number().over(_by("site_ord").orderBy("type", "method")))
        parts.append(_at(rows, 1, F.format_string("  ← %s.%s", "type", "method"), at=F.col("site_ord"), sub=F.col("k")))
    return _whole(parts)


def grep_summary_report(counts: DataFrame, pattern: str, n_searched: int, is_regex: bool = True, case_sensitive: bool = False) -> DataFrame:
    """counts(file_path, n_hits), most hits first, ties by path."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n_hits"), F.lit(0)).alias("hits"), F.count("*").alias("files"))
    heads = F.array(
        F.format_string("**Total matches:** %d in %d files", "hits", "files"), F.lit(f"**Files searched:** {n_searched}"), F.lit(f"**Options:** Regex={is_regex}, CaseSensitive={case_sensitive}"), F.lit(""),
    )
    table = F.when(F.col("files") > 0, F.array(F.lit("| File | Matches |"), F.lit("|------|---------|"))).otherwise(F.array(F.lit("*No matches found.*")))
    return _whole([
        _fixed(spark, 0, f"# Search Summary: `{pattern}`", ""),
        _at(total.select(F.posexplode(F.concat(heads, table)).alias("i", "t")), 1, F.col("t"), sub=F.col("i")),
        counts.select(F.lit(2).alias("part"), F.lit("").alias("group"), (-F.col("n_hits")).cast("long").alias("at"), F.dense_rank().over(_by("n_hits").orderBy("file_path")).cast("long").alias("sub"), F.format_string("| `%s` | %d |", "file_path", "n_hits").alias("line")),
    ])


def grep_report(hits: DataFrame, pattern: str) -> DataFrame:
    """hits(file_ord, file_path, line_no, text, found, before, after) by file and line, white space made visible."""
    seen = lambda c: F.transform(c, lambda x: visible_whitespace(x))
    block = F.concat(
        F.array(F.format_string("**Line %d:** matched `%s`", "line_no", "found"), F.lit("```")), seen("before"), F.array(F.concat(F.lit("> "), visible_whitespace(F.col("text")))), seen("after"), F.array(F.lit("```"), F.lit("")),
    )
    rows = hits.select("file_ord", "line_no", F.posexplode(block).alias("i", "t"))
    place = F.lpad(F.col("file_ord").cast("string"), 19, "0")
    heads = hits.groupBy("file_ord").agg(F.min("file_path").alias("file_path")).select("file_ord", F.posexplode(F.array(F.format_string("## `%s`", "file_path"), F.lit(""))).alias("i", "t"))
    total = hits.agg(F.count("*").alias("n"), F.countDistinct("file_ord").alias("files"))
    return _whole([
        _fixed(hits.sparkSession, 0, f"# Search Results: `{pattern}`", ""),
        _at(total.select(F.posexplode(F.array(F.format_string("**Found:** %d matches in %d files", "n", "files"), F.lit(""))).alias("i", "t")), 1, F.col("t"), sub=F.col("i")),
        _at(heads, 2, F.col("t"), group=place, at=0, sub=F.col("i")),
        _at(rows, 2, F.col("t"), group=place, at=F.col("line_no"), sub=F.col("i")),
    ])


def impact_report(impact: DataFrame, summary: DataFrame, symbol: str) -> DataFrame:
    """impact as impact.blast_radius gives it, by level, file and line; summary as impact.summary does."""
    tag = F.when(F.col("is_test"), " [test]").when(F.col("is_external"), " [external]").otherwise("")
    kind = F.when(F.col("kind") != "caller", F.concat(F.lit(" ("), F.col("kind"), F.lit(")"))).otherwise("")
    row = F.concat(F.format_string("- `%s:%d` — `%s`", F.coalesce("file", F.lit("")), "line", "name"), kind, tag)
    levels = impact.groupBy("depth").agg(F.count("*").alias("n"))
    heads = F.array(
        F.format_string("## Risk: **%s** (score: %s/10)", "risk_level", F.col("risk_score").cast("string")), F.lit(""), F.format_string("**Total impact:** %d symbols across %d depth levels", "affected", "levels"),
    )
    heads = F.concat(heads, F.when(F.col("tests") > 0, F.array(F.format_string("**Tests found:** %d", "tests"))).otherwise(F.array()), F.array(F.lit("")))
    bullets = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), F.transform(c, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    last = F.concat(bullets("## Risk Factors", "factors"), bullets("## Suggested Actions", "actions"))
    by_level = lambda rows, line, group, at, sub: rows.select((F.lit(10) + F.col("depth") * 2 + sub).cast("int").alias("part"), group.alias("group"), at.cast("long").alias("at"), F.lit(0).cast("long").alias("sub"), line.alias("line"))
    none = F.lit("")
    return _whole([
        _fixed(impact.sparkSession, 0, f"# Blast Radius: `{symbol}`", ""),
        _at(summary.select(F.posexplode(heads).alias("i", "t")), 1, F.col("t"), sub=F.col("i")),
        by_level(levels, F.format_string("## Depth %d — %d symbols", "depth", "n"), none, F.lit(-1), 0),
        by_level(impact, row, F.coalesce("file", none), F.col("line"), 0),
        by_level(levels, none, none, F.lit(0), 1),
        _at(summary.select(F.posexplode(last).alias("i", "t")), 99, F.col("t"), sub=F.col("i")),
    ])


def context_report(selected: DataFrame, task: str, words: list[str], tips: list[str] = ()) -> DataFrame:
    """selected(file_ord, relative_path, score, estimated_tokens, reasons), best first, ties by ord: bounded by the budget of files."""
    from pyspark.sql import Window as W

    rows = selected.withColumn("k", F.row_number().over(W.orderBy(F.desc("score"), "file_ord")))
    why = F.when(F.size("reasons") > 0, F.array_join(F.slice("reasons", 1, 2), "; ")).otherwise("-")
    row = F.format_string("| %d | `%s` | %.1f | %s | %s |", "k", "relative_path", "score", _thousands(F.col("estimated_tokens")), why)
    total = selected.agg(F.coalesce(F.sum("estimated_tokens"), F.lit(0)).alias("n"))
    known = ["## Detected Keywords", ", ".join(f"`{w}`" for w in words), ""] if words else []
    advice = ["## Suggestions", *[f"- {t}" for t in tips], ""] if tips else []
    return _whole([
        _fixed(selected.sparkSession, 0, "# Context Analysis for Task", "", f"**Task:** {task}", ""),
        _at(total, 1, F.concat(F.lit("**Total Tokens:** "), _thousands(F.col("n")))),
        _fixed(selected.sparkSession, 2, "", *known, *advice, "## Relevant Files (by relevance)", "", "| # | File | Score | Tokens | Reasons |", "|---|------|-------|--------|---------|"),
        _at(rows, 3, row, at=F.col("k")),
    ])
