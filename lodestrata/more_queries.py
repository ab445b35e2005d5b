"""More operators over the driver's tables: sources, edits, maintenance, telemetry and reports, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .operators import buildlog, edits, lookup, rules, symbols, telemetry
from .plans import adapters as A
from .plans import index, shared, store
from .queries import CALLS, FILES, LINES, MEMBERS, ORACLE_SQL, QUERIES, SITES, TYPES, WORD_PATTERN, query
from .sinks import export, reports
from .sources import files as scans
from .sources import logs

__all__ = ["ORACLE_SQL", "QUERIES"]

BRAND = "CAST(regexp_extract(type_name, '([0-9]+)$', 1) AS BIGINT)"
# Documents as files of a project: some are solutions, projects or entry points.
PROJECT = f"""(SELECT file_ord, CASE file_ord % 7 WHEN 0 THEN '' ELSE namespace || '/' END || CASE WHEN file_ord % 11 = 0 THEN 'Program.cs' ELSE 'f' || CAST(file_ord AS VARCHAR) || CASE file_ord % 5 WHEN 0 THEN '.csproj' WHEN 1 THEN '.sln' ELSE '.cs' END END AS relative_path FROM {FILES})"""


def _project(spark, d):
    i = F.col("file_ord")
    name = F.when(i % 11 == 0, "Program.cs").otherwise(F.concat(F.lit("f"), i.cast("string"), F.when(i % 5 == 0, ".csproj").when(i % 5 == 1, ".sln").otherwise(".cs")))
    rows = A.document_files(spark, d).select("file_ord", F.concat(F.when(i % 7 == 0, "").otherwise(F.concat("namespace", F.lit("/"))), name).alias("relative_path"))
    return rows.withColumn("file_name", T.file_name(F.col("relative_path"))).withColumn("extension", T.extension(F.col("relative_path")))


@query(f"SELECT count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, CAST(floor(sum(size_bytes) / 4) AS BIGINT) AS estimated_tokens FROM {FILES}")
def scan_totals(spark, d):
    return scans.scan_totals(A.document_files(spark, d))


@query(f"SELECT file_ord FROM {FILES} WHERE language <> 'fr' AND language <> 'de'")
def scan_filter(spark, d):
    return A.document_files(spark, d).filter(scans.accepted(F.col("relative_path"), [".TXT", ".md"], ["FR", "de"])).select("file_ord")


@query(rf"SELECT file_ord FROM {FILES} WHERE namespace = 'src1' OR regexp_matches(relative_path, '^src2/[^/]*/1[^/]*\.txt$') OR regexp_matches(relative_path, '^src3/.*7\.txt$') OR language = 'es'")
def ignored_files(spark, d):
    return A.document_files(spark, d).filter(scans.ignored_by(F.col("relative_path"), ["src1/", "/src2/*/1*.txt", "src3/**7.txt", "es"])).select("file_ord")


@query(f"SELECT namespace, count(*) AS n_files FROM {FILES} GROUP BY namespace")
def namespace_counts(spark, d):
    return index.namespace_counts(A.document_files(spark, d))


@query(f"SELECT file_ord, relative_path FROM {PROJECT} WHERE relative_path LIKE '%Program.cs' OR relative_path LIKE '%.csproj' ORDER BY file_ord LIMIT 10")
def entry_points(spark, d):
    return index.entry_points(_project(spark, d)).select("file_ord", "relative_path")


@query(f"SELECT file_ord, relative_path FROM {PROJECT} WHERE relative_path LIKE '%.csproj' OR (relative_path LIKE '%.sln' AND NOT contains(relative_path, '/'))")
def build_targets(spark, d):
    return index.build_targets(_project(spark, d)).select("file_ord", "relative_path")


@query(
    f"""WITH r AS (SELECT CASE WHEN file_ord % 3 = 0 THEN 'out/x' || CAST(file_ord % 9 AS VARCHAR) || '.csproj' ELSE relative_path END AS resolved_path, CAST(file_ord % 4 AS VARCHAR) AS p FROM {PROJECT})
SELECT resolved_path, string_agg(DISTINCT p, ', ' ORDER BY p) AS used_by, lower(resolved_path) NOT IN (SELECT lower(relative_path) FROM {PROJECT}) AS is_external FROM r GROUP BY resolved_path"""
)
def project_references(spark, d):
    files, i = _project(spark, d), F.col("file_ord")
    path = F.when(i % 3 == 0, F.concat(F.lit("out/x"), (i % 9).cast("string"), F.lit(".csproj"))).otherwise(F.col("relative_path"))
    refs = files.select(path.alias("resolved_path"), (i % 4).cast("string").alias("source_project"))
    return index.bound_project_refs(refs, files).select("resolved_path", F.array_join("used_by", ", ").alias("used_by"), "is_external")


@query(
    f"""WITH k AS (SELECT {BRAND} AS file_ord, name, row_number() OVER (PARTITION BY {BRAND} ORDER BY member_ord) AS k FROM {MEMBERS} WHERE access_modifier = 'public' AND kind = 'Method'),
s AS (SELECT file_ord, string_agg(name, ', ' ORDER BY k) AS s FROM k WHERE k <= 3 GROUP BY file_ord) SELECT file_ord, CASE WHEN length(s) > 50 THEN substr(s, 1, 47) || '...' ELSE s END AS key_members FROM s"""
)
def key_members(spark, d):
    return index.key_members(A.part_members(spark, d).withColumn("signature", F.col("name")))


@query("SELECT directory, string_agg(name, ', ' ORDER BY ord, name) AS tags FROM (SELECT DISTINCT l_suppkey AS directory, l_returnflag AS name, CASE l_returnflag WHEN 'R' THEN 0 ELSE 1 END AS ord FROM lineitem) GROUP BY directory")
def merged_workspaces(spark, d):
    rows = A.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name")).agg(F.collect_set("l_suppkey").alias("directories"))
    return index.merged_workspaces(rows.select(F.when(F.col("name") == "R", 0).otherwise(1).alias("ord"), "name", "directories"))


@query("SELECT name, CASE WHEN base_type = '' THEN '' WHEN iface IS NULL THEN base_type ELSE base_type || ',' || iface END AS deps FROM " + TYPES)
def dependency_map(spark, d):
    return index.dependency_map(A.chain_types(spark, d)).select("name", F.array_join("deps", ",").alias("deps"))


@query(
    f"""SELECT 'f' || CAST(l_orderkey AS VARCHAR) AS file_path, l_orderkey AS ord FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber = 1
UNION ALL SELECT 'f' || CAST(o_orderkey AS VARCHAR), -1 FROM orders WHERE o_orderkey % 3 = 0"""
)
def index_upsert(spark, d):
    path = lambda c: F.concat(F.lit("f"), F.col(c).cast("string")).alias("file_path")
    table = A.read(spark, d, "lineitem").filter("l_linenumber = 1").select(path("l_orderkey"), F.col("l_orderkey").alias("ord"))
    rows = A.read(spark, d, "orders").filter("o_orderkey % 3 = 0").select(path("o_orderkey"), F.lit(-1).cast("long").alias("ord"))
    return index.upserted(table, rows)


@query("SELECT item_id FROM benchmark WHERE contains(lower(text), 'the ')")
def topic_search(spark, d):
    manual = A.read(spark, d, "benchmark").select("item_id", F.lit("k").alias("key"), F.lit("item").alias("title"), F.col("text").alias("content"))
    return index.topics(manual, "THE ").select("item_id")


@query(f"SELECT member_ord, CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM {MEMBERS} WHERE lower(name) = 'cold_widget' AND kind IN ('Method', 'Constructor')")
def method_body(spark, d):
    return lookup.method_body(A.part_members(spark, d), "Cold_Widget").select("member_ord", "status")


@query(f"SELECT member_ord, kind, name, count(*) OVER (PARTITION BY kind, name) > 1 AS is_overload FROM {MEMBERS} WHERE type_name = 'Brand#13'")
def type_detail(spark, d):
    members = A.part_members(spark, d)
    types = members.select("type_ord", "file_ord", F.lower("type_name").alias("name_lc")).distinct()
    return lookup.type_detail(types, members, "BRAND#13").select("member_ord", "kind", "name", "is_overload")


@query("SELECT count(*) AS n_stale FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-12-31 23:59:58'")
def stale_files(spark, d):
    files = A.read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", ".cs").otherwise(".py").alias("extension"), F.col("o_orderdate").alias("last_indexed_utc"))
    return lookup.stale_files(files, "1998-01-01 00:00:03")


@query(
    """WITH r AS (SELECT l_orderkey % 1000 AS file, l_linenumber AS line, min(l_orderkey) AS ord FROM lineitem GROUP BY 1, 2)
SELECT file, line, ord FROM r UNION ALL SELECT o_orderkey % 2000, 3, -o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE file = o_orderkey % 2000 AND line = 3)"""
)
def resolved_usages(spark, d):
    refs = A.read(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_orderkey").alias("ord"))
    inheritance = A.read(spark, d, "orders").select((F.col("o_orderkey") % 2000).alias("file"), F.lit(3).alias("line"), (-F.col("o_orderkey")).alias("ord"))
    return symbols.resolved_usages(refs, inheritance)


@query(f"SELECT member_ord, kind FROM {MEMBERS} WHERE name = 'cold_widget' ORDER BY kind <> 'Field', member_ord LIMIT 1")
def symbol_lookup(spark, d):
    return symbols.symbol_by_name(A.part_members(spark, d).withColumn("ord", F.col("member_ord")), "cold_widget", "Field").select("member_ord", "kind")


NAMES = "(SELECT p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'Microsoft.' WHEN 1 THEN 'System.' ELSE '' END || p_type || repeat('x', p_size % 5) AS namespace FROM part)"


@query(f"SELECT namespace FROM {NAMES} WHERE name = 'cold widget' ORDER BY CASE WHEN namespace LIKE 'System%' THEN 0 WHEN namespace LIKE 'Microsoft%' THEN 1 ELSE 2 END, length(namespace), namespace LIMIT 1")
def namespace_choice(spark, d):
    k = F.col("p_partkey") % 3
    ns = F.concat(F.when(k == 0, "Microsoft.").when(k == 1, "System.").otherwise(""), "p_type", F.repeat(F.lit("x"), F.col("p_size") % 5))
    return symbols.namespace_for_type(A.read(spark, d, "part").select(F.col("p_name").alias("name"), ns.alias("namespace")), "cold widget")


@query(f"SELECT member_ord, string_split(name, '_')[-1] AS parameter FROM {MEMBERS} WHERE access_modifier = 'public' AND kind IN ('Method', 'Constructor') AND member_ord % 4 <> 0 AND member_ord % 6 <> 0")
def null_checks(spark, d):
    last, i = F.element_at(F.split("name", "_"), -1), F.col("member_ord")
    body = F.when(i % 4 == 0, F.concat(F.lit("Guard.ThrowIfNull("), last, F.lit(");"))).when(i % 6 == 0, F.concat(F.lit("if ("), last, F.lit(" == null) return;"))).otherwise("return;")
    return rules.unchecked_parameters(A.part_members(spark, d).withColumn("body", body)).select("member_ord", "parameter")


@query(
    """SELECT CAST(n_nationkey AS BIGINT) AS type_ord, n_name || 'Service' AS name, count(*) AS n_members FROM nation JOIN customer ON c_nationkey = n_nationkey
WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 AND c_custkey % 2 = 0 AND c_custkey % 3 = 0 GROUP BY 1, 2"""
)
def missing_interfaces(spark, d):
    i = F.col("n_nationkey")
    name = F.when(i % 2 == 0, F.concat("n_name", F.lit("Service"))).otherwise(F.col("n_name"))
    types = A.read(spark, d, "nation").select(i.cast("long").alias("type_ord"), i.cast("long").alias("file_ord"), name.alias("name"), F.lower(name).alias("name_lc"), F.lit("Class").alias("kind"), F.when(i % 3 == 0, F.array(F.concat(F.lit("I"), name))).otherwise(F.array().cast("array<string>")).alias("interfaces"))
    k = F.col("c_custkey")
    members = A.read(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("type_ord"), F.col("c_name").alias("name"), F.when(k % 2 == 0, "public").otherwise("private").alias("access_modifier"), F.when(k % 3 == 0, "Method").otherwise("Field").alias("kind"))
    return rules.missing_interfaces(types, members).select("type_ord", "name", "n_members")


NL = "chr(10)"


@query(
    f"""SELECT {BRAND} AS type_ord, '    /// <summary>' || {NL} || '    /// Interface for ' || type_name || {NL} || '    /// </summary>' || {NL} || '    public interface I' || type_name || {NL} || '    {{' || {NL}
  || string_agg(CASE kind WHEN 'Method' THEN '        ' || return_type || ' ' || name || '();' ELSE '        ' || return_type || ' ' || name || ' {{ get; set; }}' END, {NL} ORDER BY member_ord) || {NL} || '    }}' AS code
FROM {MEMBERS} WHERE access_modifier = 'public' AND kind IN ('Method', 'Property') GROUP BY 1, type_name"""
)
def generated_interfaces(spark, d):
    members = A.part_members(spark, d).withColumn("signature", F.concat("name", F.lit("()")))
    return edits.interface_text(members, F.concat(F.lit("I"), "type_name"))


@query(
    f"""WITH s AS (SELECT {BRAND} AS type_ord, type_name, string_agg(CASE kind WHEN 'Method' THEN '        public ' || return_type || ' ' || name || '()' || {NL} || '        {{' || {NL} || '            throw new NotImplementedException();' || {NL} || '        }}' || {NL}
  WHEN 'Property' THEN '        public ' || return_type || ' ' || name || ' {{ get; set; }}' || {NL} END, {NL} ORDER BY member_ord) AS b FROM {MEMBERS} GROUP BY 1, 2)
SELECT type_ord, '        #region ' || type_name || ' Implementation' || {NL} || {NL} || coalesce(b, '') || {NL} || '        #endregion' AS code FROM s"""
)
def generated_stubs(spark, d):
    return edits.implementation_text(A.part_members(spark, d).withColumn("signature", F.lit(None).cast("string")))


@query(
    f"""WITH f AS (SELECT {BRAND} AS type_ord, type_name, member_ord, return_type AS t, '_' || upper(name) AS n, upper(name) AS a FROM {MEMBERS} WHERE kind IN ('Field', 'Property') AND NOT is_static)
SELECT type_ord, '        public ' || type_name || '(' || {NL} || string_agg('            ' || t || ' ' || a, ',' || {NL} ORDER BY member_ord) || {NL} || '        )' || {NL} || '        {{' || {NL} || string_agg('            ' || n || ' = ' || a || ';', {NL} ORDER BY member_ord) || {NL} || '        }}' AS code
FROM f GROUP BY type_ord, type_name"""
)
def generated_constructors(spark, d):
    return edits.constructor_text(A.part_members(spark, d).withColumn("name", F.concat(F.lit("_"), F.upper("name"))))


@query(
    f"""WITH l AS (SELECT line_no, text FROM {LINES} WHERE file_ord = 5), m AS (SELECT max(line_no) AS last FROM l), p AS (SELECT repeat(' ', length(regexp_extract(text, '^(\\s*)', 1))) AS pad FROM l WHERE line_no = 1),
a AS (SELECT 1 AS spot, 0 AS sub, 0 AS own, pad || 'var r = Part(a, b);' AS text FROM p
UNION ALL SELECT last, -6, 0, '' FROM m UNION ALL SELECT last, -5, 0, pad || 'private int Part(string a, long b)' FROM m, p UNION ALL SELECT last, -4, 0, pad || '{{' FROM m, p
UNION ALL SELECT last, -4, line_no, text FROM l, m WHERE line_no <= 2 UNION ALL SELECT last, -3, 0, '' FROM m UNION ALL SELECT last, -2, 0, pad || '    return r;' FROM m, p UNION ALL SELECT last, -1, 0, pad || '}}' FROM m, p
UNION ALL SELECT last, 0, 0, '' FROM m UNION ALL SELECT line_no, 1, 0, text FROM l WHERE line_no > 2)
SELECT CAST(5 AS BIGINT) AS file_ord, CAST(row_number() OVER (ORDER BY spot, sub, own) AS INTEGER) AS line_no, text FROM a"""
)
def extract_method(spark, d):
    return edits.extract_method(A.document_lines(spark, d), 5, 1, 2, "Part", [("string", "a"), ("long", "b")], ("int", "r"))


@query(f"SELECT file_ord, n_found, CASE n_found WHEN 1 THEN 'replaced' WHEN 0 THEN 'not found' ELSE 'ambiguous' END AS status FROM (SELECT file_ord, CAST((length(t) - length(replace(t, 'icensed under', ''))) / 13 AS INTEGER) AS n_found FROM (SELECT file_ord, replace(text, chr(13) || chr(10), chr(10)) AS t FROM {FILES}))")
def replace_once(spark, d):
    return edits.replace_once(A.document_files(spark, d), "icensed under", "ICENSED UNDER").select("file_ord", "n_found", "status")


@query(f"SELECT file_ord, CAST(line_no + 2 AS INTEGER) AS line_no, text FROM {LINES} WHERE file_ord = 5 AND line_no > 1 UNION ALL VALUES (5, 1, 'one'), (5, 2, 'two'), (5, 3, 'three')")
def replace_lines(spark, d):
    return edits.replace_lines(A.document_lines(spark, d), 5, 1, 1, ["one", "two", "three"])


WORDS = f"(SELECT file_ord, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM {FILES})"


def _words(spark, d):
    return A.document_files(spark, d).select("file_ord", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("token"))


@query(f"SELECT file_ord, count(*) AS n_found FROM {WORDS} WHERE token = 'the' GROUP BY file_ord")
def rename_preview(spark, d):
    return edits.rename_preview(_words(spark, d), "the")


@query(f"SELECT count(DISTINCT kind) AS n_kinds, count(DISTINCT kind) > 1 AS ambiguous FROM {MEMBERS} WHERE name = 'cold_widget'")
def rename_ambiguity(spark, d):
    return edits.rename_ambiguity(A.part_members(spark, d), "cold_widget")


@query(f"SELECT file_ord, string_agg(DISTINCT token, ', ' ORDER BY token) AS names, 'a.b' AS old_namespace, 'a.c' AS new_namespace FROM {WORDS} WHERE token IN ('The', 'under') AND file_ord <> 1 GROUP BY file_ord")
def move_impact(spark, d):
    types = spark.createDataFrame([(1, "The"), (1, "under"), (2, "of")], "file_ord long, name string")
    found = edits.move_impact(_words(spark, d), types, 1, "a/b/T.cs", "a/c/T.cs")
    return found.withColumn("names", F.array_join("names", ", "))


@query(f"SELECT CAST(orderkey AS VARCHAR) AS file_path, count(*) AS n_sites, CASE WHEN orderkey % 2 = 0 THEN 2 ELSE 0 END AS n_text FROM {SITES} WHERE called_method = 'm11' GROUP BY orderkey")
def parameter_impact(spark, d):
    k = F.col("o_orderkey")
    files = A.read(spark, d, "orders").select(k.cast("string").alias("file_path"), F.when(k % 2 == 0, "m11(a); xm11(b); m11 (c)").otherwise("m110(a)").alias("text"))
    return edits.parameter_impact(A.part_call_sites(spark, d), files, "m11")


@query(
    """SELECT event_id AS ord, 'error' AS severity, 'F' || CAST(user_id AS VARCHAR) || '.cs' AS file_path, CAST(event_id % 100 AS INTEGER) AS line, 'CS1002' AS error_code, '; expected ' || CAST(user_id AS VARCHAR) AS message FROM events WHERE event_type = 'error'
UNION ALL SELECT min(event_id), 'error', '', 0, 'MSB1', 'broken ' || CAST(user_id % 7 AS VARCHAR) FROM events WHERE event_type = 'signup' GROUP BY user_id % 7"""
)
def build_messages(spark, d):
    s = lambda c: F.col(c).cast("string")
    placed = F.concat(F.lit("src/F"), s("user_id"), F.lit(".cs("), (F.col("event_id") % 100).cast("string"), F.lit(",4): error CS1002: ; expected "), s("user_id"))
    value = F.when(F.col("event_type") == "error", placed).when(F.col("event_type") == "signup", F.concat(F.lit("  error MSB1: broken "), (F.col("user_id") % 7).cast("string"))).otherwise("  restored")
    return logs.build_messages(A.read(spark, d, "events").select(F.col("event_id").alias("ord"), value.alias("value"))).select("ord", "severity", "file_path", "line", "error_code", "message")


DIAGNOSTICS = "(SELECT CAST(user_id AS VARCHAR) AS file_path, CAST(event_id AS INTEGER) AS line, event_type AS severity FROM events)"


def _diagnostics(spark, d):
    return A.read(spark, d, "events").select(F.col("user_id").cast("string").alias("file_path"), F.col("event_id").cast("int").alias("line"), F.lit(1).alias("column"), F.lit("m").alias("message"), F.col("event_type").alias("severity"))


@query(f"SELECT file_path, line FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line) AS k FROM {DIAGNOSTICS}) WHERE k <= 5 ORDER BY file_path, line LIMIT 30")
def capped_diagnostics(spark, d):
    return buildlog.capped_diagnostics(_diagnostics(spark, d)).select("file_path", "line")


@query(f"SELECT severity, count(*) AS n FROM {DIAGNOSTICS} GROUP BY severity")
def severity_counts(spark, d):
    return buildlog.severity_counts(_diagnostics(spark, d))


@query("SELECT c_custkey % 10 AS bucket, min(c_custkey) AS first, CASE c_custkey % 2 WHEN 0 THEN 'missing_semicolon' ELSE 'missing_using' END AS category FROM customer WHERE c_custkey % 5 <> 4 GROUP BY 1, 3")
def heal_selection(spark, d):
    k = F.col("c_custkey")
    code = F.when(k % 5 == 4, "CS8602").when(k % 2 == 0, "CS1002").otherwise("CS0246")
    rows = A.read(spark, d, "customer").select((k % 10).alias("bucket"), (k % 10).cast("string").alias("file_path"), F.lit(3).alias("line"), k.alias("column"), code.alias("error_code"), F.lit("The type 'List' is missing").alias("message"))
    return buildlog.fixes(buildlog.classified(rows)).select("bucket", F.col("column").alias("first"), "category")


@query("SELECT directory, n_files, n_bytes, oldest FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS directory, count(*) AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS n_bytes, min(o_orderdate) AS oldest FROM orders GROUP BY 1) ORDER BY n_files DESC, directory LIMIT 5")
def top_backup_folders(spark, d):
    rows = A.read(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("directory"), F.col("o_orderkey").alias("size"), F.col("o_orderdate").alias("mtime"))
    return telemetry.top_backup_folders(rows)


@query(f"SELECT CAST(count(*) AS VARCHAR) || ' calls | avg ' || CAST(CAST(round(avg(duration_ms)) AS BIGINT) AS VARCHAR) || 'ms | ' || CAST(count(*) FILTER (WHERE is_error) AS VARCHAR) || ' errors' AS summary FROM {CALLS}")
def session_summary(spark, d):
    return telemetry.session_summary(A.event_calls(spark, d))


@query("SELECT event_id AS ord, 'w' || CAST(user_id AS VARCHAR) AS workspace, event_type AS tool_name, CAST(floor(value) AS BIGINT) AS duration_ms FROM events WHERE event_type IN ('click', 'view')")
def activity_facts(spark, d):
    kind = F.when(F.col("event_type") == "click", "COMPLETED").when(F.col("event_type") == "view", "COMPLETED").when(F.col("event_type") == "error", "ERROR").otherwise("INDEXED")
    line = F.concat(F.lit("w"), F.col("user_id").cast("string"), F.lit("|"), kind, F.lit("|"), F.col("event_type"), F.lit("|"), F.floor("value").cast("string"), F.lit("ms"))
    rows = telemetry.parse_activity(A.read(spark, d, "events").select(F.col("event_id").alias("ord"), line.alias("value")))
    return telemetry.tool_calls(rows).select("ord", "workspace", "tool_name", "duration_ms")


@query("SELECT conv_id * 1000 + turn AS line_no, CASE WHEN role = 'user' THEN row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) END AS number FROM conversations")
def numbered_notes(spark, d):
    text = F.when(F.col("role") == "user", "- [x] note").otherwise("## head")
    lines = A.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), text.alias("text"))
    return logs.notes(lines).select("line_no", "number")


@query("""SELECT event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || upper(event_type) || ',t' || CAST(user_id AS VARCHAR) || ',' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',"' || replace(props, '"', '""') || '"' AS line FROM events""")
def activity_csv(spark, d):
    log = A.read(spark, d, "events").select(F.col("event_id").alias("ord"), "ts", F.upper("event_type").alias("type"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tool_name"), F.floor("value").alias("duration_ms"), F.col("props").alias("message"))
    return export.activity_lines(log)


@query(
    f"""WITH c AS (SELECT relative_path AS p, count(*) AS n FROM (SELECT * FROM {LINES} WHERE regexp_matches(lower(text), '{WORD_PATTERN}')) l JOIN {FILES} f ON l.file_ord = f.file_ord GROUP BY 1)
SELECT '| `' || p || '` | ' || CAST(n AS VARCHAR) || ' |' AS line FROM c UNION ALL SELECT '**Total matches:** ' || CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) || ' in ' || CAST(count(*) AS VARCHAR) || ' files' FROM c
UNION ALL VALUES ('# Search Summary: `{WORD_PATTERN}`'), (''), ('**Files searched:** 7'), ('**Options:** Regex=True, CaseSensitive=False'), (''), ('| File | Matches |'), ('|------|---------|')"""
)
def grep_summary_report(spark, d):
    counts = lookup.grep_summary(A.document_lines(spark, d), WORD_PATTERN).join(A.document_files(spark, d).select("file_ord", F.col("relative_path").alias("file_path")), "file_ord")
    return reports.grep_summary_report(counts, WORD_PATTERN, 7).select("line")


@query(
    f"""WITH u AS (SELECT 'Invocation' AS k, CAST(orderkey AS VARCHAR) AS p, line, caller_type || '.' || caller_method AS c FROM {SITES} WHERE called_method = 'm11')
SELECT '- `' || p || ':' || CAST(line AS VARCHAR) || '` - ' || c AS line FROM u UNION ALL SELECT '**Total:** ' || CAST(count(*) AS VARCHAR) || ' usages — **Resolution:** heuristic' FROM u
UNION ALL VALUES ('# Usages of `m11`'), (''), (''), ('## Invocation'), ('')"""
)
def usages_report(spark, d):
    sites = A.part_call_sites(spark, d).filter("called_method = 'm11'")
    rows = sites.select(F.lit("Invocation").alias("usage_kind"), "file_path", "line", F.concat_ws(".", "caller_type", "caller_method").alias("context"))
    return reports.usages_report(rows, "m11").select("line")


@query(
    f"""WITH t AS (SELECT * FROM {TYPES}), h AS (SELECT name || CASE WHEN base_type = '' THEN '' ELSE ' : ' || base_type || CASE WHEN iface IS NULL THEN '' ELSE ', ' || iface END END AS line FROM t)
SELECT line FROM h UNION ALL SELECT name FROM t WHERE base_type <> '' UNION ALL SELECT '  → uses: ' || base_type || CASE WHEN iface IS NULL THEN '' ELSE ', ' || iface END FROM t WHERE base_type <> ''"""
)
def hierarchy_report(spark, d):
    files, types = A.document_files(spark, d), A.chain_types(spark, d).withColumn("xml_doc", F.lit(""))
    none = F.array().cast("array<string>")
    files = files.withColumn("dependencies", none).withColumn("usings", none).withColumn("classification", F.lit("Unknown"))
    members = A.part_members(spark, d).withColumn("signature", F.col("name"))
    chunks = spark.createDataFrame([], "chunk_number int, pos int, file_ord long, estimated_tokens int")
    return reports.master_index("driver", "now", files, types, members, chunks).filter("part in (2, 4)").select("line")


# Orders as files: each declares a type of its customer and calls its parts in turn. Three batches of changes: two thirds of the files; the rest, and a fifth of all with calls the
# other way round and another base; a seventh of all gone.
_KEPT = "(SELECT *, o_orderkey % 5 = 0 AS turned FROM orders WHERE o_orderkey % 7 <> 0)"
_BASES = "[CASE WHEN turned THEN o_orderpriority ELSE o_orderstatus END, 'I' || CAST(o_orderkey % 4 AS VARCHAR)]"


@query(
    f"""SELECT 'type_hierarchy' AS index_name, 'T' || CAST(o_custkey AS VARCHAR) AS key, array_to_string(arg_max({_BASES}, o_orderkey), ',') AS value FROM {_KEPT} GROUP BY o_custkey
UNION ALL SELECT 'dependency_map', 'T' || CAST(o_custkey AS VARCHAR), array_to_string(arg_max(list_append({_BASES}, 'C' || CAST(o_custkey % 10 AS VARCHAR)), o_orderkey), ',') FROM {_KEPT} GROUP BY o_custkey
UNION ALL SELECT 'file_dependencies', CAST(o_orderkey AS VARCHAR), array_to_string({_BASES}, ',') FROM {_KEPT}
UNION ALL SELECT DISTINCT 'call_graph', CASE WHEN turned THEN 'm' || n.l_partkey ELSE 'm' || l.l_partkey END, CASE WHEN turned THEN 'm' || l.l_partkey ELSE 'm' || n.l_partkey END
  FROM lineitem l JOIN lineitem n ON l.l_orderkey = n.l_orderkey AND n.l_linenumber = l.l_linenumber + 1 JOIN {_KEPT} ON o_orderkey = l.l_orderkey"""
)
def incremental_indexes(spark, d):
    orders = A.read(spark, d, "orders").withColumn("file_path", F.concat(F.lit("f"), F.col("o_orderkey").cast("string")))
    items = A.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("method"))
    pairs = items.join(items.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("method").alias("next")), ["l_orderkey", "l_linenumber"])

    def base(some, turned):
        one, two = ("next", "method") if turned else ("method", "next")
        parts = lambda c: [F.lit(None).cast("string"), F.col(c)]
        files = some.select("file_path", F.col("o_orderkey").alias("file_ord"), F.array(F.concat(F.lit("C"), (F.col("o_custkey") % 10).cast("string"))).alias("dependencies"))
        types = some.select("file_path", F.col("o_orderkey").alias("file_ord"), F.col("o_orderkey").alias("type_ord"), F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("name"),
                            F.col("o_orderpriority" if turned else "o_orderstatus").alias("base_type"), F.array(F.concat(F.lit("I"), (F.col("o_orderkey") % 4).cast("string"))).alias("interfaces"))
        calls = some.select("file_path", F.col("o_orderkey").alias("l_orderkey")).join(pairs, "l_orderkey")
        calls = calls.select("file_path", *[c.alias(n) for c, n in zip([*parts(one), *parts(two)], ("caller_type", "caller_method", "called_type", "called_method"), strict=True)])
        return {"files": files, "types": types, "call_sites": calls}

    kept = store.IndexStore(spark, shared.fresh_path(spark, "indexes"), buckets=4)
    kept.apply(base(orders.filter("o_orderkey % 3 <> 0"), False))
    plain, turned = base(orders.filter("o_orderkey % 3 = 0 and o_orderkey % 5 <> 0"), False), base(orders.filter("o_orderkey % 5 = 0"), True)
    kept.apply({k: plain[k].unionByName(turned[k]) for k in plain})
    version = kept.apply({k: t.filter("false") for k, t in plain.items()}, gone=orders.filter("o_orderkey % 7 = 0").select("file_path"))
    text = lambda c: F.array_join(c, ",").alias("value")
    shown = {"type_hierarchy": ["name", text("bases")], "dependency_map": ["name", text("deps")], "file_dependencies": [F.col("file_ord").cast("string"), text("dependencies")], "call_graph": ["caller", "callee"]}
    out = [kept.index(n, version).select(F.lit(n).alias("index_name"), *cols).toDF("index_name", "key", "value") for n, cols in shown.items()]
    return reduce(DataFrame.unionByName, out)
