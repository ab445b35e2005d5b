"""The tools over base tables, end to end: usages, files, attributes, impact, context, duplicates, rules, edits, telemetry, notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .code_queries import PLACED, csharp_files
from .functions import text as T
from .operators import buildlog, context, duplicates, edits, impact, lookup, rules, symbols, telemetry
from .plans import adapters as A
from .plans import index
from .plans.shared import cut, fresh_path
from .queries import CALLS, EMAIL, FILES, LINES, MEMBERS, ORACLE_SQL, QUERIES, SITES, TYPES, WORD_PATTERN, query
from .sinks import export, reports
from .sources import code

BRAND = "CAST(regexp_extract(type_name, '([0-9]+)$', 1) AS BIGINT)"


@query("SELECT *, 'heuristic' AS mode FROM (" + ORACLE_SQL["usages_union"] + ")")
def usages_tagged(spark, d):
    corpus = A.chain_corpus(spark, d)
    none = symbols.find_usages(corpus, "  ")
    resolved = symbols.usages(corpus, "no such name")
    return symbols.find_usages(corpus, "Nation_3", resolved).unionByName(none)


@query("SELECT *, 'semantic' AS mode FROM (" + ORACLE_SQL["usages_of_method"] + ")")
def usages_resolved(spark, d):
    corpus = A.chain_corpus(spark, d)
    return symbols.find_usages(corpus, "Nation_3", symbols.usages(corpus, "M11"))


@query(f"SELECT 'found' AS status, file_ord, relative_path, NULL AS classification, namespace, estimated_tokens, language, text FROM {FILES} WHERE file_ord = 4")
def file_content(spark, d):
    files = A.document_files(spark, d)
    return lookup.file_content(files, files.filter("file_ord = 4").first()["relative_path"].upper())


@query(
    f"""SELECT file_ord, relative_path, 2 AS strategy, 'found' AS status FROM {FILES} WHERE file_ord = 1 UNION ALL SELECT file_ord, relative_path, 3, 'found' FROM {FILES} WHERE file_ord = 2
UNION ALL SELECT file_ord, relative_path, 4, 'found' FROM {FILES} WHERE file_ord = 3"""
)
def path_strategies(spark, d):
    """By a bare name, below the root's name, with dots in it."""
    files = A.document_files(spark, d).withColumn("root_directory", F.lit("/data/Work/"))
    paths = {r.file_ord: r.relative_path for r in files.filter("file_ord in (2, 3)").select("file_ord", "relative_path").collect()}
    out = lookup.find_file(files, "1.TXT")
    for p in ("work\\" + paths[2], "a/../" + paths[3].replace("/", "/./", 1)):
        out = out.unionByName(lookup.find_file(files, p))
    return out


@query(f"SELECT file_ord, line_no, (SELECT count(*) FROM {LINES} WHERE regexp_matches(lower(text), '{WORD_PATTERN}')) AS total FROM {LINES} WHERE regexp_matches(lower(text), '{WORD_PATTERN}') ORDER BY file_ord, line_no LIMIT 7")
def grep_total(spark, d):
    return lookup.grep_total(A.document_lines(spark, d), WORD_PATTERN, limit=7).select("file_ord", "line_no", "total")


@query(f"SELECT FALSE AS found, name FROM {TYPES} ORDER BY type_ord LIMIT 20")
def type_missing(spark, d):
    return lookup.type_or_names(A.chain_types(spark, d), A.part_members(spark, d).withColumn("type_ord", F.col("file_ord")), "NoSuchType")


ATTRIBUTES = f"""(SELECT name, 'Interface' AS kind, type_ord AS f, type_ord AS t, -1 AS m, 'interface' AS why, 0 AS r FROM {TYPES} WHERE type_ord % 7 = 0
UNION ALL SELECT name, 'Class', type_ord, type_ord, -1, 'implements', 1 FROM {TYPES} WHERE contains(iface, 'MACH')
UNION ALL SELECT type_name || '.' || name, kind, {BRAND}, {BRAND}, member_ord, 'member', 2 FROM {MEMBERS} WHERE is_async AND NOT is_static AND contains(return_type, 'BRASS') AND kind = 'Method'
UNION ALL SELECT type_name || '.' || name, kind, {BRAND}, {BRAND}, member_ord, 'undocumented', 3 FROM {MEMBERS} WHERE access_modifier = 'public' AND xml_doc = '')"""


@query(f"SELECT name, kind, f AS file_ord, why, (SELECT count(*) FROM {ATTRIBUTES}) AS total FROM {ATTRIBUTES} ORDER BY f, t, m, r, name LIMIT 100")
def attribute_query(spark, d):
    types = A.chain_types(spark, d).withColumn("kind", F.when(F.col("type_ord") % 7 == 0, "Interface").otherwise("Class"))
    return lookup.semantic_matches(types, A.part_members(spark, d), interfaces=True, implements="MACH", missing_docs=True, is_async=True, is_static=False, return_type="BRASS", kind="Method")


@query("SELECT o_orderkey AS ord, o_orderstatus = 'F' OR o_orderpriority LIKE '1%' OR o_orderkey % 3 = 0 AS is_test FROM orders")
def test_files(spark, d):
    k = F.col("o_orderkey")
    usings = F.when(k % 3 == 0, F.array(F.lit("System"), F.lit("NUnit.Framework"))).when(k % 3 == 1, F.array(F.lit("System"))).otherwise(F.lit(None).cast("array<string>"))
    kind = F.when(F.col("o_orderstatus") == "F", "Test").otherwise("Model")
    name = F.when(F.col("o_orderpriority").startswith("1"), "MyTests.cs").otherwise("My.cs")
    return A.read(spark, d, "orders").select(k.alias("ord"), impact.is_test_file(kind, name, usings).alias("is_test"))


@query(
    f"""WITH i AS ({ORACLE_SQL["blast_radius"]}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT is_test) AS non_test, count(DISTINCT CASE WHEN is_test THEN lower(file) END) AS tests, count(*) FILTER (WHERE is_external) AS ext, max(depth) AS levels FROM i),
s AS (SELECT *, round_even(least(10.0, least(3.0, n / 4.0) + CASE WHEN non_test > 0 AND tests = 0 THEN 2.0 WHEN non_test > tests * 2 THEN 1.0 ELSE 0.0 END + 1.4 + least(2.0, ext * 1.0)), 1) AS score FROM c)
SELECT n AS affected, tests, ext AS external, CAST(score AS DOUBLE) AS risk_score, CASE WHEN score < 3 THEN 'LOW' WHEN score < 5 THEN 'MEDIUM' WHEN score < 7 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_level,
  concat_ws('|', CASE WHEN n > 10 THEN 'High fan-out: ' || n || ' symbols on ' || levels || ' levels' WHEN n > 5 THEN 'Moderate fan-out: ' || n || ' symbols' END, CASE WHEN tests = 0 THEN 'No tests cover an affected path' END, '2 markup bindings', CASE WHEN ext > 0 THEN ext || ' references from outside' END) AS factors,
  concat_ws('|', CASE WHEN tests > 0 THEN 'Run the affected tests' ELSE 'Add tests for the affected paths' END, 'Check the markup bindings', CASE WHEN levels >= 2 THEN 'Review the transitive callers' END, CASE WHEN score >= 7 THEN 'Change in small steps and build after each' END) AS actions FROM s"""
)
def impact_summary(spark, d):
    s = impact.summary(QUERIES["blast_radius"](spark, d), "m1", bindings=2)
    return s.select("affected", "tests", "external", "risk_score", "risk_level", F.array_join("factors", "|").alias("factors"), F.array_join("actions", "|").alias("actions"))


# Context: reasons, expansion along the call graph, hints.
REASON_WORDS = ("asia", "Nation_1", "NATION_1", "customer")


@query(
    f"""WITH w AS (SELECT unnest({list(REASON_WORDS)!r}) AS k, unnest([0, 1, 2, 3]) AS pos), h AS (SELECT type_ord, 'Type ' || name || ' matches ' || k AS reason, min(pos) AS pos FROM {TYPES} t JOIN w ON contains(lower(name), lower(k)) GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY type_ord ORDER BY pos) AS i FROM h) SELECT type_ord AS file_ord, string_agg(reason, '; ' ORDER BY pos) AS reasons FROM n WHERE i <= 5 GROUP BY type_ord"""
)
def match_reasons(spark, d):
    return context.match_reasons(A.chain_types(spark, d), list(REASON_WORDS)).withColumn("reasons", F.array_join("reasons", "; "))


CHOSEN = "(SELECT s_suppkey AS file_ord, 10.0 + s_suppkey AS score FROM supplier WHERE s_suppkey <= 3)"
EXPANDED = f"""WITH RECURSIVE g AS (SELECT DISTINCT caller_type || '.' || caller_method AS caller, called_type || '.' || called_method AS callee FROM {SITES}),
m AS (SELECT p_brand || '.m' || p_partkey AS method, s.score FROM part JOIN {CHOSEN} s ON p_partkey % 40 = s.file_ord),
r AS (SELECT there, f * score AS score FROM (SELECT method, score, g.caller AS there, 0.6 AS f, row_number() OVER (PARTITION BY method ORDER BY g.caller) AS k FROM m JOIN g ON g.callee = method) WHERE k <= 3
  UNION ALL SELECT there, f * score FROM (SELECT method, score, g.callee AS there, 0.5 AS f, row_number() OVER (PARTITION BY method ORDER BY g.callee) AS k FROM m JOIN g ON g.caller = method) WHERE k <= 3),
h AS (SELECT p_brand AS name, max(p_partkey % 40) AS file_ord FROM part GROUP BY 1),
b AS (SELECT h.file_ord, max(r.score) AS score FROM r JOIN h ON string_split(r.there, '.')[1] = h.name WHERE h.file_ord NOT IN (SELECT file_ord FROM {CHOSEN}) GROUP BY 1 ORDER BY score DESC, h.file_ord LIMIT 5),
o AS (SELECT file_ord, score, 100 + file_ord % 7 * 100 AS tokens, row_number() OVER (ORDER BY score DESC, file_ord) AS i FROM b),
p AS (SELECT CAST(0 AS BIGINT) AS i, CAST(900 AS BIGINT) AS room UNION ALL SELECT min(o.i), arg_min(p.room - o.tokens, o.i) FROM p JOIN o ON o.i > p.i AND o.tokens <= p.room GROUP BY p.i)
SELECT o.file_ord, CAST(o.score AS DOUBLE) AS score, CAST(o.tokens AS BIGINT) AS tokens FROM p JOIN o ON p.i = o.i"""


@query(EXPANDED)
def context_expansion(spark, d):
    part = A.read(spark, d, "part")
    at = (F.col("p_partkey") % 40).alias("file_ord")
    members = part.select(F.lit("Method").alias("kind"), F.col("p_brand").alias("type_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), at)
    types = part.select(F.col("p_brand").alias("name"), at, F.col("p_partkey").alias("type_ord"))
    files = part.select(at).distinct().withColumn("estimated_tokens", 100 + F.col("file_ord") % 7 * 100)
    chosen = A.read(spark, d, "supplier").filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("file_ord"), (F.lit(10.0) + F.col("s_suppkey")).alias("score"))
    return context.expansion(chosen, members, types, files, index.call_graph(A.part_call_sites(spark, d)), slots=5, tokens=900)


@query("SELECT * FROM (VALUES (1, 'Regular expressions make patterns flexible'), (2, 'Return line numbers and context'), (3, 'No file matches: the task may need new components'), (4, 'Decide which class of file fits'), (5, 'The context is large: name types or methods to narrow it')) v(place, hint)")
def task_suggestions(spark, d):
    hints = context.suggestions("Find the parser", 0, 31_000)
    return spark.createDataFrame(list(enumerate(hints, 1)), "place int, hint string")


@query(f"SELECT file_ord, CAST(CASE WHEN contains(lower(relative_path), 'server') OR contains(lower(relative_path), 'mcp') THEN 15 ELSE 0 END + CASE WHEN file_ord % 2 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS bonus FROM (SELECT file_ord, CASE WHEN file_ord % 3 = 0 THEN 'Server/' ELSE '' END || relative_path AS relative_path FROM {FILES})")
def task_bonus(spark, d):
    path = F.concat(F.when(F.col("file_ord") % 3 == 0, "Server/").otherwise(""), "relative_path")
    kind = F.when(F.col("file_ord") % 2 == 0, "View").otherwise("Model")
    return A.document_files(spark, d).select("file_ord", context.task_bonus("Add a tool to the window", path, kind).alias("bonus"))


# Duplicates.
@query(r"SELECT doc_id, md5(trim(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS digest FROM documents")
def normalised_texts(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.md5(T.normalised_code(F.col("text"))).alias("digest"))


@query(f"SELECT min(ord) AS seed, count(*) AS n_members, 100 AS similarity, CAST(6 * count(*) AS BIGINT) AS total_lines, CAST(6 * (count(*) - 1) AS BIGINT) AS saved_lines FROM (SELECT file_ord * 10000000000 + row_number() OVER (PARTITION BY file_ord ORDER BY k) - 1 AS ord, kind FROM {PLACED}) WHERE kind = 0")
def method_duplicates(spark, d):
    """Methods of five lines or more whose bodies, without regard to white space and case, are alike."""
    rows = duplicates.blocks(code.corpus(csharp_files(spark, d)).members)
    return duplicates.cluster_report(duplicates.row_clusters(rows), rows)


# Rules and edits.
@query("SELECT * FROM (VALUES (1, 'add_xml_doc'), (2, 'add_null_checks'), (3, 'add_sealed'), (4, NULL), (5, 'mine')) v(place, intent)")
def intents(spark, d):
    custom = {"mine": ("my own words",)}
    asked = ["Please add a summary to all", "ADD_NULL_CHECKS", "make classes sealed", "nothing known", "use MY OWN words"]
    return spark.createDataFrame([(i, rules.resolve_intent(t, custom)) for i, t in enumerate(asked, 1)], "place int, intent string")


@query(f"SELECT file_ord FROM {FILES} WHERE lower(namespace) LIKE 'src1%' OR lower(relative_path) LIKE '%src1%'")
def rule_scope(spark, d):
    files = A.document_files(spark, d)
    return rules.in_scope(rules.in_scope(files, "all"), "SRC1").select("file_ord")


@query(f"SELECT file_ord, line_no FROM {LINES} WHERE text LIKE '%!!%' AND file_ord IN (SELECT DISTINCT file_ord FROM {LINES} WHERE text LIKE '%!!%' ORDER BY 1 LIMIT 10)")
def rule_targets(spark, d):
    found = rules.line_violations(A.document_lines(spark, d), {"shout": "!!"}).select("file_ord", "line_no")
    return rules.capped(found, 10)


USER_RULES = """{ // rules of the first directory that has any
  "customIntents": [
    {"name": "mail", "findPattern": "(?<who>[a-z0-9.]+)@(?<host>[a-z0-9.]+)", "replacePattern": "${host} at $1", "excludePattern": "^info"},
    {"name": "mail2", "findPattern": ""},
    {"findPattern": "x"},
  ], }"""
HELD = f"(SELECT file_ord, CAST(line_no AS INTEGER) AS line, unnest(regexp_extract_all(text, '{EMAIL}')) AS found FROM {LINES})"


@query(f"SELECT file_ord, line, found, regexp_replace(found, '([a-z0-9.]+)@([a-z0-9.]+)', '\\2 at \\1') AS replacement FROM {HELD} WHERE NOT starts_with(found, 'info')")
def user_rule(spark, d):
    (rule,) = rules.first_rules([None, USER_RULES, '{"customIntents": [{"name": "other", "findPattern": "y"}]}'])
    files = A.document_files(spark, d).withColumn("extension", F.lit(".txt"))
    return rules.rule_matches(files, rule).select("file_ord", "line", "found", "replacement")


@query(
    f"""WITH f AS (SELECT file_ord, string_split(text, chr(10)) AS p FROM {FILES} WHERE text NOT LIKE 'CHANGED%')
SELECT file_ord, '--- ' || chr(10) || '+++ ' || chr(10) || CASE WHEN len(p) = 1 THEN '@@ -1 +1 @@' ELSE '@@ -1,' || least(len(p), 4) || ' +1,' || least(len(p), 4) || ' @@' END || chr(10) || '-' || p[1] || chr(10) || '+CHANGED'
  || CASE WHEN len(p) > 1 THEN chr(10) || array_to_string(list_transform(p[2:4], lambda x: ' ' || x), chr(10)) ELSE '' END AS diff, len(p) - 1 < 0.2 * len(p) AS is_rewrite FROM f"""
)
def first_line_diffs(spark, d):
    rest = F.expr("concat_ws('\\n', transform(slice(split(text, '\\n'), 2, size(split(text, '\\n'))), x -> x))")
    new = F.when(F.size(F.split("text", "\n")) == 1, F.lit("CHANGED")).otherwise(F.concat(F.lit("CHANGED\n"), rest))
    return edits.diffs(A.document_files(spark, d).filter("not startswith(text, 'CHANGED')").select("file_ord", F.col("text").alias("old"), new.alias("new")))


@query(
    """SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Other.List' WHEN 1 THEN 'My.List' WHEN 2 THEN 'System.Very.Long.List' WHEN 3 THEN 'A.List' ELSE 'System.List' END AS choice FROM part"""
)
def ambiguity_choice(spark, d):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "using Other;\nclass X {}").when(k == 1, "using My;").otherwise("class X {}")
    one = F.when(k == 0, "System.List").when(k == 1, "My.List").when(k == 2, "A.List").when(k == 3, "A.List").otherwise("System.List")
    two = F.when(k == 0, "Other.List").when(k == 1, "System.List").when(k == 2, "System.Very.Long.List").when(k == 3, "Bb.List").otherwise("My.L")
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("k"), buildlog.best_candidate(text, one, two).alias("choice"))


@query("SELECT * FROM (VALUES ('add', '# n|## a|- one|- new|## b|- two'), ('update', '# n|## a|x|y|## b|- two'), ('clear', '# n|## a|## b|- two'), ('delete', '# n|## b|- two'), ('create', '# n|## a|- one|## b|- two||## c|z'), ('over', NULL)) v(edit, lines)")
def notes_edits(spark, d):
    now = ["# n", "## a", "- one", "## b", "- two"]
    made = {
        "add": edits.notes_edit(now, "new", "a"), "update": edits.notes_replaced(now, "a", ["x", "y"]), "clear": edits.notes_without(now, "a", keep_head=True),
        "delete": edits.notes_without(now, "a"), "create": edits.notes_replaced(now, "c", ["z"]), "over": edits.notes_edit(now, "n" * 30_000, "a"),
    }
    return spark.createDataFrame([(k, None if v is None else "|".join(v)) for k, v in made.items()], "edit string, lines string")


@query(f"SELECT file_ord, line_no AS at, 1 AS score FROM {LINES} WHERE trim(replace(text, chr(9), ' ')) = (SELECT trim(text) FROM {LINES} WHERE file_ord = 5 AND line_no = 2)")
def near_places(spark, d):
    """Where a line of a file, indented otherwise, could have been meant."""
    lines = A.document_lines(spark, d)
    line = lines.filter("file_ord = 5 and line_no = 2").first()["text"]
    return edits.matches_of_lines(lines, "    " + line.strip())


NAME = "SELECT 'v' || (user_id % 30) AS name FROM events WHERE event_id % 100"


@query(
    f"""SELECT string_agg(name, ',' ORDER BY name) AS x, count(*) AS n
FROM ({NAME} BETWEEN 20 AND 40 AND event_type <> 'view' INTERSECT {NAME} < 20 AND event_type = 'view' EXCEPT {NAME} BETWEEN 20 AND 40 AND event_type = 'view' AND user_id % 30 < 12)"""
)
def flow_parameters(spark, d):
    """Names that a range of lines uses and that are declared before it, but not in it."""
    name = F.concat(F.lit("v"), (F.col("user_id") % 30).cast("string"))
    inside = (F.col("event_id") % 100).between(20, 40)
    role = F.when(F.col("event_type") == "view", "declare").when(F.col("event_type") == "click", "assign").otherwise("use")
    rows = A.read(spark, d, "events").filter(~inside | (F.col("event_type") != "view") | (F.col("user_id") % 30 < 12))
    flow = edits.data_flow(rows.select((F.col("event_id") % 100).alias("line_no"), name.alias("name"), role.alias("role")), 20, 40)
    return flow.select(F.array_join("parameters", ",").alias("x"), F.size("parameters").cast("long").alias("n"))


# Telemetry.
KINDS = "CASE event_type WHEN 'click' THEN 'STARTED' WHEN 'view' THEN 'COMPLETED' WHEN 'error' THEN 'ERROR' ELSE 'OTHER' END"


def _activity(spark, d):
    kind = F.when(F.col("event_type") == "click", "STARTED").when(F.col("event_type") == "view", "COMPLETED").when(F.col("event_type") == "error", "ERROR").otherwise("OTHER")
    return A.read(spark, d, "events").select(F.col("event_id").alias("ord"), "ts", kind.alias("type"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("tool_name"), F.lit("").alias("details"))


@query(f"SELECT ord, tool_name, idle_seconds FROM (SELECT event_id AS ord, 't' || user_id AS tool_name, kind, (epoch_us(lead(ts) OVER (ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000.0::DOUBLE AS idle_seconds FROM (SELECT *, {KINDS} AS kind FROM events) WHERE kind <> 'OTHER') WHERE kind = 'COMPLETED' AND idle_seconds >= 45")
def unanswered_calls(spark, d):
    return telemetry.unanswered(_activity(spark, d))


@query(f"SELECT event_id AS ord, 't' || user_id AS tool_name FROM events WHERE {KINDS} = 'ERROR'")
def activity_errors(spark, d):
    return telemetry.errors(_activity(spark, d)).select("ord", "tool_name")


@query(
    f"SELECT CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration FROM (SELECT CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS s FROM {CALLS})"
)
def session_duration(spark, d):
    return telemetry.session_duration(A.event_calls(spark, d))


@query(f"SELECT count(*) AS n_calls, round(avg(duration_ms), 6) AS avg_ms FROM {CALLS} WHERE ts > (SELECT ts FROM {CALLS} WHERE ord = 500)")
def average_since_reset(spark, d):
    calls = A.event_calls(spark, d)
    return telemetry.running_average(telemetry.since_reset(calls, calls.filter("ord = 500").first()["ts"]))


@query(
    """WITH l AS (SELECT item_id AS ord FROM benchmark ORDER BY item_id DESC LIMIT 15), u AS (SELECT 0 AS s, ord FROM l UNION ALL SELECT 1, n_nationkey FROM nation),
n AS (SELECT CAST(row_number() OVER (ORDER BY s, ord) AS INTEGER) AS number, CASE s WHEN 0 THEN 'local' ELSE 'community' END AS source, ord FROM u)
SELECT number, source, ord FROM n WHERE NOT (number IN (2, 20) AND source = 'local')"""
)
def lessons_kept(spark, d):
    """The newest up to the capacity, numbered with the community's; a local one goes by its number, a community's stays."""
    local = telemetry.kept_lessons(A.read(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("ord")), 15)
    numbered = telemetry.numbered_lessons(local, A.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("ord")))
    return telemetry.without_lesson(telemetry.without_lesson(numbered, 2), 20).select("number", "source", "ord")


# Index.
CLASS_OF = "CASE file_ord % 4 WHEN 0 THEN 'Service' WHEN 1 THEN 'Config' WHEN 2 THEN 'Test' ELSE 'Unknown' END"


@query(
    f"""WITH RECURSIVE r AS (SELECT file_ord, estimated_tokens AS t, {CLASS_OF} AS c, row_number() OVER (ORDER BY CASE file_ord % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 8 ELSE 7 END, relative_path, file_ord) AS i FROM {FILES}),
p AS (SELECT i, c, 1 AS chunk_number, 0 AS pos, t AS held, t > 20000 AS closed FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.c, CASE WHEN p.closed OR p.held + r.t > 20000 THEN chunk_number + 1 ELSE chunk_number END, CASE WHEN p.closed OR p.held + r.t > 20000 THEN 0 ELSE pos + 1 END,
    CASE WHEN p.closed OR p.held + r.t > 20000 THEN r.t ELSE p.held + r.t END, (p.closed OR p.held + r.t > 20000) AND r.t > 20000 FROM p JOIN r ON r.i = p.i + 1),
k AS (SELECT chunk_number, c, count(*) AS n, min(pos) AS f FROM p GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY chunk_number ORDER BY n DESC, f) AS j FROM k)
SELECT chunk_number, string_agg(c, ' + ' ORDER BY j) AS description FROM q WHERE j <= 3 GROUP BY chunk_number"""
)
def chunk_descriptions(spark, d):
    i = F.col("file_ord") % 4
    files = A.document_files(spark, d).withColumn("classification", F.when(i == 0, "Service").when(i == 1, "Config").when(i == 2, "Test").otherwise("Unknown"))
    return index.chunk_descriptions(index.chunk_files(files, 20_000), files)


@query(f"SELECT file_ord, CASE WHEN relative_path LIKE 'src1%' THEN 'src1' WHEN relative_path LIKE 'src%' THEN 'src' END AS root FROM {FILES}")
def first_roots(spark, d):
    return A.document_files(spark, d).select("file_ord", index.root_of(F.col("relative_path"), ["src1", "src", "src2"]).alias("root"))


@query(
    f"""SELECT m.k, l.off AS line_no, l.text FROM (SELECT min(k) AS k, min_by(line, k) AS line, min_by(file_ord, k) AS file_ord FROM {PLACED} WHERE kind = 0 AND b = 13) m,
(VALUES (0, '    {{'), (1, '        Store.Load(name.Length); // Ghost.Call('), (2, '        var t = order.Total + "Not.A(".Length;'), (3, '        Helper();'), (4, '    }}')) l(off, text)"""
)
def method_source(spark, d):
    """The lines of a method from its file, after its signature."""
    corpus = code.corpus(csharp_files(spark, d))
    lowest = corpus.members.filter("type_name = 'Brand13' and kind = 'Method'").select(F.substring("name", 2, 20).cast("long").alias("k")).agg(F.min("k")).first()[0]
    rows = lookup.method_source(corpus.members, corpus.lines, f"M{lowest}", "brand13")
    first = corpus.members.filter(f"name = 'M{lowest}'").select("file_ord", F.col("start_line").alias("_s"))
    return rows.join(first, "file_ord").filter("line_no > _s").select(F.lit(lowest).alias("k"), (F.col("line_no") - F.col("_s") - 1).cast("int").alias("line_no"), "text")


# Sinks.
@query("SELECT CAST(n_nationkey AS INTEGER) AS number, n_name AS component, CASE WHEN n_regionkey <> 2 THEN r_name END AS observation FROM nation JOIN region ON n_regionkey = r_regionkey")
def lessons_written(spark, d):
    """Written as JSON, nulls left out, and read back."""
    rows = A.read(spark, d, "nation").join(A.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = fresh_path(spark, "lessons")
    export.write_lessons(rows.select(F.col("n_nationkey").cast("int").alias("number"), F.col("n_name").alias("component"), F.when(F.col("n_regionkey") != 2, F.col("r_name")).alias("observation")), path)
    return spark.read.schema("number int, component string, observation string").json(path)


@query("SELECT r_name AS name, n_name AS folder FROM nation JOIN region ON n_regionkey = r_regionkey")
def workspaces_written(spark, d):
    """A folder for each workspace, with its settings, and read back."""
    rows = A.read(spark, d, "nation").join(A.read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = fresh_path(spark, "workspaces")
    export.write_workspaces(rows.groupBy(F.col("r_name").alias("name")).agg(F.collect_list("n_name").alias("folders")), path)
    found = spark.read.schema("name string, folders array<string>, workspace string").json(path)
    return found.filter("name = workspace").select("name", F.explode("folders").alias("folder"))


@query("SELECT event_id AS n, upper(event_type) AS kind, CAST(floor(value) AS BIGINT) AS ms, props AS message FROM events")
def activity_written(spark, d):
    """Written as CSV with quotes and commas in cells, and read back."""
    log = A.read(spark, d, "events").select(F.col("event_id").alias("ord"), "ts", F.upper("event_type").alias("type"), F.col("event_id").cast("string").alias("tool_name"), F.floor("value").alias("duration_ms"), F.col("props").alias("message"))
    path = fresh_path(spark, "activity")
    export.write_activity(log, path)
    found = spark.read.schema("Timestamp string, Type string, Tool string, DurationMs long, Message string").csv(path, header=True, quote='"', escape='"')
    return found.select(F.col("Tool").cast("long").alias("n"), F.col("Type").alias("kind"), F.col("DurationMs").alias("ms"), F.col("Message").alias("message"))


@query(
    f"""SELECT file_ord, text AS line FROM {LINES} UNION ALL SELECT file_ord, '// --- ' || relative_path || ' ---' FROM {FILES}
UNION ALL SELECT file_ord, '```' || language FROM {FILES} UNION ALL SELECT file_ord, '```' FROM {FILES} UNION ALL SELECT file_ord, '' FROM {FILES}"""
)
def chunk_texts(spark, d):
    """The files as chunks show them."""
    none = F.array().cast("array<string>")
    files = A.document_files(spark, d).withColumn("dependencies", none).withColumn("usings", none).withColumn("classification", F.lit("Unknown"))
    chunks = cut(index.chunk_files(files, 20_000), "chunks")
    types, members = A.chain_types(spark, d).filter("false"), A.part_members(spark, d).withColumn("signature", F.col("name")).filter("false")
    rows = reports.chunk_texts(chunks, files, types, members).filter("part = 3").withColumn("pos", F.shiftright("sub", 40).cast("int"))
    return rows.join(chunks.select(F.col("chunk_number").alias("at"), "pos", "file_ord"), ["at", "pos"]).select("file_ord", "line")
