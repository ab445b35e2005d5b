"""The operators over the driver's tables, each with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import buildlog, context, duplicates, impact, lookup, rules, symbols, telemetry
from .plans import adapters as A
from .plans import index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORD_PATTERN = "moron|idiot"
EMAIL = "[a-z0-9.]+@[a-z0-9.]+"
TASK = "Find the Nation customer parser in src1 text"
START = 1


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# The adapters' tables in SQL.
FILES = "(SELECT doc_id AS file_ord, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS relative_path, CAST(doc_id AS VARCHAR) || '.txt' AS file_name, lang AS language, source AS namespace, n_chars AS size_bytes, CAST(floor(n_chars / 4.0) AS INTEGER) AS estimated_tokens, text FROM documents)"
LINES = "(SELECT doc_id AS file_ord, CAST(i AS INTEGER) AS line_no, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)))"
TYPES = """(SELECT CAST(r_regionkey AS BIGINT) AS type_ord, r_name AS name, '' AS base_type, NULL AS iface, TRUE AS is_abstract FROM region
  UNION ALL SELECT CAST(n_nationkey + 100 AS BIGINT), n_name, r_name, NULL, FALSE FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_custkey + 1000, c_name, n_name, c_mktsegment, FALSE FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MEMBERS = """(SELECT p_partkey AS member_ord, p_brand AS type_name, replace(p_name, ' ', '_') AS name,
  CASE p_size % 4 WHEN 0 THEN 'Method' WHEN 1 THEN 'Property' WHEN 2 THEN 'Field' ELSE 'Constructor' END AS kind,
  CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' ELSE 'protected' END AS access_modifier, p_type AS return_type,
  p_partkey % 4 = 0 AS is_async, p_partkey % 5 = 0 AS is_static, p_partkey % 7 = 0 AS is_override, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END AS xml_doc, p_size + 1 AS start_line FROM part)"""
SITES = """(SELECT l.l_orderkey * 100000000000 + l.l_linenumber * 10000000000 + l.l_partkey * 100000 + n.l_partkey AS site_ord, a.p_brand AS caller_type, 'm' || CAST(l.l_partkey AS VARCHAR) AS caller_method,
  b.p_brand AS called_type, 'm' || CAST(n.l_partkey AS VARCHAR) AS called_method, CAST(l.l_linenumber AS INTEGER) AS line, l.l_orderkey AS orderkey
  FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l JOIN (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) n
    ON l.l_orderkey = n.l_orderkey AND n.l_linenumber = l.l_linenumber + 1 JOIN part a ON a.p_partkey = l.l_partkey JOIN part b ON b.p_partkey = n.l_partkey)"""
EDGES = "(SELECT DISTINCT l.l_partkey AS src, n.l_partkey AS dst FROM lineitem l JOIN lineitem n ON l.l_orderkey = n.l_orderkey AND n.l_linenumber = l.l_linenumber + 1)"
CALLS = "(SELECT event_id AS ord, ts, event_type AS tool_name, value AS duration_ms, event_type = 'error' AS is_error FROM events)"


@query(f"SELECT file_ord, relative_path, namespace, (SELECT count(*) FROM {FILES} WHERE lower(namespace) LIKE '%src1%') AS total FROM {FILES} WHERE lower(namespace) LIKE '%src1%' ORDER BY file_ord LIMIT 50")
def list_files(spark, d):
    return lookup.list_files(A.document_files(spark, d), namespace="src1").select("file_ord", "relative_path", "namespace", "total")


@query(f"SELECT file_ord, relative_path FROM {FILES} WHERE lower(relative_path) LIKE '%fr/1%' OR lower(file_name) LIKE '%fr/1%' ORDER BY file_ord LIMIT 20")
def search_substring(spark, d):
    return lookup.search_files(A.document_files(spark, d), "FR/1").select("file_ord", "relative_path")


@query(f"SELECT namespace, count(*) AS n_files FROM {FILES} WHERE lower(namespace) LIKE '%src%' GROUP BY namespace ORDER BY n_files DESC, namespace LIMIT 10")
def search_group_topk(spark, d):
    return lookup.search_namespaces(A.document_files(spark, d), "SRC")


@query(f"SELECT type_ord, name FROM {TYPES} WHERE lower(name) LIKE '%nation_1%' ORDER BY type_ord LIMIT 20")
def search_types(spark, d):
    return lookup.search_types(A.chain_types(spark, d), "Nation_1").select("type_ord", "name")


@query(f"SELECT member_ord, name, kind FROM {MEMBERS} WHERE lower(name) LIKE '%ring%' ORDER BY CAST(regexp_extract(type_name, '([0-9]+)$', 1) AS BIGINT), member_ord LIMIT 20")
def search_members(spark, d):
    return lookup.search_members(A.part_members(spark, d), "RING").select("member_ord", "name", "kind")


@query(f"SELECT member_ord, type_name, kind, name, count(*) OVER (PARTITION BY type_name, kind, name) > 1 AS is_overload FROM {MEMBERS}")
def member_overloads(spark, d):
    return lookup.with_overloads(A.part_members(spark, d)).select("member_ord", "type_name", "kind", "name", "is_overload")


def _supplies(spark, d):
    rows = A.read(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dep")).distinct()
    return rows.groupBy("name").agg(F.collect_list("dep").alias("deps"))


@query("SELECT DISTINCT 'forward' AS direction, 's' || CAST(l_suppkey AS VARCHAR) AS name FROM lineitem WHERE l_partkey = 7")
def deps_forward(spark, d):
    return lookup.dependencies(_supplies(spark, d), "p7").filter("direction = 'forward'")


@query("SELECT DISTINCT 'reverse' AS direction, 'p' || CAST(l_partkey AS VARCHAR) AS name FROM lineitem WHERE l_suppkey = 7")
def deps_reverse(spark, d):
    return lookup.dependencies(_supplies(spark, d), "s7").filter("direction = 'reverse'")


@query(f"SELECT file_ord, line_no, text FROM {LINES} WHERE regexp_matches(lower(text), '{WORD_PATTERN}') ORDER BY file_ord, line_no LIMIT 50")
def grep_hits(spark, d):
    return lookup.grep(A.document_lines(spark, d), WORD_PATTERN, context=0).select("file_ord", "line_no", "text")


@query(
    f"""WITH l AS (SELECT file_ord, line_no, text, lag(text, 1) OVER w AS b1, lag(text, 2) OVER w AS b2, lead(text, 1) OVER w AS a1, lead(text, 2) OVER w AS a2 FROM {LINES} WINDOW w AS (PARTITION BY file_ord ORDER BY line_no))
SELECT file_ord, line_no, concat_ws('|', b2, b1) AS shown_before, concat_ws('|', a1, a2) AS shown_after FROM l WHERE regexp_matches(lower(text), '{EMAIL}')"""
)
def grep_context(spark, d):
    hits = lookup.grep(A.document_lines(spark, d), EMAIL, limit=None)
    return hits.select("file_ord", "line_no", F.array_join("before", "|").alias("shown_before"), F.array_join("after", "|").alias("shown_after"))


@query(f"SELECT file_ord, count(*) AS n_hits FROM {LINES} WHERE regexp_matches(lower(text), '{WORD_PATTERN}') GROUP BY file_ord")
def grep_summary(spark, d):
    return lookup.grep_summary(A.document_lines(spark, d), WORD_PATTERN).select("file_ord", "n_hits")


@query(f"SELECT file_ord, line_no, replace(replace(replace(text, chr(13), ''), chr(9), '→'), ' ', '·') AS shown FROM {LINES} WHERE file_ord = 5 AND line_no BETWEEN 1 AND 21")
def line_range(spark, d):
    return lookup.line_range(A.document_lines(spark, d), 5, 1)


@query(f"SELECT file_ord, relative_path, 1 AS strategy, 'found' AS status FROM {FILES} WHERE lower(relative_path) = (SELECT lower(relative_path) FROM {FILES} WHERE file_ord = 1)")
def path_resolution(spark, d):
    files = A.document_files(spark, d)
    path = files.filter("file_ord = 1").first()["relative_path"]
    return lookup.find_file(files, "/" + path.replace("/", "\\").upper())


@query(
    f"""SELECT 'Definition' AS usage_kind, name AS symbol, type_ord AS ord, 1 AS line FROM {TYPES} WHERE lower(name) = 'nation_3'
UNION ALL SELECT CASE WHEN is_override THEN 'Override' ELSE 'Definition' END, name, member_ord, start_line FROM {MEMBERS} WHERE lower(name) = 'nation_3'
UNION ALL SELECT 'Invocation', caller_type || '.' || caller_method, site_ord, line FROM {SITES} WHERE lower(called_method) = 'nation_3'
UNION ALL SELECT 'Reference', name, type_ord, 1 FROM {TYPES} WHERE lower(base_type) = 'nation_3'
UNION ALL SELECT 'Implementation', name, type_ord, 1 FROM {TYPES} WHERE lower(iface) = 'nation_3'"""
)
def usages_union(spark, d):
    return symbols.usages(A.chain_corpus(spark, d), "Nation_3")


@query(f"SELECT 'Invocation' AS usage_kind, caller_type || '.' || caller_method AS symbol, site_ord AS ord, line FROM {SITES} WHERE called_method = 'm11' UNION ALL SELECT 'Implementation', name, type_ord, 1 FROM {TYPES} WHERE lower(iface) = 'm11'")
def usages_of_method(spark, d):
    return symbols.usages(A.chain_corpus(spark, d), "M11")


@query(f"SELECT caller_type AS type, caller_method AS method, min(site_ord) AS site_ord FROM {SITES} WHERE called_method = 'm11' AND contains(called_type, 'Brand') GROUP BY 1, 2")
def callers_distinct(spark, d):
    return symbols.callers(A.part_call_sites(spark, d), "M11", "Brand").select("type", "method", "site_ord")


@query(f"SELECT called_type AS type, called_method AS method, min(site_ord) AS site_ord FROM {SITES} WHERE caller_method = 'm11' GROUP BY 1, 2")
def callees_distinct(spark, d):
    return symbols.callees(A.part_call_sites(spark, d), "m11").select("type", "method", "site_ord")


@query(
    f"""WITH s AS (SELECT * FROM {SITES}), h AS (SELECT caller_type AS vt, caller_method AS vm FROM s WHERE called_method = 'm11' GROUP BY 1, 2 ORDER BY min(site_ord), 1, 2 LIMIT 10),
n AS (SELECT vt, vm, caller_type, caller_method, min(site_ord) AS o FROM s JOIN h ON called_method = vm GROUP BY 1, 2, 3, 4)
SELECT vt AS via_type, vm AS via_method, caller_type AS type, caller_method AS method FROM (SELECT *, row_number() OVER (PARTITION BY vt, vm ORDER BY o, caller_type, caller_method) AS k FROM n) WHERE k <= 5"""
)
def second_hop_topk(spark, d):
    return symbols.second_hop(A.part_call_sites(spark, d), "m11")


@query(
    f"""WITH t AS (SELECT * FROM {TYPES}), d AS (SELECT name, base_type FROM t WHERE base_type = 'ASIA')
SELECT name, 'direct' AS path FROM d UNION ALL SELECT t.name, t.name || ' → ' || d.name || ' → ASIA' FROM t JOIN d ON t.base_type = d.name"""
)
def implementations_chain(spark, d):
    return symbols.implementations(A.chain_types(spark, d), "ASIA")


@query(
    f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), r AS (SELECT CAST({START} AS BIGINT) AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 3)
SELECT depth, count(*) AS n_nodes FROM (SELECT node, min(depth) AS depth FROM r GROUP BY node) GROUP BY depth"""
)
def blast_radius_levels(spark, d):
    start = spark.createDataFrame([(START,)], "node long")
    return impact.reach(A.part_edges(spark, d), start, 3).groupBy("depth").agg(F.count("*").alias("n_nodes"))


@query(
    """SELECT p_partkey, round_even(least(10.0, least(3.0, (p_size) / 4.0) + CASE WHEN p_size > 0 AND p_partkey % 3 = 0 THEN 2.0 WHEN p_size > (p_partkey % 3) * 2 THEN 1.0 ELSE 0.0 END
  + least(2.0, (p_partkey % 4) * 0.7) + least(2.0, (p_partkey % 5) * 1.0) + CASE WHEN p_name LIKE '%auth%' OR p_name LIKE '%token%' THEN 1.0 ELSE 0.0 END), 1) AS risk_score FROM part"""
)
def blast_radius_score(spark, d):
    n, k = F.col("p_size"), F.col("p_partkey")
    return A.read(spark, d, "part").select("p_partkey", impact.risk_score(n, n, k % 3, k % 4, k % 5, impact.is_critical(F.col("p_name"))).alias("risk_score"))


FILE_PATHS = "(SELECT CAST(o_orderkey AS VARCHAR) AS p, o_orderpriority = '1-URGENT' AS is_test FROM orders WHERE o_orderstatus <> 'P')"


@query(
    f"""WITH s AS (SELECT * FROM {SITES}),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(caller_type || '.' || caller_method) ORDER BY site_ord) AS k FROM s WHERE lower(called_method) = 'm1') WHERE k = 1),
f AS (SELECT m, row_number() OVER (ORDER BY o) AS spot FROM (SELECT lower(caller_method) AS m, min(site_ord) AS o FROM a GROUP BY 1)),
b AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY lower(caller_type || '.' || caller_method) ORDER BY spot, site_ord) AS k FROM s JOIN f ON lower(s.called_method) = f.m
  WHERE lower(caller_type || '.' || caller_method) NOT IN (SELECT lower(caller_type || '.' || caller_method) FROM a UNION ALL SELECT 'm1')) WHERE k = 1),
u AS (SELECT 1 AS depth, * FROM a UNION ALL SELECT 2, * FROM b)
SELECT depth, caller_type || '.' || caller_method AS name, coalesce('o/' || x.p, CAST(orderkey AS VARCHAR)) AS file, line, 'caller' AS kind, coalesce(x.is_test, FALSE) AS is_test, x.p IS NULL AS is_external
FROM u LEFT JOIN {FILE_PATHS} x ON CAST(u.orderkey AS VARCHAR) = x.p"""
)
def blast_radius(spark, d):
    files = A.read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("file_path"), F.concat(F.lit("o/"), F.col("o_orderkey").cast("string")).alias("relative_path"), (F.col("o_orderpriority") == "1-URGENT").alias("is_test"))
    members = A.part_members(spark, d).withColumn("file_path", F.col("member_ord").cast("string"))
    return impact.blast_radius(A.part_call_sites(spark, d), members, files, "m1", 2)


@query(f"SELECT member_ord, name FROM {MEMBERS} WHERE is_async AND NOT is_static AND kind = 'Method' AND lower(return_type) LIKE '%o%' AND xml_doc = '' ORDER BY member_ord LIMIT 100")
def semantic_filter(spark, d):
    return lookup.semantic_query(A.part_members(spark, d), is_async=True, is_static=False, kind="Method", return_type="O", missing_docs=True).select("member_ord", "name")


@query(f"SELECT type_ord, name FROM {TYPES} t WHERE NOT is_abstract AND NOT EXISTS (SELECT 1 FROM {TYPES} b WHERE lower(b.base_type) = lower(t.name))")
def sealed_candidates(spark, d):
    return rules.sealable(A.chain_types(spark, d)).select("type_ord", "name")


@query(f"SELECT DISTINCT base_type AS name FROM {TYPES} WHERE base_type IN (SELECT name FROM {TYPES}) ORDER BY name LIMIT 10")
def related_types(spark, d):
    types = A.chain_types(spark, d)
    return context.related_types(types, types)


@query("SELECT name, CASE WHEN base_type = '' THEN '' WHEN iface IS NULL THEN base_type ELSE base_type || ',' || iface END AS bases FROM " + TYPES)
def type_hierarchy(spark, d):
    return index.type_hierarchy(A.chain_types(spark, d)).select("name", F.array_join("bases", ",").alias("bases"))


@query(
    f"""SELECT file_ord, CASE WHEN p LIKE '%.json' THEN 'Config' WHEN p LIKE '%test%' OR p LIKE '%spec%' THEN 'Test' WHEN p LIKE '%model%' THEN 'Model' WHEN p LIKE '%service%' THEN 'Service' ELSE 'Unknown' END AS classification
FROM (SELECT file_ord, CASE file_ord % 6 WHEN 0 THEN 'latest/' WHEN 1 THEN 'models/' WHEN 2 THEN 'service/' WHEN 3 THEN 'test/' ELSE 'src/' END || relative_path || CASE WHEN file_ord % 5 = 0 THEN '.json' ELSE '' END AS p FROM {FILES})"""
)
def classification(spark, d):
    i, files = F.col("file_ord") % 6, A.document_files(spark, d)
    top = F.when(i == 0, "latest/").when(i == 1, "models/").when(i == 2, "service/").when(i == 3, "test/").otherwise("src/")
    path = F.concat(top, F.col("relative_path"), F.when(F.col("file_ord") % 5 == 0, ".json").otherwise(""))
    return files.select("file_ord", index.classification(path, T.file_name(path)).alias("classification"))


@query(f"SELECT count(*) AS n_files, CAST(sum(estimated_tokens) AS BIGINT) AS total_tokens, CASE WHEN sum(estimated_tokens) < 100000 THEN 'small' ELSE 'large' END AS tier FROM {FILES}")
def token_totals(spark, d):
    return index.totals(A.document_files(spark, d))


@query(f"SELECT DISTINCT caller_type || '.' || caller_method AS caller, called_type || '.' || called_method AS callee FROM {SITES}")
def call_graph(spark, d):
    return index.call_graph(A.part_call_sites(spark, d))


@query(
    """WITH n AS (SELECT DISTINCT CAST(l_orderkey % 20 AS INTEGER) AS chunk, l_partkey FROM lineitem WHERE l_linenumber = 1), h AS (SELECT DISTINCT CAST(l_orderkey % 20 AS INTEGER) AS chunk, l_partkey FROM lineitem WHERE l_linenumber = 2)
SELECT n.chunk, h.chunk AS other, count(*) AS n_shared FROM n JOIN h ON n.l_partkey = h.l_partkey WHERE n.chunk <> h.chunk GROUP BY 1, 2"""
)
def chunk_crossrefs(spark, d):
    rows = A.read(spark, d, "lineitem").select((F.col("l_orderkey") % 20).cast("int").alias("chunk"), F.col("l_partkey").cast("string").alias("name"), "l_linenumber")
    return index.chunk_crossrefs(rows.filter("l_linenumber = 1").select("chunk", "name"), rows.filter("l_linenumber = 2").select("chunk", "name")).select("chunk", "other", "n_shared")


@query(
    f"""WITH RECURSIVE r AS (SELECT file_ord, estimated_tokens AS t, row_number() OVER (ORDER BY relative_path, file_ord) AS i FROM {FILES}),
p AS (SELECT i, file_ord, t, 1 AS chunk_number, 0 AS pos, t AS held, t > 5000 AS closed FROM r WHERE i = 1
  UNION ALL SELECT r.i, r.file_ord, r.t, CASE WHEN p.closed OR p.held + r.t > 5000 THEN chunk_number + 1 ELSE chunk_number END, CASE WHEN p.closed OR p.held + r.t > 5000 THEN 0 ELSE pos + 1 END,
    CASE WHEN p.closed OR p.held + r.t > 5000 THEN r.t ELSE p.held + r.t END, (p.closed OR p.held + r.t > 5000) AND r.t > 5000 FROM p JOIN r ON r.i = p.i + 1)
SELECT chunk_number, pos, file_ord, t AS estimated_tokens FROM p"""
)
def chunk_pack(spark, d):
    return index.chunk_files(A.document_files(spark, d).withColumn("classification", F.lit("Unknown")), 5_000)


# Keywords of TASK: its words and identifiers, and the types that hold a word of four letters or more.
KEYWORDS = f"""(SELECT lower(keyword) AS k, count(*) AS n FROM (SELECT DISTINCT keyword FROM (SELECT unnest(['nation', 'customer', 'parser', 'text', 'Find', 'Nation']) AS keyword
  UNION ALL SELECT name FROM {TYPES} WHERE regexp_matches(lower(name), 'nation|customer|parser|text'))) GROUP BY 1)"""
SCORES = f"""(SELECT file_ord, CAST(sum(s) AS DOUBLE) AS score FROM (SELECT file_ord, 0 AS s FROM {FILES} UNION ALL SELECT file_ord, n * 10 FROM {FILES} f JOIN {KEYWORDS} w ON contains(lower(file_name), k)
  UNION ALL SELECT file_ord, n * 4 FROM {FILES} f JOIN {KEYWORDS} w ON contains(lower(relative_path), k)
  UNION ALL SELECT type_ord, n * CASE WHEN lower(name) = k THEN 20 WHEN length(k) >= 4 THEN 10 ELSE 0 END FROM {TYPES} t JOIN {KEYWORDS} w ON contains(lower(name), k)
  UNION ALL SELECT CAST(regexp_extract(type_name, '([0-9]+)$', 1) AS BIGINT), n * 5 FROM {MEMBERS} m JOIN {KEYWORDS} w ON length(k) >= 4 AND contains(lower(name), k)) GROUP BY file_ord)"""


def _task_scores(spark, d):
    types = A.chain_types(spark, d)
    return context.scores(A.document_files(spark, d), types, A.part_members(spark, d), context.keywords(spark, TASK, types))


@query(f"SELECT file_ord, score FROM {SCORES}")
def keyword_scores(spark, d):
    return _task_scores(spark, d)


@query(f"SELECT k, n FROM {KEYWORDS}")
def task_keywords(spark, d):
    return context.keywords(spark, TASK, A.chain_types(spark, d)).groupBy(F.lower("keyword").alias("k")).agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (ORDER BY score DESC, file_ord) AS i FROM (SELECT s.file_ord, s.score, f.estimated_tokens AS tokens FROM {SCORES} s JOIN {FILES} f ON s.file_ord = f.file_ord WHERE score > 0)),
p AS (SELECT 1 AS step, CAST(1 AS BIGINT) AS i, 35000 - tokens AS room FROM r WHERE i = 1
  UNION ALL SELECT p.step + 1, min(r.i), arg_min(p.room - r.tokens, r.i) FROM p JOIN r ON r.i > p.i AND r.tokens <= p.room WHERE p.step < 5 GROUP BY p.step)
SELECT r.file_ord, r.score, CAST(r.tokens AS BIGINT) AS tokens FROM p JOIN r ON p.i = r.i"""
)
def context_select(spark, d):
    return context.first_pass(_task_scores(spark, d), A.document_files(spark, d))


@query(
    f"""WITH d AS (SELECT min(member_ord) AS ord, lower(name) AS body FROM {MEMBERS} GROUP BY lower(name)),
p AS (SELECT x.ord AS a, y.ord AS b, x.body AS s, y.body AS t, greatest(length(x.body), length(y.body)) AS m, least(length(x.body), length(y.body)) AS k FROM d x JOIN d y ON x.ord < y.ord),
q AS (SELECT a, b, CASE WHEN s = t THEN 100 WHEN k < m * 0.5 THEN 0 ELSE CAST(trunc((1.0::DOUBLE - CAST(levenshtein(s, t) AS DOUBLE) / m) * 100) AS INTEGER) END AS similarity FROM p)
SELECT a, b, similarity FROM q WHERE similarity >= 50"""
)
def similarity_pairs(spark, d):
    return duplicates.similar_pairs(_names(spark, d), 50)


def _names(spark, d):
    """Each different name of a part once, with its first ord."""
    return A.part_members(spark, d).groupBy(F.col("name_lc").alias("body")).agg(F.min("member_ord").alias("ord")).withColumn("n_lines", F.length("body"))


def _texts(spark, d):
    """Every document as a block, with its normalised text."""
    return duplicates.text_blocks(A.read(spark, d, "documents").select(F.col("doc_id").alias("ord"), "text"))


# Documents by normalised text: k(ord, body, n_lines, rows), each text once by its first row, and the pairs of texts that are alike, e(a, b, similarity). DuckDB's edit distance
# counts bytes, so characters beyond ASCII change to capitals and controls, which no normalised text has.
TEXTS = r"""d AS (SELECT doc_id AS ord, trim(lower(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS body, len(string_split(text, chr(10))) AS n_lines FROM documents),
k AS (SELECT min(ord) AS ord, body, count(*) AS n_rows, length(body) AS n FROM d WHERE body <> '' GROUP BY body),
w AS (SELECT string_agg(c, '' ORDER BY c) AS other FROM (SELECT DISTINCT unnest(regexp_extract_all(body, '[^\x00-\x7F]')) AS c FROM k)),
z AS (SELECT k.*, translate(body, coalesce(other, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || (SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) FROM range(14, 32) v(i))) AS plain FROM k, w WHERE n <= 500),
g AS (SELECT DISTINCT ord, substr(body, i::INTEGER, 5) AS gram FROM (SELECT ord, body, unnest(range(1, n - 3)) AS i FROM k WHERE 2 * n > 500)),
h AS (SELECT ord, count(*) AS size FROM g GROUP BY ord),
s AS (SELECT x.ord AS a, y.ord AS b, count(*) AS shared FROM (SELECT g.*, size, n FROM g JOIN h USING (ord) JOIN k USING (ord)) x JOIN (SELECT g.*, size, n FROM g JOIN h USING (ord) JOIN k USING (ord)) y
  ON x.gram = y.gram AND x.ord < y.ord AND greatest(x.n, y.n) > 500 AND 2 * least(x.n, y.n) >= greatest(x.n, y.n) AND 5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size) GROUP BY 1, 2),
e AS (SELECT a, b, CAST(trunc(shared::DOUBLE / (p.size + q.size - shared) * 100) AS INTEGER) AS similarity FROM s JOIN h p ON p.ord = a JOIN h q ON q.ord = b WHERE similarity >= 80
  UNION ALL SELECT x.ord, y.ord, CAST(trunc((1.0::DOUBLE - levenshtein(x.plain, y.plain)::DOUBLE / greatest(x.n, y.n)) * 100) AS INTEGER) AS similarity
  FROM z x JOIN z y ON x.ord < y.ord AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) WHERE similarity >= 80)"""


@query(f"WITH {TEXTS} SELECT a, b, similarity, x.n_rows AS a_rows, y.n_rows AS b_rows FROM e JOIN k x ON x.ord = a JOIN k y ON y.ord = b")
def document_pairs(spark, d):
    return duplicates.row_pairs(_texts(spark, d))


@query(f"WITH {TEXTS} SELECT d.ord, k.ord AS class, k.n_rows FROM d JOIN k ON d.body = k.body")
def document_classes(spark, d):
    """The rows that document_pairs' texts stand for."""
    return duplicates.row_classes(_texts(spark, d))


# Texts in order: one that no seed before it is similar to is a seed itself.
@query(
    f"""WITH RECURSIVE {TEXTS},
t AS (SELECT ord, row_number() OVER (ORDER BY ord) AS i, (SELECT list(a) FROM e WHERE b = ord) AS below FROM (SELECT a AS ord FROM e UNION SELECT b FROM e)),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seeds UNION ALL
  SELECT t.i, CASE WHEN list_has_any(seeds, coalesce(below, [])) THEN seeds ELSE list_append(seeds, t.ord) END FROM r JOIN t ON t.i = r.i + 1),
f AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM r ORDER BY i DESC LIMIT 1)),
j AS (SELECT b AS ord, min(seed) AS seed, arg_min(similarity, seed) AS similarity FROM e JOIN f ON e.a = seed WHERE b NOT IN (FROM f) GROUP BY b),
c AS (SELECT seed, ord, similarity FROM j UNION ALL SELECT DISTINCT seed, seed, 100 FROM j UNION ALL SELECT ord, ord, 100 FROM k WHERE n_rows > 1 AND ord NOT IN (SELECT ord FROM j) AND ord NOT IN (SELECT seed FROM j)),
m AS (SELECT c.seed, d.ord, c.similarity, d.n_lines FROM c JOIN k ON c.ord = k.ord JOIN d ON d.body = k.body)
SELECT seed, count(*) AS n_members, max(similarity) FILTER (ord <> seed) AS similarity, CAST(sum(n_lines) AS BIGINT) AS total_lines, CAST(sum(n_lines) - max(n_lines) FILTER (ord = seed) AS BIGINT) AS saved_lines
FROM m GROUP BY seed ORDER BY n_members DESC, similarity DESC, seed LIMIT 20"""
)
def duplicate_clusters(spark, d):
    rows = _texts(spark, d)
    return duplicates.cluster_report(duplicates.row_clusters(rows), rows)


RULES = {"license": "[Ll]icensed under|License", "email": EMAIL, "shout": "!!"}


@query("UNION ALL ".join(f"SELECT '{k}' AS rule, file_ord, line_no FROM {LINES} WHERE regexp_matches(text, '{p}') " for k, p in RULES.items()))
def rule_violations(spark, d):
    return rules.line_violations(A.document_lines(spark, d), RULES)


@query(
    f"""SELECT row_number() OVER (ORDER BY file_ord, line_no) AS match_index, file_ord, line_no, regexp_replace(text, '[Ll]icensed under', 'LICENSED: ', 'g') AS new FROM {LINES} WHERE regexp_matches(text, '[Ll]icensed under') AND NOT regexp_matches(text, 'Apache')"""
)
def rule_replace(spark, d):
    return rules.grep_replace(A.document_lines(spark, d), "[Ll]icensed under", "LICENSED: ", case_sensitive=True, exclude_pattern="Apache").select(F.col("match_index").cast("long").alias("match_index"), "file_ord", "line_no", "new")


@query(f"SELECT member_ord, name, name || 'Async' AS new_name FROM {MEMBERS} WHERE kind = 'Method' AND is_async AND name NOT LIKE '%Async' AND return_type <> 'void'")
def async_naming(spark, d):
    return rules.async_without_suffix(A.part_members(spark, d)).select("member_ord", "name", "new_name")


@query(f"SELECT type_name, count(*) AS n_members FROM {MEMBERS} WHERE access_modifier = 'public' AND kind IN ('Method', 'Property') AND xml_doc = '' GROUP BY type_name")
def missing_docs(spark, d):
    return rules.undocumented(A.part_members(spark, d)).groupBy("type_name").agg(F.count("*").alias("n_members"))


@query("SELECT CAST(l_suppkey AS VARCHAR) AS directory, count(DISTINCT l_returnflag) AS n_workspaces, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS workspaces FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def shared_dirs(spark, d):
    return index.shared_directories(A.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("workspace"), F.col("l_suppkey").cast("string").alias("directory")))


@query("SELECT DISTINCT string_split(p_brand, '#')[1] || string_split(p_brand, '#')[2] AS root FROM part")
def root_distinct(spark, d):
    return index.root_namespaces(A.read(spark, d, "part").select(F.concat(F.regexp_replace("p_brand", "#", ""), F.lit("."), "p_type").alias("namespace")))


def _backups(spark, d):
    return A.read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_custkey").cast("string").alias("original"), F.col("o_orderkey").alias("size"), F.col("o_orderdate").alias("mtime"), F.col("o_orderpriority").alias("directory"))


@query("SELECT path, original FROM (SELECT CAST(o_orderkey AS VARCHAR) AS path, CAST(o_custkey AS VARCHAR) AS original, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS k FROM orders) WHERE k > 2")
def retention_excess(spark, d):
    return telemetry.retention_excess(_backups(spark, d), keep=2).select("path", "original")


@query("SELECT o_orderpriority AS directory, count(*) AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS n_bytes, min(o_orderdate) AS oldest FROM orders GROUP BY 1")
def backup_stats(spark, d):
    return telemetry.backup_stats(_backups(spark, d))


@query(f"SELECT count(*) AS n_calls, round(avg(duration_ms), 6) AS avg_ms FROM {CALLS}")
def running_average(spark, d):
    return telemetry.running_average(A.event_calls(spark, d))


@query(f"SELECT tool_name, count(*) AS n_calls, round(avg(duration_ms), 6) AS avg_ms FROM {CALLS} GROUP BY tool_name")
def tool_breakdown(spark, d):
    return telemetry.tool_breakdown(A.event_calls(spark, d))


@query(f"SELECT date_trunc('minute', ts) AS minute, count(*) AS n_calls, round(avg(duration_ms), 6) AS avg_ms FROM {CALLS} GROUP BY 1")
def activity_per_minute(spark, d):
    return telemetry.activity_per_minute(A.event_calls(spark, d))


@query(f"WITH e AS (SELECT ord, ts FROM {CALLS} WHERE is_error) SELECT ord, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS n_errors FROM e")
def recent_errors(spark, d):
    return telemetry.errors_before_each(A.event_calls(spark, d))


@query(f"SELECT ord, tool_name, duration_ms FROM {CALLS} ORDER BY duration_ms DESC, ord LIMIT 1")
def slowest_call(spark, d):
    return telemetry.slowest_call(A.event_calls(spark, d)).select("ord", "tool_name", "duration_ms")


@query(
    f"SELECT ord, tool_name, idle_seconds FROM (SELECT ord, tool_name, (epoch_us(lead(ts) OVER (PARTITION BY tool_name ORDER BY ts, ord)) - epoch_us(ts)) / 1000000.0::DOUBLE AS idle_seconds FROM {CALLS}) WHERE idle_seconds >= 45"
)
def idle_gaps(spark, d):
    return telemetry.idle_gaps(A.event_calls(spark, d), key="tool_name")


@query(f"SELECT ord, tool_name FROM {CALLS} ORDER BY ts DESC, ord DESC LIMIT 1000")
def bounded_tail(spark, d):
    return telemetry.bounded_tail(A.event_calls(spark, d)).select("ord", "tool_name")


@query(f"SELECT ord, CASE WHEN duration_ms = 0 THEN 'error' WHEN duration_ms > 2 * (SELECT avg(duration_ms) FROM {CALLS}) THEN 'slow' ELSE 'normal' END AS status FROM {CALLS} ORDER BY ts DESC, ord DESC LIMIT 60")
def chart_series(spark, d):
    return telemetry.chart_series(A.event_calls(spark, d)).select("ord", "status")


@query(f"WITH c AS (SELECT tool_name, count(*) AS n_calls FROM {CALLS} GROUP BY 1) SELECT tool_name, n_calls, n_calls * 150.0::DOUBLE / (SELECT max(n_calls) FROM c) AS bar FROM c ORDER BY n_calls DESC, tool_name LIMIT 8")
def top_tools(spark, d):
    return telemetry.top_tools(A.event_calls(spark, d))


@query("SELECT CAST(row_number() OVER (ORDER BY s, o) AS INTEGER) AS number, CASE s WHEN 0 THEN 'local' ELSE 'community' END AS source, o AS ord FROM (SELECT 0 AS s, item_id AS o FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn FROM conversations)")
def lessons_numbered(spark, d):
    local = A.read(spark, d, "benchmark").select(F.col("item_id").alias("ord"))
    community = A.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    return telemetry.numbered_lessons(local, community).select("number", "source", "ord")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return A.read(spark, d, "events").select("event_id", telemetry.json_number(F.col("props"), "k").alias("k"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'missing_semicolon' WHEN 1 THEN 'null_warning' WHEN 2 THEN 'missing_using' WHEN 3 THEN 'missing_type_unresolved' ELSE 'unknown' END AS category,
CAST(CASE p_size % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.3 WHEN 2 THEN 0.75 ELSE 0.0 END AS DOUBLE) AS confidence, CASE WHEN p_size % 5 = 2 THEN 'System.Collections.Generic' END AS resolved_data FROM part"""
)
def error_classes(spark, d):
    k = F.col("p_size") % 5
    code = F.when(k == 0, "CS1002").when(k == 1, "CS8602").when(k.isin(2, 3), "CS0246").otherwise("CS9999")
    text = F.when(k == 2, "The type 'List' could not be found").otherwise(F.concat(F.lit("The type 'X"), F.col("p_partkey").cast("string"), F.lit("' could not be found")))
    return buildlog.classified(A.read(spark, d, "part").select("p_partkey", code.alias("error_code"), text.alias("message"))).select("p_partkey", "category", "confidence", "resolved_data")


@query("SELECT page_id, count(*) AS n_links FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS u FROM pages) GROUP BY page_id")
def page_links(spark, d):
    links = A.read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"))
    return links.groupBy("page_id").agg(F.count("*").alias("n_links"))
