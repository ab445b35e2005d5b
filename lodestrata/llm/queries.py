"""One query per operator over its whole table, with the results that the contracts name, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ego_join, exact_dedup, langid, licenses, mixing, negatives, ngram_join, packing, repeats, runs, shards, toxicity, webp
from .common import WORD, cut


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The production tokenizer. The import is here: only this query needs the package of vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_docs(spark, sf_dir), size=4, percent=85)


def op2_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_of_documents(_docs(spark, sf_dir))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.round(x, 9).alias(n) for x, n in ((F.col("positions")[0], "position"), (F.col("positions")[1], "second_position"))]
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", *at)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_docs(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_docs(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir), tokenizer_path())


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licensed(_docs(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def _with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs, with the words of every tenth document by hash repeating from some word on, as the query's contract plants them."""
    h = F.crc32(docs["doc_id"].cast("string"))
    words = F.regexp_extract_all(F.coalesce(docs["text"], F.lit("")), F.lit(WORD), F.lit(0))
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    begin = g % n
    period = 1 + F.floor((n - begin) / (3 + g % 8))
    times = F.ceil((n - begin) / period).cast("int")
    part = lambda at, length: F.slice(words, (at + 1).cast("int"), length.cast("int"))
    planted = F.slice(F.concat(part(F.lit(0), begin), F.flatten(F.array_repeat(part(begin, period), times))), 1, n.cast("int"))
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), F.array_join(planted, " ")).otherwise(docs["text"]).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_with_planted_periods(_docs(spark, sf_dir)))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = runs.strongest(F.col("runs"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))  # as the query's contract has it
    return negatives.hard_negatives(vectors.withColumn("label", moved))


def op13_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    n_bytes = F.octet_length(F.encode(F.coalesce(docs["text"], F.lit("")), "utf-8")).cast("long")
    media = cut(webp.to_media(docs.select("doc_id", n_bytes.alias("n_bytes"), webp.payload_of(docs["text"]).alias("media"))), "media")
    read = webp.pixel_arrays(media, pixels=False)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(F.substring("samples", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_ngram_jaccard, op2_ego_join, op3_toxicity, op4_compaction, op5_curriculum_mix, op6_langid, op7_suffix_dedup, op8_sum_of_squares, op9_licenses, op10_exact_dedup, op11_periodic_runs, op12_hard_negatives, op13_lossless_webp)
}



def _time_sql(share: str, rank: str) -> str:
    """The training time at which a source of that rank has met a share of its demand: the area under its schedule, inverted."""
    number = lambda x: f"{x!r}e0" if "e" not in repr(x) else repr(x)
    cases = []
    for k, knots in enumerate(mixing.SCHEDULES):
        step, done = 1.0 / (len(knots) - 1), 0.0
        total = sum((a + b) / 2 * step for a, b in zip(knots, knots[1:], strict=False))
        pieces = []
        for i, (a, b) in enumerate(zip(knots, knots[1:], strict=False)):
            a, b, area = a / total, b / total, (a + b) / 2 * step / total
            u = f"greatest({share} - {number(done)}, 0e0)"
            x = f"2e0 * {u} / ({number(a)} + sqrt(greatest({number(a * a)} + {number(2 * (b - a) / step)} * {u}, 0e0)))"
            done += area
            at = number(i * step)
            pieces.append((number(done), f"CASE WHEN {u} <= 0 THEN {at} ELSE {at} + least({x}, {number(step)}) END"))
        inner = " ".join(f"WHEN {share} < {end} THEN {value}" for end, value in pieces[:-1])
        cases.append(f"WHEN {k} THEN (CASE {inner} ELSE {pieces[-1][1]} END)")
    return f"(CASE {rank} % {len(cases)} {' '.join(cases)} END)"


ORACLE_SQL: dict[str, str] = {
    "op5_curriculum_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT source, source_size, k, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), l AS (
  SELECT level FROM f WHERE level * weight <= cap ORDER BY cap / weight, k LIMIT 1
), t AS (
  SELECT source, k, source_size, least(cap, coalesce((SELECT level FROM l) * weight, cap)) AS target FROM f
), o AS (
  SELECT d.doc_id, d.size, t.k, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS goal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, goal - begun)) + greatest(0, least(size, goal - source_size - begun)) AS BIGINT) AS taken,
       round(CASE WHEN least(size, goal - begun) > 0 THEN """
    + _time_sql("(begun / target)", "k")
    + """ END, 9) AS position,
       round(CASE WHEN least(size, goal - source_size - begun) > 0 THEN """
    + _time_sql("((begun + source_size) / target)", "k")
    + """ END, 9) AS second_position
FROM o""",
    "op10_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n""",
}


def _licenses_sql() -> str:
    """The templates as rows; lines, paragraphs and runs of words, their bigrams, and the coefficient."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    bodies = [(name, k, body) for name, every in sorted(licenses.TEMPLATES.items()) for k, body in enumerate(every)]
    values = ", ".join(f"({quote(n)}, {k}, {quote(' '.join(licenses.words_of(b)))})" for n, k, b in bodies)
    anchors = ", ".join(map(quote, licenses.ANCHORS))
    return rf"""
WITH b(license, k, p) AS (SELECT l, k, string_split(t, ' ') FROM (VALUES {values}) v(l, k, t)),
t AS (SELECT DISTINCT license, k, p[j] || ' ' || p[j + 1] AS gram FROM (SELECT license, k, p, unnest(range(1, len(p))) AS j FROM b)), m AS (SELECT license, k, count(*) AS n FROM t GROUP BY 1, 2),
u AS (SELECT DISTINCT doc_id, unit FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents
  UNION ALL SELECT doc_id, unnest(string_split_regex(text, '
[ 	
]*
')) FROM documents)),
w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS p FROM u),
i AS (SELECT doc_id, unit, p, unnest(range(1, len(p))) AS j FROM w),
g AS (SELECT DISTINCT doc_id, unit, p[j] || ' ' || p[j + 1] AS gram FROM i), s AS (SELECT doc_id, unit, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT g.doc_id, g.unit, t.license, t.k, count(*) AS both FROM g JOIN t ON g.gram = t.gram GROUP BY 1, 2, 3, 4),
d AS (SELECT c.doc_id, c.unit, c.license, 2.0::DOUBLE * c.both / (s.n + m.n) AS dice FROM c JOIN s ON c.doc_id = s.doc_id AND c.unit = s.unit JOIN m ON c.license = m.license AND c.k = m.k),
h AS (SELECT doc_id, unit, license, dice, row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, license) AS r FROM d WHERE dice >= 0.8),
q AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS p FROM documents),
x AS (SELECT doc_id, p, j FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS j FROM q) WHERE p[j] IN ({anchors})),
a AS (SELECT license, k, len(p) AS n, o, p[o] AS word FROM (SELECT license, k, p, unnest(range(1, len(p) + 1)) AS o FROM b) WHERE p[o] IN ({anchors})),
f AS (SELECT DISTINCT doc_id, license, k, j - o + 1 AS begun, list_slice(x.p, greatest(j - o + 1, 1), j - o + a.n) AS p FROM x JOIN a ON x.p[x.j] = a.word),
v AS (SELECT DISTINCT doc_id, license, k, begun, p[j] || ' ' || p[j + 1] AS gram FROM (SELECT *, unnest(range(1, len(p))) AS j FROM f)),
y AS (SELECT v.doc_id, v.license, v.k, v.begun, count(*) AS n, count(t.gram) AS both FROM v LEFT JOIN t ON v.license = t.license AND v.k = t.k AND v.gram = t.gram GROUP BY 1, 2, 3, 4),
z AS (SELECT doc_id, license, dice FROM (SELECT y.doc_id, y.license, 2.0::DOUBLE * y.both / (y.n + m.n) AS dice FROM y JOIN m ON y.license = m.license AND y.k = m.k) WHERE dice >= 0.8),
e AS (SELECT doc_id, license, max(dice) AS dice, sum(unit) AS units FROM (SELECT doc_id, license, dice, 1 AS unit FROM h WHERE r = 1 UNION ALL SELECT doc_id, license, dice, 0 FROM z) GROUP BY 1, 2),
n AS (SELECT doc_id, CAST(sum(greatest(units, 1)) AS BIGINT) AS n, string_agg(license, ',' ORDER BY license) AS names FROM e GROUP BY 1),
o AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS r FROM e)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_notices, o.license, o.dice, coalesce(n.names, '') AS licenses
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id LEFT JOIN o ON documents.doc_id = o.doc_id AND o.r = 1"""


ORACLE_SQL["op9_licenses"] = _licenses_sql()
ORACLE_SQL["op1_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS p FROM documents
), i AS (SELECT doc_id, p, unnest(range(1, greatest(len(p) - 3, 1) + 1)) AS j FROM w WHERE len(p) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(p[j:j + 3], ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x.a, x.b FROM x JOIN n p ON x.a = p.doc_id JOIN n q ON x.b = q.doc_id WHERE 100 * x.both >= 85 * (p.n + q.n - x.both)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.reach) AS component_id FROM r LEFT JOIN n ON r.node = n.doc_id GROUP BY r.node"""

ORACLE_SQL["op2_ego_join"] = """
WITH RECURSIVE u AS (
  SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), v AS (SELECT vec_id, label, i, CAST(x AS DOUBLE) AS x FROM u),
q AS (SELECT vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY vec_id),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.x * b.x) AS dot FROM v a JOIN v b ON a.label = b.label AND a.i = b.i WHERE a.vec_id <> b.vec_id GROUP BY 1, 2),
e AS (SELECT d.a, d.b FROM d JOIN q p ON d.a = p.vec_id JOIN q t ON d.b = t.vec_id WHERE p.norm > 0 AND t.norm > 0 AND d.dot / (p.norm * t.norm) >= 0.98),
r AS (SELECT vec_id AS node, vec_id AS reach FROM embeddings UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node), k AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT c.node AS vec_id, coalesce(k.n, 0) AS n_links, c.component_id, c.node = c.component_id AS kept FROM c LEFT JOIN k ON c.node = k.a"""


ORACLE_SQL["op11_periodic_runs"] = r"""
WITH m AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY n) AS crc FROM range(256) v(n)),
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS p, 4294967295 - list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT))), lambda x, y: xor(x >> 8, crc[1 + (xor(x, y) & 255)])) AS h FROM documents, m),
c AS (SELECT doc_id, p, h % 10 = 0 AND len(p) > 0 AS planted, (h // 10) % greatest(len(p), 1) AS a, 3 + (h // 10) % 8 AS parts FROM o),
w AS (SELECT doc_id, CASE WHEN planted THEN list_transform(range(len(p)), lambda i: p[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(p) - a) // parts) END]) ELSE p END AS p FROM c),
i AS (SELECT doc_id, len(p) AS n, unnest(range(len(p))) AS i, unnest(p) AS word FROM w),
e AS (SELECT b.doc_id, b.i - a.i AS q, b.i AS j FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.word = b.word AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
k AS (SELECT doc_id, q, j, j - row_number() OVER (PARTITION BY doc_id, q ORDER BY j) AS island FROM e),
s AS (SELECT doc_id, q, min(j) - q AS start, count(*) + q AS length FROM k GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY doc_id, start, length),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS nth FROM r),
g AS (SELECT DISTINCT i.doc_id, i.i FROM i JOIN r ON i.doc_id = r.doc_id AND i.i >= r.start + r.period AND i.i < r.start + r.length),
l AS (SELECT i.doc_id, string_agg(word, ' ' ORDER BY i.i) AS rest FROM i LEFT JOIN g ON i.doc_id = g.doc_id AND i.i = g.i WHERE g.i IS NULL GROUP BY i.doc_id)
SELECT o.doc_id, coalesce(t.n_runs, 0) AS n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period AS exponent_milli,
       sha256(coalesce(t.lines, '')) AS runs_sha256, sha256(coalesce(l.rest, '')) AS collapsed_sha256
FROM o LEFT JOIN t ON o.doc_id = t.doc_id LEFT JOIN b ON o.doc_id = b.doc_id AND b.nth = 1 LEFT JOIN l ON o.doc_id = l.doc_id"""

ORACLE_SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: NOT coalesce(isfinite(x), false))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_inner_product(a.e, o.e) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3"""
