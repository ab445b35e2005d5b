"""The ten queries against their SQL, and the pipeline stage by stage against plain versions."""

import math
import re
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from lodestrata.llm import mixing, queries, toxicity

from . import brute
from .test_contracts import check_packing


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall()), key=str)


def test_compaction_query(spark, sf):
    """Every row is in one live shard of the committed version, whose size is that of its rows' texts."""
    docs = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_compaction(spark, sf).collect()
    assert Counter(r.doc_id for r in rows) == Counter(docs.keys())
    size, count = Counter(), Counter()
    for r in rows:
        size[r.shard] += docs[r.doc_id]
        count[r.shard] += 1
    assert all((r.shard_bytes, r.shard_rows) == (size[r.shard], count[r.shard]) for r in rows)


def stages_of(spark, docs, sf):
    """The rows after each stage."""
    out, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
        rows = now.collect()
        out[name] = (now.columns, rows)
        now = spark.createDataFrame(rows, now.schema)
    return out


def test_pipeline_against_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = stages_of(spark, docs, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard", "mixing", "packing"]
    assert all(stages[n][0] == docs.columns for n in list(stages)[:-1])
    before = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    clean = {i: r for i, r in before.items() if scores[i] < 0.5}
    assert {r.doc_id: r for r in stages["toxicity"][1]} == clean and 0 < len(clean) < len(before)

    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    first = {}
    for i in sorted(clean):
        first.setdefault(norm(clean[i].text), i)
    single = {i: clean[i] for i in first.values()}
    assert {r.doc_id: r for r in stages["exact_dedup"][1]} == single and len(single) < len(clean)

    groups = brute.jaccard_components({i: r.text for i, r in single.items()}, 5, 80)
    far = {i: r for i, r in single.items() if groups[i][1] == i}
    assert {r.doc_id: r for r in stages["ngram_jaccard"][1]} == far and len(far) < len(single)

    plan = {r.doc_id: r.repeats for r in mixing.mix(spark.createDataFrame(list(far.values()), docs.schema)).collect()}
    mixed = Counter(r.doc_id for r in stages["mixing"][1])
    assert mixed == Counter({i: n for i, n in plan.items() if n}) and all(r == far[r.doc_id] for r in stages["mixing"][1])

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    ids = {i: [*tokenizer.encode(far[i].text or "", add_special_tokens=False).ids, 0] for i in mixed}
    check_packing(stages["packing"][1], ids.__getitem__, 2048)
    assert sum(r.length for r in stages["packing"][1]) == sum(len(ids[i]) * n for i, n in mixed.items())

    run = corpus_pipeline.run(spark, sf).collect()
    pieces = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(run) == pieces(stages["packing"][1])


def test_stages_on_hard_rows(spark, tmp_path):
    from .test_contracts import HARD, table

    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, HARD)
    out = stages_of(spark, docs, str(tmp_path))
    assert all(out[n][0] == docs.columns for n in list(out)[:-1])
    assert len(out["toxicity"][1]) == len(HARD)  # nothing is known to be toxic
    ids = sorted((r.doc_id for r in out["exact_dedup"][1]), key=str)
    assert ids == sorted([-5, 1, 3, 4, 5, 7, 8, 9, 10, 11, 13, 14, 15], key=str)
    near = {r.doc_id for r in out["ngram_jaccard"][1]}
    assert near == {-5, 1, 3, 4, 5, 8, 9, 10, 14, 15}  # 7 is 5 but for case; 11 and 13 are near -5
    empty = stages_of(spark, docs.filter("false"), str(tmp_path))
    assert all(not rows for _, rows in empty.values())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    from pyspark.sql import functions as F

    from .test_contracts import table

    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, [(i, f"some words of text number {i} " * (i + 1), f"s{i % 2}") for i in range(8)] + [(9, "some words of text number 0 ", "s1")])
    names = ["_n", "_at", "_row", "_text", "_k", "_key", "_gone", "_keep", "hits", "component_id", "repeats", "Position", "a b"]
    docs = docs.withColumns({n: F.lit(i) for i, n in enumerate(names)})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        rows = now.collect()
        assert rows and all(r[n] == i for r in rows for i, n in enumerate(names)), name
