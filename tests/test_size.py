"""What a query holds in one place does not grow with its tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from lodestrata.operators import context


def test_many_keywords_are_not_broadcast(spark):
    n = context.FEW_WORDS + 5
    types = spark.range(n).selectExpr("id as file_ord", "concat('Customer', id) as name")
    files = spark.range(3).selectExpr("id as file_ord", "concat('Customer', id) as file_name", "concat('a/Customer', id) as relative_path")
    members = types.limit(0)
    scored = context.scores(files, types, members, types.select(types["name"].alias("keyword")))
    found = {r.file_ord: r.score for r in scored.collect()}
    assert len(found) == n and found[0] == 10 + 4 + 20 and found[12] == 20 + 10 and found[5000] == 20 + 3 * 10  # Customer12 holds Customer1, Customer5000 three others
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()


def test_ranked_files_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(context, "cut", lambda df, tag: seen.append(df) or df)
    scored, files = spark.sql("select id as file_ord, double(id) as score from range(9)"), spark.sql("select id as file_ord, 10 as estimated_tokens from range(9)")
    assert [r.file_ord for r in context.first_pass(scored, files).collect()] == [8, 7, 6, 5, 4]
    assert "Broadcast" not in seen[0]._jdf.queryExecution().executedPlan().toString()


def test_parsers_get_their_batches_in_slices(spark, monkeypatch):
    from lodestrata.operators import edits, rules
    from lodestrata.plans import shared
    from lodestrata.sources import code, markup

    batch = pa.RecordBatch.from_pydict({"file_ord": list(range(100)), "text": ["x" * 100_000] * 99 + [None]})
    parts = list(shared.slices(batch))
    assert sum(p.num_rows for p in parts) == 100 and max(p.nbytes for p in parts) <= shared.SLICE
    seen = []
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda *a: seen.append(a))
    files = spark.sql("select 1 as file_ord, 'a.py' as file_path, 'a.py' as relative_path, 'a.py' as file_name, '.py' as extension, 9 as size_bytes, 'def f(): g()' as text")
    assert code.corpus(files.withColumn("content", files["text"].cast("binary"))).call_sites.count() == 2
    assert [r.token for r in code.tokens(files).collect()] == ["def", "f", "g"]
    assert edits.diffs(files.selectExpr("file_ord", "text as old", "'b' as new")).first().is_rewrite
    assert rules.rule_matches(files, {"findpattern": "f"}).count() == 2
    assert markup.nodes(files.selectExpr("file_ord", "'<Grid/>' as text")).count() == 1
    assert not seen


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    from lodestrata.plans.store import IndexStore

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        store = IndexStore(spark, f"file://{tmp_path}/s", buckets=1)
        rows = spark.range(0, 40_000, 1, 8).selectExpr("concat('f', id) as file_path", "id as file_ord")
        generation, buckets = store._write("files", rows, "file_path")
    finally:
        spark.conf.set(name, before)
    at = tmp_path / "s" / "data" / "files" / generation / "bucket=0"
    assert buckets == {0} and len(list(at.glob("*.parquet"))) > 1
    assert spark.read.parquet(f"file://{at}").count() == 40_000


def test_texts_of_a_group_are_read_once_for_its_pairs(spark, monkeypatch):
    """Near copies are alike pair by pair; no step gets a row with the texts of each pair."""
    import random

    from lodestrata.operators import duplicates

    r = random.Random(5)
    base = "".join(r.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(c if r.random() > 0.004 else "x" for c in base) + str(i) for i in range(60)]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in texts]
    want = {(i, j, p) for i in range(60) for j in range(i + 1, 60) if (p := int(len(sets[i] & sets[j]) / len(sets[i] | sets[j]) * 100)) >= 80}
    rows, seen, mapped = spark.createDataFrame(list(enumerate(texts)), "ord long, body string"), [], DataFrame.mapInArrow

    def counted(df, *a, **b):
        if any("body" in c for c in df.columns):
            seen.append(df.count())
        return mapped(df, *a, **b)

    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    if hasattr(duplicates, "GROUP_ROWS"):
        monkeypatch.setattr(duplicates, "GROUP_ROWS", 20)  # several parts in the group
    assert {tuple(p) for p in duplicates.similar_pairs(rows, 80).collect()} == want and len(want) > 1000
    assert max(seen) <= 60


def test_clusters_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    import random

    from lodestrata.operators import duplicates

    def greedy(pairs):
        taken, out = set(), set()
        for seed in sorted({p for pair in pairs for p in pair}):
            if seed not in taken:
                mine = [b for a, b in sorted(pairs) if a == seed and b not in taken]
                taken |= {seed, *mine}
                out |= {(seed, b) for b in [seed, *mine] if mine}
        return out

    r = random.Random(1)
    chain, some = {(i, i + 1) for i in range(40)}, {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}
    seen, cut = [], duplicates.cut
    monkeypatch.setattr(duplicates, "cut", lambda df, tag: seen.append(tag) or cut(df, tag))
    for pairs, few in ((chain, None), (some, None), (some, 3)):
        if few is not None and hasattr(duplicates, "FEW_PAIRS"):
            monkeypatch.setattr(duplicates, "FEW_PAIRS", few)  # rounds, and an end
        table = spark.createDataFrame([(a, b, 90) for a, b in pairs], "a long, b long, similarity int")
        assert {(x.seed, x.ord) for x in duplicates.clusters(table, table).collect()} == greedy(pairs)
        assert few is not None or len(seen) < 8
        seen.clear()


def test_texts_to_compare_reach_python_a_few_at_a_time(spark):
    """A worker does not hold all pairs of a batch of 10,000: memory of the workers hardly grows over pairs of 300 MB."""
    import threading

    import psutil

    from lodestrata.operators import edits

    def held() -> int:
        total = 0
        for p in psutil.Process().children(recursive=True):
            try:
                total += p.memory_full_info().uss if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name() else 0
            except psutil.Error:  # it has ended meanwhile
                pass
        return total

    text = "concat_ws('\\n', 'a', repeat(concat(id, ' word '), 4000))"
    pairs = lambda n: spark.range(0, n, 1, 1).selectExpr("id as file_ord", f"{text} as old", f"concat('b', substring({text}, 2)) as new")
    edits.diffs(pairs(300)).count()  # a worker is there
    before, most, over = held(), [0], threading.Event()

    def watch() -> None:
        while not over.is_set():
            most[0] = max(most[0], held())

    watching = threading.Thread(target=watch)
    watching.start()
    try:
        rows = edits.diffs(pairs(4000)).selectExpr("count(*)", "count_if(startswith(diff, '--- \\n+++ \\n@@ -1,2 +1,2 @@\\n-a\\n+b\\n '))", "count_if(is_rewrite)").first()
    finally:
        over.set()
        watching.join()
    assert tuple(rows) == (4000, 4000, 0)
    assert before and most[0] - before < 60e6


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    """A row that holds two blocks goes to Python where it is made, and blocks go when no later step reads them."""
    import random

    from lodestrata.operators import duplicates

    r = random.Random(8)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in [40] * 60 + [900] * 60]
    texts += [t[:-1] + "x" for t in texts]
    rows, seen, released, mapped, release = spark.createDataFrame(list(enumerate(texts)), "ord long, body string"), [], [], DataFrame.mapInArrow, duplicates.release
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda df, *a, **b: seen.append(df) or mapped(df, *a, **b))
    monkeypatch.setattr(duplicates, "release", lambda *t: released.extend(t) or release(*t))
    monkeypatch.setattr(duplicates, "SHORT_ROWS", 8)
    monkeypatch.setattr(duplicates, "BLOCK_ROWS", 8)
    assert {(p.a, p.b) for p in duplicates.similar_pairs(rows, 90).collect()} == {(i, i + 120) for i in range(120)}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen if "x_block" in df.columns]
    assert len(plans) == 2 and all("Repartition" not in p.split("Join")[0] for p in plans)
    assert len(released) >= 3


def test_texts_are_shuffled_once_and_shuffle_files_go(spark):
    import tempfile
    from pathlib import Path

    from lodestrata.operators import duplicates

    def files() -> set[Path]:
        return set(Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("**/blockmgr-*/*/shuffle_*.data"))

    rows, before = spark.range(0, 2000, 1, 4).selectExpr("id as ord", "concat(repeat(sha2(string(id % 1900), 256), 3)) as body", "1 as n_lines"), files()
    classes, members = duplicates.text_classes(rows)
    assert not files() - before
    assert classes.count() == 1900 and members.filter("class <> ord").count() == 100


def test_tables_of_pairs_go_when_no_later_step_reads_them(spark, monkeypatch):
    from lodestrata.operators import duplicates

    texts = ["abcdefgh " * n for n in range(60, 90)] + ["some words", "some word", "others"]
    rows, tags, gone = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[-3:])], "ord long, body string, n_lines int"), {}, []
    cut, release = duplicates.cut, duplicates.release

    def written(df, tag):
        out = cut(df, tag)
        tags[out] = tag
        return out

    monkeypatch.setattr(duplicates, "cut", written)
    monkeypatch.setattr(duplicates, "release", lambda *t: gone.extend(t) or release(*t))
    found = {(r.a, r.b, r.a_rows, r.b_rows) for r in duplicates.row_pairs(rows, 80).collect()}
    assert (30, 31, 2, 2) in found and (0, 1, 1, 1) in found
    assert sorted(tag for df, tag in tags.items() if all(df is not t for t in gone)) == ["short", "similar", "texts", "units"]
