"""The store of tables and indexes: batches of changes against a full build, versions, writers that fail, streams."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import index
from lodestrata.plans.store import Conflict, IndexStore

FILES = "file_path string, file_ord long, dependencies array<string>"
TYPES = "file_path string, file_ord long, type_ord long, name string, base_type string, interfaces array<string>"
CALLS = "file_path string, caller_type string, caller_method string, called_type string, called_method string"


def content(i, edition):
    rng = random.Random(i * 1000 + edition)
    name = lambda: f"T{rng.randrange(12)}"
    return {"deps": [name() for _ in range(2)], "types": [(name(), name() if rng.random() < 0.7 else None, [name()]) for _ in range(2)], "calls": [(name(), "m", name(), "n") for _ in range(3)]}


def rows(files):
    out = [], [], []
    for i, c in sorted(files.items()):
        path = f"f{i}"
        out[0].append((path, i, c["deps"]))
        out[1].extend((path, i, 10 * i + k, *t) for k, t in enumerate(c["types"]))
        out[2].extend((path, *x) for x in c["calls"])
    return out


def tables(spark, files):
    return {n: spark.createDataFrame(r, s) for n, r, s in zip(("files", "types", "call_sites"), rows(files), (FILES, TYPES, CALLS), strict=True)}


def full(base):
    types = base["types"]
    deps = index.dependency_map(types, base["files"])
    return {"type_hierarchy": index.type_hierarchy(types), "dependency_map": deps, "file_dependencies": index.file_dependencies(types), "call_graph": index.call_graph(base["call_sites"])}


def same_as_full(spark, store, files, version=None):
    want = full(tables(spark, files))
    for name in store.indexes:
        got = store.index(name, version)
        assert sorted(map(str, got.collect())) == sorted(map(str, want[name].select(*got.columns).collect())), name


def test_batches_equal_a_full_build(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/s", buckets=8)
    assert store.version() == 0 and store.index("call_graph") is None and store.table("files") is None
    files = {i: content(i, 0) for i in range(20)}
    assert store.apply(tables(spark, files)) == 1
    first = dict(files)
    same_as_full(spark, store, files)
    edited = {i: content(i, 1) for i in (3, 4, 25)}
    store.apply(tables(spark, edited), spark.createDataFrame([("f7",), ("f4",), ("unknown",)], "file_path string"))
    files |= edited
    del files[7]
    same_as_full(spark, store, files)
    same_as_full(spark, store, first, version=1)  # readers of a version keep it
    before = {(r.name, r.bucket): r.generation for r in store.manifest()}
    one = {9: content(9, 0) | {"calls": content(9, 5)["calls"]}}  # its calls alone differ
    store.apply(tables(spark, one))
    files |= one
    after = {(r.name, r.bucket): r.generation for r in store.manifest()}
    kept = [k for k in after if after[k] == before.get(k)]
    assert {n for n, _ in set(after) - set(kept)} == {"files", "types", "call_sites", "call_graph"}  # one bucket of each base table, and the callers'
    assert sum(n == "files" for n, _ in kept) == sum(n == "files" for n, _ in after) - 1 and any(n == "call_graph" for n, _ in kept)
    same_as_full(spark, store, files)
    some = sorted({r.caller for r in store.index("call_graph").collect()})[:2]
    assert sorted(map(tuple, store.index("call_graph", keys=some).collect())) == sorted(tuple(r) for r in store.index("call_graph").collect() if r.caller in some)
    store.apply(tables(spark, {}), spark.createDataFrame([(f"f{i}",) for i in files], "file_path string"))
    assert store.index("call_graph") is None and store.table("types") is None  # nothing is left
    assert store.clean() == 0 and store.clean(keep_versions=1, older_than_s=0) > 0


def test_a_build_that_ends_halfway_is_not_seen(spark, tmp_path, monkeypatch):
    store = IndexStore(spark, f"file://{tmp_path}/s", buckets=4)
    files = {i: content(i, 0) for i in range(6)}
    store.apply(tables(spark, files))
    write = IndexStore._write

    def dies(self, name, rows, key):
        if name == "dependency_map":
            raise RuntimeError("killed")
        return write(self, name, rows, key)

    monkeypatch.setattr(IndexStore, "_write", dies)
    with pytest.raises(RuntimeError):
        store.apply(tables(spark, {2: content(2, 9)}))
    monkeypatch.setattr(IndexStore, "_write", write)
    assert store.version() == 1
    same_as_full(spark, store, files)
    assert store.clean(older_than_s=0) > 0  # what it has left
    store.apply(tables(spark, {2: content(2, 9)}))
    same_as_full(spark, store, files | {2: content(2, 9)})
    held = store.manifest(1)
    with pytest.raises(Conflict):  # a writer that began before the last commit
        store._commit({(r.name, r.bucket): r.generation for r in held}, 1, None)


def test_stream_of_changes(spark, tmp_path):
    def parse(changed):
        lines = changed.select("file_path", F.substring("file_path", 2, 9).cast("long").alias("file_ord"), F.split("content", ">").alias("p"))
        files = lines.select("file_path", "file_ord", F.array().cast("array<string>").alias("dependencies"))
        types = lines.select("file_path", "file_ord", F.col("file_ord").alias("type_ord"), F.col("p")[0].alias("name"), F.col("p")[1].alias("base_type"), F.array().cast("array<string>").alias("interfaces"))
        calls = lines.select("file_path", F.col("p")[0].alias("caller_type"), F.lit("m").alias("caller_method"), F.col("p")[1].alias("called_type"), F.lit("m").alias("called_method"))
        return {"files": files, "types": types, "call_sites": calls}

    store = IndexStore(spark, f"file://{tmp_path}/s", buckets=4)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("file_path string, content string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")

    def run():
        store.feed(stream, parse).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination(120)

    put = lambda *r: spark.createDataFrame(list(r), "file_path string, content string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    put(("f1", "A>B"), ("f2", "C>B"))
    run()
    put(("f1", "A>C"), ("f2", None))
    run()
    assert sorted(map(tuple, store.index("call_graph").collect())) == [("A.m", "C.m")]
    assert [tuple(r) for r in store.index("type_hierarchy").collect()] == [("A", ["C"])]
    version, last = store.version(), max(r.batch for r in store.manifest())
    rows = spark.createDataFrame([("f9", "X>Y")], "file_path string, content string")
    assert store.apply(parse(rows), batch=last) == version  # a batch that comes again
