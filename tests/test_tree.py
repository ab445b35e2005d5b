"""The tree as a data source against Spark's own listing."""

import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import files, tree


@pytest.fixture
def root(spark, sf, tmp_path):
    """Documents as a tree of sources and languages, with ignored directories at two levels."""
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "text").collect():
        below = ("bin", "src/Obj", "src")[r.doc_id % 3] if r.doc_id % 5 == 0 else ""
        at = tmp_path / "t" / r.source / r.lang / below
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{r.doc_id}{('.txt', '.CS', '')[r.doc_id % 3]}").write_text(r.text or "")
    return str(tmp_path / "t")


def rows(df):
    return sorted((r.file_path, r.relative_path, r.root_directory, r.file_name, r.extension, r.size_bytes, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize(("extensions", "ignored", "parts"), [([], ["bin", "obj"], 5), ([".txt", ".cs"], ["OBJ"], 1), ([".cs"], [], 500)])
def test_same_as_the_listing(spark, root, extensions, ignored, parts):
    got = rows(tree.scan_tree(spark, root, extensions, ignored, parts=parts))
    assert got and got == rows(files.scan(spark, root, extensions, ignored))


def test_extensions_are_pushed_into_the_walk(spark, root):
    asked = tree.scan_tree(spark, root, [], ["bin"], content=False).filter((F.col("extension") == ".cs") & (F.col("size_bytes") > 10))
    got = asked.collect()
    assert {r.extension for r in got} == {".cs"} and all(r.content is None for r in got)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "size_bytes" in plan.split("Filter", 1)[1].splitlines()[0] and "extension" not in plan.split("Filter", 1)[1].splitlines()[0].replace("isnotnull(extension", "")


def test_ignored_directories_are_never_opened(root, monkeypatch):
    opened, scandir = [], os.scandir

    def watched(path):
        opened.append(path)
        assert not {"bin", "obj"} & set(path.lower().split("/")), path
        return scandir(path)

    monkeypatch.setattr(os, "scandir", watched)
    for parts in (1, 4, 1000):
        reader = tree.TreeReader(root, ["bin", "obj"], [".txt"], False, parts)
        cut = reader.partitions()
        got = [r[1] for p in cut for r in reader.read(p)]
        assert len(got) == len(set(got)) > 0 and len(cut) <= 2 * parts
    monkeypatch.undo()
    every = {os.path.relpath(os.path.join(d, n), root) for d, below, names in os.walk(root) for n in names if n.endswith(".txt")}
    assert set(got) == {p for p in every if not {"bin", "obj"} & set(p.lower().split("/"))}
    assert [r for p in tree.TreeReader(root + "/none", [], [], False, 3).partitions() for r in tree.TreeReader(root, [], [], False, 3).read(p)] == []
