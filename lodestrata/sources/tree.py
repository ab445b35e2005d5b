"""A file tree as a data source: subtrees are walked side by side, and ignored ones are never opened.

The driver opens directories from the top, level by level, until there are as many as PARTS, and no further; each is the subtree of a task, which walks it
and reads files as it goes. Names are told apart before anything below them is listed, so the cost is that of the files asked for. A filter on the
extension is pushed into the walk. The tree must be one that executors can open under the same path, such as a shared mount; for other stores files.scan
lets Spark list everything."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

#: Parts that a scan is cut into, if the tree has as many directories, and as many again for the files of directories that the driver opens.
PARTS = 200
SCHEMA = "file_path string, relative_path string, root_directory string, file_name string, extension string, size_bytes long, content binary"


def listed(directory: str, ignored: frozenset[str]) -> tuple[list[os.DirEntry], list[str]]:
    """Files and directories within a directory, in order of name, but for ignored names; of one that cannot be read, none. Links to directories are not followed."""
    try:
        with os.scandir(directory) as entries:
            kept = sorted((e for e in entries if e.name.lower() not in ignored), key=lambda e: e.name)
    except OSError:
        return [], []
    return [e for e in kept if e.is_file()], [e.path for e in kept if e.is_dir(follow_symlinks=False)]


def walked(directory: str, ignored: frozenset[str], deep: bool = True) -> Iterator[os.DirEntry]:
    """The files below a directory, or of it alone."""
    open_ = [directory]
    while open_:
        files, below = listed(open_.pop(), ignored)
        yield from files
        if deep:
            open_ += reversed(below)


class _Subtree(InputPartition):
    def __init__(self, directories: list[tuple[str, bool]]) -> None:
        self.directories = directories


class TreeReader(DataSourceReader):
    def __init__(self, root: str, ignored: list[str], extensions: list[str], content: bool, parts: int) -> None:
        self.root, self.ignored, self.content, self.parts = root, frozenset(x.lower() for x in ignored), content, parts
        wanted = {e.lower() for e in extensions}
        self.wanted = None if not wanted or "*.*" in wanted else wanted

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("extension",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Directories opened from the top have their files in one part each, and the subtrees below them in others."""
        open_, own = [self.root], []
        while open_ and len(open_) < self.parts:
            level, open_ = open_, []
            for d in level:
                own.append((d, False))
                open_ += listed(d, self.ignored)[1]
        return [_Subtree(some) for every in ([(d, True) for d in open_], own) for some in self._groups(every)]

    def _groups(self, every: list) -> list[list]:
        size = max(1, -(-len(every) // self.parts))
        return [every[k : k + size] for k in range(0, len(every), size)]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        for directory, deep in partition.directories:
            for e in walked(directory, self.ignored, deep):
                extension = os.path.splitext(e.name)[1].lower()
                if self.wanted is not None and extension not in self.wanted:
                    continue
                try:
                    size, content = e.stat().st_size, None
                    if self.content:
                        with open(e.path, "rb") as f:
                            content = f.read()
                except OSError:  # gone meanwhile, or not ours to read
                    continue
                yield e.path, os.path.relpath(e.path, self.root), self.root, e.name, extension, size, content


class TreeSource(DataSource):
    """Options: path; ignored and extensions (JSON lists); content ("false": sizes alone); parts."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        o = self.options
        return TreeReader(o["path"], json.loads(o.get("ignored", "[]")), json.loads(o.get("extensions", "[]")), o.get("content", "true") == "true", int(o.get("parts", PARTS)))


def scan_tree(spark: SparkSession, directory: str, extensions: list[str] = (), ignored: list[str] = (".git",), content: bool = True, parts: int = PARTS) -> DataFrame:
    """What files.scan gives of a directory, without opening ignored ones; content is null if it is not asked for."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"ignored": json.dumps(list(ignored)), "extensions": json.dumps(list(extensions)), "content": str(content).lower(), "parts": str(parts)}
    return spark.read.format(TreeSource.name()).options(path=directory.rstrip("/"), **options).load()
