"""File trees: scans with extensions, ignored directories and ignore files; projects; lists of directories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, file_name
from ..plans.shared import numbered

#: Directories that a repository scan always ignores, and groups of extensions.
REPOSITORY_IGNORED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
PRESETS = {
    "csharp": (".cs", ".xaml", ".csproj", ".sln", ".slnx", ".props", ".targets"),
    "python": (".py", ".pyi", ".pyx", ".ipynb"),
    "web": (".html", ".css", ".js", ".ts", ".tsx", ".jsx", ".vue", ".svelte"),
    "data": (".json", ".xml", ".yaml", ".yml", ".csv", ".toml"),
    "docs": (".md", ".txt", ".rst"),
}


def with_preset(extensions: list[str], preset: str) -> list[str]:
    return list(dict.fromkeys([*extensions, *PRESETS[preset]]))


def active_directories(directories: DataFrame, disabled: DataFrame) -> DataFrame:
    return directories.join(disabled, "directory", "left_anti")


def accepted(path: Column, extensions: list[str], ignored: list[str]) -> Column:
    """Whether no segment of the path is ignored and its extension is in the list; an empty list or *.* takes all."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    out = ~F.arrays_overlap(parts, F.array(*[F.lit(x.lower()) for x in ignored])) if ignored else F.lit(True)
    wanted = [e.lower() for e in extensions]
    return out if not wanted or "*.*" in wanted else out & extension(path).isin(*wanted)


def scan(spark: SparkSession, directory: str, extensions: list[str] = (), ignored: list[str] = (".git",)) -> DataFrame:
    """file_path, relative_path, root_directory, file_name, extension, size_bytes, content of the files below a directory.

    The predicates are on the path, which Spark lists before it reads: content is read for files that pass, if it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    plain = F.regexp_replace("path", "^file:/*", "/")
    rel = F.regexp_replace(F.replace(plain, F.lit(re.sub("^file:/*", "/", directory).rstrip("/")), F.lit("")), "^/+", "")
    files = files.select(plain.alias("file_path"), rel.alias("relative_path"), F.lit(directory).alias("root_directory"), file_name(plain).alias("file_name"), extension(plain).alias("extension"), F.col("length").alias("size_bytes"), "content")
    return files.filter(accepted(F.col("relative_path"), list(extensions), list(ignored)))


def scan_all(spark: SparkSession, directories: list[str], extensions: list[str] = (), ignored: list[str] = (".git",)) -> DataFrame:
    """The scans of several directories, each file once, with file_ord, its rank by path."""
    rows = reduce(DataFrame.unionByName, [scan(spark, d, extensions, ignored) for d in directories]).dropDuplicates(["file_path"])
    return rows.join(numbered(rows.select("file_path"), ["file_path"], "file_ord"), "file_path")


def scan_totals(files: DataFrame) -> DataFrame:
    n = F.coalesce(F.sum("size_bytes"), F.lit(0))
    return files.agg(F.count("*").alias("n_files"), n.alias("size_bytes"), F.floor(n / 4).alias("estimated_tokens"))


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file, without blank and comment lines."""
    rows = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> '' and not startswith(v, '#')")
    return [r.v for r in rows.collect()]


def ignored_by(path: Column, patterns: list[str]) -> Column:
    """Whether a pattern matches: a trailing slash names a directory anywhere; with a star, the whole path (one star stays within a
    segment, two do not); else the path or any segment of it. There is no negation."""
    p, parts = F.translate(path, "\\", "/"), F.split(F.translate(path, "\\", "/"), "/")
    out = F.lit(False)
    for raw in patterns:
        t = raw.removeprefix("/")
        if t.endswith("/"):
            hit = F.array_contains(parts, t.rstrip("/"))
        elif "*" in t:
            body = ".*".join("[^/]*".join(re.escape(x) for x in y.split("*")) for y in t.split("**"))
            hit = F.rlike(p, F.lit(f"^{body}$"))
        else:
            hit = (p == t) | F.array_contains(parts, t)
        out = out | hit
    return out


def repository_files(files: DataFrame, extensions: list[str] = (), ignored: list[str] = (), patterns: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """files(relative_path, ...) that a repository scan takes: prefixes to include and to exclude are compared in any case."""
    rel = F.lower("relative_path")
    rows = files.filter(accepted(F.col("relative_path"), list(extensions), [*ignored, *REPOSITORY_IGNORED])).filter(~ignored_by(F.col("relative_path"), list(patterns)))
    starts = lambda ps: reduce(lambda a, b: a | b, [rel.startswith(p.lower()) for p in ps])
    rows = rows.filter(starts(include)) if include else rows
    return rows.filter(~starts(exclude)) if exclude else rows


def project_facts(files: DataFrame) -> DataFrame:
    """file_ord, project_refs, packages, framework, output, namespace of projects(file_ord, file_name, text)."""
    x = lambda p: F.xpath("text", F.lit(p))
    one = lambda p: F.try_element_at(x(p), F.lit(1))
    return files.select(
        "file_ord", x("//ProjectReference/@Include").alias("project_refs"), x("//PackageReference/@Include").alias("packages"),
        one("//TargetFramework/text()").alias("framework"), one("//OutputType/text()").alias("output"),
        F.coalesce(one("//RootNamespace/text()"), one("//AssemblyName/text()"), F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("namespace"),
    )


def project_references(facts: DataFrame, files: DataFrame) -> DataFrame:
    """source_project, relative_path, resolved_path, name: references resolved against the project's directory."""
    from ..functions.text import directory, resolved_path, stem

    rows = facts.join(files.select("file_ord", F.col("relative_path").alias("project_path")), "file_ord").select("project_path", F.explode("project_refs").alias("relative_path"))
    return rows.select(stem(F.col("project_path")).alias("source_project"), "relative_path", resolved_path(F.concat_ws("/", directory(F.col("project_path")), "relative_path")).alias("resolved_path"), stem(F.col("relative_path")).alias("name"))
