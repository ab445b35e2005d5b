"""Source files to base tables: one pass parses each file, in the language of its extension."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, language_of
from ..plans.index import classification, python_classification
from ..plans.shared import cut, map_texts
from ..tables import Corpus, lines_of
from . import csharp, python_code

_MEMBER = "struct<name:string,kind:string,return_type:string,signature:string,access_modifier:string,parameters:array<string>,body:string,is_static:boolean,is_async:boolean,is_virtual:boolean,is_override:boolean,is_abstract:boolean,start_line:int,end_line:int,xml_doc:string>"
_TYPE = f"struct<name:string,full_name:string,kind:string,base_type:string,interfaces:array<string>,is_abstract:boolean,start_line:int,end_line:int,xml_doc:string,members:array<{_MEMBER}>>"
_CALL = "struct<caller_type:string,caller_method:string,called_type:string,called_method:string,line:int,is_property_access:boolean>"
PARSED = f"struct<namespace:string,usings:array<string>,dependencies:array<string>,types:array<{_TYPE}>,calls:array<{_CALL}>,error:string>"
_EMPTY = {"namespace": "", "usings": [], "dependencies": [], "types": [], "calls": []}


def parse(text: str, name: str) -> dict:
    """What a file declares; nothing for other languages, nothing but an error if it cannot be read."""
    try:
        if name.lower().endswith(".cs"):
            return csharp.parse(text)
        if name.lower().endswith(".py"):
            return python_code.parse(text, name.rsplit(".", 1)[0])
    except (ValueError, IndexError, AttributeError, RecursionError) as e:
        return _EMPTY | {"error": f"{type(e).__name__}: {e}"}
    return _EMPTY


def _key(of: str, room: int) -> Column:
    """A number for a place within a number: an error where the place does not fit."""
    return F.col(of) * room + F.when(F.col("pos") < room, F.col("pos")).otherwise(F.raise_error(F.concat(F.lit(f"more than {room} rows within {of} "), F.col(of).cast("string"))).cast("int"))


def corpus(files: DataFrame) -> Corpus:
    """Base tables of files(file_ord, file_path, relative_path, file_name, extension, size_bytes, content).

    A file that cannot be parsed declares nothing and says why in parse_error. Keys of types, members and sites are places in their file behind its number: file_ord is below
    9 * 10**8, and a file has fewer than 10**5 types, a type fewer than 10**5 members, a file fewer than 10**6 calls; more is an error, never a collision."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [json.dumps(parse(t or "", n)) for t, n in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, "parsed"])

    kept = files.select(F.col("file_ord").cast("long"), "file_path", "relative_path", "file_name", "extension", F.col("size_bytes").cast("long"), F.decode("content", "UTF-8").alias("text"))
    rows = map_texts(kept, run, "file_ord long, file_path string, relative_path string, file_name string, extension string, size_bytes long, text string, parsed string")
    # Written once: five tables come from it, and a lost executor must not have files parsed again.
    rows = cut(rows.withColumn("parsed", F.from_json("parsed", PARSED)), "parsed")
    kinds = F.transform("parsed.types", lambda t: F.struct(t["base_type"].alias("base_type"), t["interfaces"].alias("interfaces")))
    path, name = F.col("relative_path"), F.col("file_name")
    kind = F.when(F.col("extension") == ".py", python_classification(path, name, F.transform("parsed.types", lambda t: t["base_type"]))).otherwise(classification(path, name, kinds))
    out = rows.select("file_ord", "file_path", "relative_path", "file_name", "extension", language_of(F.col("extension")).alias("language"), kind.alias("classification"), F.col("parsed.namespace").alias("namespace"), "size_bytes", estimated_tokens(F.col("size_bytes")).alias("estimated_tokens"), F.col("parsed.usings").alias("usings"), F.col("parsed.dependencies").alias("dependencies"), F.col("parsed.error").alias("parse_error"), "text")
    types = rows.select("file_ord", F.posexplode("parsed.types").alias("pos", "t"))
    types = types.select(_key("file_ord", 100_000).alias("type_ord"), "file_ord", "t.*").withColumn("name_lc", F.lower("name"))
    members = types.select("type_ord", F.col("name").alias("type_name"), "file_ord", F.posexplode("members").alias("pos", "m"))
    members = members.select(_key("type_ord", 100_000).alias("member_ord"), "type_ord", "type_name", "file_ord", "m.*").withColumn("name_lc", F.lower("name"))
    sites = rows.select("file_ord", "file_path", F.posexplode("parsed.calls").alias("pos", "c")).select(_key("file_ord", 1_000_000).alias("site_ord"), "c.*", "file_path")
    return Corpus(out, types.drop("members"), members, sites, lines_of(out, native=True))


def tokens(files: DataFrame) -> DataFrame:
    """file_ord, token: identifiers of C# files(file_ord, text) outside literals and comments."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [(o, t) for o, s in zip(*(c.to_pylist() for c in b.columns), strict=True) for t in re.findall(r"\b[A-Za-z_]\w*", csharp.blanked(s or ""))]
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.array([t for _, t in found], pa.string())], names=["file_ord", "token"])

    return map_texts(files.select(F.col("file_ord").cast("long"), "text"), run, "file_ord long, token string")
