"""Base tables of a corpus: schemas and the container the operators take.

Order is part of the semantics: every table has an ord column, and every limit sorts by it last. Names that are compared
without regard to case have a lower-case twin, so the comparison stays an equi-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILES = (
    "file_ord bigint, file_path string, relative_path string, root_directory string, source_workspace string, file_name string, extension string, "
    "language string, classification string, namespace string, size_bytes bigint, estimated_tokens int, usings array<string>, dependencies array<string>"
)
TYPES = (
    "type_ord bigint, file_ord bigint, name string, name_lc string, full_name string, kind string, base_type string, interfaces array<string>, "
    "is_abstract boolean, start_line int, end_line int, xml_doc string"
)
MEMBERS = (
    "member_ord bigint, type_ord bigint, file_ord bigint, name string, name_lc string, kind string, return_type string, signature string, "
    "access_modifier string, parameters array<string>, body string, is_static boolean, is_async boolean, is_virtual boolean, is_override boolean, "
    "is_abstract boolean, start_line int, end_line int, xml_doc string"
)
CALL_SITES = (
    "site_ord bigint, caller_type string, caller_method string, called_type string, called_method string, file_path string, line int, "
    "is_property_access boolean"
)
USAGE_ORDER = ("Definition", "Reference", "Implementation", "Override", "Invocation")


@dataclass
class Corpus:
    files: DataFrame
    types: DataFrame
    members: DataFrame
    call_sites: DataFrame
    lines: DataFrame | None = None  # file_ord, line_no from 1, text

    def typed_members(self) -> DataFrame:
        """members with the name of their type."""
        return self.members.join(self.types.select("type_ord", F.col("name").alias("type_name")), "type_ord")


def lines_of(files: DataFrame, text: str = "text", native: bool = False) -> DataFrame:
    """file_ord, line_no, text of files(file_ord, text). native: as a line reader sees it, without an empty piece after the last
    line feed and without carriage returns."""
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n$", "") if native else F.col(text)
    out = files.select("file_ord", F.posexplode(F.split(body, "\n")).alias("pos", "text"))
    return out.select("file_ord", (F.col("pos") + 1).alias("line_no"), "text")
