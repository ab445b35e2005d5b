"""The driver's tables in the shape of base tables: documents as files, parts as members, order lines as call sites,
customers, nations and regions as types in a chain, events as telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from ..tables import Corpus, lines_of


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with their text: path source/lang/doc_id.txt, namespace source."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_ord"), path.alias("relative_path"), name.alias("file_name"), F.lit(".txt").alias("extension"), F.col("lang").alias("language"),
        F.col("source").alias("namespace"), F.col("n_chars").alias("size_bytes"), estimated_tokens(F.col("n_chars")).alias("estimated_tokens"), "text",
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(document_files(spark, sf_dir))


def chain_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers derive from nations, nations from regions; a market segment is an interface. Regions are abstract."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    none = F.array().cast("array<string>")
    kind = lambda o, name, base, faces, abstract: [o.cast("long").alias("type_ord"), name.alias("name"), base.alias("base_type"), faces.alias("interfaces"), F.lit(abstract).alias("is_abstract")]
    top = region.select(*kind(F.col("r_regionkey"), F.col("r_name"), F.lit(""), none, True))
    middle = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*kind(F.col("n_nationkey") + 100, F.col("n_name"), F.col("r_name"), none, False))
    leaves = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*kind(F.col("c_custkey") + 1000, F.col("c_name"), F.col("n_name"), F.array("c_mktsegment"), False))
    every = top.unionByName(middle).unionByName(leaves)
    return every.select("*", F.col("type_ord").alias("file_ord"), F.lower("name").alias("name_lc"), F.lit("Class").alias("kind"), F.lit(1).alias("start_line"))


def part_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as members of their brand."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("member_ord"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("type_ord"), F.col("p_brand").alias("type_name"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("file_ord"), F.regexp_replace("p_name", " ", "_").alias("name"), F.lower(F.regexp_replace("p_name", " ", "_")).alias("name_lc"),
        F.element_at(F.array(*map(F.lit, ("Method", "Property", "Field", "Constructor"))), size % 4 + 1).alias("kind"),
        F.element_at(F.array(*map(F.lit, ("public", "private", "protected"))), size % 3 + 1).alias("access_modifier"),
        F.col("p_type").alias("return_type"), (F.col("p_partkey") % 4 == 0).alias("is_async"), (F.col("p_partkey") % 5 == 0).alias("is_static"), (F.col("p_partkey") % 7 == 0).alias("is_override"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise("").alias("xml_doc"), F.array(F.concat_ws(" ", "p_type", "p_name")).alias("parameters"), (size + 1).alias("start_line"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: distinct parts on consecutive lines of an order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    return line.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), "dst").distinct()


def part_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as call sites: the part of a line calls the part of the next. Method names are m and the part key."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    after = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    brand = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(after, ["l_orderkey", "l_linenumber"])
    rows = rows.join(brand.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("caller_type")), "l_partkey")
    rows = rows.join(brand.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("called_type")), "dst")
    method = lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))
    order = F.col("l_orderkey") * 100_000_000_000 + F.col("l_linenumber") * 10_000_000_000 + F.col("l_partkey") * 100_000 + F.col("dst")
    return rows.select(
        order.alias("site_ord"), "caller_type", method("l_partkey").alias("caller_method"), "called_type", method("dst").alias("called_method"),
        F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linenumber").cast("int").alias("line"), F.lit(False).alias("is_property_access"),
    )


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: ord, ts, tool_name, duration_ms, is_error."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "ts", F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"), (F.col("event_type") == "error").alias("is_error"))


def chain_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(document_files(spark, sf_dir), chain_types(spark, sf_dir), part_members(spark, sf_dir), part_call_sites(spark, sf_dir), document_lines(spark, sf_dir))
