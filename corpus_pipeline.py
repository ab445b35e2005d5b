"""Documents through the operators of lodestrata.llm, stage by stage.

All stages but the last keep the columns of their documents, whatever their names; an empty table gives no rows. What each does with
null and repeated ids and with texts that are null, empty or very long is told below and tested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from lodestrata.llm.common import cut, release
from lodestrata.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay. Null and empty texts have no hits and stay; rows with the same text stay or go together; ids play no
    part. Without labels of both kinds nothing is known to be toxic, or all is."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the smallest doc_id stays, one with a null id only where there is no other; a null text counts as empty. Rows that repeat an
    id are rows of their own: a text that no other row has stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 over five words, the smallest doc_id stays. Rows without an id or without words are linked with
    nothing and stay; rows that repeat an id are one document."""
    return ngram_join.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are there as often as the mix takes them, in the order of training. Null and empty texts have no words: the mix takes none of
    them. A null source is a source, the last."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences; a null or empty text is one end mark. Ids come out as they went in."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
