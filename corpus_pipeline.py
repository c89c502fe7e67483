"""From raw documents to packed training sequences: five stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm import line_dedup, minhash, mixing, packing, toxicity
from chronoloom.llm.common import table
from chronoloom.llm.queries import tokenizer_file
from chronoloom.session import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the model is fitted on these documents and the labels table.

    Rows of one doc_id go or stay together. Rows without an id, and null or empty texts that score below 0.5, stay. An empty
    table stays empty.
    """
    judged = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    bad = judged.where("predicted = 1").select(F.col("doc_id").alias("__bad_id")).distinct()
    return docs.join(bad, F.col("doc_id") == F.col("__bad_id"), "left_anti")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals go, and documents of which no line stays.

    Null and empty texts have no lines to lose and stay. n_chars is counted anew where lines went (null stays null elsewhere).
    """
    kept = line_dedup.dedup_lines(docs)
    kept = kept.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Documents without words are in no group and stay, as do rows without an id. Rows of one doc_id go or stay together.
    """
    judged = minhash.near_duplicates(docs, words=5, percent=80)
    gone = judged.where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone_id"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one like the others. Those without words have no size and are taken once."""
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 1024; a null or empty text is the one closing token."""
    return packing.pack_documents(docs, tokenizer_file(), capacity=1024, eos=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]
# The first stage is a fitted model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
