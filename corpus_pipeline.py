"""Corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, byte pairs.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, line_dedup, ngram_join, quality_rules
from tallyspark.llm.shared import shared_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    left = line_dedup.dedup_lines(docs)
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a question of the benchmark go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit integers), and whether decoding gives the text back."""
    encoded = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))))
    n_tokens = (F.octet_length("ids") / 4).cast("bigint")
    return encoded.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_common_lines),
    ("ngram_join", keep_one),
    ("decontaminate", keep_clean),
    ("byte_pairs", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The verdict of the quality rules is fitted by expectation-maximisation, which SQL does not express; see tests/llm.
ORACLE_SQL = None
