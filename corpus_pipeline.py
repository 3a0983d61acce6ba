"""A corpus from raw documents to tokens: five stages, each a DataFrame of documents for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, exact_dedup, langid, mixing, simhash
from trailmark.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or between two languages go."""
    return langid.keep_identified(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it draws, in random order; copies repeat its row."""
    return mixing.mix(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, input_ids and whether they decode to the text."""
    rows = docs.select("doc_id", "source", "lang", bpe.checked(F.col("text")).alias("t"))
    return rows.select("doc_id", "source", "lang", F.size("t.input_ids").cast("long").alias("n_tokens"), "t.input_ids", "t.round_trip")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("source_mixing", mixing_stage),
    ("byte_bpe", tokenize),
]

#: The language of a text cannot be told in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
