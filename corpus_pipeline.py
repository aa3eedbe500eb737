"""From raw documents to packed training sequences, in five stages.

Every stage gets all rows that the one before it kept, as a Parquet table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairscreen.llm import language, minhash, mixing, quality
from pairscreen.llm.catalog import MIX_SHARE, MIX_WEIGHTS, packed
from pairscreen.session import materialize

#: Language and perplexity come from statistics over the stage's own rows, near
#: duplicates from confirmed links; no part of it can be said in SQL.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages, and puts the language found
    into ``lang``."""
    return language.keep_identified(docs)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents less likely than nearly all trusted ones of their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that shares 80 % of its runs of five words."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source to its target: rows come back once, twice, or not at all."""
    return mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold every row."""
    return packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", judge_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
