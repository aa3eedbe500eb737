"""Token counts behind a cache of content digests.

The cache is a Parquet table of (tokenizer digest, content digest, count).
Documents are reduced to digests first; only one text for each digest that
the cache lacks is encoded, and its count appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscreen.llm.arrays import small_batches, text_array
from pairscreen.llm.tokens import Encoder, splits_words
from pairscreen.session import materialize, scratch_path

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column, white_space_dropped: bool) -> Column:
    """SHA-256 of the text as the tokenizer sees it. For a tokenizer that
    drops white space, runs of it count as one space and ends are trimmed;
    nothing else is changed, so equal digests mean equal counts."""
    seen = F.coalesce(text, F.lit(""))
    if white_space_dropped:
        seen = F.trim(F.regexp_replace(seen, r"[\x09-\x0D\x20]+", " "))
    return F.unhex(F.sha2(seen, 256))


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache table at ``path``, created empty if there is none. Entries
    appended twice by runs side by side count once."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("ignore").parquet(path)
    found = spark.read.schema(CACHE_SCHEMA).parquet(path)
    return found.groupBy("tokenizer", "digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, digest`` for every row.

    ``cache_path`` is a folder on shared storage; without one the cache lives
    for this call. NULL text is empty. Rows with equal texts share a digest;
    rows with equal or NULL ids keep their own results. Other columns are
    ignored. The rows of one digest meet only as partial aggregates and in a
    join with a unique side, which adaptive execution splits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    dropped = tokenizer.endswith(".json") and splits_words(tokenizer)
    version = tokenizer_digest(tokenizer)
    path = cache_path or scratch_path(spark, "token-cache")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    keyed = materialize(rows.select(
        "_id", content_digest(F.col("_text"), dropped).alias("digest"),
        F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long").alias("n_bytes")), "token-digests")
    known = open_cache(spark, path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    # one row stands for each digest that has no count yet
    missing = materialize(keyed.groupBy("digest").agg(F.min("_id").alias("_one")).join(
        known, "digest", "left_anti"), "token-misses")
    texts = rows.withColumn("digest", content_digest(F.col("_text"), dropped)).alias("t").join(
        missing.alias("m"), (F.col("t.digest") == F.col("m.digest")) & F.col("t._id").eqNullSafe(F.col("m._one")),
        "left_semi").select("digest", "_text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = counter(tokenizer), set()
        for batch in batches:
            keep = []
            for i, digest in enumerate(batch.column(0).to_pylist()):
                if digest not in seen:  # repeated rows, id included
                    seen.add(digest)
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            counts = encoder(text_array(part.column(1)))
            yield pa.record_batch([pa.array([version] * len(keep), pa.string()), part.column(0),
                                   pa.array(counts, pa.int64())], names=["tokenizer", "digest", "n_tokens"])

    texts.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(path)
    counts = open_cache(spark, path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")
    return keyed.join(counts, "digest", "left").select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", "digest")


def counter(tokenizer: str):
    """A function from a text column to its counts, for one task."""
    if tokenizer.endswith(".json"):
        return Encoder(tokenizer).lengths
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    return lambda texts: [len(x) for x in model.encode([t or "" for t in texts.to_pylist()], num_threads=1)] if len(
        texts) else []
