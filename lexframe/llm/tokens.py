"""Operator 4, token counts: a digest cache.

A count belongs to (digest of the content, digest of the tokenizer). Documents
are reduced to digests in the JVM; digests without a stored count are encoded
once each (however many documents carry them), appended to the cache, and the
counts joined back. A second run over the same corpus encodes nothing.

The content digest is taken over the text as the tokenizer sees it. The
library normalises inside ``encode``; normalising more before the digest would
change counts, so the only step here is null -> ''.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, digest_columns, frugal, join_checked, read, scratch_path, stored

MODEL = "piece_bpe_32k.model"
MAX_TOKENS = 4096
CACHE = "digest binary, version string, n_tokens bigint"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file: another vocabulary or normaliser never
    meets old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_misses(misses: DataFrame, model: str) -> DataFrame:
    """``digest, text`` -> ``digest, n_tokens``. Whole texts, no begin, end or
    other special ids, no truncation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = (sp.encode(t, num_threads=1) for t in texts)
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([len(x) for x in ids], pa.int64())],
                                             ["digest", "n_tokens"])

    return misses.select("digest", "text").mapInArrow(frugal(count), "digest binary, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer, a digest once even if two runs added it
    at the same time. A cache not yet written is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, model: str = MODEL, key: str = "doc_id", text: str = "text",
                 most: int = MAX_TOKENS) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit, digest`` of every row of ``docs``.

    ``cache`` is a folder that all executors share; misses are appended to it.
    Texts cross one shuffle, after each map task has dropped its own copies
    (so a group holding a third of all rows sends one row a task); when few
    digests are missing, texts are restricted to those before it.

    Null text: 0 bytes, 0 tokens. Repeated rows: one result row each. Empty
    table: no rows, and the cache gains nothing.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    version = tokenizer_version(model_path(model))
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(digest_columns(F.col(text)).alias("digest"), body.alias("text"))
    ids = stored(docs.select(F.col(key), digest_columns(F.col(text)).alias("digest"),
                             F.octet_length(body).cast("bigint").alias("n_bytes")), "token-digests")
    known = read_cache(spark, cache, version)
    missing = stored(ids.select("digest").distinct().join(known, "digest", "left_anti"), "token-misses")
    if not missing.isEmpty():
        misses = join_checked(texts.dropDuplicates(["digest"]), missing, ["digest"], "left_semi")
        (encode_misses(misses, model).select("digest", F.lit(version).alias("version"), "n_tokens")
         .write.mode("append").parquet(cache))
    # a table of its own, so that a digest of many documents is an input that Spark can split
    counts = stored(read_cache(spark, cache, version), "token-counts")
    return ids.join(counts, "digest", "left").select(
        key, "n_bytes", "n_tokens", (F.col("n_tokens") > most).alias("over_limit"), F.hex("digest").alias("digest"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), scratch_path(spark, "token-cache"))
