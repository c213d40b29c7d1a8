"""Token counts against the library, and what the cache does."""

import awkward
import sentencepiece
from conftest import SMALL
from lexframe.llm import tokens
from lexframe.session import scratch_path
from pyspark.sql import functions as F


def brute(rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path())
    n = [len(sp.encode(t or "")) for _, t in rows]
    return sorted(((k, len((t or "").encode()), m, m > 4096) for (k, t), m in zip(rows, n)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect()), key=repr)


def test_whole_table(spark):
    d = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got(tokens.op4_token_counts(spark, SMALL)) == brute(d)


def test_cache_is_filled_once_and_used(spark, tmp_path):
    cache = scratch_path(spark, "cache")
    a = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "another"), (4, None)], "doc_id long, text string")
    assert got(tokens.count_tokens(a, cache)) == brute([tuple(r) for r in a.collect()])
    assert spark.read.parquet(cache).count() == 3
    # a stored count is believed, so a false one shows that it was used; the new text alone is added
    version = tokens.tokenizer_version(tokens.model_path())
    other = scratch_path(spark, "cache")
    spark.createDataFrame([("one text", 77)], "t string, n_tokens long").select(
        F.unhex(F.sha2("t", 256)).alias("digest"), F.lit(version).alias("version"), "n_tokens").write.parquet(other)
    rows = got(tokens.count_tokens(a, other))
    assert [r[2] for r in rows[:2]] == [77, 77] and spark.read.parquet(other).count() == 3
    # another tokenizer's counts are not
    spark.read.parquet(cache).withColumn("version", F.lit("x")).withColumn("n_tokens", F.lit(5).cast("bigint")).write.parquet(
        third := scratch_path(spark, "cache"))
    assert got(tokens.count_tokens(a, third)) == brute([tuple(r) for r in a.collect()])


def test_awkward_rows(spark, tmp_path):
    folder = awkward.table(spark, tmp_path)
    assert got(tokens.op4_token_counts(spark, folder)) == brute([(r[0], r[1]) for r in awkward.rows()])
    d = spark.read.parquet(f"{folder}/documents.parquet").filter(F.lit(False))
    assert tokens.count_tokens(d, scratch_path(spark, "cache")).count() == 0
