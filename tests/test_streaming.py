"""The stateless rule operators give the same answer on a file stream."""

from pyspark.sql import functions as F

from conftest import SMALL
from lexframe.functions import rulepacks as RP
from lexframe.functions.rules import classify
from lexframe.session import scratch_path
from lexframe.streaming.classify import classify_files


def test_stream_equals_batch(spark):
    # a landing folder of parquet files, as a stream source expects
    landing = scratch_path(spark, "landing")
    spark.read.parquet(f"{SMALL}/documents.parquet").repartition(4).write.parquet(landing)
    sink = classify_files(spark, landing, RP.LICENCE, RP.LICENCE_ORDER, max_files_per_trigger=1)
    got = sorted((r.doc_id, r.rule_class) for r in spark.read.parquet(sink).collect())
    d = spark.read.parquet(f"{SMALL}/documents.parquet")
    exp = sorted((r.doc_id, r.c) for r in d.select("doc_id", classify(RP.LICENCE, F.col("text"),
                                                                      RP.LICENCE_ORDER).alias("c")).collect())
    assert got == exp
