"""The stateless text operators on a Structured Streaming source.

The reference has no streaming operators (no state, windows or late data),
so none are invented here. Rule classification, cleaning and tokenising are
plain column expressions, so they run unchanged on a file stream; this
module wires them to ``readStream`` / ``writeStream`` with an exactly-once
file sink and a checkpoint below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import RulePack, classify
from ..session import scratch_path

DOCUMENT_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def classified(stream: DataFrame, pack: RulePack, order: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    return stream.select(key, F.md5(F.col(text)).alias("text_key"),
                         classify(pack, F.col(text), order).alias("rule_class"))


def classify_files(spark: SparkSession, source_dir: str, pack: RulePack, order: list[str], sink_dir: str | None = None,
                   schema: T.StructType = DOCUMENT_SCHEMA, max_files_per_trigger: int = 64) -> str:
    """Classify every parquet file that lands in ``source_dir`` (processes
    what is there now, then stops); returns the sink path."""
    sink = sink_dir or scratch_path(spark, "classified-stream")
    ckpt = scratch_path(spark, "classified-stream-ckpt")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    q = (classified(src, pack, order).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
