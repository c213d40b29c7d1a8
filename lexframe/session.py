"""Session and shared-storage helpers.

Cluster runs get their SparkSession (and ``spark.checkpoint.dir``) from the
launcher; local runs and tests call :func:`local_session`. Everything the
library writes (round-trip tables, lineage cuts) goes below the shared folder
named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The shared folder of each application whose session names none.
_OWN_DIRS: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "lexframe") -> SparkSession:
    """A local session configured like the tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written tables and checkpoints.

    Reads ``spark.checkpoint.dir`` from the session. Where it is unset, a
    single-machine session (tests, bench) gets a private folder and a cluster
    session a folder below its warehouse, which its executors share.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not d:
        context = spark.sparkContext
        d = _OWN_DIRS.get(context.applicationId)
        if not d:
            if context.master.startswith("local[") or context.master == "local":
                d = tempfile.mkdtemp(prefix="lexframe-shared-")
            else:
                d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lexframe_scratch"
            _OWN_DIRS[context.applicationId] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
