"""The corpus pipeline: raw documents to packed training rows.

Each stage takes ``(spark, docs, sf_dir)``, with ``docs`` the Parquet table that
its predecessor left, and returns what is written for the next one. All but the
last return the columns of ``documents``.

1. language identification: documents without an accepted language go;
2. near-duplicates: one document of each class stays;
3. benchmark decontamination: documents that carry a test item go;
4. mixing: rows as often as their source's target asks, in training order;
5. packing: rows of token ids, with segment ends and positions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexframe.llm import decontam, langid, mixing, neardup, packing
from lexframe.llm.common import read, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no text likelihoods, sketches or byte-pair merges: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the
    shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
