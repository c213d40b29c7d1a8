"""The training-data queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (alignment, decontam, importance, langid, mixing, neardup, packing, passages, quality, secrets, squares,
               tokens, warc)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": _pipeline,
        "op1_mixing": mixing.op1_mixing,
        "op2_token_packing": packing.op2_token_packing,
        "op3_language_fusion": langid.op3_language_fusion,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_order_minhash": neardup.op5_order_minhash,
        "op6_quality_divergence": quality.op6_quality_divergence,
        "op7_secret_ownership": secrets.op7_secret_ownership,
        "op8_warc": warc.op8_warc,
        "op9_paragraph_bands": passages.op9_paragraph_bands,
        "op9_paragraph_bands_within": passages.op9_paragraph_bands_within,
        "op10_bm25_decontamination": decontam.op10_bm25_decontamination,
        "op11_sum_of_squares": squares.op11_sum_of_squares,
        "op12_importance_resampling": importance.op12_importance_resampling,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_secret_ownership": secrets.OP7_SQL, "op8_warc": warc.OP8_SQL}
