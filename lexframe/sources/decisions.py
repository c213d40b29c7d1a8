"""The marked-up decision records (S1, S7): schema of one element and its
projection to the 17-column table, text lists as arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import read_xml

ROW_TAG = "ep-appeal-decision"  # fixed value
_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k.replace("__", "-"), v) for k, v in fields.items()])


# Element and attribute names of a record.
DECISION = T.StructType([
    T.StructField("_id", T.LongType()), T.StructField("_lang", _S),
    T.StructField("ep-appeal-bib-data", _of(
        _reference=_S, ep__case__num=T.StructType([T.StructField("_code", _S), T.StructField("ep-appeal-num", _L)]),
        ep__date__of__decision=_of(date=_L), ep__ecli=_L, invention__title=_L, ep__board__of__appeal__code=_L,
        doc__number=_L, classification__ipcr=_of(text=_L), ep__keywords=_of(keyword=_L),
        ep__legal__citation=T.StructType([T.StructField("ep-legal-ref-presentation", _L)]), ep__cited__decision=_L)),
    T.StructField("ep-summary-of-facts", T.StructType([T.StructField("_lang", _S), T.StructField("p", _L)])),
    T.StructField("ep-reasons-for-decision", _of(p=_L)), T.StructField("ep-appeal-order", _of(p=_L)),
])


def _one(c: str):
    """A single value as a list; none as an empty one."""
    return F.array_compact(F.array(F.col(c)))


def decision_table(records: DataFrame) -> DataFrame:
    """One row a record: ``case_id`` and the 17 columns, all lists of texts;
    what a record lacks is an empty list."""
    bib = "`ep-appeal-bib-data`."
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return records.select(
        F.col("_id").alias("case_id"), _one(bib + "_reference").alias("reference"), _one("_lang").alias("procedure_lang"),
        _one(bib + "`ep-case-num`._code").alias("court_type"), some(bib + "`ep-case-num`.`ep-appeal-num`").alias("appeal_number"),
        _one("`ep-summary-of-facts`._lang").alias("document_lang"), some("`ep-summary-of-facts`.p").alias("summary_facts"),
        some("`ep-reasons-for-decision`.p").alias("decision_reasons"), some("`ep-appeal-order`.p").alias("order_text"),
        some(bib + "`ep-date-of-decision`.date").alias("date"), some(bib + "`ep-ecli`").alias("ecli"),
        some(bib + "`invention-title`").alias("title"), some(bib + "`ep-board-of-appeal-code`").alias("board_code"),
        some(bib + "`classification-ipcr`.text").alias("classification"), some(bib + "`ep-keywords`.keyword").alias("keywords"),
        some(bib + "`doc-number`").alias("app_no"),
        some(bib + "`ep-legal-citation`.`ep-legal-ref-presentation`").alias("legal_provisions"),
        some(bib + "`ep-cited-decision`").alias("cited"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return decision_table(read_xml(spark, path, ROW_TAG, DECISION))
