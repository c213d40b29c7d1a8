"""The two main flows over whole tables: XML records -> labelled cases (E1) ->
experiment splits (E2). The records are written from ``orders``, with texts
that the rule packs decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import decisions as D
from ..sources import files as FS
from .catalog import query, t
from .corpus import experiment_split as split_cases
from .corpus import label_cases as label

OPPOSED = ("1-URGENT", "2-HIGH", "3-MEDIUM")
CUT = 2010
SHIFT = 10  # years added to an order's date, so that decisions fall into the cohort
PREAMBLE = "Summary of Facts and Submissions I."
FACTS = ("Appeal by the proprietor against the decision of the opposition division.",
         "The examining division refused the application.")


def write_records(spark, sf) -> str:
    """A record for each order; urgent ones are there twice, the second time
    without a title, so that the dedup drops it."""
    o = t(spark, sf, "orders").withColumn("opposed", F.col("o_orderpriority").isin(*OPPOSED))
    day = F.date_format(F.add_months("o_orderdate", 12 * SHIFT), "yyyyMMdd")
    o = o.withColumn("day", day).withColumn("copy", F.explode(F.when(
        F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    facts = F.concat(F.lit(PREAMBLE), F.when(F.col("opposed"), FACTS[0]).otherwise(FACTS[1]))
    order = (F.when(F.col("o_orderstatus") == "F", "The appeal is dismissed.")
             .when(F.col("o_orderstatus") == "O", "The decision under appeal is set aside.").otherwise("The parties were heard."))
    key = F.col("o_orderkey").cast("string")
    ecli = F.concat(F.lit("ECLI:EP:BA:"), F.substring("day", 1, 4), F.lit(":T"), F.lpad(key, 9, "0"), F.lit("."), F.col("day"))
    one = lambda c: F.array(c if not isinstance(c, str) else F.lit(c))
    values = {
        "_reference": F.concat(F.lit("T"), key), "ep-case-num": F.struct(F.lit("T").alias("_code"), one(key).alias("ep-appeal-num")),
        "ep-date-of-decision": F.struct(one(F.col("day")).alias("date")), "ep-ecli": one(ecli),
        "invention-title": F.when(F.col("copy") == 0, one("A & B <C>")), "ep-board-of-appeal-code": one("3.2.1"),
        "doc-number": one(F.concat(F.lit("EP"), key)), "classification-ipcr": F.struct(one("A61K 31/00").alias("text")),
        "ep-keywords": F.struct(F.array(F.lit("novelty"), F.lit("inventive step")).alias("keyword")),
        "ep-legal-citation": F.struct(one("EPC_Art_056").alias("ep-legal-ref-presentation")),
        "ep-cited-decision": F.array().cast("array<string>")}
    rec = o.select(
        (F.col("o_orderkey") * 2 + F.col("copy")).alias("_id"), F.lit("en").alias("_lang"),
        F.struct(*[v.alias(k) for k, v in values.items()]).alias("ep-appeal-bib-data"),
        F.struct(F.lit("en").alias("_lang"), one(facts).alias("p")).alias("ep-summary-of-facts"),
        F.struct(one("Reasons.").alias("p")).alias("ep-reasons-for-decision"), F.struct(one(order).alias("p")).alias("ep-appeal-order"))
    path = scratch_path(spark, "decisions")
    FS.write_xml(rec, path, D.ROW_TAG, "records")
    return path


def cases(spark, sf) -> DataFrame:
    """E1, written once: every split starts from the labelled table."""
    path = scratch_path(spark, "cases")
    FS.write_table(label(D.read_decisions(spark, write_records(spark, sf))), path)
    return spark.read.parquet(path)


_CASES = f"""SELECT o_orderkey * 2 AS case_id, year(o_orderdate) + {SHIFT} AS year,
  CASE WHEN o_orderpriority IN {OPPOSED} THEN 'Opposition Division' ELSE 'Patent Refusal' END AS case_type,
  CASE WHEN o_orderpriority IN {OPPOSED} THEN '1' END AS appellant_type,
  CASE o_orderstatus WHEN 'F' THEN 'Affirmed' WHEN 'O' THEN 'Reversed' ELSE 'Unknown' END AS outcome
FROM orders WHERE year(o_orderdate) + {SHIFT} BETWEEN 2000 AND 2024"""


@query("label_cases", f"SELECT *, 'Inventive Step' AS articles, 'A & B <C>' AS title FROM ({_CASES})")
def label_cases(spark, sf):
    """XML records -> 17 columns -> cleaned, deduplicated, classified cases."""
    return cases(spark, sf).select("case_id", F.col("year").cast("bigint").alias("year"), "case_type", "appellant_type", "outcome",
                                   F.array_join("matched_articles", "|").alias("articles"), "title")


@query("experiment_split", lambda: f"""
WITH c AS (SELECT *, CAST(outcome = 'Affirmed' AS INTEGER) AS label FROM ({_CASES}) WHERE outcome <> 'Unknown'),
h AS (SELECT *, md5('42:' || CAST(case_id AS VARCHAR)) AS h FROM c),
sizes AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q FROM h),
r AS (SELECT h.*, row_number() OVER (PARTITION BY label ORDER BY h, case_id)
        - (CASE label WHEN 1 THEN p ELSE q END - least(p, q)) AS place, least(p, q) AS m FROM h CROSS JOIN sizes),
w AS (SELECT *, CAST(ceil(2 * m * CAST(0.2 AS DOUBLE) - 1e-9) AS BIGINT) AS pool FROM r),
one AS (SELECT case_id, '1' AS experiment, 'both' AS case_mode,
          CASE WHEN place <= pool // 2 + CASE WHEN label = 0 THEN pool % 2 ELSE 0 END THEN 'test' ELSE 'train' END AS split,
          case_type, label FROM w),
es AS (SELECT count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS q
       FROM h WHERE case_type = 'Patent Refusal' AND year < {CUT}),
er AS (SELECT h.*, row_number() OVER (PARTITION BY label ORDER BY h, case_id)
         - (CASE label WHEN 1 THEN p ELSE q END - least(p, q)) AS place FROM h CROSS JOIN es
       WHERE case_type = 'Patent Refusal' AND year < {CUT}),
two AS (SELECT case_id, '2', 'pf', 'train', case_type, label FROM er WHERE place > 0
        UNION ALL SELECT case_id, '2', 'pf', 'test', case_type, label FROM h WHERE case_type = 'Patent Refusal' AND year >= {CUT})
SELECT case_id, experiment, case_mode, split, label,
       CASE case_type WHEN 'Patent Refusal' THEN '{FACTS[1]}' ELSE '{FACTS[0]}' END AS text
FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
""")
def experiment_split(spark, sf):
    """E2 from the stored cases: experiment 1 on both case types, experiment 2
    on refusals."""
    c = cases(spark, sf)
    cols = ["case_id", "experiment", "case_mode", "split", "label", "text"]
    return split_cases(c, "both", "1").select(*cols).unionByName(split_cases(c, "pf", "2", CUT).select(*cols))
