"""Joins and set operations: write-back, resume
anti-join, run plan, unions, intersections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rulepacks as RP
from ..functions.rules import classify, classify_combined
from . import oracle_rules as OR
from .catalog import docs, query, t

EXPERIMENTS = ["1", "2"]
CASE_MODES = ["pf", "op", "both"]


@query("label_writeback", lambda: f"""
WITH c AS (SELECT doc_id, text,
    {OR.classify_sql(RP.LICENCE, OR.flags_sql(RP.LICENCE, 'text'), RP.LICENCE_ORDER)} AS rule_class FROM documents),
sub AS (SELECT doc_id,
    {OR.combined_sql(RP.APPELLANT_TYPE, OR.flags_sql(RP.APPELLANT_TYPE, 'text'), '3', ('2', '1'), RP.APPELLANT_ORDER)}
      AS appellant_type FROM c WHERE rule_class = 'with_the')
SELECT c.doc_id, c.rule_class, coalesce(sub.appellant_type, c.rule_class) AS final_class
FROM c LEFT JOIN sub ON c.doc_id = sub.doc_id
""")
def label_writeback(spark, sf):
    """Sub-class labels computed on one class only, written back onto the
    full table by a left join on the key (J1)."""
    d = docs(spark, sf)
    c = d.select("doc_id", "text", classify(RP.LICENCE, F.col("text"), RP.LICENCE_ORDER).alias("rule_class"))
    sub = c.filter(F.col("rule_class") == "with_the").select(
        "doc_id", classify_combined(RP.APPELLANT_TYPE, F.col("text"), "3", ("2", "1"), RP.APPELLANT_ORDER)
        .alias("appellant_type"))
    j = c.drop("text").join(sub, "doc_id", "left")
    return j.select("doc_id", "rule_class", F.coalesce("appellant_type", "rule_class").alias("final_class"))


def run_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of runs: every algorithm seen in the results x experiments x
    case modes. The two small axes are literal arrays exploded per row, so
    the grid needs no join."""
    algos = t(spark, sf, "events").select(F.col("event_type").alias("algo")).distinct()
    return (algos.withColumn("experiment", F.explode(F.array(*[F.lit(e) for e in EXPERIMENTS])))
            .withColumn("case_mode", F.explode(F.array(*[F.lit(m) for m in CASE_MODES]))))


_PLAN_SQL = """plan AS (
  SELECT algo, experiment, case_mode FROM (SELECT DISTINCT event_type AS algo FROM events),
    (VALUES ('1'), ('2')) e(experiment), (VALUES ('pf'), ('op'), ('both')) m(case_mode))"""


@query("run_matrix", f"WITH {_PLAN_SQL} SELECT * FROM plan")
def run_matrix(spark, sf):
    return run_plan(spark, sf)


def eval_key_case_mode():
    """The record's case mode, else pf/both from the opposition flag."""
    return F.coalesce(F.nullif(F.col("case_mode"), F.lit("")),
                      F.when(F.col("opposition"), F.lit("both")).otherwise(F.lit("pf")))


@query("resume_anti_join", lambda: f"""
WITH {_PLAN_SQL},
ex AS (SELECT event_type AS algo, CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END AS experiment,
         coalesce(nullif(CASE WHEN value < 20 THEN '' WHEN value < 40 THEN NULL WHEN value < 60 THEN 'op' ELSE 'both' END, ''),
                  CASE WHEN user_id > 50 THEN 'both' ELSE 'pf' END) AS case_mode
       FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00')
SELECT * FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM ex WHERE ex.algo IS NOT DISTINCT FROM p.algo AND ex.experiment IS NOT DISTINCT FROM p.experiment
    AND ex.case_mode IS NOT DISTINCT FROM p.case_mode)
""")
def resume_anti_join(spark, sf):
    """Pending runs = plan minus finished runs, by a null-safe anti join on
    the evaluation key (J3). Runs logged before the cut-off exist."""
    plan = run_plan(spark, sf)
    ex = t(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"))
    ex = existing_results(ex).select("algo", "experiment", eval_key_case_mode().alias("case_mode"))
    cond = ((plan.algo.eqNullSafe(ex.algo)) & (plan.experiment.eqNullSafe(ex.experiment))
            & (plan.case_mode.eqNullSafe(ex.case_mode)))
    return plan.join(ex, cond, "left_anti")


def existing_results(e: DataFrame) -> DataFrame:
    """Finished runs as result records: key fields, with the case mode
    missing on some records (fallback from the opposition flag, P29)."""
    case_mode = F.when(F.col("value") < 20, F.lit("")).when(F.col("value") < 40, F.lit(None)).when(
        F.col("value") < 60, "op").otherwise("both")
    return e.select(F.col("event_type").alias("algo"),
                    F.when(F.col("user_id") % 2 == 0, "1").otherwise("2").alias("experiment"),
                    case_mode.alias("case_mode"), (F.col("user_id") > 50).alias("opposition"))


@query("union_categories", """
WITH pr AS (SELECT o_orderkey, 'Patent Refusal' AS category, o_orderstatus FROM orders WHERE o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW')),
od AS (SELECT o_orderkey, 'Opposition Division' AS category, o_orderstatus,
              CAST(1 + (o_custkey % 4) AS VARCHAR) AS matches FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))
SELECT o_orderkey, category, o_orderstatus, NULL::VARCHAR AS matches FROM pr
UNION ALL SELECT o_orderkey, category, o_orderstatus, matches FROM od
""")
def union_categories(spark, sf):
    """Two case subsets with different columns stacked by name."""
    o = t(spark, sf, "orders")
    pr = o.filter(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW")).select(
        "o_orderkey", F.lit("Patent Refusal").alias("category"), "o_orderstatus")
    od = o.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).select(
        "o_orderkey", F.lit("Opposition Division").alias("category"), "o_orderstatus",
        (F.lit(1) + F.col("o_custkey") % 4).cast("string").alias("matches"))
    return pr.unionByName(od, allowMissingColumns=True)


@query("mode_intersect", """
SELECT DISTINCT event_type AS mode FROM events WHERE value > 50
INTERSECT
SELECT DISTINCT event_type AS mode FROM events WHERE value < 5 AND event_type <> 'error'
""")
def mode_intersect(spark, sf):
    """Requested modes intersected with the modes that have runs."""
    e = t(spark, sf, "events")
    a = e.filter(F.col("value") > 50).select(F.col("event_type").alias("mode"))
    b = e.filter((F.col("value") < 5) & (F.col("event_type") != "error")).select(F.col("event_type").alias("mode"))
    return a.intersect(b)
