"""End-to-end flows of the reference, composed from the operators:

* :func:`label_cases` (E1): raw 17-column decision table -> cleaned,
  de-duplicated, article-mapped, rule-classified cases (one lazy plan; the
  only shuffle is the ECLI dedup).
* :func:`experiment_split` (E2): cases -> ONE split table
  ``case_id, experiment, case_mode, split, text, <one-hot aux>, label``
  (no positional X/y pairing).

Both take and return DataFrames; nothing passes through the driver except
the small one-hot category domain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rulepacks as RP
from ..functions.rules import classify, classify_combined
from ..functions.text import chop_preamble, strip_markup
from ..operators import clean as C
from ..operators import sampling as S

LIST_COLUMNS = ["reference", "procedure_lang", "court_type", "appeal_number", "document_lang", "summary_facts",
                "decision_reasons", "order_text", "date", "ecli", "title", "board_code", "classification", "keywords",
                "app_no"]
RAW_SCHEMA = T.StructType(
    [T.StructField("case_id", T.LongType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in LIST_COLUMNS]
    + [T.StructField("legal_provisions", T.ArrayType(T.StringType())),
       T.StructField("cited", T.ArrayType(T.StringType()))]
)
KNOWN = ["Affirmed", "Reversed"]
CUT_YEAR = 2020


def clean_decisions(raw: DataFrame) -> DataFrame:
    """P1-P7 + W1: join list columns, repair and parse dates, blanks to
    null, year, cohort filter, ECLI dedup keeping the last record."""
    joined = raw.select("case_id", *[F.array_join(c, " ").alias(c) for c in LIST_COLUMNS],
                        "legal_provisions", "cited")
    d = joined.withColumn("date", C.parse_date(C.repair_date("date", "ecli")))
    d = C.blanks_to_null(d).withColumn("year", F.year("date"))
    d = C.cohort_filter(d, date="date")
    return C.dedup_keep_last(d, key="ecli", title="title", seq="case_id")


def label_cases(raw: DataFrame) -> DataFrame:
    """Every step is a column expression over the cleaned rows; the
    appellant type is computed on Opposition Division rows only and the
    outcome on the two known case types only."""
    c = clean_decisions(raw)
    c = c.withColumn("matched_articles", C.map_codes(C.normalise_provisions("legal_provisions")))
    c = c.withColumn("case_type", classify(RP.CASE_TYPE, F.col("summary_facts"), RP.CASE_TYPE_ORDER))
    c = c.withColumn("new_summary_facts", chop_preamble("summary_facts"))
    od = F.col("case_type") == "Opposition Division"
    c = c.withColumn("appellant_type", F.when(od, classify_combined(
        RP.APPELLANT_TYPE, F.col("summary_facts"), "3", ("2", "1"), RP.APPELLANT_ORDER)))
    known_type = F.col("case_type").isin("Patent Refusal", "Opposition Division")
    c = c.withColumn("outcome", F.when(known_type, classify(RP.OUTCOME, F.col("order_text"), RP.OUTCOME_ORDER)))
    return c.withColumn("category", F.when(known_type, F.col("case_type")))


def _one_hot(df: DataFrame, domain_from: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Dummies over the category domain of ``domain_from`` (a bounded,
    tiny collect of distinct values); unseen values give all zeros."""
    names = []
    for c in cols:
        dom = sorted(r[0] for r in domain_from.select(c).distinct().collect() if r[0] is not None)
        for v in dom:
            n = f"{c}_{v}"
            df = df.withColumn(n, (F.col(c) == F.lit(v)).cast("int"))
            names.append(n)
    return df, names


def experiment_split(cases: DataFrame, case_mode: str, experiment: str, cut_year: int = CUT_YEAR,
                     test_frac: float = 0.2) -> DataFrame:
    """E2 for one (case mode, experiment): pf = Patent Refusal, op =
    Opposition Division with appellant 1/2/3, both = the union with
    ``category`` and ``od_match``. Experiment 1: balanced pool, stratified
    80/20, dropped majority rows into test. Experiment 2: test = year >=
    cut, only the earlier years balanced."""
    k = cases.filter(F.col("outcome").isin(*KNOWN))
    pr = k.filter(F.col("case_type") == "Patent Refusal")
    od = k.filter((F.col("case_type") == "Opposition Division") & F.col("appellant_type").isin("1", "2", "3"))
    if case_mode == "pf":
        data, aux = pr, []
    elif case_mode == "op":
        data, aux = od.withColumn("matches", F.col("appellant_type")), ["matches"]
    elif case_mode == "both":
        data = pr.unionByName(od).withColumn("od_match", F.when(F.col("case_type") == "Opposition Division",
                                                                F.col("appellant_type")).otherwise(F.lit("0")))
        aux = ["category", "od_match"]
    else:
        raise ValueError(case_mode)
    data = data.withColumn("label", (F.col("outcome") == "Affirmed").cast("int"))
    if experiment == "1":
        s = S.balanced_split(data, "label", "case_id", 1, 0, test_frac)
        domain = S.downsample_flag(data, "label", "case_id", 1, 0).filter("kept")
    elif experiment == "2":
        early = S.downsample_flag(data.filter(F.col("year") < cut_year), "label", "case_id", 1, 0)
        train = early.filter("kept").drop("kept").withColumn("split", F.lit("train"))
        s = train.unionByName(data.filter(F.col("year") >= cut_year).withColumn("split", F.lit("test")))
        domain = train
    else:
        raise ValueError(experiment)
    s, dummies = _one_hot(s, domain, aux)
    return s.select("case_id", F.lit(experiment).alias("experiment"), F.lit(case_mode).alias("case_mode"), "split",
                    strip_markup("new_summary_facts").alias("text"), *dummies, "label")
