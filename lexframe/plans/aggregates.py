"""Aggregations, pivots, metrics and top-k reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import metrics as M
from ..operators import reports as R
from ..operators.features import term_frequencies
from ..operators.sampling import hash_order
from .catalog import dealt, docs, query, t
from .scalars import articles_frame, _PROV_SQL
from .sqlbits import clean_tokens_sql
from .windows import cases, random_split

OUTCOMES = ["Affirmed", "Reversed", "Unknown"]
FEATURES = ["TF-IDF", "N-Grams", "Word2Vec"]
ALGO_ORDER = ["click", "view", "purchase", "signup", "error"]


def order_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("year"),
                    F.when(F.col("o_orderstatus") == "F", "Affirmed").when(F.col("o_orderstatus") == "O", "Reversed")
                    .otherwise("Unknown").alias("outcome"))


OUT_SQL = """oo AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, year(o_orderdate) AS year,
  CASE o_orderstatus WHEN 'F' THEN 'Affirmed' WHEN 'O' THEN 'Reversed' ELSE 'Unknown' END AS outcome FROM orders)"""


@query("value_counts", """
SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1
""")
def value_counts(spark, sf):
    return R.value_counts(t(spark, sf, "orders"), "o_orderpriority")


@query("outcome_counts", lambda: f"""
WITH {OUT_SQL}
SELECT year, count(*) AS total, count(*) FILTER (WHERE outcome = 'Affirmed') AS n_affirmed,
  count(*) FILTER (WHERE outcome = 'Reversed') AS n_reversed, count(*) FILTER (WHERE outcome = 'Unknown') AS n_unknown
FROM oo GROUP BY year
""")
def outcome_counts(spark, sf):
    return R.conditional_counts(order_outcomes(spark, sf), "outcome", OUTCOMES, ["year"])


@query("count_by_year", """
SELECT year(l_shipdate) AS year, count(*) AS n_rows, count(l_discount) AS n_discount, count(l_returnflag) AS n_flag,
  count(DISTINCT l_orderkey) AS n_orders
FROM lineitem GROUP BY 1
""")
def count_by_year(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.groupBy(F.year("l_shipdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("l_discount").alias("n_discount"),
        F.count("l_returnflag").alias("n_flag"), F.count_distinct("l_orderkey").alias("n_orders"))


@query("explode_counts", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT item, count(*) AS n FROM (SELECT unnest(articles) AS item FROM art) GROUP BY item
""")
def explode_counts(spark, sf):
    return R.explode_counts(articles_frame(spark, sf), "articles")


@query("combination_counts", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT array_to_string(list_sort(articles), ' + ') AS combination, count(*) AS n FROM art GROUP BY 1
""")
def combination_counts(spark, sf):
    return R.combination_counts(articles_frame(spark, sf), "articles")


_CT_SQL = f"""WITH {OUT_SQL},
ct AS (SELECT year, count(*) FILTER (WHERE outcome = 'Affirmed') AS "Affirmed",
  count(*) FILTER (WHERE outcome = 'Reversed') AS "Reversed", count(*) FILTER (WHERE outcome = 'Unknown') AS "Unknown"
  FROM oo WHERE year BETWEEN 1995 AND 2000 GROUP BY year)"""


def _year_crosstab(spark, sf):
    o = order_outcomes(spark, sf).filter(F.col("year").between(1995, 2000))
    return R.crosstab(o, "year", "outcome", OUTCOMES)


@query("crosstab_outcome_year", _CT_SQL + ' SELECT * FROM ct')
def crosstab_outcome_year(spark, sf):
    return _year_crosstab(spark, sf)


@query("crosstab_percent", _CT_SQL + """
SELECT year, round("Affirmed" * 100.0 / ("Affirmed" + "Reversed" + "Unknown"), 4) AS "pct_Affirmed",
  round("Reversed" * 100.0 / ("Affirmed" + "Reversed" + "Unknown"), 4) AS "pct_Reversed",
  round("Unknown" * 100.0 / ("Affirmed" + "Reversed" + "Unknown"), 4) AS "pct_Unknown",
  "Affirmed" + "Reversed" + "Unknown" AS total FROM ct
""")
def crosstab_percent(spark, sf):
    return R.row_percent(_year_crosstab(spark, sf), "year", OUTCOMES)


@query("pivot_category_outcome", lambda: f"""
WITH {OUT_SQL},
c AS (SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Opposition Division' ELSE 'Patent Refusal' END AS category,
             outcome FROM oo),
ct AS (SELECT category, count(*) FILTER (WHERE outcome = 'Affirmed') AS a, count(*) FILTER (WHERE outcome = 'Reversed') AS r,
       count(*) FILTER (WHERE outcome = 'Unknown') AS u FROM c GROUP BY category)
SELECT category, round(a * 100.0 / (a + r + u), 4) AS "pct_Affirmed", round(r * 100.0 / (a + r + u), 4) AS "pct_Reversed",
       round(u * 100.0 / (a + r + u), 4) AS "pct_Unknown", a + r + u AS total FROM ct
""")
def pivot_category_outcome(spark, sf):
    o = order_outcomes(spark, sf).withColumn("category", F.when(
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Opposition Division").otherwise("Patent Refusal"))
    return R.row_percent(R.crosstab(o, "category", "outcome", OUTCOMES), "category", OUTCOMES)


@query("pivot_exploded_outcome", lambda: f"""
WITH {_PROV_SQL.strip()}, {OUT_SQL},
x AS (SELECT unnest(art.articles) AS article, oo.outcome FROM art JOIN oo ON art.o_orderkey = oo.o_orderkey),
ct AS (SELECT article, count(*) FILTER (WHERE outcome = 'Affirmed') AS a, count(*) FILTER (WHERE outcome = 'Reversed') AS r,
       count(*) FILTER (WHERE outcome = 'Unknown') AS u FROM x GROUP BY article)
SELECT article, round(a * 100.0 / (a + r + u), 4) AS "pct_Affirmed", round(r * 100.0 / (a + r + u), 4) AS "pct_Reversed",
       round(u * 100.0 / (a + r + u), 4) AS "pct_Unknown", a + r + u AS total FROM ct
""")
def pivot_exploded_outcome(spark, sf):
    a = articles_frame(spark, sf).select("o_orderkey", F.explode("articles").alias("article"))
    x = a.join(order_outcomes(spark, sf).select("o_orderkey", "outcome"), "o_orderkey")
    return R.row_percent(R.crosstab(x, "article", "outcome", OUTCOMES), "article", OUTCOMES)


@query("mode_value", lambda: f"""
WITH {OUT_SQL},
c AS (SELECT year, o_orderpriority, count(*) AS n FROM oo GROUP BY 1, 2)
SELECT year, o_orderpriority AS mode, n FROM (
  SELECT *, row_number() OVER (PARTITION BY year ORDER BY n DESC, o_orderpriority) AS rn FROM c) WHERE rn = 1
""")
def mode_value(spark, sf):
    return R.mode_value(order_outcomes(spark, sf), "o_orderpriority", ["year"])


# -- A13-A16: predictions vs truth --------------------------------------------------
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Truth = labels.quality; matcher predictions: a length rule and a
    source rule; score = n_chars."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", "lang", F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"),
                    (F.col("n_chars") > 1000).cast("int").alias("pred_len"),
                    (F.col("source") < "src5").cast("int").alias("pred_src"))


PRED_SQL = """p AS (SELECT d.doc_id, d.lang, l.quality AS label, CAST(d.n_chars AS DOUBLE) AS score,
  CAST(d.n_chars > 1000 AS INTEGER) AS pred_len, CAST(d.source < 'src5' AS INTEGER) AS pred_src
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


@query("confusion_matrix", lambda: f"""
WITH {PRED_SQL},
x AS (SELECT CASE WHEN label = 1 THEN 'good' ELSE 'bad' END AS real, CASE WHEN pred_len = 1 THEN 'good' ELSE 'bad' END AS pred FROM p)
SELECT real, count(*) FILTER (WHERE pred = 'bad') AS bad, count(*) FILTER (WHERE pred = 'good') AS good FROM x GROUP BY real
""")
def confusion_matrix(spark, sf):
    p = predictions(spark, sf).select(F.when(F.col("label") == 1, "good").otherwise("bad").alias("real"),
                                      F.when(F.col("pred_len") == 1, "good").otherwise("bad").alias("pred"))
    return M.confusion_matrix(p, "real", "pred", ["good", "bad"])


@query("validation_summary", lambda: f"""
WITH {PRED_SQL},
x AS (SELECT 'length' AS matcher, label, pred_len AS pred FROM p UNION ALL SELECT 'source', label, pred_src FROM p)
SELECT matcher, count(*) AS n, count(*) FILTER (WHERE label = pred) AS correct,
       round(count(*) FILTER (WHERE label = pred) * 100.0 / count(*), 4) AS percent FROM x GROUP BY matcher
""")
def validation_summary(spark, sf):
    p = predictions(spark, sf)
    x = p.select(F.lit("length").alias("matcher"), "label", F.col("pred_len").alias("pred")).unionByName(
        p.select(F.lit("source").alias("matcher"), "label", F.col("pred_src").alias("pred")))
    return M.accuracy_summary(x, "label", "pred", ["matcher"])


@query("binary_metrics", lambda: f"""
WITH {PRED_SQL},
c AS (SELECT lang, count(*) FILTER (WHERE label = 1 AND pred_len = 1)::DOUBLE AS tp,
        count(*) FILTER (WHERE label = 0 AND pred_len = 1)::DOUBLE AS fp,
        count(*) FILTER (WHERE label = 1 AND pred_len = 0)::DOUBLE AS fn,
        count(*) FILTER (WHERE label = 0 AND pred_len = 0)::DOUBLE AS tn FROM p GROUP BY lang)
SELECT lang,
  round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc,
  tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn
FROM c
""")
def binary_metrics(spark, sf):
    m = M.binary_metrics(predictions(spark, sf), "label", "pred_len", ["lang"])
    return m.select("lang", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "mcc")],
                    "tp", "fp", "fn", "tn")


@query("roc_auc", lambda: f"""
WITH {PRED_SQL},
r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY score) AS lo,
             count(*) OVER (PARTITION BY lang, score) AS ties FROM p),
s AS (SELECT lang, sum(CASE WHEN label = 1 THEN lo + (ties - 1) / 2.0 END) AS rs,
             count(*) FILTER (WHERE label = 1) AS np, count(*) FILTER (WHERE label = 0) AS nn FROM r GROUP BY lang)
SELECT lang, CASE WHEN np > 0 AND nn > 0 THEN CAST(round((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS DOUBLE) END AS auc FROM s
""")
def roc_auc(spark, sf):
    a = M.roc_auc(predictions(spark, sf), "label", "score", ["lang"])
    return a.select("lang", F.round("auc", 6).alias("auc"))


# -- A17-A20: result tables ------------------------------------------------------------
def result_records(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation records (one per logged run): case mode, experiment,
    algorithm, input representation, f1, mcc, timestamp."""
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", "ts",
        F.when(F.col("user_id") % 3 == 0, "pf").when(F.col("user_id") % 3 == 1, "op").otherwise("both").alias("case_mode"),
        F.when(F.hour("ts") < 12, "1").otherwise("2").alias("experiment"),
        F.col("event_type").alias("algo"),
        F.when(k < 34, "TF-IDF").when(k < 67, "N-Grams").otherwise("Word2Vec").alias("feature"),
        (F.col("value") / 500.0).alias("f1"), ((F.col("value") - 250.0) / 250.0).alias("mcc"))


REC_SQL = """rec AS (SELECT event_id, ts,
  CASE user_id % 3 WHEN 0 THEN 'pf' WHEN 1 THEN 'op' ELSE 'both' END AS case_mode,
  CASE WHEN hour(ts) < 12 THEN '1' ELSE '2' END AS experiment, event_type AS algo,
  CASE WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 34 THEN 'TF-IDF'
       WHEN CAST(json_extract(props, '$.k') AS INTEGER) < 67 THEN 'N-Grams' ELSE 'Word2Vec' END AS feature,
  value / 500.0 AS f1, (value - 250.0) / 250.0 AS mcc FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_mode, experiment, algo, feature
           ORDER BY ts DESC, f1 DESC, event_id) AS rn FROM rec) WHERE rn = 1)"""


def latest_records(spark, sf) -> DataFrame:
    r = result_records(spark, sf)
    return R.best_per_group(r, ["case_mode", "experiment", "algo", "feature"],
                            [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("f1"), F.col("event_id")])


@query("pivot_results", lambda: f"""
WITH {REC_SQL}
SELECT case_mode, experiment, algo,
  {', '.join(f'''round(max(f1) FILTER (WHERE feature = '{f}'), 4) AS "{f} | F1", round(max(mcc) FILTER (WHERE feature = '{f}'), 4) AS "{f} | MCC"''' for f in FEATURES)}
FROM latest GROUP BY case_mode, experiment, algo
""")
def pivot_results(spark, sf):
    """Algorithm x feature, several metrics flattened "Feature | Metric",
    per case mode and experiment; values rounded to 4 places (P30)."""
    lr = latest_records(spark, sf)
    p = lr.groupBy("case_mode", "experiment", "algo").pivot("feature", FEATURES).agg(
        F.max("f1").alias("f1"), F.max("mcc").alias("mcc"))
    return p.select("case_mode", "experiment", "algo", *[
        F.round(F.col(f"{f}_{m}"), 4).alias(f"{f} | {m.upper()}") for f in FEATURES for m in ("f1", "mcc")])


@query("pivot_heatmap", lambda: f"""
WITH {REC_SQL}
SELECT algo, CASE algo {' '.join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ALGO_ORDER))} END AS row_order,
  {', '.join(f'''round(max(f1) FILTER (WHERE feature = '{f}'), 4) AS "{f}"''' for f in FEATURES)}
FROM rec GROUP BY algo
""")
def pivot_heatmap(spark, sf):
    r = result_records(spark, sf)
    p = r.groupBy("algo").pivot("feature", FEATURES).agg(F.max("f1"))
    pos = F.array_position(F.array(*[F.lit(a) for a in ALGO_ORDER]), F.col("algo")) - 1
    return p.select("algo", pos.cast("int").alias("row_order"), *[F.round(f, 4).alias(f) for f in FEATURES])


@query("best_feature", lambda: f"""
WITH {REC_SQL},
m AS (SELECT case_mode, feature, avg(f1) AS mean_f1 FROM rec GROUP BY 1, 2)
SELECT case_mode, feature AS best_feature, round(mean_f1, 6) AS mean_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY case_mode ORDER BY mean_f1 DESC, feature) AS rn FROM m) WHERE rn = 1
""")
def best_feature(spark, sf):
    m = result_records(spark, sf).groupBy("case_mode", "feature").agg(F.avg("f1").alias("mean_f1"))
    b = R.best_per_group(m, ["case_mode"], [-F.col("mean_f1"), F.col("feature")])
    return b.select("case_mode", F.col("feature").alias("best_feature"), F.round("mean_f1", 6).alias("mean_f1"))


@query("split_distribution", """
WITH cases AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Affirmed' ELSE 'Reversed' END AS outcome,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders WHERE o_orderstatus IN ('F', 'O')),
c AS (SELECT count(*) FILTER (WHERE outcome = 'Affirmed') AS p, count(*) FILTER (WHERE outcome = 'Reversed') AS q FROM cases),
d AS (SELECT CASE WHEN p > q THEN 'Affirmed' ELSE 'Reversed' END AS maj, abs(p - q) AS n_drop FROM c),
r AS (SELECT s.*, row_number() OVER (PARTITION BY outcome ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM cases s),
flag AS (SELECT r.*, NOT (r.outcome = d.maj AND r.rn <= d.n_drop) AS kept FROM r, d),
b AS (SELECT * FROM flag WHERE kept),
q AS (SELECT label, count(*) AS n FROM b GROUP BY label),
w AS (SELECT label, ceil(CAST(0.2 AS DOUBLE) * (SELECT sum(n) FROM q) - 1e-9) AS w,
             ceil(CAST(0.2 AS DOUBLE) * (SELECT sum(n) FROM q) - 1e-9) * n / (SELECT sum(n) FROM q) AS x FROM q),
quota AS (SELECT label, floor(x + 1e-9) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x + 1e-9), 9) DESC, label)
                 <= w - (SELECT sum(floor(x + 1e-9)) FROM w) THEN 1 ELSE 0 END AS t FROM w),
r2 AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn2,
       count(*) OVER (PARTITION BY label) AS n FROM b),
sp AS (SELECT label, CASE WHEN rn2 <= (SELECT t FROM quota WHERE quota.label = r2.label) THEN 'test' ELSE 'train' END AS split FROM r2
       UNION ALL SELECT label, 'test' FROM flag WHERE NOT kept)
SELECT split, label, count(*) AS n FROM sp GROUP BY ROLLUP (split, label)
""")
def split_distribution(spark, sf):
    """Label counts per split with subtotals (rollup)."""
    s = random_split(cases(spark, sf))
    return s.rollup("split", "label").agg(F.count(F.lit(1)).alias("n"))


# -- K2 / K3 ----------------------------------------------------------------------------
@query("top_terms", lambda: f"""
WITH x AS (SELECT DISTINCT doc_id, unnest({clean_tokens_sql('text', stopwords=True)}) AS term FROM documents)
SELECT term, count(*) AS df FROM x GROUP BY term ORDER BY df DESC, term LIMIT 20
""")
def top_terms(spark, sf):
    """Top-20 terms by document frequency (the limit is the feature)."""
    d = dealt(spark, sf).select("doc_id", TX.clean_tokens(F.col("text"), stopwords=True).alias("tok"))
    v = term_frequencies(d, "doc_id", "tok").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return R.top_k(v, [F.col("df").desc(), F.col("term").asc()], 20)


@query("error_examples", lambda: f"""
WITH {PRED_SQL},
b AS (SELECT doc_id, CASE WHEN label <> pred_len THEN 'misclassified' WHEN label = 1 THEN 'correct_affirmed' ELSE 'correct' END AS bucket
      FROM p)
SELECT bucket, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM b)
WHERE rn = 1
""")
def error_examples(spark, sf):
    """One seeded example per outcome bucket (K3), by min over a struct."""
    p = predictions(spark, sf)
    b = p.select("doc_id", F.when(F.col("label") != F.col("pred_len"), "misclassified")
                 .when(F.col("label") == 1, "correct_affirmed").otherwise("correct").alias("bucket"))
    return R.best_per_group(b, ["bucket"], [hash_order("doc_id"), F.col("doc_id")])


# -- P31 ----------------------------------------------------------------------------------
@query("flatten_results", lambda: f"""
WITH {REC_SQL}
SELECT event_id, case_mode, experiment, algo, feature, round(f1, 6) AS f1, round(mcc, 6) AS mcc,
  CASE WHEN f1 >= 0.1 THEN round(f1 * 0.9, 6) END AS auc,
  CAST(json_extract(params, '$.C') AS DOUBLE) AS param_c
FROM (SELECT *, '{{"C": ' || CAST(round(f1 * 10, 3) AS VARCHAR) || '}}' AS params FROM rec)
WHERE algo = 'click'
""")
def flatten_results(spark, sf):
    """Nested result records (metrics struct, params as a JSON string) to one
    flat row each, for one mode; a metric missing in a record stays null."""
    r = result_records(spark, sf)
    nested = r.select(
        "event_id", "case_mode", "experiment", "algo", "feature",
        F.struct(F.col("f1").alias("f1"), F.col("mcc").alias("mcc"),
                 F.when(F.col("f1") >= 0.1, F.col("f1") * 0.9).alias("auc")).alias("test_metrics"),
        F.to_json(F.struct(F.round(F.col("f1") * 10, 3).alias("C"))).alias("params"))
    flat = nested.filter(F.col("algo") == "click").select(
        "event_id", "case_mode", "experiment", "algo", "feature",
        F.round("test_metrics.f1", 6).alias("f1"), F.round("test_metrics.mcc", 6).alias("mcc"),
        F.round("test_metrics.auc", 6).alias("auc"),
        F.get_json_object("params", "$.C").cast("double").alias("param_c"))
    return flat
