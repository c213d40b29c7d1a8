"""Window-shaped operators: dedup, latest/best record, balanced samples,
splits and folds (SURVEY 2.6). Cases are ``orders`` with status F/O as the
known outcomes Affirmed/Reversed and ``year(o_orderdate)`` as the year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling as S
from ..operators.clean import dedup_keep_last
from ..operators.reports import best_per_group
from .catalog import query, t

H = "md5('42:' || CAST({k} AS VARCHAR))"
HK = H.format(k="o_orderkey")
TEST_YEARS = [1998, 1999, 2000, 2001]


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Known-outcome cases: key, year, date, outcome, 0/1 label."""
    o = t(spark, sf, "orders").filter(F.col("o_orderstatus").isin("F", "O"))
    return o.select("o_orderkey", F.year("o_orderdate").alias("year"), "o_orderdate",
                    F.when(F.col("o_orderstatus") == "F", "Affirmed").otherwise("Reversed").alias("outcome"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))


CASES_SQL = """cases AS (
  SELECT o_orderkey, year(o_orderdate) AS year, o_orderdate,
         CASE WHEN o_orderstatus = 'F' THEN 'Affirmed' ELSE 'Reversed' END AS outcome,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
  FROM orders WHERE o_orderstatus IN ('F', 'O'))"""


@query("dedup_keep_last", """
WITH j AS (SELECT d.doc_id, l.quality, md5(d.text) AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM j),
f AS (SELECT * FROM c WHERE NOT (n > 1 AND quality IS NULL) AND length(k) >= 20)
SELECT doc_id, k AS text_key, quality
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) AS rn FROM f) WHERE rn = 1
""")
def dedup_keep_last_q(spark, sf):
    # hash the text map-side: the label join and the dedup move no text
    d = t(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_key"))
    j = d.join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return dedup_keep_last(j.select("doc_id", "quality", "text_key"), key="text_key", title="quality", seq="doc_id")


@query("latest_best_record", """
SELECT user_id, event_type, event_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id) AS rn
  FROM events) WHERE rn = 1
""")
def latest_best_record(spark, sf):
    """Latest record per key; a timestamp tie goes to the higher score."""
    e = t(spark, sf, "events").select("user_id", "event_type", "event_id", "ts", "value")
    order = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("value"), F.col("event_id")]
    return best_per_group(e, ["user_id", "event_type"], order)


@query("balanced_sample", lambda: f"""
WITH {CASES_SQL},
c AS (SELECT year, outcome, count(*) AS n FROM cases GROUP BY year, outcome),
q AS (SELECT year, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS quota FROM c GROUP BY year),
r AS (SELECT cases.*, row_number() OVER (PARTITION BY year, outcome ORDER BY {HK}, o_orderkey) AS rn FROM cases)
SELECT r.o_orderkey, r.year, r.outcome FROM r JOIN q ON r.year = q.year WHERE rn <= quota
""")
def balanced_sample(spark, sf):
    c = cases(spark, sf)
    b = S.balanced_sample(c, by="year", label="outcome", key="o_orderkey", classes=["Affirmed", "Reversed"])
    return b.select("o_orderkey", "year", "outcome")


_DOWNSAMPLE_SQL = f"""
c AS (SELECT count(*) FILTER (WHERE outcome = 'Affirmed') AS p, count(*) FILTER (WHERE outcome = 'Reversed') AS q FROM {{src}}),
d AS (SELECT CASE WHEN p > q THEN 'Affirmed' ELSE 'Reversed' END AS maj, abs(p - q) AS n_drop FROM c),
r AS (SELECT s.*, row_number() OVER (PARTITION BY outcome ORDER BY {HK}, o_orderkey) AS rn FROM {{src}} s),
flag AS (SELECT r.*, NOT (r.outcome = d.maj AND r.rn <= d.n_drop) AS kept FROM r, d)"""


@query("downsample_majority", lambda: f"""
WITH {CASES_SQL}, {_DOWNSAMPLE_SQL.format(src='cases').strip()}
SELECT o_orderkey, outcome, kept FROM flag
""")
def downsample_majority(spark, sf):
    c = cases(spark, sf)
    f = S.downsample_flag(c, "outcome", "o_orderkey", "Affirmed", "Reversed")
    return f.select("o_orderkey", "outcome", "kept")


@query("validation_sample", lambda: f"""
WITH {CASES_SQL}
SELECT o_orderkey, outcome FROM (
  SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {HK}, o_orderkey) AS rn FROM cases) WHERE rn <= 10
""")
def validation_sample(spark, sf):
    return S.validation_sample(cases(spark, sf), "outcome", "o_orderkey", 20).select("o_orderkey", "outcome")


def random_split(c: DataFrame) -> DataFrame:
    """Experiment 1: down-sample the majority, stratified 80/20 of the
    balanced pool, the dropped majority rows join the test side."""
    return S.balanced_split(c, "label", "o_orderkey", 1, 0, 0.2)


@query("split_random", lambda: f"""
WITH {CASES_SQL}, {_DOWNSAMPLE_SQL.format(src='cases').strip()},
b AS (SELECT * EXCLUDE (rn, kept) FROM flag WHERE kept),
q AS (SELECT label, count(*) AS n FROM b GROUP BY label),
w AS (SELECT label, ceil(CAST(0.2 AS DOUBLE) * (SELECT sum(n) FROM q) - 1e-9) AS w,
             ceil(CAST(0.2 AS DOUBLE) * (SELECT sum(n) FROM q) - 1e-9) * n / (SELECT sum(n) FROM q) AS x FROM q),
quota AS (SELECT label, floor(x + 1e-9) + CASE WHEN row_number() OVER (ORDER BY round(x - floor(x + 1e-9), 9) DESC, label)
                 <= w - (SELECT sum(floor(x + 1e-9)) FROM w) THEN 1 ELSE 0 END AS t FROM w),
r2 AS (SELECT b.*, row_number() OVER (PARTITION BY label ORDER BY {HK}, o_orderkey) AS rn2,
              count(*) OVER (PARTITION BY label) AS n FROM b)
SELECT o_orderkey, label, CASE WHEN rn2 <= (SELECT t FROM quota WHERE quota.label = r2.label) THEN 'test' ELSE 'train' END AS split FROM r2
UNION ALL
SELECT o_orderkey, label, 'test' AS split FROM flag WHERE NOT kept
""")
def split_random(spark, sf):
    return random_split(cases(spark, sf)).select("o_orderkey", "label", "split")


@query("split_temporal", lambda: f"""
WITH {CASES_SQL}, tr AS (SELECT * FROM cases WHERE year < 1999),
{_DOWNSAMPLE_SQL.format(src='tr').strip()}
SELECT o_orderkey, label, 'train' AS split FROM flag WHERE kept
UNION ALL
SELECT o_orderkey, label, 'test' AS split FROM cases WHERE year >= 1999
""")
def split_temporal(spark, sf):
    """Experiment 2: test = year >= cut; only the train part is balanced."""
    c = cases(spark, sf)
    tr = S.downsample_flag(c.filter(F.col("year") < 1999), "outcome", "o_orderkey", "Affirmed", "Reversed")
    train = tr.filter("kept").select("o_orderkey", "label", F.lit("train").alias("split"))
    test = c.filter(F.col("year") >= 1999).select("o_orderkey", "label", F.lit("test").alias("split"))
    return train.unionByName(test)


@query("split_tail", """
SELECT o_orderkey, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE) + 1e-9) THEN 'train' ELSE 'val' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rn,
             count(*) OVER () AS n FROM orders)
""")
def split_tail(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return S.split_tail(o, "o_orderdate", "o_orderkey", 0.8).select("o_orderkey", "split")


@query("window_validation", lambda: f"""
WITH {CASES_SQL},
w AS (SELECT * FROM (VALUES {', '.join(f'({y})' for y in TEST_YEARS)}) v(test_year)),
m AS (SELECT c.*, w.test_year, CASE WHEN c.year = w.test_year THEN 'test' ELSE 'train' END AS role
      FROM cases c JOIN w ON c.year <= w.test_year - 1 OR c.year = w.test_year),
v AS (SELECT test_year, count(*) FILTER (WHERE role = 'train' AND year = test_year - 1) AS nv,
             count(*) FILTER (WHERE role = 'train') AS nt FROM m GROUP BY test_year),
t2 AS (SELECT m.*, v.nv, v.nt,
         row_number() OVER (PARTITION BY m.test_year ORDER BY o_orderdate NULLS LAST, o_orderkey) AS rn
       FROM m JOIN v ON m.test_year = v.test_year WHERE role = 'train')
SELECT o_orderkey, test_year,
  CASE WHEN nv > 0 THEN CASE WHEN year = test_year - 1 THEN 'val' ELSE 'train' END
       ELSE CASE WHEN rn <= floor(nt * CAST(0.8 AS DOUBLE) + 1e-9) THEN 'train' ELSE 'val' END END AS role
FROM t2
UNION ALL SELECT o_orderkey, test_year, role FROM m WHERE role = 'test'
""")
def window_validation(spark, sf):
    m = S.window_membership(cases(spark, sf), "year", TEST_YEARS)
    v = S.window_validation(m, "year", "o_orderdate", "o_orderkey")
    return v.select("o_orderkey", "test_year", "role")


@query("stratified_folds", lambda: f"""
WITH {CASES_SQL}
SELECT o_orderkey, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {HK}, o_orderkey) - 1) % 3 AS INTEGER) AS fold
FROM cases
""")
def stratified_folds(spark, sf):
    return S.stratified_folds(cases(spark, sf), "label", "o_orderkey", 3).select("o_orderkey", "label", "fold")


@query("timeseries_folds", lambda: f"""
WITH {CASES_SQL},
p AS (SELECT o_orderkey, row_number() OVER (ORDER BY year, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM cases),
f AS (SELECT * FROM (VALUES (0), (1), (2)) v(fold))
SELECT o_orderkey, CAST(fold AS INTEGER) AS fold,
       CASE WHEN pos < n - (3 - fold) * (n // 4) THEN 'train' ELSE 'test' END AS role
FROM p JOIN f ON p.pos < n - (3 - fold) * (n // 4) + (n // 4)
""")
def timeseries_folds(spark, sf):
    c = cases(spark, sf).select("o_orderkey", "year")
    f = S.timeseries_folds(c, [F.col("year").asc(), F.col("o_orderkey").asc()], 3)
    return f.select("o_orderkey", F.col("fold").cast("int").alias("fold"), "role")


@query("best_per_group", """
SELECT event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1
""")
def best_per_group_q(spark, sf):
    e = t(spark, sf, "events").select("event_type", "event_id", "value")
    return best_per_group(e, ["event_type"], [-F.col("value"), F.col("event_id")])


@query("sliding_windows", lambda: f"""
WITH {CASES_SQL},
w AS (SELECT * FROM (VALUES {', '.join(f'({y})' for y in TEST_YEARS)}) v(test_year)),
m AS (SELECT c.*, w.test_year, CASE WHEN c.year = w.test_year THEN 'test' ELSE 'train' END AS role
      FROM cases c JOIN w ON c.year <= w.test_year - 1 OR c.year = w.test_year),
has AS (SELECT DISTINCT test_year FROM m WHERE role = 'test'),
m2 AS (SELECT * FROM m WHERE test_year IN (SELECT test_year FROM has)),
q AS (SELECT test_year, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n
      FROM m2 WHERE role = 'train' GROUP BY test_year),
r AS (SELECT m2.*, row_number() OVER (PARTITION BY m2.test_year, label ORDER BY {HK}, o_orderkey) AS rn
      FROM m2 WHERE role = 'train')
SELECT r.test_year, o_orderkey, role, label FROM r JOIN q ON r.test_year = q.test_year
WHERE p = 0 OR n = 0 OR rn <= least(p, n)
UNION ALL SELECT test_year, o_orderkey, role, label FROM m2 WHERE role = 'test'
""")
def sliding_windows(spark, sf):
    """Window membership (theta condition as a per-row explode), windows
    without test rows skipped (semi join), per-window class balance."""
    m = S.window_membership(cases(spark, sf), "year", TEST_YEARS)
    m = S.windows_with_test(m)
    b = S.balance_windows(m, "label", "o_orderkey")
    return b.select("test_year", "o_orderkey", "role", "label")
