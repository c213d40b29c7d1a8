"""Scalar/array/map/JSON queries. Record-shaped inputs
(provision lists, ECLIs, references, keyword lists) are derived from the
TPC-H-like tables by Spark, so the work grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import clean as C
from ..operators.features import binarise, one_hot
from .catalog import query, t

LI_ITEMS = r'<li><a href="[^"]*">([^<]*)</a></li>'


@query("list_to_string", lambda: f"""
SELECT page_id, array_to_string(regexp_extract_all(html, '{LI_ITEMS}', 1), ' ') AS nav_text
FROM pages
""")
def list_to_string(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", TX.list_to_string(F.regexp_extract_all("html", F.lit(LI_ITEMS), 1)).alias("nav_text"))


# -- P2/P3 ------------------------------------------------------------------------
def decision_dates(spark: SparkSession, sf: str) -> DataFrame:
    """An ECLI and a raw date string per order, in the formats of the corpus
    (some too short, to be repaired from the ECLI)."""
    o = t(spark, sf, "orders")
    d = F.col("o_orderdate")
    ecli = F.when(F.col("o_orderstatus") != "P", F.concat(
        F.lit("ECLI:EP:BA:"), F.year(d).cast("string"), F.lit(":T"),
        F.lpad(F.col("o_orderkey").cast("string"), 6, "0"), F.lit("."), F.date_format(d, "yyyyMMdd")))
    raw = (F.when(F.col("o_orderpriority") == "1-URGENT", F.date_format(d, "yyyyMMdd"))
           .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(d, "yyyy-MM-dd"))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.date_format(d, "dd.MM.yyyy"))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
           .otherwise(F.date_format(d, "yyyy")))
    return o.select("o_orderkey", ecli.alias("ecli"), raw.alias("raw_date"))


@query("date_repair", """
WITH x AS (
  SELECT o_orderkey,
    CASE WHEN o_orderstatus <> 'P' THEN 'ECLI:EP:BA:' || CAST(year(o_orderdate) AS VARCHAR) || ':T'
         || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '.' || strftime(o_orderdate, '%Y%m%d') END AS ecli,
    CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y%m%d')
         WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d')
         WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d.%m.%Y')
         WHEN '4-NOT SPECIFIED' THEN '' ELSE strftime(o_orderdate, '%Y') END AS raw_date
  FROM orders),
y AS (SELECT *, CASE WHEN length(raw_date) < 8 AND ecli IS NOT NULL THEN split_part(ecli, '.', 2) ELSE raw_date END AS fixed
      FROM x)
SELECT o_orderkey, fixed AS repaired,
  coalesce(try_strptime(trim(fixed), '%Y%m%d'), try_strptime(trim(fixed), '%Y-%m-%d'),
           try_strptime(trim(fixed), '%d.%m.%Y')) AS decision_date
FROM y
""")
def date_repair(spark, sf):
    d = decision_dates(spark, sf)
    fixed = C.repair_date("raw_date", "ecli")
    return d.select("o_orderkey", fixed.alias("repaired"), C.parse_date(fixed).alias("decision_date"))


@query("blank_to_null", """
SELECT page_id,
  CASE WHEN NOT regexp_full_match(x, '[ \\t\\n\\r\\f]*') THEN x END AS ad_text,
  CASE WHEN NOT regexp_full_match(y, '[ \\t\\n\\r\\f]*') THEN y END AS footer_text
FROM (SELECT page_id, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS x,
             regexp_extract(html, '<footer>([^<]*)', 1) AS y FROM pages)
""")
def blank_to_null(spark, sf):
    p = t(spark, sf, "pages").select(
        "page_id", F.regexp_extract("html", r'<div class="ad">([^<]*)</div>', 1).alias("ad_text"),
        F.regexp_extract("html", r"<footer>([^<]*)", 1).alias("footer_text"))
    return C.blanks_to_null(p)


@query("cohort_filter", """
SELECT o_orderkey, year(o_orderdate) AS year FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND year(o_orderdate) >= 1995
  AND year(o_orderdate) < 2000 AND o_totalprice IS NOT NULL
""")
def cohort_filter(spark, sf):
    o = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    c = C.cohort_filter(o, court="o_orderstatus", lang="o_orderpriority", year="year", order="o_totalprice",
                        court_value="F", lang_value="1-URGENT", first_year=1995, end_year=2000,
                        date="o_orderdate")
    return c.select("o_orderkey", "year")


@query("strip_markup", """
SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest,
       length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS n_chars
FROM pages
""")
def strip_markup(spark, sf):
    p = t(spark, sf, "pages")
    s = TX.strip_markup("html")
    return p.select("page_id", F.md5(s).alias("digest"), F.length(s).alias("n_chars"))


@query("chop_preamble", """
SELECT doc_id, md5(substr(coalesce(text, ''), 36)) AS digest, length(substr(coalesce(text, ''), 36)) AS n_chars
FROM documents
""")
def chop_preamble(spark, sf):
    d = t(spark, sf, "documents")
    s = TX.chop_preamble("text")
    return d.select("doc_id", F.md5(s).alias("digest"), F.length(s).alias("n_chars"))


# -- P10-P12: provisions -> articles ----------------------------------------------
def provision_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Per order, a list of citation strings in the corpus' spelling, one per
    line item, in line order (a bounded per-order list)."""
    li = t(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    code = (F.when(F.col("l_returnflag") == "R", F.concat(F.lit("EPC1973_Art_0"), (n + 51).cast("string")))
            .when(F.col("l_returnflag") == "A", F.concat(F.lit("EPC2000_Art_0"), (n + 50).cast("string"), F.lit("_(2007)")))
            .when(F.col("l_linestatus") == "O", F.concat(F.lit("EPC_Art_052("), n.cast("string"), F.lit(")")))
            .when(n == 7, F.lit("Article 54 EPC"))
            .when(n == 6, F.lit("RPBA_Art_13"))
            .otherwise(F.concat(F.lit("EPC_R_"), n.cast("string"))))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(n.alias("n"), code.alias("c")))).alias("s"))
    return g.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("s", lambda x: x["c"]).alias("provisions"))


_PROV_SQL = """
li AS (
  SELECT l_orderkey AS o_orderkey, l_linenumber,
    CASE WHEN l_returnflag = 'R' THEN 'EPC1973_Art_0' || CAST(l_linenumber + 51 AS VARCHAR)
         WHEN l_returnflag = 'A' THEN 'EPC2000_Art_0' || CAST(l_linenumber + 50 AS VARCHAR) || '_(2007)'
         WHEN l_linestatus = 'O' THEN 'EPC_Art_052(' || CAST(l_linenumber AS VARCHAR) || ')'
         WHEN l_linenumber = 7 THEN 'Article 54 EPC'
         WHEN l_linenumber = 6 THEN 'RPBA_Art_13'
         ELSE 'EPC_R_' || CAST(l_linenumber AS VARCHAR) END AS c
  FROM lineitem),
p AS (SELECT o_orderkey, list(c ORDER BY l_linenumber, c) AS provisions FROM li GROUP BY o_orderkey),
n1 AS (SELECT o_orderkey, provisions,
  list_transform(list_filter(list_transform(list_filter(provisions, lambda x: contains(x, 'Art') AND contains(x, 'EPC')),
        lambda x: split_part(split_part(x, 'Art', 2), '_(2007)', 1)),
        lambda x: x <> '' AND length(x) < 15 AND NOT contains(x, 'icle')),
      lambda x: CASE WHEN contains(x, '_') THEN split_part(x, '_', 2) ELSE x END) AS codes FROM p),
n2 AS (SELECT *, list_filter(list_transform(codes, lambda x: CASE x
        WHEN '052(2)' THEN 'Subject Matter' WHEN '052(3)' THEN 'Subject Matter' WHEN '052(4)' THEN 'Subject Matter'
        WHEN '053' THEN 'Subject Matter' WHEN '054' THEN 'Novelty' WHEN '055' THEN 'Novelty'
        WHEN '056' THEN 'Inventive Step' WHEN '057' THEN 'Industrial Applicability' END), lambda x: x IS NOT NULL) AS named
  FROM n1),
n3 AS (SELECT *, list_filter(named, lambda x, i: list_position(named, x) = i) AS uniq FROM n2),
art AS (SELECT o_orderkey, provisions, codes, CASE WHEN len(uniq) > 0 THEN uniq ELSE ['Other'] END AS articles FROM n3)"""


def articles_frame(spark, sf) -> DataFrame:
    p = provision_lists(spark, sf)
    codes = C.normalise_provisions("provisions")
    return p.select("o_orderkey", "provisions", codes.alias("codes")).withColumn("articles", C.map_codes("codes"))


@query("normalise_provisions", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT o_orderkey, array_to_string(provisions, '|') AS provisions, array_to_string(codes, '|') AS codes FROM art
""")
def normalise_provisions(spark, sf):
    a = articles_frame(spark, sf)
    return a.select("o_orderkey", F.array_join("provisions", "|").alias("provisions"),
                    F.array_join("codes", "|").alias("codes"))


@query("map_codes", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT o_orderkey, array_to_string(articles, '|') AS articles FROM art
""")
def map_codes(spark, sf):
    a = articles_frame(spark, sf)
    return a.select("o_orderkey", F.array_join("articles", "|").alias("articles"))


@query("array_exact_filter", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT o_orderkey FROM art WHERE articles = ['Inventive Step']
""")
def array_exact_filter(spark, sf):
    a = articles_frame(spark, sf)
    return a.filter(C.exact_array_filter("articles", ["Inventive Step"])).select("o_orderkey")


# -- P13/P14: keyword exclusion ---------------------------------------------------
def keyword_lists(spark, sf) -> DataFrame:
    li = t(spark, sf, "lineitem")
    kw = (F.when(F.col("l_returnflag") == "R", F.lit("Inventive step - auxiliary request"))
          .when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), F.lit("Inventive Step - main request (no)"))
          .when(F.col("l_linestatus") == "F", F.lit("Inventive step - (yes)"))
          .otherwise(F.lit("Novelty - prior art")))
    g = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"),
                                                                           kw.alias("k")))).alias("s"))
    return g.select(F.col("l_orderkey").alias("o_orderkey"), F.transform("s", lambda x: x["k"]).alias("keywords"))


@query("keyword_exclude", lambda: f"""
WITH k0 AS (
  SELECT l_orderkey AS o_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Inventive step - auxiliary request'
        WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'Inventive Step - main request (no)'
        WHEN l_linestatus = 'F' THEN 'Inventive step - (yes)' ELSE 'Novelty - prior art' END AS k
  FROM lineitem),
k AS (SELECT o_orderkey, list(k ORDER BY l_linenumber, k) AS kw FROM k0 GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(array_to_string(kw, ' | '), '') AS keywords FROM k
WHERE NOT regexp_matches(coalesce(array_to_string(kw, ' | '), ''), '{C.AUXILIARY_PATTERN}', 'i')
""")
def keyword_exclude(spark, sf):
    k = keyword_lists(spark, sf).withColumn("keywords", C.keywords_string("keywords"))
    return k.filter(~C.keyword_excluded("keywords")).select("o_orderkey", "keywords")


@query("convert_reference", r"""
WITH r AS (SELECT o_orderkey, 'T' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || lpad(CAST(o_custkey AS VARCHAR), 4, '0')
    || CASE o_orderstatus WHEN 'F' THEN 'EU1' WHEN 'O' THEN 'EP2' ELSE 'EU3' END AS reference FROM orders)
SELECT o_orderkey, reference, regexp_replace(reference, '^([A-Z])(\d{2})(\d+)(EU|EP)[12]$', '\1\3\2') AS converted FROM r
""")
def convert_reference(spark, sf):
    o = t(spark, sf, "orders")
    ref = F.concat(F.lit("T"), F.substring(F.year("o_orderdate").cast("string"), 3, 2),
                   F.lpad(F.col("o_custkey").cast("string"), 4, "0"),
                   F.when(F.col("o_orderstatus") == "F", "EU1").when(F.col("o_orderstatus") == "O", "EP2").otherwise("EU3"))
    r = o.select("o_orderkey", ref.alias("reference"))
    return r.withColumn("converted", C.convert_reference("reference"))


@query("array_contains_filter", lambda: f"""
SELECT page_id FROM pages
WHERE len(list_filter(regexp_extract_all(html, '{LI_ITEMS}', 1), lambda x: contains(lower(x), 'the'))) > 0
""")
def array_contains_filter(spark, sf):
    p = t(spark, sf, "pages").withColumn("items", F.regexp_extract_all("html", F.lit(LI_ITEMS), 1))
    return p.filter(C.array_contains_text("items", "THE")).select("page_id")


# -- P18/P19 ------------------------------------------------------------------------
def outcome_of(status):
    s = F.col(status)
    return F.when(s == "F", "Affirmed").when(s == "O", "Reversed").otherwise("Unknown")


@query("binary_label", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Affirmed' ELSE 'Reversed' END AS outcome,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label
FROM orders WHERE o_orderstatus IN ('F', 'O')
""")
def binary_label(spark, sf):
    o = t(spark, sf, "orders").withColumn("outcome", outcome_of("o_orderstatus"))
    k = o.filter(F.col("outcome").isin("Affirmed", "Reversed"))
    return k.select("o_orderkey", "outcome", F.when(F.col("outcome") == "Affirmed", 1).otherwise(0).alias("label"))


# -- P20-P23 ------------------------------------------------------------------------
PRIORITY_DOMAIN_SQL = "SELECT DISTINCT o_orderpriority FROM orders WHERE year(o_orderdate) < 1998"


@query("one_hot_aligned", """
WITH o AS (SELECT o_orderkey, o_orderpriority AS p,
                  CASE WHEN year(o_orderdate) < 1998 THEN 'train' ELSE 'test' END AS split
           FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' OR year(o_orderdate) >= 1998)
SELECT o_orderkey, split,
  CAST(p = '1-URGENT' AS INTEGER) AS prio_1, CAST(p = '2-HIGH' AS INTEGER) AS prio_2,
  CAST(p = '3-MEDIUM' AS INTEGER) AS prio_3, CAST(p = '4-NOT SPECIFIED' AS INTEGER) AS prio_4
FROM o
""")
def one_hot_aligned(spark, sf):
    """Dummies over the training domain only; test rows of an unseen value
    (here 5-LOW never occurs in train) get all zeros. The domain is the
    distinct values of one categorical column: a bounded, tiny collect."""
    o = t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    o = o.filter((F.col("o_orderstatus").isin("F", "O") & (F.col("o_orderpriority") != "5-LOW"))
                 | (F.col("year") >= 1998))
    o = o.withColumn("split", F.when(F.col("year") < 1998, "train").otherwise("test"))
    domain = sorted(r[0] for r in o.filter(F.col("split") == "train").select("o_orderpriority").distinct().collect())
    cols = one_hot("o_orderpriority", domain)
    renamed = [c.alias(f"prio_{v.split('-')[0]}") for c, v in zip(cols, domain)]
    return o.select("o_orderkey", "split", *renamed)


@query("binarise", """
SELECT o_orderkey, CAST(o_totalprice > 150000 AS DOUBLE) AS expensive, CAST(o_custkey > 0 AS DOUBLE) AS known FROM orders
""")
def binarise_orders(spark, sf):
    """Numbers to 0.0 / 1.0 by a threshold."""
    return t(spark, sf, "orders").select("o_orderkey", binarise("o_totalprice", 150000).alias("expensive"),
                                         binarise("o_custkey").alias("known"))


# -- P24/P25 ------------------------------------------------------------------------
@query("derive_category", """
SELECT o_orderkey, category, matches,
  CASE WHEN category = 'Opposition Division' AND matches IN ('1', '2', '3') THEN matches ELSE '0' END AS od_match
FROM (SELECT o_orderkey,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'Opposition Division' ELSE 'Patent Refusal' END AS category,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN
          CAST(1 + (o_custkey % 4) AS VARCHAR) END AS matches
      FROM orders)
""")
def derive_category(spark, sf):
    o = t(spark, sf, "orders")
    od = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")
    c = o.select("o_orderkey", F.when(od, "Opposition Division").otherwise("Patent Refusal").alias("category"),
                 F.when(od, (F.lit(1) + F.col("o_custkey") % 4).cast("string")).alias("matches"))
    odm = F.when((F.col("category") == "Opposition Division") & F.col("matches").isin("1", "2", "3"),
                 F.col("matches")).otherwise(F.lit("0"))
    return c.withColumn("od_match", odm)


# -- P26/P33 ------------------------------------------------------------------------
@query("relabel", """
SELECT event_id,
  CASE event_type WHEN 'click' THEN 'Click-through' WHEN 'view' THEN 'Page view' ELSE event_type END AS event_label,
  split_part(upper(substr(event_type, 1, 1)) || substr(event_type, 2) || 'Classifier(k=' ||
    CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || ')', '(', 1) AS algo
FROM events
""")
def relabel(spark, sf):
    e = t(spark, sf, "events")
    clf = F.concat(F.initcap("event_type"), F.lit("Classifier(k="), F.get_json_object("props", "$.k"), F.lit(")"))
    return e.select("event_id", C.relabel("event_type", {"click": "Click-through", "view": "Page view"}).alias("event_label"),
                    C.class_name(clf).alias("algo"))


# -- P27/P28/P31/P32 --------------------------------------------------------------------
def param_maps(spark, sf) -> DataFrame:
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    m = F.create_map(F.lit("clf__C"), F.col("value").cast("string"), F.lit("vect__num__min_df"), k,
                     F.lit("prep__stopwords"), F.when(F.col("value") > 50, "true").otherwise("false"),
                     F.lit("clf__penalty"), F.col("event_type"))
    return e.select("event_id", m.alias("params"))


@query("map_prefix_params", """
SELECT event_id,
  'C=' || CAST(value AS VARCHAR) || ';penalty=' || event_type AS clf_params,
  'min_df=' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS vect_params
FROM events
""")
def map_prefix_params(spark, sf):
    def strip(prefix):
        m = F.transform_keys(F.map_filter("params", lambda k, v: k.startswith(prefix)),
                             lambda k, v: F.substring(k, F.lit(len(prefix) + 1), F.length(k)))
        ent = F.array_sort(F.map_entries(m))
        return F.array_join(F.transform(ent, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")

    p = param_maps(spark, sf)
    return p.select("event_id", strip("clf__").alias("clf_params"), strip("vect__num__").alias("vect_params"))


@query("json_params", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  lower(trim(CASE WHEN value > 50 THEN ' True ' ELSE 'no' END)) IN ('1', 'true', 'yes', 'y', 't') AS stop_flag
FROM events
""")
def json_params(spark, sf):
    e = t(spark, sf, "events")
    parsed = F.from_json("props", "k BIGINT")
    flag_text = F.when(F.col("value") > 50, " True ").otherwise("no")
    return e.select("event_id", parsed["k"].alias("k"),
                    F.lower(F.trim(flag_text)).isin("1", "true", "yes", "y", "t").alias("stop_flag"))


@query("run_filter", """
WITH plan AS (SELECT DISTINCT event_type AS algo, user_id % 3 AS fold FROM events)
SELECT algo, fold FROM plan
WHERE list_contains(list_transform(string_split(' click, view ,purchase', ','), lambda x: trim(x)), algo)
""")
def run_filter(spark, sf):
    e = t(spark, sf, "events")
    plan = e.select(F.col("event_type").alias("algo"), (F.col("user_id") % 3).alias("fold")).distinct()
    wanted = F.transform(F.split(F.lit(" click, view ,purchase"), ","), lambda x: F.trim(x))
    return plan.filter(F.array_contains(wanted, F.col("algo")))
