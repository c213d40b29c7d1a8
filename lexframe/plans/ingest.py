"""Scans, sources and sinks. Round trips write below the
shared folder and read back with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sampling as S
from ..operators.clean import select_present
from ..session import scratch_path
from ..sources import files as FS
from ..sources import markup as MK
from .aggregates import REC_SQL, result_records
from .catalog import query, t
from .scalars import _PROV_SQL, provision_lists
from .windows import CASES_SQL, HK, cases

# The oracle's patterns have no look-ahead: a tag's attributes may not end with a slash there.
P_OPEN = "<p(?:\\s(?:[^>/]|/[^>])*)?>"


def _decode_sql(s: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'" * 2), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{char}')"
    return s


@query("markup_attribute", """
SELECT page_id, regexp_extract(regexp_extract(html, '<html[\\s>][^>]*', 0), '\\slang="([^"]*)"', 1) AS lang,
  regexp_extract(regexp_extract(html, '<meta[\\s>][^>]*', 0), '\\scharset="([^"]*)"', 1) AS charset,
  regexp_extract(regexp_extract(html, '<body[\\s>][^>]*', 0), '\\sclass="([^"]*)"', 1) AS body_class
FROM pages
""")
def markup_attribute(spark, sf):
    p = t(spark, sf, "pages")
    return p.select("page_id", MK.attribute("html", "html", "lang").alias("lang"),
                    MK.attribute("html", "meta", "charset").alias("charset"),
                    MK.attribute("html", "body", "class").alias("body_class"))


@query("markup_tag_text", lambda: f"""
WITH x AS (SELECT page_id, list_transform(list_filter(regexp_extract_all(html, '{P_OPEN}([^<]*)', 1), lambda s: s <> ''),
                                           lambda s: {_decode_sql('s')}) AS items FROM pages)
SELECT page_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS digest FROM x
""")
def markup_tag_text(spark, sf):
    p = t(spark, sf, "pages").select("page_id", MK.tag_texts("html", "p").alias("items"))
    return p.select("page_id", F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("digest"))


@query("markup_nested_text", lambda: f"""
WITH b AS (SELECT page_id, regexp_extract_all(html, '(?s)<article(?:\\s[^>]*)?>(.*?)</article>', 1) AS blocks,
                  regexp_extract_all(html, '<article((?:\\s[^>]*)?)>', 1) AS opens FROM pages),
x AS (SELECT page_id, flatten(list_transform(blocks, lambda blk:
         list_transform(list_filter(regexp_extract_all(blk, '{P_OPEN}([^<]*)', 1), lambda s: s <> ''),
                        lambda s: {_decode_sql('s')}))) AS items,
         list_transform(opens, lambda o: regexp_extract(o, '\\sclass="([^"]*)"', 1)) AS attrs FROM b)
SELECT page_id, len(items) AS n_items, md5(array_to_string(items, '|')) AS digest, array_to_string(attrs, ',') AS attrs FROM x
""")
def markup_nested_text(spark, sf):
    p = t(spark, sf, "pages")
    x = p.select("page_id", MK.nested_texts("html", "article", "p").alias("items"),
                 MK.outer_attributes("html", "article", "class").alias("attrs"))
    return x.select("page_id", F.size("items").alias("n_items"), F.md5(F.array_join("items", "|")).alias("digest"),
                    F.array_join("attrs", ",").alias("attrs"))


def _sorted_list(value, where=None):
    v = value if where is None else F.when(where, value)
    return F.transform(F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct(
        F.col("l_linenumber").alias("n"), v.alias("v"))))), lambda x: x["v"])


@query("zip_classification", """
WITH g AS (SELECT l_orderkey,
  list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS sec,
  list(lpad(CAST(l_linenumber AS VARCHAR), 2, '0') ORDER BY l_linenumber) FILTER (WHERE l_quantity > 10) AS cls,
  list(l_linestatus ORDER BY l_linenumber, l_linestatus) AS sub,
  list(CAST(l_partkey % 1000 AS VARCHAR) ORDER BY l_linenumber, CAST(l_partkey % 1000 AS VARCHAR)) FILTER (WHERE l_discount > 0.02) AS mg,
  list(CAST(l_suppkey AS VARCHAR) ORDER BY l_linenumber, CAST(l_suppkey AS VARCHAR)) AS sg
  FROM lineitem GROUP BY l_orderkey),
h AS (SELECT l_orderkey, sec, coalesce(cls, []) AS cls, sub, coalesce(mg, []) AS mg, sg FROM g),
z AS (SELECT l_orderkey, list_transform(range(least(len(sec), len(cls), len(sub))), lambda i:
        sec[i + 1] || cls[i + 1] || sub[i + 1] || ' ' ||
        CASE WHEN i < len(mg) AND i < len(sg) THEN mg[i + 1] || '/' || sg[i + 1] ELSE '' END) AS classes FROM h)
SELECT l_orderkey, len(classes) AS n_classes, array_to_string(classes, ';') AS classes FROM z
""")
def zip_classification(spark, sf):
    li = t(spark, sf, "lineitem")
    g = li.groupBy("l_orderkey").agg(
        _sorted_list(F.col("l_returnflag")).alias("sec"),
        _sorted_list(F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.col("l_quantity") > 10).alias("cls"),
        _sorted_list(F.col("l_linestatus")).alias("sub"),
        _sorted_list((F.col("l_partkey") % 1000).cast("string"), F.col("l_discount") > 0.02).alias("mg"),
        _sorted_list(F.col("l_suppkey").cast("string")).alias("sg"))
    z = g.select("l_orderkey", MK.zip_classification(F.col("sec"), F.col("cls"), F.col("sub"), F.col("mg"),
                                                      F.col("sg")).alias("classes"))
    return z.select("l_orderkey", F.size("classes").alias("n_classes"), F.array_join("classes", ";").alias("classes"))


@query("cited_edges", """
SELECT l_orderkey, l_returnflag || ' ' || CAST(l_partkey AS VARCHAR) || ' ' || CAST(year(l_shipdate) AS VARCHAR) AS cited, count(*) AS n
FROM lineitem WHERE l_linestatus <> 'O' AND l_returnflag IS NOT NULL GROUP BY 1, 2
""")
def cited_edges(spark, sf):
    """Cited items per record (nested array<struct>) -> "code num year" for
    the complete ones -> an edge table (record, cited)."""
    li = t(spark, sf, "lineitem")
    item = F.struct(F.col("l_returnflag").alias("code"), F.col("l_partkey").cast("string").alias("num"),
                    F.when(F.col("l_linestatus") != "O", F.year("l_shipdate").cast("string")).alias("year"))
    rec = li.groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    e = rec.select("l_orderkey", F.explode(MK.cited_edges(F.col("items"))).alias("cited"))
    return e.groupBy("l_orderkey", "cited").agg(F.count(F.lit(1)).alias("n"))


# -- S1 / S7 -----------------------------------------------------------------------
DECISION_SCHEMA = T.StructType([
    T.StructField("_key", T.LongType()), T.StructField("_status", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("price", T.DoubleType()),
    T.StructField("decided", T.StringType()),
    T.StructField("provisions", T.StructType([T.StructField("provision", T.ArrayType(T.StringType()))])),
])


@query("xml_roundtrip", lambda: f"""
WITH {_PROV_SQL.strip()}
SELECT o.o_orderkey, o.o_orderstatus, o.o_orderpriority, o.o_totalprice, strftime(o.o_orderdate, '%Y-%m-%d') AS decided,
       coalesce(array_to_string(a.provisions, '|'), '') AS provisions
FROM orders o LEFT JOIN art a ON o.o_orderkey = a.o_orderkey
""")
def xml_roundtrip(spark, sf):
    """Records written as XML (attributes + nested repeated elements) and
    scanned back one row per element with an explicit schema."""
    o = t(spark, sf, "orders")
    p = provision_lists(spark, sf)
    rec = o.join(p, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("_key"), F.col("o_orderstatus").alias("_status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("decided"),
        F.struct(F.col("provisions").alias("provision")).alias("provisions"))
    path = scratch_path(spark, "decisions-xml")
    FS.write_xml(rec, path, "decision", "decisions")
    x = FS.read_xml(spark, path, "decision", DECISION_SCHEMA)
    return x.select(F.col("_key").alias("o_orderkey"), F.col("_status").alias("o_orderstatus"),
                    F.col("priority").alias("o_orderpriority"), F.col("price").alias("o_totalprice"), "decided",
                    F.coalesce(F.array_join("provisions.provision", "|"), F.lit("")).alias("provisions"))


@query("parquet_roundtrip", lambda: f"""
WITH {CASES_SQL}
SELECT o_orderkey, year, outcome FROM cases WHERE year >= 1999
""")
def parquet_roundtrip(spark, sf):
    """Cases written partitioned by year, read back with a year predicate
    (partition pruning: only the matching year folders are listed)."""
    path = scratch_path(spark, "cases-parquet")
    FS.write_table(cases(spark, sf).select("o_orderkey", "outcome", "year"), path, ["year"])
    back = spark.read.parquet(path).filter(F.col("year") >= 1999)
    return back.select("o_orderkey", "year", "outcome")


@query("corpus_scan_filter", """
SELECT doc_id, md5(text) AS digest FROM documents WHERE lang = 'en' AND source <> 'src0'
""")
def corpus_scan_filter(spark, sf):
    """Headerless TSV corpus (from 0: column 4 language, 5 kind, 7 text)."""
    d = t(spark, sf, "documents")
    kind = F.when(F.col("source") == "src0", "PDFEP").otherwise("TXT")
    rows = d.select(F.col("doc_id").cast("string"), "source", F.col("n_chars").cast("string"), F.lit("EP"), "lang",
                    kind.alias("kind"), F.lit("A1"), "text")
    path = scratch_path(spark, "corpus-tsv")
    FS.write_tsv(rows, path)
    c = FS.scan_corpus(spark, path)
    return c.select(F.col("c0").cast("bigint").alias("doc_id"), F.md5("c7").alias("digest"))


RESULT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("case_mode", T.StringType()),
    T.StructField("experiment", T.StringType()), T.StructField("algo", T.StringType()),
    T.StructField("feature", T.StringType()), T.StructField("f1", T.DoubleType()), T.StructField("mcc", T.DoubleType()),
    T.StructField("test_metrics", T.StructType([T.StructField("f1", T.DoubleType()), T.StructField("mcc", T.DoubleType())])),
])


def _records(spark, sf) -> DataFrame:
    r = result_records(spark, sf)
    return r.select("event_id", "case_mode", "experiment", "algo", "feature", "f1", "mcc",
                    F.struct("f1", "mcc").alias("test_metrics"))


@query("results_append", lambda: f"""
WITH {REC_SQL}
SELECT experiment, algo, count(*) AS n, round(sum(f1), 6) AS sum_f1 FROM rec GROUP BY 1, 2
""")
def results_append(spark, sf):
    """Two runs append their records to one store; read back and summed."""
    path = scratch_path(spark, "results")
    r = _records(spark, sf)
    FS.append_results(r.filter(F.col("experiment") == "1"), path)
    FS.append_results(r.filter(F.col("experiment") == "2"), path)
    back = FS.load_results(spark, path, RESULT_SCHEMA)
    return back.groupBy("experiment", "algo").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("f1"), 6).alias("sum_f1"))


@query("results_load", lambda: f"""
WITH {REC_SQL}
SELECT case_mode, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(max(mcc), 6) AS max_mcc FROM rec GROUP BY 1
""")
def results_load(spark, sf):
    """Tolerant loader: a store with a broken file loses only the broken
    lines; a missing store is an empty frame of the same schema."""
    path = scratch_path(spark, "results")
    FS.append_results(_records(spark, sf), path)
    broken = t(spark, sf, "events").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"),
                                                     F.lit(', "algo": ')).alias("value"))
    broken.write.mode("append").text(path)  # truncated records, as after a crash
    back = FS.load_results(spark, path, RESULT_SCHEMA)
    missing = FS.load_results(spark, path + "-missing", RESULT_SCHEMA)
    allr = back.unionByName(missing)
    return allr.groupBy("case_mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("test_metrics.f1"), 6).alias("mean_f1"),
                                         F.round(F.max("mcc"), 6).alias("max_mcc"))


@query("embedding_text_load", """
SELECT vec_id, len(embedding) AS dim, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total
FROM embeddings WHERE label NOT IN (8, 9)
""")
def embedding_text_load(spark, sf):
    """Vectors as text lines "word v1..vd": lines with the wrong arity or a
    non-number are skipped, as is the "n d" header."""
    e = t(spark, sf, "embeddings")
    text = F.col("embedding").cast("array<string>")
    vec = F.when(F.col("label") == 9, F.slice(text, 1, 63)).when(
        F.col("label") == 8, F.concat(F.array(F.lit("n/a")), F.slice(text, 2, 63))).otherwise(text)
    path = scratch_path(spark, "vectors-txt")
    FS.write_vectors_text(e.select("vec_id", vec.alias("v")), "vec_id", "v", path)
    header = e.agg(F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.lit("64")).alias("value"))
    header.write.mode("append").text(path)
    v = FS.read_vectors_text(spark, path, 64)
    total = F.aggregate(F.transform("vector", lambda x: x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return v.select(F.col("word").cast("bigint").alias("vec_id"), F.size("vector").alias("dim"),
                    F.round(total, 4).alias("total"))


@query("dataset_profile", """
SELECT count(*) AS n_rows, min(year(o_orderdate)) AS min_year, max(year(o_orderdate)) AS max_year FROM orders
""")
def dataset_profile(spark, sf):
    """Required columns are checked on the schema; rows and year range."""
    o = t(spark, sf, "orders")
    missing = {"o_orderkey", "o_orderdate", "o_orderstatus"} - set(o.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    return o.agg(F.count(F.lit(1)).alias("n_rows"), F.min(F.year("o_orderdate")).alias("min_year"),
                 F.max(F.year("o_orderdate")).alias("max_year"))


@query("select_present", "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def select_present_q(spark, sf):
    return select_present(t(spark, sf, "orders"), ["o_orderkey", "o_clerk", "o_orderdate", "o_totalprice"])


@query("infer_mode", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pf'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'op' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'both' ELSE 'unknown' END AS case_mode
FROM orders
""")
def infer_mode(spark, sf):
    """Split files named ``X_Train_1_<mode>.parquet``; the mode is read back
    from each row's file name."""
    base = scratch_path(spark, "splits")
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    groups = {"pf": ["1-URGENT", "2-HIGH"], "op": ["3-MEDIUM"], "both": ["4-NOT SPECIFIED"], "all": ["5-LOW"]}
    for mode, prios in groups.items():
        o.filter(F.col("o_orderpriority").isin(*prios)).select("o_orderkey").write.mode("overwrite").parquet(
            f"{base}/X_Train_1_{mode}.parquet")
    back = spark.read.parquet(*[f"{base}/X_Train_1_{m}.parquet" for m in groups])
    return back.select("o_orderkey", FS.infer_case_mode(F.col("_metadata.file_path")).alias("case_mode"))


@query("sample_report", lambda: f"""
WITH {CASES_SQL},
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {HK}, o_orderkey) AS rn FROM cases) WHERE rn <= 10)
SELECT printf('%d. [%s] case %d (%d)', row_number() OVER (ORDER BY {HK}, o_orderkey), outcome, o_orderkey, year) AS line FROM s
""")
def sample_report(spark, sf):
    """Numbered report of the 10+10 validation sample, written as text."""
    s = S.validation_sample(cases(spark, sf), "outcome", "o_orderkey", 20)
    # numbered in seeded hash order by the range-partitioned position (no
    # single-partition window, whatever the sample size)
    p = S.global_position(s, [S.hash_order("o_orderkey").asc(), F.col("o_orderkey").asc()], "pos")
    lines = p.select(F.format_string("%d. [%s] case %d (%d)", (F.col("pos") + 1).cast("int"), "outcome", "o_orderkey",
                                     "year").alias("line"))
    path = scratch_path(spark, "sample-report")
    FS.write_report(lines, path)
    return spark.read.text(path).select(F.col("value").alias("line"))
