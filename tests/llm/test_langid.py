"""Language identification: held-out accuracy, what each evidence adds."""

import awkward
from conftest import MEDIUM
from lexframe.llm import langid as L
from pyspark.sql import functions as F

NONE = lambda: F.lit(None).cast("string")


def test_held_out_accuracy_of_the_text_alone(spark):
    d = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    held = F.col("doc_id") % 4 == 0
    rows = L.identify(d, F.when(~held, F.col("lang")), NONE(), NONE()).filter(held).collect()
    long = [r for r in rows if len(r["text"].split()) >= 20]
    assert len(long) > 150 and sum(r["_lang"] == r["lang"] for r in long) >= 0.97 * len(long)


def test_documents_stay(spark):
    d = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = L.op3_language_fusion(spark, MEDIUM).collect()
    assert len(rows) == d.count()
    assert sum(r["kept"] for r in rows) >= 0.995 * len(rows)
    assert sum(r["lang"] == r["declared"] for r in rows) >= 0.98 * len(rows)


def test_evidence_is_fused(spark):
    en = "the house and the garden that was with them in the morning for this and that "
    de = "der hund und die katze mit dem haus in der nacht auf dem weg nicht das "
    rows = [(i, en * 3, "en", "a.uk", "uk") for i in range(40)] + [(100 + i, de * 3, "de", "b.de", "de") for i in range(40)]
    rows += [(200, "ok", None, "b.de", "de"), (201, "ok", None, "a.uk", "uk"), (202, "ok", "de", None, None),
             (203, en * 3, "de", "b.de", "de"), (204, None, None, "b.de", "de"), (205, "123 456", None, None, None),
             (206, "ok", None, "new.de", "de"), (207, None, "en", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string, suffix string")
    got = {r["doc_id"]: (r["_lang"], r["_accepted"]) for r in L.identify(
        d, F.col("lang"), F.col("host"), F.col("suffix"), languages=("de", "en")).collect()}
    assert got[0] == ("en", True) and got[100] == ("de", True)
    assert got[200][0] == "de" and got[201][0] == "en" and got[202][0] == "de" and got[207] == ("en", True)
    assert got[203] == ("en", True)  # a long text outweighs its page and its host
    assert got[204] == ("de", False) and got[205] == (None, False)


def test_pages(spark):
    rows = L.identify_pages(spark.read.parquet(f"{MEDIUM}/pages.parquet")).collect()
    lang = lambda r: r["html"].split('<html lang="')[1][:2]
    assert sum(r["_lang"] == lang(r) for r in rows) >= 0.99 * len(rows)
    s = spark.range(1).select(*[L.suffix_of(F.lit(u)).alias(u) for u in (
        "http://a.example.de:80/x", "https://u@host/x", "ftp://b.co.uk?q", "nothing")]).first()
    assert list(s) == ["de", "host", "uk", ""]


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet")
    out = L.identify_documents(d)
    assert out.count() == len(awkward.rows())
    kept = L.keep_identified(d)
    assert kept.columns == d.columns and {1, 2, 9} <= {r["doc_id"] for r in kept.collect()}
    assert L.identify_documents(d.filter(F.lit(False))).count() == 0
