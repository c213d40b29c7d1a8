"""Golden rows for record cleaning."""

from pyspark.sql import functions as F

from lexframe.operators import clean as C


def test_provisions_and_articles(spark):
    items = ["EPC1973_Art_056", "EPC2000_Art_054_(2007)", "EPC_Art_052(2)", "EPC1973_Art_123(2)",
             "Article 54 EPC", "EPC_R_27", "RPBA_Art_13", "EPC_Art"]
    df = spark.createDataFrame([(items,), (["EPC_Art_054(2)"],), ([],)], "p array<string>")
    out = df.select(C.normalise_provisions("p").alias("codes")).withColumn("art", C.map_codes("codes")).collect()
    assert out[0].codes == ["056", "054", "052(2)", "123(2)"]
    assert out[0].art == ["Inventive Step", "Novelty", "Subject Matter"]
    assert out[1].art == ["Other"]
    assert out[2].codes == [] and out[2].art == ["Other"]


def test_convert_reference(spark):
    df = spark.createDataFrame([("T112564EU1",), ("T000019EU1",), ("X1",), ("T112564EU3",)], "r string")
    assert [r[0] for r in df.select(C.convert_reference("r")).collect()] == ["T256411", "T001900", "X1", "T112564EU3"]


def test_date_repair_and_parse(spark):
    rows = [("2019", "ECLI:EP:BA:2019:T123415.20190521"), ("20180102", "ECLI:EP:BA:2018:T1.20180102"),
            ("", None), ("03.04.2017", "x"), ("garbage!", "y")]
    df = spark.createDataFrame(rows, "d string, e string")
    out = df.select(C.parse_date(C.repair_date("d", "e")).alias("t")).collect()
    got = [r.t.strftime("%Y-%m-%d") if r.t else None for r in out]
    assert got == ["2019-05-21", "2018-01-02", None, "2017-04-03", None]


def test_keyword_exclusion(spark):
    rows = [("Inventive step - auxiliary request (yes)",), ("Novelty - main request",), ("inventive STEP - (no)",),
            ("",)]
    df = spark.createDataFrame(rows, "k string")
    assert [r[0] for r in df.select(C.keyword_excluded("k")).collect()] == [True, False, True, False]


def test_dedup_keep_last(spark):
    rows = [
        (1, "ECLI:EP:BA:2019:T000119.20190101", "A"),
        (2, "ECLI:EP:BA:2019:T000119.20190101", None),   # null title in a duplicated key: dropped
        (3, "ECLI:EP:BA:2019:T000119.20190101", "B"),    # last titled row wins
        (4, "ECLI:EP:BA:2019:T000219.20190101", None),   # single row: kept despite null title
        (5, "ECLI:EP:BA:2019:T000319.20190101", None),   # all-null group vanishes
        (6, "ECLI:EP:BA:2019:T000319.20190101", None),
        (7, "short", "C"),                               # key shorter than 20: dropped
    ]
    df = spark.createDataFrame(rows, "seq long, ecli string, title string")
    out = sorted((r.seq, r.title) for r in C.dedup_keep_last(df, "ecli", "title", "seq").collect())
    assert out == [(3, "B"), (4, None)]
    # idempotent
    again = C.dedup_keep_last(C.dedup_keep_last(df, "ecli", "title", "seq"), "ecli", "title", "seq")
    assert sorted((r.seq, r.title) for r in again.collect()) == out


def test_blank_and_exact_filters(spark):
    df = spark.createDataFrame([(" \t", ["Inventive Step"]), ("x", ["Inventive Step", "Novelty"])],
                               "s string, a array<string>")
    out = df.select(C.blanks_to_null(df.select("s")).columns[0]).collect()
    assert out
    b = C.blanks_to_null(df).collect()
    assert b[0].s is None and b[1].s == "x"
    assert [r[0] for r in df.select(C.exact_array_filter("a", ["Inventive Step"])).collect()] == [True, False]
    assert [r[0] for r in df.select(C.array_contains_text("a", "NOVEL")).collect()] == [False, True]
    assert F is not None
