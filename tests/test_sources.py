"""Markup extraction and file sources on literal inputs."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexframe.session import scratch_path
from lexframe.sources import files as FS
from lexframe.sources import markup as MK

HTML = ('<doc lang="en"><sec class="a"><p>one <b>two</b> three</p><p><b>bold</b> tail</p><p></p>'
        '<p>four</p></sec><p>outside</p><sec><p>five</p></sec></doc>')


def test_first_text_child_semantics(spark):
    df = spark.createDataFrame([(HTML,)], "h string")
    r = df.select(MK.attribute("h", "doc", "lang").alias("lang"), MK.attribute("h", "doc", "x").alias("missing"),
                  MK.tag_texts("h", "p").alias("p"), MK.nested_texts("h", "sec", "p").alias("nested"),
                  MK.outer_attributes("h", "sec", "class").alias("attrs")).first()
    assert r.lang == "en" and r.missing == ""
    # text after an inner element is lost; element-first and empty elements give nothing
    assert r.p == ["one ", "four", "outside", "five"]
    assert r.nested == ["one ", "four", "five"]
    assert r.attrs == ["a", ""]


def test_zip_classification_and_cited(spark):
    df = spark.createDataFrame([(["A", "B", "C"], ["01", "02"], ["K", "L", "M"], ["1"], ["10", "20"])],
                               "s array<string>, c array<string>, u array<string>, m array<string>, g array<string>")
    z = df.select(MK.zip_classification(*[F.col(x) for x in "scumg"]).alias("z")).first().z
    assert z == ["A01K 1/10", "B02L "]
    items = spark.createDataFrame([([("T", "1", "2001"), ("T", None, "2002"), ("G", "3", "2003")],)],
                                  "i array<struct<code:string,num:string,year:string>>")
    assert items.select(MK.cited_edges(F.col("i"))).first()[0] == ["T 1 2001", "G 3 2003"]


def test_results_store_tolerant(spark):
    schema = T.StructType([T.StructField("algo", T.StringType()), T.StructField("f1", T.DoubleType())])
    path = scratch_path(spark, "store")
    assert FS.load_results(spark, path, schema).count() == 0          # missing store
    FS.append_results(spark.createDataFrame([("a", 0.5)], schema), path)
    FS.append_results(spark.createDataFrame([("b", 0.7)], schema), path)
    spark.createDataFrame([('{"algo": "c", "f1":',)], "value string").write.mode("append").text(path)
    got = sorted((r.algo, r.f1) for r in FS.load_results(spark, path, schema).collect())
    assert got == [("a", 0.5), ("b", 0.7)]


def test_vectors_text_and_mode(spark):
    path = scratch_path(spark, "vec")
    lines = ["3 2", "w1 0.5 1.5", "w2 0.25", "w3 x 1", "w4 -1 2e-1"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    got = sorted((r.word, r.vector) for r in FS.read_vectors_text(spark, path, 2).collect())
    # header, short and non-numeric lines are skipped; floats are float32
    assert [w for w, _ in got] == ["w1", "w4"]
    assert got[0][1] == [0.5, 1.5]
    assert abs(got[1][1][0] + 1.0) < 1e-6 and abs(got[1][1][1] - 0.2) < 1e-6
    df = spark.createDataFrame([("d/X_Train_1_pf.parquet/part-0",), ("d/X_test_2_both.parquet",), ("d/x_all.parquet/p",)],
                               "p string")
    assert [r[0] for r in df.select(FS.infer_case_mode(F.col("p"))).collect()] == ["pf", "both", "unknown"]


def test_results_store_json_documents(spark):
    schema = T.StructType([T.StructField("algo", T.StringType()), T.StructField("f1", T.DoubleType())])
    path = scratch_path(spark, "store-docs")
    docs = ['[{"algo": "a", "f1": 0.5}, {"algo": "b", "f1": 0.7}]', '{"algo": "c", "f1": 0.1}', '[{"algo": ']
    for i, d in enumerate(docs):
        spark.createDataFrame([(d,)], "value string").coalesce(1).write.text(f"{path}/part{i}")
    got = sorted((r.algo, r.f1) for r in FS.load_results(spark, f"{path}/*", schema, multi_line=True).collect())
    assert got == [("a", 0.5), ("b", 0.7), ("c", 0.1)]


def test_markup_follows_the_dom(spark):
    """Literal rows: the first element without the attribute, self-closing and
    nested elements, quotes in attributes, entities."""
    from lexframe.sources import markup as MK

    rows = [
        '<a x="1"/><a n="7">t</a>', '<p class="n"/>tail<p>one</p>', "<b><p>1</p><b><p>2</p></b><p>3</p></b><p>4</p>",
        """<a n='x > y &amp;lt;'>&lt;é&gt; &quot;q&quot;<i>in</i> after</a>""", "<ab n='no'>x</ab><a>yes</a>", "",
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, x string")
    got = [tuple(r)[1:] for r in d.select("i", MK.attribute("x", "a", "n"), MK.tag_texts("x", "p"), MK.tag_texts("x", "a"),
                                          MK.nested_texts("x", "b", "p"), MK.outer_attributes("x", "a", "n")).orderBy("i").collect()]
    assert got == [
        ("", [], ["t"], [], ["", "7"]), ("", ["one"], [], [], []),
        ("", ["1", "2", "3", "4"], [], ["1", "2", "3", "2"], []),
        ("x > y &lt;", [], ['<é> "q"'], [], ["x > y &lt;"]), ("", [], ["yes"], [], [""]), ("", [], [], [], []),
    ]


def test_tsv_columns_are_counted_from_zero(spark):
    from lexframe.session import scratch_path
    from lexframe.sources import files as FS

    path = scratch_path(spark, "tsv")
    spark.createDataFrame([("EP1\tx\tx\tx\ten\tTXT\tx\tthe text",), ("EP2\tx\tx\tx\ten\tPDFEP\tx\tno",),
                           ("EP3\tx\tx\ten\tde\tTXT\tx\tno",)], "v string").write.text(path)
    assert [(r["c0"], r["c7"]) for r in FS.scan_corpus(spark, path).collect()] == [("EP1", "the text")]


def test_shared_folder_is_one(spark):
    """Where the session names no folder, it gets one, the same at each call."""
    from lexframe.session import scratch_path, shared_dir

    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/x-")


def test_written_xml_is_compressed_and_cut(spark, tmp_path, monkeypatch):
    """Every record comes back from files of a bounded number of records, which are far smaller than their tags."""
    import os

    from lexframe.sources import files as FS

    monkeypatch.setattr(FS, "XML_RECORDS", 400)
    d = spark.range(0, 1000, 1, 1).selectExpr("id AS _id", "array('A & B <C>', cast(id AS string)) AS `ep-board-of-appeal-code`")
    FS.write_xml(d, str(tmp_path / "x"), "rec", "recs")
    sizes = [os.path.getsize(tmp_path / "x" / f) for f in os.listdir(tmp_path / "x") if f.startswith("part-")]
    assert len(sizes) == 3 and sum(sizes) < 30_000
    got = FS.read_xml(spark, str(tmp_path / "x"), "rec", d.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()))
