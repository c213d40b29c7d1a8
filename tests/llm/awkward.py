"""Small awkward tables that every operator is run on."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators might use themselves
    T.StructField("_key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("digest", T.StringType()),
])
LONG = " ".join(f"word{i % 977} tail{i % 31}," for i in range(30_000))


def rows():
    plain = "The quick brown fox jumps over the lazy dog while seven other animals watch from the old wooden fence. " * 3
    return [
        (1, plain, "en", "a", 10, "k", "s", "d"), (2, plain, "en", "a", 10, "k", "s", "d"),
        (2, plain, "en", "a", 10, "k", "s", "d"), (3, None, None, None, None, None, None, None),
        (4, "", "", "", 0, "", "", ""), (5, "  \n\t ", "de", "b", 5, "k", "s", "d"),
        (None, plain + "an ending", "en", None, 1, None, None, None), (None, None, None, None, None, None, None, None),
        (6, LONG, "fr", "b", 9, "x", "y", "z"), (7, "é ü ñ 漢字 \U0001f600", "xx", "c", 9, "x", "y", "z"),
        (8, "one", "en", "c", 3, "x", "y", "z"), (9, plain.upper(), "en", "c", 3, "x", "y", "z"),
    ]


def table(spark, tmp_path, data=None, name="documents"):
    """Write the rows as a table that queries can read; returns its folder."""
    folder = str(tmp_path / f"in-{name}")
    spark.createDataFrame(rows() if data is None else data, DOCS).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return folder
