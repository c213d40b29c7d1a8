"""Split arithmetic from the published sizes and sampling invariants."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexframe.operators import sampling as S


def _cases(spark, n_pos, n_neg):
    return spark.range(n_pos + n_neg).select(F.col("id").alias("key"),
                                             F.when(F.col("id") < n_pos, 1).otherwise(0).alias("label"))


@pytest.mark.parametrize("n_pos,n_neg,train,test", [
    (5013, 3648, 5836, 2825),    # pf, experiment 1
    (7286, 5353, 8564, 4075),    # op, experiment 1
    (10934, 10366, 16585, 4715),  # both, experiment 1: an odd test row
])
def test_published_split_sizes(spark, n_pos, n_neg, train, test):
    s = S.balanced_split(_cases(spark, n_pos, n_neg), "label", "key", 1, 0, 0.2)
    got = dict(s.groupBy("split").count().collect())
    assert (got["train"], got["test"]) == (train, test)
    # balanced train, test holds every dropped majority row
    per = dict(((r.split, r.label), r["count"]) for r in s.groupBy("split", "label").count().collect())
    assert abs(per[("train", 1)] - per[("train", 0)]) <= 1


def test_balanced_split_equals_two_pass(spark):
    c = _cases(spark, 700, 300)
    one = S.balanced_split(c, "label", "key", 1, 0, 0.2)
    f = S.downsample_flag(c, "label", "key", 1, 0)
    kept = S.split_random(f.filter("kept").drop("kept"), "label", "key", 0.2)
    two = kept.unionByName(f.filter(~F.col("kept")).drop("kept").withColumn("split", F.lit("test")))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_stratified_rank_matches_brute_force(spark):
    df = spark.range(5000).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"))
    fast = S.stratified_rank(df, ["g"], "key", rank_col="r", bucket_chars=2)
    w = Window.partitionBy("g").orderBy(S.hash_order("key"), "key")
    slow = df.withColumn("r", F.row_number().over(w))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select("key", "g", "r").collect()))


def test_global_position_is_a_permutation(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v"), F.col("id").alias("key"))
    p = S.global_position(df, [F.col("v").asc(), F.col("key").asc()])
    rows = sorted((r.v, r.key, r.pos) for r in p.collect())
    assert [r[2] for r in rows] == list(range(3000))


def test_split_tail_counts(spark):
    df = spark.range(101).select(F.col("id").alias("key"), F.when(F.col("id") % 10 == 0, None)
                                 .otherwise(F.expr("timestamp_seconds(id)")).alias("d"))
    s = S.split_tail(df, "d", "key", 0.8)
    got = dict(s.groupBy("split").count().collect())
    assert got == {"train": 80, "val": 21}
    # null dates come last
    assert s.filter(F.col("d").isNull() & (F.col("split") == "train")).count() == 0


def test_stratified_folds_balanced(spark):
    f = S.stratified_folds(_cases(spark, 100, 50), "label", "key", 3)
    counts = {(r.label, r.fold): r["count"] for r in f.groupBy("label", "fold").count().collect()}
    assert sorted(counts[(1, k)] for k in range(3)) == [33, 33, 34]
    assert sorted(counts[(0, k)] for k in range(3)) == [16, 17, 17]


def test_timeseries_folds(spark):
    df = spark.range(20).select(F.col("id").alias("key"))
    f = S.timeseries_folds(df, [F.col("key").asc()], 3)
    t = 20 // 4
    for fold in range(3):
        rows = f.filter(F.col("fold") == fold)
        start = 20 - (3 - fold) * t
        assert rows.filter(F.col("role") == "train").count() == start
        assert rows.filter(F.col("role") == "test").count() == t


def test_window_membership_and_balance(spark):
    df = spark.createDataFrame([(i, 2018 + i % 4, i % 3 == 0 and 1 or 0) for i in range(40)],
                               "key long, year int, label int")
    m = S.window_membership(df, "year", [2020, 2021, 2025])
    m = S.windows_with_test(m)
    assert {r.test_year for r in m.select("test_year").distinct().collect()} == {2020, 2021}
    b = S.balance_windows(m, "label", "key")
    for ty in (2020, 2021):
        tr = b.filter((F.col("test_year") == ty) & (F.col("role") == "train"))
        assert tr.filter("label = 1").count() == tr.filter("label = 0").count()
        assert tr.filter(F.col("year") > ty - 1).count() == 0


def test_ceil_rule(spark):
    """The test rows are a ceiling of the total, shared by largest remainder."""
    for sizes, want in (((3648, 3648), (730, 730)), ((10366, 10366), (2074, 2073)), ((7, 2, 1), (2, 0, 0)), ((6, 3, 2), (2, 1, 0))):
        c = spark.createDataFrame(list(enumerate(sizes)), "label int, n long")
        got = tuple(r["t"] for r in S.test_quota(c, "label", "n", 0.2, "t").orderBy("label").collect())
        assert got == want and sum(got) == math.ceil(sum(sizes) * 0.2)


def test_best_per_group_matches_window(spark):
    from lexframe.operators.reports import best_per_group

    rows = [(i % 7, float(i % 5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, score double, id int")
    fast = best_per_group(df, ["g"], [-F.col("score"), F.col("id")])
    w = Window.partitionBy("g").orderBy(F.col("score").desc(), "id")
    slow = df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    assert sorted(map(tuple, fast.select("g", "score", "id").collect())) == sorted(map(tuple, slow.collect()))
