"""Exact, reproducible sampling and splitting.

Random draws are replaced by a seeded hash order: within a stratum rows are
ranked by ``md5(seed ':' key)`` then key. Counts per stratum are exact and
the same in any engine.

Ranking never puts a whole stratum into one task. :func:`stratified_rank`
buckets rows by a hash prefix, counts rows per (stratum, bucket), turns the
counts into offsets (a small table) and ranks only inside a bucket, so a
stratum holding a third of all rows is spread over 16^k buckets.
:func:`global_position` does the same for a total order over all rows with
a range repartition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SEED = 42


def hash_order(key: str | Column, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(r, cond, how)
    return out.drop(*[f"__r_{k}" for k in keys])


def stratified_rank(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    seed: int = SEED,
    rank_col: str = "rank",
    bucket_chars: int = 4,
) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row inside its stratum,
    in seeded hash order; exact and skew-safe (see module doc)."""
    strata = list(strata)
    d = df.withColumn("__h", hash_order(key, seed)).withColumn("__b", F.substring("__h", 1, bucket_chars))
    counts = d.groupBy(*strata, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*strata, "__b").orderBy("__h", key)
    ranked = d.withColumn("__r", F.row_number().over(inner))
    out = _null_safe_join(ranked, offsets, strata + ["__b"])
    return out.withColumn(rank_col, (F.col("__off") + F.col("__r")).cast("bigint")).drop("__h", "__b", "__r", "__off")


def stratum_counts(df: DataFrame, strata: Sequence[str], name: str = "n") -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias(name))


def take_per_stratum(df: DataFrame, strata: Sequence[str], key: str, quota: DataFrame, quota_col: str,
                     seed: int = SEED) -> DataFrame:
    """Rows whose hash rank is within the per-stratum ``quota`` table."""
    r = stratified_rank(df, strata, key, seed, "__rank")
    j = _null_safe_join(r, quota.select(*strata, quota_col), list(strata))
    return j.filter(F.col("__rank") <= F.col(quota_col)).drop("__rank", quota_col)


# -- W3 -------------------------------------------------------------------
def balanced_sample(df: DataFrame, by: str, label: str, key: str, classes: Sequence[str],
                    seed: int = SEED) -> DataFrame:
    """Per value of ``by``: min(count of each class) rows from every class."""
    d = df.filter(F.col(label).isin(*classes))
    c = stratum_counts(d, [by, label])
    per = c.groupBy(by).agg(F.min("n").alias("__m"), F.count(F.lit(1)).alias("__k"))
    # a stratum missing one class takes nothing
    per = per.withColumn("__q", F.when(F.col("__k") == len(classes), F.col("__m")).otherwise(F.lit(0)))
    quota = c.join(per.select(by, "__q"), by).select(by, label, "__q")
    return take_per_stratum(d, [by, label], key, quota, "__q", seed)


# -- W4 / J2 ---------------------------------------------------------------
def downsample_flag(df: DataFrame, label: str, key: str, pos: str, neg: str, seed: int = SEED,
                    flag: str = "kept", extra_strata: Sequence[str] = ()) -> DataFrame:
    """Mark the rows a majority-class down-sample drops: the ``|n_pos-n_neg|``
    first majority rows in hash order get ``flag = false``. Rows of other
    labels keep ``true``. ``extra_strata`` balances inside each group."""
    strata = list(extra_strata)
    d = df
    c = d.filter(F.col(label).isin(pos, neg)).groupBy(*strata).agg(
        F.count_if(F.col(label) == pos).alias("__p"), F.count_if(F.col(label) == neg).alias("__q"))
    drops = c.select(
        *strata,
        F.when(F.col("__p") > F.col("__q"), F.lit(pos)).otherwise(F.lit(neg)).alias(label),
        F.abs(F.col("__p") - F.col("__q")).alias("__drop"),
    )
    r = stratified_rank(d, strata + [label], key, seed, "__rank")
    j = _null_safe_join(r, drops, strata + [label], "left")
    kept = F.coalesce(F.col("__rank") > F.col("__drop"), F.lit(True))
    return j.withColumn(flag, kept).drop("__rank", "__drop")


def downsample_majority(df: DataFrame, label: str, key: str, pos: str, neg: str, seed: int = SEED):
    """(balanced, dropped) pair as two frames of one lazy plan."""
    f = downsample_flag(df, label, key, pos, neg, seed)
    return f.filter("kept").drop("kept"), f.filter(~F.col("kept")).drop("kept")


# -- W6 --------------------------------------------------------------------
def validation_sample(df: DataFrame, label: str, key: str, n: int, seed: int = SEED) -> DataFrame:
    """``n // 2`` rows per class (fewer, i.e. all, where a class is short)."""
    half = n // 2
    r = stratified_rank(df, [label], key, seed, "__rank")
    return r.filter(F.col("__rank") <= half).drop("__rank")


# -- W7 / W9 ---------------------------------------------------------------
def split_random(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = SEED,
                 split_col: str = "split") -> DataFrame:
    """Stratified split: ``ceil(frac * rows)`` rows are test, shared over the
    classes by :func:`test_quota`; of a class the first hash-ranked rows."""
    r = stratified_rank(df, [label], key, seed, "__rank")
    j = _null_safe_join(r, test_quota(stratum_counts(df, [label], "__n"), label, "__n", test_frac, "__t"), [label])
    return j.withColumn(split_col, F.when(F.col("__rank") <= F.col("__t"), "test").otherwise("train")).drop(
        "__rank", "__n", "__t")


def test_quota(counts: DataFrame, label: str, n: str, test_frac: float, out: str) -> DataFrame:
    """Add ``out`` to a table of class counts: the classes' parts of
    ``ceil(frac * total)`` test rows in proportion to their sizes, rounded by
    largest remainder (of equal ones the smaller label first). The windows
    hold one row for each class."""
    everything = Window.partitionBy()
    total = F.sum(n).over(everything)
    wanted = F.ceil(total * F.lit(test_frac) - F.lit(1e-9))
    c = counts.withColumn("__w", wanted).withColumn("__x", F.col("__w") * F.col(n) / total)
    c = c.withColumn("__f", F.floor(F.col("__x") + F.lit(1e-9)))
    order = Window.orderBy(F.round(F.col("__x") - F.col("__f"), 9).desc(), F.col(label).asc_nulls_last())
    c = c.withColumn("__left", F.col("__w") - F.sum("__f").over(everything))
    extra = (F.row_number().over(order) <= F.col("__left")).cast("bigint")
    return c.withColumn(out, F.col("__f") + extra).drop("__w", "__x", "__f", "__left")


def balanced_split(df: DataFrame, label: str, key: str, pos, neg, test_frac: float = 0.2, seed: int = SEED,
                   split_col: str = "split") -> DataFrame:
    """W4 + W7 in one ranking pass. The majority rows a down-sample drops
    are the first ``n_drop`` of their class in hash order, so inside the
    balanced pool a row's rank is ``rank - n_drop``: of the pool's ``2 m``
    rows (m = minority count) ``ceil(frac * 2 m)`` are test, half of each
    class and an odd one of the smaller label; the dropped rows go to test as
    well."""
    r = stratified_rank(df, [label], key, seed, "__rank")
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    j = _null_safe_join(r, c, [label])
    m = df.agg(F.count_if(F.col(label) == pos).alias("p"), F.count_if(F.col(label) == neg).alias("q")).first()
    minority = min(m["p"], m["q"])
    n_drop = F.col("__n") - F.lit(minority)
    pool = math.ceil(2 * minority * test_frac - 1e-9)
    ntest = F.when(F.col(label) == min(pos, neg), pool - pool // 2).otherwise(pool // 2)
    test = (F.col("__rank") <= n_drop) | (F.col("__rank") - n_drop <= ntest)
    return j.withColumn(split_col, F.when(test, "test").otherwise("train")).drop("__rank", "__n")


# -- W10 / W13 helpers -----------------------------------------------------
def global_position(df: DataFrame, order: Sequence[Column], pos_col: str = "pos") -> DataFrame:
    """0-based position of every row in a total order, computed by range
    partitioning: each task sorts one key range, and the per-partition row
    counts (one row per partition) give the offsets. The numbered rows are
    checkpointed once so ids are stable if tasks are retried."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = (df.repartitionByRange(n, *order).sortWithinPartitions(*order)
         .withColumn("__pid", F.spark_partition_id())
         .withColumn("__mid", F.monotonically_increasing_id()))
    d = cut_lineage(d)
    stats = d.groupBy("__pid").agg(F.min("__mid").alias("__m0"), F.count(F.lit(1)).alias("__c"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("__off", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    # one row per partition: bounded by spark.sql.shuffle.partitions
    out = d.join(F.broadcast(stats.select("__pid", "__m0", "__off")), "__pid")
    return out.withColumn(pos_col, F.col("__off") + F.col("__mid") - F.col("__m0")).drop(
        "__pid", "__mid", "__m0", "__off")


def split_tail(df: DataFrame, date_col: str, key: str, train_frac: float = 0.8,
               split_col: str = "split") -> DataFrame:
    """Order by date (null last) then key; first floor(frac*n) rows train,
    the rest val (W10)."""
    order = [F.col(date_col).asc_nulls_last(), F.col(key).asc()]
    p = global_position(df, order, "__pos")
    n = p.count()  # one scalar, of the checkpointed rows
    cut = int(n * train_frac + 1e-9)
    return p.withColumn(split_col, F.when(F.col("__pos") < cut, "train").otherwise("val")).drop("__pos")


def timeseries_folds(df: DataFrame, order: Sequence[Column], k: int = 3) -> DataFrame:
    """Expanding-window folds (W13): test size n // (k+1); fold i tests the
    positions [n - (k-i)*t, n - (k-i-1)*t) and trains on all before.
    Output: input columns + fold, role (a row appears once per fold it is in)."""
    p = global_position(df, order, "__pos")
    n = p.count()  # one scalar, of the checkpointed rows
    t = n // (k + 1)
    folds = F.array(*[F.lit(i) for i in range(k)])
    start = lambda i: F.lit(n) - (F.lit(k) - i) * t
    member = F.filter(folds, lambda i: F.col("__pos") < start(i) + t)
    ex = p.withColumn("fold", F.explode(member))
    role = F.when(F.col("__pos") < start(F.col("fold")), "train").otherwise("test")
    return ex.withColumn("role", role).drop("__pos")


# -- W12 -------------------------------------------------------------------
def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = SEED,
                     fold_col: str = "fold") -> DataFrame:
    """Per class, hash-ranked rows dealt round-robin into ``k`` folds."""
    r = stratified_rank(df, [label], key, seed, "__rank")
    return r.withColumn(fold_col, ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")


# -- J7 / J8 / W5 / W11 -------------------------------------------------------
def window_membership(df: DataFrame, year_col: str, test_years: Sequence[int]) -> DataFrame:
    """Every row once per sliding window it belongs to: train when
    ``year <= T-1``, test when ``year == T``. The window list is a literal
    array, so this is a per-row explode, no join."""
    wins = F.array(*[F.lit(int(t)) for t in test_years])
    member = F.filter(wins, lambda t: (F.col(year_col) <= t - 1) | (F.col(year_col) == t))
    ex = df.withColumn("test_year", F.explode(member))
    return ex.withColumn("role", F.when(F.col(year_col) == F.col("test_year"), "test").otherwise("train"))


def windows_with_test(member: DataFrame) -> DataFrame:
    """Keep only windows that have at least one test row."""
    has = member.filter(F.col("role") == "test").select("test_year").distinct()
    return member.join(has, "test_year", "left_semi")


def balance_windows(member: DataFrame, label: str, key: str, seed: int = SEED) -> DataFrame:
    """Inside each window's train part, cut both classes to the smaller one;
    a window whose train part lacks a class is left alone (W5)."""
    train = member.filter(F.col("role") == "train")
    c = train.groupBy("test_year").agg(
        F.count_if(F.col(label) == 1).alias("__p"), F.count_if(F.col(label) == 0).alias("__q"))
    quota = c.select("test_year", F.when((F.col("__p") > 0) & (F.col("__q") > 0),
                                         F.least("__p", "__q")).alias("__m"))
    r = stratified_rank(train, ["test_year", label], key, seed, "__rank")
    r = r.join(quota, "test_year")
    kept = r.filter(F.col("__m").isNull() | (F.col("__rank") <= F.col("__m"))).drop("__rank", "__m")
    return kept.unionByName(member.filter(F.col("role") == "test"))


def window_validation(member: DataFrame, year_col: str, date_col: str, key: str,
                      train_frac: float = 0.8) -> DataFrame:
    """Inside each window's train part: rows of the last train year are the
    validation set; a window without such rows uses the ordered tail split
    (W11, falling back to W10) - the tail split runs per window."""
    train = member.filter(F.col("role") == "train")
    has_last = train.groupBy("test_year").agg(F.count_if(F.col(year_col) == F.col("test_year") - 1).alias("__v"))
    t = train.join(has_last, "test_year")
    by_year = t.filter(F.col("__v") > 0).withColumn(
        "role", F.when(F.col(year_col) == F.col("test_year") - 1, "val").otherwise("train")).drop("__v")
    rest = t.filter(F.col("__v") == 0).drop("__v")
    # ordered tail per window: a total order over (window, date, key) by range
    # partitioning, then the position relative to the window's first row
    order = [F.col("test_year").asc(), F.col(date_col).asc_nulls_last(), F.col(key).asc()]
    p = global_position(rest, order, "__p")
    stats = p.groupBy("test_year").agg(F.min("__p").alias("__p0"), F.count(F.lit(1)).alias("__n"))
    tail = p.join(stats, "test_year")
    cut = F.floor(F.col("__n") * F.lit(train_frac) + F.lit(1e-9))
    tail = tail.withColumn("role", F.when(F.col("__p") - F.col("__p0") < cut, "train")
                           .otherwise("val")).drop("__p", "__p0", "__n")
    return by_year.unionByName(tail).unionByName(member.filter(F.col("role") == "test"))

