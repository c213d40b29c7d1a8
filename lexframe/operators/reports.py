"""Descriptive tables: counts, crosstabs, pivots, modes, best-of (A1-A21,
K1-K3, U1-U2). All are grouped aggregations with map-side combine; pivots
take an explicit value list so their schema never depends on the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, c: str | Column, name: str = "value") -> DataFrame:
    """A1/A4: count per value (nulls excluded, as pandas does)."""
    x = F.col(c) if isinstance(c, str) else c
    return df.where(x.isNotNull()).groupBy(x.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(df: DataFrame, c: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A2: total, known (not the last value) and one count per value."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.count_if(F.col(c) == v).alias(f"n_{v.lower().replace(' ', '_')}") for v in values]
    return df.groupBy(*by).agg(*aggs)


def explode_counts(df: DataFrame, arr: str, name: str = "item") -> DataFrame:
    """A5: explode a list, count items."""
    return df.select(F.explode(arr).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def combination_counts(df: DataFrame, arr: str, sep: str = " + ") -> DataFrame:
    """Count of each sorted list (as a joined string)."""
    k = F.array_join(F.array_sort(F.col(arr)), sep)
    return df.groupBy(k.alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str]) -> DataFrame:
    """Counts rows x an explicit list of column values, 0-filled."""
    p = df.groupBy(rows).pivot(cols, list(values)).agg(F.count(F.lit(1)))
    return p.select(rows, *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in values])


def row_percent(ct: DataFrame, rows: str, values: Sequence[str], digits: int = 4,
                keep_counts: bool = False) -> DataFrame:
    """Each cell as a percentage of its row total (one projection over
    the crosstab, optionally keeping the counts)."""
    total = sum((F.col(v) for v in values), F.lit(0))
    return ct.select(rows, *(list(values) if keep_counts else []), *[
        F.round(F.col(v) * 100.0 / F.nullif(total, F.lit(0)), digits).alias(f"pct_{v}") for v in values
    ], total.alias("total"))


def mode_value(df: DataFrame, c: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per group; ties -> smallest value."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count(F.lit(1)).alias("__n"))
    # one row per distinct value: reduce by min over (-count, value); no
    # window over rows
    best = counts.groupBy(*by).agg(F.min(F.struct((-F.col("__n")).alias("__k"), F.col(c))).alias("__m"))
    return best.select(*by, F.col(f"__m.{c}").alias("mode"), (-F.col("__m.__k")).alias("n"))


def best_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per group under ascending ``order`` (pass
    ``-score`` for "highest first"), via min over a struct that sorts like
    ``order``: map-side partial aggregation, so a hot group is never
    gathered in one task."""
    keys = [F.col(f"__k{i}") for i in range(len(order))]
    d = df.select("*", *[o.alias(f"__k{i}") for i, o in enumerate(order)])
    row = F.struct(*keys, *[F.col(c) for c in df.columns if c not in by])
    g = d.groupBy(*by).agg(F.min(row).alias("__m"))
    return g.select(*by, *[F.col(f"__m.{c}").alias(c) for c in df.columns if c not in by])


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """K2: global top-k (TakeOrderedAndProject: k rows per task, merged)."""
    return df.orderBy(*order).limit(k)
