"""Operator 1, mixing: a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral sets
the source's share of the tokens; its running integral, scaled to the tokens
the source gives, is the cumulative demand. The documents of a source, in a
seeded order and repeated as the target asks, lie on that demand line, and the
inverse of the demand at a document's middle is its training position.
Documents are then range-sorted by position.

DataFrame functions only. A source may hold a third of all rows: its running
sums are taken over hash buckets first and inside a bucket second, so no window
ever spans a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read, stored

Knots = tuple[tuple[float, float], ...]


@dataclass(frozen=True)
class Curriculum:
    """``schedules`` are dealt to the sources in code point order, repeating,
    null last. A schedule is piecewise linear: (time, weight) from time 0 to
    1. ``share`` is the mix's size as a part of all tokens; ``most`` caps a
    source's target as a multiple of its tokens."""

    schedules: tuple[Knots, ...]
    share: float = 1.5
    most: int = 2
    buckets: int = 4096     # hash buckets of a source
    mends: int = 3          # documents that may join or leave a source's last pass
    seed: int = 17


#: Production: integrals 5, 2 and 1; the first fades, the second peaks midway, the third grows.
CURRICULUM = Curriculum((((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (0.5, 3.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5))))


def integral(knots: Knots) -> float:
    return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(knots, knots[1:]))


def size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, c: Curriculum) -> DataFrame:
    """``source, source_size, target, _schedule``: one row for each source.

    The tokens are shared by weight. A source whose part exceeds its cap gets
    the cap and the excess is reshared; in order of cap / weight the capped
    sources come first, so the level at which none is above is found in one
    pass of prefix sums. (One row for each source of the mix, as the list of
    schedules has: a configuration, not data.)
    """
    weights = F.array(*[F.lit(integral(s)) for s in c.schedules])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("_schedule", (F.row_number().over(order) - 1) % len(c.schedules))
    s = s.withColumn("_w", F.element_at(weights, F.col("_schedule") + 1))
    s = s.withColumn("_cap", (F.col("source_size") * c.most).cast("double"))
    rise = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(c.share))
    s = s.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # once a source is under its cap, all later ones are, at the same level
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct(
        (F.col("_cap") / F.col("_w")).alias("a"), F.col("_level").alias("l")))).over(everything)["l"]
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))
    return s.select("source", "source_size", target.alias("target"), "_schedule")


def demand_time(part: Column, schedule: Column, schedules: tuple[Knots, ...]) -> Column:
    """The time at which ``part`` (0..1) of a source's tokens has been asked
    for: the inverse of its schedule's running integral."""
    cases = []
    for i, knots in enumerate(schedules):
        whole, done, inverse = integral(knots), 0.0, F.lit(float(knots[-1][0]))
        pieces = []
        for (a, v), (b, w) in zip(knots, knots[1:]):
            area, slope = (b - a) * (v + w) / 2, (w - v) / (b - a)
            rest = part * F.lit(whole) - F.lit(done)
            # v x + slope x^2 / 2 = rest, in the form that is stable for small slopes
            root = F.sqrt(F.greatest(F.lit(v * v) + rest * F.lit(2 * slope), F.lit(0.0)))
            pieces.append((done + area, F.lit(a) + F.coalesce(F.try_divide(rest * F.lit(2.0), F.lit(v) + root), F.lit(0.0)),
                           area))
            done += area
        for upper, time, area in reversed(pieces):
            if area > 0:
                inverse = F.when(part * F.lit(whole) <= F.lit(upper), time).otherwise(inverse)
        cases.append((F.lit(i), F.least(F.greatest(inverse, F.lit(0.0)), F.lit(1.0))))
    out = F.lit(None).cast("double")
    for i, value in reversed(cases):
        out = F.when(schedule == i, value).otherwise(out)
    return out


def plan(sizes: DataFrame, c: Curriculum) -> DataFrame:
    """Per row of ``sizes`` (``_id, _mark, source, size``; rows that agree in
    all four are one document): ``source_size, target, copies, positions``.

    A source gives every document ``floor(target / source_size)`` times, and
    once more those at the head of its seeded order, up to the one whose middle
    lies beyond the rest of the target; :func:`mend` then brings the sum nearer,
    one document at a time. Each pass follows the one before on the demand line.
    """
    keys = ["_id", "_mark", "source", "size"]
    d = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_mass", F.col("_n") * F.col("size"))
    # md5 of the id: an order that any engine can repeat
    d = d.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(c.seed)), F.coalesce(F.col("_id").cast("string"),
                                                                                F.lit("null")))))
    d = d.withColumn("_bucket", F.conv(F.substring("_h", 1, 4), 16, 10).cast("int") % c.buckets)
    targets = stored(source_targets(sizes, c), "mix-targets")
    sums = d.groupBy("source", "_bucket").agg(F.sum("_mass").alias("_in"))
    w = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_bucket", F.coalesce(F.sum("_in").over(w), F.lit(0)).alias("_offset"))
    offsets = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(
        offsets["source"].alias("_source"), F.col("_bucket").alias("_b"), "_offset", "source_size", "target",
        "_schedule")
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "_mark", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("_mass").over(inside), F.lit(0)))
    d = d.join(offsets, d["source"].eqNullSafe(offsets["_source"]) & (d["_bucket"] == offsets["_b"])).drop(
        "_source", "_b")
    d = d.withColumn("_before", F.col("_before") + F.col("_offset"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    d = d.withColumn("_full", full.cast("int"))
    d = d.withColumn("_rest", F.col("target") - F.col("_full") * F.col("source_size"))
    d = stored(d.withColumn("_head", (F.col("_mass") > 0) & (F.col("_before") + F.col("_mass") / 2 <= F.col("_rest"))),
               "mix-order")
    for _ in range(c.mends):
        d = stored(mend(d), "mix-mended")
    d = d.withColumn("copies", F.when(F.col("_mass") > 0, F.col("_full") + F.col("_head").cast("int")).otherwise(F.lit(0)))
    middle = lambda i: F.try_divide(
        F.col("_before") + F.col("_mass") / 2 + i * F.col("source_size"), F.col("target"))
    positions = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: demand_time(
        F.least(middle(i), F.lit(1.0)), F.col("_schedule"), c.schedules))
    return d.select(*keys, "source_size", "target", "copies",
                    F.when(F.col("copies") > 0, positions).otherwise(F.array().cast("array<double>")).alias("positions"))


def mend(d: DataFrame) -> DataFrame:
    """Let one document of each source join or leave its last pass: the one
    after which the source's sum is nearest to its target (of equals the first
    in the seeded order), if that is nearer than before."""
    given = F.coalesce(F.sum(F.when(F.col("_head"), F.col("_mass"))), F.lit(0))
    gaps = d.groupBy("source").agg((F.max("_rest") - given).alias("_gap"))
    gaps = stored(gaps.select(F.col("source").alias("_source"), "_gap"), "mix-gaps")
    near = d.filter("_mass > 0").join(gaps, d["source"].eqNullSafe(gaps["_source"]))
    change = F.when(F.col("_head"), -F.col("_mass")).otherwise(F.col("_mass"))
    near = near.withColumn("_left", F.abs(F.col("_gap") - change)).filter(F.col("_left") < F.abs(F.col("_gap")))
    pick = near.groupBy("source").agg(F.min(F.struct("_left", "_h", "_mark", "size")).alias("_pick"))
    pick = pick.select(F.col("source").alias("_source"), F.col("_pick._h").alias("_ph"),
                       F.col("_pick._mark").alias("_pm"), F.col("_pick.size").alias("_ps"))
    joined = d.join(pick, d["source"].eqNullSafe(pick["_source"]), "left")
    picked = (F.col("_h") == F.col("_ph")) & (F.col("_mark") == F.col("_pm")) & (F.col("size") == F.col("_ps"))
    return joined.withColumn("_head", F.when(F.coalesce(picked, F.lit(False)), ~F.col("_head")).otherwise(F.col("_head"))
                             ).select(*d.columns)


def _sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_mark"),
                       F.col(source).alias("source"), size(F.col(text)).alias("size"))


def mix_plan(docs: DataFrame, c: Curriculum = CURRICULUM, key: str = "doc_id", source: str = "source",
             text: str = "text") -> DataFrame:
    """One row for each row of ``docs``, range-sorted by first position:
    ``key, size, source_size, target, taken, copies, positions``.

    Only ids and sizes are shuffled. A document is taken whole 0, 1 or
    ``most`` times at most, so a source misses its target by less than the
    sizes nearest to the gap allow. Null text: size 0, never taken. Null
    source: a source, the last. Rows alike in key, source and text share their
    positions. Empty table: no rows.
    """
    sizes = stored(_sized(docs, key, source, text), "mix-sizes")
    p = plan(sizes, c)
    p = p.select(*[F.col(k).alias(f"_{k}_p") for k in ("_id", "_mark", "source", "size")], "source_size", "target",
                 "copies", "positions")
    on = [sizes[k].eqNullSafe(p[f"_{k}_p"]) for k in ("_id", "_mark", "source", "size")]
    rows = sizes.join(p, on[0] & on[1] & on[2] & on[3]).withColumn("_first", F.get("positions", F.lit(0)))
    return rows.orderBy(F.col("_first").asc_nulls_last(), "_id", "_mark").select(
        F.col("_id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        "copies", "positions")


def mix(docs: DataFrame, c: Curriculum = CURRICULUM, key: str = "doc_id", source: str = "source",
        text: str = "text") -> DataFrame:
    """The mixed rows themselves: the columns of ``docs``, each row as often
    as it is taken, range-sorted by training position."""
    sizes = stored(_sized(docs, key, source, text), "mix-sizes")
    p = plan(sizes, c).filter("copies > 0").select("_id", "_mark", "source", "size", "positions")
    p = p.select(F.col("_id").alias("_pid"), F.col("_mark").alias("_pmark"), F.col("source").alias("_psource"),
                 "positions")
    marked = docs.withColumn("_mark", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = marked.join(p, marked[key].eqNullSafe(p["_pid"]) & (marked["_mark"] == p["_pmark"])
                       & marked[source].eqNullSafe(p["_psource"]))
    rows = rows.select(*docs.columns, "_mark", F.explode("positions").alias("_position"))
    return rows.orderBy("_position", key, "_mark").select(*docs.columns)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents"))
