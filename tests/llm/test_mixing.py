"""The curriculum mix: targets, sums near them, positions on the demand line."""

import random
import re

import awkward
import pytest
from conftest import MEDIUM
from lexframe.llm.mixing import CURRICULUM, Curriculum, demand_time, integral, mix, mix_plan, op1_mixing
from pyspark.sql import functions as F


def water(sizes, weights, total, most):
    """Share by weight, cap, reshare the excess until none is above."""
    target, open_ = {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return target


def check(rows, texts, most=2, share=1.5):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, t, s in texts:
        sums[s] = sums.get(s, 0) + size(t)
    order = sorted(sums, key=lambda s: (s is None, s))
    want = water(sums, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, share * sum(sums.values()), most)
    source = {i: s for i, _, s in texts}
    taken, targets = dict.fromkeys(sums, 0), {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == sums[s] and 0 <= r["taken"] <= most * r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert r["copies"] == len(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
    for s in sums:
        assert targets[s] == pytest.approx(want[s], rel=1e-9)
    return taken, targets


def test_targets_and_sums(spark):
    d = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "source").collect()]
    rows = op1_mixing(spark, MEDIUM).collect()
    assert len(rows) == len(d)
    taken, targets = check(rows, d)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 0.01 * t
    first = [r["positions"][0] for r in rows if r["positions"]]
    assert first == sorted(first)
    again = {r["doc_id"]: r["taken"] for r in op1_mixing(spark, MEDIUM).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_demand_is_met_at_all_times(spark):
    """Up to any time, a source has given what its schedule asks for by then."""
    rng = random.Random(5)
    data = [(i, " ".join("w" * rng.randint(1, 60)), f"s{i % 3}") for i in range(3000)]
    rows = mix_plan(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    target = {f"s{r['doc_id'] % 3}": r["target"] for r in rows}
    for i in range(3):
        knots = CURRICULUM.schedules[i]
        for t in (0.2, 0.5, 0.7):
            given = sum(r["size"] for r in rows if r["doc_id"] % 3 == i for p in r["positions"] if p <= t)
            upto = [k for k in knots if k[0] <= t]
            (a, v), (b, w) = upto[-1], knots[len(upto)]
            asked = (integral(tuple(upto)) + (t - a) * (v + v + (w - v) * (t - a) / (b - a)) / 2) / integral(knots)
            assert given == pytest.approx(asked * target[f"s{i}"], abs=150)


def test_inverse(spark):
    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 4.0), (0.5001, 0.0), (1.0, 0.0))
    at = spark.range(1).select(*[demand_time(F.lit(p), F.lit(0), (knots,)).alias(str(i)) for i, p in
                                 enumerate((0.0, 0.1, 0.5, 0.99, 1.0))]).first()
    assert at[0] == 0 and list(at) == sorted(at) and at[4] <= 0.51


def test_rows_are_mixed_in_order(spark):
    data = [(i, "w " * (1 + i % 5), f"s{i % 2}", i) for i in range(400)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, size long")
    rows = mix(d).collect()
    plan = {r["doc_id"]: r["copies"] for r in mix_plan(d).collect()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v} and rows[0].asDict().keys() == {"doc_id", "text", "source", "size"}


def test_awkward_rows(spark, tmp_path):
    folder = awkward.table(spark, tmp_path)
    rows = op1_mixing(spark, folder).collect()
    assert len(rows) == len(awkward.rows())
    check([r for r in rows if r["doc_id"] is not None and r["doc_id"] != 2], [(r[0], r[1], r[3]) for r in awkward.rows()])
    d = spark.read.parquet(f"{folder}/documents.parquet")
    assert mix(d).columns == d.columns
    assert mix_plan(d.filter(F.lit(False))).count() == 0 and mix(d.filter(F.lit(False))).count() == 0
    assert mix_plan(d, Curriculum((((0.0, 1.0), (1.0, 1.0)),), share=0.5)).count() == len(awkward.rows())
