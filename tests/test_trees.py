"""Sparse trees against Spark's and brute force; a vocabulary of any size is exact."""

import numpy as np
import pytest
from lexframe.operators import learn as L
from lexframe.operators import trees as TR
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F


def cases(spark, n=120, words=12, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        counts = rng.poisson(0.8, words)
        y = float(counts[0] > counts[1] or (counts[2] > 1 and rng.random() < 0.8))
        rows.append((i, " ".join(f"w{chr(97 + k)}" for k in range(words) for _ in range(counts[k])), y, int(i % 3 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, label double, x int").repartition(3)


def test_boosting_is_that_of_spark(spark):
    d = cases(spark)
    draw = {"n_estimators": 12, "learning_rate": 0.1, "gamma": 0, "max_depth": 3, "min_df": 1, "use_idf": False, "norm": None}
    got = {r["doc_id"]: r for r in L.fit_draw(d, "GradientBoosting", draw, aux=["x"])(d).collect()}
    cut = d.withColumn("t", L.search_tokens(F.col("text")))
    rows = L.assemble(L.text_features(cut, "t", "v", 1, False, None).transform(cut), ["v", "x"])
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, stepSize=0.1, maxDepth=3, seed=42).fit(rows)
    want = model.transform(rows).select("doc_id", "prediction", "probability").collect()
    assert len(got) == len(want) == 120
    for r in want:
        assert abs(got[r["doc_id"]]["probability"][1] - r["probability"][1]) < 1e-9
        assert got[r["doc_id"]]["prediction"] == r["prediction"]


def test_forest_splits_are_the_best(spark):
    """Both features of two are looked at: every split is the best one of its bootstrap sample."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (40, 2)).astype(float), rng.integers(0, 2, 40).astype(float)
    e = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(40) for j in range(2) if x[i, j]], "__id long, feature int, value double")
    for tree, (feature, threshold, left, right, value) in enumerate(TR.forest(TR.blocks(e, np.arange(40)), y, 2, 5, "sqrt", 4)):
        w = TR.bootstrap(42, tree, 40)

        def check(at, inside):
            n, s = w[inside].sum(), (w * y)[inside].sum()
            assert abs(value[at] - s / n) < 1e-12
            if feature[at] < 0:
                return 1
            gain = lambda f, t: sum((w * y)[m].sum() ** 2 / w[m].sum() for m in (
                inside & (x[:, f] > t), inside & (x[:, f] <= t)) if w[m].sum()) - s * s / n
            assert abs(gain(feature[at], threshold[at]) - max(gain(f, t) for f in range(2) for t in range(5))) < 1e-9
            go = x[:, feature[at]] > threshold[at]
            return check(left[at], inside & ~go) + check(right[at], inside & go)

        assert check(0, w > 0) > 2


def test_forest_predicts(spark):
    d = cases(spark, 200)
    draw = {"n_estimators": 30, "max_features": "sqrt", "max_depth": 30, "min_df": 1, "use_idf": False}
    pred = L.fit_draw(d, "RandomForest", draw)(d)
    assert {"probability", "prediction", "doc_id", "label"} <= set(pred.columns) and pred.count() == 200
    assert pred.filter("label = prediction").count() > 180
    again = {r["doc_id"]: r["probability"][1] for r in L.fit_draw(d, "RandomForest", draw)(d).collect()}
    assert again == {r["doc_id"]: r["probability"][1] for r in pred.collect()}


def test_every_term_is_a_feature_of_its_own(spark, monkeypatch):
    """300,000 terms, more than were hashed before: a model's width is their number."""
    words = spark.range(600).select("id", F.expr("transform(sequence(0, 999), i -> concat('w', (id div 2) * 1000 + i))").alias("t"))
    tf, held = L.count_stage(words, "t", 2)
    assert len(tf.vocabulary) == len(held) == 300_000 and set(held) == {2}
    got = tf.transform(words.filter("id = 7")).first()["__tf"]
    assert got.size == 300_000 and len(got.indices) == 1000 and set(got.values) == {1.0}
    terms = TR.Terms(words.select(F.col("id").alias("__id"), F.col("t").alias("__terms")), 600, 2, False, "l2")
    assert terms.size == 300_000
    e = terms.entries(terms.tf.filter("__id = 7"))
    assert e.select("feature").distinct().count() == 1000 and abs(e.agg(F.sum("value")).first()[0] - 1000 ** 0.5) < 1e-6


def test_labels_are_checked(spark):
    d = spark.createDataFrame([(1, "some text", 1.0), (2, "some more", None)], "doc_id long, text string, label double")
    for algo in ("RandomForest", "GradientBoosting"):
        with pytest.raises(ValueError):
            L.fit_draw(d, algo, {"min_df": 1})
