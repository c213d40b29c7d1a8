"""The search's parts: exact vocabulary, the grids, stored tokens, the choice of a record."""

from datetime import datetime, timezone

from lexframe.operators import learn as L
from lexframe.plans import learning as P
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F


def test_vocabulary_is_exact(spark):
    # term t{i} stands in i documents, twice in each
    rows = [(j, [f"t{i}" for i in range(1, 31) if j < i] * 2) for j in range(30)] + [(99, None)]
    d = spark.createDataFrame(rows, "id long, tokens array<string>")
    seen = set()
    for least in (2, 5, 10):
        known = L.vocabulary(d, "tokens", least, 1000)
        assert known == [f"t{i}" for i in range(30, least - 1, -1)]
        seen.add(len(known))
        m = L.text_features(d.filter("tokens IS NOT NULL"), "tokens", "v", min_df=least, use_idf=False, norm=None)
        got = m.transform(d.filter("id = 0")).select(vector_to_array("v").alias("v")).first()["v"]
        assert got == [2.0] * len(known)  # every term its own feature
    assert len(seen) == 3 and L.vocabulary(d, "tokens", 2, 28) is None
    assert L.vocabulary(d, "tokens", 31, 10) == [""]


def test_grids_and_draws():
    for algo in L.GRIDS:
        some = L.sample_grid(P.search_grid(algo, "N-Grams"), P.PUBLISHED_DRAWS)
        assert len({repr(sorted(d.items(), key=repr)) for d in some}) == 50
        assert {d["norm"] for d in some} == {None, "l2"} and not any(d["use_idf"] for d in some)
    assert all(d["norm"] == "l2" and d["use_idf"] for d in L.sample_grid(P.search_grid("LinearSVC"), P.PUBLISHED_DRAWS))
    assert [L.tree_depth(x) for x in (10, 50, 100, None)] == [10, 30, 30, 30]


def test_search_on_stored_tokens(spark):
    """All draws are scored, and the token store holds the shapes that they have."""
    d = spark.createDataFrame([(i, f"the plain word{i % 2} number {i} of {i % 7} words", float(i % 2), i % 2) for i in range(60)],
                              "doc_id long, text string, label double, fold int").withColumn("fold", F.col("doc_id") % 4 >= 2)
    d = d.withColumn("fold", F.col("fold").cast("int"))
    draws = [{"stopwords": s, "numbers": n, "ngram_range": r, "min_df": 2, "C": 1} for s, n, r in
             ((False, False, (1, 1)), (True, True, (1, 1)), (True, True, (1, 2)))]
    store = L.token_store(d, draws)
    assert set(store) == {(False, False, False), (True, True, False)}
    for shape, cut in store.items():
        want = d.select("doc_id", L.search_tokens(F.col("text"), *shape).alias("t")).collect()
        assert {r["doc_id"]: r[L.TOKENS] for r in cut.collect()} == {r["doc_id"]: r["t"] for r in want}
    scores = L.cross_validate(d, lambda x: L.stratified_parts(x, 2), "LogisticRegression", draws, "doc_id").collect()
    assert sorted(r["draw"] for r in scores) == [0, 1, 2] and all(0 <= r["f1"] <= 1 for r in scores)


def test_latest_record_then_score(spark):
    at = lambda h: datetime(2024, 1, 1, h, tzinfo=timezone.utc).isoformat()
    rows = [(at(1), "A", "pf", 0.9, {"C": "1"}), (at(2), "A", "pf", 0.2, {"C": "2"}), (at(2), "A", "pf", 0.3, {"C": "3"}),
            (at(1), "B", "pf", 0.1, {"C": "4"})]
    got = P.chosen_record(spark.createDataFrame(rows, P.SEARCH_RECORD)).collect()
    assert {(r["algo"], r["best_params"]) for r in got} == {("A", '{"C":"3"}'), ("B", '{"C":"4"}')}


def test_weights_are_those_of_idf(spark):
    """Counts by an exact vocabulary give the weights of Spark's IDF, without a pass of its own."""
    from pyspark.ml.feature import IDF

    d = spark.createDataFrame([(i, ["a"] * (i + 1) + ["b"] * (i % 2) + ["c c"] * (i == 3)) for i in range(6)], "id long, t array<string>")
    tf, held = L.count_stage(d, "t", 1, 10)
    counted = tf.transform(d)
    assert tf.vocabulary == ["a", "b", "c c"] and held == [6, 3, 1]
    want = IDF(inputCol="__tf", outputCol="x", minDocFreq=2).fit(counted).idf.toArray()
    for use in (True, False):
        got = L.weight_stages(counted, 6, held, "v", 2, use, None)[0].getScalingVec().toArray()
        assert [round(x, 12) for x in got] == [round(v + 1.0, 12) if use else 1.0 for v in want[:2]] + [0.0]


def test_training_rows_carry_no_names(spark, monkeypatch):
    """An iteration's tasks hold neither the feature names nor the stages behind the rows."""
    seen, real = {}, L.estimator

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def fit(self, rows):
            seen["meta"] = rows.schema["features"].metadata
            seen["plan"] = rows._jdf.queryExecution().optimizedPlan().toString()
            return self.inner.fit(rows)

    monkeypatch.setattr(L, "estimator", lambda *a, **k: Spy(real(*a, **k)))
    d = spark.createDataFrame([(i, f"plain {'alpha' if i % 2 else 'beta'} text", float(i % 2), 1) for i in range(20)], "doc_id long, text string, label double, x int")
    pred = L.fit_draw(d, "LogisticRegression", {"C": 1, "min_df": 1}, aux=["x"])(d)
    assert seen["meta"] == {"ml_attr": {"num_attrs": 5}} and "UDF" not in seen["plan"]
    assert pred.filter("label = prediction").count() == 20


def test_training_partitions():
    assert [L.train_partitions(n, 12, False) for n in (100, 16_000, 160_000, 1_000_000, 10 ** 9)] == [1, 9, 12, 21, 512]
    assert L.train_partitions(16_000, 12, True) == 33


def test_tree_rows_are_spread(spark):
    """Few large partitions of training rows are dealt anew, and small tables stay as they are."""
    few = spark.range(0, 3000, 1, 2)
    parts = L.train_partitions(3000, 4, True)
    sizes = L.spread(few, parts).groupBy(F.spark_partition_id()).count().collect()
    assert parts == 7 and len(sizes) == 7 and max(r["count"] for r in sizes) < 2 * 3000 / 7
    assert L.spread(few, 1).rdd.getNumPartitions() == 1


def test_feature_importance_deals_its_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "spread", lambda rows, parts: seen.append(parts) or rows.repartition(parts))
    monkeypatch.setattr(L, "TRAIN_ROWS", 10)
    assert P.feature_importance(spark, "/root/testdata/sf0.001").count() <= 20 and seen and seen[0] > 1


def searched(spark, monkeypatch, name):
    """The draws that a query hands to the search."""
    class Seen(Exception):
        pass

    def stop(rows, split, algo, draws, *a, **k):
        raise Seen(draws)

    monkeypatch.setattr(L, "cross_validate", stop)
    try:
        getattr(P, name)(spark, "/root/testdata/sf0.001")
    except Seen as e:
        return e.args[0]


def test_random_search_makes_all_draws(spark, monkeypatch):
    draws = searched(spark, monkeypatch, "random_search")
    assert len({repr(sorted(d.items(), key=repr)) for d in draws}) == P.PUBLISHED_DRAWS == 50


def test_temporal_search_makes_all_draws(spark, monkeypatch):
    draws = searched(spark, monkeypatch, "temporal_search")
    assert len({repr(sorted(d.items(), key=repr)) for d in draws}) == 50 and {d["norm"] for d in draws} == {None, "l2"}
