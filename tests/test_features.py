"""Document vectors: the broadcast and the shuffled form."""

from lexframe.operators import features
from pyspark.sql import functions as F


def test_mean_vectors_shuffle_tokens_alone(spark, monkeypatch):
    tokens = spark.createDataFrame([(i % 7, f"t{i * i % 11}", i) for i in range(80)] + [(None, "t1", 1), (9, "none", 1)],
                                   "doc_id long, term string, n long")
    vectors = spark.createDataFrame([(f"t{i}", [float(i), i / 3, -1.0]) for i in range(9)], "word string, vec array<float>")
    weighted = {"weight": F.length("term") * 0.5, "count": "n"}
    for more in ({}, weighted):
        got = features.mean_vectors(tokens, "doc_id", vectors, "word", "vec", **more)
        # the sums by document need no exchange of their own
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        with monkeypatch.context() as m:
            m.setattr(features, "VECTOR_CELLS", 0)
            rows = features.mean_vectors(tokens, "doc_id", vectors, "word", "vec", **more)
        flat = lambda df: {(r[0], r[1]): round(r[2], 9) for r in df.collect()}
        assert flat(got) == flat(rows) and len(flat(got)) == 8 * 3


def test_terms_are_weighted_where_their_document_is(spark):
    """Only texts and the vocabulary cross a shuffle, no row for each term of a document."""
    from lexframe.plans.text import ngram_tf_l2, tfidf_l2

    for q in (tfidf_l2, ngram_tf_l2):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert shuffles and all("hashpartitioning(doc_id" in x and "term" not in x for x in shuffles)


def test_document_frequencies_by_document(spark):
    """Rows of one key are one document, and so are those without a key."""
    rows = [(1, "a b a"), (1, "b c"), (2, "b"), (None, "a d"), (None, "a"), (3, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for some, want in ((d, {"a": 2, "b": 2, "c": 1, "d": 1}), (d.filter("doc_id > 1"), {"b": 1}), (d.limit(0), {})):
        got = features.counted_documents(some, "doc_id", "text", lambda c: F.expr("filter(split(text, ' '), x -> x <> '')"))
        assert {r["term"]: r["df"] for r in got.collect()} == want


def test_vectors_are_not_sorted_with_their_tokens(spark):
    """Sums of a dimension are hashed: no sort, and one exchange of a row a document and task."""
    from lexframe.plans.text import doc_mean_embedding, doc_vectors_idf

    for q in (doc_mean_embedding, doc_vectors_idf):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "ObjectHashAggregate" not in plan
        shuffles = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
        assert len(shuffles) == 1 and "hashpartitioning(doc_id" in shuffles[0]


def test_short_vectors(spark):
    """Each dimension is the mean of the vectors that have it."""
    tokens = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "z")], "doc_id long, term string")
    vectors = spark.createDataFrame([("x", [1.0, 2.0]), ("y", [3.0]), ("z", None)], "word string, vec array<float>")
    got = features.mean_vectors(tokens, "doc_id", vectors, "word", "vec").collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(1, 0): 2.0, (1, 1): 2.0, (2, 0): 3.0}
