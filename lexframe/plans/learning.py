"""Learning and evaluation jobs. Text cases are ``documents``
joined to ``labels`` (quality is the label); temporal cases are ``orders``.
Results are rows (rows-only check), except the per-dimension scaling and
the linear term contributions, which have SQL oracles."""

from __future__ import annotations

import ast
import json
from datetime import datetime, timezone

from pyspark.ml.feature import StandardScaler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from ..operators import learn as L
from ..operators import sampling as S
from ..operators.features import VOCABULARY_TERMS, mean_arrays, one_hot, tfidf_long
from ..operators.reports import best_per_group, top_k
from ..session import cut_lineage, scratch_path
from ..sources import files as FS
from .catalog import docs, query, t
from .sqlbits import clean_tokens_sql
from .text import word_vectors
from .windows import TEST_YEARS

def text_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with a stratified 80/20 split by label (W7). Labels
    are split on their keys; the texts join the split and are not shuffled
    while the labels are few enough for Spark to broadcast."""
    lab = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    return docs(spark, sf).select("doc_id", "lang", "text").join(S.split_random(lab, "label", "doc_id", 0.2), "doc_id")


LANGS = ["de", "en", "es", "fr"]


def with_aux(df: DataFrame, domain=LANGS) -> tuple[DataFrame, list[str]]:
    """Auxiliary columns: one-hot language over a declared domain, so an
    unknown value is all zeros (P22)."""
    return df.select("*", *one_hot("lang", domain)), [f"lang_{v}" for v in domain]


def parts_of(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = cut_lineage(c)
    return c.filter(F.col("split") == "train"), c.filter(F.col("split") == "test")


NGRAMS = {"ngram_range": (1, 2), "use_idf": False}


def _fit_eval(spark, sf, algo: str, params: dict, input_representation: str = "TF-IDF", aux: bool = False) -> DataFrame:
    c, extra = with_aux(text_cases(spark, sf))
    train, test = parts_of(c)
    draw = params | ({} if input_representation == "TF-IDF" else NGRAMS)
    pred = L.fit_draw(train, algo, draw, aux=extra if aux else [])(test)
    return L.evaluate(pred).select(
        F.lit(algo).alias("algo"), F.lit(input_representation).alias("input_representation"),
        F.lit(train.count()).alias("train_size"), F.lit(test.count()).alias("test_size"),
        *[F.round(x, 6).alias(x) for x in L.SCORES])


@query("fit_linear_svc")
def fit_linear_svc(spark, sf):
    return _fit_eval(spark, sf, "LinearSVC", {"C": 1})


@query("fit_logistic")
def fit_logistic(spark, sf):
    """Text and one-hot language together."""
    return _fit_eval(spark, sf, "LogisticRegression", {"C": 10, "penalty": "l2", "max_iter": 100}, aux=True)


@query("fit_random_forest")
def fit_random_forest(spark, sf):
    return _fit_eval(spark, sf, "RandomForest", {"n_estimators": 100, "max_features": "sqrt", "max_depth": 30}, "N-Grams")


@query("fit_gbt")
def fit_gbt(spark, sf):
    return _fit_eval(spark, sf, "GradientBoosting", {"n_estimators": 100, "learning_rate": 0.1, "gamma": 0,
                                                     "max_depth": 3}, "N-Grams")


def record(metrics: DataFrame, mode: str, algo: str, params: dict, experiment: str, case_mode: str, representation: str,
           train_years: str, test_year: str, train_size: int, test_size: int, opposition: bool = False) -> DataFrame:
    """The 17-field evaluation record."""
    texts = {k: F.lit(v) for k, v in (
        ("mode", mode), ("algo", algo), ("experiment", experiment), ("case_mode", case_mode),
        ("dataset_label", f"{case_mode}_{experiment}"), ("input_representation", representation), ("embedding", "none"),
        ("model_name", algo), ("train_years", train_years), ("test_year", test_year))}
    pairs = [F.lit(x) for k, v in sorted(params.items()) for x in (k, str(v))]
    history = F.array().cast("array<struct<epoch:int,loss:double>>")
    return metrics.select(
        F.current_timestamp().cast("string").alias("timestamp_utc"), *[c.alias(k) for k, c in texts.items()],
        F.lit(opposition).alias("opposition"), F.lit(None).cast("bigint").alias("max_context_length"),
        F.lit(train_size).cast("bigint").alias("train_size"), F.lit(test_size).cast("bigint").alias("test_size"),
        F.create_map(*pairs).alias("params"), history.alias("epoch_history"),
        F.struct("accuracy", "f1", "precision", "recall", "mcc", "auc").alias("test_metrics"))


@query("evaluate_model")
def evaluate_model(spark, sf):
    """Full-test evaluation record (M12/M13): fit on train, score test."""
    c, extra = with_aux(text_cases(spark, sf))
    train, test = parts_of(c)
    draw = {"C": 1, "penalty": "l2", "max_iter": 250, "ngram_range": (1, 1), "min_df": 2, "norm": "l2"}
    m = L.evaluate(L.fit_draw(train, "LogisticRegression", draw, aux=extra)(test))
    return record(m, "full_test_ml", "LogisticRegression", draw, "1", "pf", "TF-IDF", "all", "all", train.count(),
                  test.count())


@query("standard_scale", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
s AS (SELECT dim, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY dim)
SELECT vec_id, CAST(x.dim AS INTEGER) AS dim, round(CASE WHEN sd > 0 THEN (v - mu) / sd ELSE 0 END, 6) AS value
FROM x JOIN s ON x.dim = s.dim
""")
def standard_scale(spark, sf):
    """M5 per dimension: (x - mean) / population std, from one grouped
    aggregation (one row per dimension) joined back."""
    e = t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    e = e.withColumn("v", F.col("v").cast("double"))
    s = e.groupBy("dim").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    j = e.join(F.broadcast(s), "dim")  # one row per dimension
    val = F.when(F.col("sd") > 0, (F.col("v") - F.col("mu")) / F.col("sd")).otherwise(F.lit(0.0))
    return j.select("vec_id", F.col("dim").cast("int").alias("dim"), F.round(val, 6).alias("value"))


PUBLISHED_DRAWS = 50    # a classifier; random_search and temporal_search make as many


def search_grid(algo: str, representation: str = "TF-IDF") -> dict:
    return L.GRIDS[algo] | L.TEXT_GRID | L.REPRESENTATIONS[representation]


def search_records(spark, sf, draws: int, folds: int = 3, seed: int = 42, representation: str = "TF-IDF",
                   algo: str = "LogisticRegression") -> tuple[DataFrame, DataFrame, list[dict], DataFrame]:
    """(train, test, draws, scores) of a random search over text and classifier
    parameters on the training split; the test split is returned unread."""
    train, test = parts_of(text_cases(spark, sf))
    train = cut_lineage(S.stratified_folds(train, "label", "doc_id", folds))
    some = L.sample_grid(search_grid(algo, representation), draws, seed)
    return train, test, some, L.cross_validate(train, lambda d: L.stratified_parts(d, folds), algo, some, "doc_id")


@query("random_search")
def random_search(spark, sf):
    """M6: seeded draws of text and classifier parameters, 3 stratified
    folds with the features fitted in each, six scores, refit on the best F1;
    the test split is read for the refitted model alone."""
    train, test, some, scores = search_records(spark, sf, PUBLISHED_DRAWS)
    scores = cut_lineage(scores)
    best, cv = L.best_draw(scores)
    m = L.evaluate(L.fit_draw(train, "LogisticRegression", some[best])(test))
    params = F.create_map(*[F.lit(x) for k, v in sorted(some[best].items()) for x in (k, str(v))])
    return m.select(F.lit("LogisticRegression").alias("algo"), F.lit(scores.count()).alias("draws"),
                    params.alias("best_params"), *[F.lit(round(v, 6)).alias(f"cv_{k}") for k, v in cv.items()],
                    *[F.round(x, 6).alias(x) for x in L.SCORES])


def dated_cases(spark, sf) -> DataFrame:
    """Labelled documents with a date: that of the order with the document's
    number."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderdate").alias("date"))
    lab = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")).join(o, "doc_id")
    return docs(spark, sf).select("doc_id", "lang", "text").join(lab.withColumn("year", F.year("date")), "doc_id")


@query("temporal_search")
def temporal_search(spark, sf):
    """Experiment 2's search over n-grams: expanding folds in date order
    on the rows before the cut year, scores of every draw."""
    train = cut_lineage(dated_cases(spark, sf).filter(F.col("year") < 2000))
    folds = cut_lineage(S.timeseries_folds(train, [F.col("date").asc_nulls_last(), F.col("doc_id").asc()], 3))
    some = L.sample_grid(search_grid("LogisticRegression", "N-Grams"), PUBLISHED_DRAWS)
    scores = L.cross_validate(folds, lambda d: L.expanding_parts(d, 3), "LogisticRegression", some, "doc_id")
    return scores.select("draw", *[F.round(x, 6).alias(x) for x in L.SCORES])


def doc_vectors(spark, sf) -> DataFrame:
    """Mean word vector per labelled document; none known -> zeros. Texts
    become tokens where they are read, while the labels are few enough to
    broadcast; the vectors are written once."""
    lab = t(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    has = lab.select("doc_id")
    has = F.broadcast(has) if has.count() <= VOCABULARY_TERMS else has
    toks = docs(spark, sf).join(has, "doc_id", "left_semi").select(
        "doc_id", TX.explode_tokens(TX.clean_tokens(F.col("text"))).alias("term"))
    toks = toks.filter(F.col("term").isNotNull())
    v = mean_arrays(toks, "doc_id", word_vectors(spark, sf), "word", "embedding").withColumnRenamed("mean", "vec")
    base = docs(spark, sf).select("doc_id", "lang").join(lab, "doc_id")
    j = base.join(v, "doc_id", "left")
    width = t(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0] or 1
    return cut_lineage(j.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), width))))


@query("fit_embedding")
def fit_embedding(spark, sf):
    """M8: document embeddings -> standardise -> logistic regression."""
    train, test = parts_of(S.split_random(doc_vectors(spark, sf), "label", "doc_id", 0.2).withColumn(
        "raw", array_to_vector("vec")))
    sc = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(train)
    rows = sc.transform(train).persist()
    model = L.estimator("LogisticRegression", {"C": 1, "penalty": "l2", "max_iter": 100}, rows.count()).fit(rows)
    rows.unpersist()
    m = L.evaluate(model.transform(sc.transform(test)))
    return m.select(F.lit("LogisticRegression").alias("algo"), F.lit("word2vec").alias("embedding"), "f1", "mcc", "auc")


@query("fused_classifier")
def fused_classifier(spark, sf):
    """M16 re-aimed: precomputed document embedding + one-hot language over
    the declared domain (unknown -> all zeros) -> hidden layer of 256 -> 2
    outputs."""
    c, extra = with_aux(S.split_random(doc_vectors(spark, sf), "label", "doc_id", 0.2))
    train, test = parts_of(c.withColumn("emb", array_to_vector("vec")))
    size = train.select(F.max(F.size("vec"))).first()[0] or 1
    hint = VectorSizeHint(inputCol="emb", size=size, handleInvalid="error")
    prep = lambda df: L.assemble(hint.transform(df), ["emb", *extra])
    rows = prep(train).persist()
    width = size + len(extra)
    model = L.estimator("MLP", {"layers": [width, 256, 2], "max_iter": 100}, 0).fit(rows)
    rows.unpersist()
    m = L.evaluate(model.transform(prep(test)))
    return m.select(F.lit("MLP").alias("algo"), F.lit(width).alias("input_width"), "f1", "mcc", "auc")


@query("feature_importance")
def feature_importance(spark, sf):
    """M17 re-aimed: forest feature importances, the top 20 terms. Every term
    of the vocabulary is a feature of its own; beyond TREE_FEATURES terms the
    least number of documents a term needs is doubled until they fit."""
    train, _ = parts_of(text_cases(spark, sf))
    terms = cut_lineage(train.select("label", TX.clean_tokens(F.col("text")).alias("tokens")))
    least = 5
    while (known := L.vocabulary(terms, "tokens", least, L.TREE_FEATURES)) is None:
        least *= 2
    feats = L.text_features(terms, "tokens", "features", min_df=least, use_idf=False, features=L.TREE_FEATURES)
    parts = L.train_partitions(terms.count(), spark.sparkContext.defaultParallelism, True)
    rows = L.unnamed(feats.transform(terms).select("features", "label"), "features", len(known))
    rows = cut_lineage(L.spread(rows, parts) if parts > 1 else rows)
    model = L.estimator("RandomForest", {"n_estimators": 100, "max_features": "sqrt", "max_depth": 10}, 0).fit(rows)
    imp = model.featureImportances  # one weight for each of TREE_FEATURES terms at most
    top = sorted(zip([known[i] for i in imp.indices.tolist()], imp.values.tolist()), key=lambda p: (-p[1], p[0]))[:20]
    return top_k(spark.createDataFrame(top, "term string, importance double"),
                 [F.col("importance").desc(), F.col("term").asc()], 20)


@query("term_contributions", lambda: f"""
WITH docs AS (SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
toks AS (SELECT doc_id, unnest({clean_tokens_sql('text')}) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 5),
n AS (SELECT count(*) AS n FROM docs),
w AS (SELECT tf.doc_id, tf.term, tf.tf * (ln((1.0 + n.n) / (1.0 + df.df)) + 1.0) AS w FROM tf JOIN df ON tf.term = df.term CROSS JOIN n),
wn AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w),
cls AS (SELECT t.term, count(DISTINCT t.doc_id) FILTER (WHERE d.quality = 1) AS p, count(DISTINCT t.doc_id) FILTER (WHERE d.quality = 0) AS q
        FROM toks t JOIN docs d ON t.doc_id = d.doc_id GROUP BY t.term),
np AS (SELECT count(*) FILTER (WHERE quality = 1) AS np, count(*) FILTER (WHERE quality = 0) AS nq FROM docs),
coef AS (SELECT term, ln((p + 1.0) / (np + 2.0)) - ln((q + 1.0) / (nq + 2.0)) AS coef FROM cls CROSS JOIN np),
c AS (SELECT wn.doc_id, wn.term, wn.weight * coef.coef AS contribution FROM wn JOIN coef ON wn.term = coef.term)
SELECT doc_id, term, CAST(round(contribution, 6) AS DOUBLE) AS contribution FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(round(contribution, 9)) DESC, term) AS rn FROM c) WHERE rn <= 5
""")
def term_contributions(spark, sf):
    """M18 re-aimed: a linear model's per-term contributions coef * x, the
    top 5 per document by magnitude. The model is the closed-form
    log-count-ratio (naive Bayes) model, so the contributions are exact."""
    lab = t(spark, sf, "labels").select("doc_id", "quality")
    d = docs(spark, sf).join(lab, "doc_id", "left_semi").select("doc_id", TX.clean_tokens(F.col("text")).alias("tok"))
    d = d.join(lab, "doc_id")
    w = tfidf_long(d, "doc_id", "tok", min_df=5)
    present = d.select("doc_id", "quality", TX.explode_tokens(F.array_distinct("tok")).alias("term"))
    present = present.filter(F.col("term").isNotNull())
    cls = present.groupBy("term").agg(F.count_if(F.col("quality") == 1).alias("p"),
                                      F.count_if(F.col("quality") == 0).alias("q"))
    np_, nq_ = d.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    coef = cls.select("term", (F.log((F.col("p") + 1.0) / F.lit(np_ + 2.0))
                               - F.log((F.col("q") + 1.0) / F.lit(nq_ + 2.0))).alias("coef"))
    c = w.join(coef, "term").select("doc_id", "term", (F.col("weight") * F.col("coef")).alias("contribution"))
    # top-k per document: bounded by one document's distinct terms
    win = Window.partitionBy("doc_id").orderBy(F.abs(F.round("contribution", 9)).desc(), "term")
    top = c.withColumn("rn", F.row_number().over(win)).filter(F.col("rn") <= 5)
    return top.select("doc_id", "term", F.round("contribution", 6).alias("contribution"))


# -- M10 / M14: records -> refit; sliding windows ------------------------------------------
SEARCH_RECORD = T.StructType([
    T.StructField("timestamp_utc", T.StringType()), T.StructField("algo", T.StringType()),
    T.StructField("case_mode", T.StringType()), T.StructField("best_score_cv", T.DoubleType()),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
])


def parsed(params: dict[str, str]) -> dict:
    """A draw from the strings of a stored record."""
    return {k: None if v == "None" else ast.literal_eval(v) if v[:1] in "(-0123456789TF" else v for k, v in params.items()}


RECORD_DRAWS = 10  # of each search that refit_from_record makes for its store


def chosen_record(records: DataFrame) -> DataFrame:
    """A record for each classifier and case mode: the latest, of equally late
    ones the one with the best score (W2)."""
    flat = records.withColumn("best_params", F.to_json("best_params"))  # maps have no order
    late = -F.unix_micros(F.col("timestamp_utc").cast("timestamp"))
    return best_per_group(flat, ["algo", "case_mode"], [late, -F.col("best_score_cv"), F.col("best_params")])


@query("refit_from_record")
def refit_from_record(spark, sf):
    """Two searches (of RECORD_DRAWS draws each, with seeds of their own)
    append their best record to the store; the latest record of the classifier
    and case mode is read back, of equally late ones the best score (W2). Its
    vectoriser and classifier are rebuilt and fitted on the training split. The
    test split is read for that model alone."""
    path = scratch_path(spark, "records")
    for seed in (1, 2):
        train, test, some, scores = search_records(spark, sf, RECORD_DRAWS, folds=2, seed=seed)
        best, cv = L.best_draw(scores)
        now = datetime.now(timezone.utc).isoformat()
        row = (now, "LogisticRegression", "pf", float(cv["f1"]), {k: str(v) for k, v in some[best].items()})
        FS.append_results(spark.createDataFrame([row], SEARCH_RECORD), path)
    best = chosen_record(FS.load_results(spark, path, SEARCH_RECORD)).first()
    params = json.loads(best["best_params"])
    m = L.evaluate(L.fit_draw(train, best["algo"], parsed(params))(test))
    return m.select(F.lit(best["algo"]).alias("algo"), F.lit(params["C"]).alias("C"),
                    F.lit(params["ngram_range"]).alias("ngram_range"),
                    F.lit(round(best["best_score_cv"], 6)).alias("best_score_cv"), "f1", "mcc", "auc")


@query("sliding_window_eval")
def sliding_window_eval(spark, sf):
    """For every test year, train on the text and the auxiliary columns
    of all years before (balanced), test on the year; a full record for every
    window that has both classes to train on. Membership is one explode (J7);
    one distributed fit per window."""
    c, extra = with_aux(dated_cases(spark, sf))
    m = S.window_membership(c.withColumn("label", F.col("label").cast("int")), "year", TEST_YEARS)
    m = cut_lineage(S.balance_windows(S.windows_with_test(m), "label", "doc_id"))
    sizes = {r["test_year"]: r for r in m.groupBy("test_year").agg(  # one row for each window
        F.count_if(F.col("role") == "train").alias("n"), F.count_if(F.col("role") == "test").alias("t"),
        F.count_distinct(F.when(F.col("role") == "train", F.col("label"))).alias("k"), F.min("year").alias("y")).collect()}
    out, draw = None, {"C": 1, "penalty": "l2", "max_iter": 100}
    for year in [y for y in TEST_YEARS if y in sizes and sizes[y]["k"] == 2]:
        w = m.filter(F.col("test_year") == year)
        pred = L.fit_draw(w.filter(F.col("role") == "train"), "LogisticRegression", draw, aux=extra)(
            w.filter(F.col("role") == "test"))
        r = record(L.evaluate(pred), "sliding_window_ml", "LogisticRegression", draw, "2", "pf", "TF-IDF",
                   f"{sizes[year]['y']}-{year - 1}", str(year), sizes[year]["n"], sizes[year]["t"])
        out = r if out is None else out.unionByName(r)
    if out is None:  # the schema of a record, without a row
        none = spark.createDataFrame([], ", ".join(f"{x} double" for x in L.SCORES))
        out = record(none, "", "", draw, "", "", "", "", "", 0, 0)
    return out
