"""Classifiers, search and evaluation on Spark ML.

Features: tokens (or n-grams) -> counts of the terms in min_df documents ->
tf * (idf + 1) -> l2 (scikit-style smooth idf with the +1), or the counts alone.
The driver holds models, the vocabulary of a linear model (which has a weight
for each term anyway) and small parameter maps; every fit/transform is a
distributed Spark job. Forests and boosted trees are those of :mod:`trees`.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import cut_lineage, scratch_path
from . import metrics as M
from . import trees as TR

# ---------------------------------------------------------------------------
# Search grids per classifier (scikit-learn names -> values).
# Spark's trees go to depth 30: deeper ones and "no limit" are grown to 30.
# ---------------------------------------------------------------------------
GRIDS = {
    "LinearSVC": {"C": [0.1, 1, 10, 100]},
    "LogisticRegression": {"C": [0.1, 1, 10, 100], "penalty": ["none", "l2"], "max_iter": [100, 250, 500]},
    "RandomForest": {"n_estimators": [100, 200, 300], "max_features": ["sqrt", "log2"], "max_depth": [10, 50, 100, None]},
    "GradientBoosting": {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.02, 0.05, 0.1, 0.2],
                         "gamma": [0, 0.1, 0.2], "max_depth": [3, 6, 9]},
}
# The text side of the same search: every draw takes one value of each.
TEXT_GRID = {
    "stopwords": [True, False], "numbers": [True, False], "lemmatise": [True, False],
    "ngram_range": [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3), (1, 4), (2, 4), (3, 4), (4, 4)],
    "min_df": [2, 5, 10],
}
# What each representation adds: TF-IDF has both fixed, n-grams draw the norm.
REPRESENTATIONS = {"TF-IDF": {"norm": ["l2"], "use_idf": [True]}, "N-Grams": {"norm": [None, "l2"], "use_idf": [False]}}
SHAPE = ("stopwords", "numbers", "lemmatise")  # what a text's tokens depend on
MAX_TREE_DEPTH = 30     # Spark's limit
TOL = 1e-4              # scikit-learn's default stopping tolerance for both linear models
TREE_FEATURES = 1 << 14     # terms of Spark's trees (feature_importance), which keep a bin of every feature for every row
TRAIN_ROWS = 500        # rows that a partition of training rows should have
TRAIN_PARTITIONS = 512  # at most so many partitions of training rows, as every iteration is a job over all of them
LINEAR_ROWS = (2000, 50_000)    # the same of the linear models, whose gradients weigh more than their rows: least and most


def search_tokens(text: Column, stopwords: bool = False, numbers: bool = False, lemmatise: bool = False,
                  ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """The terms of a text under one draw of ``TEXT_GRID``."""
    tokens = TX.clean_tokens(text, stopwords=stopwords, numbers=numbers, lemmatise=lemmatise)
    return tokens if tuple(ngram_range) == (1, 1) else TX.ngrams(tokens, *ngram_range)


def text_features(train: DataFrame, tokens: str, out: str = "text_vec", min_df: int = 2, use_idf: bool = True,
                  norm: str | None = "l2", features: int | None = None) -> PipelineModel:
    """Fit the sparse text featuriser on ``train`` only (no test leakage).

    The vocabulary is exact, whatever its size: every term in at least
    ``min_df`` training documents (a grouped count) has a feature of its own.
    A caller that can take no more than ``features`` terms gets an error beyond."""
    tf, held = count_stage(train, tokens, min_df, features)
    return PipelineModel(stages=[tf, *weight_stages(tf.transform(train), train.count(), held, out, min_df, use_idf, norm)])


SEPARATOR = "\u0001"    # of terms on their way to the JVM; no token has it


def count_stage(train: DataFrame, tokens: str, min_df: int, features: int | None = None):
    """The stage that counts a row's terms (into ``__tf``), and in how many
    rows each term of its exact vocabulary stands."""
    held = document_counts(train, tokens, min_df)
    if features is not None and held.num_rows > features:
        raise ValueError(f"{held.num_rows} terms in {min_df} documents, where {features} are allowed")
    known = held["term"].to_pylist()
    if any(SEPARATOR in term for term in known):
        return CountVectorizerModel.from_vocabulary(known, inputCol=tokens, outputCol="__tf"), held["n"].to_pylist()
    # one string for all terms: from_vocabulary makes a call to the JVM for each (31 s for 200,000)
    terms = train.sparkSession.sparkContext._jvm.java.util.regex.Pattern.compile(SEPARATOR).split(SEPARATOR.join(known), -1)
    tf = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", terms)
    return tf.setInputCol(tokens).setOutputCol("__tf")._set(vocabSize=len(known)), held["n"].to_pylist()


def weight_stages(counted: DataFrame, n_rows: int, held: list[int], out: str, min_df: int, use_idf: bool,
                  norm: str | None) -> list:
    """The stages from ``__tf`` (of ``counted``) to ``out``, by the numbers of
    rows of the vocabulary."""
    n = np.asarray(held, np.float64)
    weight = np.where(n >= min_df, np.log((n_rows + 1.0) / (n + 1.0)) + 1.0 if use_idf else 1.0, 0.0)
    stages = [ElementwiseProduct(scalingVec=Vectors.dense(weight), inputCol="__tf",
                                 outputCol="__w" if norm == "l2" else out)]
    if norm == "l2":
        stages.append(Normalizer(p=2.0, inputCol="__w", outputCol=out))
    return stages


def held_terms(train: DataFrame, tokens: str, min_df: int) -> DataFrame:
    """``term, n``: the terms in at least ``min_df`` rows of ``train`` with the number of rows."""
    terms = train.select(TX.explode_tokens(F.array_distinct(tokens)).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_df)


def document_counts(train: DataFrame, tokens: str, min_df: int) -> pa.Table:
    """:func:`held_terms` on the driver, the commonest first (ties by term).
    Without any term: one that no text has, as a vocabulary is never empty."""
    held = held_terms(train, tokens, min_df).toArrow().sort_by([("n", "descending"), ("term", "ascending")])
    return held if held.num_rows else pa.table({"term": [""], "n": [0]})


def vocabulary(train: DataFrame, tokens: str, min_df: int, most: int) -> list[str] | None:
    """The terms of :func:`document_counts`; null if they are more than ``most``."""
    if held_terms(train, tokens, min_df).limit(most + 1).count() > most:
        return None
    return document_counts(train, tokens, min_df)["term"].to_pylist()


def estimator(algo: str, params: dict, n_train: int, features: str = "features", label: str = "label"):
    """Spark estimator for a scikit-style parameter set (M1-M4)."""
    p = dict(params)
    if algo == "LinearSVC":
        c = float(p.get("C", 1.0))
        return LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (c * max(n_train, 1)), maxIter=100,
                         tol=TOL)
    if algo == "LogisticRegression":
        c = float(p.get("C", 1.0))
        reg = 0.0 if p.get("penalty") == "none" else 1.0 / (c * max(n_train, 1))
        return LogisticRegression(featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=0.0,
                                  maxIter=int(p.get("max_iter", 100)), tol=TOL)
    if algo == "RandomForest":
        depth = tree_depth(p.get("max_depth", MAX_TREE_DEPTH))
        return RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=int(p.get("n_estimators", 100)),
                                      featureSubsetStrategy=p.get("max_features", "sqrt"), maxDepth=depth, seed=42)
    if algo == "GradientBoosting":
        return GBTClassifier(featuresCol=features, labelCol=label, maxIter=int(p.get("n_estimators", 100)),
                             stepSize=float(p.get("learning_rate", 0.1)), minInfoGain=float(p.get("gamma", 0.0)),
                             maxDepth=tree_depth(p.get("max_depth", 3)), seed=42)
    if algo == "MLP":
        return MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=p["layers"],
                                              maxIter=int(p.get("max_iter", 100)), seed=42)
    raise ValueError(algo)


def tree_depth(depth: int | None) -> int:
    return MAX_TREE_DEPTH if depth is None else min(int(depth), MAX_TREE_DEPTH)


def score_column(pred: DataFrame) -> Column:
    """Positive-class score: probability when the model has one, else the
    raw margin (M11)."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    return vector_to_array("rawPrediction")[1]


def evaluate(pred: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, f1, mcc and auc per group (A15+A16)."""
    keys = list(by) or ["__all"]
    p = pred.select(*(by or [F.lit(1).alias("__all")]), F.col(label).cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("pred"), score_column(pred).alias("score"))
    p = cut_lineage(p)  # three jobs read it, and the texts behind it are cut and scored once
    m = M.binary_metrics(p, "label", "pred", keys)
    a = M.roc_auc(p, "label", "score", keys)
    out = m.join(a, keys)
    return out if by else out.drop("__all")


def sample_grid(grid: dict, draws: int, seed: int = 42) -> list[dict]:
    """Seeded random draws (without replacement) from a parameter grid."""
    keys = sorted(grid)
    combos = [dict(zip(keys, v)) for v in itertools.product(*[grid[k] for k in keys])]
    rng = random.Random(seed)
    return combos if draws >= len(combos) else rng.sample(combos, draws)


def stratified_parts(df: DataFrame, k: int, fold_col: str = "fold") -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) of every fold of a frame with a fold column."""
    return [(df.filter(F.col(fold_col) != i), df.filter(F.col(fold_col) == i)) for i in range(k)]


def expanding_parts(folds: DataFrame, k: int) -> list[tuple[DataFrame, DataFrame]]:
    """(train, validation) of every expanding fold: rows ``fold, role`` of
    :func:`sampling.timeseries_folds` (W13)."""
    of = lambda i, r: folds.filter((F.col("fold") == i) & (F.col("role") == r)).drop("fold", "role")
    return [(of(i, "train"), of(i, "test")) for i in range(k)]


TOKENS = "__tokens"     # of a frame whose texts are cut already, for one SHAPE
SCORES = ["accuracy", "precision", "recall", "f1", "mcc", "auc"]


def fit_draw(train: DataFrame, algo: str, draw: dict, text: str = "text", aux: Sequence[str] = (),
             label: str = "label"):
    """Fit one draw (text and classifier parameters) on ``train``; returns a
    function that predicts another frame. Features come from ``train`` only."""
    shape = {k: draw.get(k, False) for k in SHAPE}
    span = tuple(draw.get("ngram_range", (1, 1)))

    def terms(df: DataFrame) -> DataFrame:
        if TOKENS not in df.columns:
            return df.withColumn("__terms", search_tokens(F.col(text), **shape, ngram_range=span))
        return df.withColumn("__terms", F.col(TOKENS) if span == (1, 1) else TX.ngrams(F.col(TOKENS), *span))

    least = int(draw.get("min_df", 2))
    cut = terms(train)
    if algo in ("RandomForest", "GradientBoosting"):
        depth = tree_depth(draw.get("max_depth", 3 if algo == "GradientBoosting" else MAX_TREE_DEPTH))
        predict = TR.fit(cut, algo, draw, list(aux), label, least, draw.get("use_idf", True), draw.get("norm", "l2"), depth)
        return lambda df: predict(terms(df))
    tf, held = count_stage(cut, "__terms", least)
    n = train.count()
    parts = train_partitions(n, train.sparkSession.sparkContext.defaultParallelism, False)
    counted = tf.transform(cut).select("__tf", *aux, label).coalesce(parts)
    weigh = weight_stages(counted, n, held, "__text", least, draw.get("use_idf", True), draw.get("norm", "l2"))
    ready = lambda df: unnamed(assemble(PipelineModel(stages=weigh).transform(
        unnamed(df, "__tf", len(held))), ["__text", *aux]), "features", len(held) + len(aux))
    # without their lineage: every task of every iteration would carry its stages, vocabulary and weights included
    rows = cut_lineage(ready(counted).select("features", label))
    model = estimator(algo, draw, n, "features", label).fit(rows)
    prep = lambda df: ready(tf.transform(terms(df)))
    return lambda df: model.transform(prep(df))


def spread(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` in ``parts`` partitions, shuffled where they are fewer: the tree
    ensembles keep a bin of every feature for every row (64 kB a row of
    ``TREE_FEATURES``), and a task reads those of its whole partition."""
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows.coalesce(parts)


def unnamed(df: DataFrame, c: str, size: int) -> DataFrame:
    """Vector column ``c`` with its size alone as metadata. The stages name
    every feature there, and all tasks carry the names (0.7 s a task for
    190,000)."""
    return df.withColumn(c, F.col(c).alias(c, metadata={"ml_attr": {"num_attrs": size}}))


def train_partitions(n: int, cores: int, trees: bool) -> int:
    """In how many partitions ``n`` training rows are kept. Each sends a
    gradient of a number for each term an iteration, so the linear models take no
    more than there are cores while that leaves them bounded in rows."""
    if trees:
        return min(TRAIN_PARTITIONS, n // TRAIN_ROWS + 1)
    few, many = LINEAR_ROWS
    return min(TRAIN_PARTITIONS, n // few + 1, max(cores, n // many + 1))


def token_store(rows: DataFrame, draws: Sequence[dict], text: str = "text") -> dict[tuple, DataFrame]:
    """``rows`` with ``TOKENS`` in place of the text, written once for every
    SHAPE that the draws have (eight at most): all draws of a shape, all folds
    and all n-gram orders read the same tokens."""
    out = {}
    for shape in sorted({tuple(d.get(k, False) for k in SHAPE) for d in draws}):
        path = scratch_path(rows.sparkSession, "tokens")
        cut = rows.withColumn(TOKENS, search_tokens(F.col(text), **dict(zip(SHAPE, shape)))).drop(text)
        cut.write.parquet(path)
        out[shape] = rows.sparkSession.read.schema(cut.schema).parquet(path)
    return out


def cross_validate(rows: DataFrame, split, algo: str, draws: Sequence[dict], key: str, text: str = "text",
                   aux: Sequence[str] = (), label: str = "label", parallelism: int = 8) -> DataFrame:
    """Random search (M6): every draw on every fold, the features fitted anew
    in each. ``split`` gives the (train, validation) frames of ``rows``.
    Validation predictions are written, and one grouped job scores all of them:
    ``draw`` and the mean over the folds of ``SCORES``."""
    spark = rows.sparkSession
    path = scratch_path(spark, "search")
    parts = {shape: split(cut) for shape, cut in token_store(rows, draws, text).items()}
    folds = len(next(iter(parts.values())))

    def one(job: tuple[int, int]) -> None:
        d, f = job
        train, val = parts[tuple(draws[d].get(k, False) for k in SHAPE)][f]
        pred = fit_draw(train, algo, draws[d], text, aux, label)(val)
        # a folder for each job: concurrent jobs share no commit folder
        pred.select(F.col(key).cast("string").alias("key"), F.col(label).cast("int").alias("label"),
                    F.col("prediction").cast("int").alias("pred"), score_column(pred).alias("score")).write.parquet(
                        f"{path}/draw={d}/fold={f}")

    with ThreadPool(parallelism) as pool:
        pool.map(one, [(d, f) for d in range(len(draws)) for f in range(folds)], chunksize=1)
    p = spark.read.parquet(path)
    m = M.binary_metrics(p, "label", "pred", ["draw", "fold"]).join(M.roc_auc(p, "label", "score", ["draw", "fold"]),
                                                                   ["draw", "fold"])
    return m.groupBy("draw").agg(*[F.avg(s).alias(s) for s in SCORES])


def best_draw(scores: DataFrame, by: str = "f1") -> tuple[int, dict]:
    """The draw with the best mean score (the first of equal ones), with its
    scores. One row reaches the driver."""
    best = scores.orderBy(F.col(by).desc(), "draw").limit(1).first()
    return best["draw"], {s: best[s] for s in SCORES}


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Text vector + auxiliary columns into one feature vector."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)

