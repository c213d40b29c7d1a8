"""Text and auxiliary features.

Two forms: a long form ``(doc_id, term, weight)`` built with explode +
grouped aggregation (exact, SQL-checkable), and the ML vector form built
with Spark ML stages (CountVectorizer / HashingTF, IDF, Normalizer,
VectorAssembler) for the classifiers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import explode_tokens
from ..session import cut_lineage
from .sampling import global_position

VOCABULARY_TERMS = 500_000  # terms with a number each that are broadcast: some 40 MB
VECTOR_CELLS = 1 << 23  # numbers in all word vectors up to which they are broadcast: 64 MB as doubles


def term_frequencies(df: DataFrame, doc: str, tokens: str) -> DataFrame:
    """(doc, term, tf): one row per distinct term of a document."""
    terms = df.select(doc, explode_tokens(tokens).alias("term")).filter(F.col("term").isNotNull())
    return terms.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(tf: DataFrame, doc: str, min_df: int = 1) -> DataFrame:
    """(term, df, cf) for terms in at least ``min_df`` documents.

    ``df`` counts the documents where the term occurs (``tf > 0``, the same
    number as count(*)): reading ``tf`` keeps this branch's input identical
    to the tf branch after column pruning, so the tokenising scan and its
    shuffle run once and are reused (ReusedExchange) instead of twice."""
    return (tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"), F.sum("tf").alias("cf"))
            .filter(F.col("df") >= min_df))


def tfidf_long(df: DataFrame, doc: str, tokens: str, min_df: int = 1, use_idf: bool = True,
               norm: bool = True) -> DataFrame:
    """T17 long form: weight = tf * (ln((1+n)/(1+df)) + 1), optionally l2
    normalised per document. The l2 norm is a window partitioned by the
    document: bounded by one document's distinct terms."""
    tf = term_frequencies(df, doc, tokens)
    dfreq = cut_lineage(document_frequencies(tf, doc, min_df).select("term", "df"))
    if dfreq.count() <= VOCABULARY_TERMS:  # documents stay where they are, also for the norm
        dfreq = F.broadcast(dfreq)
    n = df.count()  # one scalar: the number of documents
    j = tf.join(dfreq, "term")
    idf = F.log((F.lit(1.0) + F.lit(float(n))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0) if use_idf else F.lit(1.0)
    w = F.col("tf") * idf
    j = j.withColumn("__w", w)
    if norm:
        j = j.withColumn("__w", F.col("__w") / F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy(doc))))
    return j.select(doc, "term", F.col("__w").alias("weight"))


def vocabulary_ids(counted: DataFrame) -> DataFrame:
    """(term, df, term_id) of (term, df): terms by df desc, term asc, numbered
    from 0 by a range-partitioned position (no single-task window)."""
    return global_position(counted, [F.col("df").desc(), F.col("term").asc()], "term_id")


def counted_documents(df: DataFrame, doc: str, text: str, tokens) -> DataFrame:
    """(term, df): in how many documents each term of ``tokens(text column)``
    stands, where rows of one ``doc`` (null is one, too) are one document.

    A document of one row gives its distinct terms where it is read, so what
    crosses the shuffle are each task's terms; only rows whose key repeats are
    dealt by it."""
    d = df.select(doc, text)
    again = cut_lineage(d.groupBy(doc).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col(doc).alias("__again")))
    n = again.count()
    again = F.broadcast(again) if n <= VOCABULARY_TERMS else again
    of = lambda how: d.join(again, F.col(doc).eqNullSafe(F.col("__again")), how) if n else d
    listed = lambda rows: rows.select(doc, explode_tokens(F.array_distinct(tokens(F.col(text)))).alias("term")).filter(
        F.col("term").isNotNull())
    terms = listed(of("left_anti")).select("term")
    if n:
        terms = terms.unionByName(listed(of("left_semi")).distinct().select("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def mean_arrays(tokens_long: DataFrame, doc: str, vectors: DataFrame, word: str, vec: str,
                weight: Column | None = None, count: str | None = None) -> DataFrame:
    """(doc, mean): the (weighted) mean of the vectors of the known tokens of
    each document (T18/T20), an array. Unknown tokens are ignored; a document
    with none is absent (its vector is null).

    ``tokens_long`` has one row per token occurrence (doc, term), or per term
    with their number in column ``count``. ``weight`` is a weight of a term
    (over ``term`` and the columns of either frame). A vector table of
    ``VECTOR_CELLS`` numbers at most (they are counted) is broadcast, so tokens
    become one row of sums a document and task where they are read. The sums
    have a column for each dimension: their rows are of fixed width and are
    hashed, while vectors as values would be sorted, and spilled with each token.
    Beyond ``VECTOR_CELLS`` tokens are counted and joined by a shuffle."""
    vectors = cut_lineage(vectors.withColumnsRenamed({word: "term", vec: "__v"}).filter(F.col("__v").isNotNull()))
    cells, width = vectors.select(F.sum(F.size("__v").cast("bigint")), F.max(F.size("__v"))).first()
    if (cells or 0) <= VECTOR_CELLS:
        vectors = F.broadcast(vectors)
    elif not count:
        tokens_long = tokens_long.groupBy(doc, "term").agg(F.count(F.lit(1)).alias("__c"))
        count = "__c"
    wt = (F.col(count) if count else F.lit(1)) * (weight if weight is not None else F.lit(1.0))
    j = tokens_long.join(vectors, "term").select(doc, wt.cast("double").alias("__wt"), "__v")
    at = [F.get("__v", i).cast("double") for i in range(width or 0)]
    sums = [c for i, v in enumerate(at) for c in (
        F.sum(v * F.col("__wt")).alias(f"__s{i}"), F.sum(F.when(v.isNotNull(), F.col("__wt"))).alias(f"__w{i}"))]
    if not ragged(vectors, width):
        sums = sums[::2] + [F.sum("__wt").alias("__w")]
    total = lambda i: F.col("__w" if len(sums) == len(at) + 1 else f"__w{i}")
    mean = [F.col(f"__s{i}") / total(i) for i in range(width or 0)]
    return j.groupBy(doc).agg(*sums).select(doc, F.array(*mean).cast("array<double>").alias("mean"))


def ragged(vectors: DataFrame, width: int | None) -> bool:
    """Whether vectors (``__v``) are shorter than ``width`` or lack an entry."""
    short = (F.size("__v") < F.lit(width or 0)) | F.exists("__v", lambda x: x.isNull())
    return not vectors.filter(short).isEmpty()


def mean_vectors(tokens_long: DataFrame, doc: str, vectors: DataFrame, word: str, vec: str,
                 weight: Column | None = None, count: str | None = None) -> DataFrame:
    """(doc, dim, value): :func:`mean_arrays` by dimension."""
    mean = mean_arrays(tokens_long, doc, vectors, word, vec, weight, count)
    return mean.select(doc, F.posexplode("mean").alias("dim", "value")).filter(F.col("value").isNotNull())


def one_hot(c: str, domain: Sequence[str], prefix: str | None = None) -> list[Column]:
    """One int column per value of the (training) domain; values
    outside the domain give all zeros, missing domain values give 0."""
    p = prefix or c
    return [(F.col(c) == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in domain]


def binarise(c: str | Column, threshold: float = 0.0) -> Column:
    """1.0 when > threshold."""
    x = F.col(c) if isinstance(c, str) else c
    return (x > threshold).cast("double")
