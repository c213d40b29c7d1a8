"""Operator 3, language identification: Bayesian evidence fusion.

The posterior of a document's language multiplies
* the likelihood of its text under byte-trigram models, one a language, trained
  on all rows by grouped counts;
* the likelihood of the language that its markup declares (a table of what
  pages of each language declare, counted over all rows and smoothed);
* a prior from its address: counts of its host, smoothed towards the counts of
  its address suffix, smoothed towards all rows.
A document is rejected if no candidate language is probable enough, or if it
gives no evidence at all.

The text likelihood is tempered: a text's trigrams depend on each other, so
its mean log-likelihood counts as if it had at most ``TEMPER`` independent
trigrams. A long text outweighs everything else; a short one is decided by what
its page and host say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frugal, join_checked, read, stored, text_bytes

LANGUAGES = ("de", "en", "es", "fr")
BINS = 1 << 15          #: hashed trigrams of a model
TEMPER = 40.0           #: independent trigrams that a long text counts for
HOST_WEIGHT = 20.0      #: rows of a host that weigh as much as its suffix
SUFFIX_WEIGHT = 100.0   #: rows of a suffix that weigh as much as everything
LEAST_PROBABILITY = 0.6 #: posterior from which a language is accepted
_LETTER = np.zeros(256, np.uint8)   # other bytes count as one space
_LETTER[list(range(97, 123))] = np.arange(1, 27)
_LETTER[list(range(65, 91))] = np.arange(1, 27)
_LETTER[128:] = np.arange(27, 155)


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Hashed trigrams of letters; runs of other bytes are one separator, and
    trigrams around it are word starts and ends."""
    c = _LETTER[buf]
    keep = c > 0
    if len(c) > 1:
        keep[1:] |= c[:-1] > 0
    c = c[keep].astype(np.uint32)
    if len(c) < 3:
        return np.empty(0, np.int64)
    h = (c[:-2] * np.uint32(160) + c[1:-1]) * np.uint32(160) + c[2:]
    return ((h * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def train(rows: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log-probabilities, a row for each language: trigram counts of all rows
    by declared language, of which only ``languages`` x ``BINS`` sums reach
    the driver."""
    known = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(known), BINS), np.int64)
        for b in batches:
            buf, off = text_bytes(b.column("text"))
            for k, lang in enumerate(b.column("declared").to_pylist()):
                if lang in known:
                    sums[known[lang]] += np.bincount(trigrams(buf[off[k]: off[k + 1]]), minlength=BINS)
        lang, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(at, pa.int32()),
                                          pa.array(sums[lang, at], pa.int64())], ["lang", "bin", "n"])

    parts = rows.select("declared", "text").mapInArrow(frugal(count), "lang int, bin int, n bigint")
    sums = np.zeros((len(languages), BINS))
    for r in parts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas().itertuples():
        sums[r.lang, r.bin] = r.n
    # towards the mean of all languages, so that a language without rows is neutral
    mean = (sums.sum(axis=0) + 0.5) / (sums.sum() + 0.5 * BINS)
    return np.log((sums + 1000.0 * mean) / (sums.sum(axis=1, keepdims=True) + 1000.0)).astype(np.float32)


def text_likelihoods(model: np.ndarray):
    """An Arrow function: text -> tempered log-likelihood of each language,
    the best being 0; null for a text without a trigram."""
    table = np.ascontiguousarray(model.T)  # a trigram's row holds all languages

    def score(texts: pa.Array) -> pa.Array:
        buf, off = text_bytes(texts)
        out = []
        for k in range(len(off) - 1):
            t = trigrams(buf[off[k]: off[k + 1]])
            if not len(t):
                out.append(None)
                continue
            total = np.zeros(table.shape[1])
            for a in range(0, len(t), 1 << 18):
                total += table[t[a: a + (1 << 18)]].sum(axis=0, dtype=np.float64)
            total *= TEMPER / (TEMPER + len(t))
            out.append((total - total.max()).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return score


def likelihood_column(model: np.ndarray, text: Column) -> Column:
    score = text_likelihoods(model)

    @F.arrow_udf("array<double>")
    def likelihood(texts: pa.Array) -> pa.Array:
        return score(texts)

    return likelihood(text)


def evidence(rows: DataFrame, languages: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Grouped counts of the languages that the texts alone point to: by what
    is declared, and by host with its smoothed prior.

    Returns ``declared, _told`` (log-likelihoods) and ``host, suffix, _prior``
    (log-priors), both arrays over ``languages``.
    """
    n = len(languages)
    best = F.when(F.col("_text").isNotNull(), F.array_position("_text", F.array_max("_text")).cast("int"))
    one = stored(rows.select("host", "suffix", "declared", best.alias("_best")).filter("_best IS NOT NULL").groupBy(
        "host", "suffix", "declared", "_best").agg(F.count(F.lit(1)).alias("n")), "langid-counts")
    of = [F.sum(F.when(F.col("_best") == i + 1, F.col("n")).otherwise(0)) for i in range(n)]
    counts = F.array(*of).cast("array<double>")
    # what each language's pages declare; a declaration never seen tells nothing
    totals = one.agg(counts.alias("c")).first()["c"] or []
    totals = [x or 0.0 for x in totals] or [0.0] * n
    declared = one.filter("declared IS NOT NULL").groupBy("declared").agg(counts.alias("c"))
    told = F.array(*[F.log((F.get("c", F.lit(i)) + 0.5) / F.lit(totals[i] + 1.0)) for i in range(n)])
    declared = declared.select("declared", told.alias("_told"))
    # all -> suffix -> host, each smoothed towards the one before
    everything = [(t + 1.0) / (sum(totals) + n) for t in totals]
    suffix = one.groupBy("suffix").agg(counts.alias("s"))
    size = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    suffix = suffix.select("suffix", F.array(*[
        (F.get("s", F.lit(i)) + SUFFIX_WEIGHT * everything[i]) / (size("s") + SUFFIX_WEIGHT) for i in range(n)]).alias("p"))
    host = one.groupBy("host", "suffix").agg(counts.alias("h"))
    host = host.join(suffix.withColumnRenamed("suffix", "_suffix"), F.col("suffix").eqNullSafe(F.col("_suffix")))
    host = host.select("host", "suffix", F.array(*[F.log(
        (F.get("h", F.lit(i)) + HOST_WEIGHT * F.get("p", F.lit(i))) / (size("h") + HOST_WEIGHT)) for i in range(n)]
    ).alias("_prior"))
    return stored(declared, "langid-declared"), stored(host, "langid-hosts")


def suffix_of(address: Column) -> Column:
    """The last label of an address's host."""
    return F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[^/?#:]*\.)?([^/?#:.]+)", 1))


def identify(docs: DataFrame, declared: Column, host: Column, suffix: Column, text: str = "text",
             languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """``docs`` with ``_lang`` (the most probable language, first in the list
    on a tie; null if there is no evidence), ``_probability`` and
    ``_accepted``.

    Texts are read three times and never shuffled; hosts and declarations are
    joined by broadcast while few, else by a shuffle. Null text: decided by
    declaration and host. Null declaration, host or suffix: no evidence of
    that kind (a null host is one more host). A language that is declared but
    not in ``languages``: counted, so it tells what such pages are. Repeated
    rows: each gets the same answer. Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    base = docs.select(F.col(text).alias("text"), declared.alias("declared"), host.alias("host"), suffix.alias("suffix"))
    model = train(base, languages)
    told, prior = evidence(base.withColumn("_text", likelihood_column(model, F.col("text"))), languages)
    keys = {"_declared": declared, "_host": host, "_suffix": suffix}
    d = docs.withColumns(keys).withColumn("_text", likelihood_column(model, F.col(text)))
    d = join_checked(d, told.withColumnRenamed("declared", "_declared"), ["_declared"], "left")
    d = join_checked(d, prior.withColumnsRenamed({"host": "_host", "suffix": "_suffix"}), ["_host", "_suffix"], "left")
    n = len(languages)
    part = lambda c, i: F.coalesce(F.get(F.col(c), F.lit(i)), F.lit(0.0))
    d = d.withColumn("_log", F.array(*[part("_text", i) + part("_told", i) + part("_prior", i) for i in range(n)]))
    d = d.withColumn("_most", F.array_max("_log"))
    weight = F.aggregate(F.transform("_log", lambda x: F.exp(x - F.col("_most"))), F.lit(0.0), lambda a, x: a + x)
    known = F.col("_text").isNotNull() | F.col("_told").isNotNull() | F.col("_prior").isNotNull()
    d = d.withColumn("_probability", F.when(known, F.lit(1.0) / weight))
    lang = F.get(F.array(*[F.lit(x) for x in languages]), (F.array_position("_log", F.col("_most")) - 1).cast("int"))
    d = d.withColumn("_lang", F.when(known, lang))
    d = d.withColumn("_accepted", F.coalesce((F.col("_probability") >= LEAST_PROBABILITY) & (
        F.col("_text").isNotNull() | F.col("_told").isNotNull()), F.lit(False)))
    return d.select(*docs.columns, "_lang", "_probability", "_accepted")


def identify_documents(docs: DataFrame) -> DataFrame:
    """``documents``: ``lang`` is what the page declares, ``source`` the host;
    the table has no address."""
    return identify(docs, F.lower(F.col("lang")), F.col("source"), F.lit(None).cast("string"))


def identify_pages(pages: DataFrame) -> DataFrame:
    """``pages``: the declaration is the root element's lang, host and suffix
    come from the address, the text is the page without scripts and tags."""
    root = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*?\blang=[\"']?([A-Za-z]+)", 1)), F.lit(""))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    d = pages.withColumn("_body", body)
    return identify(d, root, host, F.nullif(suffix_of(F.col("url")), F.lit("")), "_body").drop("_body")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is accepted."""
    return identify_documents(docs).filter("_accepted").select(*docs.columns)


def op3_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_documents(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("_lang").alias("lang"),
                      F.round("_probability", 6).alias("probability"), F.col("_accepted").alias("kept"))
