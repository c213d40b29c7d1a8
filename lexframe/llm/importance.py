"""Operator 12, target-distribution importance resampling.

Words come from the tokenizer library's pre-tokenisation: an untrained Split by
a regular expression over the ASCII-lowered text, which returns the words with
their offsets. Windows of successive offset pairs are the features: runs of one
to three words, hashed to buckets by the CRC-32 of the words joined by single
spaces. A bucket's gain is the log of its share in the target texts over that
in the documents; a document's weight is the sum over its features. A seeded
Gumbel number is added, and the highest scores are drawn: sampling without
replacement by importance.

The CRC of a window is put together from those of its words (a CRC is linear),
by lookup tables for whole arrays of words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import global_position
from .common import blocks, bound_batches, fresh, frugal, join_checked, number_repeats, read, stored, text_bytes
from .parts import type_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"   #: of the lowered text: ASCII letters and digits, and all beyond ASCII
BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
RUN = 3             #: words of the longest feature
BUCKETS = 10_000
SEED = 42
LEAST = 20          #: words of a document that can be drawn
PERCENT = 5         #: of these that are drawn
STRETCH = 1 << 18   #: characters handed to the library at a time
TABLES = 64         #: bytes of a word for which lookup tables are kept


def _byte_table() -> np.ndarray:
    """CRC-32 of each byte: the polynomial's remainders."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t.astype(np.uint32)


_BYTE = _byte_table()


def _shift_tables() -> np.ndarray:
    """``[n, place, byte]``: what a CRC's byte at a place becomes when ``n``
    more bytes follow."""
    out = np.empty((TABLES + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, TABLES + 1):
        out[n] = _BYTE[out[n - 1] & 255] ^ (out[n - 1] >> 8)
    return out


_SHIFT = _shift_tables().reshape(-1)


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The share of ``crc`` in the CRC of a text that goes on for ``n`` bytes."""
    n = n.copy()
    far = np.flatnonzero(n > TABLES)
    if len(far):
        crc = crc.copy()
        while len(far):
            crc[far] = shifted(crc[far], np.full(len(far), TABLES))
            n[far] -= TABLES
            far = far[n[far] > TABLES]
    at = n * 1024
    return (_SHIFT[at + (crc & 255)] ^ _SHIFT[at + 256 + (crc >> 8 & 255)] ^ _SHIFT[at + 512 + (crc >> 16 & 255)]
            ^ _SHIFT[at + 768 + (crc >> 24)])


def word_crcs(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a byte of all words at a time."""
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    on = np.flatnonzero(size <= TABLES)
    for j in range(TABLES):
        on = on[size[on] > j]
        if not len(on):
            break
        c = crc[on]
        crc[on] = _BYTE[(c ^ buf[start[on] + j]) & 255] ^ (c >> 8)
    crc = ~crc
    for i in np.flatnonzero(size > TABLES).tolist():
        crc[i] = zlib.crc32(buf[start[i]: start[i] + size[i]])
    return crc


def splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str


def offsets(split, text: str) -> np.ndarray:
    """(start, end) of each word, in characters. Long texts go to the library
    in stretches that end after a character between words."""
    out, at = [], 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            found = BETWEEN.search(text, end)
            end = found.end() if found else len(text)
        out.append(np.array([o for _, o in split(text[at:end])], np.int64).reshape(-1, 2) + at)
        at = end
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def features(split, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The index of each text's first word (the total last), and for runs of 1
    to ``RUN`` words the bucket of the run at every word (those that cross into
    the next text are no features)."""
    raw = b"\0".join(texts).lower()  # ASCII alone is lowered; a zero byte is between words
    buf, body = np.frombuffer(raw, np.uint8), raw.decode()
    spans = offsets(split, body)
    if len(body) < len(raw):
        spans = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(raw))[spans]
    start, size = spans[:, 0], spans[:, 1] - spans[:, 0]
    first = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in texts]))
    crc = word_crcs(buf, start, size)
    spaced = shifted(np.full(len(size), zlib.crc32(b" "), np.uint32), size) ^ crc  # of " word"
    out, run = [crc % BUCKETS], crc
    for k in range(1, RUN):
        run = shifted(run[:-1], size[k:] + 1) ^ spaced[k:]
        out.append(run % BUCKETS)
    return first, out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    buf, off = text_bytes(batch.column("text"))
    for i, j in blocks(off):
        yield i, j, [buf[off[k]: off[k + 1]].tobytes() for k in range(i, j)]


def feature_table(texts: DataFrame) -> DataFrame:
    """``_id, text`` -> ``_id, n_words, buckets``: the bucket of every feature
    of a text, as little-endian 16-bit numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter()
        for batch in batches:
            for i, j, own in _slices(batch):
                first, buckets = features(split, own)
                some = [b.astype("<u2") for b in buckets]
                # a run of k more words does not start at a text's last k words
                out = [b"".join(b[lo: max(hi - k, lo)].tobytes() for k, b in enumerate(some))
                       for lo, hi in zip(first.tolist(), first[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(i, j - i), pa.array(np.diff(first)),
                                                  pa.array(out, pa.binary())], ["_id", "n_words", "buckets"])

    return texts.select("_id", "text").mapInArrow(
        frugal(work), f"_id {type_of(texts, '_id')}, n_words bigint, buckets binary")


def _joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all rows and the offsets of each row's."""
    buf, off = text_bytes(batch.column("buckets"))
    return buf.view("<u2"), off // 2


def histogram(table: DataFrame) -> dict[int, int]:
    """:func:`feature_table` rows -> the features of each bucket. A task
    reports its own sums, a row a bucket; ``BUCKETS`` rows at most reach the
    driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    rows = table.select("buckets").mapInArrow(frugal(work), "bucket int, n bigint")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Per bucket floor(1000 ln of the smoothed target share over the source's)."""
    s_all, t_all = sum(source.values()), sum(target.values())
    return np.array([math.floor(1000 * math.log(
        float(target.get(b, 0) + 1) * float(s_all + BUCKETS) / (float(source.get(b, 0) + 1) * float(t_all + BUCKETS))))
        for b in range(BUCKETS)], np.int64)


def weigh(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """:func:`feature_table` rows -> ``_id, n_words, n_features, weight``;
    ``gain`` has ``BUCKETS`` numbers and goes with the tasks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, off = _joined(batch)
            run = np.concatenate([[0], np.cumsum(gain[buckets])])
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_words"), pa.array(np.diff(off)),
                                              pa.array(np.diff(run[off]))], ["_id", "n_words", "n_features", "weight"])

    return table.mapInArrow(
        frugal(work), f"_id {type_of(table, '_id')}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key, seed: int = SEED):
    """floor(1000 g) of a Gumbel number g that only the seed and the key
    decide (a null key counts as an empty string)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
               least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row.

    Of the N rows with at least ``least`` words the floor(``percent`` * N /
    100) highest scores have a ``rank`` from 1, ties to the smaller key, a null
    key last; the other rows' is null.

    Null or empty text: no words, weight 0. Repeated rows: drawn each for
    itself. Empty documents: no rows; empty target: the gains of its empty
    histogram. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    aim = target.select(F.lit(0).alias("_id"), F.col(target_text).cast("string").alias("text"))
    table = stored(feature_table(d), "importance-features")  # the texts are split once
    gain = gains(histogram(table), histogram(feature_table(aim)))
    rows = stored(weigh(table, gain).withColumn("score", F.col("weight") + gumbel(F.col("_id"), seed)), "importance-scores")
    able = rows.filter(F.col("n_words") >= least)
    draw = able.count() * percent // 100
    # all that can be drawn are sorted by score over range partitions: five numbers a row
    placed = global_position(able, [F.col("score").desc(), F.col("_id").asc_nulls_last()], "_place")
    rank = F.when(F.col("_place") < draw, F.col("_place") + 1).cast("bigint").alias("rank")
    names = [F.col("_id").alias(key), "n_words", "n_features", "weight", "score"]
    return placed.select(*names, rank).unionByName(
        rows.filter(F.col("n_words") < least).select(*names, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Keys tell
    rows apart; a key of several drawn rows has that many of its rows kept."""
    ranked = importance(docs, target, key, text, **options).filter("rank IS NOT NULL")
    many = stored(ranked.groupBy(key).agg(F.count(F.lit(1)).alias("_drawn")), "importance-drawn")
    extra = fresh(docs, "_drawn"), fresh(docs, "_rep")
    kept = join_checked(docs, many.withColumnRenamed("_drawn", extra[0]), [key])
    return number_repeats(kept, [key], extra[1]).filter(F.col(extra[1]) < F.col(extra[0])).select(*docs.columns)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")
