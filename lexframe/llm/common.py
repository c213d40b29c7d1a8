"""Helpers shared by the training-data operators.

Defined results for awkward input (all operators, unless one says otherwise):
a null text counts as an empty one; a null key is a value like any other;
repeated rows are separate rows; an empty table gives an empty result with the
same columns; extra input columns are ignored, or carried along untouched
where an operator filters rows. Names an operator adds itself start with an
underscore and replace nothing of the input's.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, table  # noqa: F401

# Executors need not have this package: what runs there is sent with the task.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: Rows up to which a side of a join may be broadcast; every side so joined
#: has a few fixed-width columns, so this bounds the broadcast to some 50 MB.
BROADCAST_ROWS = 500_000

#: The words of the contracts: everything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage and survives lost executors. A frame without rows stays readable,
    as the schema is given."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(work):
    """A map over Arrow batches that gives freed memory back to the system
    when its task ends: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


ROWS_CONF, BYTES_CONF = (f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes"))


def bound_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Let jobs of this session hand Python at most ``rows`` rows and about
    ``size`` bytes at a time: for whole texts, where the default of 10,000 rows
    is much memory."""
    before = int(spark.conf.get(ROWS_CONF))
    if before <= 0 or before > rows:
        spark.conf.set(ROWS_CONF, str(rows))
    if not 0 < in_bytes(spark.conf.get(BYTES_CONF)) <= size:
        spark.conf.set(BYTES_CONF, f"{size}b")


def in_bytes(size: str) -> int:
    """A byte size of the session's settings as a number."""
    digits = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(digits[-1:], 0)
    return int(digits[:-1] if unit else digits) << unit


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within the block, a setting of the session has another value."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int, size: int = 8 << 20) -> Iterator[None]:
    """Within the block, jobs hand Python at most ``rows`` rows and about
    ``size`` bytes at a time: for rows that carry two texts."""
    before = {c: spark.conf.get(c) for c in (ROWS_CONF, BYTES_CONF)}
    bound_batches(spark, rows, size)
    try:
        yield
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (names differ by
    more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of ``keys`` in two frames."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def join_checked(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` (null-safe), broadcasting ``small`` only when its
    counted rows stay under ``BROADCAST_ROWS``; beyond, Spark's shuffled join
    with adaptive skew splitting does it. ``small`` should be a stored table
    (it is counted first). Columns of ``small`` other than the keys follow
    those of ``df``."""
    right = {k: fresh(df, f"_{k}_right") for k in keys}
    renamed = small.select(*[F.col(k).alias(right[k]) for k in keys], *[c for c in small.columns if c not in keys])
    side = F.broadcast(renamed) if small.count() <= BROADCAST_ROWS else renamed
    on = reduce(lambda a, b: a & b, (df[k].eqNullSafe(renamed[right[k]]) for k in keys))
    out = df.join(side, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*right.values())


def number_repeats(df: DataFrame, keys: list[str], out: str = "_rep") -> DataFrame:
    """Number rows that agree in ``keys`` from 0. Rows whose keys occur once
    (normally all) get 0 without a shuffle of their other columns: only the
    keys are counted, and only rows of repeated keys go through a window."""
    from pyspark.sql import Window

    n = fresh(df, "_n")
    many = stored(df.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(*keys),
                  "repeats")
    if many.isEmpty():
        return df.withColumn(out, F.lit(0))
    once = join_checked(df, many, keys, "left_anti").withColumn(out, F.lit(0))
    w = Window.partitionBy(*keys).orderBy(*keys)
    again = join_checked(df, many, keys, "left_semi").withColumn(out, F.row_number().over(w) - 1)
    return once.unionByName(again)


# -- words of whole Arrow batches, by numpy -----------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; nulls
    are empty."""
    a = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    a = a.fill_null(b"") if a.null_count else a
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset: a.offset + len(a) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0]: off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``most`` bytes (one row at least), which
    bounds the memory of the vectorised work on a batch."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Byte classes for loose matching: everything but ASCII letters, digits and non-ASCII bytes separates words.
_LOOSE = np.ones(256, bool)
_LOOSE[128:] = False
_LOOSE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)  # any odd constant
_INVERSE = np.uint64(pow(int(_MUL), -1, 1 << 64))
_STRETCH = 1 << 20  # bytes hashed at a time
_BYTE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0x2545F4914F6CDD1D)

_LOWERED = _BYTE[_LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(buf: np.ndarray, off: np.ndarray, loose: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words in rows ``off`` of ``buf``, and
    the index of each row's first word (with the total at the end)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~(_LOOSE if loose else _SPACES)[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True  # a row's first byte starts anew
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (ASCII letters lowered on request):
    differences of a running polynomial, shifted back by the word's place."""
    out = np.empty(len(start), np.uint64)
    powers = shifts = np.empty(0, np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):  # a stretch of whole words at a time
            j = max(i + 1, int(np.searchsorted(end, start[i] + _STRETCH, "right")))
            part = buf[start[i]: end[j - 1]]
            if len(part) >= len(powers):
                powers = np.cumprod(np.full(len(part) + 1, _MUL, np.uint64))
                shifts = np.cumprod(np.full(len(part) + 1, _INVERSE, np.uint64))
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((_LOWERED if lower else _BYTE)[part] * powers[: len(part)], out=run[1:])
            at = start[i:j] - start[i]
            out[i:j] = (run[end[i:j] - start[i]] - run[at]) * shifts[at]
            i = j
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (len(h) - k + 1 of them);
    order matters."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out *= _MUL
            out += h[i: i + n]
        return mix(out)


def digest_columns(text: Column) -> Column:
    """SHA-256 of the text (null as empty), as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)
