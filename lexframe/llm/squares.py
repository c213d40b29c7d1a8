"""Operator 11, packing: sum-of-squares online packing.

A document's ids (and an end mark) that fill whole windows leave as such; the
rest is placed online. The level array counts the open windows by how full they
are, and a piece goes to the fill level (or to a new window) that minimises the
sum of squared counts of partially filled windows. Levels that many windows
share are used up first, and windows end up full although nothing is known of
the documents to come.

Every task packs the documents of its own split; nothing is shuffled. A task
holds ``OPEN`` windows at most. When they are more, and at its end, the open
windows are joined, fullest first, and cut into full ones; what is then left at
the end is cut at powers of two, so it needs no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frugal, read
from .parts import Ids, byte_bpe, cut, some_rows, type_of

LENGTH = 1024               #: ids of a sequence
OPEN = 4096                 #: open windows of a task
VOCABULARY = "byte_bpe_50k.json"
END = 0                     #: the id set after every document

Piece = tuple  #: document, its ids in all, start, ids


class Levels:
    """Open windows by fill level, and the array of their counts."""

    def __init__(self, length: int):
        self.length, self.open = length, 0
        self.count = np.zeros(length + 1, np.int64)  # levels 0 and length are never open
        self.windows: dict[int, list[list[Piece]]] = {}
        # a window leaves level h (not level 0) and enters level h + size (not the full one)
        self.ones = np.full(length + 1, 2, np.int64)
        self.ones[0] = 1

    def best(self, size: int) -> int:
        """The level whose window should take ``size`` more (0: a new one).
        The sum of squares changes by 2 * (entered - left) and the ones; of
        equal levels the fullest is taken."""
        left, entered = self.count[: self.length - size + 1], self.count[size:]
        change = 2 * (entered - left) + self.ones[: len(left)]
        change[-1] -= 1
        change[1:][left[1:] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece shorter than a window in; returns the window if that
        fills it."""
        size = len(piece[3])
        level = self.best(size)
        if level:
            self.count[level] -= 1
            window = self.windows[level].pop()
        else:
            self.open += 1
            window = []
        window.append(piece)
        if level + size == self.length:
            self.open -= 1
            return window
        self.count[level + size] += 1
        self.windows.setdefault(level + size, []).append(window)
        return None

    def rejoin(self, last: bool) -> Iterator[list[Piece]]:
        """Join the open windows, fullest first, and cut them into full ones.
        The rest stays open, or is cut at powers of two if it is the ``last``."""
        own = [p for level in sorted(self.windows, reverse=True) for w in self.windows[level] for p in w]
        self.windows, self.open = {}, 0
        self.count[:] = 0
        total = sum(len(p[3]) for p in own)
        sizes = [self.length] * (total // self.length)
        rest = total % self.length
        sizes += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if last and rest >> b & 1]
        own.reverse()
        for size in sizes:
            window, room = [], size
            while room:
                doc, n, start, ids = own.pop()
                window.append((doc, n, start, ids[:room]))
                if len(ids) > room:
                    own.append((doc, n, start + room, ids[room:]))
                room -= min(room, len(ids))
            yield window
        if own:
            self.open = self.count[rest] = 1
            self.windows[rest] = [own[::-1]]


def sum_of_squares(pieces: Iterator[Piece], length: int, most: int = OPEN) -> Iterator[list[Piece]]:
    """Pack documents ``(document, number of ids, 0, ids)`` into windows."""
    levels = Levels(length)
    for doc, n, _, ids in pieces:
        whole = n - n % length
        for a in range(0, whole, length):
            yield [(doc, n, a, ids[a: a + length])]
        if whole < n:
            full = levels.place((doc, n, whole, ids[whole:]))
            if full:
                yield full
        if levels.open > most:
            yield from levels.rejoin(last=False)
    yield from levels.rejoin(last=True)


def pack_online(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, most: int = OPEN,
                vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """A row for each piece: ``key``, ``start`` (ids of the document before
    it), ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``
    (of the document, with the end mark), ``sequence_id``, ``offset`` (in the
    sequence). A sequence's pieces follow each other without gaps, and it has
    ``length`` ids or a power of two.

    The number of a sequence is made of its split's, and a split is packed in
    the same way whenever it is recomputed. Special strings in a text are
    handled as the library does by default.

    Null or empty text: the end mark alone. Null key: kept. Repeated rows:
    packed each. Empty table: no rows. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    names = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = byte_bpe(vocabulary, special=True)
        first, rest = Ids(encode), Ids(lambda parts: encode([" " + p for p in parts]))
        mark = np.array([end], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        kind = None

        def documents() -> Iterator[Piece]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("_id").type
                for rows, texts in some_rows(batch):
                    parts = [cut(t) for t in texts]
                    heads, tails = first([p[:1] for p in parts]), rest([p[1:] for p in parts])
                    for doc, a, b in zip(rows.column("_id").to_pylist(), heads, tails):
                        ids = np.frombuffer(a + b + mark, "<u4")
                        yield doc, len(ids), 0, ids

        def table(out: list[tuple]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        out = []
        for window in sum_of_squares(documents(), length, most):
            at = 0
            for doc, n, start, ids in window:
                out.append((doc, start, len(ids), ids.tobytes(), n, number, at))
                at += len(ids)
            number += 1
            if len(out) >= 1024:
                yield table(out)
                out = []
        if out:
            yield table(out)

    rows = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        frugal(work), f"_id {type_of(docs, key)}, start bigint, length bigint, ids binary, doc_tokens bigint, "
                      "sequence_id bigint, offset bigint")
    return rows.withColumnRenamed("_id", key)


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_online(read(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
