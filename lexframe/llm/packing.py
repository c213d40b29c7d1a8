"""Operator 2, token-id output: best-fit-decreasing packing.

Texts are encoded, an end mark follows each, and what is longer than a row is
split into pieces without loss. Pieces are packed into rows of ``LENGTH`` ids:
the longest first, each into the open row with the least room that still holds
it. That row is found in a segment tree over the capacities: a leaf counts the
rows with that much room, and the search goes to the first non-empty leaf at or
after the piece's length, in a logarithmic number of steps.

Every task packs the documents of its own split, a window of ``WINDOW_TOKENS``
at a time, so no text or id is shuffled, memory is bounded, and rows keep the
order of the documents up to a window (a curriculum's order survives). A split
is packed in the same way whenever it is recomputed.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frugal, read

LENGTH = 2048               #: ids of a row
WINDOW_TOKENS = 1 << 20     #: ids packed together
RANKS = "byte_bpe_50k.tiktoken"
END = 50256                 #: the vocabulary's free id, set after every document
LONG_RUN = 100_000          #: characters of a run of white space that is cut out before the library's pattern
#: What the library's pattern takes as white space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RESULT = ("n_tokens int, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, "
          "doc_ids array<bigint>, pieces array<int>, starts array<bigint>")


def encoder(ranks: str = RANKS, longest: int = LONG_RUN) -> Callable[[str], list[int]]:
    """The library's encoder of a vocabulary: text -> ids.

    Its pattern fails on a run of a million white-space characters. The pattern
    takes such a run but for its last character as one piece before something
    else, and the whole run at the end of a text, so runs of ``longest`` or
    more go to the library's merges as that piece, and what lies between them
    goes through the pattern.
    """
    import public_tokenizers as p
    import tiktoken

    with open(p.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=table, special_tokens={})
    # the look-behind lets a run be tried from its start alone: one pass over the text
    runs = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{longest},}}").finditer

    def encode(text: str) -> list[int]:
        if len(text) < longest:
            return library.encode_ordinary(text)
        ids, at = [], 0
        for m in runs(text):
            stop = m.end() if m.end() == len(text) else m.end() - 1
            ids += library.encode_ordinary(text[at: m.start()])
            ids += library._encode_single_piece(text[m.start(): stop])
            at = stop
        return ids + library.encode_ordinary(text[at:])

    return encode


class Capacities:
    """Open rows by room: a segment tree of counts over 0..most."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def least(self, size: int) -> int | None:
        """The least room of at least ``size`` that some row has."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:  # up until a right sibling holds something, then down to its first leaf
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.rows[room].pop()


def best_fit_decreasing(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of piece numbers; equal sizes keep their order, and rows are in
    the order of their first piece."""
    open_, rows = Capacities(length), []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        room = open_.least(size)
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = open_.take(room)
        rows[row].append(k)
        open_.add(room - size, row)
    for r in rows:
        r.sort()
    return sorted(rows)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, window: int = WINDOW_TOKENS,
         ranks: str = RANKS, end: int = END) -> DataFrame:
    """``RESULT``: a row of the id matrix in each row.

    ``input_ids`` and ``position_ids`` are ``n_tokens`` little-endian 32-bit
    numbers (rows are not padded); positions start from 0 in each segment,
    and ``cu_seqlens`` has the segments' ends, from 0. A segment is piece
    ``pieces`` of document ``doc_ids`` and starts at id ``starts`` of it, so
    the documents' ids can be put together again.

    Null or empty text: the end mark alone. Null key: kept. Repeated rows:
    packed each. Empty table: no rows.
    """

    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, total = encoder(ranks), [], 0
        for b in batches:
            for k, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = np.array([*encode(t or ""), end], np.int32)
                held += [(k, n, a, ids[a: a + length]) for n, a in enumerate(range(0, len(ids), length))]
                total += len(ids)
                if total >= window:
                    yield from _rows(held, length)
                    held, total = [], 0
        if held:
            yield from _rows(held, length)

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(frugal(work), RESULT)


def _rows(pieces: list, length: int, most: int = 256) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(p[3]) for p in pieces], np.int64)
    rows = best_fit_decreasing(sizes, length)
    for a in range(0, len(rows), most):
        out = []
        for row in rows[a: a + most]:
            own = [pieces[k] for k in row]
            n = [len(p[3]) for p in own]
            out.append((sum(n), len(own), np.concatenate([p[3] for p in own]).astype("<i4").tobytes(),
                        np.concatenate([np.arange(m, dtype="<i4") for m in n]).tobytes(),
                        [0, *np.cumsum(n).tolist()], [p[0] for p in own], [p[1] for p in own], [p[2] for p in own]))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                 pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)


def op2_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
