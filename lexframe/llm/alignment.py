"""Operator 13, cross-tokenizer alignment: lockstep vectorised merging.

Two tokenizers cut the same bytes. Where tokens of both end, the text is cut
into groups; tokens whose bytes overlap are linked. The merge is done for all
documents of a batch at once: a state vector holds a pointer into the A tokens
and one into the B tokens for every lane, each step emits the lanes' links (and
a cut where both tokens end together), advances the pointer of the token that
ends first (both at a cut), and drops the lanes that are done. A document is a
lane; a long one is several, each with ``LANE`` of its A tokens and beginning at
the B token that overlaps its first byte, so that one very long text does not
leave the others' vector empty.

How many documents link an id pair is a grouped count. The pairs of most
documents are joined to their counts from a broadcast side of a checked size,
the rare ones by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import bound_batches, frugal, read, stored
from .parts import Ids, byte_bpe, byte_letters, cut, some_rows, type_of

A_MODEL = "byte_bpe_50k.json"
B_MODEL = "piece_bpe_32k.model"
LANE = 256      #: A tokens of a lane


def byte_level_bytes(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    letters = byte_letters()
    return [bytes(letters[c] for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]


def piece_bytes(sp) -> list[bytes]:
    """The bytes of each id of a piece model: U+2581 is a space, <0xHH> a byte."""
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else
            sp.id_to_piece(i).replace("▁", " ").encode() for i in range(len(sp))]


def piece_model(name: str):
    """A piece model and a function that gives the ids of many strings, each
    with the space in front that the model sets."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return sp, lambda texts: sp.encode(texts, num_threads=1)


def lockstep(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray, lane: int = LANE
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Merge token ends of documents that lie one behind the other on one axis
    of bytes. ``first_a``: each document's first A token, with the total last.

    Returns the links (index of the A token, of the B token) and, ascending,
    the last A and last B token of every group.
    """
    n = -(-np.diff(first_a) // lane)    # lanes of each document
    stop = np.repeat(first_a[1:], n)
    a = np.repeat(first_a[:-1], n) + lane * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    stop = np.minimum(stop, a + lane)
    b = np.searchsorted(end_b, np.where(a > 0, end_a[a - 1], 0), "right") if len(a) else a
    links, cuts = [(a[:0], b[:0])], [(a[:0], b[:0])]
    while len(a):
        links.append((a, b))
        ea, eb = end_a[a], end_b[b]
        together = ea == eb
        cuts.append((a[together], b[together]))
        a, b = a + (ea <= eb), b + (eb <= ea)
        on = a < stop
        if not on.all():
            a, b, stop = a[on], b[on], stop[on]
    link_a, link_b = (np.concatenate(x) for x in zip(*links))
    cut_a, cut_b = (np.sort(np.concatenate(x)) for x in zip(*cuts))
    return link_a, link_b, cut_a, cut_b


class Names:
    """Ids as decimal text, with what follows inside and at the end of a
    group's side."""

    def __init__(self, n_a: int, n_b: int):
        self.a = np.array([f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)], object)
        self.b = np.array([f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)], object)
        self.n_a, self.n_b = n_a, n_b

    def groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> np.ndarray:
        """The tokens of both sides in the order of ``a1,a2|b1;a3|b2,b3;``."""
        ia, ib = np.arange(len(a)), np.arange(len(b))
        ga, gb = np.searchsorted(cut_a, ia), np.searchsorted(cut_b, ib)
        out = np.empty(len(a) + len(b), object)
        out[ia + np.concatenate([[0], cut_b + 1])[ga]] = self.a[a + self.n_a * (ia == cut_a[ga])]
        out[ib + cut_a[gb] + 1] = self.b[b + self.n_b * (ib == cut_b[gb])]
        return out


ALIGNED = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, "
           "pairs array<struct<a:int,b:int,n:int>>")


def align_documents(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL) -> DataFrame:
    """``_id, text`` -> ``_id`` and ``ALIGNED``: the groups as decimal ids
    (``a1,a2|b1;a3|b2,b3``), and each linked pair of ids once, with the number
    of its links in the document.

    Special strings in a text are plain text. A text that is null or empty, or
    whose tokens' joined bytes differ from a space and the text, has no tokens.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode_a = byte_bpe(a_model, special=False)
        sp, encode_b = piece_model(b_model)
        bytes_a, bytes_b = byte_level_bytes(bpe), piece_bytes(sp)
        sizes_a, sizes_b = (np.array([len(x) for x in t], np.int64) for t in (bytes_a, bytes_b))
        names = Names(len(bytes_a), len(bytes_b))
        # each part of a text has its space in front on both sides
        ids_a, ids_b = Ids(lambda parts: encode_a([" " + p for p in parts])), Ids(encode_b)

        def whole(ids: bytes, table: list[bytes], text: bytes) -> bool:
            return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]) == text

        for batch in batches:
            for rows, texts in some_rows(batch):
                parts = [cut(t) if t else [] for t in texts]
                own = list(zip(ids_a(parts), ids_b(parts)))
                for k, t in enumerate(texts):
                    if t and not (whole(own[k][0], bytes_a, b" " + t.encode())
                                  and whole(own[k][1], bytes_b, b" " + t.encode())):
                        own[k] = b"", b""
                yield table(rows.column("_id"), own, sizes_a, sizes_b, names)

    def table(ids: pa.Array, own: list[tuple[bytes, bytes]], sizes_a, sizes_b, names: Names) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*own))
        first_a, first_b = (np.cumsum([0] + [len(x) // 4 for x in side]) for side in zip(*own))
        link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b]), first_a)
        n = len(own)
        doc_of = np.repeat(np.arange(n), np.diff(first_a))
        words = names.groups(a, b, cut_a, cut_b)
        at = first_a + first_b
        groups = ["".join(words[x:y].tolist())[:-1] for x, y in zip(at, at[1:])]
        pair, links = np.unique((doc_of[link_a] * names.n_a + a[link_a]) * names.n_b + b[link_b], return_counts=True)
        rest, pair_b = np.divmod(pair, names.n_b)
        pair_doc, pair_a = np.divmod(rest, names.n_a)
        pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (pair_a, pair_b, links)], ["a", "b", "n"])
        off = np.searchsorted(pair_doc, np.arange(n + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.diff(first_a)), pa.array(np.diff(first_b)), pa.array(np.bincount(doc_of[cut_a], minlength=n)),
             pa.array(np.bincount(doc_of[link_a], minlength=n)), pa.array(groups, pa.string()),
             pa.ListArray.from_arrays(pa.array(off), pairs)],
            ["_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    return docs.select("_id", "text").mapInArrow(frugal(work), f"_id {type_of(docs, '_id')}, {ALIGNED}")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``a, b`` (a row a document) -> ``a, b, count, best``: the documents
    that hold the pair, and whether that is the highest number of its A id."""
    counts = stored(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("count")), "alignment-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.join(most, "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, rows: int) -> int:
    """The least power of two so that at most ``rows`` pairs have a count of
    it or more."""
    steps = {r["step"]: r["n"] for r in counts.groupBy(F.floor(F.log2("count")).alias("step")).agg(
        F.count(F.lit(1)).alias("n")).collect()}  # a row for each power of two
    step, held = max(steps, default=0) + 1, 0
    while step > 0 and held + steps.get(step - 1, 0) <= rows:
        step -= 1
        held += steps.get(step, 0)
    return 1 << step


def alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", a_model: str = A_MODEL, b_model: str = B_MODEL
              ) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of
    every row.

    Null or empty text, and one that a tokenizer does not give back: zeros and
    an empty digest. Null key: a document like any other. Repeated rows: each a
    document of its own, also in the counts. Empty table: no rows. Other
    columns are ignored.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(key).alias("_id"), F.col(text).cast("string").alias("text"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    rows = stored(align_documents(d, a_model, b_model).select(
        F.monotonically_increasing_id().alias("_row"), "_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs"),
        "alignment-rows")
    pairs = rows.select("_row", F.inline("pairs"))
    counts = stored(pair_counts(pairs), "alignment-pairs")
    least = frequent(counts, common.BROADCAST_ROWS)
    often = F.broadcast(counts.filter(F.col("count") >= least))
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
            F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    told = pairs.join(often, ["a", "b"]).groupBy("_row").agg(*sums)
    if least > 1:
        rare = pairs.join(often.select("a", "b"), ["a", "b"], "left_anti").join(
            counts.filter(F.col("count") < least), ["a", "b"]).groupBy("_row").agg(*sums)
        told = told.unionByName(rare).groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias(
            "count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return rows.drop("pairs").join(told, "_row", "left").select(
        F.col("_id").alias(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read(spark, sf_dir, "documents"))
