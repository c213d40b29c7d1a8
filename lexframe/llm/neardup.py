"""Operator 5, near-duplicates: order MinHash with banded alignment.

A text's k-mers are its runs of five words, each labelled with its occurrence
number. A sketch takes the ``ORDER`` k-mers with the smallest hashes and hashes
them in the order in which they stand in the text, so that it agrees for texts
that share k-mers *in the same order*: texts close in edit distance. Texts that
agree in one of the sketches are candidates, and an alignment within the band
that the similarity allows decides.

A bucket of equal sketches may hold a third of all texts. Its members are first
aligned with two leaders only (the smallest and the largest key), and the
components of what is confirmed are formed. Where a bucket still holds texts of
different components, every pair across them is a candidate that bounds cannot
rule out: similar texts share most of their words, so one of the rarest fifth of
each must be in both, and the words that one of them lacks must be few. Texts
that meet in a bucket by a common passage seldom pass, so they are not aligned.
Texts already connected are never paired.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (arrow_rows, blocks, bound_batches, fresh, frugal, join_checked, mix, number_repeats, read, rolling,
                     setting, stored, text_bytes, word_hashes, word_spans)
from .graph import components

WORDS = 5           #: words of a k-mer
ORDER = 3           #: k-mers of a sketch: texts with a part J of k-mers in common agree in one with about J ** 3
SKETCHES = 24       #: sketches of a text: at J = 0.8 all differ for 3 pairs in 100 million, at J = 0.6 for 3 in 1,000
SIMILARITY = 0.8    #: 1 - edits / words of the longer text

_SALT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def occurrence_labelled(kmers: np.ndarray) -> np.ndarray:
    """Make equal k-mers differ by their occurrence number; a first one stays
    as it is, so that texts with and without repeats agree."""
    order = np.argsort(kmers, kind="stable")
    s = kmers[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    if fresh.all():
        return kmers
    index = np.arange(len(s))
    number = index - np.maximum.accumulate(np.where(fresh, index, 0))
    out = np.empty_like(kmers)
    with np.errstate(over="ignore"):
        out[order] = np.where(fresh, s, mix(s + number.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return out


def order_sketches(hashes: np.ndarray, sketches: int = SKETCHES, order: int = ORDER, k: int = WORDS) -> np.ndarray:
    """The order-MinHash sketches of a text given its words' hashes. A text of
    fewer than ``k`` words is one k-mer; one of fewer k-mers than ``order``
    gives them all."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    kmers = rolling(hashes, min(k, len(hashes)))
    labelled = occurrence_labelled(kmers)
    out = np.empty(sketches, np.uint64)
    step = max(1, (1 << 21) // len(kmers))  # bounds the matrix for very long texts
    with np.errstate(over="ignore"):
        for i in range(0, sketches, step):
            salt = _SALT[i: min(i + step, sketches), None]
            rank = (labelled[None, :] ^ salt) * (salt | np.uint64(1))
            take = min(order, len(kmers))
            at = (np.argpartition(rank, take - 1, axis=1)[:, :take] if take < len(kmers)
                  else np.broadcast_to(np.arange(take), (len(salt), take)))
            chosen = kmers[np.sort(at, axis=1)]
            h = salt[:, 0].copy()
            for c in range(take):
                h = mix(h ^ chosen[:, c])
            out[i: i + len(salt)] = h
    return out


def sketch_table(docs: DataFrame) -> DataFrame:
    """``_key, text`` -> ``_key, digest, n_words, sketches``; the digest is
    over the words, so texts that differ in white space alone are equal. A
    text without words has a null digest and no sketch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_bytes(b.column("text"))
            digests, sizes, sketches = [], [], []
            for i, j in blocks(off):
                part, at = buf[off[i]: off[j]], off[i: j + 1] - off[i]
                start, end, first = word_spans(part, at)
                h = word_hashes(part, start, end)
                for k in range(j - i):
                    own = h[first[k]: first[k + 1]]
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sketches.append(order_sketches(own).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(sketches, pa.list_(pa.int64()))], ["_key", "digest", "n_words", "sketches"])

    return docs.select("_key", "text").mapInArrow(
        frugal(work), "_key bigint, digest binary, n_words int, sketches array<bigint>")


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the equal words at both ends, which no edit needs to touch."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b = a[lead:], b[lead:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


_AHEAD = np.arange(1024)


def edits_within(a: np.ndarray, b: np.ndarray, most: int, beam: int | None = None) -> int | None:
    """Edit distance of two sequences of numbers if it is at most ``most``.

    An alignment confined to the diagonals within ``most`` of the main one:
    for each number of edits the furthest cell reached on each diagonal, all
    diagonals at once; runs of equal words are passed by comparing blocks that
    double. Memory is in proportion to the texts and the diagonals. With
    ``beam``, only diagonals that are at most so many cells behind the furthest
    are followed: what is found then is the cost of some alignment, so an upper
    bound.
    """
    if abs(len(a) - len(b)) > most:
        return None
    a, b = _trim(a, b)
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) if max(n, m) <= most else None
    kinds = np.unique(np.concatenate([a, b]), return_inverse=True)[1].reshape(-1)
    # ends that equal nothing
    x, y = (np.concatenate([t, np.full(len(_AHEAD) + 1, end)]) for t, end in ((kinds[:n], -1), (kinds[n:], -2)))

    def slide(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        """From the cells (i, i + d) down their diagonals past equal words."""
        on, width = np.arange(len(i)), 8
        while len(on):
            going = []
            for c in range(0, len(on), 4096):
                some = on[c: c + 4096]
                at = i[some, None] + _AHEAD[:width]
                differ = x[at] != y[at + d[some, None]]
                stop = differ.argmax(axis=1)
                through = ~differ[np.arange(len(some)), stop]
                i[some] += np.where(through, width, stop)
                going.append(some[through])
            on = np.concatenate(going)
            if 4 * len(on) * width <= 1 << 18:
                width = min(4 * width, len(_AHEAD))
        return i

    none, goal = -(1 << 40), m - n
    reach = np.full(2 * most + 5, none)  # of diagonal d at d + most + 2
    zero = most + 2
    lo = hi = 0
    reach[zero] = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for e in range(most + 1):
        if reach[zero + goal] >= n:
            return e
        lo, hi = max(lo - 1, -n, goal - (most - e)), min(hi + 1, m, goal + most - e)
        if lo > hi:
            return None
        d = np.arange(lo, hi + 1)
        own, before, after = (reach[zero + lo + s: zero + hi + 1 + s] for s in (0, -1, 1))
        best = np.minimum(np.maximum(np.maximum(own + 1, before), after + 1), np.minimum(n, m - d))
        best[best < np.maximum(0, -d)] = none
        there = np.flatnonzero(best >= 0)
        if not len(there):
            return None
        best[there] = slide(best[there], d[there])
        if beam is not None:
            far = 2 * best + d
            best[far < far.max() - 2 * beam] = none
            there = np.flatnonzero(best >= 0)
        reach[zero + lo - 2: zero + hi + 3] = none
        reach[zero + lo: zero + hi + 1] = best
        lo, hi = int(d[there[0]]), int(d[there[-1]])
    return None


def _in_order(at: np.ndarray) -> int:
    """The length of the longest increasing subsequence."""
    tails: list[int] = []
    for p in at.tolist():
        k = bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
        else:
            tails[k] = p
    return len(tails)


def alike(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two sequences are within ``most`` edits. Bounds decide nearly
    all pairs: from below the words that one side lacks, and those that stand
    once in both, of which an alignment keeps a run in order at most; from above
    a position by position comparison and an alignment along a beam. The rest is
    aligned in the whole band."""
    if abs(len(a) - len(b)) > most:
        return False
    a, b = _trim(a, b)
    if max(len(a), len(b)) <= most:
        return True
    if len(a) == len(b) and int((a != b).sum()) <= most:
        return True
    kinds, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    number = number.reshape(-1)
    x, y = number[: len(a)], number[len(a):]
    in_a, in_b = (np.bincount(t, minlength=len(kinds)) for t in (x, y))
    both = np.minimum(in_a, in_b)
    if max(len(a), len(b)) - int(both.sum()) > most:
        return False
    once = (in_a == 1) & (in_b == 1)
    place = np.zeros(len(kinds), np.int64)
    place[y] = np.arange(len(y))
    kept = int(both[~once].sum()) + _in_order(place[x[once[x]]])
    if max(len(a), len(b)) - kept > most:
        return False
    # a narrow band costs no more than a beam along it
    return (most > 256 and edits_within(a, b, most, beam=8) is not None) or edits_within(a, b, most) is not None


def word_table(texts: DataFrame) -> DataFrame:
    """``_key, text`` -> ``_key, words``: the words' 64-bit hashes, as bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = text_bytes(batch.column("text"))
            out = []
            for i, j in blocks(off):
                part, at = buf[off[i]: off[j]], off[i: j + 1] - off[i]
                start, end, first = word_spans(part, at)
                h = word_hashes(part, start, end)
                out += [h[first[k]: first[k + 1]].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(out, pa.binary())], ["_key", "words"])

    return texts.select("_key", "text").mapInArrow(frugal(work), "_key bigint, words binary")


def align(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``a, b`` -> the pairs that are similar enough; ``words`` is a
    :func:`word_table` with a row for each key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("wa"), batch.column("wb")
            good = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                good.append(alike(x, y, int((1 - similarity) * max(len(x), len(y)) + 1e-9)))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    # the last join deals the pairs out by their less frequent side, so that one text's many pairs are no one task's
    ends = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"))
    met = pairs.join(ends.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(
        ends.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    often = F.col("na") >= F.col("nb")
    met = met.select("a", "b", F.when(often, F.col("a")).otherwise(F.col("b")).alias("x"),
                     F.when(often, F.col("b")).otherwise(F.col("a")).alias("y"))
    left = words.select(F.col("_key").alias("x"), F.col("words").alias("wa"))
    right = words.select(F.col("_key").alias("y"), F.col("words").alias("wb"))
    return met.join(left, "x").join(right, "y").select("a", "b", "wa", "wb").mapInArrow(frugal(work), "a bigint, b bigint")


PAIR_ROWS = 128     #: pairs of texts that a task holds at a time


def _verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """Fetch the texts of the paired keys (only theirs) and align."""
    pairs = stored(pairs, "near-pairs")
    keys = stored(pairs.select(F.col("a").alias("_key")).unionByName(pairs.select(F.col("b").alias("_key"))).distinct(),
                  "near-keys")
    words = word_table(join_checked(docs.select("_key", "text"), keys, ["_key"], "left_semi"))
    words = stored(words.dropDuplicates(["_key"]), "near-words")
    # the work is in the pairs, not in their bytes: as many tasks as the session has shuffle partitions
    with arrow_rows(docs.sparkSession, PAIR_ROWS), setting(
            docs.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        return stored(align(pairs, words, similarity), "near-links")


COUNTERS = 1 << 18     #: counters of words, a fixed size: they only order the words, so words may share one


def _labelled(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The occurrence-labelled word hashes of each text of a batch."""
    buf, off = text_bytes(batch.column("text"))
    for i, j in blocks(off):
        part, at = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        start, end, first = word_spans(part, at)
        h = word_hashes(part, start, end)
        for k in range(j - i):
            yield occurrence_labelled(h[first[k]: first[k + 1]])


def word_counters(texts: DataFrame) -> np.ndarray:
    """How many texts have a word of each counter, about. A task reports its
    own counters, ``COUNTERS`` rows at most reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for words in _labelled(batch):
                total += np.bincount((words % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["c", "n"])

    rows = texts.select("text").mapInArrow(frugal(work), "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    out = np.zeros(COUNTERS, np.int64)
    for r in rows.toLocalIterator():
        out[r["c"]] = r["n"]
    return out


def word_parity(words: np.ndarray) -> np.ndarray:
    """256 bits: for each value of some bits of a word's hash, whether the text
    has an odd number of such words. Two texts have at least as many words that
    stand in one of them alone as these bits differ."""
    odd = np.bincount((words >> np.uint64(40)).astype(np.int64) % 256, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(texts: DataFrame, counters: np.ndarray, similarity: float) -> DataFrame:
    """``_key, text`` -> ``_key, tokens, p0 .. p3``: the rarest words of a
    text, so many that any text similar enough has one of them among its own,
    and its :func:`word_parity`. Of two texts within (1 - similarity) * n edits
    each has at least similarity * n of its own n words in common, so not all
    of its other words and one more lack."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, parity = [], []
            for words in _labelled(batch):
                n = len(words)
                lead = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                order = np.lexsort((words, counters[(words % np.uint64(COUNTERS)).astype(np.int64)]))
                out.append(words[order[:lead]].view(np.int64))
                parity.append(word_parity(words))
            bits = np.array(parity, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(out, pa.list_(pa.int64())), *[pa.array(bits[:, i].copy()) for i in range(4)]],
                ["_key", "tokens", *PARITY])

    return texts.select("_key", "text").mapInArrow(
        frugal(work), "_key bigint, tokens array<bigint>, " + ", ".join(f"{p} bigint" for p in PARITY))


PARITY = ["p0", "p1", "p2", "p3"]


def prefix_table(texts: DataFrame, counters: np.ndarray, similarity: float) -> DataFrame:
    """``_key, token``: the :func:`prefixes`, a row each."""
    return prefixes(texts, counters, similarity).select("_key", F.explode("tokens").alias("token"))


def _near(x: Column, y: Column, similarity: float) -> Column:
    """Fewer words than the edits allowed between two texts can make up for
    are no pair."""
    return F.least(x, y) >= similarity * F.greatest(x, y) - 1e-9


def across(crowd: DataFrame, docs: DataFrame, links: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """``links`` and those found between the components of ``crowd`` (``_key,
    n_words, sketches``, a row for each key). Every pair of texts that have a
    bucket in common and are of different components is aligned, but for those
    ``tried`` and those that bounds rule out: words that one lacks, no rare word
    in common. A pair is met once, in the least bucket of both. The texts of a
    bucket's largest component are not paired with each other."""
    texts = join_checked(docs.select("_key", "text"), crowd.select("_key"), ["_key"], "left_semi")
    words = stored(prefixes(texts, word_counters(texts), similarity).dropDuplicates(["_key"]), "near-prefixes")
    label = components(links).select(F.col("node").alias("_key"), "label")
    one = crowd.join(words, "_key").join(label, "_key", "left").withColumn("label", F.coalesce("label", "_key"))
    one = stored(one, "near-crowd")
    at = one.select(F.explode(F.array_distinct("sketches")).alias("bucket"), "label").groupBy("bucket", "label").agg(
        F.count(F.lit(1)).alias("n"))
    most = at.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.max(F.struct("n", "label")).alias("most")).filter(
        "labels > 1").select("bucket", F.col("most.label").alias("most"))
    held = one.withColumn("bucket", F.explode(F.array_distinct("sketches"))).join(stored(most, "near-mixed"), "bucket")
    held = stored(held, "near-held")
    names = ["_key", "n_words", "sketches", "tokens", "label", *PARITY]
    x, y = (held.select("bucket", "most", *[F.col(c).alias(f"{c}_{side}") for c in names]) for side in "xy")
    x, y = x.filter("label_x <> most").drop("most"), y.withColumn("first", F.col("label_y") == F.col("most")).drop("most")
    apart = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITY), F.lit(0))
    both = F.ceil(similarity * F.greatest("n_words_x", "n_words_y") - 1e-9)     # words that stand in both at least
    met = x.join(y, (x["bucket"] == y["bucket"]) & (F.col("label_x") != F.col("label_y"))
                 & (F.col("first") | (F.col("_key_x") < F.col("_key_y")))
                 & _near(F.col("n_words_x"), F.col("n_words_y"), similarity)
                 & (F.col("n_words_x") + F.col("n_words_y") - apart >= 2 * both)
                 & (x["bucket"] == F.array_min(F.array_intersect("sketches_x", "sketches_y")))
                 & F.arrays_overlap("tokens_x", "tokens_y"))
    pairs = met.select(F.least("_key_x", "_key_y").alias("a"), F.greatest("_key_x", "_key_y").alias("b"))
    pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "near-across")
    return stored(links.unionByName(_verified(pairs, docs, similarity)), "near-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``docs``: ``key, class_id, class_size, kept``.

    ``class_id`` is the smallest key of the class; one row of each class is
    ``kept`` (that key's first). Classes are the components of: equal words,
    and alignments of at least ``similarity``.

    Null or empty text: a class of its own row. Null key: a document like any
    other, smallest last. Repeated rows (key and text): one document, of which
    one row stays. Empty table: no rows.
    """
    d = keyed(docs, key, text)
    return classes(d, similarity).select(F.col("_id").alias(key), "class_id", "class_size", "kept")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_id, _key, text``: an inner key that tells rows of one id but
    different texts apart, and gives one to a row without id."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_id"), F.xxhash64(F.col(key), body).alias("_key"), body.alias("text"))


def classes(d: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``_id, _key, class_id, class_size, kept`` for :func:`keyed` rows."""
    ids = stored(d.select("_id", "_key"), "near-ids")
    bound_batches(d.sparkSession)
    sketches = stored(sketch_table(d), "near-sketches")
    # texts of equal words: one of them stands for all
    some = sketches.filter("n_words > 0")
    equal = stored(some.select("digest", "_key").distinct().groupBy("digest").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_rep")).filter("_n > 1").select("digest", "_rep"), "near-equal")
    marked = join_checked(some, equal, ["digest"], "left")
    copies = stored(marked.filter("_rep <> _key").select("_key", "_rep").distinct(), "near-copies")
    alone = marked.filter("_rep IS NULL OR _rep = _key").select("_key", "n_words", "sketches")
    members = alone.select("_key", "n_words", F.explode("sketches").alias("bucket"))
    # 1: every member with two leaders of its bucket
    leaders = members.groupBy("bucket").agg(*[f(F.struct("_key", "n_words")).alias(n) for n, f in
                                              (("lo", F.min), ("hi", F.max))]).filter("lo._key < hi._key")
    leaders = stored(leaders.select("bucket", F.col("lo._key").alias("k1"), F.col("lo.n_words").alias("n1"),
                                    F.col("hi._key").alias("k2"), F.col("hi.n_words").alias("n2")), "near-leaders")
    met = stored(members.join(leaders, "bucket"), "near-members")
    first, second = (met.filter(_near(F.col("n_words"), F.col(n), similarity)).select(
        F.col("_key").alias("x"), F.col(k).alias("y")) for k, n in (("k1", "n1"), ("k2", "n2")))
    pairs = stored(first.unionByName(second).filter("x <> y").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "near-tries")
    links = _verified(pairs, d, similarity)
    # 2: across the components that a bucket still holds
    label = components(links)
    at = met.select("bucket", "_key", "n_words").join(label.select(F.col("node").alias("_key"), "label"), "_key", "left")
    at = stored(at.select("bucket", "_key", "n_words", F.coalesce("label", "_key").alias("label")), "near-labelled")
    mixed = at.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).filter("l1 < l2")
    crowd = stored(at.join(mixed.select("bucket"), "bucket", "left_semi").select("_key").distinct(), "near-met")
    if not crowd.isEmpty():
        crowd = stored(alone.join(crowd, "_key", "left_semi").dropDuplicates(["_key"]), "near-crowd-sketches")
        label = components(across(crowd, d, links, pairs, similarity))
    # classes: copies with their representative, representatives by their links
    whole = copies.join(label.select(F.col("node").alias("_rep"), "label"), "_rep", "left").select(
        "_key", F.coalesce("label", "_rep").alias("label"))
    whole = whole.unionByName(label.select(F.col("node").alias("_key"), "label"))
    standing = copies.select(F.col("_rep").alias("_key")).distinct().join(
        label.select(F.col("node").alias("_key")), "_key", "left_anti").select("_key", F.col("_key").alias("label"))
    whole = stored(whole.unionByName(standing), "near-classes")
    return _result(ids, whole)


def _result(ids: DataFrame, whole: DataFrame) -> DataFrame:
    """The rows of ``ids``, each with its class; keys that are not in
    ``whole`` are classes of their own."""
    rows = number_repeats(ids.join(whole, "_key", "left").withColumn("label", F.coalesce("label", "_key")), ["_key"])
    rows = stored(rows, "near-rows")
    large = stored(rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("k"))).alias(
            "_first")).filter("class_size > 1").select("label", "class_size", F.col("_first.id").alias("class_id"),
                                                       F.col("_first.k").alias("_k")), "near-large")
    out = rows.join(large, "label", "left")
    single = F.col("_k").isNull()
    return out.select("_id", "_key", "_rep", F.when(single, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("class_size", F.lit(1).cast("bigint")).alias("class_size"),
                      (single | ((F.col("_k") == F.col("_key")) & (F.col("_rep") == 0))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class. The texts are not
    shuffled: keys of removed rows are joined out."""
    d = keyed(docs, key, text)
    gone = stored(classes(d, similarity).groupBy("_key").agg(F.max("kept").alias("kept")).filter("NOT kept").select(
        "_key"), "near-gone")
    name, rep = fresh(docs, "_key"), fresh(docs, "_rep")
    rows = docs.withColumn(name, F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))))
    left = join_checked(rows, gone.withColumnRenamed("_key", name), [name], "left_anti")
    return number_repeats(left, [name], rep).filter(F.col(rep) == 0).select(*docs.columns)


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
