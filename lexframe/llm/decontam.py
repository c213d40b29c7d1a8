"""Operator 10, benchmark decontamination: BM25 over an inverted index of test
items, searched by block-max WAND.

The test items are indexed, not the corpus: every passage of every document is
a query, and all items whose score reaches ``THRESHOLD`` of the score that the
item gives itself are retrieved. Passages are runs of words that overlap by
half, and longer items are indexed in pieces of half a passage, so a copy
anywhere in a document lies whole in one of its passages.

A passage meets the index in two steps, both of which only skip what cannot
reach its threshold. A bound first: an item's rarest terms carry ``HEAVY`` of
its own score, so a passage without a certain part of those cannot reach it;
this bound is summed for all passages of a batch at once. Passages with an item
that passes the bound are then searched with block-max WAND. Retrieved items
are verified by the overlap of their question and their answer with the
document, in shingles of five words.

The index is broadcast with the tasks, in blocks of ``BLOCK_PIECES`` pieces at
most; a larger benchmark means more passes over the documents, not a larger
broadcast. No text is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, bound_batches, frugal, read, rolling, stored, text_bytes, word_hashes, word_spans

PASSAGE = 128       #: words of a passage; passages start every half of it
THRESHOLD = 0.6     #: part of an item's own score from which it is retrieved
OVERLAP = 0.8       #: part of the question's (and the answer's) shingles that must be in the document
SHINGLE = 5
HEAVY = 0.7         #: part of a piece's own score that its heavy terms carry at least
K1, B = 1.2, 0.75   #: BM25
POSTINGS = 16       #: postings of a block, for block maxima
BLOCK_PIECES = 10_000
_END = re.compile(r"(?<=[.!?])\s+")


def loose_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (letters and digits, ASCII case ignored) and the
    index of each text's first."""
    buf, off = text_bytes(texts)
    start, end, first = word_spans(buf, off, loose=True)
    return word_hashes(buf, start, end, lower=True), first


def shingles(h: np.ndarray) -> np.ndarray:
    """Distinct shingles; a text shorter than one is a shingle whole."""
    return np.unique(rolling(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, np.uint64)


def question_answer(text: str) -> tuple[str, str]:
    """An item without a column for its answer: the last sentence is the
    answer if there is more than one."""
    parts = [x for x in _END.split(text.strip()) if x]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def distinct_items(items: DataFrame, key: str, question: str, answer: str | None) -> DataFrame:
    """``item, id, q, a``: every distinct item once, under an inner number."""
    a = F.coalesce(F.col(answer), F.lit("")) if answer else F.lit("")
    some = items.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(question), F.lit("")).alias("q"),
                        a.alias("a")).distinct()
    return stored(some.withColumn("item", F.xxhash64("id", "q", "a")), "bm25-items")


def index_table(items: DataFrame) -> DataFrame:
    """Postings ``block, item, n, term, impact, self`` of the items' pieces,
    with document frequencies and lengths over all of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = loose_words(b.column("text"))
            rows: list[tuple] = []
            for i, item in enumerate(b.column("item").to_pylist()):
                own = h[first[i]: first[i + 1]]
                for n, at in enumerate(range(0, len(own), PASSAGE // 2)):
                    terms, times = np.unique(own[at: at + PASSAGE // 2], return_counts=True)
                    size = int(times.sum())
                    rows += [(item, n, t, m, size) for t, m in zip(terms.view(np.int64).tolist(), times.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                    (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))], ["item", "n", "term", "tf", "len"])

    rows = items.select("item", F.concat_ws(" ", "q", "a").alias("text")).mapInArrow(
        frugal(cut), "item bigint, n int, term bigint, tf int, len int")
    rows = stored(rows, "bm25-terms")
    pieces = rows.groupBy("item", "n").agg(F.max("len").alias("len"))
    all_ = pieces.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("mean")).first()
    total, mean = all_["N"], all_["mean"] or 1.0
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    out = rows.join(df, "term").withColumn("impact", impact)
    w = Window.partitionBy("item", "n")
    count = max(1, -(-total // BLOCK_PIECES))
    return stored(out.select(
        F.pmod(F.xxhash64("item", "n"), F.lit(count)).cast("int").alias("block"), "item", "n", "term", "impact",
        F.sum("impact").over(w).alias("self")), "bm25-index")


@dataclass
class Index:
    """A block of the index. Pieces are numbered 0..; ``terms`` is sorted.
    ``lists[t]`` are a term's postings (pieces ascending, impacts as parts of
    the piece's threshold), ``most[t]`` their maximum, ``maxima[t]`` the maxima
    of their blocks with the last piece of each."""

    terms: np.ndarray
    items: np.ndarray           # item of a piece
    lists: list[tuple[list[int], list[float]]]
    most: list[float]
    maxima: list[tuple[list[int], list[float]]]
    # heavy postings of a term: where they start, their pieces and impacts; what a piece needs of them
    heavy_at: np.ndarray
    heavy_piece: np.ndarray
    heavy_impact: np.ndarray
    heavy_need: np.ndarray


def build(item: np.ndarray, n: np.ndarray, term: np.ndarray, impact: np.ndarray, own: np.ndarray) -> Index:
    """An :class:`Index` from postings in any order."""
    pieces, piece = np.unique(np.stack([item, n], axis=1), axis=0, return_inverse=True)
    piece = piece.reshape(-1)
    terms, number = np.unique(term.view(np.uint64), return_inverse=True)
    share = impact / (THRESHOLD * own)          # a piece is retrieved when its shares reach 1
    order = np.lexsort((piece, number))
    piece, number, share = piece[order], number[order], share[order]
    edge = np.searchsorted(number, np.arange(len(terms) + 1))
    lists, most, maxima = [], [], []
    for a, b in zip(edge, edge[1:]):
        p, s = piece[a:b].tolist(), share[a:b].tolist()
        lists.append((p, s))
        most.append(max(s))
        cuts = range(0, len(p), POSTINGS)
        maxima.append(([p[min(c + POSTINGS, len(p)) - 1] for c in cuts], [max(s[c: c + POSTINGS]) for c in cuts]))
    # a piece's heavy terms: its largest shares, until they carry HEAVY of its own score
    rank = np.lexsort((-share, piece))
    first = np.searchsorted(piece[rank], np.arange(len(pieces)))
    run = np.cumsum(share[rank])
    before = run - share[rank] - np.repeat(np.concatenate([[0.0], run])[first], np.diff(np.append(first, len(rank))))
    heavy = np.zeros(len(share), bool)
    heavy[rank] = before < HEAVY / THRESHOLD - 1e-12
    light = np.bincount(piece[~heavy], weights=share[~heavy], minlength=len(pieces))
    at = np.searchsorted(number[heavy], np.arange(len(terms) + 1))
    return Index(terms, pieces[:, 0], lists, most, maxima, at, piece[heavy], share[heavy], 1 - light - 1e-9)


def bounded(index: Index, words: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
    """(text, passage) of every passage that may reach the threshold of some
    piece: the heavy terms in it, counted as often as they occur, bring what
    the piece's other terms cannot."""
    if not len(index.terms) or not len(words):
        return set()
    t = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[t] == words)
    t = t[hit]
    count = index.heavy_at[t + 1] - index.heavy_at[t]
    hit, t, count = hit[count > 0], t[count > 0], count[count > 0]
    if not len(hit):
        return set()
    # one event for each heavy posting of each occurrence
    which = np.repeat(index.heavy_at[t] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    place = np.repeat(hit, count)
    piece, impact = index.heavy_piece[which], index.heavy_impact[which]
    text = np.searchsorted(first, place, "right") - 1
    step = (place - first[text]) // (PASSAGE // 2)
    # a word lies in the passage that starts in its half and in the one before
    text, step = np.concatenate([text, text]), np.concatenate([step, step - 1])
    piece, impact = np.concatenate([piece, piece]), np.concatenate([impact, impact])
    wide = int(step.max()) + 2
    keys, at = np.unique(((text * wide + step + 1) * len(index.items)) + piece, return_inverse=True)
    reached = np.bincount(at.reshape(-1), weights=impact) >= index.heavy_need[keys % len(index.items)]
    own = keys[reached] // len(index.items)
    return set(zip((own // wide).tolist(), np.maximum(own % wide - 1, 0).tolist()))


def block_max_wand(index: Index, query: np.ndarray) -> list[tuple[int, float]]:
    """All (piece, score) with a score of at least 1, scores being parts of the
    pieces' thresholds. ``query``: distinct word hashes.

    Lists are kept in the order of their current pieces. The pivot is the first
    piece at which the lists' maxima add up to 1; if the maxima of the blocks
    that hold it do not, everything up to the nearest block end is skipped.
    """
    t = np.searchsorted(index.terms, query)
    t = np.minimum(t, len(index.terms) - 1)
    open_ = [[index.lists[i][0][0], 0, 0, i] for i in t[index.terms[t] == query].tolist()]  # piece, at, block, term
    found, least = [], 1 - 1e-9

    def forward(c: list[int], piece: int) -> bool:
        """Move a list to the first posting at or after ``piece``."""
        p = index.lists[c[3]][0]
        at = c[1]
        while at < len(p) and p[at] < piece:
            at += 1
        c[1] = at
        if at == len(p):
            return False
        c[0] = p[at]
        return True

    while open_:
        open_.sort()
        bound, pivot = 0.0, None
        for i, c in enumerate(open_):
            bound += index.most[c[3]]
            if bound >= least:
                pivot = i
                break
        if pivot is None:
            break
        piece = open_[pivot][0]
        while pivot + 1 < len(open_) and open_[pivot + 1][0] == piece:
            pivot += 1
        bound, end = 0.0, None
        for c in open_[: pivot + 1]:
            ends, tops = index.maxima[c[3]]
            while c[2] < len(ends) and ends[c[2]] < piece:
                c[2] += 1
            if c[2] < len(ends):
                bound += tops[c[2]]
                end = ends[c[2]] if end is None else min(end, ends[c[2]])
        if bound >= least:
            score, goal = 0.0, piece + 1
            kept = []
            for c in open_[: pivot + 1]:
                if c[0] < piece and not forward(c, piece):
                    continue
                if c[0] == piece:
                    score += index.lists[c[3]][1][c[1]]
                kept.append(c)
            if score >= least:
                found.append((piece, score))
        else:  # no piece up to the end of the nearest block can be reached by these lists
            goal, kept = (piece if end is None else end) + 1, open_[: pivot + 1]
            if pivot + 1 < len(open_):
                goal = max(min(goal, open_[pivot + 1][0]), piece + 1)
        open_ = [c for c in kept if c[0] >= goal or forward(c, goal)] + open_[pivot + 1:]
    return found


#: An item's id and the shingles of its question and its answer.
Parts = dict[int, tuple[int | None, np.ndarray, np.ndarray]]


def load_blocks(items: DataFrame, key: str, question: str, answer: str | None) -> Iterator[tuple[Index, Parts]]:
    """Each block of the index with its items' parts. One block at a time is
    on the driver."""
    items = distinct_items(items, key, question, answer)
    table = index_table(items)
    for b in [r[0] for r in table.select("block").distinct().orderBy("block").collect()]:
        own = table.filter(F.col("block") == b)
        rows = own.toPandas()
        index = build(rows["item"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["term"].to_numpy(np.int64),
                      rows["impact"].to_numpy(np.float64), rows["self"].to_numpy(np.float64))
        parts: Parts = {}
        for r in items.join(own.select("item").distinct(), "item", "left_semi").collect():
            q, a = (r["q"], r["a"]) if answer else question_answer(r["q"])
            h, first = loose_words(pa.array([q, a]))
            parts[r["item"]] = (r["id"], shingles(h[: first[1]]), shingles(h[first[1]:]))
        yield index, parts


def overlap(wanted: np.ndarray, there: np.ndarray) -> float:
    """Part of ``wanted`` that is in the sorted array ``there``; 1 of nothing."""
    if not len(wanted):
        return 1.0
    if not len(there):
        return 0.0
    at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
    return float((there[at] == wanted).mean())


def search(index: Index, parts: Parts, texts: pa.Array) -> list[tuple[int, int | None, float, float, float]]:
    """(row, item, score, question overlap, answer overlap) of every retrieved
    item, the score being the best of the row's passages."""
    out = []
    buf, off = text_bytes(texts)
    for i, j in blocks(off):
        part, at = buf[off[i]: off[j]], off[i: j + 1] - off[i]
        start, end, first = word_spans(part, at, loose=True)
        words = word_hashes(part, start, end, lower=True)
        best: dict[tuple[int, int], float] = {}
        for text, passage in bounded(index, words, first):
            lo = first[text] + passage * (PASSAGE // 2)
            query = np.unique(words[lo: min(lo + PASSAGE, first[text + 1])])
            for piece, score in block_max_wand(index, query):
                k = (text, int(index.items[piece]))
                best[k] = max(best.get(k, 0.0), score * THRESHOLD)
        held, seen = -1, np.empty(0, np.uint64)
        for (text, item), score in sorted(best.items()):
            own = words[first[text]: first[text + 1]]
            if text != held:
                held, seen = text, np.unique(rolling(own, SHINGLE)) if len(own) >= SHINGLE else np.empty(0, np.uint64)
            number, *wanted = parts[item]
            # a part shorter than a shingle is looked for whole, at its own length
            out.append((i + text, number, score, *[overlap(x, seen) if len(x) != 1 else _short(x, own, seen) for x in wanted]))
    return out


def _short(one: np.ndarray, own: np.ndarray, seen: np.ndarray) -> float:
    if overlap(one, seen) == 1.0:
        return 1.0
    return float(any(one[0] in rolling(own, k) for k in range(1, min(SHINGLE, len(own) + 1))))



def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 question: str = "text", answer: str | None = None) -> DataFrame:
    """``key, item_id, score, question_overlap, answer_overlap``: a row for each
    document and item whose question and answer both overlap by ``OVERLAP``.

    Null or empty documents and items without words are in no row. Null ids
    are kept as they are. Repeated documents give their rows again, a repeated
    item counts once. An empty benchmark or table gives no rows.
    """
    bound_batches(docs.sparkSession)
    out = None
    kind = docs.schema[key].dataType.simpleString()
    for index, parts in load_blocks(items, key=item, question=question, answer=answer):

        def work(batches: Iterator[pa.RecordBatch], index=index, parts=parts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [r for r in search(index, parts, b.column("text")) if min(r[3], r[4]) >= OVERLAP]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array([r[0] for r in rows], pa.int64())),
                     *[pa.array([r[c] for r in rows], t) for c, t in
                       enumerate((None, pa.int64(), pa.float64(), pa.float64(), pa.float64())) if c]],
                    ["id", "item_id", "score", "question_overlap", "answer_overlap"])

        schema = f"id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double"
        one = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(frugal(work), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        schema = f"id {kind}, item_id bigint, score double, question_overlap double, answer_overlap double"
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", key)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id",
                      question: str = "text", answer: str | None = None) -> DataFrame:
    """The rows of ``docs`` without those that carry an item; all columns pass
    through one map, nothing is joined or shuffled."""
    bound_batches(docs.sparkSession)
    out = docs
    for index, parts in load_blocks(items, key=item, question=question, answer=answer):

        def work(batches: Iterator[pa.RecordBatch], index=index, parts=parts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                gone = {r[0] for r in search(index, parts, b.column(text)) if min(r[3], r[4]) >= OVERLAP}
                yield b.filter(pa.array([i not in gone for i in range(b.num_rows)], pa.bool_()))

        out = out.mapInArrow(frugal(work), docs.schema)
    return out


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
