"""Operator 6, quality rules: distribution divergence.

A document is compared with its language: the histogram of its character
classes and the histogram of its common words, each against the language's
reference, by Jensen-Shannon distance (base 2, so 0 to 1). References are
counts over all documents. A document too short for a histogram to mean much
is not judged by it.

The common words of a language are those with at least ``COMMON`` of all its
words. They are found exactly and in bounded memory: a word that reaches the
share over everything reaches it in at least one block of the words, so every
task reports the words that reach it in a block of its own, and a second pass
counts the reported words everywhere.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, bound_batches, frugal, read, stored, text_bytes, word_hashes, word_spans

COMMON = 0.002          #: share of a language's words that makes a word common
LEAST_LANGUAGE = 5_000  #: words that give a language a reference of its own, whatever the others have
BLOCK_WORDS = 1 << 20   #: words counted at a time
MAX_CLASS_DISTANCE = 0.3    #: Jensen-Shannon distance of character classes
MAX_WORD_DISTANCE = 0.3     #: Jensen-Shannon distance of common words in a long text ...
SHORT_TEXT = 0.7            #: ... to which this over the root of the words is added, as a short sample differs by chance
LEAST_CHARS = 200       #: characters from which character classes are judged
LEAST_WORDS = 60        #: words from which common words are judged
LEAST_KEPT_WORDS = 20   #: the base rule: fewer words fail
MOST_REPEATED = 30      #: the base rule: per cent of words in repeated windows
WINDOW = 8              #: words of a repeated window
SYMBOLS = "#*$%&|<>"    # fixed value

#: Character classes by byte: lower, upper, digit, space, end of line, sentence marks, other marks, symbols, non-ASCII
#: lead bytes, other bytes. Continuation bytes belong to their lead byte and are not counted.
CLASSES = 10


def _classes() -> np.ndarray:
    c = np.full(256, 9, np.uint8)
    for cls, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t",
                                 b"\n\r", b".,;:!?'\"()-", b"/\\[]{}@^_`~+=", SYMBOLS.encode())):
        c[list(chars)] = cls
    c[192:] = 8
    c[128:192] = CLASSES
    return c


_CLASS = _classes()
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of ``WINDOW`` words which occurs at least
    twice, given a number for each word (equal words, equal numbers)."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i: i + n].astype(np.uint64) + np.uint64(1)
            h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    s = h[order]
    twin = s[1:] == s[:-1]
    if not twin.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][twin]] = True
    maybe[order[:-1][twin]] = True
    at = np.flatnonzero(maybe)
    times = Counter(w.tobytes() for w in np.ascontiguousarray(windows[at]))  # equal hashes are not yet equal windows
    covered = np.zeros(len(ids) + 1, np.int64)
    for i, w in zip(at, np.ascontiguousarray(windows[at])):
        if times[w.tobytes()] > 1:
            covered[i] += 1
            covered[i + WINDOW] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if _WORD.search(x)] if "\n" in text else ()
    return len(lines) - len(set(lines))


def class_counts(buf: np.ndarray) -> np.ndarray:
    return np.bincount(_CLASS[buf], minlength=CLASSES + 1)[:CLASSES]


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2) of two histograms of counts."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return math.sqrt(max(0.0, (a + b) / 2))


def common_words(docs: DataFrame) -> DataFrame:
    """``lang, word`` (lower-cased): a superset of the common words of every
    language that has a reference, at most 1 / COMMON a language and block."""

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str | None, Counter] = {}
        found: set[tuple[str | None, str]] = set()
        held = 0

        def close() -> None:
            for lang, c in counts.items():
                least = COMMON * c.total()
                found.update((lang, w) for w, n in c.items() if n >= least)
            counts.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                words = _WORD.findall((text or "").lower())
                counts.setdefault(lang, Counter()).update(words)
                held += len(words)
                if held >= BLOCK_WORDS:
                    close()
                    held = 0
        close()
        rows = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.string())], ["lang", "word"])

    return docs.select("lang", "text").mapInArrow(frugal(report), "lang string, word string").distinct()


def language_counts(docs: DataFrame, vocabulary: dict[str | None, list[str]]) -> DataFrame:
    """``lang, word, n``: in every language, the occurrences of its reported
    words, of all words (word null) and of the character classes (word is the
    class's number after a space)."""
    known = {lang: set(words) for lang, words in vocabulary.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str | None, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                c, keep = total.setdefault(lang, Counter()), known.get(lang, ())
                words = _WORD.findall((text or "").lower())
                c.update([w for w in words if w in keep])
                c[None] += len(words)
                for i, n in enumerate(class_counts(np.frombuffer((text or "").encode(), np.uint8))):
                    c[f" {i}"] += int(n)
        rows = [(lang, w, n) for lang, c in total.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                          enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    parts = docs.select("lang", "text").mapInArrow(frugal(count), "lang string, word string, n bigint")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


#: A reference: common words with their columns, their counts with all others last, class counts.
Reference = tuple[dict[str, int], np.ndarray, np.ndarray]


def references(docs: DataFrame) -> dict[str | None, Reference]:
    """A reference for every language of ``LEAST_LANGUAGE`` words, however many
    the others have; 1 / COMMON words of each at most are kept."""
    sizes = stored(docs.select("lang", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORD.pattern)).alias(
        "n")).groupBy("lang").agg(F.sum("n").alias("n")), "quality-languages")
    large = [r["lang"] for r in sizes.filter(F.col("n") >= LEAST_LANGUAGE).collect()]
    wanted = F.coalesce(F.col("lang").isin([x for x in large if x is not None]), F.lit(None in large))
    reported: dict[str | None, list[str]] = {lang: [] for lang in large}
    for r in stored(common_words(docs.filter(wanted)), "quality-words").collect():
        reported[r["lang"]].append(r["word"])
    counts = stored(language_counts(docs.filter(wanted), reported), "quality-counts")
    by: dict[str | None, dict] = {}
    for r in counts.collect():
        by.setdefault(r["lang"], {})[r["word"]] = r["n"]
    out: dict[str | None, Reference] = {}
    for lang, c in by.items():
        total, own = c.pop(None, 0), np.array([c.pop(f" {i}", 0) for i in range(CLASSES)], float)
        words = sorted(w for w, n in c.items() if n >= COMMON * total)
        seen = [c[w] for w in words]
        out[lang] = ({w: i for i, w in enumerate(words)}, np.array([*seen, total - sum(seen)], float), own)
    return out


RESULT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double")


def judge(docs: DataFrame, refs: dict[str | None, Reference]) -> DataFrame:
    """``RESULT`` for every row of ``docs`` (doc_id, lang, text). A distance is
    null where a guard or a missing reference leaves it unjudged."""

    nothing: Reference = ({}, np.zeros(1), np.zeros(CLASSES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, off = text_bytes(b.column("text"))
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            out: list[tuple] = []
            for i, j in blocks(off):
                part, at = buf[off[i]: off[j]], off[i: j + 1] - off[i]
                start, end, first = word_spans(part, at)
                ids = word_hashes(part, start, end)
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before each byte
                length = np.concatenate([[0], np.cumsum(chars[end] - chars[start])])
                marks = np.concatenate([[0], np.cumsum(_IS_SYMBOL[part])])
                for k in range(i, j):
                    lo, hi = first[k - i], first[k - i + 1]
                    text, mine = texts[k] or "", ids[lo:hi]
                    repeated = repeated_words(mine)
                    n = int(hi - lo)
                    failed = n < LEAST_KEPT_WORDS or 100 * repeated > MOST_REPEATED * n
                    words, word_ref, class_ref = refs.get(langs[k]) or nothing
                    own = class_counts(part[at[k - i]: at[k - i + 1]])
                    by_class = by_word = None
                    if own.sum() >= LEAST_CHARS and class_ref.sum() > 0:
                        by_class = divergence(own, class_ref)
                    if n >= LEAST_WORDS and words:
                        seen = np.zeros(len(word_ref))
                        for w, m in Counter(_WORD.findall(text.lower())).items():
                            seen[words.get(w, -1)] += m
                        by_word = divergence(seen, word_ref)
                    kept = not failed and (by_class is None or by_class <= MAX_CLASS_DISTANCE) and (
                        by_word is None or by_word <= MAX_WORD_DISTANCE + SHORT_TEXT / math.sqrt(n))
                    out.append((n, int(length[hi] - length[lo]), int(marks[at[k - i + 1]] - marks[at[k - i]]),
                                duplicate_lines(text), repeated, failed, kept, by_class, by_word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [f.strip().split(" ")[0] for f in RESULT.split(",")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()),
                 *[pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]], names)

    return docs.select("doc_id", "lang", "text").mapInArrow(frugal(rows), RESULT)


def quality(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Judge every row of ``docs`` against references from the same rows.

    Three reads of the texts, none of them shuffled. Null or empty text: no
    words, so the base rule fails it. Null language: a language. A language
    below ``LEAST_LANGUAGE``: judged by the base rule alone.
    Repeated rows: a result each. Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    d = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return judge(d, references(d)).withColumnRenamed("doc_id", key)


def op6_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"))
