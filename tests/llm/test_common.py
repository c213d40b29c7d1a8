"""The shared helpers: words of Arrow batches, repeats, checked joins."""

import re

import numpy as np
import pyarrow as pa
from lexframe.llm import common

TEXTS = ["one two  two\tthree\n", None, "", " x", "é é\U0001f600 É", "a" * 70 + " b", "two", "One-two, TWO ", "\x0b\x0c\r"]


def words(texts, loose=False):
    buf, off = common.text_bytes(pa.array(texts))
    start, end, first = common.word_spans(buf, off, loose)
    return buf, start, end, first, common.word_hashes(buf, start, end, loose)


def test_words_are_found_and_hashed():
    buf, start, end, first, h = words(TEXTS)
    got = [[bytes(buf[s:e]).decode() for s, e in zip(start[a:b], end[a:b])] for a, b in zip(first, first[1:])]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    flat = [w for row in got for w in row]
    for i, w in enumerate(flat):
        for j, v in enumerate(flat):
            assert (h[i] == h[j]) == (w == v)


def test_loose_words_ignore_case_and_marks():
    _, _, _, first, h = words(["One-two, TWO", "one two two"], loose=True)
    assert h[first[0]: first[1]].tolist() == h[first[1]: first[2]].tolist()


def test_hash_does_not_depend_on_the_place(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    _, _, _, _, whole = words([text])
    monkeypatch.setattr(common, "_STRETCH", 37)
    _, _, _, _, short = words([None, "zz", text])
    assert whole.tolist() == short[1:].tolist() and len(set(whole.tolist())) == 50


def test_slices_and_blocks():
    a = pa.array(TEXTS).slice(3, 4)
    buf, off = common.text_bytes(a)
    assert bytes(buf).decode() == "".join(TEXTS[3:7])
    assert [x for i, j in common.blocks(off, 20) for x in range(i, j)] == [0, 1, 2, 3]


def test_rolling_hash_is_ordered():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    r = common.rolling(h, 3)
    assert r[0] == r[3] and len(set(r.tolist())) == 5 and len(common.rolling(h, 9)) == 0


def test_repeats_and_checked_joins(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (None, "a", 7), (None, "a", 8), (2, None, 9)], "k long, s string, v long")
    got = sorted((r["v"], r["_rep"]) for r in common.number_repeats(d, ["k", "s"]).collect())
    assert sorted(x for v, x in got if v < 7) == [0, 1] and sorted(x for v, x in got if 7 <= v < 9) == [0, 1]
    small = spark.createDataFrame([(None, "a", 1.0), (2, None, 2.0)], "k long, s string, w double")
    for rows in (10, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
        out = common.join_checked(d, small, ["k", "s"], "left")
        assert out.columns == ["k", "s", "v", "w"]
        assert sorted((r["v"], r["w"] or 0) for r in out.collect()) == [(5, 0), (6, 0), (7, 1.0), (8, 1.0), (9, 2.0)]
        assert common.join_checked(d, small, ["k", "s"], "left_anti").count() == 2
