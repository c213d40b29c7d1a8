"""Importance resampling against a plain version that hashes every feature."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import awkward
import numpy as np
from conftest import SMALL
from lexframe.llm import importance as I
from pyspark.sql import functions as F


def plain_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    runs = [" ".join(words[i: i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def plain(rows, target):
    """[(doc_id, n_features, weight, score, rank)] in the order of ``rows``."""
    made = [plain_features(t) for _, t in rows]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in plain_features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for (k, _), (n, f) in zip(rows, made):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in out]


def test_crc_of_runs():
    rng = random.Random(5)
    words = ["".join(rng.choice("ab9é漢\U0001f600") for _ in range(rng.choice((1, 2, 7, 30, 70, 300)))) for _ in range(300)]
    for some in ([], ["a"], ["a", "b"], words):
        text = " , ".join(some)
        first, buckets = I.features(I.splitter(), [b"", text.encode(), b"--", b"Q q"])
        lo, hi = first[1], first[2]
        assert hi - lo == len(some) and first[0] == lo and first[2] == first[3]
        for k, b in enumerate(buckets):
            want = [zlib.crc32(" ".join(some[i: i + k + 1]).encode()) % 10_000 for i in range(len(some) - k)]
            assert b[lo: lo + len(want)].tolist() == want


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "".join(random.Random(1).choice("ab é-\x00") for _ in range(4000)) + "z" * 900 + " end"
    whole = I.offsets(I.splitter(), text)
    assert [text[a:b] for a, b in whole] == re.findall(I.WORD, text)
    monkeypatch.setattr(I, "STRETCH", 50)
    assert np.array_equal(I.offsets(I.splitter(), text), whole)


def test_whole_table(spark):
    read = lambda n: spark.read.parquet(f"{SMALL}/{n}.parquet").collect()
    rows = [(r["doc_id"], r["text"]) for r in read("documents")]
    want = plain(rows, [r["text"] for r in read("benchmark")])
    got = I.op12_importance_resampling(spark, SMALL)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(r[4] is not None for r in want) > 5


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    extra = [(100 + i, f"{'filler word ' * 12} Item{i % 3} QUESTION") for i in range(60)] + [(170, "aßẞÀÉ" * 3), (171, "x\x00y")]
    d = d.select("doc_id", "text", F.lit(1).alias("weight"), F.lit(2).alias("_drawn"), F.lit(3).alias("_rep")).unionByName(
        spark.createDataFrame(extra, "doc_id long, text string").select("*", *[F.lit(i).alias(c) for i, c in enumerate(("weight", "_drawn", "_rep"), 1)]))
    items = spark.createDataFrame([("the question item1",), (None,), ("",)], "text string")
    want = plain(rows + extra, [r["text"] for r in items.collect()])
    got = I.importance(d, items).drop("n_words")
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(want)
    drawn = I.resample(d, items, percent=50)
    assert drawn.columns == d.columns and drawn.count() == I.importance(d, items, percent=50).filter("rank IS NOT NULL").count() > 20
    assert {tuple(r[2:]) for r in drawn.collect()} == {(1, 2, 3)}
    none = d.filter(F.lit(False))
    assert I.importance(none, items).count() == 0 and I.importance(d, items.filter(F.lit(False))).count() == d.count()
