"""Quality rules: base counts by brute force, divergence on planted junk."""

import re

import awkward
import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from lexframe.llm.quality import divergence, op6_quality_divergence, quality
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def base(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_base_counts(spark, folder):
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op6_quality_divergence(spark, folder).collect()
    assert len(rows) == len(d)
    for r in rows:
        assert base(r) == brute(d[r["doc_id"]]), r["doc_id"]
        assert not (r["base_failed"] and r["kept"])


def test_divergence():
    p = np.array([1.0, 2.0, 0.0])
    assert divergence(p, 3 * p) == pytest.approx(0, abs=1e-9)
    assert divergence(p, np.array([0.0, 0.0, 5.0])) == pytest.approx(1)


def test_junk_goes_and_clean_documents_stay(spark):
    """By the labels: documents of quality 1 that pass the base rule stay."""
    rows = op6_quality_divergence(spark, MEDIUM).join(
        spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    clean, junk = [r["kept"] for r in rows if r["quality"]], [r["kept"] for r in rows if not r["quality"]]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_small_language_among_large_ones(spark, monkeypatch):
    """A small language is not judged by the characters of the others, and has
    a reference from its own words on, whatever its share."""
    import random

    from lexframe.llm import quality as Q

    rng = random.Random(1)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=6)) for _ in range(n))
    greek, latin = "αβγδεζηθικλμνξοπρστυφχψω", "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "en", text(latin, 2000)) for i in range(300)] + [(400 + i, "el", text(greek, 90)) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    small = {r["doc_id"]: r for r in quality(d).filter("doc_id >= 400").collect()}
    assert all(r["kept"] and r["class_distance"] is None and r["word_distance"] is None for r in small.values())
    monkeypatch.setattr(Q, "LEAST_LANGUAGE", 270)
    small = quality(d).filter("doc_id >= 400").collect()
    assert len(small) == 3 and all(r["class_distance"] < 0.1 and r["word_distance"] is not None for r in small)


def test_awkward_rows(spark, tmp_path):
    folder = awkward.table(spark, tmp_path)
    rows = op6_quality_divergence(spark, folder).collect()
    want = sorted(((r[0], *brute(r[1])) for r in awkward.rows()), key=repr)
    assert sorted(((r["doc_id"], *base(r)) for r in rows), key=repr) == want
    d = spark.read.parquet(f"{folder}/documents.parquet")
    assert quality(d.filter(F.lit(False))).count() == 0
