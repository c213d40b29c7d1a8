"""Decontamination: block-max WAND against a full scan, planted and clean documents."""

import random

import awkward
import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM, SMALL
from lexframe.llm import decontam as D
from pyspark.sql import functions as F


def random_index(rng, pieces, vocabulary):
    rows = []
    for p in range(pieces):
        terms = rng.sample(range(1, vocabulary), rng.randint(3, 25))
        impacts = [rng.random() * (5 if t > vocabulary // 2 else 0.5) + 0.01 for t in terms]
        rows += [(p, 0, t, i, sum(impacts)) for t, i in zip(terms, impacts)]
    rng.shuffle(rows)
    return [np.array(c, t) for c, t in zip(zip(*rows), (np.int64, np.int64, np.int64, float, float))]


@pytest.mark.parametrize("seed", range(6))
def test_block_max_wand_finds_all_above_threshold(seed):
    rng = random.Random(seed)
    item, n, term, impact, own = random_index(rng, 300, 120)
    index = D.build(item, n, term, impact, own)
    some = 0
    for _ in range(150):
        query = np.array(sorted(rng.sample(range(1, 130), rng.randint(1, 60))), np.uint64)
        hit = np.isin(term.view(np.uint64), query)
        score = np.bincount(item[hit], weights=impact[hit] / (D.THRESHOLD * own[hit]), minlength=300)
        want = {p: s for p, s in enumerate(score) if s >= 1 - 1e-9}
        got = dict(D.block_max_wand(index, query))
        assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)
        some += len(want)
        # the bound keeps every passage that has something to find
        assert not want or D.bounded(index, query, np.array([0, len(query)])) == {(0, 0)}
    assert some > 20


def test_planted_items_are_found_and_nothing_else(spark):
    for folder in (SMALL, MEDIUM):
        docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
        got = {(r["doc_id"], r["item_id"]) for r in D.op10_bm25_decontamination(spark, folder).collect()}
        exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
        words = lambda t: D.loose_words(pa.array([t]))[0]
        grams = {i: [set(D.shingles(words(x)).tolist()) for x in D.question_answer(t)] for i, t in items.items()}
        want = set()
        for d, t in docs.items():
            there = set(D.rolling(words(t), 5).tolist())
            want |= {(d, i) for i, (q, a) in grams.items() if q and len(q & there) >= 0.8 * len(q)
                     and len(a & there) >= 0.8 * len(a)}
        assert exact <= got and got >= want and all(
            len((grams[i][0] | grams[i][1]) & set(D.rolling(words(docs[d]), 5).tolist())) >= 3 for d, i in got)
        assert len(exact) >= 3 and len(got) <= len(exact) + 3


def test_long_items_question_and_answer(spark):
    rng = random.Random(4)
    w = lambda n: " ".join(f"q{rng.randrange(10**6)}" for _ in range(n))
    question, answer, other = w(300), w(6), w(40)
    items = spark.createDataFrame([(1, question, answer), (2, other, None), (3, w(30), "yes"), (4, None, None), (5, "", "")],
                                  "id long, question string, answer string")
    docs = [(1, w(500) + " " + question.upper().replace(" ", ", ") + " " + answer + " " + w(200)),
            (2, w(100) + question + w(20)), (3, answer + " " + w(90)), (4, w(61) + " " + other + w(5)), (5, w(400)),
            (6, other), (7, None), (8, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(
        d, items, item="id", question="question", answer="answer").collect()}
    assert got == {(1, 1), (4, 2), (6, 2)}
    left = D.drop_contaminated(d, items, item="id", question="question", answer="answer")
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 5, 7, 8]


def test_blocks_of_the_index_agree_with_one(spark, monkeypatch):
    one = sorted(tuple(r)[:2] for r in D.op10_bm25_decontamination(spark, SMALL).collect())
    monkeypatch.setattr(D, "BLOCK_PIECES", 15)
    assert sorted(tuple(r)[:2] for r in D.op10_bm25_decontamination(spark, SMALL).collect()) == one


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet")
    text = awkward.rows()[0][1]
    items = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, "!!"), (4, "one")],
                                  "item_id long, text string")
    got = D.contaminated(d, items)
    assert {r["doc_id"] for r in got.collect()} == {1, 2, None, 8, 9}
    left = D.drop_contaminated(d, items)
    assert left.columns == d.columns and sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted(
        (3, 4, 5, None, 6, 7), key=repr)
    assert D.contaminated(d.filter(F.lit(False)), items).count() == 0
    assert D.contaminated(d, items.filter(F.lit(False))).count() == 0
    assert D.drop_contaminated(d, items.filter(F.lit(False))).count() == len(awkward.rows())
