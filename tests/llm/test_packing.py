"""Packing: the round trip and the fit."""

import random

import awkward
import numpy as np
from conftest import SMALL
from lexframe.llm import packing as P
from pyspark.sql import functions as F


def test_best_fit_against_a_plain_search():
    rng = random.Random(2)
    for _ in range(60):
        length = rng.choice((5, 16, 100))
        sizes = np.array([rng.randint(1, length) for _ in range(rng.randint(1, 80))])
        rooms, rows = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fit = [r for r in rooms if r >= sizes[k]]
            if fit:
                i = max(j for j, r in enumerate(rooms) if r == min(fit))
            else:
                i = len(rooms)
                rooms.append(length)
                rows.append([])
            rooms[i] -= sizes[k]
            rows[i].append(k)
        got = P.best_fit_decreasing(sizes, length)
        assert sorted(k for r in got for k in r) == list(range(len(sizes)))
        assert all(sizes[r].sum() <= length for r in got) and len(got) == len(rows)
        assert sorted(int(sizes[r].sum()) for r in got) == sorted(int(sizes[r].sum()) for r in rows)


def whole(rows, length=P.LENGTH):
    """Each document's ids, put together from the rows."""
    parts = {}
    for r in rows:
        ids, pos = (np.frombuffer(r[c], "<i4") for c in ("input_ids", "position_ids"))
        cu = r["cu_seqlens"]
        assert cu[0] == 0 and cu[-1] == len(ids) == len(pos) == r["n_tokens"] <= length and len(cu) == r["n_segments"] + 1
        for a, b, d, n, s in zip(cu, cu[1:], r["doc_ids"], r["pieces"], r["starts"]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, []).append((n, s, ids[a:b].tolist()))
    return {d: sorted(p) for d, p in parts.items()}


def test_long_runs_of_white_space():
    whole, parts = P.encoder(longest=1 << 30), P.encoder()
    for run in (" ", "\n", " \n\t", "\u3000 "):
        for n in (P.LONG_RUN - 1, P.LONG_RUN, P.LONG_RUN + 1, 400_000):
            w = (run * n)[:n]
            for text in (w, w + "end", "it's" + w, "a." + w + "b 1" + w + "\x1c" + w + "!", w + "\u200b" + w):
                assert parts(text) == whole(text)
    small = P.encoder(longest=3)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t\xa0\x1fa1.'s") for _ in range(rng.randint(0, 30)))
        assert small(text) == whole(text)
    for run in (" ", "\n", " \t"):
        w = run * (2_000_000 // len(run))
        for text in (w + "x", "x" + w + "x", "x" + w):
            assert len(parts(text)) > 1000


def test_long_run_is_packed(spark):
    d = spark.createDataFrame([(1, "a" + " " * 1_200_000 + "b")], "doc_id bigint, text string")
    got = whole(P.pack(d).collect())
    assert [x for p in got[1] for x in p[2]] == [*P.encoder()("a" + " " * 1_200_000 + "b"), P.END]


def test_round_trip(spark):
    encode = P.encoder()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = P.op2_token_packing(spark, SMALL).collect()
    got = whole(rows)
    assert got.keys() == docs.keys()
    for d, parts in got.items():
        assert [p[1] for p in parts] == [i * P.LENGTH for i in range(len(parts))]
        assert [x for p in parts for x in p[2]] == [*encode(docs[d]), P.END]
    total = sum(r["n_tokens"] for r in rows)
    assert total >= 0.97 * P.LENGTH * len(rows)


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet")
    rows = P.pack(d, length=64, window=500).collect()
    got = whole(rows, 64)
    assert sum(len(p) for p in got.values()) == sum(r["n_segments"] for r in rows)
    assert [x[2] for x in got[4]] == [[P.END]] and [x[2] for x in got[3]] == [[P.END]] and len(got[None]) > 1
    encode = P.encoder()
    assert [x for p in got[6] for x in p[2]] == [*encode(awkward.LONG), P.END]
    assert sum(p[0] == 0 for p in got[2]) == 2
    assert P.pack(d.filter(F.lit(False))).count() == 0
