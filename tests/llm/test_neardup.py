"""Near-duplicates against all pairs, the alignment against the textbook table."""

import random
import time
import tracemalloc

import awkward
import numpy as np
from conftest import MEDIUM
from lexframe.llm import neardup
from lexframe.llm.common import rolling
from lexframe.llm.graph import components
from pyspark.sql import functions as F


def table_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.randrange(rng.choice((2, 5, 40))) for _ in range(rng.randint(0, 40))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(5) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 9)):
            if b:
                i = rng.randrange(len(b))
                b[i: i + rng.randint(0, 2)] = [rng.randrange(40) for _ in range(rng.randint(0, 2))]
        d, most = table_distance(a, b), rng.randint(0, 14)
        got = neardup.edits_within(np.array(a, np.int64), np.array(b, np.int64), most)
        assert got == (d if d <= most else None), (a, b, most)
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert neardup.alike(x, y, most) == (d <= most)
        beam = neardup.edits_within(x, y, most, beam=2)
        assert beam is None or beam >= d


def test_swapped_halves_cost_little():
    h = np.random.default_rng(4).integers(0, 1 << 62, 8000).astype(np.uint64)
    swapped = np.concatenate([h[4000:], h[:4000]])
    tracemalloc.start()
    began = time.perf_counter()
    assert not neardup.alike(h, swapped, 1600)
    assert time.perf_counter() - began < 1  # 0.03 s alone
    assert neardup.edits_within(h, swapped, 1600) is None
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_prefixes_of_similar_texts_meet(spark):
    """Whatever the counters say, two similar texts share a prefix word, and
    texts with a common passage alone seldom do."""
    rng = random.Random(6)
    rows, links = [], []
    passage = [f"p{i}" for i in range(60)]
    for i in range(0, 400, 2):
        n = rng.choice((1, 2, 4, 5, 9, 30, 170))
        a = [f"w{rng.randrange(rng.choice((3, 40, 10**6)))}" for _ in range(n)]
        b = list(a)
        for _ in range(int(0.2 * n)):
            b[rng.randrange(len(b))] = f"z{rng.randrange(10**6)}"
        rng.random() < 0.3 and rng.shuffle(b)
        rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
        links.append((i, i + 1))
    strangers = [(1000 + i, " ".join([f"v{rng.randrange(10**6)}" for _ in range(100)] + passage)) for i in range(60)]
    d = spark.createDataFrame(rows + strangers, "_key long, text string")
    for counters in (neardup.word_counters(d), np.zeros(neardup.COUNTERS, np.int64)):
        got = {}
        for r in neardup.prefix_table(d, counters, 0.8).collect():
            got.setdefault(r["_key"], set()).add(r["token"])
        assert all(got[a] & got[b] for a, b in links)
        if counters.any():
            own = [got[k] for k, _ in strangers]
            assert sum(bool(x & y) for i, x in enumerate(own) for y in own[:i]) < 20


def test_sketches_keep_the_order():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    same = lambda x, y: np.mean(neardup.order_sketches(x, 200) == neardup.order_sketches(y, 200))
    swapped = np.concatenate([h[200:], h[:200]])  # nearly all k-mers are shared, in another order
    edited = h.copy()
    edited[[50, 300]] = 7
    assert same(h, h) == 1 and same(h, edited) > 0.7 and same(h, swapped) < 0.3
    assert len(set(neardup.occurrence_labelled(np.array([5, 5, 5, 8], np.uint64)).tolist())) == 4


def parts(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(500 + i, 501 + i) for i in range(90)]
    edges += [(700, 701 + i) for i in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == parts(edges, {n for e in edges for n in e})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_against_all_pairs(spark):
    """Every pair of an edit similarity of 0.8 is in one class, and nothing
    else is."""
    d = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    known: dict[str, int] = {}
    words = {k: np.array([known.setdefault(w, len(known)) for w in t.split()], np.int64) for k, t in d.items()}
    size = len(known)
    order = sorted(d, key=lambda k: len(words[k]))
    bags = {k: np.bincount(w, minlength=size).astype(np.int32) for k, w in words.items()}
    links, shingled = [], []
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            n = len(words[b])
            if len(words[a]) < 0.8 * n:
                break
            most = int(0.2 * n + 1e-9)
            both = np.minimum(bags[a], bags[b]).sum()
            if n - both <= most and neardup.alike(words[a], words[b], most):
                links.append((a, b))
                x, y = (set(rolling(w.astype(np.uint64), 5).tolist()) for w in (words[a], words[b]))
                if x and len(x & y) >= 0.8 * len(x | y):
                    shingled.append((a, b))
    rows = neardup.op5_order_minhash(spark, MEDIUM).collect()
    got = {r["doc_id"]: r["class_id"] for r in rows}
    want = parts(links, d)
    assert all(want[k] == want[c] for k, c in got.items())  # nothing else
    assert all(got[a] == got[b] for a, b in shingled) and len(shingled) > 50
    assert sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    assert sorted(k for k, c in got.items() if k == c) == sorted(r["doc_id"] for r in rows if r["kept"])


def test_a_large_group_and_strangers_in_its_buckets(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    shared = " ".join(base[:60])  # half of the text: strangers that meet it in buckets
    rows += [(1000 + i, shared + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(40))) for i in range(30)]
    rows += [(2000 + i, " ".join(base)) for i in range(20)] + [(3000, "two words"), (3001, "two  words"), (3002, "two")]
    got = {r["doc_id"]: (r["class_id"], r["class_size"], r["kept"]) for r in neardup.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k][:2] == (0, 170) for k in (*range(150), *range(2000, 2020)))
    assert all(got[1000 + i] == (1000 + i, 1, True) for i in range(30))
    assert got[3000] == (3000, 2, True) and got[3001] == (3000, 2, False) and got[3002] == (3002, 1, True)
    assert sum(v[2] for v in got.values()) == 33


def test_partners_that_are_no_representatives(spark):
    """Two components are linked by one pair of texts, neither the smallest key
    of its component, whose rare words stand in many texts."""
    base = [f"w{i}" for i in range(200)]

    x, y = ([f"{c}{i}" if at <= i < at + 20 else w for i, w in enumerate(base)] for c, at in (("x", 0), ("y", 20)))  # 40 apart
    texts = {100: x, 101: y} | {k: w[:at] + w[at + 1:] for k, w, at in ((1, y, 180), (2, y, 190), (3, x, 180), (4, x, 190))}
    texts |= {10 + i: base[: 2 * i] + base[2 * i + 45:] for i in range(60)}  # too short for the others
    links = [(1, 101), (2, 101), (3, 100), (4, 100)]
    d = neardup.stored(spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "_key long, text string"), "texts")
    crowd = neardup.stored(neardup.sketch_table(d).select("_key", "n_words", "sketches"), "crowd")
    sketches = {r["_key"]: set(r["sketches"]) for r in crowd.collect()}
    assert sketches[100] & sketches[101]
    known = spark.createDataFrame(links, "a long, b long")
    got = {(r["a"], r["b"]) for r in neardup.across(crowd, d, known, known, 0.8).collect()}
    assert (100, 101) in got and got >= set(links)
    number = {w: i for i, w in enumerate({w for t in texts.values() for w in t})}
    numbers = {k: np.array([number[w] for w in t], np.uint64) for k, t in texts.items()}
    assert all(neardup.alike(numbers[a], numbers[b], int(0.2 * max(len(texts[a]), len(texts[b])))) for a, b in got)


def test_parity_bounds_the_common_words():
    rng = np.random.default_rng(5)
    for n in (1, 30, 400):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n - n // 2).astype(np.uint64)])
        apart = sum(int(x ^ y).bit_count() for x, y in zip(neardup.word_parity(a).view(np.uint64).tolist(),
                                                           neardup.word_parity(b).view(np.uint64).tolist()))
        assert 0 < apart <= 2 * (n - n // 2) and len(neardup.word_parity(a)) == 4


def test_awkward_rows(spark, tmp_path):
    folder = awkward.table(spark, tmp_path)
    rows = neardup.op5_order_minhash(spark, folder).collect()
    assert len(rows) == len(awkward.rows())
    kept = [r["doc_id"] for r in rows if r["kept"]]
    assert sorted(kept, key=repr) == sorted([1, 3, 4, 5, None, 6, 7, 8, 9], key=repr)
    assert {r["class_id"] for r in rows if r["doc_id"] == 2} == {1}
    d = spark.read.parquet(f"{folder}/documents.parquet")
    left = neardup.drop_near_duplicates(d)
    assert left.columns == d.columns and sorted((r["doc_id"] for r in left.collect()), key=repr) == sorted(kept, key=repr)
    assert neardup.near_duplicates(d.filter(F.lit(False))).count() == 0
