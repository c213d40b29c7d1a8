"""Alignment against a plain merge of the libraries' whole-text tokens."""

import hashlib
import random
from collections import Counter

import awkward
import numpy as np
import public_tokenizers
import sentencepiece
from conftest import SMALL
from lexframe.llm import alignment as A
from lexframe.llm import common
from lexframe.llm.parts import byte_letters
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders


LETTERS = byte_letters()


def tokens(text, a, b):
    """(id, bytes) of both tokenizers over the whole text; none if one does
    not give the text back."""
    if not text:
        return [], []
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(LETTERS[c] for c in a.id_to_token(i))) for i in e.ids]
    right = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
             for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    want = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])


def plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path(A.A_MODEL))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(A.B_MODEL))
    made, count = [], Counter()
    for k, text in rows:
        left, right = tokens(text, a, b)
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        sides = []
        for side, end in zip((left, right), ends):
            own, at = [[] for _ in cuts], 0
            for (i, _), e in zip(side, end):
                at += e > cuts[at]
                own[at].append(str(i))
            sides.append(own)
        groups = ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in zip(*sides))
        links, j = [], 0
        for (x, s), e in zip(left, ends[0]):
            while j and ends[1][j - 1] > e - len(s):
                j -= 1
            while ends[1][j] <= e - len(s):
                j += 1
            while j < len(right) and ends[1][j] - len(right[j][1]) < e:
                links.append((x, right[j][0]))
                j += 1
        count.update(set(links))
        made.append((k, left, right, cuts, links, groups))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [(k, len(le), len(r), len(c), len(li), sum(count[p] == best[p[0]] for p in li), sum(count[p] for p in li),
             hashlib.sha256(g.encode()).hexdigest() if le else "") for k, le, r, c, li, g in made]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_byte_letters_are_the_library_s():
    letters = byte_letters()
    assert sorted(letters.values()) == list(range(256))
    assert decoders.ByteLevel().decode([c for c, b in letters.items() if 32 <= b < 127]) == "".join(
        chr(b) for b in letters.values() if 32 <= b < 127)


def test_lockstep_with_short_lanes():
    rng = random.Random(8)
    sizes = [rng.choice((0, 1, 3, 40, 200)) for _ in range(30)]
    cut = lambda n: sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) if n else []
    ends = [(cut(n), cut(n)) for n in sizes]
    base = np.cumsum([0, *sizes])
    a, b = (np.array([base[k] + x for k, e in enumerate(ends) for x in e[side]], np.int64) for side in (0, 1))
    first = np.cumsum([0] + [len(e[0]) for e in ends])
    start = lambda e, i: e[i - 1] if i else 0
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if start(a, i) < b[j] and start(b, j) < a[i]}
    both = sorted(set(a.tolist()) & set(b.tolist()))
    for lane in (1, 2, 7, 10_000):
        la, lb, ca, cb = A.lockstep(a, b, first, lane)
        assert len(la) == len(want) and set(zip(la.tolist(), lb.tolist())) == want
        assert a[ca].tolist() == b[cb].tolist() == both
    empty = np.empty(0, np.int64)
    assert [len(x) for x in A.lockstep(empty, empty, np.zeros(4, np.int64))] == [0] * 4


def test_whole_table(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain(rows)
    got = A.op13_token_alignment(spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert order(got.collect()) == order(want)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)  # most pairs are joined by a shuffle
    assert order(A.op13_token_alignment(spark, SMALL).collect()) == order(want)


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet")
    hard = [(20, "a" * 5000), (21, " " * 20_000 + "x"), (22, "x" + "\n \t" * 5000), (23, "a  b <|endoftext|> <s>c</s> <0x41>"),
            (24, "tab\t x\xa0 y \x85 z  　w 'll don't  "), (25, " lead"), (26, "a▁b c"), (27, "漢字 かな\U0001f600 é"),
            (28, "▁"), (29, " "), (30, "  "), (31, "a▁ b"), (32, "\x00 \x01"), (33, "ﬁ ｆ Ａ é")]
    both = d.select("doc_id", "text", F.lit(1).alias("n_a"), F.lit("x").alias("_row")).unionByName(
        spark.createDataFrame(hard, "doc_id long, text string").select("*", F.lit(1).alias("n_a"), F.lit("x").alias("_row")))
    rows = [(r["doc_id"], r["text"]) for r in both.collect()]
    want = plain(rows)
    assert order(A.alignment(both).collect()) == order(want)
    assert sum(r[1] == 0 for r in want) >= 6  # null, empty and those with a letter that stands for a space
    assert A.alignment(both.filter(F.lit(False))).count() == 0
