"""Sum-of-squares packing: the rule against a plain search, the ids against the library, the round trip."""

import random
import zlib

import awkward
import numpy as np
import pytest
import public_tokenizers
from conftest import MEDIUM
from lexframe.llm import squares as S
from lexframe.llm.parts import byte_bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer


def library():
    t = Tokenizer.from_file(public_tokenizers.path(S.VOCABULARY))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("special", [True, False])
def test_ids_of_parts_are_the_library_s(special):
    t, encode = byte_bpe(S.VOCABULARY, special)
    t.encode_special_tokens = not special
    rng = random.Random(9)
    letters = [*" \t\n\x0b\x1c\x85\xa0'’.,;!?%<|>09azAZßéçÀ×÷漢\u0301\U0001f600", "'s", "'LL", "<|endoftext|>", "  ", "\r\n", "the"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    texts += ["a" * 64, "é" * 65, " " * 64, " " * 70, "<|endoftext|>", "x<|endoftext|> y", "", "x" * 500]
    texts += [t.decode([i]) for i in range(0, t.get_vocab_size(), 3)]
    assert encode(texts) == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_level_minimises_the_squares():
    rng = random.Random(4)
    for length in (8, 20):
        levels = S.Levels(length)
        for i in range(600):
            size = rng.randint(1, length - 1)
            now = levels.count.copy()
            costs = {}
            for level in range(length - size + 1):
                if level and not now[level]:
                    continue
                after = now.copy()
                if level:
                    after[level] -= 1
                if level + size < length:
                    after[level + size] += 1
                costs[level] = int((after ** 2).sum())
            assert levels.best(size) == max(k for k, v in costs.items() if v == min(costs.values()))
            levels.place((i, size, 0, np.zeros(size, np.uint32)))
            assert all(levels.count[k] == len(v) for k, v in levels.windows.items())
            assert levels.open == levels.count.sum()


@pytest.mark.parametrize("most", [0, 3, 10_000])
def test_pieces_cover_every_document(most):
    rng = random.Random(most)
    docs = [np.arange(rng.choice((1, 5, 16, 33, 70)) + rng.randint(0, 9), dtype=np.uint32) for _ in range(200)]
    windows = list(S.sum_of_squares(((k, len(d), 0, d) for k, d in enumerate(docs)), 16, most))
    got = {}
    for w in windows:
        n = sum(len(p[3]) for p in w)
        assert n == 16 or n & (n - 1) == 0
        for doc, total, start, ids in w:
            assert total == len(docs[doc]) and len(ids)
            got.setdefault(doc, []).append((start, ids))
    for k, d in enumerate(docs):
        parts = sorted(got[k], key=lambda p: p[0])
        assert [p[0] for p in parts] == list(np.cumsum([0] + [len(p[1]) for p in parts])[:-1])
        assert np.concatenate([p[1] for p in parts]).tolist() == d.tolist()
    assert sum(sum(len(p[3]) for p in w) < 16 for w in windows) <= 4
    assert list(S.sum_of_squares(iter([]), 16)) == []


def check(rows, texts, length=S.LENGTH):
    """Every piece against the library's ids; every sequence without gaps."""
    encode, by_doc, by_sequence = library(), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for k, own in by_doc.items():
        ids = [*encode(texts[k]), S.END]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            piece = np.array(ids[at: at + r["length"]], "<u4").tobytes()
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(piece))
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own])[:-1])
        n = sum(r["length"] for r in own)
        assert n == length or n & (n - 1) == 0 and n < length
    return by_sequence


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = S.op11_sum_of_squares(spark, MEDIUM).collect()
    assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
    sequences = check(rows, texts)
    assert len(rows) < len(texts) + len(sequences) + 2 * S.LENGTH  # documents are cut where windows are, or at the end


def test_awkward_rows(spark, tmp_path):
    d = spark.read.parquet(awkward.table(spark, tmp_path) + "/documents.parquet").filter("doc_id IN (3, 4, 5, 6, 7, 8, 9)")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    hard = {20: "a" * 5000, 21: " " * 300_000 + "x", 22: "x" + "\n \t" * 50_000, 23: "a  b <|endoftext|> c<|endoftext|>",
            24: "tab\t x\xa0 y \x85 z  　w 'll don't  ", 25: " lead", 26: "﻿▁ ▁x \x00 \x01", 27: "漢字 かな\U0001f600 é"}
    more = spark.createDataFrame(list(hard.items()), "doc_id long, text string")
    rows = S.pack_online(d.select("doc_id", "text").unionByName(more), length=64, most=5).withColumn(
        "ids_crc32", F.crc32("ids")).collect()
    check(rows, texts | hard, 64)
    full = spark.read.parquet(awkward.table(spark, tmp_path, name="again") + "/again.parquet")
    rows = S.pack_online(full).collect()
    assert sum(r["start"] == 0 for r in rows) == len(awkward.rows())
    named = full.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("ids"), F.lit(2).alias("_id"))
    assert {r["doc_id"] for r in S.pack_online(named).collect()} == {None, *(f"k{i}" for i in range(1, 10))}
    assert S.pack_online(full.filter(F.lit(False))).count() == 0
