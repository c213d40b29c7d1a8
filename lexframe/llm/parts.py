"""Token ids of whole texts, each distinct part of a text encoded once.

A text is cut at single spaces that follow something else than a space and
precede a visible ASCII character or a Latin-1 letter. At such a space the byte-level vocabulary's
pattern always starts a new word (only its white-space branches hold a space
elsewhere than in front, and those leave the last space before a visible
character to it), and no piece of the other vocabulary goes on from another
character into a space. So the ids of the parts, each with its space in front,
are the ids of the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

from .common import blocks, text_bytes
from .packing import encoder

LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
cut = re.compile(f"(?<=[^ ]) (?=[!-~{LETTERS}])").split
#: Strings on whose characters the pattern's classes are beyond doubt; special strings begin with "<|".
_plain = re.compile(f"[ -~\\t\\n{LETTERS[6:]}]{{0,64}}").fullmatch
#: Vocabularies that are there as ranks too.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}

HELD = 1 << 18  #: distinct parts of a task's younger memory; the older one has as many at most


class Ids:
    """32-bit ids of part lists, as bytes (little-endian, as the machines are); ``encode`` gives the
    ids of a list of strings. Two generations of parts are remembered: when the
    younger is full it becomes the older, and parts still met come back."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], held: int = HELD):
        self.encode, self.most, self.known, self.old = encode, held, {}, {}

    def __call__(self, texts: list[list[str]]) -> list[bytes]:
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        fresh = set().union(*texts) - self.known.keys()
        again = fresh & self.old.keys()
        self.known.update((p, self.old[p]) for p in again)
        rare = {}
        fresh = list(fresh - again)
        for i in range(0, len(fresh), 4096):
            some = fresh[i: i + 4096]
            for p, x in zip(some, self.encode(some)):
                (self.known if len(p) < 64 else rare)[p] = array("I", x).tobytes()
        known = self.known if not rare else self.known | rare
        return [b"".join(map(known.__getitem__, parts)) for parts in texts]


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for:
    printable Latin-1 characters for themselves, the other bytes in order from
    U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe(name: str, special: bool):
    """The library's tokenizer of a byte-level vocabulary file and a function
    that gives the ids of many strings, without begin or end. The strings of
    special tokens are those tokens if ``special``, else plain text.

    Where the vocabulary is also there as ranks, short strings of plain Latin
    characters get their ids from the ranks, which costs a third: pattern and
    merges are the same, and so are the ids. All others go to the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = not special

    def whole(texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 64):  # many strings as the parts of one input: a result costs more than a string
            some = texts[i: i + 64]
            e = t.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, at = e.ids, np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            yield from (ids[a:b] for a, b in zip(at, at[1:]))

    if name not in RANKS:
        return t, lambda texts: list(whole(texts))
    by_ranks = encoder(RANKS[name])

    def encode(texts: list[str]) -> list[list[int]]:
        out = [by_ranks(x) if _plain(x) and "<|" not in x else None for x in texts]
        rest = [n for n, ids in enumerate(out) if ids is None]
        for n, ids in zip(rest, whole([texts[n] for n in rest])):
            out[n] = ids
        return out

    return t, encode


def some_rows(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in slices of at most ``most`` bytes of text (a row at least),
    with the texts; nulls are empty."""
    _, off = text_bytes(batch.column("text"))
    for i, j in blocks(off, most):
        rows = batch.slice(i, j - i)
        yield rows, [t or "" for t in rows.column("text").to_pylist()]


def type_of(docs, name: str) -> str:
    return docs.schema[name].dataType.simpleString()
