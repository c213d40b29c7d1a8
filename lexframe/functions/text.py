"""Column expressions for markup, cleaning and tokens.

All functions return ``Column`` objects built from ``pyspark.sql.functions``;
they run inside whole-stage codegen and work on batch and streaming frames.
"""

from __future__ import annotations

import os
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup pattern, the preamble length and the two single
# letters kept by the tokenizer.
TAG_PATTERN = "<[^>]+>"
PREAMBLE_CHARS = 35
SINGLE_LETTERS = ("a", "i")

# Word tokens: maximal runs of letters/digits. A token is kept when it is all
# letters (or all digits with ``numbers=True``).
WORD_RUN = r"[\p{L}\p{N}]+"
ALPHA = r"^\p{L}+$"
DIGITS = r"^\p{Nd}+$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_markup(c: str | Column) -> Column:
    """Replace every ``<...>`` tag by a space."""
    return F.regexp_replace(col(c), TAG_PATTERN, " ")


def chop_preamble(c: str | Column, n: int = PREAMBLE_CHARS) -> Column:
    """Drop the first ``n`` characters; a null text gives ``''``."""
    return F.substring(F.coalesce(col(c), F.lit("")), n + 1, 1 << 30)


def blank_to_null(c: str | Column) -> Column:
    """Empty or whitespace-only strings become null."""
    x = col(c)
    return F.when(~x.rlike(r"^[ \t\n\r\f]*$"), x)


def list_to_string(c: str | Column, sep: str = " ") -> Column:
    """Join a list column with ``sep``."""
    return F.array_join(col(c), sep)


@lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    """Spark ML's default English stop words, shipped as package data."""
    with open(os.path.join(os.path.dirname(__file__), "english_stop_words.txt"), encoding="utf-8") as f:
        return tuple(f.read().split())


# The dictionary lemma table. The four "refuse" forms are the
# domain override; the rest are common irregular English forms.
LEMMAS = {
    "refusal": "refuse", "refusing": "refuse", "refuse": "refuse", "refused": "refuse", "refuses": "refuse",
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be",
    "has": "have", "had": "have", "having": "have",
    "does": "do", "did": "do", "done": "do", "doing": "do",
    "appeals": "appeal", "appealed": "appeal", "appealing": "appeal",
    "decisions": "decision", "claims": "claim", "claimed": "claim",
    "filed": "file", "files": "file", "filing": "file",
    "dismissed": "dismiss", "rejected": "reject", "remitted": "remit",
    "patents": "patent", "opponents": "opponent", "appellants": "appellant",
    "divisions": "division", "applications": "application",
    "went": "go", "gone": "go", "made": "make", "took": "take", "taken": "take",
    "found": "find", "held": "hold", "gave": "give", "given": "give",
    "men": "man", "women": "woman", "children": "child",
}


def lemma_map(extra: dict[str, str] | None = None) -> Column:
    table = dict(LEMMAS)
    if extra:
        table.update(extra)
    keys = sorted(table)
    return F.create_map(*[F.lit(x) for k in keys for x in (k, table[k])])


def kept_token_pattern(numbers: bool = False) -> str:
    """One regex that extracts exactly the kept tokens: maximal letter/digit
    runs that are all letters (2+ letters, or the single letters a / i), or,
    with ``numbers``, all digits (2+)."""
    alts = [r"\p{L}{2,}", "[" + "".join(SINGLE_LETTERS) + "]"]
    if numbers:
        alts.append(r"\p{Nd}{2,}")
    return r"(?<![\p{L}\p{N}])(?:" + "|".join(alts) + r")(?![\p{L}\p{N}])"


def clean_tokens(
    c: str | Column,
    stopwords: bool = False,
    numbers: bool = False,
    lemmatise: bool = False,
) -> Column:
    """Alphabetic lower-case tokens (T1) with the three options T2-T4.

    Single-letter tokens survive only for ``a`` and ``i``; stop words are
    tested on the surface form, lemmas replace the kept token. The token
    rule itself is one regular expression (no per-token lambda), so the
    default path stays inside whole-stage codegen.
    """
    text = F.lower(F.coalesce(col(c), F.lit("")))
    kept = F.regexp_extract_all(text, F.lit(kept_token_pattern(numbers)), 0)
    if stopwords:
        # a hash lookup a token, where an array of the words would be searched
        kept = F.filter(kept, lambda t: ~t.isin(*english_stop_words()))
    if lemmatise:
        m = lemma_map()
        kept = F.transform(kept, lambda t: F.when(t.isin(*LEMMAS), F.element_at(m, t)).otherwise(t))
    return kept


def model_text(c: str | Column) -> Column:
    """Transformer input text: stop words out, lemmas, no numbers, joined."""
    return F.array_join(clean_tokens(c, stopwords=True, numbers=False, lemmatise=True), " ")


def truncate_pad(tokens: str | Column, max_length: int, pad: str = "[PAD]") -> tuple[Column, Column]:
    """Cut a token array to ``max_length`` and pad it; returns (ids, mask)."""
    t = F.slice(col(tokens), 1, max_length)
    n = F.size(t)
    padded = F.concat(t, F.array_repeat(F.lit(pad), F.lit(max_length) - n))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))
    return padded, mask


SENTENCE_MARK = "\u0001"


def sentences(c: str | Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    marked = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"([.!?])[ \t\n\r\f]+", "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def ngrams(tokens: str | Column, n_min: int, n_max: int) -> Column:
    """Word n-grams for every n in [n_min, n_max], joined by spaces.

    The tokens (which hold no spaces) are joined once; the n-grams of each
    order are then the overlapping matches of one zero-width look-ahead
    regex anchored at every word start, so no per-gram lambda runs."""
    joined = F.array_join(col(tokens), " ")
    parts = []
    for n in range(n_min, n_max + 1):
        words = "(?:[^ ]+ ){%d}[^ ]+" % (n - 1) if n > 1 else "[^ ]+"
        parts.append(F.regexp_extract_all(joined, F.lit("(?<![^ ])(?=(" + words + "))"), 1))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def explode_tokens(c: str | Column) -> Column:
    """``explode_outer`` for token arrays; callers drop the null row of an
    empty array. Plain ``explode`` makes the optimizer infer a
    ``size(array) > 0`` filter that inlines the whole token expression
    (re-tokenising every row, quadratic for n-gram lambdas)."""
    return F.explode_outer(col(c))
