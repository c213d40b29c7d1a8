"""Declarative phrase rules over token sequences.

A rule pack is data: labels, each with token patterns made of literal
elements (exact, fuzzy, lemma set) and gaps. It compiles on the driver into
two Column expressions and nothing else:

1. every token becomes one symbol character, chosen by a ``CASE`` chain
   (a symbol stands for the *set* of literals a token satisfies);
2. the symbols are joined into one short string per text and every pattern
   is a regular expression over it (gap ``{,n}`` = ``.{0,n}``).

So matching is per-row, vectorised JVM code: no UDF, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_markup

# Token stream for the matcher: runs of ASCII letters/digits, every other
# non-space character is a token of its own.
MATCH_TOKEN = r"[a-z0-9]+|[^a-z0-9 \t\n\r\f]"
OTHER = "~"
FIRST_SYMBOL = 0xE000  # symbols are private-use characters, which no pattern gives a meaning


def fuzzy_bound(word: str) -> int:
    """Edit bound of a FUZZY literal: at least 2, up to 30 % of its length."""
    return max(2, round(0.3 * len(word)))


def levenshtein(a: str, b: str) -> int:
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


@dataclass(frozen=True)
class Lit:
    """A literal token element. kind: exact | fuzzy | lemma."""

    kind: str
    value: str
    forms: tuple[str, ...] = ()
    op: str | None = None  # None, "*", "+", "?"

    @property
    def atom(self) -> tuple:
        return (self.kind, self.value, self.forms)


@dataclass(frozen=True)
class Gap:
    """Any tokens: op "*", "+", "?", None (exactly one) or "{,n}" / "{m,n}"."""

    op: str | None = "*"


def exact(w: str, op: str | None = None) -> Lit:
    return Lit("exact", w, op=op)


def fuzzy(w: str, op: str | None = None) -> Lit:
    return Lit("fuzzy", w, op=op)


def lemma(name: str, forms: tuple[str, ...], op: str | None = None) -> Lit:
    return Lit("lemma", name, tuple(forms), op=op)


def gap(n: int | None = None) -> Gap:
    return Gap("*" if n is None else "{0,%d}" % n)


ANY = Gap(None)


@dataclass
class RulePack:
    """Ordered labels; each label has one or more patterns."""

    labels: dict[str, list[tuple]]
    default: str = "Other"
    _symbols: dict = field(default=None, init=False, repr=False)

    # -- compile -----------------------------------------------------------
    def atoms(self) -> list[tuple]:
        seen: list[tuple] = []
        for pats in self.labels.values():
            for p in pats:
                for e in p:
                    if isinstance(e, Lit) and e.atom not in seen:
                        seen.append(e.atom)
        return seen

    @staticmethod
    def _compatible(a: tuple, b: tuple) -> bool:
        """Can one token satisfy both atoms?"""
        (ka, va, fa), (kb, vb, fb) = a, b
        if ka == "lemma" and kb == "lemma":
            return bool(set(fa) & set(fb))
        if ka == "lemma" or kb == "lemma":
            forms, other = (fa, b) if ka == "lemma" else (fb, a)
            return any(RulePack._token_satisfies(w, other) for w in forms)
        if ka == "exact":
            return RulePack._token_satisfies(va, b)
        if kb == "exact":
            return RulePack._token_satisfies(vb, a)
        return levenshtein(va, vb) <= fuzzy_bound(va) + fuzzy_bound(vb)

    @staticmethod
    def _token_satisfies(tok: str, atom: tuple) -> bool:
        kind, value, forms = atom
        if kind == "exact":
            return tok == value
        if kind == "fuzzy":
            return levenshtein(tok, value) <= fuzzy_bound(value)
        return tok in forms

    def symbols(self) -> dict[frozenset, str]:
        """Clique of atoms -> symbol, largest cliques first."""
        if self._symbols is not None:
            return self._symbols
        atoms = self.atoms()
        n = len(atoms)
        adj = {i: {j for j in range(n) if j != i and self._compatible(atoms[i], atoms[j])} for i in range(n)}
        cliques: list[frozenset] = [frozenset([i]) for i in range(n)]
        frontier = list(cliques)
        while frontier:
            nxt = []
            for c in frontier:
                for j in range(max(c) + 1, n):
                    if all(j in adj[i] for i in c):
                        nxt.append(c | {j})
            cliques.extend(nxt)
            frontier = nxt
        cliques.sort(key=lambda c: (-len(c), sorted(c)))
        self._symbols = {c: chr(FIRST_SYMBOL + k) for k, c in enumerate(cliques)}
        return self._symbols

    def _atom_test(self, tok: Column, atom: tuple) -> Column:
        kind, value, forms = atom
        if kind == "exact":
            return tok == F.lit(value)
        if kind == "lemma":
            return tok.isin(*forms)
        k = fuzzy_bound(value)
        return (F.abs(F.length(tok) - len(value)) <= k) & (F.levenshtein(tok, F.lit(value), k) >= 0)

    def symbolise(self, tokens: Column) -> Column:
        """Token array -> symbol string (one character per token). Every
        literal is tested once a token, giving its bit of a number. The literals
        that a token satisfies are a clique themselves, so its symbol is that
        of the number."""
        atoms = self.atoms()
        if len(atoms) > 62:
            raise ValueError("a rule pack has at most 62 literals")
        lo = min([len(a[1]) - (fuzzy_bound(a[1]) if a[0] == "fuzzy" else 0) for a in atoms if a[0] != "lemma"]
                 + [len(w) for a in atoms if a[0] == "lemma" for w in a[2]])

        plain = [(a, 1 << i) for i, a in enumerate(atoms) if a[0] != "fuzzy"]
        words = {w for (kind, value, forms), _ in plain for w in (forms if kind == "lemma" else (value,))}
        # of plain words a lookup tells the bits; no other token is compared with them
        table = [(w, sum(bit for a, bit in plain if self._token_satisfies(w, a))) for w in sorted(words)]
        none = F.lit(0).cast("bigint")
        spans = [(len(a[1]) - fuzzy_bound(a[1]), len(a[1]) + fuzzy_bound(a[1])) for a in atoms if a[0] == "fuzzy"]

        def bits(t: Column) -> Column:
            found = none
            if table:
                of = F.element_at(F.create_map(*[F.lit(x) for w, n in table for x in (w, n)]), t).cast("bigint")
                found = F.when(t.isin(*sorted(words)), of).otherwise(none)
            if spans:
                near = sum((F.when(self._atom_test(t, a), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                            for i, a in enumerate(atoms) if a[0] == "fuzzy"), none)
                found = found + F.when(F.length(t).between(min(x for x, _ in spans), max(y for _, y in spans)), near).otherwise(none)
            return F.when(F.length(t) < max(lo, 1), none).otherwise(found)

        def one(m: Column) -> Column:
            expr = F.when(m == 0, F.lit(OTHER))
            for clique, s in sorted(self.symbols().items(), key=lambda c: len(c[0])):
                expr = expr.when(m == F.lit(sum(1 << i for i in clique)), F.lit(s))
            return expr.otherwise(F.lit(OTHER))

        return F.array_join(F.transform(F.transform(tokens, bits), one), "")

    def _element_regex(self, e) -> str:
        if isinstance(e, Gap):
            return "." + ("" if e.op is None else e.op)
        atoms = self.atoms()
        idx = atoms.index(e.atom)
        cls = "".join(s for c, s in self.symbols().items() if idx in c)
        return "[" + cls + "]" + (e.op or "")

    def pattern_regex(self, pattern: tuple) -> str:
        return "".join(self._element_regex(e) for e in pattern)

    def label_regex(self, label: str) -> str:
        return "|".join("(?:" + self.pattern_regex(p) + ")" for p in self.labels[label])

    # -- apply -------------------------------------------------------------
    def hits(self, symbols: Column) -> dict[str, Column]:
        return {lab: symbols.rlike(self.label_regex(lab)) for lab in self.labels}


def match_tokens(text: Column) -> Column:
    """Tag-stripped, lower-cased matcher tokens."""
    return F.regexp_extract_all(F.lower(strip_markup(F.coalesce(text, F.lit("")))), F.lit(MATCH_TOKEN), 0)


def first_hit(hits: dict[str, Column], order: list[str], default: str) -> Column:
    """Priority resolution: the first label in ``order`` that hit."""
    expr = None
    for lab in order:
        expr = F.when(hits[lab], F.lit(lab)) if expr is None else expr.when(hits[lab], F.lit(lab))
    return expr.otherwise(F.lit(default))


def _once(x: Column, of) -> Column:
    """``of(x)`` with ``x`` evaluated once: every rule reads the symbols, and
    behind an ``or`` or a later ``when`` Spark would make them anew for each."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def classify(pack: RulePack, text: Column, order: list[str] | None = None) -> Column:
    """Label of the highest-priority rule that matches ``text``."""
    return _once(pack.symbolise(match_tokens(text)), lambda sym: first_hit(
        pack.hits(sym), order or list(pack.labels), pack.default))


def classify_combined(pack: RulePack, text: Column, both: str, pair: tuple[str, str], order: list[str]) -> Column:
    """Appellant-type resolution (T13): ``both`` if it hit or both of ``pair``
    hit, then the rest of ``order``."""
    def resolve(sym: Column) -> Column:
        h = pack.hits(sym)
        combined = h[both] | (h[pair[0]] & h[pair[1]])
        expr = F.when(combined, F.lit(both))
        for lab in order:
            if lab != both:
                expr = expr.when(h[lab], F.lit(lab))
        return expr.otherwise(F.lit(pack.default))

    return _once(pack.symbolise(match_tokens(text)), resolve)


def symbol_string(pack: RulePack, text: Column) -> Column:
    return pack.symbolise(match_tokens(text))


__all__ = [
    "RulePack", "Lit", "Gap", "exact", "fuzzy", "lemma", "gap", "ANY",
    "classify", "classify_combined", "symbol_string", "match_tokens", "fuzzy_bound",
]
