"""DuckDB formulation of a rule pack, used only to build oracle SQL.

Deliberately a different encoding from the Spark compiler: every token
becomes ``|`` followed by one 0/1 flag per literal, and a pattern is a
regular expression over these fixed-width records.
"""

from __future__ import annotations

from ..functions.rules import Gap, RulePack, fuzzy_bound

TOKENS_SQL = (
    "regexp_extract_all(lower(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')), "
    "'[a-z0-9]+|[^a-z0-9 \\t\\n\\r\\f]')"
)


def _lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _atom_cond(atom: tuple) -> str:
    kind, value, forms = atom
    if kind == "exact":
        return f"t = {_lit_sql(value)}"
    if kind == "lemma":
        return "t IN (" + ", ".join(_lit_sql(f) for f in forms) + ")"
    return f"levenshtein(t, {_lit_sql(value)}) <= {fuzzy_bound(value)}"


def flags_sql(pack: RulePack, text: str) -> str:
    atoms = pack.atoms()
    parts = " || ".join(f"(CASE WHEN {_atom_cond(a)} THEN '1' ELSE '0' END)" for a in atoms)
    return f"array_to_string(list_transform({TOKENS_SQL.format(text=text)}, lambda t: '|' || {parts}), '')"


def _elem(pack: RulePack, e) -> str:
    m = len(pack.atoms())
    rec = "\\|.{%d}" % m
    if isinstance(e, Gap):
        op = e.op
        return rec if op is None else "(?:" + rec + ")" + op
    j = pack.atoms().index(e.atom)
    one = "\\|" + (".{%d}" % j if j else "") + "1" + (".{%d}" % (m - j - 1) if m - j - 1 else "")
    return one if e.op is None else "(?:" + one + ")" + e.op


def label_regex_sql(pack: RulePack, label: str) -> str:
    return "|".join("(?:" + "".join(_elem(pack, e) for e in p) + ")" for p in pack.labels[label])


def hit_sql(pack: RulePack, label: str, sym: str) -> str:
    return f"regexp_matches({sym}, {_lit_sql(label_regex_sql(pack, label))})"


def classify_sql(pack: RulePack, sym: str, order: list[str]) -> str:
    whens = " ".join(f"WHEN {hit_sql(pack, lab, sym)} THEN {_lit_sql(lab)}" for lab in order)
    return f"CASE {whens} ELSE {_lit_sql(pack.default)} END"


def combined_sql(pack: RulePack, sym: str, both: str, pair: tuple[str, str], order: list[str]) -> str:
    h = {lab: hit_sql(pack, lab, sym) for lab in pack.labels}
    whens = f"WHEN {h[both]} OR ({h[pair[0]]} AND {h[pair[1]]}) THEN {_lit_sql(both)} "
    whens += " ".join(f"WHEN {h[lab]} THEN {_lit_sql(lab)}" for lab in order if lab != both)
    return f"CASE {whens} ELSE {_lit_sql(pack.default)} END"


__all__ = ["flags_sql", "classify_sql", "combined_sql", "hit_sql", "TOKENS_SQL"]
