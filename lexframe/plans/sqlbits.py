"""Small DuckDB SQL fragments shared by oracle strings (oracle side only)."""

from __future__ import annotations

from ..functions.text import LEMMAS, english_stop_words


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_tokens_sql(text: str, stopwords: bool = False, numbers: bool = False, lemmatise: bool = False) -> str:
    words = f"regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')"
    kind = "regexp_full_match(w, '\\p{L}+')"
    if numbers:
        kind = f"({kind} OR regexp_full_match(w, '\\p{{Nd}}+'))"
    cond = f"{kind} AND (length(w) > 1 OR w IN ('a', 'i'))"
    if stopwords:
        cond += " AND NOT list_contains([" + ", ".join(q(s) for s in english_stop_words()) + "], w)"
    kept = f"list_filter({words}, lambda w: {cond})"
    if lemmatise:
        whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in sorted(LEMMAS.items()))
        kept = f"list_transform({kept}, lambda w: CASE w {whens} ELSE w END)"
    return kept


def tfidf_sql(tokens_cte: str, min_df: int, use_idf: bool, norm: bool) -> str:
    """Long-form (doc_id, term, weight) over a CTE ``toks(doc_id, term)`` of
    one row per token occurrence."""
    idf = "(ln((1.0 + n.n) / (1.0 + d.df)) + 1.0)" if use_idf else "1.0"
    w = f"tf.tf * {idf}"
    norm_expr = f"sqrt(sum(({w}) * ({w})) OVER (PARTITION BY tf.doc_id))" if norm else "1.0"
    return f"""
WITH {tokens_cte},
tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY doc_id, term),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= {min_df}),
n AS (SELECT count(*) AS n FROM docs)
SELECT tf.doc_id, tf.term, CAST(round(({w}) / {norm_expr}, 6) AS DOUBLE) AS weight
FROM tf JOIN d ON tf.term = d.term CROSS JOIN n
"""
