"""Record cleaning: dates, blanks, cohort, provisions, keywords, dedup
(P1-P16, W1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, col

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Date formats tried in order when parsing the decision date.
DATE_FORMATS = ("yyyyMMdd", "yyyy-MM-dd", "dd.MM.yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd")
# Provision code -> article name (exact codes only).
ARTICLES = {
    "052(2)": "Subject Matter", "052(3)": "Subject Matter", "052(4)": "Subject Matter", "053": "Subject Matter",
    "054": "Novelty", "055": "Novelty",
    "056": "Inventive Step",
    "057": "Industrial Applicability",
}
# Keyword patterns that mark auxiliary/main-request cases (case-insensitive).
AUXILIARY_PATTERN = (
    r"Inventive step - \((no|yes)\)"
    r"|Inventive Step - main request[\W_]*"
    r"|Inventive step - main request[\W_]*"
    r"|Inventive Step - auxiliary request[\W_]*"
    r"|Inventive step - auxiliary request[\W_]*"
    r"|Inventive [Ss]tep.*auxiliary"
    r"|Inventive [Ss]tep.*main request"
)
# Raw reference "T112564EU1" -> "T256411".
REFERENCE_PATTERN = r"^([A-Z])(\d{2})(\d+)(EU|EP)[12]$"
KEYWORD_SEP = " | "


def repair_date(date: str | Column, ecli: str | Column) -> Column:
    """A date string shorter than 8 characters is replaced by the ECLI part
    after its first ``.`` (P2); null-safe."""
    d, e = col(date), col(ecli)
    return F.when((F.length(d) < 8) & e.isNotNull(), F.get(F.split(e, r"\."), 1)).otherwise(d)


def parse_date(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that parses; anything else is null."""
    x = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in formats])


def blanks_to_null(df: DataFrame) -> DataFrame:
    """P4 over every string column."""
    return df.select(*[
        blank_to_null(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes
    ])


def cohort_filter(df: DataFrame, court: str = "court_type", lang: str = "procedure_lang", year: str = "year",
                  order: str = "order_text", court_value: str = "T", lang_value: str = "en",
                  first_year: int = 2000, end_year: int = 2025, date: str | None = None) -> DataFrame:
    """One court, one language, year range, order present. With the
    ``date`` column the year range is also stated as a date range, which
    parquet can push down (row-group skipping); ``year(date)`` cannot."""
    cond = ((F.col(court) == court_value) & (F.col(lang) == lang_value)
            & (F.col(year) >= first_year) & (F.col(year) < end_year) & F.col(order).isNotNull())
    if date is not None:
        dt = df.schema[date].dataType.simpleString()
        cond = cond & (F.col(date) >= F.lit(f"{first_year}-01-01 00:00:00").cast(dt)) \
            & (F.col(date) < F.lit(f"{end_year}-01-01 00:00:00").cast(dt))
    return df.filter(cond)


def dedup_keep_last(df: DataFrame, key: str, title: str, seq: str, min_key_len: int = 20) -> DataFrame:
    """W1. Rows with a null ``title`` are dropped when their key occurs more
    than once (a group of only null titles vanishes), keys shorter than
    ``min_key_len`` (and null keys) are dropped, then the last row by ``seq``
    is kept per key.

    One aggregation with map-side partial aggregation: a hot key is reduced
    in every map task before the shuffle, so no task ever holds a key group.
    """
    others = [c for c in df.columns if c != seq]
    row = F.struct(F.col(seq).alias(seq), *[F.col(c) for c in others])
    g = df.filter(F.length(F.col(key)) >= min_key_len).groupBy(key).agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(row).alias("__any"),
        F.max(F.when(F.col(title).isNotNull(), row)).alias("__titled"),
    )
    pick = F.when(F.col("__n") == 1, F.col("__any")).otherwise(F.col("__titled"))
    out = g.select(pick.alias("__r")).filter(F.col("__r").isNotNull())
    return out.select(*[F.col(f"__r.{c}").alias(c) for c in df.columns])


def normalise_provisions(c: str | Column) -> Column:
    """P10: keep items with both ``Art`` and ``EPC``; text between the first
    and second ``Art``; cut at ``_(2007)``; drop empty, >= 15 chars and
    ``icle``; with ``_`` take the part between the first and second ``_``."""
    items = F.coalesce(col(c), F.array().cast("array<string>"))
    kept = F.filter(items, lambda x: x.contains("Art") & x.contains("EPC"))
    code = F.transform(kept, lambda x: F.split(F.get(F.split(x, "Art"), 1), r"_\(2007\)").getItem(0))
    code = F.filter(code, lambda x: (x != "") & (F.length(x) < 15) & ~x.contains("icle"))
    return F.transform(code, lambda x: F.when(x.contains("_"), F.get(F.split(x, "_"), 1)).otherwise(x))


def article_map(table: dict[str, str] | None = None) -> Column:
    t = table or ARTICLES
    return F.create_map(*[F.lit(x) for k in sorted(t) for x in (k, t[k])])


def map_codes(codes: str | Column, table: dict[str, str] | None = None, default: str = "Other") -> Column:
    """Codes -> names, exact match only, distinct in first-seen order,
    empty -> [default]. The table is a literal map (a few entries)."""
    m = article_map(table)
    names = F.array_distinct(F.filter(F.transform(col(codes), lambda x: F.element_at(m, x)),
                                      lambda x: x.isNotNull()))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def exact_array_filter(c: str | Column, values: Sequence[str]) -> Column:
    """The array equals ``values`` exactly (order and length)."""
    return col(c) == F.array(*[F.lit(v) for v in values])


def keywords_string(c: str | Column) -> Column:
    """List -> joined by `` | ``; null -> ``''``."""
    return F.coalesce(F.array_join(col(c), KEYWORD_SEP), F.lit(""))


def keyword_excluded(c: str | Column, pattern: str = AUXILIARY_PATTERN) -> Column:
    """True when the keyword string matches (case-insensitive)."""
    return col(c).rlike("(?i)" + pattern)


def convert_reference(c: str | Column) -> Column:
    """``T112564EU1`` -> ``T256411``; others unchanged."""
    return F.regexp_replace(col(c), REFERENCE_PATTERN, "$1$3$2")


def array_contains_text(c: str | Column, needle: str) -> Column:
    """Some element contains ``needle`` ignoring case."""
    n = needle.lower()
    return F.exists(col(c), lambda x: F.lower(x).contains(n))


def select_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The requested columns that exist, in the requested order."""
    have = set(df.columns)
    return df.select(*[c for c in cols if c in have])


def relabel(c: str | Column, mapping: dict[str, str]) -> Column:
    """Mapped value, or the value itself."""
    m = F.create_map(*[F.lit(x) for k in sorted(mapping) for x in (k, mapping[k])])
    return F.coalesce(F.element_at(m, col(c)), col(c))


def class_name(c: str | Column) -> Column:
    """Text before the first ``(``."""
    return F.substring_index(col(c), "(", 1)
