"""Operator 7, secret scans: corpus-wide ownership frequency.

Candidates are found per row by regular expressions, with their places; the
value of each is hashed, and the hashes are counted over distinct repositories
and distinct owners. A value that many owners carry is a widely copied example;
a varied value that stays with one or two owners looks live.

DataFrame functions only. Places come from splitting the text at the pattern:
the pieces between the matches and the matches themselves, laid end to end,
give every start and end in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored

# The kinds, in the order in which equal starts are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"   # runs are maximal, so the length can be in the pattern
HEX = "[0-9a-f]{24,}"
#: Spans that the method adds: keys with a provider's own prefix, signed web tokens, key blocks.
PROVIDER = (r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
            r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
KINDS = ["assign", "access", "hex", "provider"]

SHARED_OWNERS = 3       #: owners from which a value counts as a copied example
SHARED_REPOSITORIES = 10    #: repositories from which a value counts as a copied example
BLOCK = 512             #: matches of a text that are laid end to end at a time
LEAST_LENGTH = 12       #: characters of a value that can be live
LEAST_VARIETY = 8       #: distinct characters of a value that can be live


def spans(text: Column, kind: str, pattern: str, group: int) -> Column:
    """Array of ``(start, ord, kind, stop, value)`` of all matches; empty
    where the pattern is absent, which one scan of the text decides."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    # lay gap 0, match 0, gap 1, match 1 ... end to end
    step = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value"))
    shape = "struct<start:int,ord:int,kind:string,stop:int,value:string>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out"))

    def lay(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        stop = begin + F.length(x["whole"])
        one = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"),
                       stop.alias("stop"), x["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def shifted(x: Column, by: Column) -> Column:
        return F.struct((x["start"] + by).alias("start"), x["ord"].alias("ord"), x["kind"].alias("kind"),
                        (x["stop"] + by).alias("stop"), x["value"].alias("value"))

    def joined(parts: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(parts, first, lambda acc, x: F.struct(
            (acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, begins, lambda x, by: F.transform(x["out"], lambda s: shifted(s, by))))

    # a list grows by copying, so BLOCK matches are laid at a time, from 0, and the blocks then set end to end
    laid = bound(step, lambda all_: bound(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK)),
                    lambda k: F.aggregate(F.slice(all_, k + 1, F.lit(BLOCK)), start, lay)), joined))
    return F.when(text.rlike(pattern), laid).otherwise(F.array().cast(f"array<{shape}>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once a row however often lambdas use it."""
    return F.transform(F.array(value), use)[0]


def candidates(text: Column) -> Column:
    """All spans of a text, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    assign = F.filter(spans(text, "assign", ASSIGN, 2), lambda s: F.length(s["value"]) >= 6)
    found = F.concat(assign, spans(text, "access", ACCESS, 0), spans(text, "hex", HEX, 0),
                     spans(text, "provider", PROVIDER, 0))
    return F.array_sort(found)


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")


def ownership(found: DataFrame) -> DataFrame:
    """``_hash, n_repositories, n_owners, verdict`` of each candidate value.

    ``found`` has a row for each candidate: ``_hash, _live, repository, owner``.
    Rows are first reduced to distinct (value, repository, owner), then to one
    row for each (value, owner): partial aggregation folds a value that a third
    of all rows carry in every map task, so no group is ever gathered.
    """
    pairs = found.groupBy("_hash", "repository", "owner").agg(F.max("_live").alias("_live"))
    repositories = pairs.groupBy("_hash", "repository").agg(F.max("_live").alias("_live")).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("n_repositories"), F.max("_live").alias("_live"))
    owners = pairs.groupBy("_hash", "owner").agg(F.lit(1).alias("_one")).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("n_owners"))
    both = repositories.join(owners, "_hash")
    copied = (F.col("n_owners") >= SHARED_OWNERS) | (F.col("n_repositories") >= SHARED_REPOSITORIES)
    return both.select("_hash", "n_repositories", "n_owners",
                       F.when(copied, "example").when(F.col("_live"), "live").otherwise("weak").alias("verdict"))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", repository: str = "doc_id",
                 owner: str = "source") -> DataFrame:
    """One row for each row of ``docs``: the spans and what ownership says.

    Columns: ``key, n_assign, n_access, n_hex, base_sha256, spans, n_live,
    n_example, n_weak, most_owners``. The texts are read once and never
    shuffled; values leave the scan only as hashes.

    Null text: no spans. Null repository or owner: one more repository or
    owner. Repeated rows: a result row each; they count as one repository.
    Empty table: no rows.
    """
    base = F.filter(F.col("_found"), lambda s: s["kind"] != "provider")
    value = lambda s: F.struct(
        F.xxhash64(s["value"]).alias("a"), F.hash(s["value"]).alias("b"))
    live = lambda s: (F.length(s["value"]) >= LEAST_LENGTH) & (
        F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_VARIETY)
    rows = docs.select(F.col(key).alias("_key"), F.col(repository).alias("repository"), F.col(owner).alias("owner"),
                       candidates(F.col(text)).alias("_found"))
    rows = stored(rows.select(
        "_key", "repository", "owner",
        *[_count(F.col("_found"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_found")).alias("spans"),
        F.transform("_found", lambda s: F.struct(value(s).alias("_hash"), live(s).alias("_live"))).alias("_values"),
    ), "secret-spans")
    marks = F.xxhash64(F.transform("_values", lambda v: v["_hash"]))
    some = rows.filter(F.size("_values") > 0).withColumn("_marks", marks)
    each = some.select("_key", "_marks", "repository", "owner", F.explode("_values").alias("_v")).select(
        "_key", "_marks", "repository", "owner", "_v._hash", "_v._live")
    verdicts = ownership(each)
    # rows that agree in key and values agree in their verdicts, so repeated rows are joined once
    told = each.select("_key", "_marks", "_hash").distinct().join(verdicts, "_hash").groupBy("_key", "_marks").agg(
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "example", "weak")],
        F.max("n_owners").alias("most_owners"))
    told = told.select(F.col("_key").alias("_k"), F.col("_marks").alias("_m"), "n_live", "n_example", "n_weak",
                       "most_owners")
    full = some.join(told, some["_key"].eqNullSafe(told["_k"]) & (some["_marks"] == told["_m"]), "left")
    none = rows.filter(F.size("_values") == 0)
    cols = [F.col("_key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_provider"]
    more = ["n_live", "n_example", "n_weak", "most_owners"]
    return full.select(*cols, *more).unionByName(
        none.select(*cols, *[F.lit(0).cast("bigint").alias(c) for c in more]))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(
    f"SELECT doc_id, source, {i} AS ord, '{kind}' AS kind, string_split_regex(t, {_quoted(p)}) AS gaps, "
    f"regexp_extract_all(t, {_quoted(p)}, 0) AS w, regexp_extract_all(t, {_quoted(p)}, {g}) AS v "
    f"FROM d WHERE regexp_matches(t, {_quoted(p)})"
    for i, (kind, p, g) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX, PROVIDER), (2, 0, 0, 0))))}),
e AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m),
s AS (SELECT doc_id, source, ord, kind, v[i] AS value, length(w[i]) AS size,
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
f AS (SELECT *, kind || ':' || a || ':' || (a + size) AS told FROM s WHERE kind <> 'assign' OR length(value) >= 6),
n AS (SELECT value, count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '-')) AS repositories,
             count(DISTINCT coalesce(source, chr(0))) AS owners FROM f GROUP BY value),
c AS (SELECT value, owners, CASE WHEN owners >= {SHARED_OWNERS} OR repositories >= {SHARED_REPOSITORIES} THEN 'example'
             WHEN length(value) >= {LEAST_LENGTH} AND len(list_distinct(string_split(value, ''))) >= {LEAST_VARIETY}
             THEN 'live' ELSE 'weak' END AS verdict FROM n),
x AS (SELECT doc_id, verdict, owners FROM (SELECT DISTINCT doc_id, value FROM f) JOIN c USING (value)),
y AS (SELECT doc_id, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example,
             count(*) FILTER (WHERE verdict = 'weak') AS n_weak, max(owners) AS most_owners FROM x GROUP BY doc_id),
z AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS)},
             string_agg(told, ',' ORDER BY a, ord) AS spans,
             string_agg(told, ',' ORDER BY a, ord) FILTER (WHERE kind <> 'provider') AS base FROM f GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
       coalesce(n_weak, 0) AS n_weak, coalesce(most_owners, 0) AS most_owners
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN y USING (doc_id)
"""
