"""Golden rows for the decision-corpus rule packs (symbolise-then-regex),
checked in Spark and against the independent DuckDB encoding."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lexframe.functions import rulepacks as RP
from lexframe.functions.rules import classify, classify_combined, fuzzy_bound, symbol_string
from lexframe.plans import oracle_rules as OR

GOLDEN = [
    # text, case type, appellant type, outcome
    ("The decision under appeal is set aside. The case is remitted.", "Other", "Other", "Reversed"),
    ("Both appeals are dismissed and the decision set aside", "Other", "Other", "Affirmed"),
    ("The appellant (opponent 1) filed a notice", "Other", "2", "Unknown"),
    ("Appeal by the proprietor against the decision of the Opposition Division", "Opposition Division", "1", "Unknown"),
    ("The patent proprietor and the opponent II appealed", "Other", "3", "Unknown"),
    ("The examining division refused European patent application No. 1", "Patent Refusal", "Other", "Unknown"),
    ("The Proprietor (appellant I) and the opponent (appellant II) filed", "Other", "3", "Unknown"),
    ("restricted to the question of admissability of the appeal", "Admissibility", "Other", "Unknown"),
    ("The <b>appeal</b> is <i>dismissed</i>.", "Other", "Other", "Affirmed"),
]


def test_fuzzy_bounds():
    assert [fuzzy_bound(w) for w in ["appeal", "patent", "opponent", "appellant", "proprietor", "admissibility"]] == \
        [2, 2, 2, 3, 3, 4]


def test_pack_symbols_fit_alphabet():
    for pack in (RP.CASE_TYPE, RP.APPELLANT_TYPE, RP.OUTCOME, RP.LICENCE):
        syms = pack.symbols()
        assert len(set(syms.values())) == len(syms)


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "id int, text string")


def test_golden_spark(golden):
    out = golden.select(
        "id",
        classify(RP.CASE_TYPE, F.col("text"), RP.CASE_TYPE_ORDER).alias("case_type"),
        classify_combined(RP.APPELLANT_TYPE, F.col("text"), "3", ("2", "1"), RP.APPELLANT_ORDER).alias("appellant"),
        classify(RP.OUTCOME, F.col("text"), RP.OUTCOME_ORDER).alias("outcome"),
    ).orderBy("id").collect()
    for row, g in zip(out, GOLDEN):
        assert (row.case_type, row.appellant, row.outcome) == g[1:], g[0]


def test_golden_duckdb_agrees():
    con = duckdb.connect()
    con.execute("CREATE TABLE g(id INT, text VARCHAR)")
    con.executemany("INSERT INTO g VALUES (?, ?)", [(i, g[0]) for i, g in enumerate(GOLDEN)])
    sql = f"""SELECT id,
      {OR.classify_sql(RP.CASE_TYPE, OR.flags_sql(RP.CASE_TYPE, 'text'), RP.CASE_TYPE_ORDER)},
      {OR.combined_sql(RP.APPELLANT_TYPE, OR.flags_sql(RP.APPELLANT_TYPE, 'text'), '3', ('2', '1'), RP.APPELLANT_ORDER)},
      {OR.classify_sql(RP.OUTCOME, OR.flags_sql(RP.OUTCOME, 'text'), RP.OUTCOME_ORDER)}
      FROM g ORDER BY id"""
    for row, g in zip(con.execute(sql).fetchall(), GOLDEN):
        assert tuple(row[1:]) == g[1:], g[0]


def test_symbol_string_shape(golden):
    s = golden.select(symbol_string(RP.OUTCOME, F.col("text")).alias("s")).first().s
    # one symbol per matcher token: 'The decision under appeal is set aside . The case is remitted .'
    assert len(s) == 13


def test_gap_bounds(spark):
    # appellant ... ( within 3 tokens; 4 tokens between must not match
    rows = [(1, "the appellant a b c ( opponent )"), (2, "the appellant a b c d ( opponent )")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = dict(df.select("id", classify_combined(RP.APPELLANT_TYPE, F.col("text"), "3", ("2", "1"),
                                                 RP.APPELLANT_ORDER).alias("t")).collect())
    assert out == {1: "2", 2: "Other"}


def test_each_literal_is_tested_once_a_token(spark):
    pack = RP.APPELLANT_TYPE
    d = spark.createDataFrame([("the appeal of patent proprietor ( xx",)], "text string")
    got = d.select(symbol_string(pack, F.col("text")).alias("s"))
    fuzzy = [a for a in pack.atoms() if a[0] == "fuzzy"]
    assert got._jdf.queryExecution().analyzed().toString().count("levenshtein(") == len(fuzzy)
    # the symbol is that of all literals within reach
    names = {s: {pack.atoms()[i][1] for i in c} for c, s in pack.symbols().items()}
    assert [names.get(s) for s in got.first()["s"]] == [{"the"}, {"appeal"}, {"of"}, {"patent"}, {"proprietor"}, {"("}, None]


def test_symbols_are_made_once_a_text(spark):
    d = spark.createDataFrame([("The appellant (opponent 1) filed",)], "text string")
    for c in (classify(RP.LICENCE, F.col("text"), RP.LICENCE_ORDER),
              classify_combined(RP.APPELLANT_TYPE, F.col("text"), "3", ("2", "1"), RP.APPELLANT_ORDER)):
        plan = d.select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1
