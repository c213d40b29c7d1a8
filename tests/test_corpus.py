"""E1 / E2 end to end on literal decision records."""

from pyspark.sql import functions as F

from lexframe.plans.corpus import RAW_SCHEMA, experiment_split, label_cases

PREAMBLE = "Summary of Facts and Submissions I."  # 35 characters


def _raw(i, facts, order, year=2015, ecli_year=None, title="T", court="T", lang="en", provisions=("EPC_Art_056",)):
    ecli = f"ECLI:EP:BA:{year}:T{i:06d}.{year}0102"
    return (i, [f"T{i}EU1"], [lang], [court], [str(i)], ["en"], [PREAMBLE + facts], ["reasons"], [order],
            [f"{year}0102"], [ecli], [title] if title else [], ["3.2.1"], ["A61K"], ["kw"], ["EP1"],
            list(provisions), [])


def test_label_cases_and_splits(spark):
    rows = []
    for i in range(40):
        if i % 2:
            rows.append(_raw(i, "The examining division refused the application.",
                             "The appeal is dismissed." if i % 3 else "The decision under appeal is set aside.",
                             year=2015 + i % 8))
        else:
            rows.append(_raw(i, "Appeal by the proprietor against the decision of the opposition division.",
                             "The appeal is dismissed." if i % 4 else "The decision is set aside on appeal.",
                             year=2015 + i % 8))
    rows.append(_raw(100, "x", "The appeal is dismissed.", court="J"))          # other court
    rows.append(_raw(101, "x", "The appeal is dismissed.", lang="de"))          # other language
    rows.append(_raw(102, "x", "The appeal is dismissed.", year=1999))          # out of range
    dup = list(_raw(1, "The examining division refused the application.", "The appeal is dismissed.", year=2016))
    dup[0] = 200
    dup[11] = []  # duplicated ECLI without title: dropped
    rows.append(tuple(dup))
    raw = spark.createDataFrame(rows, RAW_SCHEMA)
    cases = label_cases(raw).cache()
    assert cases.count() == 40
    types = dict(cases.groupBy("case_type").count().collect())
    assert types == {"Patent Refusal": 20, "Opposition Division": 20}
    od = cases.filter(F.col("case_type") == "Opposition Division")
    assert {r[0] for r in od.select("appellant_type").distinct().collect()} == {"1"}
    assert cases.filter(F.col("case_type") == "Patent Refusal").filter(F.col("appellant_type").isNotNull()).count() == 0
    first = cases.filter("case_id = 2").first()
    assert first.matched_articles == ["Inventive Step"]
    assert first.new_summary_facts.startswith("Appeal by the proprietor")
    pf1 = experiment_split(cases, "pf", "1")
    n = dict(pf1.groupBy("label").count().collect())
    assert sum(n.values()) == 20
    both2 = experiment_split(cases, "both", "2", cut_year=2020)
    assert {"category_Opposition Division", "od_match_0", "od_match_1"} <= set(both2.columns)
    tr = both2.filter("split = 'train'")
    assert tr.filter("label = 1").count() == tr.filter("label = 0").count()
