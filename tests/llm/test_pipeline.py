"""The pipeline: every stage's decisions take effect, end to end."""

import awkward
import corpus_pipeline as C
import numpy as np
from conftest import SMALL
from lexframe.llm import langid, mixing, neardup, packing
from lexframe.llm.common import stored


def test_stages(spark):
    assert [n for n, _ in C.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "packing"]
    first = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, seen = first, {}
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SMALL), "test")
        assert docs.columns == first.columns, name
        seen[name] = ([r["doc_id"] for r in before.collect()], [r["doc_id"] for r in docs.collect()])
    came, stay = seen["language_id"]
    kept = {r["doc_id"] for r in langid.identify_documents(first).filter("_accepted").collect()}
    assert set(stay) == kept and len(stay) >= 0.99 * len(came)
    came, stay = seen["near_duplicates"]
    rows = neardup.near_duplicates(first.filter(first.doc_id.isin(came))).collect()
    assert sorted(stay) == sorted(r["doc_id"] for r in rows if r["kept"]) and len(stay) < len(came)
    came, stay = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in first.collect()}
    assert set(came) - set(stay) == {d for d in came if any(i in texts[d] for i in items)} != set()
    came, stay = seen["mixing"]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(first.filter(first.doc_id.isin(came))).collect()}
    assert {d: stay.count(d) for d in set(stay)} == {d: n for d, n in plan.items() if n}
    rows = C.STAGES[-1][1](spark, docs, SMALL).collect()
    encode, parts = packing.encoder(), {}
    for r in rows:
        ids = np.frombuffer(r["input_ids"], "<i4")
        for a, b, d, n in zip(r["cu_seqlens"], r["cu_seqlens"][1:], r["doc_ids"], r["pieces"]):
            parts.setdefault((d, n), []).append(ids[a:b].tolist())
    for d in set(stay):
        want = [*encode(texts[d]), packing.END]
        for n in range(-(-len(want) // packing.LENGTH)):
            assert parts.pop((d, n)) == [want[n * packing.LENGTH: (n + 1) * packing.LENGTH]] * stay.count(d)
    assert not parts


def test_run_and_awkward_rows(spark, tmp_path):
    folder = awkward.table(spark, tmp_path)
    spark.createDataFrame([(1, "some test item that no document has anywhere in it")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    rows = C.run(spark, folder).collect()
    assert {d for r in rows for d in r["doc_ids"]} <= {r[0] for r in awkward.rows()} and rows
    empty = awkward.table(spark, tmp_path, [], "documents-empty")
    spark.read.parquet(f"{empty}/documents-empty.parquet").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert C.run(spark, empty).count() == 0
