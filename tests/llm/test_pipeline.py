"""The stages on a small corpus: what each has to do, and what it must leave alone."""

import corpus_pipeline
from astrolane.llm import op6_quality_rules as op6
from astrolane.llm.common import table


def test_stages(spark, odd):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "quality_rules":
            assert {i for i, t in before.items() if op6.judge(t, op6.Rules())[6]} == set(after)
        if name == "exact_dedup":
            assert {" ".join(t.split()) for t in before.values()} == {" ".join(t.split()) for t in after.values()}
            assert len({" ".join(t.split()) for t in after.values()}) == len(after)
        if name == "secret_scans":
            assert set(after) == set(before) and not any("AKIA" in t for t in after.values())
        seen.append(len(after))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert seen == sorted(seen, reverse=True) and seen[-1] < seen[0]


def test_odd_rows_pass(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= docs.count()
