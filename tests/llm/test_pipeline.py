"""The pipeline and the entry queries on the smallest tables."""

import __spark_entry__ as entry
import corpus_pipeline
from newsflow.llm.common import read
from newsflow.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def test_ten_queries_and_the_pipeline_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_sql(spark):
    for name, sql in ORACLES.items():
        ok, message = compare(spark, connect(SF), name, QUERIES[name], sql, SF)
        assert ok, message


def test_stages(spark):
    """Stages keep the columns, decide on what they get, and no exact or near copy is left."""
    from newsflow.llm.common import written
    docs = read(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = written(stage(spark, docs, SF), "test-stage")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        sizes.append(len(after))
        if n < 4:
            assert docs.columns == columns and docs.count() == len(after)
        if n == 0:
            judged = [labels[i] for i in before if i in labels and i not in after]
            assert not judged or sum(judged) / len(judged) < 0.5
    assert sizes == sorted(sizes, reverse=True) and sizes[3] == sizes[4] == sizes[5]
    assert QUERIES["op5_heavy_hitter_dedup"](spark, SF).filter("kept").count() >= sizes[2]
