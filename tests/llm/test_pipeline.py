"""The pipeline and the registered queries of the subpackage on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from leafloom.llm import quality, queries
from leafloom.llm.common import table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_registered():
    names = entry_points.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_quality_twin(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    result = con.execute(queries.SQL["op1_quality"])
    names = [c[0] for c in result.description]
    got = queries.op1_quality(spark, SF_DIR)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(result.fetchall())


@pytest.mark.parametrize("condition", ["kept", "NOT kept", "n_repeat_words > 5", "n_line_words_removed = 0 AND word_chars > 100", "n_dup_lines > 0 OR base_failed"])
def test_filtered_verdicts_are_as_fast(spark, condition):
    """A filter on the result must not evaluate the counts anew for each use of a column."""
    import time

    verdicts = queries.op1_quality(spark, SF_DIR)
    rows = verdicts.collect()
    began = time.monotonic()
    got = {r.doc_id for r in queries.op1_quality(spark, SF_DIR).where(condition).collect()}
    assert time.monotonic() - began < 30
    assert got == {r.doc_id for r in spark.createDataFrame(rows, verdicts.schema).where(condition).collect()}


def test_stages(spark):
    docs = table(spark, SF_DIR, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, SF_DIR)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString(), name
        left = {r.doc_id for r in before.collect()}
        kept = {r.doc_id for r in after.collect()}
        assert kept <= left
        if name == "quality_rules":
            assert kept == {r.doc_id for r in quality.verdicts(before).where("kept").collect()}
        before = spark.createDataFrame(after.collect(), docs.schema)
    pieces = corpus_pipeline.STAGES[4][1](spark, before, SF_DIR)
    assert {r.doc_id for r in pieces.collect()} == kept
    again = corpus_pipeline.run(spark, SF_DIR)
    assert {r.doc_id for r in again.collect()} == kept
