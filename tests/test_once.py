"""Heavy steps are done once."""

from __future__ import annotations

import pytest

from leafloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["cleanup_report", "tree_lint", "tree_lint_quality", "page_span_rollup"])
def test_texts_are_read_once(spark, name):
    plan = _plan(catalog.callables()[name](spark, SMALL))
    assert "documents.parquet" not in plan and "text#" not in plan


def test_quality_leaves_out_what_blocks_nothing(spark):
    plan = _plan(catalog.callables()["tree_lint_quality"](spark, SMALL))
    assert "RLIKE" not in plan and "poor_naming" not in plan
