"""Vectors are made within their rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from leafloom.functions import vectors as V
from leafloom.operators import similarity as S


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("words", [[], ["a"], ["b", "a", "b", "c", "b"], ["x"] * 7])
def test_unit_weights(spark, words):
    got = spark.createDataFrame([(words,)], "s array<string>").select(V.unit_weights(F.col("s")).alias("w")).first().w
    counts = Counter(words)
    length = sum(n * n for n in counts.values()) ** 0.5
    assert [(e.slot, e.weight) for e in got] == [(w, n / length) for w, n in sorted(counts.items())]


def test_vectors_need_no_groups(spark):
    rows = spark.createDataFrame([(1, "One two two"), (2, ""), (3, None)], "k int, text string")
    vectors = S.hash_embedder()(rows)
    plan = _plan(vectors)
    assert "Aggregate" not in plan and "Window" not in plan
    assert {r.k for r in vectors.collect()} == {1}
