"""Topic lists for pickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T

PICK = 50


def leaf_topic_search(leaves: DataFrame, text: str, order: list[Column], limit: int = PICK) -> DataFrame:
    """The first leaves whose title, path or subject name holds the text, in any case; blank finds all.

    The limit is the feature: Spark keeps ``limit`` rows per partition and merges those.
    """
    wanted = text.strip().lower()
    if wanted:
        hit = [F.contains(F.lower(F.col(c)), F.lit(wanted)) for c in ("title", "path", "subject_name")]
        leaves = leaves.filter(hit[0] | hit[1] | hit[2])
    return leaves.orderBy(*order).limit(limit)


def exam_coverage(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("exam_coverage", T.split_list(F.col(column)))
