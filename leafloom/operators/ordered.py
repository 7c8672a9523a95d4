"""Ordered operators that stay parallel when one key owns a large share of the rows.

A plain ``row_number``/``lag``/running ``sum`` over ``partitionBy(key)`` sends a hot key to one task.
Here each key is cut into blocks of an integer order column; the window runs per (key, block) and only
one row per block goes to a second window over the blocks of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom.session import cut_lineage

BLOCK = 65536
_B = "_block"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / F.lit(block)))


def prefix_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Sum of ``value`` over the rows before this one. ``order`` is an integer, unique within the key."""
    before = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    df = _blocked(df, order, block).withColumn("_value", value)
    offsets = (
        df.groupBy(*keys, _B)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, _B, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_offset"))
    )
    return (
        df.join(offsets, [*keys, _B])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(before), F.lit(0)))
        .drop(_B, "_value", "_offset")
    )


def ordinal(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """0-based position within the key."""
    return prefix_sum(df, keys, order, F.lit(1), out, block)


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: str,
    fields: dict[str, Column],
    step: int,
    tie: list[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``fields`` of the previous (step -1) or next (step 1) row of the key, null at the ends."""
    df = _blocked(df, order, block).withColumn("_fields", F.struct(*[c.alias(n) for n, c in fields.items()]))
    rank = F.struct(order, *tie)
    inner = Window.partitionBy(*keys, _B).orderBy(order, *tie)
    outer = Window.partitionBy(*keys).orderBy(_B)
    edge_row = F.max_by("_fields", rank) if step < 0 else F.min_by("_fields", rank)
    shift = F.lag if step < 0 else F.lead
    edges = (
        df.groupBy(*keys, _B)
        .agg(edge_row.alias("_edge"))
        .select(*keys, _B, shift("_edge").over(outer).alias("_edge"))
    )
    out = df.join(edges, [*keys, _B]).withColumn("_near", F.coalesce(shift("_fields").over(inner), F.col("_edge")))
    return out.withColumns({n: F.col(f"_near.{n}") for n in fields}).drop(_B, "_fields", "_edge", "_near")


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1, out: str = "_rank") -> DataFrame:
    """First ``keep`` rows per key. The limit on the rank lets Spark cut each map partition to ``keep``
    rows per key before the shuffle (window group limit), so a hot key stays cheap."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= keep)


def global_order(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """1-based place of every row in a total order, without one task that sees all rows.

    The rows are range-partitioned and sorted, written once so that the ranges stay put, and numbered by
    their place in the partition plus the sizes of the partitions before it.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy("_p").orderBy(*order)
    return ranged.join(starts, "_p").withColumn(out, F.row_number().over(inner) + F.col("_start")).drop("_p", "_start")
