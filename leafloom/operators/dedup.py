"""Duplicate decisions, clusters, winners and superseded leaves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.functions import vectors as V
from leafloom.session import cut_lineage, stored


def decide(pairs: DataFrame, verdicts: DataFrame | None = None, grey: float = K.GREY_SIMILARITY, auto: float = K.AUTO_SIMILARITY) -> DataFrame:
    """Adds ``verdict`` and ``decision``. A grey pair is a duplicate only if a verdict says so; without one
    it counts as related. Verdicts are looked up after the pairs are filtered, by signature pair."""
    if verdicts is None:
        judged = pairs.withColumn("verdict", F.lit(None).cast("string"))
    else:
        judged = pairs.join(verdicts.select("new_sig", "existing_sig", "verdict"), ["new_sig", "existing_sig"], "left")
    bucket = V.similarity_bucket(F.col("similarity"), grey, auto)
    decision = (
        F.when(bucket == "auto", "duplicate")
        .when(bucket == "different", "different")
        .otherwise(F.coalesce(F.when(F.col("verdict").isin("duplicate", "related", "different"), F.col("verdict")), F.lit("related")))
    )
    return judged.withColumn("bucket", bucket).withColumn("decision", decision)


def report(decided: DataFrame, groups: DataFrame) -> DataFrame:
    """Leaf pairs per decision and subject. Pairs that were never formed are different; their number is
    the product of the sides less the others."""
    sides = groups.groupBy("subject").agg(
        F.sum(F.when(F.col("is_new"), F.col("n")).otherwise(0)).alias("_a"),
        F.sum(F.when(F.col("is_new"), 0).otherwise(F.col("n"))).alias("_b"),
    )
    found = decided.withColumn("_n", F.col("n_new") * F.col("n_existing")).groupBy("subject").agg(
        F.sum(F.when(F.col("decision") == "duplicate", F.col("_n")).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col("decision") == "related", F.col("_n")).otherwise(0)).alias("related"),
    )
    rows = sides.join(found, "subject", "left").fillna(0, ["duplicates", "related"])
    return rows.select(
        "subject", "duplicates", "related", (F.col("_a") * F.col("_b") - F.col("duplicates") - F.col("related")).alias("different")
    )


def winner_order(publisher: Column, body: Column, node_id: Column) -> Column:
    """Sorts winners first: lower authority rank, longer body, smaller id."""
    return F.struct(T.authority_rank(publisher).alias("rank"), (-F.length(body)).alias("size"), node_id.alias("node_id"))


def best_members(signed: DataFrame) -> DataFrame:
    """The winner inside each signature group."""
    order = winner_order(F.col("publisher"), F.col("body"), F.col("node_id"))
    return signed.groupBy("subject", "is_new", "sig").agg(F.min(order).alias("best"))


def pick_winners(duplicates: DataFrame, best: DataFrame) -> DataFrame:
    """Winner and loser of every duplicate signature pair, each side shown by its best leaf."""
    side = lambda new, tag: best.filter(F.col("is_new") == F.lit(new)).select(
        "subject", F.col("sig").alias(f"{tag}_sig"), F.col("best").alias(f"_{tag}")
    )
    rows = duplicates.join(side(True, "new"), ["subject", "new_sig"]).join(side(False, "existing"), ["subject", "existing_sig"])
    first = F.col("_new") <= F.col("_existing")
    return rows.select(
        "subject",
        "new_sig",
        "existing_sig",
        "similarity",
        F.when(first, F.col("_new")).otherwise(F.col("_existing")).alias("_w"),
        F.when(first, F.col("_existing")).otherwise(F.col("_new")).alias("_l"),
    ).select("subject", "new_sig", "existing_sig", "similarity", F.col("_w.node_id").alias("winner"), F.col("_l.node_id").alias("loser"), F.col("_w").alias("winner_order"))


#: Edges that a task gathers before it links their ends.
LINKED_AT_ONCE = 1 << 19


def _linked(edges: pa.Table) -> pa.Table:
    """The same components with one edge per vertex, to a vertex that stands for its component; a vertex alone keeps an edge to itself."""
    ends = pa.chunked_array([*edges.column("a").chunks, *edges.column("b").chunks]).combine_chunks().dictionary_encode()
    code, root = ends.indices.to_numpy(), np.arange(len(ends.dictionary))
    a, b = code[: len(edges)], code[len(edges) :]
    alone = np.ones(len(root), bool)
    alone[a[a != b]] = alone[b[a != b]] = False
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, far := root[root]):
            root = far
    own = np.flatnonzero((root != np.arange(len(root))) | alone)
    return pa.table({"a": ends.dictionary.take(pa.array(own)), "b": ends.dictionary.take(pa.array(root[own]))})


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, least = [], 0, LINKED_AT_ONCE
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).drop_null())
        rows += len(held[-1])
        if rows >= least:
            held = [_linked(pa.concat_tables(held))]
            rows, least = len(held[0]), max(LINKED_AT_ONCE, 2 * len(held[0]))
    if rows:
        yield from _linked(pa.concat_tables(held)).to_batches(max_chunksize=1 << 14)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for undirected edges ``(a, b)``: the least id reachable.

    The tasks first put the edges they hold down to one per vertex, twice: as the edges lie, and by vertex. However many edges a vertex has, the rounds
    see few. Each round every vertex takes the least label around it and then the label of that label, so long
    chains shrink geometrically. The labels are checkpointed per round; the driver sees one count.
    """
    edges = edges.select("a", "b")
    edges = edges.mapInArrow(_forest, edges.schema).repartition("a").mapInArrow(_forest, edges.schema)
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:  # labels only fall, so there is a fixed point
        around = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("_near"))
        step = labels.join(around, "id").select("id", F.col("label").alias("_old"), F.least("label", "_near").alias("_new"))
        jump = step.select(F.col("id").alias("_new"), F.col("_new").alias("_far"))
        after = cut_lineage(step.join(jump, "_new").select("id", "_old", F.least("_new", "_far").alias("label")))
        if after.filter(F.col("label") != F.col("_old")).isEmpty():
            return after.select("id", F.col("label").alias("component"))
        labels = after.drop("_old")


def vertex(is_new: Column, subject: Column, sig: Column) -> Column:
    return F.concat(subject, F.when(is_new, F.lit(":n:")).otherwise(F.lit(":e:")), sig)


def clusters(duplicates: DataFrame, signed: DataFrame) -> DataFrame:
    """``(node_id, cluster, winner)`` for every leaf in a duplicate cluster.

    The graph has one vertex per signature group; leaves are attached afterwards, and the winner is a minimum,
    so large groups of copies combine on the map side.
    """
    edges = duplicates.select(
        vertex(F.lit(True), F.col("subject"), F.col("new_sig")).alias("a"),
        vertex(F.lit(False), F.col("subject"), F.col("existing_sig")).alias("b"),
    )
    label = components(edges)
    order = winner_order(F.col("publisher"), F.col("body"), F.col("node_id"))
    # Texts stay out of the joins: their length is all that counts.
    short = signed.select("node_id", vertex(F.col("is_new"), F.col("subject"), F.col("sig")).alias("id"), order.alias("_order"))
    members = stored(short.join(label, "id"), "members")
    best = members.groupBy("component").agg(F.min("_order").alias("_w"))
    return members.join(best, "component").select("node_id", F.col("component").alias("cluster"), F.col("_w.node_id").alias("winner"))


def heads(links: DataFrame) -> DataFrame:
    """Follows ``(node_id, next)`` links to their ends by doubling. A chain can't be longer than there are links, else it is a cycle."""
    current = cut_lineage(links)
    total, reach = current.count(), 1
    while reach <= 2 * total + 1:
        step = current.select(F.col("node_id").alias("next"), F.col("next").alias("_far"))
        after = cut_lineage(current.join(step, "next", "left").select("node_id", F.coalesce("_far", "next").alias("next"), F.col("_far").isNotNull().alias("_moved")))
        if after.filter("_moved").isEmpty():
            return after.drop("_moved")
        current = after.drop("_moved")
        reach *= 2
    raise RuntimeError("links form a cycle")


def supersede(leaves: DataFrame, losers: DataFrame) -> DataFrame:
    """Sets ``superseded_by`` to the head of each chain.

    ``losers`` has ``(node_id, winner)``. A leaf that is superseded already passes the decision on to its
    current head, so running the same decisions again changes nothing.
    """
    old = leaves.filter(F.col("superseded_by").isNotNull()).select("node_id", F.col("superseded_by").alias("next"))
    active = heads(old)
    passed = (
        losers.join(active.withColumnRenamed("next", "_head"), "node_id", "left")
        .select(F.coalesce("_head", "node_id").alias("node_id"), "winner")
        .join(active.select(F.col("node_id").alias("winner"), F.col("next").alias("_whead")), "winner", "left")
        .select("node_id", F.coalesce("_whead", "winner").alias("next"))
        .filter(F.col("node_id") != F.col("next"))
        .groupBy("node_id")
        .agg(F.min("next").alias("next"))
    )
    final = heads(old.join(passed, "node_id", "left_anti").unionByName(passed))
    return leaves.join(final, "node_id", "left").withColumn("superseded_by", F.coalesce("next", "superseded_by")).drop("next")


def missing_from_cache(leaves: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct contents without a cached vector; copies are embedded once."""
    return leaves.select("content_hash", "text").dropDuplicates(["content_hash"]).join(cache.select("content_hash"), "content_hash", "left_anti")
