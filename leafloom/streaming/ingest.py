"""Streams of new source pages and of new leaves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions.vectors import similarity_bucket
from leafloom.operators import cleaning, merging
from leafloom.operators import similarity as S
from leafloom.operators.dedup import decide
from leafloom.session import fresh_path, stored
from leafloom.sources.snapshots import SCHEMA, SnapshotStore, subject_key


def clean_and_split(pages: DataFrame, text: str, patterns: cleaning.Patterns, boundary: str = K.BLANK_LINE) -> DataFrame:
    """Cleaned paragraphs of each page, numbered within the page. Row by row, so it fits any stream."""
    cleaned = pages.withColumn(text, cleaning.clean_text(F.col(text), patterns))
    return cleaning.split_paragraphs(cleaned, text, boundary)


def run_append(rows: DataFrame, label: str, out: str | None = None) -> DataFrame:
    """Drains a stateless stream into a parquet sink and reads it back."""
    out = out or fresh_path(rows.sparkSession, label)
    query = (
        rows.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{out}/data")


Judge = Callable[[DataFrame], DataFrame | None]
Classify = Callable[[DataFrame, DataFrame], DataFrame | None]


def merge_batch(batch: DataFrame, store: SnapshotStore, base: int | None, version: int, ingested_at: str, judge: Judge | None = None, classify: Classify | None = None) -> None:
    """Writes ``version``: the trees of ``base`` with a batch of new leaves.

    Leaves of a subject with a tree are merged into it; the first leaves of a subject become its tree. ``judge`` gets the pairs of the grey zone and
    returns their verdicts; ``classify`` gets new leaves and chapters and returns ``(subject, node_id, chapter_id)``. Subjects without new leaves are
    neither read nor written.
    """
    new = stored(batch.withColumn("_key", subject_key(F.col("subject"))), "batch")
    if new.isEmpty():
        return
    keys = new.select(F.col("_key").alias("subject_key")).distinct()
    before = store.read(base, keys) if base is not None else store.spark.createDataFrame([], SCHEMA)
    known = before.filter("depth = 0").select(subject_key(F.col("subject")).alias("_key")).distinct()
    after = merging.first_trees(new.join(known, "_key", "left_anti").drop("_key"), ingested_at)
    later = new.join(known, "_key", "left_semi").drop("_key")
    if not later.isEmpty():
        later = S.with_signature(later)
        chapters, old = merging.tree_chapters(before), S.with_signature(merging.tree_leaves(before))
        shared = ["ord", "subject", "node_id", "title", "body"]
        side = lambda rows, is_new: rows.select(*shared, F.lit(is_new).alias("is_new"))
        pairs = stored(S.leaf_pairs(side(later, True).unionByName(side(old, False))), "pairs")
        verdicts = judge(pairs.filter(similarity_bucket(F.col("similarity")) == "grey")) if judge else None
        choice = classify(later, chapters) if classify else None
        actions = merging.plan(later, decide(pairs, verdicts), chapters, choice)
        after = merging.apply(before, later, actions, ingested_at).unionByName(after)
    store.commit(after, version, base)


def run_merge(leaves: DataFrame, root: str, progress: str, ingested_at: str, judge: Judge | None = None, classify: Classify | None = None) -> int | None:
    """Drains a stream of new leaves into the store at ``root``: batch ``n`` makes version ``n + 1`` of the last version up to ``n``.

    So a batch that is run again gives the same version, a restart goes on where ``progress`` says, and a caller may put trees that are there already into version 0.
    Returns the last version that is committed, also when there was nothing to do; None while there is none.
    """
    store = SnapshotStore(leaves.sparkSession, root)

    def merge(batch: DataFrame, batch_id: int) -> None:
        own = SnapshotStore(batch.sparkSession, root)
        merge_batch(batch, own, own.latest(batch_id), batch_id + 1, ingested_at, judge, classify)

    query = leaves.writeStream.foreachBatch(merge).option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.latest()
