"""Migration of book-keyed trees (schema v2) to subject trees (schema v3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators.cleaning import paragraph_array

OUT = ["node_id", "parent", "depth", "order", "subject", "name", "description", "body", "content_hash", "sources", "superseded_by", "ingestion_version"]

KEPT = ["subject_scope", "exam_coverage", "related_skills"]


def subject_display_name(slug: Column) -> Column:
    return T.title_case(slug)


def migrate(
    nodes: DataFrame,
    old_subject: Column,
    book: Column,
    new_subject: Column,
    publisher: Column,
    rank: Column,
    now: str,
    subject_name: Column | None = None,
) -> DataFrame:
    """Whole-tree rewrite, row by row: no shuffle.

    ``nodes`` has ``node_id, parent, depth, order, name, description, body, source_pages, content_hash,
    ingested_at, is_leaf``. The root gets a name without a publisher; leaves get a source heading and a
    ``sources`` list that keeps the old hash. Rows that are v3 already pass unchanged, so a second run changes nothing.
    Metadata of roots and leaves (``KEPT``) is carried along where the input has it.
    """
    for column, kind in (("source_pages", "array<int>"), ("ingested_at", "string"), ("is_leaf", "boolean"), ("ingestion_version", "string")):
        if column not in nodes.columns:
            nodes = nodes.withColumn(column, F.lit(None).cast(kind))
    is_root = F.col("depth") == 0
    path = T.rewrite_node_id(F.col("node_id"), old_subject, book, new_subject)
    up = F.when(is_root, F.lit(None).cast("string")).otherwise(
        F.when(F.coalesce("parent", F.lit("")) == "", new_subject).otherwise(T.rewrite_node_id(F.col("parent"), old_subject, book, new_subject))
    )
    pages = F.coalesce("source_pages", F.array().cast("array<int>"))
    wrapped = T.source_section(F.lit(1), pages, F.col("body"))
    ids = F.transform(paragraph_array(F.col("body")), lambda _, i: i)
    source = F.struct(
        F.lit(1).alias("source_id"),
        publisher.alias("publisher"),
        book.alias("book_slug"),
        pages.alias("pages"),
        ids.alias("paragraph_ids"),
        rank.cast("int").alias("authority_rank"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"),
        F.coalesce("ingested_at", F.lit(now)).alias("ingested_at"),
    )
    name = F.when(is_root, F.coalesce(subject_name, subject_display_name(new_subject)) if subject_name is not None else subject_display_name(new_subject)).otherwise(F.col("name"))
    body = F.when(F.col("is_leaf"), wrapped).otherwise(F.col("body"))
    kept = [c for c in KEPT if c in nodes.columns]
    migrated = nodes.select(
        F.when(is_root, new_subject).otherwise(path).alias("node_id"),
        up.alias("parent"),
        "depth",
        "order",
        new_subject.alias("subject"),
        name.alias("name"),
        "description",
        body.alias("body"),
        T.content_hash(body).alias("content_hash"),
        F.when(F.col("is_leaf") | is_root, F.array(source)).alias("sources"),
        F.lit(None).cast("string").alias("superseded_by"),
        F.lit(K.SCHEMA_VERSION).alias("ingestion_version"),
        *kept,
        *[(F.col(c) if c in nodes.columns else F.lit(None)).alias(f"_old_{c}") for c in OUT],
    )
    done = F.coalesce(F.col("_old_ingestion_version") == K.SCHEMA_VERSION, F.lit(False))
    same = [F.when(done, F.col(f"_old_{c}").cast(migrated.schema[c].dataType)).otherwise(F.col(c)).alias(c) for c in OUT]
    return migrated.select(*same, *kept)


def migration_counts(migrated: DataFrame) -> DataFrame:
    leaf = F.col("depth") == 2
    return migrated.groupBy("subject").agg(F.count_if(leaf).alias("leaves_written"), F.count_if(~leaf).alias("index_nodes_written"))
