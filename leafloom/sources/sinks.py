"""Writers of skill trees: partitioned tables and Markdown text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.sources.files import RECORD_MARK


class SubjectExistsError(RuntimeError):
    """The subject has a tree already; merge into it or ask to replace it."""


def _exists(df: DataFrame, path: str) -> bool:
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target)


def write_skill_tree(nodes: DataFrame, path: str, replace: bool = False) -> None:
    """Writes the trees, one partition per subject.

    A subject that is there already stops the write unless ``replace`` is set; then only the partitions of
    the subjects at hand are replaced.
    """
    if not replace and _exists(nodes, path):
        there = nodes.sparkSession.read.parquet(path).select("subject").distinct()
        clash = nodes.select("subject").distinct().join(there, "subject", "left_semi").limit(1).collect()
        if clash:
            raise SubjectExistsError(f"subject {clash[0]['subject']!r} exists at {path}")
    writer = nodes.write.partitionBy("subject")
    if replace:
        writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    else:
        writer.mode("append").parquet(path)


def _yaml(value: Column) -> Column:
    """A string as a double-quoted scalar, which JSON and YAML share."""
    return F.substr(F.to_json(F.array(value)), F.lit(2), F.length(F.to_json(F.array(value))) - 2)


def _entry(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def render_skill_markdown(columns: list[str]) -> Column:
    """A node as a front matter block and its body. Lists and structs are written in flow style."""
    text = ["name", "description", "node_id", "parent", "subject", "subject_scope", "ingested_at", "content_hash", "superseded_by"]
    number = ["depth", "order"]
    nested = ["exam_coverage", "sources", "related_skills"]
    lines = [_entry(c, _yaml(F.col(c))) for c in text if c in columns]
    lines += [_entry(c, F.col(c).cast("string")) for c in number if c in columns]
    lines += [_entry(c, F.to_json(c)) for c in nested if c in columns]
    lines.append(F.lit(f"ingestion_version: {K.SCHEMA_VERSION}"))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.col("body"))


def write_markdown(nodes: DataFrame, path: str) -> None:
    """One text record per node, separated by a record mark; partitioned by subject."""
    rows = nodes.select("subject", render_skill_markdown(nodes.columns).alias("value"))
    rows.write.mode("errorifexists").partitionBy("subject").option("lineSep", RECORD_MARK).text(path)


def write_skill_folder(nodes: DataFrame, root: str) -> None:
    """A folder of Markdown files, one per node: ``<node_id>/SKILL.md`` for a node with others below it and for a subject, ``<node_id>.md`` for a leaf.

    Tasks write the files of their rows, a file that is there already is replaced, so a task that runs again changes nothing. ``root`` is any location that
    `pyarrow.fs` knows and that all executors see.
    """
    inner = nodes.select(F.col("parent").alias("node_id")).where("parent IS NOT NULL").distinct().withColumn("_inner", F.lit(True))
    rows = nodes.join(inner, "node_id", "left")
    is_node = F.col("_inner") | F.col("parent").isNull()
    place = F.concat("node_id", F.when(is_node, F.lit("/SKILL.md")).otherwise(F.lit(".md")))

    def save(rows) -> None:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made = set()
        for row in rows:
            path = f"{base.rstrip('/')}/{row.place}"
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            with store.open_output_stream(path) as file:
                file.write(row.value.encode())

    rows.select(place.alias("place"), render_skill_markdown(nodes.columns).alias("value")).foreachPartition(save)
