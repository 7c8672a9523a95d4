"""File sources: text documents, Markdown skill trees, manifests, event frames, proposed trees."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions.model_json import extract_json_object
from leafloom.session import cut_lineage, stored


PART_CHARS = 1 << 20


def load_text_sources(spark: SparkSession, path: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Text files as one-page documents, a row per part: ``(source_path, page, part, text, page_count)``. A file of another kind fails the job.

    A file is read in byte ranges of ``spark.sql.files.maxPartitionBytes``, as many tasks as it has ranges, each range from the first line that begins in it; so a
    file of any size loads, and no character is cut. The texts of a file's parts, in order, are its whole text. A part ends with the line that brings it over
    ``part_chars``. Bytes that are not UTF-8 become replacement characters. Page count is 1, or 0 for a blank file; a file
    of no bytes has no row.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)  # names and sizes only
    listed = listed.select(F.col("_metadata.file_path").alias("source_path"), "length")
    suffix = F.lower(F.regexp_extract("source_path", r"(\.[^./]*)$", 1))
    problem = F.raise_error(F.concat(F.lit("unsupported source type: "), "source_path")).cast("string")
    listed = listed.select(F.when(suffix == ".txt", F.col("source_path")).otherwise(problem).alias("source_path"), "length")
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    lines = lines.select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("_range"),
        F.monotonically_increasing_id().alias("_line"),  # rises within a range
        (F.octet_length("value") + 1).alias("_bytes"),
        F.make_valid_utf8("value").alias("_text"),
    )
    before = Window.partitionBy("source_path", "_range").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    number = F.floor(F.coalesce(F.sum(F.length("_text") + 1).over(before), F.lit(0)) / part_chars)
    parts = lines.withColumn("_piece", number).groupBy("source_path", "_range", "_piece").agg(
        F.array_sort(F.collect_list(F.struct("_line", "_text"))).alias("_lines"), F.sum("_bytes").alias("_bytes"), F.bool_or(T.strip(F.col("_text")) != "").alias("_says")
    )
    parts = parts.withColumn("text", F.concat(F.array_join(F.transform("_lines", lambda x: x["_text"]), "\n"), F.lit("\n"))).drop("_lines")
    # One row per part from here on.
    of_file = Window.partitionBy("source_path")
    parts = parts.withColumns(
        {
            "part": (F.row_number().over(of_file.orderBy("_range", "_piece")) - 1).cast("int"),
            "_parts": F.count(F.lit(1)).over(of_file),
            "_bytes": F.sum("_bytes").over(of_file),
            "_says": F.max("_says").over(of_file),
        }
    )
    rows = listed.join(parts, "source_path", "left")
    # Every line was counted with a line end, which the last one may lack.
    open_end = (F.col("part") == F.col("_parts") - 1) & (F.col("_bytes") > F.col("length"))
    text = F.when(open_end, F.substr("text", F.lit(1), F.length("text") - 1)).otherwise(F.coalesce("text", F.lit("")))
    return rows.select(
        "source_path", F.lit(1).alias("page"), F.coalesce("part", F.lit(0)).alias("part"), text.alias("text"), F.coalesce(F.col("_says").cast("int"), F.lit(0)).alias("page_count")
    )


RECORD_MARK = "\n\x1e\n"

SKILL_SCHEMA = (
    "source_path string, subject string, node_id string, parent string, depth int, order int, name string, "
    "description string, subject_scope string, exam_coverage array<string>, ingested_at string, ingestion_version string, "
    "content_hash string, superseded_by string, source_pages array<int>, "
    "sources array<struct<source_id:int,publisher:string,book_slug:string,pages:array<int>,paragraph_ids:array<int>,"
    "authority_rank:int,content_hash:string,ingested_at:string>>, body string, error string"
)
_SOURCE_FIELDS = ["source_id", "publisher", "book_slug", "pages", "paragraph_ids", "authority_rank", "content_hash", "ingested_at"]


def _front_matter(text: str) -> tuple[dict, str]:
    import yaml

    lines = text.lstrip("\ufeff").split("\n")
    if lines[0].strip() != "---":
        return {}, text.strip()
    close = next((i for i, line in enumerate(lines[1:], 1) if line.strip() == "---"), None)
    if close is None:
        return {}, text.strip()
    loaded = yaml.safe_load("\n".join(lines[1:close])) or {}
    return loaded, "\n".join(lines[close + 1 :]).strip()


def _ints(values: object) -> list[int] | None:
    return [v for v in values if isinstance(v, int)] if isinstance(values, list) else None


def _record(path: str, text: str) -> dict:
    try:
        meta, body = _front_matter(text)
    except Exception as exc:  # an unreadable file is a row with an error, not a lost file
        return {"source_path": path, "error": f"{type(exc).__name__}: {exc}"}
    row = {"source_path": path, "body": body}
    for field in ("subject", "node_id", "parent", "name", "description", "subject_scope", "ingested_at", "ingestion_version", "content_hash", "superseded_by"):
        row[field] = None if meta.get(field) is None else str(meta[field])
    for field in ("depth", "order"):
        row[field] = meta.get(field)
    row["exam_coverage"] = [str(x) for x in meta.get("exam_coverage") or []]
    row["source_pages"] = _ints(meta.get("source_pages"))
    if isinstance(meta.get("sources"), list):
        row["sources"] = [
            {f: (_ints(s.get(f)) if f in ("pages", "paragraph_ids") else s.get(f)) for f in _SOURCE_FIELDS} for s in meta["sources"] if isinstance(s, dict)
        ]
    return row


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.strip().split(" ")[0] for c in SKILL_SCHEMA.split(", ")]
    for batch in batches:
        rows = [_record(p, t) for p, t in zip(batch["source_path"], batch["value"])]
        frame = pd.DataFrame(rows, columns=columns)
        for column in ("depth", "order"):
            frame[column] = frame[column].astype("Int32")
        yield frame.astype(object).where(frame.notna(), None)


def parse_skill_text(raw: DataFrame) -> DataFrame:
    """``(source_path, value)`` texts to rows: front matter in columns, body as text.

    The primary publisher and book are those of the first source. A text that cannot be read is kept as a
    row with ``error`` set.
    """
    rows = raw.select("source_path", "value").mapInPandas(_parse, SKILL_SCHEMA)
    first = F.try_element_at("sources", F.lit(1))
    return rows.withColumns(
        {
            "publisher": F.coalesce(first["publisher"], F.lit("")),
            "book_slug": F.coalesce(first["book_slug"], F.lit("")),
            "subject_scope": T.subject_scope(F.col("subject_scope")),
        }
    )


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``(source_path)`` of every file below a folder whose name ends in ``suffix``; names that begin with a dot or an underscore are left out.

    Folders are listed by tasks, a level at a time, so the driver sees no names; a folder's own entries meet in one task. ``root`` is any location that `pyarrow.fs` knows.
    """

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for folder in batch.column("source_path").to_pylist():
                found = store.get_file_info(fs.FileSelector(folder))
                found = [x for x in found if x.base_name[:1] not in ("_", ".") and (x.type == fs.FileType.Directory or x.base_name.endswith(suffix))]
                for at in range(0, len(found), LISTED):
                    some = found[at : at + LISTED]
                    yield pa.RecordBatch.from_arrays([pa.array([x.path for x in some], pa.string()), pa.array([x.type == fs.FileType.Directory for x in some])], names=["source_path", "_folder"])

    from pyarrow import fs

    tasks = 4 * spark.sparkContext.defaultParallelism
    level, files = spark.createDataFrame([(fs.FileSystem.from_uri(root)[1],)], "source_path string"), None
    while True:
        found = stored(level.repartition(tasks).mapInArrow(children, "source_path string, _folder boolean"), "listing")
        own = found.filter("NOT _folder").select("source_path", F.lit(root).alias("_root"))
        files = own if files is None else files.unionByName(own)
        level = found.filter("_folder").select("source_path")
        if level.isEmpty():
            return files.repartition(tasks)


LISTED, READ_BYTES = 10_000, 4 << 20


def read_texts(files: DataFrame) -> DataFrame:
    """``(source_path, value)``: the whole text of each listed file. Bytes that are not UTF-8 become replacement characters."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, of = None, None
        for batch in batches:
            paths, values, size = [], [], 0
            for path, root in zip(batch.column("source_path").to_pylist(), batch.column("_root").to_pylist()):
                if root != of:
                    store, of = fs.FileSystem.from_uri(root)[0], root
                with store.open_input_file(path) as file:
                    data = file.readall()
                paths.append(path)
                values.append(data.decode("utf-8", "replace"))
                size += len(data)
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["source_path", "value"])
                    paths, values, size = [], [], 0
            if paths:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.string())], names=["source_path", "value"])

    return files.mapInArrow(texts, "source_path string, value string")


def load_skill_folder(spark: SparkSession, root: str) -> DataFrame:
    """A folder of Markdown tree files, one file per node.

    Paths give what the front matter may lack. Chapter folders must start with two digits and a hyphen and have a SKILL file; others are
    skipped with all that is in them.
    """
    raw = read_texts(list_files(spark, root, ".md"))
    base = root.rstrip("/").rsplit("/", 1)[-1]
    inside = F.regexp_replace(F.substring_index("source_path", f"/{base}/", -1), r"\.md$", "")
    parts = F.split(inside, "/")
    is_node = F.element_at(parts, -1) == "SKILL"
    path = F.when(is_node, F.regexp_replace(inside, r"/?SKILL$", "")).otherwise(inside)
    folders = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    rows = parse_skill_text(raw).filter(F.forall(folders, lambda f: f.rlike(r"^\d{2}-")))
    rows = rows.withColumns({"path": path, "is_leaf": ~is_node, "_chapter": F.when(F.size(folders) > 0, F.array_join(F.slice(parts, 1, 2), "/"))})
    known = rows.filter(~F.col("is_leaf")).select(F.col("path").alias("_chapter"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(known, "_chapter", "left").filter(F.col("_chapter").isNull() | F.col("_known")).drop("_chapter", "_known")
    return rows.withColumns(
        {"subject": F.coalesce("subject", F.substring_index("path", "/", 1)), "node_id": F.coalesce("node_id", "path")}
    )


def load_skill_records(spark: SparkSession, path: str) -> DataFrame:
    """What ``sinks.write_markdown`` wrote: many nodes per file, told apart by a record mark."""
    raw = spark.read.option("lineSep", RECORD_MARK).text(path).select(F.col("_metadata.file_path").alias("source_path"), "value")
    rows = parse_skill_text(raw.filter(T.strip(F.col("value")) != ""))
    return rows.withColumns({"path": F.col("node_id"), "is_leaf": F.col("sources").isNotNull() & (F.col("depth") > 0)})


def list_subjects(nodes: DataFrame) -> DataFrame:
    """Subjects: top folders with a node file of their own; hidden, archived and dotted names are skipped."""
    top = nodes.filter(~F.col("is_leaf") & (F.instr("path", "/") == 0)).select(F.col("path").alias("subject"))
    return top.filter(~F.col("subject").rlike(r"^[._]|\.")).distinct()


def load_manifest(spark: SparkSession, path: str, nodes: DataFrame, multi_line: bool = True) -> DataFrame:
    """Manifest entries with node and leaf counts. Entries without a folder are skipped; entries whose
    folder holds nothing stay as unavailable."""
    schema = "slug string, name string, scope string, skill_folder string"
    entries = spark.read.schema(schema).json(path, multiLine=multi_line).filter(F.coalesce("skill_folder", F.lit("")) != "")
    counts = nodes.groupBy(F.substring_index("path", "/", 1).alias("_folder")).agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_leaf").alias("_l"))
    rows = entries.withColumn("_folder", F.substring_index("skill_folder", "/", -1)).join(counts, "_folder", "left")
    return rows.select(
        "slug",
        F.coalesce("name", "slug").alias("name"),
        F.coalesce("scope", F.lit("—")).alias("scope"),
        F.coalesce("_n", F.lit(0)).alias("total_nodes"),
        F.coalesce("_l", F.lit(0)).alias("total_leaves"),
        F.col("_n").isNotNull().alias("available"),
    )


def event_frames(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """``data:`` frames to rows, for files and streams alike. Other lines, the end mark and broken JSON drop."""
    body = F.trim(F.substr(F.col(value), F.lit(7)))
    rows = lines.filter(F.startswith(F.col(value), F.lit("data: "))).withColumn("_json", body)
    rows = rows.filter((F.col("_json") != "") & (F.col("_json") != "[DONE]"))
    parsed = rows.withColumn("_event", F.from_json("_json", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    kept = [c for c in lines.columns if c != value]
    return parsed.filter(F.col("_event._bad").isNull()).select(*kept, "_event.*").drop("_bad")


_NODE = "title string, description string, paragraph_start int, paragraph_end int, children array<string>"


def read_proposed_trees(replies: DataFrame, key: str = "doc_id", reply: str = "reply") -> DataFrame:
    """Trees in model replies, bare, fenced or in prose, as node rows of any depth. An unreadable reply gives one row with ``error``.

    Children are read as JSON text and opened level by level until a level has none.
    """
    parsed = cut_lineage(replies.select(key, extract_json_object(F.col(reply)).alias("x")))
    root = F.from_json(F.col("x.json"), "root string")["root"]
    nodes = parsed.select(key, F.col("x.error").alias("error"), F.from_json(root, _NODE).alias("n"))
    bad = F.when(F.col("error").isNull() & F.col("n.title").isNull(), "no tree").otherwise(F.col("error"))
    level = nodes.select(key, F.lit("r").alias("node_key"), F.lit(None).cast("string").alias("parent_key"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), "n", bad.alias("error"))
    out = None
    while True:
        level = cut_lineage(level)
        rows = level.select(key, "node_key", "parent_key", "ord", "depth", "n.title", "n.description", "n.paragraph_start", "n.paragraph_end", "error")
        out = rows if out is None else out.unionByName(rows)
        below = level.filter(F.col("error").isNull() & (F.size("n.children") > 0))
        if below.isEmpty():
            return out
        opened = below.select(key, F.col("node_key").alias("parent_key"), "depth", F.posexplode("n.children").alias("ord", "c"))
        level = opened.select(
            key,
            F.concat("parent_key", F.lit("/"), F.col("ord").cast("string")).alias("node_key"),
            "parent_key",
            "ord",
            (F.col("depth") + 1).alias("depth"),
            F.from_json("c", _NODE).alias("n"),
            F.lit(None).cast("string").alias("error"),
        ).filter(F.col("n").isNotNull())
