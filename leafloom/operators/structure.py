"""Chapter drafts, proposed trees, their checks, and content fill.

Tables: paragraphs ``(doc_id, paragraph_id, page, text)``; bookmarks ``(doc_id, level, title, page)``;
nodes ``(doc_id, node_key, parent_key, ord, depth, title, description, paragraph_start, paragraph_end)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import ordered
from leafloom.session import cut_lineage
from leafloom.sources.snapshots import SnapshotStore
from leafloom.sources.tables import valid_bookmarks

TREE = "doc_id"


# --- chapters -------------------------------------------------------------------------------------
def chapter_ranges(bookmarks: DataFrame, documents: DataFrame) -> DataFrame:
    """Page range of every top-level bookmark: up to the page before the next one, or to the last page."""
    # Read twice by the next row's window, so the narrow frame is written once.
    top = cut_lineage(valid_bookmarks(bookmarks).filter(F.col("level") == 1).select(TREE, "title", "page"))
    following = ordered.neighbour(top, [TREE], "page", {"next_page": F.col("page")}, step=1, tie=["title"])
    last = F.greatest("page", F.coalesce(F.col("next_page") - 1, F.col("page_count")))
    return following.join(documents.select(TREE, "page_count"), TREE).select(
        TREE, "title", F.col("page").alias("first_page"), last.alias("last_page")
    )


def assign_chapters(paragraphs: DataFrame, bookmarks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chapter drafts with the first and last paragraph and their number.

    Page ranges are opened to pages, so paragraphs meet them by (document, page) equality: no range
    join, and a large document is spread over its pages. Paragraph numbers rise with the page, so
    first, last and count say which paragraphs a chapter holds. Documents left without a chapter get one
    untitled chapter.
    """
    per_page = paragraphs.groupBy(TREE, "page").agg(
        F.min("paragraph_id").alias("a"), F.max("paragraph_id").alias("b"), F.count(F.lit(1)).alias("n")
    )
    ranges = chapter_ranges(bookmarks, documents).withColumn("page", F.explode(F.sequence("first_page", "last_page")))
    counted = [F.min("a").alias("first_id"), F.max("b").alias("last_id"), F.sum("n").alias("paragraphs")]
    titled = ranges.join(per_page, [TREE, "page"]).groupBy(TREE, "title", "first_page", "last_page").agg(*counted)
    whole = (
        per_page.join(titled.select(TREE).distinct(), TREE, "left_anti")
        .groupBy(TREE)
        .agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), *counted)
        .withColumn("title", F.lit(None).cast("string"))
    )
    return titled.unionByName(whole)


def draft_chapter_lines(documents: DataFrame, chapters: DataFrame) -> DataFrame:
    """One line per chapter draft, or one of two fixed lines for documents without bookmark chapters."""
    titled = chapters.filter(F.col("title").isNotNull())
    first = ordered.ordinal(_unique_order(titled), [TREE], "_order", "_n")
    line = F.format_string(
        "%d. %s — pages %d–%d, paragraphs %d..%d (%d total)",
        F.col("_n") + 1, F.col("title"), F.col("first_page"), F.col("last_page"), F.col("first_id"), F.col("last_id"), F.col("paragraphs"),
    )
    named = first.select(TREE, (F.col("_n") + 1).cast("int").alias("chapter"), line.alias("line"))
    untitled = chapters.filter(F.col("title").isNull()).select(TREE, F.lit(0).alias("chapter"), F.lit(K.NO_BOOKMARKS).alias("line"))
    none = documents.join(chapters.select(TREE).distinct(), TREE, "left_anti").select(
        TREE, F.lit(0).alias("chapter"), F.lit(K.NO_DRAFT_CHAPTERS).alias("line")
    )
    return named.unionByName(untitled).unionByName(none)


def _unique_order(chapters: DataFrame) -> DataFrame:
    """An integer order that is unique per document: chapters that start on one page follow by title.

    The chapters of one page are ranked inside the page; the page takes the upper half of the number, so no two orders meet.
    """
    w = Window.partitionBy(TREE, "first_page").orderBy("title")
    return chapters.withColumn("_order", F.shiftleft(F.col("first_page").cast("bigint"), 32) + F.row_number().over(w))


# --- leaves and references ------------------------------------------------------------------------
def wide(rows: DataFrame) -> DataFrame:
    """For joins of rows opened from ranges. Spark takes their size for that of the ranges, and would send very many of them through the driver."""
    return rows.hint("merge")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    parents = nodes.filter(F.col("parent_key").isNotNull()).select(TREE, F.col("parent_key").alias("node_key")).distinct()
    return nodes.join(wide(parents), [TREE, "node_key"], "left_anti")


def good_range() -> Column:
    return F.col("paragraph_start").isNotNull() & (F.col("paragraph_end") >= F.col("paragraph_start"))


def paragraph_refs(nodes: DataFrame) -> DataFrame:
    """One row per referenced paragraph id; null and inverted ranges refer to nothing."""
    return nodes.filter(good_range()).select(
        TREE, "node_key", F.explode(F.sequence("paragraph_start", "paragraph_end")).alias("paragraph_id")
    )


def resolve_refs(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Referenced paragraphs that exist."""
    return paragraph_refs(nodes).join(wide(paragraphs), [TREE, "paragraph_id"])


def unreferenced(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    return paragraphs.select(TREE, "paragraph_id").join(paragraph_refs(nodes), [TREE, "paragraph_id"], "left_anti")


def hallucinated(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """References to paragraphs that do not exist."""
    return paragraph_refs(nodes).join(paragraphs.select(TREE, "paragraph_id"), [TREE, "paragraph_id"], "left_anti")


def coverage(nodes: DataFrame, paragraphs: DataFrame, threshold: float = K.COVERAGE_OK) -> DataFrame:
    """Share of paragraphs that the tree refers to; an empty document is covered.

    The list of missing paragraphs is ``unreferenced``, as rows.
    """
    total = paragraphs.groupBy(TREE).agg(F.count(F.lit(1)).alias("total"))
    used = (
        paragraph_refs(nodes)
        .join(paragraphs.select(TREE, "paragraph_id"), [TREE, "paragraph_id"], "left_semi")
        .select(TREE, "paragraph_id")
        .distinct()
        .groupBy(TREE)
        .agg(F.count(F.lit(1)).alias("referenced"))
    )
    trees = nodes.filter(F.col("parent_key").isNull()).select(TREE)
    rows = trees.join(total, TREE, "left").join(used, TREE, "left").fillna(0, ["total", "referenced"])
    share = F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("referenced") / F.col("total"))
    return rows.withColumn("coverage", share).withColumn("ok", F.col("coverage") >= threshold)


class CoverageError(ValueError):
    """A tree leaves out too much of its source."""


def require_coverage(result: DataFrame) -> None:
    """Stops the run when any tree is below the threshold. Looks at one failing row at most."""
    failed = result.filter(~F.col("ok")).limit(1).collect()
    if failed:
        raise CoverageError(f"coverage {failed[0]['coverage']:.3f} of tree {failed[0][TREE]} is too low")


def commit_covered(store: SnapshotStore, rows: DataFrame, result: DataFrame, version: int, base: int | None) -> None:
    """Commits snapshot rows, with their tree in ``doc_id``, unless a tree among them is below the threshold in ``result``, or is not in it.

    The trees that fail are counted by the job that writes the rows, so nothing is computed for the check alone, and the version counts only
    if there are none.
    """
    seen = Observation("coverage")
    ok = F.coalesce("_ok", F.lit(False))
    gated = rows.join(result.select(TREE, F.col("ok").alias("_ok"), F.col("coverage").alias("_coverage")), TREE, "left")
    gated = gated.observe(seen, F.count_if(~ok).alias("failed"), F.min(F.when(~ok, F.struct(F.coalesce("_coverage", F.lit(0.0)).alias("coverage"), F.col(TREE).cast("string").alias("tree")))).alias("least"))

    def check() -> None:
        found = seen.get
        if found["failed"]:
            raise CoverageError(f"coverage {found['least']['coverage']:.3f} of tree {found['least']['tree']} is too low; version {version} is not committed")

    store.commit(gated, version, base, check)


# --- checks ---------------------------------------------------------------------------------------
def tree_violations(nodes: DataFrame) -> DataFrame:
    """Broken leaf ranges: null, inverted, or overlapping the leaf before in paragraph order."""
    tips = leaves(nodes)
    start, end = F.col("paragraph_start"), F.col("paragraph_end")
    null = tips.filter(start.isNull() | end.isNull()).select(TREE, "node_key", F.lit("null_range").alias("rule"))
    inverted = tips.filter(end < start).select(TREE, "node_key", F.lit("inverted_range").alias("rule"))
    ranged = cut_lineage(tips.filter(start.isNotNull() & end.isNotNull()).select(TREE, "node_key", "ord", "paragraph_start", "paragraph_end"))
    near = ordered.neighbour(ranged, [TREE], "paragraph_start", {"previous_end": end}, step=-1, tie=["ord", "node_key"])
    overlap = near.filter(start <= F.col("previous_end")).select(TREE, "node_key", F.lit("overlap").alias("rule"))
    return null.unionByName(inverted).unionByName(overlap)


def range_gaps(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Paragraph ranges between consecutive leaves, before the first and after the last."""
    start, end = F.col("paragraph_start"), F.col("paragraph_end")
    ranged = cut_lineage(leaves(nodes).filter(good_range()).select(TREE, "node_key", "ord", "paragraph_start", "paragraph_end"))
    tie = ["ord", "node_key"]
    near = cut_lineage(ordered.neighbour(ranged, [TREE], "paragraph_start", {"before": end}, step=-1, tie=tie))
    near = ordered.neighbour(near, [TREE], "paragraph_start", {"after": start}, step=1, tie=tie)
    last = paragraphs.groupBy(TREE).agg(F.max("paragraph_id").alias("last_id"))
    rows = near.join(last, TREE)
    lead = F.coalesce("before", F.lit(-1)) + 1
    inner = rows.filter(start > lead).select(TREE, lead.alias("gap_start"), (start - 1).alias("gap_end"))
    tail = rows.filter(F.col("after").isNull() & (end < F.col("last_id"))).select(
        TREE, (end + 1).alias("gap_start"), F.col("last_id").alias("gap_end")
    )
    return inner.unionByName(tail)


IMBALANCE = 4
TOO_BROAD = 20
BLOCKING = ["missing_coverage", "structural_imbalance", "sibling_duplication"]


def tree_lint(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Issue rows by rule: imbalance among siblings, equal sibling titles, missing coverage, depth, naming."""
    children = (
        nodes.filter(F.col("parent_key").isNotNull())
        .groupBy(TREE, F.col("parent_key").alias("node_key"))
        .agg(F.count(F.lit(1)).alias("children"))
    )
    internal = nodes.select(TREE, "node_key", "parent_key").join(children, [TREE, "node_key"])
    least = internal.groupBy(TREE, "parent_key").agg(F.min("children").alias("fewest"))

    def issue(rows: DataFrame, category: str) -> DataFrame:
        return rows.select(TREE, "node_key", F.lit(category).alias("category"))

    uneven = internal.join(least, [TREE, "parent_key"]).filter(F.col("children") >= IMBALANCE * F.col("fewest"))
    single = internal.filter(F.col("children") == 1)
    size = F.when(good_range(), F.col("paragraph_end") - F.col("paragraph_start") + 1).otherwise(0)
    odd_size = leaves(nodes).filter((size == 1) | (size > TOO_BROAD))
    named = nodes.withColumn("_title", T.normalize_line(F.col("title")))
    repeated = named.groupBy(TREE, "parent_key", "_title").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    twins = named.join(repeated, [TREE, "parent_key", "_title"])
    vague = nodes.filter(F.col("title").rlike(K.VAGUE_TITLE))
    missing = unreferenced(nodes, paragraphs).select(TREE).distinct()
    uncovered = nodes.filter(F.col("parent_key").isNull()).join(missing, TREE, "left_semi")
    return (
        issue(uneven, "structural_imbalance")
        .unionByName(issue(twins, "sibling_duplication"))
        .unionByName(issue(uncovered, "missing_coverage"))
        .unionByName(issue(single, "inappropriate_depth"))
        .unionByName(issue(odd_size, "inappropriate_depth"))
        .unionByName(issue(vague, "poor_naming"))
    )


def lint_quality(nodes: DataFrame, issues: DataFrame) -> DataFrame:
    # Filtered first, so that the issues that block nothing are not looked for.
    blocking = issues.filter(F.col("category").isin(BLOCKING)).groupBy(TREE).agg(F.count(F.lit(1)).alias("blocking"))
    quality = F.when(F.coalesce("blocking", F.lit(0)) > 0, "needs_revision").otherwise("good")
    trees = nodes.filter(F.col("parent_key").isNull()).select(TREE)
    return trees.join(blocking, TREE, "left").select(TREE, quality.alias("quality"))


# --- content --------------------------------------------------------------------------------------
def leaf_bodies(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Body of each leaf: its paragraphs verbatim but for repaired line breaks, else its description.

    A body is one value by definition, so the paragraphs of one leaf meet in one row.
    """
    tips = leaves(nodes)
    text = T.repair_soft_breaks(F.col("text"))
    parts = (
        resolve_refs(tips.select(TREE, "node_key", "paragraph_start", "paragraph_end"), paragraphs)
        .select(TREE, "node_key", "paragraph_id", text.alias("text"))
        .filter(F.col("text") != "")
    )
    rows = F.array_sort(F.collect_list(F.struct("paragraph_id", "text")))
    body = F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n")
    joined = parts.groupBy(TREE, "node_key").agg(T.strip(F.regexp_replace(body, r"\n{3,}", "\n\n")).alias("_body"))
    return tips.join(joined, [TREE, "node_key"], "left").select(
        *nodes.columns, F.coalesce(F.nullif("_body", F.lit("")), "description").alias("body")
    )


def contents_outline(nodes: DataFrame) -> DataFrame:
    """Body of each internal node: a heading and a bullet per child in order."""
    bullet = F.concat(F.lit("- **"), F.col("title"), F.lit("** — "), F.col("description"))
    rows = F.array_sort(F.collect_list(F.struct("ord", "node_key", bullet.alias("line"))))
    lines = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return (
        nodes.filter(F.col("parent_key").isNotNull())
        .groupBy(TREE, F.col("parent_key").alias("node_key"))
        .agg(F.concat(F.lit("## Contents\n\n"), lines).alias("body"))
    )


def source_pages(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Pages per node: a leaf's own, an inner node's direct children's."""
    refs = resolve_refs(nodes, paragraphs.select(TREE, "paragraph_id", "page")).select(TREE, "node_key", "page").distinct()
    own = refs.join(wide(leaves(nodes).select(TREE, "node_key")), [TREE, "node_key"], "left_semi")
    parent = nodes.filter(F.col("parent_key").isNotNull()).select(TREE, "node_key", "parent_key")
    passed = refs.join(wide(parent), [TREE, "node_key"]).select(TREE, F.col("parent_key").alias("node_key"), "page")
    pages = own.unionByName(passed).groupBy(TREE, "node_key").agg(F.array_sort(F.collect_set("page")).alias("source_pages"))
    none = F.array().cast("array<int>")
    return nodes.select(TREE, "node_key").join(wide(pages), [TREE, "node_key"], "left").withColumn("source_pages", F.coalesce("source_pages", none))


# --- prompt lines ---------------------------------------------------------------------------------
def paragraph_lines(paragraphs: DataFrame, limit: int = K.PROMPT_PARAGRAPH_CHARS) -> DataFrame:
    """One line per paragraph; the block of a document is its lines in order."""
    line = F.format_string("[ID:%d page:%d] %s", "paragraph_id", "page", T.cut(F.col("text"), limit, " [...]"))
    return paragraphs.select(TREE, "paragraph_id", line.alias("line"))


def generator_lines(paragraphs: DataFrame) -> DataFrame:
    line = F.format_string("[paragraph_id=%d] %s", "paragraph_id", T.cut(F.col("text"), K.GENERATOR_PARAGRAPH_CHARS, " […]"))
    return paragraphs.select("node_id", "paragraph_id", line.alias("line"))


def leaf_samples(nodes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Bullets of the first five paragraphs a leaf refers to."""
    head = leaves(nodes).withColumn(
        "paragraph_end", F.least("paragraph_end", F.col("paragraph_start") + K.LEAF_SAMPLE_PARAGRAPHS - 1)
    )
    rows = resolve_refs(head, paragraphs.select(TREE, "paragraph_id", "text"))
    line = F.concat(F.lit("- "), T.cut(F.col("text"), K.SNIPPET_CHARS, " [...]"))
    lines = F.array_sort(F.collect_list(F.struct("paragraph_id", line.alias("line"))))
    return rows.groupBy(TREE, "node_key").agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("sample"))
