"""Paths, relations and statistics of trees held as parent links, and node ids made from titles."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom.functions import slugs
from leafloom.operators import ordered
from leafloom.session import cut_lineage


def climb(nodes: DataFrame, node: str, parent: str, fields: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """Adds ``path``: the fields of every ancestor and of the node itself, root first, at any depth.

    By doubling: each round joins a node's known path with that of the next ancestor above it. A parent that is no node ends a path;
    a cycle fails the job.
    """
    state = cut_lineage(nodes.withColumn("path", F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))).withColumn("_next", F.col(parent)))
    total, reach = state.count(), 1
    while not state.filter(F.col("_next").isNotNull()).isEmpty():
        if reach > total:
            raise ValueError("parent links form a cycle")
        # Rows that reached the root get a key of their own that matches nothing; null keys would all
        # meet in one partition.
        keyed = state.withColumn("_key", F.coalesce("_next", F.concat(F.lit("\u0001"), F.col(node))))
        above = state.select(*keys, F.col(node).alias("_key"), F.col("_next").alias("_up"), F.col("path").alias("_g"))
        joined = keyed.join(above, [*keys, "_key"], "left")
        path = F.when(F.col("_g").isNull(), F.col("path")).otherwise(F.concat("_g", "path"))
        state = cut_lineage(joined.withColumn("path", path).withColumn("_next", F.col("_up")).drop("_up", "_g", "_key"))
        reach *= 2
    return state.drop("_next")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Depth, id path, title path and an order key for ``(id, parent, ord, title)``."""
    fields = {"id": F.col("id"), "title": F.col("title"), "ord": F.lpad(F.col("ord").cast("string"), 12, "0")}
    rows = climb(nodes, "id", "parent", fields)
    join = lambda f, sep: F.array_join(F.transform("path", lambda p: p[f]), sep)
    return rows.select(
        *nodes.columns,
        (F.size("path") - 1).alias("depth"),
        join("id", "/").alias("id_path"),
        join("title", " › ").alias("title_path"),
        join("ord", "/").alias("path_key"),
        "path",
    )


def ancestors(nodes: DataFrame) -> DataFrame:
    """``(id, ancestor, distance)`` rows."""
    rows = tree_paths(nodes)
    up = F.slice("path", 1, F.col("depth"))
    return rows.select("id", "depth", F.posexplode(up).alias("_pos", "_a")).select(
        "id", F.col("_a.id").alias("ancestor"), (F.col("depth") - F.col("_pos")).alias("distance")
    )


def relations(nodes: DataFrame) -> DataFrame:
    """Parent, number of siblings with the node itself, and number of children.

    The siblings of a node are the rows with its parent; listing them per node would be quadratic.
    """
    kids = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    siblings = kids.select(F.coalesce("parent", F.lit("")).alias("_p"), F.col("n").alias("siblings"))
    children = kids.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id"), F.col("n").alias("children"))
    return (
        nodes.withColumn("_p", F.coalesce("parent", F.lit("")))
        .join(siblings, "_p")
        .join(children, "id", "left")
        .select("id", "parent", "siblings", F.coalesce("children", F.lit(0)).alias("children"))
    )


def tips(nodes: DataFrame) -> DataFrame:
    parents = nodes.filter(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    return nodes.join(parents, "id", "left_anti")


def leaf_breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Leaves with their titles from the chapter down; the root is left out."""
    rows = tree_paths(nodes).join(tips(nodes).select("id"), "id", "left_semi")
    below = F.slice("path", 2, F.greatest(F.col("depth"), F.lit(1)))
    return rows.filter(F.col("depth") > 0).select(
        "id", "title", F.array_join(F.transform(below, lambda p: p["title"]), " › ").alias("breadcrumb")
    )


def flatten_to_chapters(nodes: DataFrame) -> DataFrame:
    """Every leaf below a chapter becomes its direct leaf; ``path_key`` keeps document order."""
    rows = tree_paths(nodes).join(tips(nodes).select("id"), "id", "left_semi")
    return rows.filter(F.col("depth") > 1).select("id", F.col("path")[1]["id"].alias("chapter"), "path_key")


def sibling_nav(nodes: DataFrame) -> DataFrame:
    """Previous and next sibling."""
    rows = cut_lineage(nodes.select("id", "parent", "ord", F.coalesce("parent", F.lit("")).alias("_p")))
    rows = ordered.neighbour(rows, ["_p"], "ord", {"previous": F.col("id")}, step=-1)
    rows = ordered.neighbour(rows, ["_p"], "ord", {"next": F.col("id")}, step=1)
    return rows.select("id", "parent", "previous", "next")


def tree_counts(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes and leaves per tree for rows with ``is_leaf``."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("is_leaf").alias("total_leaves"))


def tree_stats(nodes: DataFrame, key: str) -> DataFrame:
    return nodes.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.min("start_page"), F.lit(0)).alias("min_page"),
        F.coalesce(F.max("end_page"), F.lit(0)).alias("max_page"),
    )


def page_span(pages: Column) -> tuple[Column, Column]:
    """First and last page of a list, 0 when it is empty."""
    return F.coalesce(F.array_min(pages), F.lit(0)), F.coalesce(F.array_max(pages), F.lit(0))


def book_span(chapters: DataFrame, key: str) -> DataFrame:
    """Span of a book: the least and greatest positive page of its chapters, else 0."""
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    return chapters.groupBy(key).agg(
        F.coalesce(F.min(positive("start_page")), F.lit(0)).alias("start_page"),
        F.coalesce(F.max(positive("end_page")), F.lit(0)).alias("end_page"),
    )


def numeric_prefix(name: Column) -> Column:
    return F.coalesce(F.regexp_extract(name, r"^(\d+)-", 1).try_cast("bigint"), F.lit(9007199254740991))


# --- slugs and node ids ---------------------------------------------------------------------------
_NUMBERED = r"^(.+)-(?:[2-9]|[1-9]\d+)$"


def unique_slugs(rows: DataFrame, group: list[str], order: str, base: str = "base") -> DataFrame:
    """Adds ``slug``: the base, or in order base-2, base-3 and so on, the first one free in the group.

    A base only competes with the same base, and with a base of the group that reads like one of its numbered forms (``a-2``, a child of ``a``). Which numbers the
    children take from it is settled first; then the n-th row of a base gets the n-th number that is left, by a running count of taken
    numbers. All of it is counts over blocks of an integer order, so a base of very many rows is spread.
    """
    keys = [*group, base]
    ranked = cut_lineage(ordered.ordinal(rows, keys, order, "_n"))
    bases = ranked.groupBy(*keys).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    links = _numbered_children(bases, group, base)
    if links.isEmpty():
        return ranked.withColumn("slug", _numbered_slug(F.col(base), F.col("_n") + 1)).drop("_n")
    taken, lost = _settled_numbers(ranked, links, group, base, order)
    # Row n of a base that lost its bare form to its stem is one number further.
    placed = ranked.join(lost.withColumn("_lost", F.lit(1)), keys, "left").withColumn("_p", F.col("_n") + F.coalesce("_lost", F.lit(0)))
    # The i-th number k that is taken lies behind k - 1 - i free ones, so it moves every later place by one.
    marks = ordered.ordinal(taken, keys, "_k", "_i").withColumn("_at", 2 * (F.col("_k") - 2 - F.col("_i")) + 1)
    marks = marks.groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_weight"))
    both = placed.withColumns({"_at": 2 * F.col("_p"), "_weight": F.lit(0).cast("bigint")}).unionByName(marks, allowMissingColumns=True)
    moved = ordered.prefix_sum(both, keys, "_at", F.col("_weight"), "_moved").filter(F.col("_p").isNotNull())
    return moved.withColumn("slug", _numbered_slug(F.col(base), F.col("_p") + 1 + F.col("_moved"))).select(*rows.columns, "slug")


def _numbered_slug(base: Column, number: Column) -> Column:
    return F.when(number == 1, base).otherwise(F.concat(base, F.lit("-"), number.cast("string")))


def _numbered_children(bases: DataFrame, group: list[str], base: str) -> DataFrame:
    """``(group, stem, _k, child, _first)`` of each base that reads like number ``_k`` of another one that could come that far."""
    stem = F.regexp_extract(base, _NUMBERED, 1)
    child = bases.withColumns({"_stem": stem, "_k": F.regexp_extract(base, r"-(\d+)$", 1).try_cast("bigint")}).filter((F.col("_stem") != "") & F.col("_k").isNotNull())
    return cut_lineage(
        child.join(bases.select(*group, F.col(base).alias("_stem")), [*group, "_stem"]).select(*group, "_stem", "_k", F.col(base).alias("_child"), "_first")
    )


def _settled_numbers(ranked: DataFrame, links: DataFrame, group: list[str], base: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Numbers that the children of a base take from it, ``(group, base, _k)``, and the children that come too late for it, ``(group, base)``.

    A child takes its number if its first row comes before the row of the stem that would. Which row that is depends on the numbers below that are taken, so
    bounds on these are narrowed until they meet: with more of them taken it is an earlier row. Stems come before their children, as a child may lose its bare form.
    """
    stem = [*group, "_stem"]
    times = ranked.select(*group, F.col(base).alias("_stem"), F.col("_n").alias("_row"), F.col(order).alias("_time"))
    links = links.select("*", F.lit(0).cast("bigint").alias("_low"), F.lit(1).cast("bigint").alias("_high"))
    waiting, taken, lost = links, [], []
    late = links.select(*group, "_child").limit(0)
    while not waiting.isEmpty():
        inner = waiting.select(*group, F.col("_child").alias("_stem"))
        level = cut_lineage(waiting.join(inner, stem, "left_anti").join(late.select(*group, F.col("_child").alias("_stem")).withColumn("_late", F.lit(1)), stem, "left"))
        waiting = cut_lineage(waiting.join(inner, stem, "left_semi"))
        while True:
            level = ordered.prefix_sum(level, stem, "_k", F.col("_low"), "_fewest")
            level = ordered.prefix_sum(level, stem, "_k", F.col("_high"), "_most")
            for bound, below in (("_low", "_most"), ("_high", "_fewest")):
                row = F.col("_k") - 1 - F.col(below) - F.coalesce("_late", F.lit(0))
                level = level.withColumn("_row", row).join(times, [*stem, "_row"], "left")
                level = level.withColumn(bound, F.coalesce(F.col("_first") < F.col("_time"), F.lit(True)).cast("bigint")).drop("_row", "_time")
            level = cut_lineage(level.drop("_fewest", "_most"))
            if level.filter("_low != _high").isEmpty():
                break
        late = level.filter("_low = 0").select(*group, "_child")
        taken.append(level.filter("_low = 1").select(*group, F.col("_stem").alias(base), "_k"))
        lost.append(late.select(*group, F.col("_child").alias(base)))
    return functools.reduce(DataFrame.unionByName, taken), functools.reduce(DataFrame.unionByName, lost)


def emit_node_ids(nodes: DataFrame, tree: str, subject: Column) -> DataFrame:
    """Order, unique slug, path and depth of every node; the root's path is the subject.

    Orders and slugs depend on siblings only, so all levels are done at once and the levels are joined
    just to put the segments together.
    """
    below = nodes.filter(F.col("parent_key").isNotNull())
    placed = ordered.ordinal(below, [tree, "parent_key"], "ord", "_pos").withColumn("order", (F.col("_pos") + 1).cast("int")).drop("_pos")
    # Read several times below, so each is written once.
    placed = cut_lineage(placed.withColumn("base", slugs.slugify(F.col("title"))))
    slugged = unique_slugs(placed, [tree, "parent_key"], "ord").drop("base")
    root = nodes.filter(F.col("parent_key").isNull()).withColumns({"order": F.lit(0), "slug": F.lit("")})
    segment = F.when(F.col("parent_key").isNull(), subject).otherwise(slugs.path_segment(F.col("order"), F.col("slug")))
    rows = cut_lineage(slugged.unionByName(root).withColumn("segment", segment))
    out = climb(rows, "node_key", "parent_key", {"segment": F.col("segment")}, [tree])
    path = F.transform("path", lambda p: p["segment"])
    return (
        out.withColumn("node_id", F.array_join(path, "/"))
        .withColumn("parent", F.when(F.size("path") > 1, F.array_join(F.slice(path, F.lit(1), F.size("path") - 1), "/")))
        .withColumn("depth", F.size("path") - 1)
        .drop("path", "segment")
    )
