"""Structure, content and tree queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import slugs
from leafloom.functions import text as T
from leafloom.operators import structure as S
from leafloom.operators import trees
from leafloom.plans import fixtures as fx
from leafloom.plans.registry import block, query
from leafloom.session import Tables, cut_lineage, fresh_path, stored
from leafloom.sources import tables as src
from leafloom.sources.snapshots import SnapshotStore


def doc_pages(t: Tables) -> DataFrame:
    from leafloom.operators.cleaning import paragraph_array

    n = F.size(paragraph_array(F.col("text"), fx.LINES))
    return t("documents").select("doc_id", F.ceil(n / fx.PARAGRAPHS_PER_PAGE).cast("int").alias("page_count"))


def paras(t: Tables) -> DataFrame:
    return fx.paragraphs(t).select("doc_id", "paragraph_id", "page", "text")


@query(
    "load_bookmarks",
    "SELECT doc_id, level, trim(title) AS title, page FROM fx_bookmark WHERE level >= 1 AND page >= 1 AND trim(title) <> ''",
    ("fx_bookmark",),
)
def _(t):
    return src.valid_bookmarks(fx.bookmarks(t))


block(
    "chapter_range",
    """
SELECT b.doc_id, b.title, b.page AS first_page,
       CAST(greatest(b.page, coalesce(lead(b.page) OVER (PARTITION BY b.doc_id ORDER BY b.page, b.title) - 1, d.pages)) AS INTEGER) AS last_page
FROM (SELECT doc_id, trim(title) AS title, page FROM fx_bookmark WHERE level = 1 AND trim(title) <> '') b JOIN fx_doc_pages d USING (doc_id)""",
    "fx_bookmark",
)
block(
    "chapter",
    """
SELECT c.doc_id, c.title, c.first_page, c.last_page, min(p.paragraph_id) AS first_id, max(p.paragraph_id) AS last_id, count(*) AS paragraphs
FROM chapter_range c JOIN fx_paragraph p ON p.doc_id = c.doc_id AND p.page BETWEEN c.first_page AND c.last_page
GROUP BY c.doc_id, c.title, c.first_page, c.last_page""",
    "chapter_range",
    "fx_paragraph",
)
block(
    "any_chapter",
    """
SELECT * FROM chapter UNION ALL
SELECT doc_id, NULL, min(page), max(page), min(paragraph_id), max(paragraph_id), count(*) FROM fx_paragraph
WHERE doc_id NOT IN (SELECT doc_id FROM chapter) GROUP BY doc_id""",
    "chapter",
)


@query("chapter_ranges", "SELECT doc_id, title, first_page, last_page FROM chapter_range", ("chapter_range",))
def _(t):
    return S.chapter_ranges(fx.bookmarks(t), doc_pages(t))


@query(
    "assign_chapters",
    "SELECT doc_id, title, first_page, last_page, first_id, last_id, paragraphs FROM any_chapter",
    ("any_chapter",),
)
def _(t):
    return S.assign_chapters(paras(t), fx.bookmarks(t), doc_pages(t))


@query(
    "render_draft_chapters",
    f"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_page, title) AS INTEGER) AS chapter,
       row_number() OVER (PARTITION BY doc_id ORDER BY first_page, title) || '. ' || title || ' — pages ' || first_page || '–' || last_page ||
       ', paragraphs ' || first_id || '..' || last_id || ' (' || paragraphs || ' total)' AS line
FROM chapter
UNION ALL SELECT doc_id, 0, {fx.sql_text(K.NO_BOOKMARKS)} FROM any_chapter WHERE title IS NULL
UNION ALL SELECT doc_id, 0, {fx.sql_text(K.NO_DRAFT_CHAPTERS)} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM any_chapter)""",
    ("any_chapter",),
)
def _(t):
    return S.draft_chapter_lines(doc_pages(t), S.assign_chapters(paras(t), fx.bookmarks(t), doc_pages(t)))


block(
    "ref",
    """
SELECT doc_id, node_key, CAST(unnest(range(paragraph_start, paragraph_end + 1)) AS INTEGER) AS paragraph_id
FROM fx_node WHERE paragraph_start IS NOT NULL AND paragraph_end >= paragraph_start""",
    "fx_node",
)
block(
    "tip",
    "SELECT * FROM fx_node n WHERE NOT EXISTS (SELECT 1 FROM fx_node c WHERE c.doc_id = n.doc_id AND c.parent_key = n.node_key)",
    "fx_node",
)


@query("collect_leaves", "SELECT doc_id, node_key, ord, title FROM tip", ("tip",))
def _(t):
    return S.leaves(fx.nodes(t)).select("doc_id", "node_key", "ord", "title")


@query(
    "resolve_paragraph_refs",
    "SELECT r.doc_id, r.node_key, r.paragraph_id, p.page, p.text FROM ref r JOIN fx_paragraph p USING (doc_id, paragraph_id)",
    ("ref", "fx_paragraph"),
)
def _(t):
    return S.resolve_refs(fx.nodes(t), paras(t)).select("doc_id", "node_key", "paragraph_id", "page", "text")


@query(
    "unreferenced_paragraphs",
    "SELECT doc_id, paragraph_id FROM fx_paragraph EXCEPT SELECT doc_id, paragraph_id FROM ref",
    ("ref", "fx_paragraph"),
)
def _(t):
    return S.unreferenced(fx.nodes(t), paras(t))


@query(
    "hallucinated_refs",
    "SELECT doc_id, node_key, paragraph_id FROM ref r WHERE NOT EXISTS (SELECT 1 FROM fx_paragraph p WHERE p.doc_id = r.doc_id AND p.paragraph_id = r.paragraph_id)",
    ("ref", "fx_paragraph"),
)
def _(t):
    return S.hallucinated(fx.nodes(t), paras(t)).select("doc_id", "node_key", "paragraph_id")


@query(
    "ref_intersection",
    """
SELECT doc_id, paragraph_id, true AS is_known FROM (SELECT doc_id, paragraph_id FROM ref INTERSECT SELECT doc_id, paragraph_id FROM fx_paragraph)
UNION ALL
SELECT doc_id, paragraph_id, false FROM (SELECT doc_id, paragraph_id FROM ref EXCEPT SELECT doc_id, paragraph_id FROM fx_paragraph)""",
    ("ref", "fx_paragraph"),
)
def _(t):
    refs = S.paragraph_refs(fx.nodes(t)).select("doc_id", "paragraph_id")
    known = paras(t).select("doc_id", "paragraph_id")
    return refs.intersect(known).withColumn("is_known", F.lit(True)).union(refs.subtract(known).withColumn("is_known", F.lit(False)))


@query(
    "coverage",
    """
SELECT d.doc_id, coalesce(t.total, 0) AS total, coalesce(u.referenced, 0) AS referenced,
       round(CASE WHEN coalesce(t.total, 0) = 0 THEN 1.0::DOUBLE ELSE coalesce(u.referenced, 0)::DOUBLE / t.total END, 6) AS coverage,
       CASE WHEN coalesce(t.total, 0) = 0 THEN true ELSE coalesce(u.referenced, 0)::DOUBLE / t.total >= 0.95 END AS ok
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS total FROM fx_paragraph GROUP BY doc_id) t USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS referenced FROM (SELECT DISTINCT doc_id, paragraph_id FROM ref JOIN fx_paragraph USING (doc_id, paragraph_id)) GROUP BY doc_id) u USING (doc_id)""",
    ("ref", "fx_paragraph"),
)
def _(t):
    return S.coverage(fx.nodes(t), paras(t)).withColumn("coverage", F.round("coverage", 6))


@query(
    "coverage_gate",
    """
SELECT n.doc_id, count(*) AS nodes FROM fx_node n
LEFT JOIN (SELECT doc_id, count(*) AS total FROM fx_paragraph GROUP BY doc_id) t USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS referenced FROM (SELECT DISTINCT doc_id, paragraph_id FROM ref JOIN fx_paragraph USING (doc_id, paragraph_id)) GROUP BY doc_id) u USING (doc_id)
WHERE t.total IS NULL OR coalesce(u.referenced, 0)::DOUBLE / t.total >= 0.95 GROUP BY n.doc_id""",
    ("ref", "fx_node", "fx_paragraph"),
)
def _(t):
    """Trees that cover their documents are committed; a delivery with any other tree in it is refused as a whole and leaves them as they are."""
    nodes = cut_lineage(fx.nodes(t))
    result = cut_lineage(S.coverage(nodes, paras(t)))
    path = lambda c: F.concat_ws("/", F.col("doc_id").cast("string"), c)
    # A store has a folder per subject; here a subject is a bin of documents.
    rows = nodes.select(
        "doc_id", F.concat(F.lit("bin"), (F.col("doc_id") % 8).cast("string")).alias("subject"), path("node_key").alias("node_id"), path("parent_key").alias("parent"),
        "depth", F.col("ord").alias("order"), F.col("title").alias("name"), F.lit("").alias("body"), F.lit(None).alias("sources"), F.lit(None).alias("content_hash"),
    )
    store = SnapshotStore(t.spark, fresh_path(t.spark, "gated"))
    S.commit_covered(store, rows.join(result.filter("ok").select("doc_id"), "doc_id", "left_semi"), result, 0, None)
    try:
        S.commit_covered(store, rows, result, 1, 0)
    except S.CoverageError:
        pass
    return store.read().groupBy(F.split_part("node_id", F.lit("/"), F.lit(1)).cast("bigint").alias("doc_id")).agg(F.count(F.lit(1)).alias("nodes"))


@query(
    "tree_violations",
    """
SELECT doc_id, node_key, 'null_range' AS rule FROM tip WHERE paragraph_start IS NULL OR paragraph_end IS NULL
UNION ALL SELECT doc_id, node_key, 'inverted_range' FROM tip WHERE paragraph_end < paragraph_start
UNION ALL SELECT doc_id, node_key, 'overlap' FROM (
  SELECT *, lag(paragraph_end) OVER (PARTITION BY doc_id ORDER BY paragraph_start, ord, node_key) AS previous_end
  FROM tip WHERE paragraph_start IS NOT NULL AND paragraph_end IS NOT NULL) WHERE paragraph_start <= previous_end""",
    ("tip",),
)
def _(t):
    return S.tree_violations(fx.nodes(t))


block(
    "ranged",
    """
SELECT *, lag(paragraph_end) OVER w AS before, lead(paragraph_start) OVER w AS after
FROM tip JOIN (SELECT doc_id, max(paragraph_id) AS last_id FROM fx_paragraph GROUP BY doc_id) USING (doc_id)
WHERE paragraph_start IS NOT NULL AND paragraph_end >= paragraph_start
WINDOW w AS (PARTITION BY doc_id ORDER BY paragraph_start, ord, node_key)""",
    "tip",
    "fx_paragraph",
)


@query(
    "range_gaps",
    """
SELECT doc_id, CAST(coalesce(before, -1) + 1 AS INTEGER) AS gap_start, CAST(paragraph_start - 1 AS INTEGER) AS gap_end FROM ranged WHERE paragraph_start > coalesce(before, -1) + 1
UNION ALL SELECT doc_id, CAST(paragraph_end + 1 AS INTEGER), last_id FROM ranged WHERE after IS NULL AND paragraph_end < last_id""",
    ("ranged",),
)
def _(t):
    return S.range_gaps(fx.nodes(t), paras(t))


block(
    "kid",
    "SELECT n.doc_id, n.node_key, n.parent_key AS up, count(*) AS n FROM fx_node n JOIN fx_node c ON c.doc_id = n.doc_id AND c.parent_key = n.node_key GROUP BY ALL",
    "fx_node",
)
block(
    "lint",
    r"""
SELECT k.doc_id, k.node_key, 'structural_imbalance' AS category FROM kid k JOIN (SELECT doc_id, up, min(n) AS fewest FROM kid GROUP BY doc_id, up) m ON m.doc_id = k.doc_id AND m.up = k.up WHERE n >= 4 * fewest
UNION ALL SELECT n.doc_id, n.node_key, 'sibling_duplication' FROM fx_node n JOIN (SELECT doc_id, parent_key, lower(title) AS lt FROM fx_node WHERE parent_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1) d
  ON d.doc_id = n.doc_id AND d.parent_key = n.parent_key AND d.lt = lower(n.title)
UNION ALL SELECT DISTINCT doc_id, 'r', 'missing_coverage' FROM (SELECT doc_id, paragraph_id FROM fx_paragraph EXCEPT SELECT doc_id, paragraph_id FROM ref)
UNION ALL SELECT doc_id, node_key, 'inappropriate_depth' FROM kid WHERE n = 1
UNION ALL SELECT doc_id, node_key, 'inappropriate_depth' FROM tip WHERE paragraph_start IS NOT NULL AND (paragraph_end - paragraph_start = 0 OR paragraph_end - paragraph_start + 1 > 20)
UNION ALL SELECT doc_id, node_key, 'poor_naming' FROM fx_node WHERE regexp_matches(title, '(?i)^(?:(?:chapter|section)\s+\w{1,3}|introduction|other|miscellaneous)$')""",
    "kid",
    "tip",
    "ref",
    "fx_paragraph",
)


@query("tree_lint", "SELECT doc_id, node_key, category FROM lint", ("lint",))
def _(t):
    return S.tree_lint(*fx.nodes_and_ids(t))


@query(
    "tree_lint_quality",
    """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM lint WHERE category IN ('missing_coverage', 'structural_imbalance', 'sibling_duplication'))
       THEN 'needs_revision' ELSE 'good' END AS quality FROM documents""",
    ("lint",),
)
def _(t):
    n, ids = fx.nodes_and_ids(t)
    return S.lint_quality(n, S.tree_lint(n, ids))


block(
    "body",
    r"""
SELECT t.*, coalesce(b.body, t.description) AS body FROM tip t LEFT JOIN (
  SELECT doc_id, node_key, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id) AS body FROM ref JOIN fx_paragraph USING (doc_id, paragraph_id) GROUP BY doc_id, node_key) b USING (doc_id, node_key)""",
    "tip",
    "ref",
    "fx_paragraph",
)


@query("assemble_leaf_body", "SELECT doc_id, node_key, body FROM body", ("body",))
def _(t):
    return S.leaf_bodies(fx.nodes(t), paras(t)).select("doc_id", "node_key", "body")


@query(
    "contents_outline",
    """
SELECT doc_id, parent_key AS node_key, '## Contents' || chr(10) || chr(10) || string_agg('- **' || title || '** — ' || description, chr(10) ORDER BY ord) AS body
FROM fx_node WHERE parent_key IS NOT NULL GROUP BY doc_id, parent_key""",
    ("fx_node",),
)
def _(t):
    return S.contents_outline(fx.nodes(t))


block(
    "node_page",
    """
SELECT n.doc_id, n.node_key, coalesce(p.pages, []) AS pages FROM fx_node n LEFT JOIN (
  SELECT doc_id, node_key, list_sort(list(DISTINCT page)) AS pages FROM (
    SELECT r.doc_id, r.node_key, p.page FROM ref r JOIN fx_paragraph p USING (doc_id, paragraph_id)
    UNION ALL SELECT r.doc_id, c.parent_key, p.page FROM ref r JOIN fx_paragraph p USING (doc_id, paragraph_id) JOIN fx_node c ON c.doc_id = r.doc_id AND c.node_key = r.node_key WHERE c.parent_key IS NOT NULL
  ) GROUP BY doc_id, node_key) p USING (doc_id, node_key)""",
    "ref",
    "fx_paragraph",
)


@query("source_pages", "SELECT doc_id, node_key, array_to_string(pages, ',') AS pages FROM node_page", ("node_page",))
def _(t):
    rows = S.source_pages(fx.nodes(t), paras(t))
    return rows.select("doc_id", "node_key", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"))


_PAGES_SQL = "CASE WHEN len(pages) = 0 THEN 'pages unknown' WHEN len(pages) = 1 THEN 'page ' || pages[1] ELSE 'pages ' || list_min(pages) || '-' || list_max(pages) END"


@query("format_pages", f"SELECT doc_id, node_key, {_PAGES_SQL} AS label FROM node_page", ("node_page",))
def _(t):
    return S.source_pages(fx.nodes(t), paras(t)).select("doc_id", "node_key", T.format_pages(F.col("source_pages")).alias("label"))


def _leaf_with_pages(t: Tables) -> DataFrame:
    nodes, paragraphs = fx.nodes(t), stored(paras(t), "paragraphs")
    return S.leaf_bodies(nodes, paragraphs).join(S.source_pages(nodes, paragraphs), ["doc_id", "node_key"])


block(
    "wrapped",
    f"""
SELECT doc_id, node_key, '## Source 1 (' || {_PAGES_SQL} || ')' || chr(10) || chr(10) || trim(body) || chr(10) AS wrapped
FROM body JOIN node_page USING (doc_id, node_key)""",
    "body",
    "node_page",
)


@query("wrap_leaf_body", "SELECT doc_id, node_key, wrapped FROM wrapped", ("wrapped",))
def _(t):
    once = T.wrap_leaf_body(F.col("body"), F.col("source_pages"))
    return _leaf_with_pages(t).select("doc_id", "node_key", T.wrap_leaf_body(once, F.col("source_pages")).alias("wrapped"))


@query("content_hash", "SELECT doc_id, node_key, 'sha256:' || sha256(wrapped) AS content_hash FROM wrapped", ("wrapped",))
def _(t):
    wrapped = T.wrap_leaf_body(F.col("body"), F.col("source_pages"))
    return _leaf_with_pages(t).select("doc_id", "node_key", T.content_hash(wrapped).alias("content_hash"))


@query(
    "render_paragraph_block",
    r"""
SELECT doc_id, paragraph_id, '[ID:' || paragraph_id || ' page:' || page || '] ' ||
       CASE WHEN length(text) > 400 THEN regexp_replace(substr(text, 1, 400), '\s+$', '') || ' [...]' ELSE text END AS line FROM fx_paragraph""",
    ("fx_paragraph",),
)
def _(t):
    return S.paragraph_lines(paras(t))


@query(
    "render_generator_block",
    r"""
SELECT node_id, paragraph_id, '[paragraph_id=' || paragraph_id || '] ' ||
       CASE WHEN length(text) > 800 THEN regexp_replace(substr(text, 1, 800), '\s+$', '') || ' […]' ELSE text END AS line FROM fx_paragraph""",
    ("fx_paragraph",),
)
def _(t):
    return S.generator_lines(fx.paragraphs(t))


@query(
    "leaf_sample",
    r"""
SELECT doc_id, node_key, string_agg('- ' || CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '\s+$', '') || ' [...]' ELSE text END, chr(10) ORDER BY paragraph_id) AS sample
FROM ref JOIN tip USING (doc_id, node_key) JOIN fx_paragraph USING (doc_id, paragraph_id) WHERE paragraph_id < paragraph_start + 5
GROUP BY doc_id, node_key""",
    ("ref", "tip", "fx_paragraph"),
)
def _(t):
    return S.leaf_samples(fx.nodes(t), paras(t))


# --- tree statistics ------------------------------------------------------------------------------
def _spanned(t: Tables) -> DataFrame:
    n, ids = fx.nodes_and_ids(t)
    pages = S.source_pages(n, ids)
    start, end = trees.page_span(F.col("source_pages"))
    leaf = S.leaves(n).select("doc_id", "node_key", F.lit(True).alias("is_leaf"))
    return (
        n.join(S.wide(pages), ["doc_id", "node_key"])
        .join(S.wide(leaf), ["doc_id", "node_key"], "left")
        .select("doc_id", "node_key", "depth", F.coalesce("is_leaf", F.lit(False)).alias("is_leaf"), start.alias("start_page"), end.alias("end_page"))
    )


block(
    "spanned",
    """
SELECT n.doc_id, n.node_key, n.depth, coalesce(list_min(p.pages), 0) AS start_page, coalesce(list_max(p.pages), 0) AS end_page,
       EXISTS (SELECT 1 FROM tip WHERE tip.doc_id = n.doc_id AND tip.node_key = n.node_key) AS is_leaf
FROM fx_node n JOIN node_page p USING (doc_id, node_key)""",
    "node_page",
    "tip",
)


@query(
    "tree_counts",
    "SELECT doc_id, count(*) AS total_nodes, count(*) FILTER (is_leaf) AS total_leaves FROM spanned GROUP BY doc_id",
    ("spanned",),
)
def _(t):
    return trees.tree_counts(_spanned(t), "doc_id")


@query(
    "tree_stats",
    "SELECT doc_id, count(*) AS total_nodes, max(depth) AS max_depth, min(start_page) AS min_page, max(end_page) AS max_page FROM spanned GROUP BY doc_id",
    ("spanned",),
)
def _(t):
    return trees.tree_stats(_spanned(t), "doc_id")


@query(
    "page_span_rollup",
    """
SELECT doc_id, coalesce(min(start_page) FILTER (start_page > 0), 0) AS start_page, coalesce(max(end_page) FILTER (end_page > 0), 0) AS end_page
FROM spanned WHERE depth = 1 GROUP BY doc_id""",
    ("spanned",),
)
def _(t):
    return trees.book_span(_spanned(t).filter("depth = 1"), "doc_id")


block(
    "walk",
    """
SELECT id, parent, ord, title, CAST(0 AS INTEGER) AS depth, id AS id_path, title AS title_path, lpad(CAST(ord AS VARCHAR), 12, '0') AS path_key, '' AS crumb, '' AS chapter FROM fx_tree WHERE parent IS NULL
UNION ALL
SELECT c.id, c.parent, c.ord, c.title, w.depth + 1, w.id_path || '/' || c.id, w.title_path || ' › ' || c.title, w.path_key || '/' || lpad(CAST(c.ord AS VARCHAR), 12, '0'),
       CASE WHEN w.depth = 0 THEN c.title ELSE w.crumb || ' › ' || c.title END, CASE WHEN w.depth = 0 THEN c.id ELSE w.chapter END
FROM walk w JOIN fx_tree c ON c.parent = w.id""",
    "fx_tree",
)


@query("tree_paths", "SELECT id, parent, ord, title, depth, id_path, title_path, path_key FROM walk", ("walk",))
def _(t):
    return trees.tree_paths(fx.place_tree(t)).drop("path")


@query(
    "ancestors",
    """
SELECT w.id, a.id AS ancestor, CAST(w.depth - a.depth AS INTEGER) AS distance FROM walk w JOIN walk a ON starts_with(w.id_path, a.id_path || '/')""",
    ("walk",),
)
def _(t):
    return trees.ancestors(fx.place_tree(t))


@query(
    "parent_siblings_children",
    """
SELECT id, parent, count(*) OVER (PARTITION BY parent) AS siblings, (SELECT count(*) FROM fx_tree c WHERE c.parent = t.id) AS children FROM fx_tree t""",
    ("fx_tree",),
)
def _(t):
    return trees.relations(fx.place_tree(t))


@query(
    "leaf_breadcrumbs",
    "SELECT id, title, crumb AS breadcrumb FROM walk WHERE depth > 0 AND id NOT IN (SELECT parent FROM fx_tree WHERE parent IS NOT NULL)",
    ("walk",),
)
def _(t):
    return trees.leaf_breadcrumbs(fx.place_tree(t))


@query(
    "flatten_to_two_levels",
    "SELECT id, chapter, path_key FROM walk WHERE depth > 1 AND id NOT IN (SELECT parent FROM fx_tree WHERE parent IS NOT NULL)",
    ("walk",),
)
def _(t):
    return trees.flatten_to_chapters(fx.place_tree(t))


@query(
    "sibling_nav",
    """
SELECT id, parent, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM fx_tree WINDOW w AS (PARTITION BY parent ORDER BY ord)""",
    ("fx_tree",),
)
def _(t):
    return trees.sibling_nav(fx.place_tree(t))


@query(
    "numeric_prefix_sort",
    r"""
SELECT name, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(nullif(regexp_extract(name, '^(\d+)-', 1), '') AS BIGINT), 9007199254740991), name) AS INTEGER) AS place
FROM (SELECT DISTINCT CASE WHEN p_size % 7 = 0 THEN lower(p_type) ELSE p_size || '-' || lower(p_type) END AS name FROM part)""",
)
def _(t):
    size, kind = F.col("p_size"), F.lower("p_type")
    name = F.when(size % 7 == 0, kind).otherwise(F.concat(size.cast("string"), F.lit("-"), kind))
    names = t("part").select(name.alias("name")).distinct()
    return _placed(names)


def _placed(names: DataFrame) -> DataFrame:
    """Sorts names by number and then name; the place of a row is its partition's start plus its position.

    A sort ranges over all partitions, so no task holds the whole list.
    """
    from leafloom.operators.ordered import global_order

    return global_order(names.withColumn("_n", trees.numeric_prefix(F.col("name"))), ["_n", "name"], "place").select(
        "name", F.col("place").cast("int").alias("place")
    )


# --- slugs ----------------------------------------------------------------------------------------
_SLUG_SQL = (
    r"regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '')"
)


def slug_sql(x: str) -> str:
    s = _SLUG_SQL.format(x=x)
    return f"CASE WHEN {s} = '' THEN 'untitled' ELSE {s} END"


block(
    "slug_base",
    f"SELECT lang AS grp, doc_id, {slug_sql('substr(string_split(text, chr(10))[1], 1, 8)')} AS base FROM documents",
)


@query("slugify", f"SELECT doc_id, {slug_sql('string_split(text, chr(10))[1]')} AS slug FROM documents")
def _(t):
    return t("documents").select("doc_id", slugs.slugify(F.substring_index("text", "\n", 1)).alias("slug"))


block(
    "issue",
    """
SELECT grp, base, doc_id, CAST(row_number() OVER (PARTITION BY grp, base ORDER BY doc_id) AS BIGINT) AS n FROM slug_base""",
    "slug_base",
)


@query(
    "unique_slugs",
    "SELECT grp, doc_id, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM issue",
    ("issue",),
)
def _(t):
    title = F.substring(F.substring_index("text", "\n", 1), 1, 8)
    rows = t("documents").select(F.col("lang").alias("grp"), "doc_id", slugs.slugify(title).alias("base"))
    return trees.unique_slugs(rows, ["grp"], "doc_id").select("grp", "doc_id", "base", "slug")


block(
    "slugged",
    f"""
SELECT doc_id, node_key, parent_key, depth, pos, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, parent_key, base ORDER BY ord) AS n FROM (
    SELECT *, {slug_sql('title')} AS base, row_number() OVER (PARTITION BY doc_id, parent_key ORDER BY ord) AS pos FROM fx_clean_node WHERE parent_key IS NOT NULL))""",
    "fx_clean_node",
)
block(
    "emitted",
    """
SELECT doc_id, node_key, CAST(0 AS INTEGER) AS depth, 'subject-' || doc_id AS node_id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS INTEGER) AS "order", '' AS slug FROM fx_clean_node WHERE parent_key IS NULL
UNION ALL
SELECT s.doc_id, s.node_key, e.depth + 1, e.node_id || '/' || lpad(CAST(s.pos AS VARCHAR), 2, '0') || '-' || s.slug, e.node_id, CAST(s.pos AS INTEGER), s.slug
FROM emitted e JOIN slugged s ON s.doc_id = e.doc_id AND s.parent_key = e.node_key""",
    "slugged",
)


def emitted(t: Tables) -> DataFrame:
    subject = F.concat(F.lit("subject-"), F.col("doc_id").cast("string"))
    return trees.emit_node_ids(fx.nodes(t, clean=True), "doc_id", subject)


@query("emit_node_ids", 'SELECT doc_id, node_key, depth, node_id, parent, "order", slug FROM emitted', ("emitted",))
def _(t):
    return emitted(t).select("doc_id", "node_key", "depth", "node_id", "parent", "order", "slug")


@query(
    "node_path",
    """
SELECT p_partkey, 'catalog/' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || replace(lower(p_type), ' ', '-') AS node_id FROM part""",
)
def _(t):
    segment = slugs.path_segment(F.col("p_size"), slugs.slugify(F.col("p_type")))
    return t("part").select("p_partkey", F.concat_ws("/", F.lit("catalog"), segment).alias("node_id"))


@query(
    "slug_token_overlap",
    """
SELECT p_partkey, len(list_intersect(list_distinct(string_split(replace(lower(p_name), ' ', '-'), '-')), list_distinct(string_split(replace(lower(p_type), ' ', '-'), '-')))) AS shared FROM part""",
)
def _(t):
    words = lambda c: F.split(slugs.slugify(F.col(c)), "-")
    return t("part").select("p_partkey", F.size(F.array_intersect(words("p_name"), words("p_type"))).cast("bigint").alias("shared"))


@query(
    "concat_chapter_files",
    """
SELECT p.doc_id, p.lang, CAST(p.page + coalesce(o.before, 0) AS INTEGER) AS book_page
FROM (SELECT lang, doc_id, CAST(unnest(range(1, pages + 1)) AS INTEGER) AS page FROM fx_doc_pages JOIN documents USING (doc_id)) p
JOIN (SELECT lang, doc_id, sum(pages) OVER (PARTITION BY lang ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM fx_doc_pages JOIN documents USING (doc_id)) o USING (lang, doc_id)""",
    ("fx_doc_pages",),
)
def _(t):
    n = F.size(F.col("ps"))
    from leafloom.operators.cleaning import paragraph_array

    docs = t("documents").select("lang", "doc_id", paragraph_array(F.col("text"), fx.LINES).alias("ps"))
    pages = F.ceil(n / fx.PARAGRAPHS_PER_PAGE).cast("int")
    rows = docs.filter(n > 0).select(
        "lang", "doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file"), F.explode(F.sequence(F.lit(1), pages)).alias("page")
    )
    return src.concat_chapter_files(rows, "lang", "file", "page").select("doc_id", "lang", "book_page")
