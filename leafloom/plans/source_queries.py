"""Source, sink, migration and streaming queries. Files are written by Spark from the test tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import catalog_search, migration, trees
from leafloom.plans import fixtures as fx
from leafloom.plans.dialogue_queries import show_fold
from leafloom.plans.registry import block, query
from leafloom.plans.tree_queries import emitted
from leafloom.session import Tables, fresh_path
from leafloom.sources import files, sinks, tables
from leafloom.streaming import ingest, jobs, turns


@query(
    "load_text_sources",
    "SELECT source, CAST(1 AS INTEGER) AS page, sum(length(text) + 1)::BIGINT AS chars, CAST(1 AS INTEGER) AS page_count FROM documents GROUP BY source",
)
def _(t):
    out = fresh_path(t.spark, "texts")
    t("documents").select("source", "text").write.partitionBy("source").text(out)
    rows = files.load_text_sources(t.spark, out)
    source = F.regexp_extract("source_path", "source=([^/]+)/", 1)
    return rows.groupBy(source.alias("source"), "page").agg(
        F.sum(F.length("text")).alias("chars"), F.max("page_count").alias("page_count")
    )


def tree_rows(t: Tables) -> DataFrame:
    """Emitted nodes of all documents as a skill tree; a subject per document language."""
    rows = emitted(t)
    source = F.struct(
        F.lit(1).alias("source_id"),
        F.lit("RBSE").alias("publisher"),
        F.concat(F.lit("book: "), F.col("doc_id").cast("string")).alias("book_slug"),
        F.array(F.lit(3), F.lit(4)).alias("pages"),
    )
    body = F.concat_ws("\n", F.col("description"), F.lit("--- \"quoted\": line"), F.col("node_key"))
    return rows.select(
        (F.col("doc_id") % 10).cast("string").alias("subject"),
        "node_id",
        "parent",
        "depth",
        "order",
        F.col("title").alias("name"),
        F.concat("description", F.lit(": \"yes\" # no")).alias("description"),
        F.when(F.col("node_key").contains("/l"), F.array(source)).alias("sources"),
        body.alias("body"),
        T.content_hash(body).alias("content_hash"),
    )


block(
    "skill_row",
    """
SELECT CAST(e.doc_id % 10 AS VARCHAR) AS subject, e.node_id, e.parent, e.depth, e."order", n.title AS name, n.description || ': "yes" # no' AS description,
       contains(e.node_key, '/l') AS is_leaf, n.description || chr(10) || '--- "quoted": line' || chr(10) || e.node_key AS body
FROM emitted e JOIN fx_clean_node n ON n.doc_id = e.doc_id AND n.node_key = e.node_key""",
    "emitted",
    "fx_clean_node",
)


@query(
    "load_skill_folder",
    """
SELECT subject, node_id, parent, depth, "order", name, description, CASE WHEN is_leaf THEN 'RBSE' ELSE '' END AS publisher,
       CASE WHEN is_leaf THEN '3,4' ELSE '' END AS pages, body, 'sha256:' || sha256(body) AS content_hash FROM skill_row""",
    ("skill_row",),
)
def _(t):
    """Written as one Markdown file per node and read back by path."""
    out = fresh_path(t.spark, "markdown")
    sinks.write_skill_folder(tree_rows(t), out)
    rows = files.load_skill_folder(t.spark, out)
    pages = F.flatten(F.transform(F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)), lambda s: s["pages"]))
    return rows.select(
        "subject", "node_id", "parent", "depth", "order", "name", "description", "publisher",
        F.array_join(F.transform(pages, lambda p: p.cast("string")), ",").alias("pages"), "body", "content_hash",
    )


@query(
    "write_skill_tree",
    'SELECT subject, count(*) AS nodes, max("order") AS widest FROM skill_row GROUP BY subject',
    ("skill_row",),
)
def _(t):
    out = fresh_path(t.spark, "tree")
    rows = tree_rows(t)
    sinks.write_skill_tree(rows, out)
    sinks.write_skill_tree(rows, out, replace=True)
    back = t.spark.read.schema(rows.schema).parquet(out)
    return back.groupBy("subject").agg(F.count(F.lit(1)).alias("nodes"), F.max("order").alias("widest"))


@query(
    "render_skill_markdown",
    """
SELECT s_suppkey, '---' || chr(10) || 'name: "' || s_name || '"' || chr(10) || 'node_id: "s' || s_suppkey || '"' || chr(10) || 'depth: 3' || chr(10) || 'ingestion_version: v3' || chr(10) || '---' || chr(10) || chr(10) || 'Balance ' || CAST(s_nationkey AS VARCHAR) AS markdown FROM supplier""",
)
def _(t):
    rows = t("supplier").select(
        "s_suppkey",
        F.col("s_name").alias("name"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"),
        F.lit(3).alias("depth"),
        F.concat(F.lit("Balance "), F.col("s_nationkey").cast("string")).alias("body"),
    )
    return rows.select("s_suppkey", sinks.render_skill_markdown(rows.columns).alias("markdown"))


@query("list_subjects", "SELECT DISTINCT lang AS subject FROM documents WHERE source NOT LIKE '.%'")
def _(t):
    docs = t("documents")
    roots = docs.select(F.col("lang").alias("path"), F.lit(False).alias("is_leaf"))
    hidden = docs.select(F.concat(F.lit("_"), "lang").alias("path"), F.lit(False).alias("is_leaf"))
    dotted = docs.select(F.concat("lang", F.lit(".v2")).alias("path"), F.lit(False).alias("is_leaf"))
    inner = docs.select(F.concat_ws("/", "lang", "source").alias("path"), F.lit(False).alias("is_leaf"))
    return files.list_subjects(roots.union(hidden).union(dotted).union(inner))


@query(
    "load_manifest",
    """
SELECT n_name AS slug, n_name AS name, CASE WHEN n_regionkey = 0 THEN '—' ELSE 'region ' || n_regionkey END AS scope,
       coalesce(s.n, 0) AS total_nodes, coalesce(s.n, 0) AS total_leaves, s.n IS NOT NULL AS available
FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = n_nationkey""",
)
def _(t):
    out = fresh_path(t.spark, "manifest")
    scope = F.when(F.col("n_regionkey") != 0, F.concat(F.lit("region "), F.col("n_regionkey").cast("string")))
    folder = F.concat(F.lit("skills/n"), F.col("n_nationkey").cast("string"))
    entries = t("nation").select(F.col("n_name").alias("slug"), scope.alias("scope"), folder.alias("skill_folder"))
    no_folder = t("region").select(F.col("r_name").alias("slug"), F.lit(None).cast("string").alias("scope"), F.lit(None).cast("string").alias("skill_folder"))
    entries.unionByName(no_folder).write.json(out)
    nodes = t("supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name").alias("path"), F.lit(True).alias("is_leaf")
    )
    return files.load_manifest(t.spark, out, nodes, multi_line=False)


@query(
    "read_agent_events",
    "SELECT turn_id, seq, type, id, payload, number FROM fx_agent_event",
    ("fx_agent_event",),
)
def _(t):
    out = fresh_path(t.spark, "frames")
    e = fx.agent_events(t).select(F.to_json(F.struct("turn_id", "seq", "type", "id", "payload", "number")).alias("j"))
    frame = F.explode(F.array(F.concat(F.lit("data: "), "j"), F.lit(""), F.lit("data: [DONE]"), F.lit("data: {broken"), F.lit(": note")))
    e.select(frame.alias("value")).write.text(out)
    schema = "turn_id string, seq int, type string, id string, payload string, number int"
    return files.event_frames(t.spark.read.text(out), schema)


@query(
    "read_job_events",
    "SELECT job_id, event_id, event, total_nodes FROM fx_job_event",
    ("fx_job_event",),
)
def _(t):
    out = fresh_path(t.spark, "jobs")
    rows = fx.job_events(t("events")).select(F.to_json(F.struct("job_id", "event_id", "event", "total_nodes")).alias("j"))
    rows.select(F.concat(F.lit("data: "), "j").alias("value")).write.text(out)
    return files.event_frames(t.spark.read.text(out), "job_id string, event_id bigint, event string, total_nodes int")


def tree_replies(t: Tables) -> DataFrame:
    """Each clean tree as a model reply: JSON inside prose or fences."""
    n = fx.nodes(t, clean=True)
    plain = lambda: [F.col(c) for c in ("title", "description", "paragraph_start", "paragraph_end")]
    leaf = F.array_sort(F.collect_list(F.struct("ord", F.struct(*plain()).alias("node"))))
    chapters = n.filter("depth = 2").groupBy("doc_id", F.col("parent_key").alias("node_key")).agg(F.transform(leaf, lambda x: x["node"]).alias("children"))
    inner = n.filter("depth = 1").join(chapters, ["doc_id", "node_key"], "left")
    chapter = F.array_sort(F.collect_list(F.struct("ord", F.struct(*plain(), F.col("children")).alias("node"))))
    roots = inner.groupBy("doc_id").agg(F.transform(chapter, lambda x: x["node"]).alias("children"))
    root = n.filter("depth = 0").join(roots, "doc_id", "left").select("doc_id", F.to_json(F.struct(F.struct(*plain(), F.col("children")).alias("root"))).alias("j"))
    reply = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here is the tree:\n"), "j", F.lit("\nDone."))).otherwise(F.concat(F.lit("```json\n"), "j", F.lit("\n```")))
    return root.select("doc_id", reply.alias("reply"))


@query(
    "read_proposed_tree",
    """
SELECT doc_id, CASE depth WHEN 0 THEN 'r' WHEN 1 THEN 'r/' || ord ELSE 'r/' || (ord // 3) || '/' || (ord % 3) END AS node_key, depth, title, paragraph_start, paragraph_end FROM fx_clean_node""",
    ("fx_clean_node",),
)
def _(t):
    rows = files.read_proposed_trees(tree_replies(t))
    return rows.select("doc_id", "node_key", "depth", "title", "paragraph_start", "paragraph_end")


_HOSTS = ["blog.tionsh.example.net", "Thther.example.org"]


@query(
    "source_whitelist",
    "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) IN ('blog.tionsh.example.net', 'thther.example.org') AS allowed FROM pages",
)
def _(t):
    return t("pages").select("page_id", tables.allowed_source(F.col("url"), _HOSTS).alias("allowed"))


def topics(t: Tables) -> DataFrame:
    rows = trees.leaf_breadcrumbs(fx.place_tree(t))
    return rows.select("id", "title", F.col("breadcrumb").alias("path"), F.lit("World").alias("subject_name"))


@query(
    "leaf_topic_search",
    """
SELECT id, title, crumb AS path FROM walk WHERE depth > 0 AND id NOT IN (SELECT parent FROM fx_tree WHERE parent IS NOT NULL)
  AND (contains(lower(title), 'nation_1') OR contains(lower(crumb), 'nation_1')) ORDER BY title, id LIMIT 50""",
    ("walk",),
)
def _(t):
    return catalog_search.leaf_topic_search(topics(t), " Nation_1 ", [F.col("title"), F.col("id")]).select("id", "title", "path")


@query(
    "exam_coverage_split",
    "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || ', ,' || p_brand || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS exams FROM part",
)
def _(t):
    text = F.concat("p_type", F.lit(", ,"), "p_brand", F.lit(" ,"))
    return catalog_search.exam_coverage(t("part").withColumn("raw", text), "raw").select("p_partkey", F.array_join("exam_coverage", "|").alias("exams"))


@query(
    "subject_scope_default",
    "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'world' WHEN n_regionkey = 2 THEN 'rajasthan' ELSE 'pan_india' END AS scope FROM nation",
)
def _(t):
    raw = F.when(F.col("n_regionkey") == 1, "world").when(F.col("n_regionkey") == 2, "rajasthan").when(F.col("n_regionkey") == 3, "mars")
    return t("nation").select("n_nationkey", T.subject_scope(raw).alias("scope"))


# --- migration ------------------------------------------------------------------------------------
def old_tree(t: Tables) -> DataFrame:
    """Documents as leaves of a book-keyed tree, sources as chapters, languages as roots."""
    docs = t("documents")
    base = F.concat_ws("/", F.col("lang"), F.lit("old_book"))
    pages = F.array((F.col("doc_id") % 30 + 1).cast("int"), (F.col("doc_id") % 30 + 3).cast("int"))
    leaf = docs.select(
        "lang",
        F.concat_ws("/", base, "source", F.col("doc_id").cast("string")).alias("node_id"),
        F.concat_ws("/", base, "source").alias("parent"),
        F.lit(2).alias("depth"),
        F.col("doc_id").cast("int").alias("order"),
        F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body"),
        pages.alias("source_pages"),
        F.concat(F.lit("sha256:"), F.md5("text")).alias("content_hash"),
        F.lit(True).alias("is_leaf"),
    )
    none = F.lit(None)
    inner = docs.select("lang", "source").distinct()
    chapter = inner.select(
        "lang", F.concat_ws("/", base, "source").alias("node_id"), base.alias("parent"), F.lit(1).alias("depth"),
        fx.source_number(F.col("source")).cast("int").alias("order"), F.col("source").alias("name"), F.lit("## Contents").alias("body"),
        none.cast("array<int>").alias("source_pages"), none.cast("string").alias("content_hash"), F.lit(False).alias("is_leaf"),
    )
    root = inner.select("lang").distinct().select(
        "lang", base.alias("node_id"), none.cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("order"),
        F.lit("Some Press: notes").alias("name"), F.lit("## Contents").alias("body"), none.cast("array<int>").alias("source_pages"),
        none.cast("string").alias("content_hash"), F.lit(False).alias("is_leaf"),
    )
    return leaf.unionByName(chapter).unionByName(root).withColumns({"description": F.lit("about"), "ingested_at": F.lit("2023-01-01T00:00:00Z")})


def migrated(t: Tables) -> DataFrame:
    rows = old_tree(t)
    new = F.concat(F.lit("new_subject_"), "lang")
    return migration.migrate(rows, F.col("lang"), F.lit("old_book"), new, F.lit("RBSE"), F.lit(1), "2024-01-01T00:00:00Z")


@query(
    "migrate_v2_to_v3",
    r"""
SELECT node_id, parent, depth, name, 'sha256:' || sha256(body) AS content_hash, pages FROM (
  SELECT 'new_subject_' || lang || '/' || source || '/' || doc_id AS node_id, 'new_subject_' || lang || '/' || source AS parent, CAST(2 AS INTEGER) AS depth, 'Doc ' || doc_id AS name,
         '## Source 1 (pages ' || (doc_id % 30 + 1) || '-' || (doc_id % 30 + 3) || ')' || chr(10) || chr(10) || regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') || chr(10) AS body,
         (doc_id % 30 + 1) || ',' || (doc_id % 30 + 3) AS pages FROM documents
  UNION ALL SELECT DISTINCT 'new_subject_' || lang || '/' || source, 'new_subject_' || lang, 1, source, '## Contents', NULL FROM documents
  UNION ALL SELECT DISTINCT 'new_subject_' || lang, NULL, 0, 'New Subject ' || upper(lang[1]) || lang[2:], '## Contents', '' FROM documents)""",
)
def _(t):
    pages = F.array_join(F.transform(F.try_element_at("sources", F.lit(1))["pages"], lambda p: p.cast("string")), ",")
    return migrated(t).select("node_id", "parent", "depth", "name", "content_hash", pages.alias("pages"))


@query(
    "migration_counts",
    "SELECT 'new_subject_' || lang AS subject, count(*) AS leaves_written, count(DISTINCT source) + 1 AS index_nodes_written FROM documents GROUP BY lang",
)
def _(t):
    return migration.migration_counts(migrated(t))


@query(
    "rewrite_node_id",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'fresh' ELSE lang || '/book' END || '/' || source || '/' || doc_id AS node_id FROM documents",
)
def _(t):
    old = F.concat_ws("/", F.col("lang"), F.lit("book"), "source", F.col("doc_id").cast("string"))
    return t("documents").select("doc_id", T.rewrite_node_id(old, F.lit("en"), F.lit("book"), F.lit("fresh")).alias("node_id"))


@query(
    "subject_display_name",
    "SELECT DISTINCT source, 'Rural ' || upper(source[1]) || source[2:] || ' Notes' AS name FROM documents",
)
def _(t):
    slug = F.concat(F.lit("rural_"), "source", F.lit("-notes"))
    return t("documents").select("source").distinct().select("source", migration.subject_display_name(slug).alias("name"))


# --- streams --------------------------------------------------------------------------------------
class StreamTables(Tables):
    """The same tables as file streams, be a table one file or a folder of files. A stream takes a single file as its path only from a pattern."""

    def __call__(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(self.path(name)).schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.directory}/{name}.parque[t]")
        return self._spread(rows, self.spark.read.parquet(self.path(name))) if name == "documents" else rows


_JOB_SQL = """
SELECT job_id, CASE e.event WHEN 'pipeline_complete' THEN 'complete' WHEN 'stage_error' THEN 'failed' ELSE CASE WHEN ran THEN 'running' ELSE 'queued' END END AS state,
       started_at, e.ts AS completed_at, CASE WHEN e.event = 'pipeline_complete' THEN e.total_nodes END AS total_nodes
FROM (SELECT job_id, min(ts) AS started_at, bool_or(event IN ('stage_start', 'stage_progress')) AS ran FROM fx_job_event GROUP BY job_id)
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM fx_job_event WHERE event IN ('pipeline_complete', 'stage_error')) WHERE rn = 1) e USING (job_id)"""


@query("job_state", _JOB_SQL, ("fx_job_event",))
def _(t):
    return jobs.job_state(fx.job_events(t("events")))


@query("job_state_stream", _JOB_SQL, ("fx_job_event",))
def _(t):
    stream = StreamTables(t.spark, t.directory)
    return jobs.run_job_state(fx.job_events(stream("events")))


@query(
    "fold_agent_turn_stream",
    "SELECT turn_id, text_md5, queries, results, citations, status FROM folded",
    ("folded",),
)
def _(t):
    return show_fold(turns.run_fold(fx.agent_events(StreamTables(t.spark, t.directory))))


block(
    "clean_page",
    r"SELECT book, page, regexp_replace(text, '(?:[ \t]*\n){3,}', chr(10) || chr(10), 'g') AS text FROM generic_8",
    "generic_8",
)


@query(
    "stream_ingest_clean",
    r"""
SELECT book, page, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_id, unnest(ps) AS text FROM (
  SELECT book, page, list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 20) AS ps FROM clean_page)""",
    ("clean_page",),
)
def _(t):
    pages = fx.dirty_pages(StreamTables(t.spark, t.directory))
    return ingest.run_append(ingest.clean_and_split(pages, "text", K.GENERIC_PATTERNS, fx.LINES), "clean")
