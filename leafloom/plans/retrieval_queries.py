"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import retrieval as R
from leafloom.plans import fixtures as fx
from leafloom.plans.registry import again, block, query
from leafloom.session import Tables, broadcast_when_small


def queries(t: Tables) -> DataFrame:
    q = fx.queries(t)
    return q.withColumn("scope_key", R.scope_key(F.col("scope"), F.col("subject"), F.lit(None).cast("string")))


block(
    "tok",
    "SELECT node_id, paragraph_id, page, subject, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks FROM fx_paragraph",
    "fx_paragraph",
)
block(
    "member",
    "SELECT 'all' AS scope_key, * FROM tok UNION ALL SELECT subject, * FROM tok",
    "tok",
)
block("scope_size", "SELECT scope_key, count(*) AS n, avg(len(toks)) AS avgdl FROM member GROUP BY scope_key", "member")
block(
    "raw_term",
    """
SELECT scope_key, term, df, n, ln(n - df + 0.5) - ln(df + 0.5) AS raw
FROM (SELECT scope_key, term, count(*) AS df FROM (SELECT scope_key, unnest(list_distinct(toks)) AS term FROM member) GROUP BY scope_key, term)
JOIN scope_size USING (scope_key)""",
    "scope_size",
)
block("scope_mean", "SELECT scope_key, avg(raw) AS avg_idf FROM raw_term GROUP BY scope_key", "raw_term")
block(
    "term_idf",
    "SELECT scope_key, term, df, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw_term JOIN scope_mean USING (scope_key)",
    "scope_mean",
)
block(
    "query_term",
    """
SELECT query_id, scope_key, term, count(*) AS qtf
FROM (SELECT query_id, coalesce(subject, 'all') AS scope_key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM fx_query)
GROUP BY query_id, scope_key, term""",
    "fx_query",
)
block(
    "posting",
    """
SELECT node_id, paragraph_id, page, subject, dl, term, count(*) AS tf
FROM (SELECT node_id, paragraph_id, page, subject, len(toks) AS dl, unnest(toks) AS term FROM tok)
GROUP BY node_id, paragraph_id, page, subject, dl, term""",
    "tok",
)
block(
    "scored",
    """
SELECT * FROM (
  SELECT q.query_id, p.node_id, p.paragraph_id, p.page,
         round(sum(q.qtf * i.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / s.avgdl))), 6) AS score
  FROM query_term q JOIN term_idf i USING (scope_key, term) JOIN scope_size s USING (scope_key)
  JOIN posting p ON p.term = q.term AND (q.scope_key = 'all' OR p.subject = q.scope_key)
  GROUP BY q.query_id, p.node_id, p.paragraph_id, p.page) WHERE score > 0""",
    "query_term",
    "term_idf",
    "posting",
)
block(
    "hit",
    """
SELECT h.query_id, h.rank, h.node_id, h.paragraph_id, h.page, h.score,
       CASE WHEN length(t.text) > 600 THEN regexp_replace(substr(t.text, 1, 600), '\\s+$', '') || ' […]' ELSE t.text END AS snippet
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id, paragraph_id) AS INTEGER) AS rank FROM scored) h
JOIN tok t USING (node_id, paragraph_id) WHERE h.rank <= 8""",
    "scored",
)


@query("tokenize", r"""
SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS retrieval_md5,
       md5(array_to_string(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), ' ')) AS embed_md5 FROM documents""")
def _(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id",
        F.md5(F.array_join(T.tokens(text), " ")).alias("retrieval_md5"),
        F.md5(F.array_join(T.tokens(text, K.EMBED_WORD), " ")).alias("embed_md5"),
    )


block(
    "fx_skill_leaf",
    r"""
SELECT doc_id, lang || '/' || source || '/d' || doc_id AS node_id,
       '## Source 1 (page ' || (doc_id % 50 + 1) || ')' || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS body,
       CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 + 1 AS INTEGER) END AS source_page,
       CASE WHEN doc_id % 3 = 1 THEN CAST(doc_id % 40 + 2 AS INTEGER) END AS legacy_page,
       CASE WHEN n_chars < 200 THEN 'en/src0/d0' END AS superseded_by
FROM documents""",
)


def skill_leaves(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    body = F.concat(
        F.lit("## Source 1 (page "), (d % 50 + 1).cast("string"), F.lit(")\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))
    )
    source = F.struct(F.lit(1).alias("source_id"), F.array((d % 50 + 1).cast("int")).alias("pages"))
    return t("documents").select(
        "doc_id",
        fx.node_of().alias("node_id"),
        body.alias("body"),
        F.when(d % 3 == 0, F.array(source)).alias("sources"),
        F.when(d % 3 == 1, F.array((d % 40 + 2).cast("int"))).alias("source_pages"),
        F.when(F.col("n_chars") < 200, F.lit("en/src0/d0")).alias("superseded_by"),
    )


@query(
    "leaf_paragraphs",
    r"""
SELECT doc_id, node_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_id, unnest(ps) AS text, coalesce(source_page, legacy_page, 1) AS page
FROM (SELECT *, list_filter(list_transform(string_split_regex(body, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
        lambda x: length(x) >= 20 AND NOT starts_with(x, '## Source ') AND NOT starts_with(x, '# Source ')) AS ps FROM fx_skill_leaf)""",
    ("fx_skill_leaf",),
)
def _(t):
    return R.leaf_paragraphs(skill_leaves(t).drop("superseded_by"))


@query("superseded_filter", "SELECT doc_id, node_id FROM fx_skill_leaf WHERE superseded_by IS NULL", ("fx_skill_leaf",))
def _(t):
    return R.visible_leaves(skill_leaves(t)).select("doc_id", "node_id")


@query(
    "scope_filter",
    "SELECT node_id, paragraph_id FROM fx_paragraph WHERE node_id = 'en/src1' OR starts_with(node_id, 'en/src1/')",
    ("fx_paragraph",),
)
def _(t):
    return R.scope_filter(fx.paragraphs(t), "node", node_id="en/src1").select("node_id", "paragraph_id")


@query(
    "union_subject_corpora",
    "SELECT subject, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM fx_paragraph GROUP BY subject",
    ("fx_paragraph",),
)
def _(t):
    rows = R.scope_filter(fx.paragraphs(t), "all")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(
    "scope_paragraph_join",
    """
SELECT scope_key, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars FROM (
  SELECT subject AS scope_key, text FROM fx_paragraph UNION ALL SELECT subject || '/' || book_slug, text FROM fx_paragraph
  UNION ALL SELECT 'all', text FROM fx_paragraph) GROUP BY scope_key""",
    ("fx_paragraph",),
)
def _(t):
    docs = t("documents")
    scopes = (
        docs.select(F.col("lang").alias("scope_key"))
        .union(docs.select(F.concat_ws("/", "lang", "source")))
        .union(docs.select(F.lit("all")))
        .distinct()
    )
    members = R.scope_members(fx.paragraphs(t).select("node_id", "text"), scopes, R.is_small(scopes))
    return members.groupBy("scope_key").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


@query(
    "bm25_stats",
    """
SELECT i.scope_key, i.term, i.df, round(i.idf, 6) AS idf, s.n, round(s.avgdl, 6) AS avgdl, round(m.avg_idf, 6) AS avg_idf
FROM term_idf i JOIN scope_size s USING (scope_key) JOIN scope_mean m USING (scope_key)""",
    ("term_idf",),
)
def _(t):
    scope_stats, term_stats = R.statistics(fx.paragraphs(t), queries(t))
    six = lambda c: F.round(c, 6).alias(c)
    return term_stats.join(scope_stats, "scope_key").select("scope_key", "term", "df", six("idf"), "n", six("avgdl"), six("avg_idf"))


@query(
    "bm25_term_join",
    """
SELECT q.query_id, q.term, count(*) AS paragraphs, sum(p.tf)::BIGINT AS occurrences
FROM query_term q JOIN posting p ON p.term = q.term AND (q.scope_key = 'all' OR p.subject = q.scope_key) GROUP BY q.query_id, q.term""",
    ("query_term", "posting"),
)
def _(t):
    """Counts per scope and term are summed before queries meet them, so a common term is one row per query, not one per paragraph."""
    asked = R.query_terms(queries(t))
    counts = R.scope_counts(R.term_index(fx.paragraphs(t)), queries(t), R.is_small(asked))
    return counts.join(broadcast_when_small(asked), ["scope_key", "term"]).select("query_id", "term", F.col("df").alias("paragraphs"), "occurrences")


@query(
    "bm25_score",
    "SELECT query_id, count(*) AS paragraphs, round(sum(score), 1) AS total, max(score) AS best FROM scored GROUP BY query_id",
    ("scored",),
)
def _(t):
    return (
        R.scores(fx.paragraphs(t), queries(t))
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("paragraphs"), F.round(F.sum("score"), 1).alias("total"), F.max("score").alias("best"))
    )


def hits(t: Tables, k: int = K.AGENT_TOP_K) -> DataFrame:
    return R.search(fx.paragraphs(t), queries(t), k)


@query(
    "bm25_topk",
    "SELECT query_id, rank, node_id, paragraph_id, page, score, snippet FROM hit",
    ("hit",),
)
def _(t):
    return hits(t).select("query_id", "rank", "node_id", "paragraph_id", "page", "score", "snippet")


block(
    "visible_paragraph",
    r"""
SELECT split_part(node_id, '/', 1) AS subject, node_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_id, unnest(ps) AS text, coalesce(source_page, legacy_page, 1) AS page
FROM (SELECT *, list_filter(list_transform(string_split_regex(body, '\n\s*\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
        lambda x: length(x) >= 20 AND NOT starts_with(x, '## Source ') AND NOT starts_with(x, '# Source ')) AS ps FROM fx_skill_leaf WHERE superseded_by IS NULL)""",
    "fx_skill_leaf",
)
again(["tok", "member", "scope_size", "raw_term", "scope_mean", "term_idf", "posting", "scored", "hit"], "visible", {"fx_paragraph": "visible_paragraph"})


@query(
    "search_visible_leaves",
    "SELECT query_id, rank, node_id, paragraph_id, page, score, snippet FROM visible_hit",
    ("visible_hit",),
)
def _(t):
    """The whole way from leaf bodies to hits; superseded leaves neither show nor count."""
    found = R.search_leaves(skill_leaves(t), queries(t), K.AGENT_TOP_K)
    return found.select("query_id", "rank", "node_id", "paragraph_id", "page", "score", "snippet")


@query(
    "citation_index",
    """
SELECT turn, query_id, rank, CAST(row_number() OVER (PARTITION BY turn ORDER BY query_id, rank) AS INTEGER) AS citation
FROM (SELECT split_part(query_id, ':', 2) AS turn, * FROM hit)""",
    ("hit",),
)
def _(t):
    turns = hits(t).withColumn("turn", F.split_part("query_id", F.lit(":"), F.lit(2)))
    return R.citation_index(turns, "turn", "query_id", "rank").select("turn", "query_id", "rank", "citation")


@query(
    "snippet",
    r"""
SELECT doc_id, CASE WHEN length(text) > 600 THEN regexp_replace(substr(text, 1, 600), '\s+$', '') || ' […]' ELSE text END AS snippet FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query(
    "render_sources_context",
    """
SELECT q.query_id, '# Source paragraphs (selected node: ' || coalesce(q.subject, 'All subjects') || ')' || chr(10) ||
       coalesce(h.body, '(no sources retrieved for this question)') AS context
FROM fx_query q LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] (page ' || page || ') ' || snippet, chr(10) ORDER BY rank) AS body FROM hit GROUP BY query_id) h USING (query_id)""",
    ("hit", "fx_query"),
)
def _(t):
    q = queries(t).withColumn("node_title", F.coalesce("subject", F.lit("All subjects")))
    return R.sources_context(q, hits(t))


@query(
    "render_tool_result",
    """
SELECT q.query_id, 'TOOL_RESULT (lookup_skill_content, scope=' || q.scope || ')' || chr(10) || coalesce(h.body, '(no hits)') AS content
FROM fx_query q LEFT JOIN (
  SELECT query_id, string_agg('[' || rank || '] path=''' || regexp_replace(node_id, '^[^/]*/', '') || ''' page=' || page || chr(10) || '    ' || snippet, chr(10) ORDER BY rank) AS body
  FROM hit GROUP BY query_id) h USING (query_id)""",
    ("hit", "fx_query"),
)
def _(t):
    return R.tool_result(queries(t), hits(t))


@query(
    "node_trail",
    """
SELECT DISTINCT node_id, regexp_replace(node_id, '^[^/]*/', '') AS trail, split_part(node_id, '/', 2) || '/' || split_part(node_id, '/', 3) AS short_id
FROM fx_lines""",
    ("fx_lines",),
)
def _(t):
    n = fx.node_of()
    return t("documents").select(n.alias("node_id"), T.node_trail(n).alias("trail"), T.short_node_id(n).alias("short_id"))


@query("short_node_id", "SELECT node_id, split_part(node_id, '/', 2) || '/' || split_part(node_id, '/', 3) AS short_id FROM fx_lines", ("fx_lines",))
def _(t):
    n = fx.node_of()
    return t("documents").select(n.alias("node_id"), T.short_node_id(n).alias("short_id"))


@query(
    "scope_label",
    """
SELECT query_id, CASE WHEN scope = 'all' THEN 'All subjects' ELSE upper(substr(subject, 1, 1)) || substr(subject, 2) END AS label FROM fx_query""",
    ("fx_query",),
)
def _(t):
    null = F.lit(None).cast("string")
    return queries(t).select("query_id", T.scope_label(F.col("scope"), F.col("subject"), null, null).alias("label"))


@query(
    "pretty_node_title",
    """
SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title
FROM part""",
)
def _(t):
    path = F.concat(
        F.lit("catalog/"), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit("-"), F.replace(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit(" "), F.lit("-"))
    )
    return t("part").select("p_partkey", T.pretty_node_title(path).alias("title"))


@query(
    "query_key",
    """
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2))), ' ') AS query_key FROM benchmark""",
)
def _(t):
    return t("benchmark").select("item_id", T.query_key(F.col("text")).alias("query_key"))


def flagship(t: Tables) -> DataFrame:
    """Each benchmark passage over all documents: the three best paragraphs, cited."""
    found = R.citation_index(hits(t, K.CHAT_TOP_K), "query_id", "node_id", "rank").drop("citation")
    return found.select("query_id", F.col("rank").alias("citation"), "node_id", "paragraph_id", "page", "score", "snippet")
