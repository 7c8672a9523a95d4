"""Model tables derived from the shared test tables, as Spark frames and as SQL blocks.

Every table is used whole. Remainders of ids only choose which variant of a row is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.operators import cleaning
from leafloom.plans.registry import block
from leafloom.session import Tables, stored

LINES = r"\n+"
PARAGRAPHS_PER_PAGE = 5
PARAGRAPHS_PER_LEAF = 4
LEAVES_PER_CHAPTER = 3

PUBLISHERS = ["NCERT", "RBSE", "Springboard Academy", "Unlisted Press"]

# One positive per generic pattern, then lines for the source bundle.
NOISE = [
    "See https://files.example.org/a?b=1 for the file",
    "Visit www.example.com/notes today",
    "Vedantu handout number seven",
    "Write to desk@example.com or elsewhere",
    "Follow @studyhall99 daily",
    "Downloaded from a mirror site",
    "This was page 3 of 40 in print",
    "© 2021 Example Press",
    "Join our Telegram group now",
    "A-1 KeshavVihar, near the park\nJaipur 302018 office",
    "A-1 Keshav Vihar branch",
    "Jaipur- 302018 head office",
    "Rajasthan Geography Notes",
    "Raj. Geo.Notes (RAS Pre) edition",
    "Call 0141-3555948 or come by",
    "Mob.: 98765 43210, 12",
]


def _choose(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_text(value: str) -> str:
    """SQL literal, with newlines spelled out."""
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def source_number(source: Column) -> Column:
    return F.regexp_extract(source, r"(\d+)", 1).cast("bigint")


def node_of(lang: str = "lang", source: str = "source", doc_id: str = "doc_id") -> Column:
    return F.concat_ws("/", F.col(lang), F.col(source), F.concat(F.lit("d"), F.col(doc_id).cast("string")))


# --- text -----------------------------------------------------------------------------------------
def paragraphs(t: Tables) -> DataFrame:
    docs = t("documents").select(
        "doc_id", F.col("lang").alias("subject"), F.col("source").alias("book_slug"), node_of().alias("node_id"), "text"
    )
    page = F.floor(F.col("paragraph_id") / PARAGRAPHS_PER_PAGE).cast("int") + 1
    return cleaning.split_paragraphs(docs, "text", LINES).withColumn("page", page)


block(
    "fx_lines",
    r"""
SELECT doc_id, lang, source, lang || '/' || source || '/d' || doc_id AS node_id,
       list_filter(list_transform(string_split_regex(text, '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))),
                   lambda x: length(x) >= 20) AS ps
FROM documents""",
)
block(
    "fx_paragraph",
    """
SELECT doc_id, lang AS subject, source AS book_slug, node_id,
       CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_id, unnest(ps) AS text,
       CAST((generate_subscripts(ps, 1) - 1) // 5 + 1 AS INTEGER) AS page
FROM fx_lines""",
    "fx_lines",
)


def dirty_pages(t: Tables) -> DataFrame:
    """Books are sources, pages are documents; each page ends in two boilerplate lines."""
    n = len(NOISE)
    return t("documents").select(
        F.col("source").alias("book"),
        F.col("doc_id").cast("int").alias("page"),
        F.concat_ws(
            "\n", "text", _choose(NOISE, F.col("doc_id") % n), _choose(NOISE, (F.col("doc_id") + 5) % n), F.lit("\n\n\nEnd")
        ).alias("text"),
    )


block(
    "fx_dirty_page",
    f"""
SELECT source AS book, CAST(doc_id AS INTEGER) AS page,
       text || chr(10) || {sql_list(NOISE)}[doc_id % {len(NOISE)} + 1] || chr(10) ||
       {sql_list(NOISE)}[(doc_id + 5) % {len(NOISE)} + 1] || chr(10) || chr(10) || chr(10) || chr(10) || 'End' AS text
FROM documents""",
)


def page_text(t: Tables) -> DataFrame:
    """Native text and OCR text per page. The OCR repeats the page in lower case and adds a caption twice."""
    caption = F.concat(F.lit("MAP "), F.col("doc_id").cast("string"), F.lit(" "), F.col("page").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("paragraph_id", "text")))
    return (
        paragraphs(t)
        .groupBy("doc_id", "page")
        .agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("native_text"))
        .withColumn("ocr_text", F.concat_ws("\n", F.lower("native_text"), caption, F.lit("ab"), F.lower(caption)))
    )


block(
    "fx_page_text",
    """
SELECT doc_id, page, native_text,
       lower(native_text) || chr(10) || 'MAP ' || doc_id || ' ' || page || chr(10) || 'ab' || chr(10) ||
       'map ' || doc_id || ' ' || page AS ocr_text
FROM (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY paragraph_id) AS native_text
      FROM fx_paragraph GROUP BY doc_id, page)""",
    "fx_paragraph",
)


def bookmarks(t: Tables) -> DataFrame:
    """Level 1 at odd pages and level 2 at even ones. One-page documents have none, documents of three
    pages or more have two entries on page 1, and documents of an even page count an untitled one."""
    n = F.size(cleaning.paragraph_array(F.col("text"), LINES))
    pages = F.ceil(n / PARAGRAPHS_PER_PAGE).cast("int")
    docs = t("documents").select("doc_id", pages.alias("pages")).filter(F.col("pages") > 1)
    entry = lambda level, title, page: F.struct(
        level.alias("level"), title.alias("title"), page.alias("page")
    )
    regular = F.transform(
        F.sequence(F.lit(1), F.col("pages")),
        lambda p: entry(F.when(p % 2 == 1, 1).otherwise(2), F.concat(F.lit("  Bookmark "), p.cast("string"), F.lit(" ")), p),
    )
    second = F.array(entry(F.lit(1), F.lit("Second on page 1"), F.lit(1)))
    blank = F.array(entry(F.lit(1), F.lit("   "), F.lit(2)))
    none = F.slice(regular, 1, 0)
    return docs.select(
        "doc_id",
        F.inline(
            F.concat(
                regular,
                F.when(F.col("pages") > 2, second).otherwise(none),
                F.when(F.col("pages") % 2 == 0, blank).otherwise(none),
            )
        ),
    )


block(
    "fx_doc_pages",
    "SELECT doc_id, CAST(ceil(len(ps) / 5.0) AS INTEGER) AS pages FROM fx_lines",
    "fx_lines",
)
block(
    "fx_bookmark",
    """
SELECT doc_id, CAST(CASE WHEN page % 2 = 1 THEN 1 ELSE 2 END AS INTEGER) AS level, '  Bookmark ' || page || ' ' AS title, CAST(page AS INTEGER) AS page
FROM (SELECT doc_id, unnest(range(1, pages + 1)) AS page FROM fx_doc_pages WHERE pages > 1)
UNION ALL SELECT doc_id, 1, 'Second on page 1', 1 FROM fx_doc_pages WHERE pages > 2
UNION ALL SELECT doc_id, 1, '   ', 2 FROM fx_doc_pages WHERE pages > 1 AND pages % 2 = 0""",
    "fx_doc_pages",
)


# --- trees ----------------------------------------------------------------------------------------
def nodes(t: Tables, clean: bool = False) -> DataFrame:
    """A proposed tree per document: root, chapters, leaves of four paragraphs.

    ``doc_id % 5`` picks the flaw: none, overlap with an end past the document, null start, inverted
    range, last leaf missing.
    """
    return _nodes(tree_sizes(t), clean)


def tree_sizes(t: Tables) -> DataFrame:
    """Paragraphs of each document. The texts are split once, however often a query reads the nodes."""
    docs = t("documents").select("doc_id", F.size(cleaning.paragraph_array(F.col("text"), LINES)).alias("n"))
    return stored(docs, "tree-sizes")


def nodes_and_ids(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The proposed trees, and the paragraphs ``(doc_id, paragraph_id, page)`` without their texts, from one split of the texts."""
    sizes = tree_sizes(t)
    ids = sizes.filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("paragraph_id"))
    return _nodes(sizes), ids.withColumn("page", F.floor(F.col("paragraph_id") / PARAGRAPHS_PER_PAGE).cast("int") + 1)


def _nodes(docs: DataFrame, clean: bool = False) -> DataFrame:
    size, leaf, step = F.col("n"), F.col("leaf"), PARAGRAPHS_PER_LEAF
    docs = docs.withColumn("leaves", F.ceil(size / step).cast("int")).withColumn(
        "flaw", F.lit(0).cast("bigint") if clean else F.col("doc_id") % 5
    )
    docs = docs.withColumn("leaves", F.when(F.col("flaw") == 4, F.col("leaves") - 1).otherwise(F.col("leaves")))
    root = docs.select(
        "doc_id",
        F.lit("r").alias("node_key"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit(0).alias("ord"),
        F.lit(0).alias("depth"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit("Whole document").alias("description"),
        F.lit(None).cast("int").alias("paragraph_start"),
        F.lit(None).cast("int").alias("paragraph_end"),
    )
    filled = docs.filter(F.col("leaves") > 0)
    last_chapter = F.floor((F.col("leaves") - 1) / LEAVES_PER_CHAPTER)
    chapter = filled.select("doc_id", F.explode(F.sequence(F.lit(0), last_chapter.cast("int"))).alias("c")).select(
        "doc_id",
        F.concat(F.lit("r/c"), F.col("c").cast("string")).alias("node_key"),
        F.lit("r").alias("parent_key"),
        F.col("c").alias("ord"),
        F.lit(1).alias("depth"),
        F.when(F.col("c") % 3 == 2, "Introduction")
        .otherwise(F.concat(F.lit("Part "), F.col("c").cast("string")))
        .alias("title"),
        F.lit("A part").alias("description"),
        F.lit(None).cast("int").alias("paragraph_start"),
        F.lit(None).cast("int").alias("paragraph_end"),
    )
    low = leaf * step
    flaw = F.col("flaw")
    high = F.when(flaw == 1, low + step - 1).otherwise(F.least(low + step - 1, size - 1))
    start = (
        F.when((flaw == 1) & (leaf > 0), low - 1)
        .when((flaw == 2) & (leaf == 0), F.lit(None))
        .when((flaw == 3) & (leaf == 0), high)
        .otherwise(low)
    )
    end = F.when((flaw == 3) & (leaf == 0), low).otherwise(high)
    c = F.floor(leaf / LEAVES_PER_CHAPTER).cast("int")
    leaves = filled.select("*", F.explode(F.sequence(F.lit(0), F.col("leaves") - 1)).alias("leaf")).select(
        "doc_id",
        F.concat(F.lit("r/c"), c.cast("string"), F.lit("/l"), leaf.cast("string")).alias("node_key"),
        F.concat(F.lit("r/c"), c.cast("string")).alias("parent_key"),
        leaf.alias("ord"),
        F.lit(2).alias("depth"),
        F.concat(F.lit("Topic "), (leaf % 2 + 1).cast("string")).alias("title"),
        F.concat(F.lit("About topic "), leaf.cast("string")).alias("description"),
        start.cast("int").alias("paragraph_start"),
        end.cast("int").alias("paragraph_end"),
    )
    return root.unionByName(chapter).unionByName(leaves)


def _node_sql(flaw: str, prefix: str) -> None:
    block(
        f"{prefix}_docs",
        f"""
SELECT doc_id, n, flaw, CAST(ceil(n / 4.0) - CASE WHEN flaw = 4 THEN 1 ELSE 0 END AS INTEGER) AS leaves
FROM (SELECT doc_id, len(ps) AS n, {flaw} AS flaw FROM fx_lines)""",
        "fx_lines",
    )
    block(
        prefix,
        f"""
SELECT doc_id, 'r' AS node_key, CAST(NULL AS VARCHAR) AS parent_key, CAST(0 AS INTEGER) AS ord, CAST(0 AS INTEGER) AS depth,
       'Document ' || doc_id AS title, 'Whole document' AS description,
       CAST(NULL AS INTEGER) AS paragraph_start, CAST(NULL AS INTEGER) AS paragraph_end
FROM {prefix}_docs
UNION ALL
SELECT doc_id, 'r/c' || c, 'r', CAST(c AS INTEGER), 1, CASE WHEN c % 3 = 2 THEN 'Introduction' ELSE 'Part ' || c END, 'A part', NULL, NULL
FROM (SELECT doc_id, unnest(range(0, (leaves - 1) // 3 + 1)) AS c FROM {prefix}_docs WHERE leaves > 0)
UNION ALL
SELECT doc_id, 'r/c' || (leaf // 3) || '/l' || leaf, 'r/c' || (leaf // 3), CAST(leaf AS INTEGER), 2,
       'Topic ' || (leaf % 2 + 1), 'About topic ' || leaf,
       CAST(CASE WHEN flaw = 1 AND leaf > 0 THEN leaf * 4 - 1 WHEN flaw = 2 AND leaf = 0 THEN NULL
                 WHEN flaw = 3 AND leaf = 0 THEN least(leaf * 4 + 3, n - 1) ELSE leaf * 4 END AS INTEGER),
       CAST(CASE WHEN flaw = 3 AND leaf = 0 THEN leaf * 4 WHEN flaw = 1 THEN leaf * 4 + 3 ELSE least(leaf * 4 + 3, n - 1) END AS INTEGER)
FROM (SELECT doc_id, n, flaw, unnest(range(0, leaves)) AS leaf FROM {prefix}_docs WHERE leaves > 0)""",
        f"{prefix}_docs",
    )


_node_sql("doc_id % 5", "fx_node")
_node_sql("0", "fx_clean_node")


def leaves(t: Tables) -> DataFrame:
    """Every document as a leaf of subject (language) and book (source)."""
    n = source_number(F.col("source"))
    return t("documents").select(
        F.col("doc_id").alias("ord"),
        F.col("lang").alias("subject"),
        F.col("source").alias("book_slug"),
        node_of().alias("node_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("body"),
        _choose(PUBLISHERS, n % len(PUBLISHERS)).alias("publisher"),
        (n % 2 == 0).alias("is_new"),
    )


block(
    "fx_leaf",
    f"""
SELECT doc_id AS ord, lang AS subject, source AS book_slug, lang || '/' || source || '/d' || doc_id AS node_id,
       string_split(text, chr(10))[1] AS title, text AS body,
       {sql_list(PUBLISHERS)}[CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 4 + 1] AS publisher,
       CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) % 2 = 0 AS is_new
FROM documents""",
)


def place_tree(t: Tables) -> DataFrame:
    """World, regions, nations, suppliers as one tree."""
    root = t.spark.range(1).select(
        F.lit("w").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("ord"), F.lit("World").alias("title")
    )
    region = t("region").select(
        F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
        F.lit("w").alias("parent"),
        F.col("r_regionkey").cast("bigint").alias("ord"),
        F.col("r_name").alias("title"),
    )
    nation = t("nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.col("n_nationkey").cast("bigint").alias("ord"),
        F.col("n_name").alias("title"),
    )
    supplier = t("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"),
        F.col("s_suppkey").cast("bigint").alias("ord"),
        F.col("s_name").alias("title"),
    )
    return root.unionByName(region).unionByName(nation).unionByName(supplier)


block(
    "fx_tree",
    """
SELECT 'w' AS id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS BIGINT) AS ord, 'World' AS title
UNION ALL SELECT 'r' || r_regionkey, 'w', CAST(r_regionkey AS BIGINT), r_name FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(n_nationkey AS BIGINT), n_name FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_suppkey, s_name FROM supplier""",
)


# --- retrieval and questions ----------------------------------------------------------------------
def languages(t: Tables) -> list[str]:
    """The languages of the documents, one value each."""
    rows = t("documents").select("lang").where(F.col("lang").isNotNull()).distinct().collect()
    return sorted(r.lang for r in rows)


def queries(t: Tables) -> DataFrame:
    """Every benchmark passage asked over all subjects, and once more inside each subject."""
    base = t("benchmark").select(F.col("item_id"), "text")
    every = base.select(
        F.concat(F.lit("all:"), F.col("item_id").cast("string")).alias("query_id"),
        F.lit("all").alias("scope"),
        F.lit(None).cast("string").alias("subject"),
        "text",
    )
    one = base.select("item_id", "text", F.explode(F.array(*[F.lit(s) for s in languages(t)])).alias("subject")).select(
        F.concat(F.col("subject"), F.lit(":"), F.col("item_id").cast("string")).alias("query_id"),
        F.lit("subject").alias("scope"),
        "subject",
        "text",
    )
    return every.unionByName(one)


block(
    "fx_query",
    """
SELECT 'all:' || item_id AS query_id, 'all' AS scope, CAST(NULL AS VARCHAR) AS subject, text FROM benchmark
UNION ALL
SELECT lang || ':' || item_id, 'subject', lang, text FROM (SELECT *, unnest((SELECT list(DISTINCT lang) FROM documents WHERE lang IS NOT NULL)) AS lang FROM benchmark)""",
)


QUESTIONS_PER_TEST = 10


def questions(t: Tables) -> DataFrame:
    """A multiple-choice question per document, its span taken from the document's first paragraph.

    Remainders of the id make spans that are not there, cite an unknown paragraph, or break the schema.
    """
    d = F.col("doc_id")
    first = F.coalesce(F.try_element_at(cleaning.paragraph_array(F.col("text"), LINES), F.lit(1)), F.lit("no paragraph"))

    def text(head: str) -> Column:
        return F.concat(F.lit(head), d.cast("string"))

    choices = F.create_map(
        F.lit("A"), text("first "), F.lit("B"), text("second "), F.lit("C"), text("third "), F.lit("D"), text("fourth ")
    )
    bad_choices = F.create_map(F.lit("A"), text("first "), F.lit("B"), F.lit("  "), F.lit("C"), text("third "))
    return t("documents").select(
        text("q").alias("question_id"),
        d.alias("ord"),
        F.concat(F.lit("test-"), F.floor(d / QUESTIONS_PER_TEST).cast("string")).alias("test_id"),
        node_of().alias("source_node_id"),
        F.when(d % 13 == 0, F.lit("short")).otherwise(text("Which passage belongs to document ")).alias("prompt"),
        F.when(d % 11 == 0, bad_choices).otherwise(choices).alias("choices"),
        _choose(K.CHOICES, d % 4).alias("correct"),
        F.when(d % 3 == 1, F.concat(first, F.lit(" not there")))
        .otherwise(F.concat(F.lit("  "), F.lower(first)))
        .alias("answer_span"),
        F.when(d % 5 == 0, F.array(F.lit(900000), F.lit(0)))
        .otherwise(F.array(F.lit(0), F.lit(1)))
        .alias("source_paragraph_ids"),
        _choose(K.DIFFICULTIES, d % 3).alias("difficulty"),
        F.when(d % 17 == 0, F.lit("guess")).otherwise(F.lit("understand")).alias("bloom_level"),
        text("because of ").alias("explanation"),
    )


block(
    "fx_question",
    """
SELECT 'q' || doc_id AS question_id, doc_id AS ord, 'test-' || (doc_id // 10) AS test_id, node_id AS source_node_id,
       CASE WHEN doc_id % 13 = 0 THEN 'short' ELSE 'Which passage belongs to document ' || doc_id END AS prompt,
       CASE WHEN doc_id % 11 = 0 THEN MAP {'A': 'first ' || doc_id, 'B': '  ', 'C': 'third ' || doc_id}
            ELSE MAP {'A': 'first ' || doc_id, 'B': 'second ' || doc_id, 'C': 'third ' || doc_id, 'D': 'fourth ' || doc_id} END AS choices,
       ['A', 'B', 'C', 'D'][doc_id % 4 + 1] AS correct,
       CASE WHEN doc_id % 3 = 1 THEN good || ' not there' ELSE '  ' || lower(good) END AS answer_span,
       CASE WHEN doc_id % 5 = 0 THEN [900000, 0] ELSE [0, 1] END AS source_paragraph_ids,
       ['easy', 'medium', 'hard'][doc_id % 3 + 1] AS difficulty,
       CASE WHEN doc_id % 17 = 0 THEN 'guess' ELSE 'understand' END AS bloom_level,
       'because of ' || doc_id AS explanation
FROM (SELECT *, coalesce(ps[1], 'no paragraph') AS good FROM fx_lines)""",
    "fx_lines",
)


def question_verdicts(t: Tables) -> DataFrame:
    """External verdicts from the labels table; questions on unlabelled documents have none."""
    return t("labels").select(
        F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question_id"),
        F.when(F.col("toxic") == 1, F.lit(None)).when(F.col("quality") == 0, "reject").otherwise("accept").alias("verdict"),
    )


block(
    "fx_question_verdict",
    """
SELECT 'q' || doc_id AS question_id, CASE WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN 'reject' ELSE 'accept' END AS verdict
FROM labels""",
)


def answers(t: Tables) -> DataFrame:
    """An event is its user's answer to the question of the same number; numbers without one are extra."""
    e = F.col("event_id")
    return t("events").select(
        F.col("user_id").alias("submission_id"),
        F.concat(F.lit("q"), e.cast("string")).alias("question_id"),
        _choose(K.CHOICES, F.length("event_type") % 4).alias("choice"),
    )


block(
    "fx_answer",
    """
SELECT user_id AS submission_id, 'q' || event_id AS question_id, ['A', 'B', 'C', 'D'][length(event_type) % 4 + 1] AS choice
FROM events""",
)


# --- dialogue and jobs ----------------------------------------------------------------------------
def messages(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")


block("fx_message", "SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text FROM conversations")

JOB_EVENTS = {
    "signup": "queued",
    "view": "stage_start",
    "click": "stage_progress",
    "purchase": "pipeline_complete",
    "error": "stage_error",
}


def job_events(events: DataFrame) -> DataFrame:
    """Five events in a row of one user are a job."""
    name = F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])
    return events.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 1000).cast("string")).alias("job_id"),
        "event_id",
        "ts",
        name[F.col("event_type")].alias("event"),
        F.get_json_object("props", "$.k").cast("int").alias("total_nodes"),
    )


block(
    "fx_job_event",
    """
SELECT user_id || '-' || (event_id // 1000) AS job_id, event_id, ts,
       CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'stage_start' WHEN 'click' THEN 'stage_progress'
                       WHEN 'purchase' THEN 'pipeline_complete' ELSE 'stage_error' END AS event,
       CAST(json_extract_string(props, '$.k') AS INTEGER) AS total_nodes
FROM events""",
)


def agent_events(t: Tables) -> DataFrame:
    """Recorded agent events: per assistant turn a lookup, its result, citations and text pieces.

    Time is made from the turn: one second per event number.
    """
    said = messages(t).filter(F.col("role") == "assistant")
    turn_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    n = F.col("conv_id") % 4
    size = F.length("text")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / 80).cast("int")),
        lambda i: F.struct(
            (i + 20).alias("seq"),
            F.lit("text-delta").alias("type"),
            F.lit("").alias("id"),
            F.substr(F.col("text"), i * 80 + 1, F.lit(80)).alias("payload"),
            F.lit(0).alias("number"),
        ),
    )

    def event(seq: Column, kind: str, ident: Column, payload: Column, number: Column) -> Column:
        return F.struct(
            seq.cast("int").alias("seq"), F.lit(kind).alias("type"), ident.alias("id"), payload.alias("payload"), number.cast("int").alias("number")
        )

    cites = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(1), n.cast("int")),
            lambda i: event(i + 2, "data-citation", F.concat(F.lit("c"), i.cast("string")), F.concat(F.lit("node "), i.cast("string")), i),
        ),
    ).otherwise(F.array().cast("array<struct<seq:int,type:string,id:string,payload:string,number:int>>"))
    one, blank, zero = F.lit("tc1"), F.lit(""), F.lit(0)
    calls = F.when(
        F.col("turn") % 4 == 1,
        F.array(
            event(F.lit(1), "tool-call", one, F.substring("text", 1, 40), zero),
            event(F.lit(2), "tool-result", one, F.lit("All subjects"), n),
        ),
    ).otherwise(F.array(event(F.lit(1), "tool-call", one, F.substring("text", 1, 40), zero)))
    end = F.when(
        F.col("conv_id") % 9 != 8, F.array(event(F.size(pieces) + 20, "finish", blank, F.lit("stop"), zero))
    ).otherwise(F.array().cast("array<struct<seq:int,type:string,id:string,payload:string,number:int>>"))
    start = F.array(event(F.lit(0), "start-step", blank, blank, zero))
    return said.select(
        turn_id.alias("turn_id"), "conv_id", "turn", F.inline(F.concat(start, calls, cites, pieces, end))
    ).withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 10000000 + F.col("turn") * 100000 + F.col("seq")))


block(
    "fx_agent_event",
    """
SELECT conv_id || '-' || turn AS turn_id, conv_id, turn, seq, type, id, payload, number,
       make_timestamp((conv_id * 10000000 + turn * 100000 + seq) * 1000000) AS ts
FROM (
  SELECT conv_id, turn, CAST(0 AS INTEGER) AS seq, 'start-step' AS type, '' AS id, '' AS payload, CAST(0 AS INTEGER) AS number FROM fx_message WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 1, 'tool-call', 'tc1', substr(text, 1, 40), 0 FROM fx_message WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 2, 'tool-result', 'tc1', 'All subjects', CAST(conv_id % 4 AS INTEGER) FROM fx_message WHERE role = 'assistant' AND turn % 4 = 1
  UNION ALL SELECT conv_id, turn, CAST(i + 2 AS INTEGER), 'data-citation', 'c' || i, 'node ' || i, CAST(i AS INTEGER)
    FROM (SELECT conv_id, turn, unnest(range(1, conv_id % 4 + 1)) AS i FROM fx_message WHERE role = 'assistant')
  UNION ALL SELECT conv_id, turn, CAST(i + 20 AS INTEGER), 'text-delta', '', substr(text, i * 80 + 1, 80), 0
    FROM (SELECT conv_id, turn, text, unnest(range(0, (greatest(length(text), 1) - 1) // 80 + 1)) AS i FROM fx_message WHERE role = 'assistant')
  UNION ALL SELECT conv_id, turn, CAST((greatest(length(text), 1) - 1) // 80 + 21 AS INTEGER), 'finish', '', 'stop', 0 FROM fx_message WHERE role = 'assistant' AND conv_id % 9 <> 8
)""",
    "fx_message",
)
