"""Similarity, dedup and merge queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import slugs
from leafloom.functions import text as T
from leafloom.functions import vectors as V
from leafloom.operators import dedup, merging
from leafloom.operators import similarity as S
from leafloom.plans import fixtures as fx
from leafloom.plans.registry import again, block, query
from leafloom.plans.tree_queries import slug_sql
from leafloom.session import Tables, cut_lineage, fresh_path, stored
from leafloom.sources.snapshots import SnapshotStore

_SIG = r"regexp_replace(title || chr(10) || chr(10) || substr(regexp_replace(body, '^\s+|\s+$', '', 'g'), 1, 500), '^\s+|\s+$', '', 'g')"
block("signed", f"SELECT *, {_SIG} AS signature, md5({_SIG}) AS sig FROM fx_leaf", "fx_leaf")
block(
    "sig_group",
    """
SELECT subject, is_new, sig, count(*) AS n, min(ord) AS first_ord, arg_min(node_id, ord) AS first_node, any_value(signature) AS signature
FROM signed GROUP BY subject, is_new, sig""",
    "signed",
)
block(
    "slot_weight",
    """
SELECT subject, is_new, sig, slot, c / sqrt(sum(c * c) OVER (PARTITION BY subject, is_new, sig)) AS weight FROM (
  SELECT subject, is_new, sig, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 1024 AS INTEGER) AS slot, count(*) AS c
  FROM (SELECT subject, is_new, sig, unnest(regexp_extract_all(lower(signature), '[a-z][a-z0-9]+')) AS tok FROM sig_group) GROUP BY ALL)""",
    "sig_group",
)


def _pair_block(name: str, threshold: float) -> None:
    block(
        name,
        f"""
SELECT p.*, a.n AS n_new, b.n AS n_existing, a.first_node AS new_node, b.first_node AS existing_node, a.first_ord AS new_ord, b.first_ord AS existing_ord
FROM (SELECT a.subject, a.sig AS new_sig, b.sig AS existing_sig, round(sum(a.weight * b.weight), 6) AS similarity
      FROM slot_weight a JOIN slot_weight b ON a.subject = b.subject AND a.slot = b.slot AND a.is_new AND NOT b.is_new
      GROUP BY a.subject, a.sig, b.sig) p
JOIN sig_group a ON a.subject = p.subject AND a.sig = p.new_sig AND a.is_new
JOIN sig_group b ON b.subject = p.subject AND b.sig = p.existing_sig AND NOT b.is_new
WHERE similarity >= {threshold}""",
        "slot_weight",
    )


_pair_block("pair", 0.8)


def signed(t: Tables) -> DataFrame:
    return S.with_signature(fx.leaves(t))


def pairs(t: Tables, threshold: float = K.GREY_SIMILARITY) -> DataFrame:
    return S.leaf_pairs(fx.leaves(t), threshold)


@query("embed_signature", "SELECT node_id, sig FROM signed", ("signed",))
def _(t):
    return signed(t).select("node_id", "sig")


@query("hashbag_embed", "SELECT subject, is_new, sig, slot, round(weight, 6) AS weight FROM slot_weight", ("slot_weight",))
def _(t):
    groups = S.signature_groups(signed(t))
    rows = S.hash_embedder()(groups.select("subject", "is_new", "sig", F.col("signature").alias("text")))
    return rows.withColumn("weight", F.round("weight", 6))


_PAIR_COLUMNS = ["subject", "new_sig", "existing_sig", "similarity", "n_new", "n_existing", "new_node", "existing_node", "new_ord", "existing_ord"]


@query("pair_similarity", f"SELECT {', '.join(_PAIR_COLUMNS)} FROM pair", ("pair",))
def _(t):
    return pairs(t).select(*_PAIR_COLUMNS)


block("vec", "SELECT vec_id, label, embedding, vec_id % 2 = 1 AS is_new FROM embeddings")


@query(
    "embedding_pair_similarity",
    """
SELECT a.label, a.vec_id AS new_id, b.vec_id AS existing_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM vec a JOIN vec b ON a.label = b.label AND a.is_new AND NOT b.is_new
WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3""",
    ("vec",),
)
def _(t):
    rows = t("embeddings").withColumn("is_new", F.col("vec_id") % 2 == 1)
    return S.dense_pairs(rows, "label", "vec_id", "embedding", 0.3)


@query(
    "cosine",
    """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(t):
    a = t("embeddings").select("vec_id", F.col("embedding").alias("a"))
    b = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


block(
    "centroid",
    """
SELECT label, list(s ORDER BY i) AS v FROM (
  SELECT label, i, sum(x / norm) AS s FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings)
  GROUP BY label, i) GROUP BY label""",
)


@query(
    "sibling_cohesion",
    """
SELECT label, n, round(cohesion, 6) AS cohesion, round(divergence, 6) AS divergence, coalesce(cohesion, 1.0) >= 0.55 AS cohesive, coalesce(divergence, 1.0) >= 0.15 AS "distinct"
FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) c
LEFT JOIN (SELECT a.label, avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS cohesion FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label) USING (label)
LEFT JOIN (SELECT a.label, avg(1 - list_cosine_similarity(a.v, b.v)) AS divergence FROM centroid a JOIN centroid b ON a.label <> b.label GROUP BY a.label) USING (label)""",
    ("centroid",),
)
def _(t):
    return S.sibling_cohesion(t("embeddings"), "label", "embedding")


block(
    "link_sim",
    """
SELECT label, vec_id, row_number() OVER w AS n, list_cosine_similarity(previous::DOUBLE[], embedding::DOUBLE[]) AS similarity
FROM (SELECT *, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS previous FROM embeddings) WHERE previous IS NOT NULL
WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
)


@query(
    "similarity_valleys",
    """
SELECT label, vec_id, smoothed FROM (
  SELECT *, lag(smoothed) OVER w AS l, lead(smoothed) OVER w AS r FROM (
    SELECT label, vec_id, round(avg(similarity) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM link_sim)
  WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE smoothed < l AND smoothed <= r""",
    ("link_sim",),
)
def _(t):
    return S.similarity_valleys(t("embeddings"), "label", "vec_id", "embedding")


block(
    "verdict",
    """
SELECT new_sig, existing_sig, CASE WHEN d <= '5' THEN 'duplicate' WHEN d <= 'a' THEN 'related' ELSE 'different' END AS verdict
FROM (SELECT new_sig, existing_sig, substr(md5(new_sig || existing_sig), 1, 1) AS d FROM pair) WHERE d <> 'f'""",
    "pair",
)


def verdicts(rows: DataFrame) -> DataFrame:
    """Stand-in for an external judge: the verdict hangs on a hash of the pair, and some pairs have none."""
    d = F.substring(F.md5(F.concat("new_sig", "existing_sig")), 1, 1)
    name = F.when(d <= "5", "duplicate").when(d <= "a", "related").otherwise("different")
    return rows.select("new_sig", "existing_sig", name.alias("verdict"), d.alias("_d")).filter("_d <> 'f'").drop("_d").dropDuplicates(["new_sig", "existing_sig"])


def decided(t: Tables) -> DataFrame:
    found = stored(pairs(t), "pairs")
    return dedup.decide(found, verdicts(found))


def best_decided(t: Tables, threshold: float = K.GREY_SIMILARITY) -> DataFrame:
    """Like ``decided``, for queries that go on with the best match of each new signature: pairs that can't be it are not listed."""
    found = stored(S.leaf_pairs(fx.leaves(t), threshold, best=True), "pairs")
    return dedup.decide(found, verdicts(found))


block(
    "decided",
    """
SELECT p.*, CASE WHEN similarity < 0.8 THEN 'different' WHEN similarity < 0.92 THEN 'grey' ELSE 'auto' END AS bucket, v.verdict,
       CASE WHEN similarity >= 0.92 THEN 'duplicate' ELSE coalesce(v.verdict, 'related') END AS decision
FROM pair p LEFT JOIN (SELECT DISTINCT * FROM verdict) v USING (new_sig, existing_sig)""",
    "verdict",
)


@query("similarity_bucket", "SELECT subject, new_sig, existing_sig, bucket FROM decided", ("decided",))
def _(t):
    bucket = V.similarity_bucket(F.col("similarity")).alias("bucket")
    return pairs(t).select("subject", "new_sig", "existing_sig", bucket)


@query("judge_join", "SELECT subject, new_sig, existing_sig, similarity, verdict, decision FROM decided", ("decided",))
def _(t):
    return decided(t).select("subject", "new_sig", "existing_sig", "similarity", "verdict", "decision")


@query(
    "dedup_report",
    """
SELECT subject, coalesce(d.dup, 0)::BIGINT AS duplicates, coalesce(d.rel, 0)::BIGINT AS related, (a * b - coalesce(d.dup, 0) - coalesce(d.rel, 0))::BIGINT AS different
FROM (SELECT subject, count(*) FILTER (is_new) AS a, count(*) FILTER (NOT is_new) AS b FROM fx_leaf GROUP BY subject)
LEFT JOIN (SELECT subject, sum(n_new * n_existing) FILTER (decision = 'duplicate') AS dup, sum(n_new * n_existing) FILTER (decision = 'related') AS rel FROM decided GROUP BY subject) d USING (subject)""",
    ("decided",),
)
def _(t):
    return dedup.report(decided(t), S.signature_groups(signed(t)))


@query(
    "authority_rank",
    """
SELECT node_id, CAST(CASE lower(trim(publisher)) WHEN 'ncert' THEN 0 WHEN 'rbse' THEN 1 WHEN 'springboard academy' THEN 2 ELSE 3 END AS INTEGER) AS rank FROM fx_leaf""",
    ("fx_leaf",),
)
def _(t):
    return fx.leaves(t).select("node_id", T.authority_rank(F.col("publisher")).alias("rank"))


_RANK = "CASE lower(trim(publisher)) WHEN 'ncert' THEN 0 WHEN 'rbse' THEN 1 WHEN 'springboard academy' THEN 2 ELSE 3 END"
block(
    "best_member",
    f"SELECT subject, is_new, sig, min(ROW({_RANK}, -length(body), node_id)) AS best FROM signed GROUP BY subject, is_new, sig",
    "signed",
)
block(
    "won",
    """
SELECT d.subject, d.new_sig, d.existing_sig, d.similarity, least(a.best, b.best) AS w, greatest(a.best, b.best) AS l
FROM decided d JOIN best_member a ON a.subject = d.subject AND a.sig = d.new_sig AND a.is_new
JOIN best_member b ON b.subject = d.subject AND b.sig = d.existing_sig AND NOT b.is_new WHERE d.decision = 'duplicate'""",
    "decided",
    "best_member",
)


def winners(t: Tables) -> DataFrame:
    return dedup.pick_winners(decided(t).filter("decision = 'duplicate'"), dedup.best_members(signed(t)))


@query("pick_winner", "SELECT subject, new_sig, existing_sig, similarity, w[3] AS winner, l[3] AS loser FROM won", ("won",))
def _(t):
    return winners(t).drop("winner_order")


block(
    "edge",
    """
SELECT DISTINCT a, b FROM (
  SELECT subject || ':n:' || new_sig AS a, subject || ':e:' || existing_sig AS b FROM decided WHERE decision = 'duplicate'
  UNION ALL SELECT subject || ':e:' || existing_sig, subject || ':n:' || new_sig FROM decided WHERE decision = 'duplicate')""",
    "decided",
)
block("reach", "SELECT a AS id, a AS other FROM edge UNION SELECT r.id, e.b FROM reach r JOIN edge e ON e.a = r.other", "edge")
block(
    "member_of",
    f"""
SELECT s.node_id, c.cluster, ROW({_RANK}, -length(body), node_id) AS o
FROM (SELECT *, subject || CASE WHEN is_new THEN ':n:' ELSE ':e:' END || sig AS id FROM signed) s
JOIN (SELECT id, min(other) AS cluster FROM reach GROUP BY id) c USING (id)""",
    "reach",
    "signed",
)


@query(
    "duplicate_clusters",
    "SELECT node_id, cluster, (min(o) OVER (PARTITION BY cluster))[3] AS winner FROM member_of",
    ("member_of",),
)
def _(t):
    return dedup.clusters(decided(t).filter("decision = 'duplicate'"), signed(t))


block(
    "loser",
    "SELECT l[3] AS node_id, min(w)[3] AS winner FROM won GROUP BY l[3]",
    "won",
)
block(
    "chase",
    "SELECT node_id, winner AS head FROM loser UNION SELECT c.node_id, l.winner FROM chase c JOIN loser l ON l.node_id = c.head",
    "loser",
)


@query(
    "supersede_leaves",
    """
SELECT f.node_id, c.head AS superseded_by FROM fx_leaf f LEFT JOIN (SELECT * FROM chase WHERE head NOT IN (SELECT node_id FROM loser)) c USING (node_id)""",
    ("chase", "fx_leaf"),
)
def _(t):
    won = winners(t)
    losers = won.groupBy(F.col("loser").alias("node_id")).agg(F.min("winner_order").alias("_w")).select("node_id", F.col("_w.node_id").alias("winner"))
    losers = cut_lineage(losers)
    leaves = fx.leaves(t).select("node_id", F.lit(None).cast("string").alias("superseded_by"))
    once = dedup.supersede(leaves, losers)
    return once


@query(
    "embedding_cache_miss",
    """
SELECT DISTINCT 'sha256:' || sha256(body) AS content_hash FROM fx_leaf WHERE 'sha256:' || sha256(body) NOT IN (SELECT 'sha256:' || sha256(body) FROM fx_leaf WHERE NOT is_new)""",
    ("fx_leaf",),
)
def _(t):
    rows = fx.leaves(t).select(T.content_hash(F.col("body")).alias("content_hash"), F.col("body").alias("text"), "is_new")
    return dedup.missing_from_cache(rows, rows.filter("NOT is_new")).select("content_hash")


# --- merge ----------------------------------------------------------------------------------------
block(
    "best_match",
    """
SELECT subject, new_sig, existing_sig, existing_node, existing_ord, similarity, decision FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, new_sig ORDER BY similarity DESC, existing_ord) AS rn FROM decided) WHERE rn = 1""",
    "decided",
)


# The best existing leaf is the most similar of all that share a word's slot, however little.
_pair_block("any_pair", 0)


@query(
    "best_existing_match",
    """
SELECT s.node_id, b.existing_node, b.similarity FROM signed s JOIN (
  SELECT *, row_number() OVER (PARTITION BY subject, new_sig ORDER BY similarity DESC, existing_ord) AS rn FROM any_pair) b ON b.subject = s.subject AND b.new_sig = s.sig
WHERE s.is_new AND b.rn = 1""",
    ("any_pair", "signed"),
)
def _(t):
    best = merging.best_match(best_decided(t, 0.0)).withColumnRenamed("new_sig", "sig")
    return signed(t).filter("is_new").join(best, ["subject", "sig"]).select("node_id", "existing_node", "similarity")


@query("argmax_match", "SELECT subject, new_sig, existing_sig, similarity FROM best_match", ("best_match",))
def _(t):
    return merging.best_match(best_decided(t)).select("subject", "new_sig", "existing_sig", "similarity")


block(
    "fx_chapter",
    f"""
SELECT subject, subject || '/' || lpad(CAST(ord AS VARCHAR), 2, '0') || '-' || slug AS chapter_id, ord, slug FROM (
  SELECT subject, CAST(CAST(regexp_extract(book_slug, '(\\d+)', 1) AS INTEGER) + 1 AS INTEGER) AS ord, {slug_sql('arg_min(title, ord)')} AS slug
  FROM fx_leaf WHERE NOT is_new GROUP BY subject, book_slug)""",
    "fx_leaf",
)


def chapters(t: Tables) -> DataFrame:
    """A chapter per subject and existing book, named after the book's first leaf."""
    rows = fx.leaves(t).filter("NOT is_new").groupBy("subject", "book_slug").agg(F.min_by("title", "ord").alias("title"))
    rows = rows.select("subject", "title", (fx.source_number(F.col("book_slug")) + 1).cast("int").alias("ord"), slugs.slugify(F.col("title")).alias("slug"))
    return rows.withColumn("chapter_id", F.concat_ws("/", "subject", slugs.path_segment(F.col("ord"), F.col("slug"))))


block(
    "slug_match",
    f"""
SELECT subject, node_id, chapter_id, shared FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, node_id ORDER BY shared DESC, ord) AS rn FROM (
    SELECT l.subject, l.node_id, c.chapter_id, c.ord, count(*) AS shared
    FROM (SELECT subject, node_id, unnest(list_distinct(string_split({slug_sql('title')}, '-'))) AS token FROM fx_leaf WHERE is_new) l
    JOIN (SELECT subject, chapter_id, ord, unnest(list_distinct(string_split(slug, '-'))) AS token FROM fx_chapter) c USING (subject, token)
    GROUP BY ALL)) WHERE rn = 1""",
    "fx_chapter",
)


@query("match_chapter_by_slug", "SELECT subject, node_id, chapter_id, shared FROM slug_match", ("slug_match",))
def _(t):
    return merging.match_chapter(fx.leaves(t).filter("is_new"), chapters(t))


block(
    "external_choice",
    """
SELECT l.subject, l.node_id, min(c.chapter_id) AS chapter_id FROM fx_leaf l JOIN labels b ON b.doc_id = l.ord JOIN fx_chapter c ON c.subject = l.subject
WHERE l.is_new AND b.quality = 1 GROUP BY l.subject, l.node_id""",
    "fx_chapter",
)


def external(t: Tables) -> DataFrame:
    """Stand-in for an external classifier: labelled good leaves go to the first chapter of the subject."""
    good = t("labels").filter("quality = 1").select(F.col("doc_id").alias("ord"))
    first = chapters(t).groupBy("subject").agg(F.min("chapter_id").alias("chapter_id"))
    return fx.leaves(t).filter("is_new").join(good, "ord").join(first, "subject").select("subject", "node_id", "chapter_id")


@query(
    "chapter_classifier_override",
    """
SELECT l.subject, l.node_id, coalesce(e.chapter_id, s.chapter_id) AS chapter_id
FROM fx_leaf l LEFT JOIN external_choice e USING (subject, node_id) LEFT JOIN slug_match s USING (subject, node_id) WHERE l.is_new""",
    ("external_choice", "slug_match"),
)
def _(t):
    new = fx.leaves(t).filter("is_new")
    return merging.choose_chapter(new, merging.match_chapter(new, chapters(t)), external(t))


def actions(t: Tables) -> DataFrame:
    return merging.plan(signed(t).filter("is_new"), best_decided(t), chapters(t))


block(
    "first_action",
    """
SELECT s.subject, s.ord, s.node_id, CASE WHEN b.existing_node IS NOT NULL THEN 'appended' WHEN m.chapter_id IS NOT NULL THEN 'added_leaf' ELSE 'unplaced' END AS action,
       coalesce(b.existing_node, m.chapter_id) AS target
FROM signed s LEFT JOIN (SELECT * FROM best_match WHERE decision = 'duplicate') b ON b.subject = s.subject AND b.new_sig = s.sig
LEFT JOIN slug_match m ON m.subject = s.subject AND m.node_id = s.node_id WHERE s.is_new""",
    "best_match",
    "slug_match",
    "signed",
)


block(
    "unplaced",
    f"""
SELECT a.subject, a.node_id, a.ord, list_distinct(string_split({slug_sql('l.title')}, '-')) AS tokens, row_number() OVER (PARTITION BY a.subject ORDER BY a.ord) AS k
FROM first_action a JOIN fx_leaf l USING (node_id) WHERE a.action = 'unplaced'""",
    "first_action",
    "fx_leaf",
)

# Leaf by leaf: what was opened so far is carried along; the number of shared words decides, then the chapter opened first.
block(
    "greedy",
    """
WITH RECURSIVE walk AS (
  SELECT subject, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS node_id, CAST(NULL AS VARCHAR) AS opener, CAST([] AS STRUCT(node VARCHAR, words VARCHAR[])[]) AS opened
  FROM (SELECT DISTINCT subject FROM unplaced)
  UNION ALL
  SELECT subject, k, node_id, CASE WHEN best.n > 0 THEN opened[-best.i].node ELSE node_id END,
         CASE WHEN best.n > 0 THEN opened ELSE list_append(opened, {'node': node_id, 'words': tokens}) END
  FROM (
    SELECT u.subject, u.k, u.node_id, u.tokens, w.opened,
           list_max(list_transform(range(1, len(w.opened) + 1), lambda i: {'n': len(list_intersect(w.opened[i].words, u.tokens)), 'i': -i})) AS best
    FROM walk w JOIN unplaced u ON u.subject = w.subject AND u.k = w.k + 1)
)
SELECT subject, node_id, opener FROM walk WHERE k > 0""",
    "unplaced",
)

block(
    "action",
    """
SELECT a.subject, a.ord, a.node_id, CASE WHEN g.opener = a.node_id THEN 'added_chapter' WHEN g.opener IS NOT NULL THEN 'added_leaf' ELSE a.action END AS action,
       coalesce(g.opener, a.target) AS target
FROM first_action a LEFT JOIN greedy g USING (subject, node_id)""",
    "first_action",
    "greedy",
)


@query("merge_actions", "SELECT subject, node_id, action, target FROM action", ("action",))
def _(t):
    return actions(t).select("subject", "node_id", "action", "target")


@query(
    "merge_report",
    """
SELECT subject, count(*) FILTER (action = 'appended') AS appended, count(*) FILTER (action = 'added_leaf') AS added_leaf, count(*) FILTER (action = 'added_chapter') AS added_chapter
FROM action GROUP BY subject""",
    ("action",),
)
def _(t):
    return merging.report(actions(t))


block(
    "appended",
    "SELECT *, CAST(1 + row_number() OVER (PARTITION BY target ORDER BY ord) AS INTEGER) AS source_id FROM first_action WHERE action = 'appended'",
    "first_action",
)


def existing_tree(t: Tables) -> DataFrame:
    """Existing subject trees: a root per subject, chapters, and the existing leaves below them."""
    old = fx.leaves(t).filter("NOT is_new")
    chap = chapters(t).withColumn("_book", F.concat(F.lit("src"), (F.col("ord") - 1).cast("string")))
    source = F.struct(
        F.lit(1).alias("source_id"),
        "publisher",
        "book_slug",
        F.array((F.col("ord") % 90 + 1).cast("int")).alias("pages"),
        F.array().cast("array<int>").alias("paragraph_ids"),
        T.authority_rank(F.col("publisher")).alias("authority_rank"),
        F.lit("2024-01-01T00:00:00Z").alias("ingested_at"),
    )
    body = T.wrap_leaf_body(F.col("body"), F.array((F.col("ord") % 90 + 1).cast("int")))
    leaves = old.join(chap.select("subject", F.col("_book").alias("book_slug"), "chapter_id"), ["subject", "book_slug"]).select(
        "subject", "node_id", F.col("chapter_id").alias("parent"), F.lit(2).alias("depth"), F.col("ord").cast("int").alias("order"),
        F.col("title").alias("name"), body.alias("body"), F.array(source).alias("sources"), T.content_hash(body).alias("content_hash"),
    )
    none = F.lit(None).cast(leaves.schema["sources"].dataType).alias("sources")
    empty = T.content_hash(F.lit("")).alias("content_hash")
    inner = chap.select(
        "subject", F.col("chapter_id").alias("node_id"), F.col("subject").alias("parent"), F.lit(1).alias("depth"), F.col("ord").alias("order"),
        F.col("title").alias("name"), F.lit("").alias("body"), none, empty,
    )
    root = chap.select("subject").distinct().select(
        "subject", F.col("subject").alias("node_id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("order"),
        F.col("subject").alias("name"), F.lit("").alias("body"), none, empty,
    )
    return leaves.unionByName(inner).unionByName(root)


def new_leaves(t: Tables) -> DataFrame:
    return S.with_signature(plain_new_leaves(t))


def plain_new_leaves(t: Tables) -> DataFrame:
    rows = fx.leaves(t).filter("is_new")
    page = F.array((F.col("ord") % 90 + 1).cast("int"))
    return rows.withColumns({"pages": page, "paragraph_ids": F.array(F.lit(0)), "authority_rank": T.authority_rank(F.col("publisher"))})


@query("next_source_id", "SELECT node_id, target, source_id FROM appended", ("appended",))
def _(t):
    top = fx.leaves(t).filter("NOT is_new").select("node_id", F.lit(1).alias("max_source_id"))
    rows = actions(t).filter("action = 'appended'")
    return merging.next_source_ids(rows, top).select("node_id", "target", "source_id")


@query(
    "next_position",
    """
SELECT a.node_id, a.target, CAST(coalesce(m.top, 0) + row_number() OVER (PARTITION BY a.target ORDER BY a.ord) AS INTEGER) AS "order"
FROM first_action a LEFT JOIN (SELECT c.chapter_id AS target, max(l.ord) AS top FROM fx_leaf l JOIN fx_chapter c ON c.subject = l.subject AND 'src' || (c.ord - 1) = l.book_slug WHERE NOT l.is_new GROUP BY 1) m USING (target)
WHERE a.action = 'added_leaf'""",
    ("first_action",),
)
def _(t):
    known = chapters(t).select(F.col("chapter_id").alias("target"))
    rows = actions(t).filter("action = 'added_leaf'").join(known, "target", "left_semi")
    top = existing_tree(t).filter("depth = 2").groupBy(F.col("parent").alias("target")).agg(F.max("order").alias("max_order"))
    return merging.next_positions(rows, "target", top).select("node_id", "target", "order")


@query(
    "append_source_section",
    r"""
SELECT l.node_id, md5(b.body) AS body_md5, 'sha256:' || sha256(b.body) AS content_hash, CAST(1 + coalesce(m.n, 0) AS INTEGER) AS sources
FROM fx_leaf l LEFT JOIN (
  SELECT a.target, count(*) AS n, string_agg('## Source ' || a.source_id || ' (page ' || (a.ord % 90 + 1) || ')' || chr(10) || chr(10) || regexp_replace(f.body, '^\s+|\s+$', '', 'g') || chr(10), chr(10) ORDER BY a.source_id) AS more
  FROM appended a JOIN fx_leaf f ON f.node_id = a.node_id GROUP BY a.target) m ON m.target = l.node_id,
LATERAL (SELECT '## Source 1 (page ' || (l.ord % 90 + 1) || ')' || chr(10) || chr(10) || regexp_replace(l.body, '^\s+|\s+$', '', 'g') AS head) h,
LATERAL (SELECT CASE WHEN m.more IS NULL THEN h.head || chr(10) ELSE h.head || chr(10) || chr(10) || m.more END AS body) b
WHERE NOT l.is_new""",
    ("appended", "fx_leaf"),
)
def _(t):
    snapshot = merging.apply(existing_tree(t), new_leaves(t), actions(t), "2024-02-01T00:00:00Z")
    old = fx.leaves(t).filter("NOT is_new").select("node_id")
    return snapshot.join(old, "node_id", "left_semi").select("node_id", F.md5("body").alias("body_md5"), "content_hash", F.size("sources").alias("sources"))


def apply_sql(name: str, before: str, new: str, action: str) -> None:
    """Blocks of the snapshot after one merge, ``<name>_after``: ``before`` with the actions of the leaves in ``new`` applied."""
    n = name
    base = slug_sql("x.title")
    strip = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
    section = f"'## Source ' || {{}} || ' (page ' || f.page || ')' || chr(10) || chr(10) || {strip.format('f.body')} || chr(10)"
    bare = r"regexp_replace(string_split(node_id, '/')[-1], '^\d+-', '')"
    # Of siblings, those there before keep their slugs; a new one takes its base, or the next number that is free.
    slug = """
SELECT x.*, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM (
  SELECT x.*, (SELECT count(*) FROM {n}_named o WHERE o.parent = x.parent AND (o.slug = x.base OR regexp_matches(o.slug, '^' || x.base || '-[0-9]+$')))
         + row_number() OVER (PARTITION BY x.parent, x.base ORDER BY x.ord) AS n FROM ({rows}) x) x"""
    block(f"{n}_named", f"SELECT parent, {bare} AS slug FROM {before} WHERE depth > 0", before)
    block(
        f"{n}_extra",
        f"""
SELECT target, count(*) AS n, string_agg(section, chr(10) ORDER BY ord) AS more FROM (
  SELECT a.target, a.ord, {section.format('(t.sources + row_number() OVER (PARTITION BY a.target ORDER BY a.ord))')} AS section
  FROM {action} a JOIN {new} f ON f.node_id = a.node_id JOIN {before} t ON t.node_id = a.target WHERE a.action = 'appended') GROUP BY target""",
        action,
        new,
        before,
    )
    block(
        f"{n}_opened",
        f"""
SELECT subject, node_id AS opener, title, "order", subject || '/' || format('{{:02d}}', "order") || '-' || slug AS path FROM ({slug.format(n=n, rows=f"""
  SELECT x.subject, x.subject AS parent, x.node_id, x.title, x.ord, {base} AS base,
         CAST(coalesce((SELECT max(o."order") FROM {before} o WHERE o.subject = x.subject AND o.depth = 1), 0) + row_number() OVER (PARTITION BY x.subject ORDER BY x.ord) AS INTEGER) AS "order"
  FROM {new} x JOIN {action} a USING (node_id) WHERE a.action = 'added_chapter'""")})""",
        f"{n}_named",
        action,
    )
    block(
        f"{n}_added",
        f"""
SELECT subject, parent || '/' || format('{{:02d}}', "order") || '-' || slug AS node_id, parent, "order", title, '## Source 1 (page ' || page || ')' || chr(10) || chr(10) || {strip.format('body')} || chr(10) AS body
FROM ({slug.format(n=n, rows=f"""
  SELECT x.*, {base} AS base, CAST(coalesce((SELECT max(o."order") FROM {before} o WHERE o.parent = x.parent AND o.depth = 2), 0) + row_number() OVER (PARTITION BY x.parent ORDER BY x.ord) AS INTEGER) AS "order"
  FROM (SELECT f.*, coalesce(c.path, a.target) AS parent FROM {new} f JOIN {action} a USING (node_id) LEFT JOIN {n}_opened c ON c.opener = a.target WHERE a.action <> 'appended') x""")})""",
        f"{n}_named",
        f"{n}_opened",
    )
    block(
        f"{n}_after",
        rf"""
SELECT t.subject, t.node_id, t.parent, t.depth, t."order", t.name, w.body, 'sha256:' || sha256(w.body) AS content_hash, CAST(t.sources + coalesce(m.n, 0) AS INTEGER) AS sources
FROM {before} t LEFT JOIN {n}_extra m ON m.target = t.node_id,
LATERAL (SELECT CASE WHEN m.more IS NULL THEN t.body ELSE regexp_replace(t.body, '\s+$', '') || chr(10) || chr(10) || m.more END AS body) w
UNION ALL SELECT subject, path, subject, CAST(1 AS INTEGER), "order", title, '', 'sha256:' || sha256(''), CAST(0 AS INTEGER) FROM {n}_opened
UNION ALL SELECT subject, node_id, parent, CAST(2 AS INTEGER), "order", title, body, 'sha256:' || sha256(body), CAST(1 AS INTEGER) FROM {n}_added""",
        f"{n}_extra",
        f"{n}_opened",
        f"{n}_added",
    )


block("new_leaf", "SELECT subject, ord, node_id, title, body, ord % 90 + 1 AS page FROM fx_leaf WHERE is_new", "fx_leaf")
block(
    "fx_tree",
    r"""
SELECT subject, subject AS node_id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS INTEGER) AS depth, CAST(0 AS INTEGER) AS "order", subject AS name, '' AS body, 'sha256:' || sha256('') AS content_hash, CAST(0 AS INTEGER) AS sources
FROM (SELECT DISTINCT subject FROM fx_chapter)
UNION ALL SELECT c.subject, c.chapter_id, c.subject, CAST(1 AS INTEGER), c.ord, l.title, '', 'sha256:' || sha256(''), CAST(0 AS INTEGER)
FROM fx_chapter c JOIN (SELECT subject, book_slug, arg_min(title, ord) AS title FROM fx_leaf WHERE NOT is_new GROUP BY subject, book_slug) l ON l.subject = c.subject AND l.book_slug = 'src' || (c.ord - 1)
UNION ALL SELECT l.subject, l.node_id, c.chapter_id, CAST(2 AS INTEGER), CAST(l.ord AS INTEGER), l.title, w.body, 'sha256:' || sha256(w.body), CAST(1 AS INTEGER)
FROM fx_leaf l JOIN fx_chapter c ON c.subject = l.subject AND 'src' || (c.ord - 1) = l.book_slug,
LATERAL (SELECT '## Source 1 (page ' || (l.ord % 90 + 1) || ')' || chr(10) || chr(10) || regexp_replace(l.body, '^\s+|\s+$', '', 'g') || chr(10) AS body) w
WHERE NOT l.is_new""",
    "fx_chapter",
    "fx_leaf",
)
apply_sql("merged", "fx_tree", "new_leaf", "action")
_TREE_COLUMNS = 'subject, node_id, parent, depth, "order", name, content_hash'


@query("apply_merge", f"SELECT {_TREE_COLUMNS}, sources FROM merged_after", ("merged_after",))
def _(t):
    snapshot = merging.apply(existing_tree(t), new_leaves(t), actions(t), "2024-02-01T00:00:00Z")
    return snapshot.select("subject", "node_id", "parent", "depth", "order", "name", "content_hash", F.coalesce(F.size("sources"), F.lit(0)).alias("sources"))


# --- merging as sources arrive: the first source makes the trees, the others are merged into what is there ---
MERGED_AT = "2024-02-01T00:00:00Z"
_HEADING = r"(?m)^## Source \d+ \([^\n)]*\)\n+"


def arriving(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of leaves: first the books with odd numbers, each a chapter named after its first leaf, then the others."""
    page = F.array((F.col("ord") % 90 + 1).cast("int"))
    rows = fx.leaves(t).withColumns({"pages": page, "paragraph_ids": F.array(F.lit(0)), "authority_rank": T.authority_rank(F.col("publisher"))})
    names = rows.groupBy("subject", "book_slug").agg(F.min_by("title", "ord").alias("chapter"))
    rows = rows.join(names, ["subject", "book_slug"])
    return rows.filter("NOT is_new").drop("is_new"), rows.filter("is_new").drop("is_new")


def first_chapter(leaves: DataFrame, chapters: DataFrame) -> DataFrame:
    """Stand-in for an external classifier: by a hash of the leaf, some go to the first chapter of their subject."""
    some = leaves.filter(F.substring(F.md5("node_id"), 1, 1) <= "3")
    first = chapters.groupBy("subject").agg(F.min("chapter_id").alias("chapter_id"))
    return some.join(first, "subject").select("subject", "node_id", "chapter_id")


block(
    "emit_chapter",
    f"""
SELECT subject, book_slug, title, CAST("order" AS INTEGER) AS "order", subject || '/' || format('{{:02d}}', "order") || '-' || CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS path FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, base ORDER BY first_ord) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY subject ORDER BY first_ord) AS "order", {slug_sql('title')} AS base FROM (
      SELECT subject, book_slug, arg_min(title, ord) AS title, min(ord) AS first_ord FROM fx_leaf WHERE NOT is_new GROUP BY subject, book_slug)))""",
    "fx_leaf",
)
block(
    "emit_leaf",
    rf"""
SELECT x.subject, c.path || '/' || format('{{:02d}}', x."order") || '-' || CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS node_id, c.path AS parent, CAST(x."order" AS INTEGER) AS "order", x.title,
       '## Source 1 (page ' || (x.ord % 90 + 1) || ')' || chr(10) || chr(10) || regexp_replace(x.body, '^\s+|\s+$', '', 'g') || chr(10) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY subject, book_slug, base ORDER BY ord) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY subject, book_slug ORDER BY ord) AS "order", {slug_sql('title')} AS base FROM fx_leaf WHERE NOT is_new)) x
JOIN emit_chapter c USING (subject, book_slug)""",
    "emit_chapter",
)
block(
    "emit_after",
    """
SELECT DISTINCT subject, subject AS node_id, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS INTEGER) AS depth, CAST(0 AS INTEGER) AS "order", subject AS name, '' AS body, 'sha256:' || sha256('') AS content_hash, CAST(0 AS INTEGER) AS sources FROM emit_chapter
UNION ALL SELECT subject, path, subject, CAST(1 AS INTEGER), "order", title, '', 'sha256:' || sha256(''), CAST(0 AS INTEGER) FROM emit_chapter
UNION ALL SELECT subject, node_id, parent, CAST(2 AS INTEGER), "order", title, body, 'sha256:' || sha256(body), CAST(1 AS INTEGER) FROM emit_leaf""",
    "emit_leaf",
)
block(
    "sm_leaf",
    rf"""
SELECT subject, ord, node_id, title, body, true AS is_new FROM new_leaf
UNION ALL SELECT l.subject, c."order"::BIGINT * 4294967296 + l."order", l.node_id, l.name, regexp_replace(regexp_replace(l.body, '{_HEADING}', '', 'g'), '^\s+|\s+$', '', 'g'), false
FROM emit_after l JOIN emit_after c ON c.node_id = l.parent WHERE l.depth = 2""",
    "new_leaf",
    "emit_after",
)
block("sm_chapter", r"""SELECT subject, node_id AS chapter_id, "order" AS ord, regexp_replace(string_split(node_id, '/')[-1], '^\d+-', '') AS slug FROM emit_after WHERE depth = 1""", "emit_after")


_ARRIVED = {"fx_leaf": "sm_leaf", "fx_chapter": "sm_chapter", "first_action": "sm_first_action"}
again(["signed", "sig_group", "slot_weight", "pair", "verdict", "decided", "best_match", "slug_match"], "sm", _ARRIVED)
block(
    "sm_first_action",
    """
SELECT s.subject, s.ord, s.node_id, CASE WHEN b.existing_node IS NOT NULL THEN 'appended' WHEN coalesce(e.chapter_id, m.chapter_id) IS NOT NULL THEN 'added_leaf' ELSE 'unplaced' END AS action,
       coalesce(b.existing_node, e.chapter_id, m.chapter_id) AS target
FROM sm_signed s LEFT JOIN (SELECT * FROM sm_best_match WHERE decision = 'duplicate') b ON b.subject = s.subject AND b.new_sig = s.sig
LEFT JOIN sm_slug_match m ON m.subject = s.subject AND m.node_id = s.node_id
LEFT JOIN (SELECT subject, min(chapter_id) AS chapter_id FROM sm_chapter GROUP BY subject) e ON e.subject = s.subject AND md5(s.node_id)[1] <= '3' WHERE s.is_new""",
    "sm_best_match",
    "sm_slug_match",
)
again(["unplaced", "greedy", "action"], "sm", _ARRIVED)
apply_sql("sm", "emit_after", "new_leaf", "sm_action")


@query("stream_merge", f"SELECT {_TREE_COLUMNS} FROM sm_after", ("sm_after",))
def _(t):
    """The second delivery comes after a restart of the stream, and is merged with verdicts of a judge and choices of a classifier."""
    from leafloom.streaming import ingest

    root = fresh_path(t.spark, "trees")
    for delivery in arriving(t):
        delivery.write.mode("append").option("compression", "zstd").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(delivery.schema).parquet(f"{root}/in")
        ingest.run_merge(stream, f"{root}/store", f"{root}/progress", MERGED_AT, verdicts, first_chapter)
    return SnapshotStore(t.spark, f"{root}/store").read().select("subject", "node_id", "parent", "depth", "order", "name", "content_hash")


# --- plug-ins -------------------------------------------------------------------------------------
@query("embedder_plugin", f"SELECT subject, new_sig, existing_sig FROM pair WHERE similarity >= 0.99", ("pair",))
def _(t):
    """The caller's own embedder: here words themselves are the slots."""

    def words(rows: DataFrame) -> DataFrame:
        keys = [c for c in rows.columns if c != "text"]
        entries = F.explode_outer(V.unit_weights(T.tokens(F.col("text"), K.EMBED_WORD))).alias("_e")
        return rows.select(*keys, entries).filter(F.col("_e").isNotNull()).select(*keys, "_e.slot", "_e.weight")

    return S.leaf_pairs(fx.leaves(t), 0.99, words).select("subject", "new_sig", "existing_sig")


@query(
    "judge_plugin",
    "SELECT subject, new_sig, existing_sig, verdict, decision FROM decided WHERE bucket = 'grey'",
    ("decided",),
)
def _(t):
    """The caller's judge sees the grey pairs, and its verdicts decide them."""
    found = stored(pairs(t), "pairs")
    grey = found.filter(V.similarity_bucket(F.col("similarity")) == "grey")
    return dedup.decide(grey, verdicts(grey)).select("subject", "new_sig", "existing_sig", "verdict", "decision")


@query(
    "classifier_plugin",
    """
SELECT subject, node_id, CASE WHEN a.action = 'appended' THEN a.action ELSE 'added_leaf' END AS action, CASE WHEN a.action = 'appended' THEN a.target ELSE e.chapter_id END AS target
FROM first_action a JOIN external_choice e USING (subject, node_id)""",
    ("first_action", "external_choice"),
)
def _(t):
    """The caller's classifier overrides the slug match in the plan of a merge."""
    choice = external(t)
    plan = merging.plan(signed(t).filter("is_new"), best_decided(t), chapters(t), choice)
    return plan.join(choice.select("subject", "node_id"), ["subject", "node_id"], "left_semi").select("subject", "node_id", "action", "target")
