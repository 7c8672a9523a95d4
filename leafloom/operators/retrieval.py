"""Scoped BM25 over leaf paragraphs for batches of queries, and the blocks built from its hits.

The text is read once, into an index of term counts per paragraph; statistics, bounds and scores come from the index. The best k of a query are found
with upper bounds: a term adds at most its weight times the greatest saturation that it reaches in the scope. Ordered by that bound, the first terms
of a query give a first k paragraphs, whose whole scores give a threshold. Terms whose bounds, summed from the end of the order, stay below the threshold
cannot bring a paragraph into the first k. The last of them, the commonest words, are left out of the partial scores, and only paragraphs whose partial score and
the bounds of what is missing reach the threshold are scored in full: few more than k. The result is exact.

Tables: paragraphs ``(node_id, paragraph_id, page, text)``; queries ``(query_id, scope_key, text)`` where
``scope_key`` is ``all`` or the path of a subject, chapter or leaf.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import ordered
from leafloom.session import stored

ALL = "all"
MAX_BROADCAST_HITS = 200_000
SCORE_DIGITS = 6


def scope_key(scope: Column, subject: Column, node_id: Column) -> Column:
    """The path a query is limited to; a missing argument or an unknown scope fails the job."""
    return (
        F.when(scope == "all", F.lit(ALL))
        .when((scope == "subject") & (F.coalesce(subject, F.lit("")) != ""), subject)
        .when((scope == "node") & (F.coalesce(node_id, F.lit("")) != ""), node_id)
        .otherwise(F.raise_error(F.concat(F.lit("bad scope: "), F.coalesce(scope, F.lit("null")))).cast("string"))
    )


def under(node_id: Column, path: Column) -> Column:
    """True when the node is at or below the path, by whole segments."""
    return (node_id == path) | F.startswith(node_id, F.concat(path, F.lit("/")))


def scope_filter(rows: DataFrame, scope: str, subject: str | None = None, node_id: str | None = None) -> DataFrame:
    """Rows of one scope. With literal arguments the prefix test is pushed to the scan."""
    if scope == "all":
        return rows
    path = {"subject": subject, "node": node_id}.get(scope)
    if scope not in ("subject", "node"):
        raise ValueError(f"unknown scope: {scope!r}")
    if not path:
        raise ValueError(f"scope={scope!r} needs its argument")
    return rows.filter((F.col("node_id") == path) | F.col("node_id").startswith(path + "/"))


def visible_leaves(leaves: DataFrame, include_superseded: bool = False) -> DataFrame:
    return leaves if include_superseded else leaves.filter(F.col("superseded_by").isNull())


def leaf_paragraphs(leaves: DataFrame) -> DataFrame:
    """Paragraphs of leaf bodies, numbered from 0 within each leaf; source headings are left out.

    Needs ``node_id, body, sources`` and, for old rows, ``source_pages``.
    """
    pages = F.flatten(F.transform(F.coalesce("sources.pages", F.array().cast("array<array<int>>")), lambda p: F.coalesce(p, F.array().cast("array<int>"))))
    page = F.coalesce(F.try_element_at(pages, F.lit(1)), F.try_element_at("source_pages", F.lit(1)), F.lit(1))
    chunks = F.filter(
        F.transform(F.split("body", K.BLANK_LINE), T.strip),
        lambda c: (F.length(c) >= K.MIN_PARAGRAPH_CHARS) & ~c.startswith("## Source ") & ~c.startswith("# Source "),
    )
    kept = [c for c in leaves.columns if c not in ("body", "sources", "source_pages")]
    return leaves.select(*kept, page.alias("page"), F.posexplode(chunks).alias("paragraph_id", "text"))


def is_small(rows: DataFrame, limit: int = MAX_BROADCAST_HITS) -> bool:
    """One bounded count decides whether what derives from a query batch may be broadcast."""
    return rows.limit(limit + 1).count() <= limit


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def scope_members(paragraphs: DataFrame, scopes: DataFrame, small: bool) -> DataFrame:
    """Paragraphs of every asked-for scope: ancestor paths are exploded and matched by equality."""
    paths = F.concat(F.array(F.lit(ALL)), T.ancestor_paths(F.col("node_id")))
    wanted = _hint(scopes.select("scope_key").distinct(), small)
    return paragraphs.select("*", F.explode(paths).alias("scope_key")).join(wanted, "scope_key")


def term_index(paragraphs: DataFrame) -> DataFrame:
    """``(pid, node_id, paragraph_id, page, dl, terms)``: the distinct terms of each paragraph with their counts, as ``array<struct<term, tf>>``.

    Terms are sorted and counted by the length of their runs, within the row: no shuffle. ``pid`` is a short key of the row, fixed once the index is stored.
    """
    kept = [c for c in ("node_id", "paragraph_id", "page") if c in paragraphs.columns]
    rows = paragraphs.select(*kept, F.array_sort(T.tokens(F.col("text"))).alias("_tok"))
    start = F.transform("_tok", lambda x, i: F.when((i == 0) | (x != F.get("_tok", i - 1)), i))
    rows = rows.select(*kept, "_tok", F.size("_tok").alias("dl"), F.filter(start, lambda i: i.isNotNull()).alias("_at"))
    run = F.transform("_at", lambda at, i: F.struct(F.get("_tok", at).alias("term"), (F.coalesce(F.get("_at", i + 1), F.col("dl")) - at).alias("tf")))
    return rows.select(F.monotonically_increasing_id().alias("pid"), *kept, "dl", run.alias("terms"))


def scope_counts(index: DataFrame, scopes: DataFrame, small: bool) -> DataFrame:
    """Per scope and term: paragraphs that have it (``df``), its occurrences, greatest ``tf`` and least ``dl / tf``; the empty term has one row per
    scope with the number of paragraphs and their length.

    All are sums, minima and maxima that combine on the map side, so a frequent term or a large scope is not gathered.
    """
    members = scope_members(index.select("node_id", "dl", "terms"), scopes, small)
    # The empty term stands for the paragraph itself, so one pass counts terms, paragraphs and lengths.
    every = F.concat("terms", F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf"))))
    rows = members.select("scope_key", "dl", F.explode(every).alias("t")).select("scope_key", "dl", "t.term", "t.tf")
    return rows.groupBy("scope_key", "term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum("tf").alias("occurrences"),
        F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("length"),
        F.max("tf").alias("max_tf"),
        F.min(F.col("dl") / F.col("tf")).alias("least_dl"),
    )


def statistics(paragraphs: DataFrame, scopes: DataFrame, small: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Per scope: ``(scope_key, n, avgdl, avg_idf)``; per scope and term: ``(scope_key, term, df, idf)``."""
    small = is_small(scopes) if small is None else small
    scope_stats, term_stats = index_statistics(term_index(paragraphs), scopes, small)
    return scope_stats, term_stats.select("scope_key", "term", "df", "idf")


def index_statistics(index: DataFrame, scopes: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """The statistics from an index; terms also with ``max_tf`` and ``least_dl``."""
    # Written once, because three results read it.
    counted = stored(scope_counts(index, scopes, small), "term-counts")
    sizes = counted.filter(F.col("term") == "").select(
        "scope_key", F.col("df").alias("n"), (F.col("length") / F.col("df")).alias("avgdl")
    )
    raw = (
        counted.filter(F.col("term") != "")
        .join(_hint(sizes, small), "scope_key")
        .withColumn("_raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    )
    means = raw.groupBy("scope_key").agg(F.avg("_raw").alias("avg_idf"))
    scope_stats = sizes.join(_hint(means, small), "scope_key", "left")
    term_stats = raw.join(_hint(means, small), "scope_key").select(
        "scope_key",
        "term",
        "df",
        F.when(F.col("_raw") < 0, K.BM25_EPSILON * F.col("avg_idf")).otherwise(F.col("_raw")).alias("idf"),
        "max_tf",
        "least_dl",
    )
    return scope_stats, term_stats


def query_terms(queries: DataFrame) -> DataFrame:
    """Terms of each query with the times they are repeated."""
    return (
        queries.select("query_id", "scope_key", F.explode(T.tokens(F.col("text"))).alias("term"))
        .groupBy("query_id", "scope_key", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def saturation(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of weight 1 adds to a paragraph's score."""
    return tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avgdl))


def term_weights(index: DataFrame, queries: DataFrame, asked: DataFrame, names: DataFrame, small: bool) -> DataFrame:
    """``(q, scope_key, term, avgdl, df, weight, bound)``: no paragraph gets more than ``bound`` from the term."""
    scope_stats, term_stats = index_statistics(index, queries, small)
    # Saturation grows with tf and falls with dl / tf, so the extremes of both bound it; the margin covers rounding.
    most = (K.BM25_K1 + 1) / (1 + K.BM25_K1 * ((1 - K.BM25_B) / F.col("max_tf") + K.BM25_B * F.col("least_dl") / F.col("avgdl")))
    weight = F.col("qtf") * F.col("idf")
    return (
        term_stats.join(_hint(asked.join(_hint(names, small), "query_id"), small), ["scope_key", "term"])
        .join(_hint(scope_stats.select("scope_key", "avgdl"), small), "scope_key")
        .select("q", "scope_key", "term", "avgdl", "df", weight.alias("weight"), (F.greatest(weight, F.lit(0.0)) * most * (1 + 1e-9)).alias("bound"))
    )


def _met(index: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """``(pid, q, part)``: a row per paragraph, query of its scope and term of ``weights`` in it, with what the term adds.

    A paragraph is opened to the asked scopes that it is in, so that its terms meet exactly the queries of these scopes; a match by term alone would
    first pair them with the queries of all others.
    """
    members = scope_members(index.select("pid", "node_id", "dl", "terms"), weights, small)
    found = members.select("scope_key", "pid", "dl", F.explode("terms").alias("t")).select("scope_key", "pid", "dl", "t.term", "t.tf")
    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return found.join(_hint(weights, small), ["scope_key", "term"]).select("pid", "q", part.alias("part"))


PARAGRAPH = ["node_id", "paragraph_id", "page"]


def numbered(queries: DataFrame) -> DataFrame:
    """``(q, query_id)``: a short key for each query, stored."""
    return stored(queries.select("query_id").distinct().select(F.monotonically_increasing_id().alias("q"), "query_id"), "query-keys")


def scores(paragraphs: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, node_id, paragraph_id, page, score)`` for every paragraph with a positive score: nearly queries times paragraphs. Where only
    the best are asked for, `best_scores` gives them without the others."""
    index, asked, names = stored(term_index(paragraphs), "term-index"), query_terms(queries), numbered(queries)
    # Scopes, terms and weights have at most one row per query term, so this one count bounds them all.
    small = is_small(asked)
    weights = term_weights(index, queries, asked, names, small)
    if small:
        weights = stored(weights, "query-weights")
        sizes = weights.groupBy("scope_key").agg(F.count_distinct("term").alias("_t"), F.count_distinct("q").alias("_q"))
        if (sizes.agg(F.sum(F.col("_t") * F.col("_q"))).first()[0] or 0) <= MAX_CELLS:
            members = scope_members(index.select(*PARAGRAPH, "dl", "terms"), weights, small)
            schema = ", ".join(f"{c} {kind}" for c, kind in index.select(*PARAGRAPH).dtypes) + ", _hits array<struct<q: bigint, score: double>>"
            rows = members.mapInArrow(_whole_scores(weights), schema).select(*PARAGRAPH, F.explode("_hits").alias("_h"))
            total = rows.select(F.col("_h.q").alias("q"), *PARAGRAPH, F.round("_h.score", SCORE_DIGITS).alias("score")).filter(F.col("score") > 0)
            return total.join(_hint(names, small), "q").select("query_id", *PARAGRAPH, "score")
    total = _met(index, weights, small).groupBy("q", "pid").agg(F.round(F.sum("part"), SCORE_DIGITS).alias("score")).filter(F.col("score") > 0)
    return total.join(index.select("pid", *PARAGRAPH), "pid").join(_hint(names, small), "q").select("query_id", *PARAGRAPH, "score")


MAX_CELLS = 1 << 23  # of the matrices of weights, terms by queries of a scope, that every task holds
SUMMED, SENT = 64, 1024  # paragraphs summed and sent at a time


def _whole_scores(weights: DataFrame) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Scores of a paragraph by all queries of its scope, in the row of the paragraph: nothing is shuffled by paragraph and query.

    The weights, whose number is bounded, go to the tasks as a matrix of terms and queries per scope.
    """
    rows = weights.select("scope_key", "term", "q", "weight", "avgdl").toPandas()
    terms = sorted(rows["term"].unique())
    row_of = {t: i for i, t in enumerate(terms)}
    scopes = {}
    for scope, own in rows.groupby("scope_key"):
        queries, column = np.unique(own["q"].to_numpy(), return_inverse=True)
        used, row = np.unique(own["term"].map(row_of).to_numpy(), return_inverse=True)
        matrix, place = np.zeros((len(used), len(queries))), np.full(len(terms), -1)
        matrix[row, column] = own["weight"].to_numpy()
        place[used] = np.arange(len(used))
        scopes[scope] = (queries, place, matrix, float(own["avgdl"].iloc[0]))
    shared = weights.sparkSession.sparkContext.broadcast((terms, scopes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrices = shared.value
        words = pa.array(words, pa.string())
        for batch in batches:
            names = np.array(batch.column("scope_key").to_pylist(), object)
            for scope in set(names.tolist()):
                own = batch.take(pa.array(np.flatnonzero(names == scope)))
                for at in range(0, own.num_rows, SENT):
                    yield _scored(own.slice(at, SENT), words, *matrices[scope])

    return run


def _scored(rows: pa.RecordBatch, words: pa.Array, queries: np.ndarray, place: np.ndarray, matrix: np.ndarray, avgdl: float) -> pa.RecordBatch:
    lists = rows.column("terms")
    owner = np.repeat(np.arange(rows.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    known = pc.fill_null(pc.index_in(lists.flatten().field("term"), value_set=words), -1).to_numpy(zero_copy_only=False)
    row = np.where(known >= 0, place[known] if len(place) else -1, -1)
    has = np.flatnonzero(row >= 0)
    row, owner, tf = row[has], owner[has], lists.flatten().field("tf").to_numpy(zero_copy_only=False)[has].astype(float)
    dl = rows.column("dl").to_numpy(zero_copy_only=False)[owner]
    gain = tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avgdl))
    total = np.zeros((rows.num_rows, len(queries)))
    for at in range(0, rows.num_rows, SUMMED):
        a, b = np.searchsorted(owner, [at, at + SUMMED])
        if a < b:
            first = np.flatnonzero(np.diff(owner[a:b], prepend=-1))
            total[owner[a:b][first]] = np.add.reduceat(matrix[row[a:b]] * gain[a:b, None], first, axis=0)
    i, j = np.nonzero(total > 0)
    found = pa.StructArray.from_arrays([pa.array(queries[j]), pa.array(total[i, j])], names=["q", "score"])
    ends = np.searchsorted(i, np.arange(rows.num_rows + 1)).astype(np.int32)
    return pa.RecordBatch.from_arrays([*(rows.column(c) for c in PARAGRAPH), pa.ListArray.from_arrays(pa.array(ends), found)], names=[*PARAGRAPH, "_hits"])


def score_of(index: DataFrame, pairs: DataFrame, weights: DataFrame, few: bool, small: bool) -> DataFrame:
    """``(q, node_id, paragraph_id, page, score)``: whole scores of the paragraphs ``(q, pid)`` listed, where positive."""
    rows = index.join(_hint(pairs.select("q", "pid"), few), "pid")
    rows = rows.select("q", *PARAGRAPH, "dl", F.explode("terms").alias("t")).select("q", *PARAGRAPH, "dl", "t.term", "t.tf")
    part = F.col("weight") * saturation(F.col("tf"), F.col("dl"), F.col("avgdl"))
    total = rows.join(_hint(weights, small), ["q", "term"]).groupBy("q", *PARAGRAPH).agg(F.round(F.sum(part), SCORE_DIGITS).alias("score"))
    return total.filter(F.col("score") > 0)


def top_hits(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best paragraphs per query; equal scores in path and paragraph order."""
    order = [F.col("score").desc(), F.col("node_id"), F.col("paragraph_id")]
    return ordered.best_per_key(scored, ["query_id"], order, keep=k, out="rank")


UNSEEN = 0.3  # share of the threshold that terms which are not looked at may reach together
PROBE = 256  # postings per asked-for hit that the first look at a query's terms may take


def candidates(index: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """``(q, pid)`` of every paragraph that can be among the best ``k`` of its query; the weights; the queries' keys; whether these are few."""
    asked, names = query_terms(queries), numbered(queries)
    small = is_small(asked)
    weights = term_weights(index, queries, asked, names, small)
    # Terms by falling bound: what a paragraph without the terms before can still reach, and postings up to here. One query's terms come from one row.
    by_bound = Window.partitionBy("q").orderBy(F.col("bound").desc(), "term")
    weights = stored(
        weights.withColumn("rest", F.sum("bound").over(by_bound.rowsBetween(0, Window.unboundedFollowing))).withColumn(
            "before", F.coalesce(F.sum("df").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ),
        "query-terms",
    )
    first = _met(index, weights.filter(F.col("before") < PROBE * k), small).groupBy("q", "pid").agg(F.sum("part").alias("score"))
    least = _thresholds(index, names, first, weights, k, small)
    bounded = weights.join(_hint(least, small), "q")
    # Looked at are the terms down to a share of the threshold; what the others can add is then small, and few partial scores come near it.
    cut = UNSEEN * F.col("least")
    needed = bounded.filter(F.col("least").isNull() | (F.col("rest") >= cut))
    left = bounded.groupBy("q").agg(F.coalesce(F.max(F.when(F.col("rest") < cut, F.col("rest"))), F.lit(0.0)).alias("left"), F.first("least").alias("least"))
    partial = _met(index, needed.select(*weights.columns), small).groupBy("q", "pid").agg(F.sum("part").alias("score"))
    reach = F.col("least").isNull() | (F.col("score") + F.col("left") >= F.col("least"))
    found = stored(partial.join(_hint(left, small), "q").filter(reach).select("q", "pid", "score", "left"), "reached")
    # Partial scores are nearly whole now, so their best give a threshold close to the last score that counts.
    least = _thresholds(index, names, found, weights, k, small)
    kept = found.join(_hint(least, small), "q").filter(F.col("least").isNull() | (F.col("score") + F.col("left") >= F.col("least")))
    return stored(kept.select("q", "pid"), "candidates"), weights, names, small


def _thresholds(index: DataFrame, names: DataFrame, partial: DataFrame, weights: DataFrame, k: int, small: bool) -> DataFrame:
    """``(q, least)``: what a paragraph must reach to be among the best ``k``, from the whole scores of the best by partial score; null where fewer than ``k``
    of them score."""
    chosen = stored(ordered.best_per_key(partial.select("q", "pid", "score"), ["q"], [F.col("score").desc(), F.col("pid")], keep=k, out="rank"), "chosen")
    whole = score_of(index, chosen, weights, is_small(chosen), small)
    reached = whole.groupBy("q").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least")).filter(F.col("_n") == k)
    # Scores that are equal after rounding count as equal, so a paragraph is out only if it stays below by more than that.
    least = reached.select("q", (F.col("_least") - 10.0**-SCORE_DIGITS).alias("least"))
    return stored(names.select("q").join(least, "q", "left"), "thresholds")


def best_scores(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, node_id, paragraph_id, page, score)``: the best ``k`` of every query, exactly. ``index`` is a stored `term_index`."""
    pairs, weights, names, small = candidates(index, queries, k)
    scored = score_of(index, pairs, weights, is_small(pairs), small).join(_hint(names, small), "q")
    return top_hits(scored.select("query_id", *PARAGRAPH, "score"), k)


def search(paragraphs: DataFrame, queries: DataFrame, k: int = K.CHAT_TOP_K, index: DataFrame | None = None) -> DataFrame:
    """Hits with snippets. Texts are fetched for the hits only, without moving the paragraph table
    when the hits are few enough to broadcast. ``index``: a stored `term_index` of the paragraphs, for further batches of queries."""
    hits = best_scores(stored(term_index(paragraphs), "term-index") if index is None else index, queries, k)
    few = is_small(queries, MAX_BROADCAST_HITS // k)
    texts = paragraphs.select("node_id", "paragraph_id", T.snippet(F.col("text")).alias("snippet"))
    return texts.join(_hint(hits, few), ["node_id", "paragraph_id"])


def search_leaves(leaves: DataFrame, queries: DataFrame, k: int = K.CHAT_TOP_K, include_superseded: bool = False) -> DataFrame:
    """`search` in the bodies of leaves. Superseded ones are neither found nor counted in the statistics, unless asked for."""
    return search(leaf_paragraphs(visible_leaves(leaves, include_superseded)), queries, k)


def citation_index(hits: DataFrame, turn: str, step: str, rank: str) -> DataFrame:
    """1-based number of each hit, running on through the lookups of a turn.

    A turn has a bounded number of lookups of bounded size.
    """
    w = Window.partitionBy(turn).orderBy(step, rank)
    return hits.withColumn("citation", F.row_number().over(w))


def _lines(hits: DataFrame, line: Column) -> DataFrame:
    """Rank-ordered lines per query; at most k lines each."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("_body"))


def sources_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered sources of each query under the node title, or a line that says there are none."""
    line = F.format_string("[%d] (page %d) %s", "rank", "page", "snippet")
    head = F.concat(F.lit("# Source paragraphs (selected node: "), F.col("node_title"), F.lit(")\n"))
    none = F.lit("(no sources retrieved for this question)")
    return queries.join(_lines(hits, line), "query_id", "left").select(
        "query_id", F.concat(head, F.coalesce("_body", none)).alias("context")
    )


def tool_result(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Lookup result as the agent sees it: path, page and snippet, never a publisher."""
    trail = T.node_trail(F.col("node_id"))
    line = F.format_string("[%d] path='%s' page=%d\n    %s", F.col("rank"), trail, F.col("page"), F.col("snippet"))
    head = F.concat(F.lit(K.TOOL_RESULT_PREFIX + ", scope="), F.col("scope"), F.lit(")\n"))
    return queries.join(_lines(hits, line), "query_id", "left").select(
        "query_id", F.concat(head, F.coalesce("_body", F.lit("(no hits)"))).alias("content")
    )
