"""Conversation operators: context clearing and compaction, agent steps, citations, quality reports.

Messages ``(conv_id, turn, role, text)``. Totals of a conversation are aggregates joined back, and counts from
its end are block-wise running sums, so that one very long conversation is spread like any other data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import ordered
from leafloom.session import cut_lineage

CONV = "conv_id"


def _with_totals(rows: DataFrame, **totals: Column) -> DataFrame:
    """Adds aggregates of the conversation to its messages."""
    return rows.join(rows.groupBy(CONV).agg(*[c.alias(n) for n, c in totals.items()]), CONV)


def _later(rows: DataFrame, flag: Column, out: str) -> DataFrame:
    """Adds how many later messages of the conversation the flag holds for."""
    rows = rows.withColumn("_back", -F.col("turn"))
    return ordered.prefix_sum(rows, [CONV], "_back", flag.cast("int"), out).drop("_back")


def _tokens() -> Column:
    return F.floor(F.sum(F.length("text")) / K.CHARS_PER_TOKEN).cast("bigint")


def is_tool_result() -> Column:
    return (F.col("role") == "user") & F.startswith(F.col("text"), F.lit(K.TOOL_RESULT_PREFIX))


def history_roles(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin("user", "assistant"))


def token_estimate(messages: DataFrame) -> DataFrame:
    return messages.groupBy(CONV).agg(_tokens().alias("tokens"))


def clear_old_tool_results(messages: DataFrame, keep: int = K.KEEP_TOOL_RESULTS, is_result: Column | None = None, when: Column | None = None) -> DataFrame:
    """Replaces all but the last ``keep`` tool results by a placeholder; adds ``cleared``."""
    hit = is_tool_result() if is_result is None else is_result
    rows = _later(messages.withColumn("_hit", F.coalesce(hit, F.lit(False))), F.col("_hit"), "_newer")
    gone = F.col("_hit") & (F.col("_newer") >= keep)
    if when is not None:
        gone = gone & when
    rows = rows.withColumn("cleared", gone)
    text = F.when(F.col("cleared"), K.CLEARED_PLACEHOLDER).otherwise(F.col("text"))
    return rows.withColumn("text", text).drop("_hit", "_newer")


def compaction_plan(messages: DataFrame, keep_turns: int = K.KEEP_USER_TURNS) -> DataFrame:
    """Labels each message head, middle or tail; ``compacts`` is false where nothing would be gained.

    Head is a leading system message. The tail starts at the ``keep_turns``-th user message from the end.
    """
    rows = _with_totals(messages, _n=F.count(F.lit(1)), _first=F.min("turn"))
    rows = rows.withColumn("_head", (F.col("turn") == F.col("_first")) & (F.col("role") == "system"))
    rows = cut_lineage(_later(cut_lineage(rows), F.col("role") == "user", "_users"))
    part = F.when(F.col("_head"), "head").when(F.col("_users") < keep_turns, "tail").otherwise("middle")
    rows = _with_totals(rows.withColumn("part", part), _middle=F.count_if(F.col("part") == "middle"))
    compacts = (F.col("_n") > 1 + 2 * keep_turns) & (F.col("_middle") > 0)
    return rows.withColumn("compacts", compacts).drop("_head", "_n", "_first", "_users", "_middle")


def apply_compaction(planned: DataFrame, summaries: DataFrame) -> DataFrame:
    """Head, one summary message, tail, renumbered. Conversations that do not compact, or without a
    summary, stay as they are."""
    summary = F.coalesce(T.summary_block(F.col("summary")), T.strip(F.col("summary")))
    text = F.concat(F.lit("<conversation_so_far>\n"), summary, F.lit("\n</conversation_so_far>"))
    rows = cut_lineage(planned.join(summaries.select(CONV, "summary"), CONV, "left"))
    active = F.col("compacts") & F.col("summary").isNotNull()
    kept = rows.filter(~active | (F.col("part") != "middle")).select(CONV, "turn", "role", "text")
    # The summary takes the place of the first middle message.
    starts = rows.filter(active & (F.col("part") == "middle")).groupBy(CONV).agg(F.min("turn").alias("turn"), F.first("summary").alias("summary"))
    made = starts.select(CONV, "turn", F.lit("system").alias("role"), text.alias("text"))
    whole = ordered.ordinal(cut_lineage(kept.unionByName(made)), [CONV], "turn", "_place")
    return whole.withColumn("turn", F.col("_place").cast("int")).drop("_place")


def manage_context(
    messages: DataFrame,
    summaries: DataFrame,
    clear_tokens: int = K.CLEAR_TOKENS,
    compact_tokens: int = K.COMPACT_TOKENS,
    keep_results: int = K.KEEP_TOOL_RESULTS,
    is_result: Column | None = None,
) -> DataFrame:
    """Clears old tool results from the first threshold on; compacts what is still over the second."""
    # Totals and running counts read their input twice, so it is written before each of them.
    sized = cut_lineage(_with_totals(cut_lineage(messages), _size=_tokens()))
    cleared = clear_old_tool_results(sized, keep_results, is_result, when=F.col("_size") >= clear_tokens)
    planned = _with_totals(cut_lineage(compaction_plan(cut_lineage(cleared.drop("_size", "cleared")))), _size=_tokens())
    planned = planned.withColumn("compacts", F.col("compacts") & (F.col("_size") >= compact_tokens))
    return apply_compaction(planned.drop("_size"), summaries)


def last_user_turn(messages: DataFrame) -> DataFrame:
    """Marks the question (last user message); the other messages are its history. Conversations
    without a user message drop out."""
    rows = _with_totals(messages, _last=F.max(F.when(F.col("role") == "user", F.col("turn"))))
    return rows.filter(F.col("_last").isNotNull()).withColumn("is_question", F.col("turn") == F.col("_last")).drop("_last")


def duplicate_query_guard(lookups: DataFrame) -> DataFrame:
    """Marks lookups of a turn whose keyword set was searched before; an empty set is never blocked."""
    rows = lookups.withColumn("query_key", T.query_key(F.col("query")))
    first = rows.groupBy("turn_id", "query_key").agg(F.min("step").alias("_first"))
    rows = rows.join(first, ["turn_id", "query_key"])
    return rows.withColumn("blocked", (F.col("query_key") != "") & (F.col("step") > F.col("_first"))).drop("_first")


def step_budget(steps: DataFrame, max_steps: int = K.MAX_STEPS) -> DataFrame:
    """Answer of each turn: the first answer within the budget, else the fallback."""
    inside = (F.col("step") <= max_steps) & (F.col("action") == "answer")
    rows = steps.groupBy("turn_id").agg(
        F.min_by(F.when(inside, F.struct("text")), F.when(inside, F.col("step"))).alias("_a"), F.min(F.when(inside, F.col("step"))).alias("answered_at")
    )
    text = F.coalesce(F.nullif(F.col("_a.text"), F.lit("")), F.lit("(no answer text)"))
    return rows.select("turn_id", "answered_at", F.when(F.col("answered_at").isNull(), K.NO_ANSWER_FALLBACK).otherwise(text).alias("answer"))


def citation_markers(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """``[N]`` markers of each answer, resolved to the turn's citations; unresolved ones are invented."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1))).cast("array<int>")
    marks = answers.select("turn_id", F.explode(numbers).alias("number"))
    return marks.join(citations.select("turn_id", "number", "payload"), ["turn_id", "number"], "left").withColumn(
        "resolved", F.col("payload").isNotNull()
    )


def patch_tool_calls(events: DataFrame) -> DataFrame:
    """Tool calls with the hit count and scope label of the result that bears the same id."""
    call = events.filter(F.col("type") == "tool-call").select("turn_id", "id", "seq", F.col("payload").alias("query"))
    result = (
        events.filter(F.col("type") == "tool-result")
        .groupBy("turn_id", "id")
        .agg(F.max_by(F.struct("number", "payload"), "seq").alias("_r"))
        .select("turn_id", "id", F.col("_r.number").alias("hit_count"), F.col("_r.payload").alias("scope_label"))
    )
    return call.join(result, ["turn_id", "id"], "left")


def first_token_latency(events: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(c)
    start = F.min(micros("ts"))
    token = F.min(F.when(F.col("type") == "text-delta", micros("ts")))
    return events.groupBy("turn_id").agg(
        ((token - start) / 1e6).alias("first_token_s"), ((F.max(micros("ts")) - start) / 1e6).alias("total_s")
    )


def brand_hits(text: Column) -> Column:
    """Brand names that occur in a text, by exact case."""
    names = F.array(*[F.lit(b) for b in K.BRAND_TOKENS])
    return F.filter(names, lambda b: F.contains(text, b))


def brand_audit(rows: DataFrame, table: str, text: str) -> DataFrame:
    hits = rows.select(F.lit(table).alias("table"), F.explode_outer(brand_hits(F.col(text))).alias("brand"))
    return hits.filter(F.col("brand").isNotNull()).groupBy("table", "brand").agg(F.count(F.lit(1)).alias("rows"))


def chat_quality(events: DataFrame) -> DataFrame:
    """One row: share of turns with tool calls, with citations, without brand names; latencies; errors."""
    shown = F.col("type").isin("text-delta", "data-citation")
    parts = F.array_sort(F.collect_list(F.when(shown, F.struct("seq", "payload"))))
    said = F.array_join(F.transform(parts, lambda p: p["payload"]), "")
    per_turn = events.groupBy("turn_id").agg(
        F.max(F.col("type") == "tool-call").alias("tool"),
        F.max(F.col("type") == "data-citation").alias("cited"),
        F.max(F.col("type") == "finish").alias("finished"),
        (F.size(brand_hits(said)) == 0).alias("clean"),
    )
    rows = per_turn.join(first_token_latency(events), "turn_id")
    n = F.count(F.lit(1))

    def share(flag: str) -> Column:
        k = F.count_if(flag)
        percent = F.concat(k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("), F.floor(100 * k / n).cast("string"), F.lit("%)"))
        return F.when(n == 0, F.lit("n/a")).otherwise(percent)

    return rows.agg(
        share("tool").alias("tool_call_rate"),
        share("cited").alias("citation_rate"),
        share("clean").alias("brand_clean_rate"),
        F.count_if(~F.col("finished")).alias("errors"),
        F.round(F.avg("first_token_s"), 3).alias("mean_first_token_s"),
        F.round(F.avg("total_s"), 3).alias("mean_total_s"),
    )


def fold_turns(events: DataFrame) -> DataFrame:
    """Each turn as one row: text, tool calls with their results, citations, status."""
    piece = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("seq", "id", "payload", "number"))))
    rows = events.groupBy("turn_id").agg(
        piece("text-delta").alias("_d"), piece("tool-call").alias("_c"), piece("tool-result").alias("_r"), piece("data-citation").alias("_z"),
        F.max(F.col("type") == "finish").alias("_done"),
    )

    def patched(call: Column) -> Column:
        results = F.filter("_r", lambda r: r["id"] == call["id"])
        last = F.try_element_at(results, F.lit(-1))
        return F.struct(call["id"].alias("id"), call["payload"].alias("query"), last["number"].alias("hit_count"), last["payload"].alias("scope_label"))

    return rows.select(
        "turn_id",
        F.array_join(F.transform("_d", lambda d: d["payload"]), "").alias("text"),
        F.transform("_c", patched).alias("tool_calls"),
        F.transform("_z", lambda c: F.struct(c["number"].alias("index"), c["payload"].alias("node"))).alias("citations"),
        F.when(F.col("_done"), "complete").otherwise("streaming").alias("status"),
    )
