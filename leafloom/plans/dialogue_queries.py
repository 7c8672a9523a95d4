"""Conversation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.functions.model_json import extract_json_object, parse_decision
from leafloom.operators import dialogue as D
from leafloom.plans import fixtures as fx
from leafloom.plans.fixtures import sql_text
from leafloom.plans.registry import block, query
from leafloom.session import Tables

# Thresholds small enough for the test conversations.
CLEAR, COMPACT, KEEP = 200, 300, 1


def result_flag():
    return F.col("role") == "assistant"


@query("history_role_filter", "SELECT conv_id, turn, role FROM fx_message WHERE role IN ('user', 'assistant')", ("fx_message",))
def _(t):
    return D.history_roles(fx.messages(t)).select("conv_id", "turn", "role")


@query("token_estimate", "SELECT conv_id, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM fx_message GROUP BY conv_id", ("fx_message",))
def _(t):
    return D.token_estimate(fx.messages(t))


_PLACEHOLDER = sql_text(K.CLEARED_PLACEHOLDER)


@query(
    "clear_old_tool_results",
    f"""
SELECT conv_id, turn, role, role = 'assistant' AND newer > 1 AS cleared, CASE WHEN role = 'assistant' AND newer > 1 THEN {_PLACEHOLDER} ELSE text END AS text
FROM (SELECT *, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS newer FROM fx_message)""",
    ("fx_message",),
)
def _(t):
    return D.clear_old_tool_results(fx.messages(t), KEEP, result_flag())


def _plan_sql(source: str) -> str:
    return f"""
SELECT *, n > 5 AND count(*) FILTER (part = 'middle') OVER (PARTITION BY conv_id) > 0 AS compacts FROM (
  SELECT conv_id, turn, role, text, n, CASE WHEN is_head THEN 'head' WHEN coalesce(later, 0) < 2 THEN 'tail' ELSE 'middle' END AS part FROM (
    SELECT *, sum(CASE WHEN role = 'user' AND NOT is_head THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS later FROM (
      SELECT *, role = 'system' AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS is_head, count(*) OVER (PARTITION BY conv_id) AS n FROM {source})))"""


block("planned", _plan_sql("fx_message"), "fx_message")


@query("compaction_plan", "SELECT conv_id, turn, part, compacts FROM planned", ("planned",))
def _(t):
    return D.compaction_plan(fx.messages(t)).select("conv_id", "turn", "part", "compacts")


def summaries(t: Tables) -> DataFrame:
    """Stand-in for a summariser: a note on the size of the conversation, tagged for some of them."""
    n = F.count(F.lit(1)).cast("string")
    note = F.when(F.max("turn") > 4, F.concat(F.lit("Sure. <summary> had "), n, F.lit(" messages </summary> done"))).otherwise(
        F.concat(F.lit(" had "), n, F.lit(" messages "))
    )
    return fx.messages(t).groupBy("conv_id").agg(note.alias("summary"))


block(
    "summary",
    """
SELECT conv_id, CASE WHEN max(turn) > 4 THEN 'Sure. <summary> had ' || count(*) || ' messages </summary> done' ELSE ' had ' || count(*) || ' messages ' END AS summary
FROM fx_message GROUP BY conv_id""",
    "fx_message",
)


@query(
    "summary_block",
    "SELECT conv_id, trim(nullif(regexp_extract(summary, '(?is)<summary>(.*?)</summary>', 1), '')) AS block FROM summary",
    ("summary",),
)
def _(t):
    return summaries(t).select("conv_id", T.summary_block(F.col("summary")).alias("block"))


block(
    "cleared",
    f"""
SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND newer > 1 AND tokens >= {CLEAR} THEN {_PLACEHOLDER} ELSE text END AS text
FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) // 4 AS tokens,
      sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS newer FROM fx_message)""",
    "fx_message",
)
block("cleared_size", "SELECT *, sum(length(text)) OVER (PARTITION BY conv_id) // 4 AS left_tokens FROM cleared", "cleared")
block("cleared_plan", _plan_sql("cleared"), "cleared")


block("big", f"SELECT conv_id, sum(length(text)) // 4 >= {COMPACT} AS is_big FROM cleared GROUP BY conv_id", "cleared")


@query(
    "apply_compaction",
    """
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn, role, text FROM (
  SELECT p.conv_id, p.turn, p.role, p.text FROM cleared_plan p JOIN big USING (conv_id) WHERE NOT (compacts AND is_big) OR part <> 'middle'
  UNION ALL
  SELECT p.conv_id, min(p.turn), 'system', '<conversation_so_far>' || chr(10) || trim(coalesce(nullif(regexp_extract(any_value(s.summary), '(?is)<summary>(.*?)</summary>', 1), ''), any_value(s.summary))) || chr(10) || '</conversation_so_far>'
  FROM cleared_plan p JOIN big USING (conv_id) JOIN summary s USING (conv_id) WHERE compacts AND is_big AND part = 'middle' GROUP BY p.conv_id)""",
    ("cleared_plan", "summary", "big"),
)
def _(t):
    return D.manage_context(fx.messages(t), summaries(t), CLEAR, COMPACT, KEEP, result_flag())


@query(
    "last_user_turn",
    """
SELECT conv_id, turn, role, turn = last AS is_question FROM (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM fx_message) WHERE last IS NOT NULL""",
    ("fx_message",),
)
def _(t):
    return D.last_user_turn(fx.messages(t)).select("conv_id", "turn", "role", "is_question")


def lookups(t: Tables) -> DataFrame:
    """Each message of a conversation as a lookup step, each asked twice in reversed word order."""
    said = fx.messages(t).select(F.col("conv_id").alias("turn_id"), (F.col("turn") * 2).alias("step"), F.col("text").alias("query"))
    again = said.withColumn("step", F.col("step") + 1).withColumn("query", F.array_join(F.reverse(F.split("query", " ")), " "))
    return said.unionByName(again)


@query(
    "duplicate_query_guard",
    """
SELECT turn_id, step, k <> '' AND row_number() OVER (PARTITION BY turn_id, k ORDER BY step) > 1 AS blocked FROM (
  SELECT turn_id, step, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) > 2))), ' ') AS k FROM (
    SELECT conv_id AS turn_id, CAST(turn * 2 AS INTEGER) AS step, text AS q FROM fx_message
    UNION ALL SELECT conv_id, CAST(turn * 2 + 1 AS INTEGER), array_to_string(list_reverse(string_split(text, ' ')), ' ') FROM fx_message))""",
    ("fx_message",),
)
def _(t):
    return D.duplicate_query_guard(lookups(t)).select("turn_id", "step", "blocked")


@query(
    "step_budget",
    f"""
SELECT conv_id AS turn_id, min(turn) FILTER (role = 'assistant' AND turn <= 2) AS answered_at,
       coalesce(arg_min(text, turn) FILTER (role = 'assistant' AND turn <= 2), {sql_text(K.NO_ANSWER_FALLBACK)}) AS answer
FROM fx_message GROUP BY conv_id""",
    ("fx_message",),
)
def _(t):
    action = F.when(F.col("role") == "assistant", "answer").otherwise("lookup")
    steps = fx.messages(t).select(F.col("conv_id").alias("turn_id"), F.col("turn").alias("step"), action.alias("action"), "text")
    return D.step_budget(steps, 2)


@query(
    "parse_decision",
    """
SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL WHEN role = 'user' THEN 'lookup' ELSE 'answer' END AS action,
       CASE WHEN role = 'user' THEN replace(text, chr(10), ' ') END AS query, CASE WHEN role = 'assistant' THEN replace(text, chr(10), ' ') END AS text
FROM fx_message""",
    ("fx_message",),
)
def _(t):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    lookup = F.to_json(F.struct(F.lit("lookup").alias("action"), flat.alias("query")))
    answer = F.to_json(F.struct(F.lit("answer").alias("action"), flat.alias("text")))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("I will search. <|tool_call|>"), lookup, F.lit("<|/tool_call|>")))
        .when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), answer, F.lit("\n```")))
        .otherwise("not json at all")
    )
    rows = fx.messages(t).select("conv_id", "turn", parse_decision(raw).alias("d"))
    return rows.select("conv_id", "turn", "d.action", "d.query", "d.text")


@query(
    "extract_json_object",
    """
SELECT conv_id, turn, CASE role WHEN 'user' THEN length(text) WHEN 'assistant' THEN length(text) END AS chars,
       CASE WHEN role = 'system' THEN 'no object' END AS error FROM fx_message""",
    ("fx_message",),
)
def _(t):
    body = F.to_json(F.struct(F.col("text")))
    raw = (
        F.when(F.col("role") == "user", F.concat(F.lit("Here it is: "), body, F.lit(" Bye.")))
        .when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .otherwise(F.lit("nothing here"))
    )
    rows = fx.messages(t).select("conv_id", "turn", extract_json_object(raw).alias("x"))
    return rows.select("conv_id", "turn", F.length(F.get_json_object("x.json", "$.text")).cast("bigint").alias("chars"), "x.error")


def marked_answers(t: Tables) -> DataFrame:
    end = F.concat(F.lit(" [1] and [2] but [7], again [1]"))
    text = F.concat("text", end)
    return fx.messages(t).filter("role = 'assistant'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("turn_id"), text.alias("text"))


@query(
    "citation_markers",
    """
SELECT m.turn_id, CAST(m.n AS INTEGER) AS number, e.payload, e.payload IS NOT NULL AS resolved
FROM (SELECT conv_id || '-' || turn AS turn_id, unnest([1, 2, 7]) AS n FROM fx_message WHERE role = 'assistant') m
LEFT JOIN fx_agent_event e ON e.turn_id = m.turn_id AND e.type = 'data-citation' AND e.number = m.n""",
    ("fx_message", "fx_agent_event"),
)
def _(t):
    return D.citation_markers(marked_answers(t), fx.agent_events(t).filter("type = 'data-citation'"))


@query(
    "tool_result_patch",
    """
SELECT c.turn_id, c.id, c.seq, c.payload AS query, r.number AS hit_count, r.payload AS scope_label
FROM fx_agent_event c LEFT JOIN fx_agent_event r ON r.turn_id = c.turn_id AND r.id = c.id AND r.type = 'tool-result' WHERE c.type = 'tool-call'""",
    ("fx_agent_event",),
)
def _(t):
    return D.patch_tool_calls(fx.agent_events(t))


block(
    "latency",
    """
SELECT turn_id, (min(epoch_us(ts)) FILTER (type = 'text-delta') - min(epoch_us(ts))) / 1e6 AS first_token_s, (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS total_s
FROM fx_agent_event GROUP BY turn_id""",
    "fx_agent_event",
)


@query("first_token_latency", "SELECT turn_id, first_token_s, total_s FROM latency", ("latency",))
def _(t):
    return D.first_token_latency(fx.agent_events(t))


@query(
    "chat_eval_summary",
    """
SELECT count(*) || '/' || count(*) || ' (100%)' AS tool_call_rate,
       count(*) FILTER (conv_id % 4 > 0) || '/' || count(*) || ' (' || (100 * count(*) FILTER (conv_id % 4 > 0) // count(*)) || '%)' AS citation_rate,
       count(*) || '/' || count(*) || ' (100%)' AS brand_clean_rate, count(*) FILTER (conv_id % 9 = 8) AS errors,
       (SELECT round(avg(first_token_s), 3) FROM latency) AS mean_first_token_s, (SELECT round(avg(total_s), 3) FROM latency) AS mean_total_s
FROM fx_message WHERE role = 'assistant'""",
    ("latency", "fx_message"),
)
def _(t):
    return D.chat_quality(fx.agent_events(t))


_BRANDS = ", ".join(f"'{b}'" for b in K.BRAND_TOKENS)


@query(
    "brand_audit",
    f"SELECT 'pages' AS \"table\", brand, count(*) AS rows FROM fx_dirty_page, (SELECT unnest([{_BRANDS}]) AS brand) WHERE contains(text, brand) GROUP BY brand",
    ("fx_dirty_page",),
)
def _(t):
    return D.brand_audit(fx.dirty_pages(t), "pages", "text")


block(
    "folded",
    """
SELECT turn_id, md5(coalesce(string_agg(payload, '' ORDER BY seq) FILTER (type = 'text-delta'), '')) AS text_md5,
       coalesce(string_agg(payload, '|' ORDER BY seq) FILTER (type = 'tool-call'), '') AS queries,
       coalesce(string_agg(number || ':' || payload, '|' ORDER BY seq) FILTER (type = 'tool-result'), '') AS results,
       coalesce(string_agg(number || ':' || payload, '|' ORDER BY seq) FILTER (type = 'data-citation'), '') AS citations,
       CASE WHEN bool_or(type = 'finish') THEN 'complete' ELSE 'streaming' END AS status
FROM fx_agent_event GROUP BY turn_id""",
    "fx_agent_event",
)


def show_fold(rows: DataFrame) -> DataFrame:
    """Folded turns in flat columns for comparison."""
    pair = lambda a, b: F.concat(a.cast("string"), F.lit(":"), b)
    answered = F.filter("tool_calls", lambda c: c["hit_count"].isNotNull())
    return rows.select(
        "turn_id",
        F.md5("text").alias("text_md5"),
        F.array_join(F.transform("tool_calls", lambda c: c["query"]), "|").alias("queries"),
        F.array_join(F.transform(answered, lambda c: pair(c["hit_count"], c["scope_label"])), "|").alias("results"),
        F.array_join(F.transform("citations", lambda c: pair(c["index"], c["node"])), "|").alias("citations"),
        "status",
    )


@query("fold_agent_turn", "SELECT turn_id, text_md5, queries, results, citations, status FROM folded", ("folded",))
def _(t):
    return show_fold(D.fold_turns(fx.agent_events(t)))
