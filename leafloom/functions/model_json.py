"""JSON found in model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions.text import let, strip


def _valid(text: Column) -> Column:
    """Whether a text is one JSON value. Inside brackets, so that anything behind the value makes the list longer or broken."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.coalesce(one, F.lit(False)) & (text != "")


def _unfenced(reply: Column) -> Column:
    body = strip(reply)
    return F.when(body.rlike(K.FENCE_PATTERN), strip(F.regexp_extract(body, K.FENCE_PATTERN, 1))).otherwise(body)


def _balanced(text: Column) -> Column:
    """Length of the shortest beginning of a text that closes as many braces as it opens; null if there is none.

    The text is cut behind each brace, and the cuts carry their running depth.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

    def further(state: Column, part: Column) -> Column:
        depth = state["depth"] + part.endswith("{").cast("int") - part.endswith("}").cast("int")
        step = F.struct(depth.alias("depth"), (state["size"] + F.length(part)).alias("size"), (part.endswith("}") & (depth == 0)).alias("closed"))
        return F.when(state["closed"], state).otherwise(step)

    return F.aggregate(F.split(text, "(?<=[{}])"), start, further, lambda state: F.when(state["closed"], state["size"]))


def extract_json_object(reply: Column | str) -> Column:
    """Struct of the JSON of a reply that may be fenced or wrapped in prose, else the reason there is none."""
    reply = F.col(reply) if isinstance(reply, str) else reply

    def result(json: Column, error: str | None) -> Column:
        return F.struct(json.cast("string").alias("json"), F.lit(error).cast("string").alias("error"))

    def inside(body: Column) -> Column:
        rest = F.substr(body, F.instr(body, "{"))
        found = let(rest, lambda r: F.substr(r, F.lit(1), _balanced(r)))
        cut = let(found, lambda f: F.when(f.isNull(), result(F.lit(None), "unbalanced")).when(_valid(f), result(f, None)).otherwise(result(F.lit(None), "invalid")))
        return F.when(_valid(body), result(body, None)).when(F.instr(body, "{") == 0, result(F.lit(None), "no object")).otherwise(cut)

    return F.when(F.coalesce(reply, F.lit("")) == "", result(F.lit(None), "empty")).otherwise(let(_unfenced(reply), inside))


DECISION_TYPE = "action string, query string, scope string, book_slug string, node_id string, text string"


def _decision(text: Column) -> Column:
    parsed = F.from_json(text, DECISION_TYPE, {"mode": "PERMISSIVE"})
    ok = parsed["action"].isin("lookup", "answer") & (
        parsed["scope"].isNull() | parsed["scope"].isin("all", "subject", "node")
    )
    return F.when(ok, parsed)


def parse_decision(reply: Column) -> Column:
    """The agent's decision as a struct: plain JSON, fenced JSON or an inline tool tag; null otherwise."""
    fenced = _unfenced(reply)
    tag = F.regexp_extract(reply, K.INLINE_TOOL_PATTERN, 1)
    return F.coalesce(_decision(fenced), _decision(tag))
