import math
import re

import pytest
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import questions as Q
from leafloom.operators import retrieval as R

PARAS = [
    ("geo/01-hills/01-peaks", 0, 4, "The tallest peak of the old range stands near the southern plateau."),
    ("geo/01-hills/01-peaks", 1, 4, "Granite and quartz make up most of the old range."),
    ("geo/01-hills/02-forts", 0, 7, "Forts were built on the hills to guard the passes."),
    ("geo/02-rivers/01-lakes", 0, 9, "Salt lakes form where rivers do not reach the sea."),
    ("geo/02-riversides/01-ghats", 0, 9, "Stone steps lead down to rivers in many towns."),
    ("law/01-acts/01-water", 0, 2, "The water act names who may draw from rivers and lakes."),
]
SCHEMA = "node_id string, paragraph_id int, page int, text string"


def okapi(corpus, query):
    docs = [re.findall("[a-z0-9]+", t.lower()) for t in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {w: (v if v >= 0 else floor) for w, v in raw.items()}
    out = []
    for d in docs:
        s = 0.0
        for w in re.findall("[a-z0-9]+", query.lower()):
            f = d.count(w)
            s += idf.get(w, 0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / avg))
        out.append(round(s, 6))
    return out


def search(spark, key, text, k=3):
    q = spark.createDataFrame([("q", key, text)], "query_id string, scope_key string, text string")
    hits = R.search(spark.createDataFrame(PARAS, SCHEMA), q, k).collect()
    return sorted(hits, key=lambda h: h.rank)


@pytest.mark.parametrize("key, prefix", [("all", ""), ("geo", "geo/"), ("geo/02-rivers", "geo/02-rivers/")])
def test_bm25_per_scope(spark, key, prefix):
    corpus = [p for p in PARAS if p[0].startswith(prefix)]
    query = "rivers rivers and the old range"
    want = sorted(((-s, p[0], p[1]) for p, s in zip(corpus, okapi([p[3] for p in corpus], query)) if s > 0))[:3]
    assert [(-h.score, h.node_id, h.paragraph_id) for h in search(spark, key, query)] == want


def test_best_hit_and_no_hit(spark):
    assert search(spark, "all", "tallest peak")[0].node_id == "geo/01-hills/01-peaks"
    assert search(spark, "all", "zebra") == [] and search(spark, "all", "  ") == []


def test_scope_rules(spark):
    df = spark.createDataFrame(PARAS, SCHEMA)
    assert R.scope_filter(df, "node", node_id="geo/02-rivers").count() == 1
    assert R.scope_filter(df, "subject", subject="geo").count() == 5
    assert R.scope_filter(df, "all").count() == 6
    for bad in ({"scope": "node"}, {"scope": "subject"}, {"scope": "planet"}):
        with pytest.raises(ValueError):
            R.scope_filter(df, **bad)
    with pytest.raises(Exception, match="bad scope"):
        spark.range(1).select(R.scope_key(F.lit("planet"), F.lit(None).cast("string"), F.lit("x"))).collect()


def test_contexts_hold_no_publisher(spark):
    q = spark.createDataFrame([("q", "all", "all", "lakes", "Water"), ("z", "all", "all", "zebra", "Water")], "query_id string, scope_key string, scope string, text string, node_title string")
    hits = R.search(spark.createDataFrame(PARAS, SCHEMA), q, 2)
    blocks = {r.query_id: r.context for r in R.sources_context(q, hits).collect()}
    assert blocks["q"].startswith("# Source paragraphs (selected node: Water)\n[1] (page ")
    assert blocks["z"].endswith("(no sources retrieved for this question)")
    results = {r.query_id: r.content for r in R.tool_result(q, hits).collect()}
    assert results["z"] == "TOOL_RESULT (lookup_skill_content, scope=all)\n(no hits)"
    assert "[1] path='01-acts/01-water' page=2" in results["q"] or "[1] path='02-rivers/01-lakes' page=9" in results["q"]


def test_leaf_paragraphs_fall_back_to_old_pages(spark):
    schema = "node_id string, body string, sources array<struct<pages:array<int>>>, source_pages array<int>"
    body = "## Source 1 (pages 3-4)\n\nFirst paragraph of the leaf body.\n\nshort\n\nSecond paragraph of the leaf body."
    df = spark.createDataFrame([("a", body, [([3, 4],)], None), ("b", body, None, [8]), ("c", body, [(None,)], None)], schema)
    rows = {(r.node_id, r.paragraph_id): (r.page, r.text) for r in R.leaf_paragraphs(df).collect()}
    assert rows[("a", 0)] == (3, "First paragraph of the leaf body.") and rows[("a", 1)][1].startswith("Second")
    assert rows[("b", 0)][0] == 8 and rows[("c", 1)][0] == 1 and len(rows) == 6


def test_labels(spark):
    null = F.lit(None).cast("string")
    show = lambda *a: spark.range(1).select(T.scope_label(*[F.lit(x) if x is not None else null for x in a]).alias("x")).first().x
    assert show("all", None, None, None) == "All subjects"
    assert show("subject", "old_maps", None, None) == "Old Maps"
    assert show("subject", "old_maps", None, "Maps of Old") == "Maps of Old"
    assert show("node", None, "geo/01-hills/02-old-forts", None) == "02 Old Forts"
    assert show("node", None, "", None) == "Unknown node"


GOOD = dict(A="one", B="two", C="three", D="four")
QUESTION = "question_id string, prompt string, choices map<string,string>, correct string, answer_span string, source_node_id string, source_paragraph_ids array<int>, difficulty string, bloom_level string"


def question(i, span="old range", ids=(0,), choices=GOOD, correct="A", prompt="Which one is it?", difficulty="easy"):
    return (i, prompt, choices, correct, span, "geo/01-hills/01-peaks", list(ids), difficulty, "remember")


def test_schema_filter(spark):
    bad = [
        question("short", prompt="Why?"),
        question("three", choices={k: v for k, v in GOOD.items() if k != "D"}),
        question("blank", choices={**GOOD, "C": " "}),
        question("none", ids=()),
        question("mark", correct="E"),
        question("span", span="ab"),
        question("level", difficulty="odd"),
    ]
    df = spark.createDataFrame([question("good"), *bad], QUESTION)
    assert [r.question_id for r in Q.valid_questions(df).collect()] == ["good"]
    assert all(len(r.reasons) == 1 for r in Q.with_reasons(df).collect() if r.question_id != "good")


def test_span_check(spark):
    paragraphs = spark.createDataFrame([*PARAS, ("geo/01-hills/01-peaks", 2, 5, "He said: “it’s  here”, and left.")], SCHEMA)
    rows = [question("yes", "OLD  range"), question("no", "new range"), question("far", "forts", (0, 77, 78)), question("curly", "\"it's here\"", (9, 2)), question("empty", "   "), question("ids", ids=())]
    got = {r.question_id: (r.grounded, r.reason) for r in Q.verify_spans(spark.createDataFrame(rows, QUESTION), paragraphs).collect()}
    assert got["yes"] == (True, None) and got["curly"] == (True, None)
    assert got["no"] == (False, "answer_span not found in any cited paragraph")
    assert got["far"] == (False, "answer_span not found in any cited paragraph (unknown paragraph_ids: [77, 78])")
    assert got["empty"] == (False, "empty answer_span after normalization")
    assert got["ids"] == (False, "no source_paragraph_ids")


def test_verdicts_and_grades(spark):
    q = spark.createDataFrame([("q1", "t", "A", "e", 1), ("q2", "t", "B", "e", 2), ("q3", "t", "C", "e", 3)], "question_id string, test_id string, correct string, explanation string, ord int")
    verdicts = spark.createDataFrame([("q1", "reject"), ("q2", "garbage")], "question_id string, verdict string")
    assert sorted(r.question_id for r in Q.accepted(q, verdicts).collect()) == ["q2", "q3"]
    assert [r.question_id for r in Q.take_first(q, 2).orderBy("ord").collect()] == ["q1", "q2"]
    answers = spark.createDataFrame([("s", "q1", "A"), ("s", "q2", "D"), ("s", "other", "A")], "submission_id string, question_id string, choice string")
    details = Q.grade(q, spark.createDataFrame([("s", "t")], "submission_id string, test_id string"), answers)
    assert {r.question_id: (r.user, r.is_correct) for r in details.collect()} == {"q1": ("A", True), "q2": ("D", False), "q3": (None, False)}
    summary = Q.grade_summary(details).first()
    assert (summary.score, summary.total, summary.percent) == (1, 3, 33)


def test_capital_is_one_character(spark):
    letters = {"a": "A", "É": "É", "é": "É", "ß": "ẞ", "ŉ": "ŉ", "ﬁ": "ﬁ", "ᾳ": "ᾼ", "ᾈ": "ᾈ", "ΐ": "ΐ", "7": "7", "": ""}
    rows = spark.createDataFrame([(x,) for x in letters], "x string").select("x", T.capital(F.col("x")).alias("y"))
    assert {r.x: r.y for r in rows.collect()} == letters
