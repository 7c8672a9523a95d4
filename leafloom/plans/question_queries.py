"""Question and grading queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.operators import questions as Q
from leafloom.plans import fixtures as fx
from leafloom.plans.registry import block, query
from leafloom.session import Tables

TEST_SIZE = 4

_BAD = {
    "prompt too short": "length(prompt) < 8",
    "choices must be A, B, C, D": "list_sort(map_keys(choices)) <> ['A', 'B', 'C', 'D']",
    "blank choice": "len(list_filter(map_values(choices), lambda v: trim(v) = '')) > 0",
    "bad bloom level": "bloom_level NOT IN ('remember', 'understand', 'apply', 'analyze')",
}
_REASONS = "concat_ws('; ', " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in _BAD.items()) + ")"
block("good_question", f"SELECT * FROM fx_question WHERE {_REASONS} = ''", "fx_question")
block(
    "last_text",
    "SELECT node_id, paragraph_id, text FROM fx_paragraph",
    "fx_paragraph",
)
block(
    "cited",
    r"""
SELECT q.question_id, c.pos, c.pid, p.text,
       coalesce(contains(trim(regexp_replace(lower(p.text), '\s+', ' ', 'g')), trim(regexp_replace(lower(q.answer_span), '\s+', ' ', 'g'))), false) AS found
FROM fx_question q, LATERAL (SELECT unnest(q.source_paragraph_ids) AS pid, generate_subscripts(q.source_paragraph_ids, 1) AS pos) c
LEFT JOIN fx_paragraph p ON p.node_id = q.source_node_id AND p.paragraph_id = c.pid""",
    "fx_question",
    "fx_paragraph",
)
block(
    "checked",
    """
SELECT question_id, bool_or(found) AS grounded,
       CASE WHEN bool_or(found) THEN NULL ELSE 'answer_span not found in any cited paragraph' ||
         CASE WHEN count(*) FILTER (text IS NULL) > 0 THEN ' (unknown paragraph_ids: [' || string_agg(pid::VARCHAR, ', ' ORDER BY pos) FILTER (text IS NULL) || '])' ELSE '' END END AS reason
FROM cited GROUP BY question_id""",
    "cited",
)
block(
    "kept",
    """
SELECT q.* FROM good_question q JOIN checked c USING (question_id) LEFT JOIN fx_question_verdict v USING (question_id)
WHERE c.grounded AND coalesce(v.verdict, 'accept') = 'accept'""",
    "good_question",
    "checked",
    "fx_question_verdict",
)
block(
    "shipped",
    f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY test_id ORDER BY ord) AS INTEGER) AS number FROM kept) WHERE number <= {TEST_SIZE}",
    "kept",
)
block(
    "detail",
    """
SELECT s.submission_id, q.test_id, q.question_id, a.choice AS "user", q.correct, coalesce(a.choice = q.correct, false) AS is_correct, q.explanation
FROM (SELECT DISTINCT a.submission_id, q.test_id FROM fx_answer a JOIN shipped q USING (question_id)) s JOIN shipped q USING (test_id)
LEFT JOIN fx_answer a ON a.submission_id = s.submission_id AND a.question_id = q.question_id""",
    "shipped",
    "fx_answer",
)


@query("question_schema_filter", f"SELECT question_id, {_REASONS} AS reasons FROM fx_question", ("fx_question",))
def _(t):
    return Q.with_reasons(fx.questions(t)).select("question_id", F.array_join("reasons", "; ").alias("reasons"))


def paragraphs(t: Tables) -> DataFrame:
    return fx.paragraphs(t).select("node_id", "paragraph_id", "text")


@query(
    "paragraph_index_dedupe",
    "SELECT node_id, paragraph_id, upper(text[1]) || text[2:] AS text FROM fx_paragraph",
    ("fx_paragraph",),
)
def _(t):
    rows = fx.paragraphs(t).select("node_id", "paragraph_id", "text")
    later = rows.withColumn("text", F.concat(T.capital(F.substring("text", 1, 1)), F.substr("text", F.lit(2)))).withColumn("ord", F.lit(1))
    return Q.latest_paragraphs(rows.withColumn("ord", F.lit(0)).unionByName(later), "ord")


@query("verify_spans", "SELECT question_id, grounded, reason FROM checked", ("checked",))
def _(t):
    return Q.verify_spans(fx.questions(t), paragraphs(t))


@query(
    "judge_questions",
    "SELECT question_id FROM fx_question LEFT JOIN fx_question_verdict v USING (question_id) WHERE coalesce(v.verdict, 'accept') = 'accept'",
    ("fx_question", "fx_question_verdict"),
)
def _(t):
    return Q.accepted(fx.questions(t), fx.question_verdicts(t)).select("question_id")


def kept(t: Tables) -> DataFrame:
    good = Q.valid_questions(fx.questions(t))
    grounded = Q.verify_spans(good, paragraphs(t)).filter("grounded").select("question_id")
    return Q.accepted(good.join(grounded, "question_id", "left_semi"), fx.question_verdicts(t))


def shipped(t: Tables) -> DataFrame:
    return Q.take_first(kept(t), TEST_SIZE)


@query("take_first_n_questions", "SELECT test_id, number, question_id FROM shipped", ("shipped",))
def _(t):
    return shipped(t).select("test_id", "number", "question_id")


def details(t: Tables) -> DataFrame:
    test, answers = shipped(t), fx.answers(t)
    submissions = answers.join(test.select("question_id", "test_id"), "question_id").select("submission_id", "test_id").distinct()
    return Q.grade(test, submissions, answers)


@query("grade_test", 'SELECT submission_id, test_id, question_id, "user", correct, is_correct, explanation FROM detail', ("detail",))
def _(t):
    return details(t)


@query(
    "grade_summary",
    """
SELECT submission_id, test_id, count(*) FILTER (is_correct) AS score, count(*) AS total, CAST(round(100.0 * count(*) FILTER (is_correct) / greatest(count(*), 1)) AS INTEGER) AS percent
FROM detail GROUP BY submission_id, test_id""",
    ("detail",),
)
def _(t):
    return Q.grade_summary(details(t))


@query(
    "difficulty_mix",
    """
SELECT *, greatest(0, 4 - easy) AS easy_short, greatest(0, 3 - medium) AS medium_short, greatest(0, 3 - hard) AS hard_short, CAST(13 AS INTEGER) AS oversample
FROM (SELECT test_id, count(*) FILTER (difficulty = 'easy') AS easy, count(*) FILTER (difficulty = 'medium') AS medium, count(*) FILTER (difficulty = 'hard') AS hard FROM fx_question GROUP BY test_id)""",
    ("fx_question",),
)
def _(t):
    return Q.difficulty_mix(fx.questions(t), (4, 3, 3), 10)


@query(
    "verifier_yield",
    f"""
SELECT test_id, count(*) AS produced, count(*) FILTER (c.grounded) AS grounded, count(*) FILTER (c.grounded AND coalesce(v.verdict, 'accept') <> 'reject') AS accepted,
       least(count(*) FILTER (c.grounded AND coalesce(v.verdict, 'accept') <> 'reject'), {TEST_SIZE}) AS shipped
FROM fx_question q JOIN checked c USING (question_id) LEFT JOIN fx_question_verdict v USING (question_id) GROUP BY test_id""",
    ("checked", "fx_question_verdict"),
)
def _(t):
    q = fx.questions(t)
    return Q.yield_report(q, Q.verify_spans(q, paragraphs(t)), fx.question_verdicts(t), TEST_SIZE)


@query(
    "tests_newest_first",
    """
SELECT test_id, count(*) AS question_count, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * max(ord), '%Y-%m-%dT%H:%M:%S') AS generated_at FROM fx_question GROUP BY test_id""",
    ("fx_question",),
)
def _(t):
    made = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 60 * F.max("ord")), "yyyy-MM-dd'T'HH:mm:ss")
    return Q.newest_tests(fx.questions(t).groupBy("test_id").agg(F.count(F.lit(1)).alias("question_count"), made.alias("generated_at")))


@query(
    "render_judge_block",
    """
SELECT q.question_id, '## Question' || chr(10) || 'Prompt: ' || prompt || chr(10) || 'A: ' || coalesce(choices['A'], '') || chr(10) || 'B: ' || coalesce(choices['B'], '') || chr(10) ||
       'C: ' || coalesce(choices['C'], '') || chr(10) || 'D: ' || coalesce(choices['D'], '') || chr(10) || 'Marked correct: ' || correct || chr(10) || chr(10) ||
       '## Cited source paragraphs' || chr(10) || c.lines || chr(10) || chr(10) || 'Now emit your JSON verdict.' AS block
FROM fx_question q JOIN (SELECT question_id, string_agg('[paragraph_id=' || pid || '] ' || coalesce(text, '(missing — paragraph not provided)'), chr(10) ORDER BY pos) AS lines FROM cited GROUP BY question_id) c USING (question_id)""",
    ("cited",),
)
def _(t):
    return Q.judge_block(fx.questions(t), paragraphs(t))
