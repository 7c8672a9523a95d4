"""Multiple-choice questions: schema filter, grounding check, verdicts, tests and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions import text as T
from leafloom.operators import ordered


def schema_reasons() -> Column:
    """Reasons a question row breaks the schema; an empty list when it is good."""
    keys = F.array_sort(F.map_keys("choices"))
    four = F.coalesce(keys == F.array(*[F.lit(c) for c in K.CHOICES]), F.lit(False))
    filled = F.forall(F.map_values("choices"), lambda v: F.coalesce(T.strip(v) != "", F.lit(False)))
    rules = [
        (F.coalesce(F.length("prompt") >= 8, F.lit(False)), "prompt too short"),
        (four, "choices must be A, B, C, D"),
        (F.coalesce(filled, F.lit(False)), "blank choice"),
        (F.coalesce(F.col("correct").isin(K.CHOICES), F.lit(False)), "bad correct choice"),
        (F.coalesce(F.length("answer_span") >= 3, F.lit(False)), "answer span too short"),
        (F.coalesce(F.size("source_paragraph_ids") >= 1, F.lit(False)), "no source paragraph"),
        (F.coalesce(F.col("difficulty").isin(K.DIFFICULTIES), F.lit(True)), "bad difficulty"),
        (F.coalesce(F.col("bloom_level").isin(K.BLOOM_LEVELS), F.lit(True)), "bad bloom level"),
    ]
    return F.array_compact(F.array(*[F.when(~ok, F.lit(reason)) for ok, reason in rules]))


def with_reasons(questions: DataFrame) -> DataFrame:
    return questions.withColumn("reasons", schema_reasons())


def valid_questions(questions: DataFrame) -> DataFrame:
    """Rows that satisfy the schema; bad rows are dropped one by one."""
    return with_reasons(questions).filter(F.size("reasons") == 0).drop("reasons")


def latest_paragraphs(paragraphs: DataFrame, order: str) -> DataFrame:
    """One text per (node, paragraph); the last row in order wins."""
    return paragraphs.groupBy("node_id", "paragraph_id").agg(F.max_by("text", order).alias("text"))


def _cited(questions: DataFrame) -> DataFrame:
    return questions.select(
        "question_id", F.col("source_node_id").alias("node_id"), "answer_span", F.posexplode("source_paragraph_ids").alias("pos", "paragraph_id")
    )


def verify_spans(questions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``(question_id, grounded, reason)``: the span must occur in a cited paragraph.

    Cited ids are opened to rows and met by equality; a question without ids still gets its row.
    """
    span = T.normalize_for_match(F.col("answer_span"))
    met = _cited(questions).join(paragraphs.select("node_id", "paragraph_id", "text"), ["node_id", "paragraph_id"], "left")
    found = F.coalesce(F.contains(T.normalize_for_match(F.col("text")), span), F.lit(False))
    missing = F.collect_list(F.when(F.col("text").isNull(), F.struct("pos", "paragraph_id")))
    checked = met.groupBy("question_id").agg(F.bool_or(found).alias("_hit"), F.array_sort(missing).alias("_missing"))
    ids = F.array_join(F.transform("_missing", lambda m: m["paragraph_id"].cast("string")), ", ")
    lost = F.when(F.size("_missing") > 0, F.concat(F.lit(" (unknown paragraph_ids: ["), ids, F.lit("])"))).otherwise("")
    rows = questions.select("question_id", span.alias("_span"), F.size("source_paragraph_ids").alias("_n")).join(checked, "question_id", "left")
    grounded = (F.col("_span") != "") & F.coalesce("_hit", F.lit(False))
    reason = (
        F.when(F.col("_span") == "", F.lit("empty answer_span after normalization"))
        .when(F.coalesce("_n", F.lit(0)) <= 0, F.lit("no source_paragraph_ids"))
        .when(~grounded, F.concat(F.lit("answer_span not found in any cited paragraph"), lost))
    )
    return rows.select("question_id", grounded.alias("grounded"), reason.alias("reason"))


def accepted(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Questions whose verdict is accept; a missing or unreadable verdict accepts."""
    judged = questions.join(verdicts.select("question_id", "verdict"), "question_id", "left")
    verdict = F.when(F.col("verdict").isin("accept", "reject"), F.col("verdict")).otherwise("accept")
    return judged.withColumn("verdict", verdict).filter(F.col("verdict") == "accept").drop("verdict")


def take_first(questions: DataFrame, n: int, test: str = "test_id", order: str = "ord") -> DataFrame:
    """The first ``n`` questions of each test; the rank limit cuts every map partition first."""
    return ordered.best_per_key(questions, [test], [F.col(order)], keep=n, out="number")


def grade(questions: DataFrame, submissions: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per submission and question of its test, with the answer if there is one.

    ``submissions`` has ``(submission_id, test_id)``. Answers to other questions are ignored.
    """
    asked = submissions.join(questions.select("test_id", "question_id", "correct", "explanation"), "test_id")
    rows = asked.join(answers.select("submission_id", "question_id", "choice"), ["submission_id", "question_id"], "left")
    return rows.select(
        "submission_id", "test_id", "question_id", F.col("choice").alias("user"), "correct",
        F.coalesce(F.col("choice") == F.col("correct"), F.lit(False)).alias("is_correct"), "explanation",
    )


def grade_summary(details: DataFrame) -> DataFrame:
    rows = details.groupBy("submission_id", "test_id").agg(F.count_if("is_correct").alias("score"), F.count(F.lit(1)).alias("total"))
    return rows.withColumn("percent", F.round(100 * F.col("score") / F.greatest(F.col("total"), F.lit(1))).cast("int"))


def difficulty_mix(questions: DataFrame, asked: tuple[int, int, int], n: int) -> DataFrame:
    """Questions per difficulty beside the asked mix, and how many to generate to absorb rejects."""
    counts = [F.count_if(F.col("difficulty") == d).alias(d) for d in K.DIFFICULTIES]
    rows = questions.groupBy("test_id").agg(*counts)
    short = [F.greatest(F.lit(0), F.lit(a) - F.col(d)).cast("bigint").alias(f"{d}_short") for d, a in zip(K.DIFFICULTIES, asked)]
    return rows.select("*", *short, F.lit(max(n + 3, sum(asked))).alias("oversample"))


def yield_report(questions: DataFrame, checked: DataFrame, verdicts: DataFrame, n: int) -> DataFrame:
    """Per test: produced, grounded, accepted and shipped questions."""
    rows = questions.select("question_id", "test_id").join(checked.select("question_id", "grounded"), "question_id")
    rows = rows.join(verdicts.select("question_id", "verdict"), "question_id", "left")
    kept = F.col("grounded") & (F.coalesce("verdict", F.lit("accept")) != "reject")
    out = rows.groupBy("test_id").agg(
        F.count(F.lit(1)).alias("produced"), F.count_if("grounded").alias("grounded"), F.count_if(kept).alias("accepted")
    )
    return out.withColumn("shipped", F.least(F.col("accepted"), F.lit(n).cast("bigint")))


def newest_tests(tests: DataFrame) -> DataFrame:
    return tests.orderBy(F.desc("generated_at"), F.col("test_id"))


def judge_block(questions: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """What a judge reads: the question, its choices, the marked answer and the cited paragraphs."""
    met = _cited(questions).join(paragraphs.select("node_id", "paragraph_id", "text"), ["node_id", "paragraph_id"], "left")
    body = F.coalesce("text", F.lit("(missing — paragraph not provided)"))
    line = F.concat(F.lit("[paragraph_id="), F.col("paragraph_id").cast("string"), F.lit("] "), body)
    rows = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    cited = met.groupBy("question_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("_lines"))
    choice = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col("choices")[c], F.lit(""))) for c in K.CHOICES]
    text = F.concat_ws(
        "\n",
        F.lit("## Question"),
        F.concat(F.lit("Prompt: "), "prompt"),
        *choice,
        F.concat(F.lit("Marked correct: "), "correct"),
        F.lit("\n## Cited source paragraphs"),
        "_lines",
        F.lit("\nNow emit your JSON verdict."),
    )
    return questions.join(cited, "question_id", "left").select("question_id", text.alias("block"))
