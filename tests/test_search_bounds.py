"""The best k by bounds against the scores of all paragraphs, and how many are scored in full."""

import random

import pytest
from pyspark.sql import functions as F

from leafloom.operators import retrieval as R

SCHEMA = "node_id string, paragraph_id int, page int, text string"
QUERY = "query_id string, scope_key string, text string"


def corpus(seed, n):
    """Texts of some common and many rare words; some are copies, so scores tie."""
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(900)]
    rows = []
    for i in range(n):
        words = rng.choices(common, k=rng.randint(3, 30)) + rng.choices(rare, k=rng.randint(0, 8))
        rng.shuffle(words)
        rows.append((f"s{i % 3}/b{i % 7}/d{i // 5}", i % 5, 1, rows[-1][3] if i % 11 == 10 else " ".join(words)))
    return rows, common, rare


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 8), (4, 1000)])
def test_best_scores_equal_all_scores(spark, seed, k):
    rows, common, rare = corpus(seed, 400)
    rng = random.Random(seed)
    queries = [(f"q{i}", rng.choice(["all", "s0", "s1", "s2/b1", "s9"]), " ".join(rng.choices(common, k=rng.randint(0, 6)) + rng.choices(rare, k=rng.randint(0, 6)))) for i in range(40)]
    queries += [("copy", "all", rows[17][3]), ("common", "all", "c1 c1 c2"), ("none", "all", "zebra"), ("empty", "all", ""), ("one", "s1", rare[5])]
    paragraphs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, QUERY)
    columns = ["query_id", "rank", "node_id", "paragraph_id", "score"]
    want = R.top_hits(R.scores(paragraphs, asked), k).select(*columns).collect()
    got = R.best_scores(R.stored(R.term_index(paragraphs), "index"), asked, k).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) >= 30


def test_few_paragraphs_are_scored(spark):
    rows, common, rare = corpus(5, 3000)
    queries = [(f"q{i}", "all", r[3]) for i, r in enumerate(rows) if i % 100 == 0 and any(w[0] == "r" for w in r[3].split())]
    paragraphs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(queries, QUERY)
    index = R.stored(R.term_index(paragraphs), "index")
    pairs = R.candidates(index, asked, 3)[0]
    assert pairs.count() < 40 * len(queries) < R.scores(paragraphs, asked).count() / 20


def test_negative_weights(spark):
    """In a tiny scope the mean weight is below zero, and common words lower a score."""
    rows = [("s/a/d1", i, 1, t) for i, t in enumerate(["x y", "x y z", "x y", "x y z w"])]
    paragraphs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("q", "all", "x y z"), ("p", "all", "x w")], QUERY)
    got = R.best_scores(R.stored(R.term_index(paragraphs), "index"), asked, 2).collect()
    want = R.top_hits(R.scores(paragraphs, asked), 2).collect()
    assert sorted((r.query_id, r.rank, r.paragraph_id, r.score) for r in got) == sorted((r.query_id, r.rank, r.paragraph_id, r.score) for r in want)


def test_index_counts_terms(spark):
    rows = [("n", 0, 1, "b a B a, a"), ("n", 1, 1, ""), ("n", 2, 1, None), ("n", 3, 1, "é")]
    got = {r.paragraph_id: (r.dl, [tuple(t) for t in r.terms or []]) for r in R.term_index(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == (5, [("a", 3), ("b", 2)]) and got[1] == (0, []) and got[3] == (0, []) and got[2][1] == []


def test_superseded_leaves_are_hidden(spark):
    body = "## Source 1 (page 3)\n\nThe granite range stands near the plateau.\n\nSalt lakes form far from the sea."
    rows = [("geo/a", body, None), ("geo/b", body.replace("granite", "quartz"), "geo/a"), ("geo/c", "A market town on the river bank.", None)]
    leaves = spark.createDataFrame(rows, "node_id string, body string, superseded_by string").withColumns(
        {"sources": F.lit(None).cast("array<struct<source_id:int,pages:array<int>>>"), "source_pages": F.array(F.lit(3))}
    )
    asked = spark.createDataFrame([("q", "geo", "quartz range"), ("p", "geo", "salt lakes")], QUERY)
    hits = R.search_leaves(leaves, asked, 5).collect()
    assert {r.node_id for r in hits} == {"geo/a"} and {r.page for r in hits} == {3}
    assert {r.node_id for r in R.search_leaves(leaves, asked, 5, include_superseded=True).collect()} == {"geo/a", "geo/b"}


def test_scores_of_a_paragraph_are_summed_in_its_row(spark, monkeypatch):
    rows, common, rare = corpus(6, 300)
    rows = [*rows, ("s0/b0/x", 0, 1, ""), ("s0/b0/x", 1, 1, None)]
    queries = [(f"q{i}", ["all", "s0", "s1/b3", "s9"][i % 4], " ".join(common[i % 7 : i % 7 + 4] + rare[i : i + 3])) for i in range(30)]
    paragraphs, asked = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*queries, ("empty", "all", "")], QUERY)
    shown = lambda: sorted(map(tuple, R.scores(paragraphs, asked).collect()))
    with monkeypatch.context() as m:
        m.setattr(R, "MAX_CELLS", -1)
        want = shown()
    monkeypatch.delattr(R, "_met")
    assert shown() == want and len(want) > 1000
