import random

import pytest
from pyspark.sql import functions as F

from leafloom.functions import slugs
from leafloom.operators import structure as S
from leafloom.operators import trees


def _greedy(bases):
    used, out = set(), []
    for b in bases:
        name, n = b, 2
        while name in used:
            name, n = f"{b}-{n}", n + 1
        used.add(name)
        out.append(name)
    return out


def test_unique_slugs_match_the_greedy_rule(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        rows += [(g, i, rng.choice(["a", "a-2", "a-2-2", "a-3", "b", "b-1", "c-02", "a-4-2"])) for i in range(rng.randint(1, 12))]
    got = trees.unique_slugs(spark.createDataFrame(rows, "g int, o int, base string"), ["g"], "o").collect()
    want = {}
    for g in range(40):
        line = [r for r in rows if r[0] == g]
        want.update({(g, r[1]): s for r, s in zip(line, _greedy([r[2] for r in line]))})
    assert {(r.g, r.o): r.slug for r in got} == want


@pytest.mark.parametrize(
    "title, slug",
    [("Rivers & Lakes!", "rivers-lakes"), ("Café Straße", "cafe-strae"), ("", "untitled"), ("***", "untitled"), ("ﬁne", "fine"), ("x" * 59 + " yy", "x" * 59)],
)
def test_slugify(spark, title, slug):
    assert spark.range(1).select(slugs.slugify(F.lit(title)).alias("s")).first().s == slug


NODES = "doc_id int, node_key string, parent_key string, ord int, depth int, title string, description string, paragraph_start int, paragraph_end int"


def tree(spark, *ranges):
    rows = [(1, "r", None, 0, 0, "Root", "all", None, None)]
    rows += [(1, f"r/{i}", "r", i, 1, f"Leaf {i}", f"d{i}", a, b) for i, (a, b) in enumerate(ranges)]
    return spark.createDataFrame(rows, NODES)


@pytest.mark.parametrize(
    "ranges, rules",
    [
        ([(0, 10), (11, 20)], []),
        ([(None, None), (1, 2)], ["null_range"]),
        ([(10, 5), (11, 12)], ["inverted_range"]),
        ([(0, 10), (8, 20)], ["overlap"]),
    ],
)
def test_tree_violations(spark, ranges, rules):
    assert sorted(r.rule for r in S.tree_violations(tree(spark, *ranges)).collect()) == rules


def paragraphs(spark, n):
    return spark.createDataFrame([(1, i, i // 5 + 1, f"text number {i}") for i in range(n)], "doc_id int, paragraph_id int, page int, text string")


def test_coverage_gate(spark):
    full = S.coverage(tree(spark, (0, 3), (4, 99)), paragraphs(spark, 10)).first()
    assert (full.coverage, full.referenced, full.ok) == (1.0, 10, True)
    S.require_coverage(S.coverage(tree(spark, (0, 9)), paragraphs(spark, 10)))
    low = S.coverage(tree(spark, (0, 8)), paragraphs(spark, 10))
    assert low.first().coverage == 0.9
    with pytest.raises(ValueError):
        S.require_coverage(low)
    empty = S.coverage(tree(spark, (0, 1)), paragraphs(spark, 10).limit(0)).first()
    assert empty.coverage == 1.0 and empty.ok


def test_gaps_bodies_and_pages(spark):
    t, p = tree(spark, (1, 2), (5, 6), (70, 80)), paragraphs(spark, 9)
    assert sorted((r.gap_start, r.gap_end) for r in S.range_gaps(t, p).collect() if r.gap_start < 9) == [(0, 0), (3, 4), (7, 69)]
    bodies = {r.node_key: r.body for r in S.leaf_bodies(t, p).collect()}
    assert bodies == {"r/0": "text number 1\n\ntext number 2", "r/1": "text number 5\n\ntext number 6", "r/2": "d2"}
    pages = {r.node_key: r.source_pages for r in S.source_pages(t, p).collect()}
    assert pages == {"r": [1, 2], "r/0": [1], "r/1": [2], "r/2": []}
    assert S.contents_outline(t).first().body.startswith("## Contents\n\n- **Leaf 0** — d0\n- **Leaf 1**")


def test_chapters_share_a_page_and_fall_back(spark):
    p = spark.createDataFrame([(d, i, i + 1, "x") for d in (1, 2) for i in range(6)], "doc_id int, paragraph_id int, page int, text string")
    marks = spark.createDataFrame([(1, 1, "A", 1), (1, 1, "B", 1), (1, 2, "sub", 2), (1, 1, "C", 4), (1, 1, " ", 5), (1, 1, "Z", 9)], "doc_id int, level int, title string, page int")
    docs = spark.createDataFrame([(1, 6), (2, 6)], "doc_id int, page_count int")
    got = sorted(((r.doc_id, r.title or "", r.first_page, r.last_page, r.first_id, r.last_id) for r in S.assign_chapters(p, marks, docs).collect()))
    assert got == [(1, "A", 1, 1, 0, 0), (1, "B", 1, 3, 0, 2), (1, "C", 4, 8, 3, 5), (2, "", 1, 6, 0, 5)]


def test_climb_takes_any_depth_and_rejects_cycles(spark):
    schema = "id string, parent string, ord int, title string"
    rows = spark.createDataFrame([(str(i), str(i - 1) if i else None, 0, f"t{i}") for i in range(23)], schema)
    got = {r.id: r.title_path for r in trees.tree_paths(rows).collect()}
    assert got == {str(i): " › ".join(f"t{k}" for k in range(i + 1)) for i in range(23)}
    assert trees.ancestors(rows).count() == 23 * 22 // 2
    ring = spark.createDataFrame([("r", None, 0, "t"), ("a", "b", 0, "t"), ("b", "c", 0, "t"), ("c", "a", 0, "t")], schema)
    with pytest.raises(ValueError, match="cycle"):
        trees.tree_paths(ring)


def test_node_ids(spark):
    rows = [(1, "r", None, 0, 0, "S", "", None, None), (1, "a", "r", 0, 1, "Same", "", None, None), (1, "b", "r", 1, 1, "Same", "", None, None), (1, "c", "b", 0, 2, "Deep One", "", None, None)]
    got = {r.node_key: (r.node_id, r.parent, r.depth) for r in trees.emit_node_ids(spark.createDataFrame(rows, NODES), "doc_id", F.lit("geo")).collect()}
    assert got["b"] == ("geo/02-same-2", "geo", 1)
    assert got["c"] == ("geo/02-same-2/01-deep-one", "geo/02-same-2", 2)


def greedy(wanted):
    taken, upcoming, out = set(), {}, []
    for base in wanted:
        name, number = base, upcoming.get(base, 2)
        while name in taken:
            name, number = f"{base}-{number}", number + 1
        upcoming[base] = number
        taken.add(name)
        out.append(name)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_unique_slugs_of_linked_families(spark, seed):
    """Bases that read like each other's numbered forms, several levels deep, in any order."""
    rng, rows, want = random.Random(seed), [], []
    for g in range(25):
        names = ["a", "a-2", "a-3", "a-2-2", "a-2-3", "a-2-2-2", "a-4", "a-12", "a-02", "a-1", "b", "b-99999999999999999999", "c-2"]
        wanted = rng.choices(names, weights=[rng.choice([1, 3, 9]) for _ in names], k=rng.randint(1, 60))
        rows += [(g, i * 3 - 5, b) for i, b in enumerate(wanted)]
        want += [(g, i * 3 - 5, b) for i, b in enumerate(greedy(wanted))]
    got = trees.unique_slugs(spark.createDataFrame(rows, "g int, o long, base string"), ["g"], "o")
    assert sorted((r.g, r.o, r.slug) for r in got.collect()) == sorted(want)


def test_unique_slugs_of_one_large_family(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 10 == 7, F.concat(F.lit("a-"), (F.col("id") % 50_000 + 2).cast("string"))).otherwise("a").alias("base"))
    out = trees.unique_slugs(rows, ["g"], "o")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = [r.slug for r in out.orderBy("o").select("slug").collect()]
    assert got == greedy([r.base for r in rows.orderBy("o").collect()])


def test_a_tree_below_the_threshold_is_not_committed(spark, tmp_path):
    from leafloom.sources.snapshots import COLUMNS, SCHEMA, SnapshotStore

    store, none = SnapshotStore(spark, str(tmp_path)), dict.fromkeys(COLUMNS)
    rows = lambda *trees_: spark.createDataFrame([tuple((none | {"subject": f"s{t}", "node_id": f"n{t}"}).values()) + (t,) for t in trees_], SCHEMA + ", doc_id long")
    result = spark.createDataFrame([(1, 1.0, True), (2, 0.97, True), (3, 0.5, False)], "doc_id long, coverage double, ok boolean")
    S.commit_covered(store, rows(1, 2), result, 0, None)
    with pytest.raises(S.CoverageError, match="0.500 of tree 3"):
        S.commit_covered(store, rows(2, 3), result, 1, 0)
    with pytest.raises(S.CoverageError, match="tree 4"):  # a tree without a result
        S.commit_covered(store, rows(4), result, 1, 0)
    assert store.latest() == 0 and {r.node_id for r in store.read().collect()} == {"n1", "n2"}
    S.commit_covered(store, rows(2), result, 1, 0)
    assert store.latest() == 1 and {r.node_id for r in store.read().collect()} == {"n1", "n2"}


def test_nodes_of_trees_are_not_sent_through_the_driver(spark, tmp_path):
    from leafloom.plans.catalog import QUERIES
    from leafloom.session import Tables

    text = "\n".join(f"paragraph number {i} of the document" for i in range(40))
    rows = [(i, "\n".join([text] * (i % 3)), "en", f"src{i % 4}") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["tree_stats"](Tables(spark, str(tmp_path)))
    # 80 paragraphs are 20 leaves in 7 chapters below the root; a document without paragraphs has its root only.
    assert {(r.doc_id, r.total_nodes, r.max_page) for r in found.collect() if r.doc_id in (0, 5, 10)} == {(0, 1, 0), (5, 28, 16), (10, 15, 8)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
