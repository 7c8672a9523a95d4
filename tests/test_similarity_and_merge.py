import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafloom.functions import text as T
from leafloom.functions import vectors as V
from leafloom.operators import dedup, merging
from leafloom.operators import similarity as S

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def leaf_rows(seed, n):
    """Leaves of few words; a third of them are copies of one text."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        body = "alpha beta gamma delta" if i % 3 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(3, 9)))
        rows.append((i, rng.choice("st"), f"n{i}", rng.choice(WORDS), body, rng.choice(["NCERT", "RBSE", "x"]), i % 2 == 0))
    return rows


LEAF = "ord long, subject string, node_id string, title string, body string, publisher string, is_new boolean"


def cos(a, b):
    ca, cb = ({w: t.count(w) for w in t} for t in (a, b))
    dot = sum(n * cb.get(w, 0) for w, n in ca.items())
    size = math.sqrt(sum(n * n for n in ca.values()) * sum(n * n for n in cb.values()))
    return dot / size if size else 0.0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_pairs_are_exact(spark, threshold):
    rows = leaf_rows(7, 90)
    got = S.leaf_pairs(spark.createDataFrame(rows, LEAF), threshold).collect()
    total = sum(r.n_new * r.n_existing for r in got)
    token = lambda r: re.findall("[a-z][a-z0-9]+", f"{r[3]} {r[4]}")
    want = [(a, b) for a in rows for b in rows if a[6] and not b[6] and a[1] == b[1] and round(cos(token(a), token(b)), 6) >= threshold]
    assert total == len(want) > 0
    assert all(r.similarity >= threshold for r in got)


def test_pairs_are_exact_when_slots_are_dealt_out(spark, monkeypatch):
    rows = spark.createDataFrame(leaf_rows(8, 120), LEAF)
    want = sorted(map(repr, S.leaf_pairs(rows, 0.6).collect()))
    monkeypatch.setattr(S, "PAIRS_PER_TASK", 6)
    assert sorted(map(repr, S.leaf_pairs(rows, 0.6).collect())) == want and len(want) > 5


def test_embedder_contract(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "red red blue"), (3, "sky"), (4, "")], "id int, text string")
    rows = S.hash_embedder()(df).collect()
    by = {i: {r.slot: r.weight for r in rows if r.id == i} for i in range(1, 5)}
    assert by[1] == by[2] and by[4] == {}
    assert abs(sum(w * w for w in by[1].values()) - 1) < 1e-9
    assert not set(by[1]) & set(by[3])
    with pytest.raises(ValueError):
        S.hash_embedder(32)


def test_cosine_and_buckets(spark):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    row = spark.range(1).select(
        V.cosine(arr(1, 0), arr(1, 0)).alias("a"), V.cosine(arr(1, 0), arr(0, 1)).alias("b"), V.cosine(arr(0, 0), arr(1, 0)).alias("c"),
        V.similarity_bucket(F.lit(0.85)).alias("d"), V.similarity_bucket(F.lit(0.92)).alias("e"), V.similarity_bucket(F.lit(0.79)).alias("f"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f) == (1.0, 0.0, 0.0, "grey", "auto", "different")


def test_dense_pairs_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, "b", [rng.gauss(1 if i % 4 else -1, 0.7) for _ in range(6)], i % 2 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, block string, v array<double>, is_new boolean")
    got = {(r.new_id, r.existing_id) for r in S.dense_pairs(df, "block", "id", "v", 0.8).collect()}
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] and not b[3] and round(sum(x * y for x, y in zip(unit(a[2]), unit(b[2]))), 6) >= 0.8}
    assert got == want and want


def test_grey_pairs_need_a_verdict(spark):
    pairs = spark.createDataFrame([("s", "a", "b", 0.85, 1, 1), ("s", "c", "d", 0.95, 2, 3), ("s", "e", "f", 0.85, 1, 1)], "subject string, new_sig string, existing_sig string, similarity double, n_new int, n_existing int")
    verdicts = spark.createDataFrame([("a", "b", "duplicate")], "new_sig string, existing_sig string, verdict string")
    assert {r.new_sig: r.decision for r in dedup.decide(pairs).collect()} == {"a": "related", "c": "duplicate", "e": "related"}
    decided = dedup.decide(pairs, verdicts)
    assert {r.new_sig: r.decision for r in decided.collect()} == {"a": "duplicate", "c": "duplicate", "e": "related"}
    groups = spark.createDataFrame([("s", True, 5), ("s", False, 6)], "subject string, is_new boolean, n int")
    assert dedup.report(decided, groups).first()[1:] == (7, 1, 22)


def test_winner_rule(spark):
    def winner(a, b):
        order = dedup.winner_order(F.col("p"), F.col("b"), F.col("n"))
        return spark.createDataFrame([a, b], "p string, b string, n string").agg(F.min(order)["node_id"]).first()[0]

    assert winner((" NCERT ", "x", "z"), ("rbse", "xxxx", "a")) == "z"
    assert winner(("rbse", "x", "a"), ("RBSE", "xx", "b")) == "b"
    assert winner(("who", "xx", "b"), (None, "xx", "a")) == "a"
    assert winner(("who", "xxxx", "b"), ("coaching", "x", "a")) == "a"


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"leaf{i}") for i in range(50)]
    got = {r.id: r.component for r in dedup.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(101)} == {"c000"}
    assert {v for k, v in got.items() if not k.startswith("c")} == {"hub"}


def test_supersede_walks_to_the_head_and_is_idempotent(spark):
    leaves = spark.createDataFrame([(x, None) for x in "abcde"], "node_id string, superseded_by string")
    losers = spark.createDataFrame([("a", "b"), ("b", "c")], "node_id string, winner string")
    once = dedup.supersede(leaves, losers)
    state = {r.node_id: r.superseded_by for r in once.collect()}
    assert state == {"a": "c", "b": "c", "c": None, "d": None, "e": None}
    assert {r.node_id: r.superseded_by for r in dedup.supersede(once, losers).collect()} == state
    later = dedup.supersede(once, spark.createDataFrame([("a", "d")], "node_id string, winner string"))
    assert {r.node_id: r.superseded_by for r in later.collect()} == {"a": "d", "b": "d", "c": "d", "d": None, "e": None}


def _sequential(titles):
    """The rule one leaf at a time."""
    opened, out = [], {}
    for i, title in enumerate(titles):
        words = set(title.split("-"))
        best, best_n = None, 0
        for j, have in opened:
            if len(words & have) > best_n:
                best, best_n = j, len(words & have)
        if best is None:
            opened.append((i, words))
            best = i
        out[i] = best
    return out


def test_open_chapters_match_the_sequential_rule(spark):
    rng = random.Random(11)
    titles = ["-".join(rng.sample([f"w{i}" for i in range(40)], rng.randint(1, 3))) for _ in range(80)]
    df = spark.createDataFrame([("s", i, f"n{i}", t) for i, t in enumerate(titles)], "subject string, ord long, node_id string, title string")
    got = {r.node_id: r.opener for r in merging.open_chapters(df).collect()}
    assert got == {f"n{i}": f"n{j}" for i, j in _sequential(titles).items()}


SOURCE = "struct<source_id:int,publisher:string,book_slug:string,pages:array<int>,paragraph_ids:array<int>,authority_rank:int,ingested_at:string>"
TREE = f"subject string, node_id string, parent string, depth int, order int, name string, body string, sources array<{SOURCE}>, content_hash string"


def existing(spark):
    def leaf(path, parent, order, name, body):
        return ("geo", path, parent, 2, order, name, f"## Source 1 (page 3)\n\n{body}\n", [(1, "P", "b1", [3], [0], 2, "t0")], "h")

    rows = [
        ("geo", "geo", None, 0, 0, "Geo", "", None, "h"),
        ("geo", "geo/01-climate", "geo", 1, 1, "Climate", "", None, "h"),
        ("geo", "geo/02-rivers", "geo", 1, 2, "Rivers", "", None, "h"),
        leaf("geo/01-climate/01-monsoon", "geo/01-climate", 1, "Monsoon", "rain falls in the wet season over the hills"),
        leaf("geo/02-rivers/01-chambal", "geo/02-rivers", 1, "Chambal", "the river cuts deep ravines on its way north"),
    ]
    return spark.createDataFrame(rows, TREE)


def merge(spark, new, external=None):
    tree = existing(spark)
    fresh = spark.createDataFrame(
        [(i, "geo", f"new/{i}", t, b, [8, 9], [1, 2], "Q", "b2", 1) for i, (t, b) in enumerate(new)],
        "ord long, subject string, node_id string, title string, body string, pages array<int>, paragraph_ids array<int>, publisher string, book_slug string, authority_rank int",
    )
    shared = ["ord", "subject", "node_id", "title", "body", "is_new"]
    old = tree.filter("depth = 2").select(F.col("order").cast("long").alias("ord"), "subject", "node_id", F.col("name").alias("title"), "body", F.lit(False).alias("is_new"))
    signed = S.with_signature(fresh.withColumn("is_new", F.lit(True)))
    pairs = dedup.decide(S.leaf_pairs(signed.select(*shared).unionByName(old.select(*shared))))
    chapters = tree.filter("depth = 1").select("subject", F.col("node_id").alias("chapter_id"), F.col("order").alias("ord"), F.regexp_replace(T.last_segment(F.col("node_id")), r"^\d+-", "").alias("slug"))
    actions = merging.plan(signed, pairs, chapters, external)
    return {r.node_id: r for r in actions.collect()}, {r.node_id: r for r in merging.apply(tree, signed, actions, "t1").collect()}


def test_merge_appends_a_source(spark):
    twin = ("Monsoon", "rain falls in the wet season over the hills")
    actions, tree = merge(spark, [twin, twin])
    assert {a.action for a in actions.values()} == {"appended"}
    leaf = tree["geo/01-climate/01-monsoon"]
    assert [s.source_id for s in leaf.sources] == [1, 2, 3] and leaf.sources[0].publisher == "P"
    assert "## Source 2 (pages 8-9)\n\nrain falls" in leaf.body and "## Source 3 (" in leaf.body
    assert leaf.content_hash == spark.range(1).select(T.content_hash(F.lit(leaf.body)).alias("h")).first().h
    assert tree["geo/02-rivers/01-chambal"].content_hash == "h" and len(tree) == 5


def test_merge_adds_leaves_and_chapters(spark):
    actions, tree = merge(spark, [("Climate of the west", "dry and hot for most of the year"), ("Soil types", "red and black earth"), ("Soil erosion", "wind takes the top layer")])
    assert [actions[f"new/{i}"].action for i in range(3)] == ["added_leaf", "added_chapter", "added_leaf"]
    assert "geo/01-climate/02-climate-of-the-west" in tree
    assert tree["geo/03-soil-types"].depth == 1
    assert {"geo/03-soil-types/01-soil-types", "geo/03-soil-types/02-soil-erosion"} <= set(tree)
    assert tree["geo/03-soil-types/02-soil-erosion"].body.startswith("## Source 1 (pages 8-9)\n\nwind")


def test_external_chapter_choice_wins(spark):
    choice = spark.createDataFrame([("geo", "new/0", "geo/02-rivers")], "subject string, node_id string, chapter_id string")
    actions, tree = merge(spark, [("Climate notes", "nothing alike at all in this text")], choice)
    assert actions["new/0"].target == "geo/02-rivers" and "geo/02-rivers/02-climate-notes" in tree


def test_chapter_match_needs_a_shared_word(spark):
    leaves = spark.createDataFrame([("s", "n1", "Climate of Western Deserts"), ("s", "n2", "Birds")], "subject string, node_id string, title string")
    chapters = spark.createDataFrame([("s", "c1", 1, "climate"), ("s", "c2", 2, "rivers")], "subject string, chapter_id string, ord int, slug string")
    got = {r.node_id: r.chapter_id for r in merging.choose_chapter(leaves, merging.match_chapter(leaves, chapters)).collect()}
    assert got == {"n1": "c1", "n2": None}


@pytest.mark.parametrize("common", [0, 1, 3, 1000])
def test_chapter_match_with_common_words(spark, common):
    rng = random.Random(common)
    hot, cold = ["history", "of", "india", "state"], WORDS + [f"rare{chr(97 + i)}" for i in range(20)]
    slug = lambda: "-".join(dict.fromkeys(rng.sample(hot, rng.randint(0, 4)) + rng.choices(cold, k=rng.randint(0, 3)))) or "none"
    chapters = [(s, f"{s}/c{i}", (i * 7) % 60, slug()) for s in "xy" for i in range(60)]
    leaves = [(s, f"{s}/n{i}", slug().replace("-", " ")) for s in "xyz" for i in range(80)] + [("x", "x/hot", "history of india")]
    got = merging.match_chapter(spark.createDataFrame(leaves, "subject string, node_id string, title string"), spark.createDataFrame(chapters, "subject string, chapter_id string, ord int, slug string"), common)
    want = []
    for s, node, title in leaves:
        words = set(title.split())
        best = max(((len(words & set(c[3].split("-"))), -c[2], c[1]) for c in chapters if c[0] == s), default=(0, 0, ""))
        if best[0]:
            want.append((s, node, best[2], best[0]))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_a_word_of_all_chapters_forms_no_pairs(spark):
    """Leaves times chapters would be four million rows; the rows of every join are counted in the final plan."""
    chapters = spark.range(2000).select(F.lit("s").alias("subject"), F.concat(F.lit("c"), "id").alias("chapter_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("history-of-"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("slug"))
    leaves = spark.range(2000).select(F.lit("s").alias("subject"), F.concat(F.lit("n"), "id").alias("node_id"), F.concat(F.lit("History of x"), "id").alias("title"))
    out = merging.match_chapter(leaves, chapters)
    assert {(r.chapter_id, r.shared) for r in out.collect()} == {("c0", 2)}
    most, todo = 0, [out._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert 2000 <= most < 20_000


def test_pairs_are_exact_by_products_of_blocks(spark, monkeypatch):
    rows = [*leaf_rows(9, 90), (90, None, "n90", "alpha", "alpha beta", "x", True), (91, "s", "n91", "", "", "x", False)]
    rows = spark.createDataFrame(rows, LEAF)
    near = lambda dim: sorted(map(repr, S.leaf_pairs(rows, 0.6, S.hash_embedder(dim)).collect()))
    want, wide = near(1024), near(4096)
    monkeypatch.setattr(S, "FEW_MEETINGS", -1)
    monkeypatch.setattr(S, "MEETING_COST", math.inf)
    monkeypatch.setattr(S, "BLOCK", 3)
    monkeypatch.delattr(S, "_meeting_pairs")
    assert near(1024) == want and near(4096) == wide and len(want) > 5


@pytest.mark.parametrize("threshold", [0.0, 0.8])
def test_best_pairs_by_blocks(spark, monkeypatch, threshold):
    """Few pairs leave the blocks, the best of each new signature among them, also where several are as similar."""
    rng = random.Random(7)
    words = [f"word{c}{d}" for c in "abcdefgh" for d in "abcd"]
    text = lambda i: " ".join(rng.sample(words[:6], 4) if i % 3 else rng.sample(words, rng.randint(1, 12)))
    rows = [(i, "s" if i % 5 else "t", f"n{i}", text(i), text(i), i % 2 == 0) for i in rng.sample(range(1500), 600)]
    rows.append((2000, "s", "lone", "zzunknown", "zzunknown", True))
    leaves = spark.createDataFrame(rows, "ord long, subject string, node_id string, title string, body string, is_new boolean")
    monkeypatch.setattr(S, "FEW_MEETINGS", -1)
    monkeypatch.setattr(S, "MEETING_COST", 1e12)
    monkeypatch.setattr(S, "BLOCK", 16)
    every = S.leaf_pairs(leaves, threshold).withColumn("decision", F.lit("related"))
    some = S.leaf_pairs(leaves, threshold, best=True).withColumn("decision", F.lit("related"))
    shown = lambda pairs: sorted(tuple(r) for r in merging.best_match(pairs).select("new_sig", "existing_node", "existing_ord", "similarity").collect())
    assert shown(some) == shown(every)
    assert some.count() < every.count() / 2 and every.filter(F.col("similarity") <= 0).isEmpty() and every.filter("new_node = 'lone'").isEmpty()


def test_best_existing_match_is_the_most_similar_however_little(spark, tmp_path):
    from leafloom.plans.catalog import QUERIES
    from leafloom.session import Tables

    texts = {2: "alpha beta gamma", 4: "nothing shared here", 1: "alpha delta epsilon", 3: "alpha beta zeta", 5: "alpha beta zeta"}
    rows = [(i, text, "en", f"src{i % 2}") for i, text in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["best_existing_match"](Tables(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in found] == [("en/src0/d2", "en/src1/d3", round(2 / 3, 6))]


@pytest.mark.parametrize("threshold", [0.0, 0.7])
def test_best_pairs_of_cells_of_several_blocks(monkeypatch, threshold):
    monkeypatch.setattr(S, "BLOCK", 4)
    monkeypatch.setattr(S, "HELD_PAIRS", 8)
    rng = np.random.default_rng(3)
    rows, batches = [], []
    for cell in ("a", "b"):
        for old in (False, True):
            for _ in range(23):
                slots = rng.choice(6, rng.integers(1, 4), replace=False).tolist()
                rows.append({"_cell": cell, "_old": old, "vec": len(rows), "_slots": slots, "_weights": [len(slots) ** -0.5] * len(slots), "subject": "s",
                             "_leaf": {"sig": f"g{len(rows)}", "n": 1, "node": f"n{len(rows)}", "ord": None if rng.random() < 0.1 else int(rng.integers(1000))}})
    leaf = pa.struct([("sig", pa.string()), ("n", pa.int64()), ("node", pa.string()), ("ord", pa.int64())])
    kind = pa.schema([("_cell", pa.string()), ("_old", pa.bool_()), ("vec", pa.int64()), ("_slots", pa.list_(pa.int16())), ("_weights", pa.list_(pa.float64())), ("subject", pa.string()), ("_leaf", leaf)])
    for at in range(0, len(rows), 9):
        batches.append(pa.RecordBatch.from_pylist(rows[at : at + 9], kind))
    got = [r for b in S._products(threshold, True, True)(iter(batches)) for r in b.to_pylist()]
    order = lambda r: (-round(r["_cosine"], 6), math.inf if r["existing_ord"] is None else r["existing_ord"])
    first = {new: min((r for r in got if r["new_sig"] == new), key=order) for new in {r["new_sig"] for r in got}}
    every = [r for b in S._products(threshold, True)(iter(batches)) for r in b.to_pylist()]
    every = [r for r in every if r["_cosine"] > max(0, threshold - 1e-9)]
    want = {new: min((r for r in every if r["new_sig"] == new), key=order) for new in {r["new_sig"] for r in every}}
    assert len(want) > 30 and {k: order(v) for k, v in want.items()} == {k: order(first[k]) for k in want}
    assert len(got) < len(every) / 2


def test_many_edges_are_linked_to_one_per_vertex(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LINKED_AT_ONCE", 50)
    rng = random.Random(11)
    group = lambda i: i % 7 if i < 60 else i
    edges = [(f"v{a:03d}", f"v{b:03d}") for a in range(80) for b in range(80) if group(a) == group(b) and rng.random() < 0.9]
    edges += [("alone", "alone"), ("x", None), (None, "v001")]
    rng.shuffle(edges)
    batches = [pa.RecordBatch.from_pydict({"a": [e[0] for e in edges[at : at + 9]], "b": [e[1] for e in edges[at : at + 9]]}) for at in range(0, len(edges), 9)]
    linked = [(r["a"], r["b"]) for b in dedup._forest(iter(batches)) for r in b.to_pylist()]
    assert len(linked) < 85 < len(edges) / 4 and ("alone", "alone") in linked
    near: dict[str, set[str]] = {}
    for a, b in edges:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def least(v):
        seen, todo = {v}, [v]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        return min(seen)

    got = {r.id: r.component for r in dedup.components(spark.createDataFrame(edges, "a string, b string").repartition(5)).collect()}
    assert got == {v: least(v) for v in near}


def test_texts_of_clusters_are_not_joined(spark):
    rows = spark.createDataFrame([(1, "s", "n1", "a", "a long body", "NCERT", True, "g"), (2, "s", "n2", "b", "another body", "RBSE", False, "h")], "ord long, subject string, node_id string, title string, body string, publisher string, is_new boolean, sig string")
    pairs = spark.createDataFrame([("s", "g", "h")], "subject string, new_sig string, existing_sig string")
    joined = []
    real = dedup.stored
    try:
        dedup.stored = lambda df, label: joined.append((label, df.columns)) or real(df, label)
        got = sorted(tuple(r) for r in dedup.clusters(pairs, rows).collect())
    finally:
        dedup.stored = real
    assert got == [("n1", "s:e:h", "n1"), ("n2", "s:e:h", "n1")]
    assert ("members", ["id", "node_id", "_order", "component"]) in joined
