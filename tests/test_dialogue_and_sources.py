import json

import pytest
from pyspark.sql import functions as F

from leafloom import constants as K
from leafloom.functions.model_json import extract_json_object, parse_decision
from leafloom.operators import dialogue as D
from leafloom.operators import migration
from leafloom.sources import files, sinks, tables

MESSAGE = "conv_id int, turn int, role string, text string"


def talk(spark, *messages):
    return spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(messages)], MESSAGE)


def tool(n):
    return ("user", f"{K.TOOL_RESULT_PREFIX}, scope=all)\n[1] hit {n}")


def texts(df):
    return [(r.role, r.text) for r in df.orderBy("turn").collect()]


def test_token_estimate(spark):
    assert D.token_estimate(talk(spark, ("user", "a" * 400), ("assistant", "b" * 803))).first().tokens == 300


@pytest.mark.parametrize("keep, cleared", [(1, [1, 3]), (3, []), (0, [1, 3, 5]), (2, [1])])
def test_clearing_keeps_the_last_results(spark, keep, cleared):
    df = talk(spark, ("system", "s"), tool(1), ("assistant", "a"), tool(2), ("user", "plain"), tool(3))
    rows = D.clear_old_tool_results(df, keep).collect()
    assert sorted(r.turn for r in rows if r.cleared) == cleared
    assert all((r.text == K.CLEARED_PLACEHOLDER) == r.cleared for r in rows)


def summary(spark, text):
    return spark.createDataFrame([(1, text)], "conv_id int, summary string")


def test_compaction(spark):
    long = [("system", "rules")] + [(r, f"{r} {i}") for i in range(4) for r in ("user", "assistant")]
    out = texts(D.apply_compaction(D.compaction_plan(talk(spark, *long)), summary(spark, "x <SUMMARY> so\nfar </summary> y")))
    assert out == [("system", "rules"), ("system", "<conversation_so_far>\nso\nfar\n</conversation_so_far>"), ("user", "user 2"), ("assistant", "assistant 2"), ("user", "user 3"), ("assistant", "assistant 3")]
    short = long[:5]
    assert texts(D.apply_compaction(D.compaction_plan(talk(spark, *short)), summary(spark, "s"))) == short


def test_thresholds(spark):
    small = [("system", "rules")] + [(r, "word") for _ in range(4) for r in ("user", "assistant")]
    assert texts(D.manage_context(talk(spark, *small), summary(spark, "s"))) == small
    big = [("system", "rules"), tool("x" * 40000), ("user", "q1"), tool("y"), tool("z"), tool("w"), ("assistant", "a"), ("user", "q2")]
    out = texts(D.manage_context(talk(spark, *big), summary(spark, "s")))
    assert out[1] == ("user", K.CLEARED_PLACEHOLDER) and len(out) == len(big)


def test_last_user_turn_and_guard(spark):
    rows = D.last_user_turn(talk(spark, ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"))).collect()
    assert [r.turn for r in rows if r.is_question] == [2] and len(rows) == 4
    assert D.last_user_turn(talk(spark, ("assistant", "b"))).count() == 0
    looks = spark.createDataFrame([(1, 1, "salt lakes"), (1, 2, "Lakes, salt of"), (1, 3, "a"), (1, 4, "b"), (2, 1, "salt lakes")], "turn_id int, step int, query string")
    assert sorted((r.turn_id, r.step) for r in D.duplicate_query_guard(looks).collect() if r.blocked) == [(1, 2)]


def test_step_budget(spark):
    steps = spark.createDataFrame([(1, 1, "lookup", None), (1, 2, "answer", "yes"), (2, 5, "answer", "late"), (3, 1, "answer", "")], "turn_id int, step int, action string, text string")
    got = {r.turn_id: r.answer for r in D.step_budget(steps).collect()}
    assert got == {1: "yes", 2: K.NO_ANSWER_FALLBACK, 3: "(no answer text)"}


@pytest.mark.parametrize(
    "reply, json_text, error",
    [
        ('{"a": 1}', '{"a": 1}', None),
        ('```json\n{"a": 1}\n```', '{"a": 1}', None),
        ("```\n[1]\n```", "[1]", None),
        ('Sure: {"a": {"b": 2}} done', '{"a": {"b": 2}}', None),
        ("", None, "empty"),
        ("none", None, "no object"),
        ('x {"a": 1', None, "unbalanced"),
        ("x {a} y", None, "invalid"),
    ],
)
def test_json_extraction(spark, reply, json_text, error):
    row = spark.createDataFrame([(reply,)], "r string").select(extract_json_object("r").alias("x")).first().x
    assert (row.json, row.error) == (json_text, error)


@pytest.mark.parametrize(
    "raw, action",
    [
        ('{"action": "lookup", "query": "x", "scope": "subject"}', "lookup"),
        ('```json\n{"action": "answer", "text": "x"}\n```', "answer"),
        ('hm <|tool_call|>{"action": "lookup", "query": "x"}<|/tool_call|>', "lookup"),
        ('{"action": "dance"}', None),
        ('{"action": "lookup", "scope": "planet"}', None),
        ("no json", None),
    ],
)
def test_decisions(spark, raw, action):
    row = spark.createDataFrame([(raw,)], "r string").select(parse_decision(F.col("r")).alias("d")).first().d
    assert (row.action if row else None) == action


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xc3\xa9 \xff")
    (tmp_path / "b.TXT").write_text("  \n")
    rows = {r.source_path.rsplit("/", 1)[-1]: (r.text, r.page, r.part, r.page_count) for r in files.load_text_sources(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": ("caf\u00e9 \ufffd", 1, 0, 1), "b.TXT": ("  \n", 1, 0, 0)}
    (tmp_path / "c.docx").write_text("x")
    with pytest.raises(Exception, match="unsupported source type"):
        files.load_text_sources(spark, str(tmp_path)).collect()


def test_a_large_text_file_is_read_by_many_tasks(spark, tmp_path):
    texts = {
        "one file.txt": "\n".join(f"line {i} \u00e9\u65e5\u672c\r" if i % 3 else "" for i in range(3000)),
        "two.txt": "\n\n\n" + "x" * 5000 + "\n" + "\u00e9" * 3000 + "\n",
        "blank.txt": " \n" * 900,
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.load_text_sources(spark, str(tmp_path), part_chars=1000).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        own = sorted((r for r in rows if r.source_path.replace("%20", " ").endswith(name)), key=lambda r: r.part)
        assert "".join(r.text for r in own) == text and [r.part for r in own] == list(range(len(own)))
        assert {r.page_count for r in own} == {0 if name == "blank.txt" else 1} and len(own) > 1


def test_skill_files_round_trip(spark, tmp_path):
    rows = [("geo", "geo", None, 0, "Geo", "root"), ("geo", "geo/01-hills", "geo", 1, "Hills", "in"), ("geo", "geo/01-hills/01-peaks", "geo/01-hills", 2, 'A "peak": #1', "text\n---\nmore"), ("geo", "geo/02-lone", "geo", 1, "Lone", "leaf")]
    nodes = spark.createDataFrame(rows, "subject string, node_id string, parent string, depth int, name string, body string")
    for _ in range(2):  # again: the same files
        sinks.write_skill_folder(nodes, (tmp_path / "skills").as_uri())
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.md")) == ["skills/geo/01-hills/01-peaks.md", "skills/geo/01-hills/SKILL.md", "skills/geo/02-lone.md", "skills/geo/SKILL.md"]
    back = files.load_skill_folder(spark, str(tmp_path / "skills"))
    assert sorted(map(tuple, back.select("subject", "node_id", "parent", "depth", "name", "body").collect()), key=lambda r: r[1]) == rows
    assert {r.node_id for r in back.filter("is_leaf").collect()} == {"geo/01-hills/01-peaks", "geo/02-lone"}


def test_skill_folder(spark, tmp_path):
    root = tmp_path / "skills"
    (root / "geo" / "01-hills").mkdir(parents=True)
    (root / "geo" / "drafts").mkdir()
    (root / "geo.v2").mkdir()
    (root / "geo" / "SKILL.md").write_text("---\nname: Geo\ndepth: 0\nsubject_scope: mars\n---\nroot body")
    (root / "geo.v2" / "SKILL.md").write_text("---\nname: Old\n---\nx")
    (root / "geo" / "01-hills" / "SKILL.md").write_text("no front matter")
    (root / "geo" / "drafts" / "x.md").write_text("skipped")
    (root / "geo" / "01-hills" / "01-peaks.md").write_text(
        "---\nname: 'Peaks: high'\nnode_id: geo/01-hills/01-peaks\ndepth: 2\nsources:\n- publisher: P\n  book_slug: b\n  source_id: 1\n  pages: [3, x, 4]\n- publisher: R\n---\n\nbody --- here\n"
    )
    (root / "geo" / "01-hills" / "02-bad.md").write_text("---\nname: [broken\n---\nbody")
    (root / "geo" / "02-none").mkdir()
    (root / "geo" / "02-none" / "01-lost.md").write_text("a chapter folder without a SKILL file")
    rows = files.load_skill_folder(spark, str(root)).cache()
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {"geo", "geo.v2", "geo/01-hills", "geo/01-hills/01-peaks", "geo/01-hills/02-bad"}
    leaf = got["geo/01-hills/01-peaks"]
    assert (leaf.name, leaf.publisher, leaf.book_slug, leaf.sources[0].pages, leaf.body, leaf.is_leaf) == ("Peaks: high", "P", "b", [3, 4], "body --- here", True)
    assert got["geo"].subject_scope == "pan_india" and got["geo/01-hills"].body == "no front matter"
    assert got["geo/01-hills/02-bad"].error is not None
    assert [r.subject for r in files.list_subjects(rows).collect()] == ["geo"]
    manifest = tmp_path / "manifest.json"
    manifest.write_text(json.dumps([{"slug": "g", "name": "G", "skill_folder": "skills/geo"}, {"slug": "x", "skill_folder": "skills/none"}, {"slug": "y"}]))
    cards = {r.slug: (r.name, r.total_nodes, r.total_leaves, r.available) for r in files.load_manifest(spark, str(manifest), rows).collect()}
    assert cards == {"g": ("G", 4, 2, True), "x": ("x", 0, 0, False)}


def test_tree_table_refuses_to_overwrite(spark, tmp_path):
    path = str(tmp_path / "tree")
    one = spark.createDataFrame([("geo", "n1"), ("law", "n2")], "subject string, node_id string")
    sinks.write_skill_tree(one, path)
    with pytest.raises(sinks.SubjectExistsError):
        sinks.write_skill_tree(one.filter("subject = 'geo'"), path)
    sinks.write_skill_tree(spark.createDataFrame([("geo", "n3")], "subject string, node_id string"), path, replace=True)
    sinks.write_skill_tree(spark.createDataFrame([("art", "n4")], "subject string, node_id string"), path)
    assert sorted(r.node_id for r in spark.read.parquet(path).collect()) == ["n2", "n3", "n4"]


def test_frames(spark):
    lines = ["data: {\"type\": \"a\", \"n\": 1}", "", "data: [DONE]", "data: {oops", "event: x", "data: "]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [(r.type, r.n) for r in files.event_frames(df, "type string, n int").collect()] == [("a", 1)]


def test_hosts_and_bookmarks(spark):
    urls = ["https://ncert.nic.in/a", "http://NCERT.nic.in", "https://evil.example/ncert.nic.in", "not a url"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.x for r in df.select(tables.allowed_source(F.col("u")).alias("x")).collect()] == [True, True, False, False]
    marks = spark.createDataFrame([(1, 1, " A ", 1), (1, 0, "B", 1), (1, 1, "C", 0), (1, 1, None, 2), (1, 2, "\t", 2)], "doc_id int, level int, title string, page int")
    assert [r.title for r in tables.valid_bookmarks(marks).collect()] == ["A"]


def test_chapter_files_run_on(spark):
    df = spark.createDataFrame([("b", "02.pdf", 1), ("b", "01.pdf", 1), ("b", "01.pdf", 2), ("b", "10.pdf", 1)], "book string, file string, page int")
    got = {(r.file, r.page): r.book_page for r in tables.concat_chapter_files(df, "book", "file", "page").collect()}
    assert got == {("01.pdf", 1): 1, ("01.pdf", 2): 2, ("02.pdf", 1): 3, ("10.pdf", 1): 4}


def test_migration(spark):
    schema = "node_id string, parent string, depth int, order int, name string, description string, body string, source_pages array<int>, content_hash string, ingested_at string, is_leaf boolean"
    rows = [
        ("geo/old", None, 0, 0, "Press: geo", "", "## Contents", None, "h0", "t", False),
        ("geo/old/01-a/01-b", "geo/old/01-a", 2, 1, "B", "", "A paragraph of good length.\n\nshort", [5, 4], "h1", "t", True),
        ("elsewhere/x", "elsewhere", 2, 1, "X", "", "A paragraph of good length.", None, "h2", "t", True),
    ]
    out = migration.migrate(spark.createDataFrame(rows, schema), F.lit("geo"), F.lit("old"), F.lit("new_geo"), F.lit("P"), F.lit(2), "now")
    got = {r.node_id: r for r in out.collect()}
    assert got["new_geo"].name == "New Geo" and got["new_geo"].sources[0].content_hash == "h0"
    leaf = got["new_geo/01-a/01-b"]
    assert leaf.parent == "new_geo/01-a" and leaf.body.startswith("## Source 1 (pages 4-5)\n\nA paragraph")
    assert leaf.sources[0].paragraph_ids == [0] and leaf.sources[0].content_hash == "h1"
    assert "elsewhere/x" in got
    counts = migration.migration_counts(out).first()
    assert (counts.leaves_written, counts.index_nodes_written) == (2, 1)
    again = migration.migrate(out, F.lit("geo"), F.lit("old"), F.lit("new_geo"), F.lit("P"), F.lit(2), "later")
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_migration_of_mixed_rows_keeps_metadata_and_whole_segments(spark):
    schema = "node_id string, parent string, depth int, order int, name string, description string, body string, is_leaf boolean, ingestion_version string, superseded_by string, subject_scope string, related_skills array<string>"
    rows = [
        ("geo/old/01-a/01-b", "geo/old/01-a", 2, 1, "B", "", "A paragraph of good length.", True, None, None, "state", ["x"]),
        ("geo/old2/01-a", "geo/old2", 2, 1, "C", "", "A paragraph of good length.", True, "v2", None, None, None),
        ("new_geo/03-c/01-d", "new_geo/03-c", 2, 1, "D", "", "## Source 1 (page 5)\n\nDone before.", True, K.SCHEMA_VERSION, "new_geo/x", "pan_india", None),
    ]
    got = {r.name: r for r in migration.migrate(spark.createDataFrame(rows, schema), F.lit("geo"), F.lit("old"), F.lit("new_geo"), F.lit("P"), F.lit(2), "now").collect()}
    assert got["B"].node_id == "new_geo/01-a/01-b" and got["B"].subject_scope == "state" and got["B"].related_skills == ["x"]
    assert got["C"].node_id == "geo/old2/01-a"
    assert (got["D"].body, got["D"].superseded_by, got["D"].node_id) == ("## Source 1 (page 5)\n\nDone before.", "new_geo/x", "new_geo/03-c/01-d")


def test_proposed_trees_of_any_depth_and_bad_replies(spark):
    tree = None
    for level in reversed(range(9)):
        tree = {"title": f"t{level}", "description": "", "paragraph_start": level, "paragraph_end": level, "children": [tree] if tree else []}
    replies = [(1, json.dumps({"root": tree})), (2, "no tree here"), (3, '{"root": {"title": 5'), (4, '{"other": 1}'), (5, None)]
    rows = files.read_proposed_trees(spark.createDataFrame(replies, "doc_id int, reply string")).collect()
    assert sorted((r.depth, r.title) for r in rows if r.doc_id == 1) == [(k, f"t{k}") for k in range(9)]
    assert {r.doc_id: r.error for r in rows if r.doc_id != 1} == {2: "no object", 3: "unbalanced", 4: "no tree", 5: "empty"}


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for name in ("a/SKILL.md", "a/b/c/d/deep %41 é.md", "_hidden/x.md", "a/.draft/x.md", "a/_x.md", "a/note.txt", "top.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    for root in (str(tmp_path), tmp_path.as_uri()):
        with monkeypatch.context() as m:
            m.delattr(type(spark.read), "text")
            got = files.read_texts(files.list_files(spark, root, ".md")).collect()
        names = ["a/SKILL.md", "a/b/c/d/deep %41 é.md", "top.md"]
        assert sorted((r.source_path, r.value) for r in got) == [(f"{tmp_path}/{n}", n + "\ufffd") for n in names]
