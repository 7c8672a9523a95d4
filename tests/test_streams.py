"""Streams over several batches, restarts, and what is kept between them."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from leafloom.sources.snapshots import COLUMNS, SCHEMA, SnapshotStore
from leafloom.streaming import ingest, jobs, state, turns

T0 = dt.datetime(2024, 1, 1)
JOB = "job_id string, event_id long, ts timestamp, event string, total_nodes int"
TURN = "turn_id string, ts timestamp, seq int, type string, id string, payload string, number int"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def deliver(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def totals(progress):
    """Rows in the state store after each batch that a query reports."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


def test_job_state_over_batches(spark, tmp_path):
    out, into = str(tmp_path / "out"), str(tmp_path / "in")
    batches = [
        [("a", 1, at(0), "queued", None), ("a", 2, at(1), "stage_start", None), ("b", 3, at(1), "queued", None)],
        [("a", 4, at(5), "pipeline_complete", 7), ("b", 5, at(4), "stage_progress", None)],
        [("a", 6, at(6), "stage_error", None), ("a", 7, at(3), "pipeline_complete", 5), ("c", 8, at(9), "stage_error", 3)],
    ]
    seen = []
    for rows in batches:
        got = jobs.run_job_state(deliver(spark, rows, JOB, into), out)
        seen += rows
        want = jobs.job_state(spark.createDataFrame(seen, JOB))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert {r.job_id: (r.state, r.total_nodes) for r in got.collect()} == {"a": ("complete", 5), "b": ("running", None), "c": ("failed", None)}
    assert got.filter("job_id = 'a'").first().completed_at == at(3)


def test_job_state_leaves_the_store_and_stays_in_the_result(spark, tmp_path):
    out, into = str(tmp_path / "out"), str(tmp_path / "in")
    query = lambda stream: stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: batch.count()).option("checkpointLocation", f"{out}-m").trigger(availableNow=True).start()
    first = [(f"j{i}", i, at(i % 5), "queued", None) for i in range(50)] + [("done", 90, at(2), "pipeline_complete", 4)]
    kept = []
    for rows in (first, [("later", 100, at(600), "queued", None)], [("last", 101, at(601), "queued", None)]):
        running = query(jobs.job_updates(deliver(spark, rows, JOB, into)))
        running.awaitTermination()
        kept.append(totals(running.recentProgress)[-1])
    assert kept[0] >= 51 and kept[-1] < 10  # values and timers of the old jobs are gone once the watermark has passed them
    again = str(tmp_path / "in2")
    for rows in (first, [("later", 100, at(600), "queued", None)], [("done", 102, at(600), "stage_start", None)]):
        got = jobs.run_job_state(deliver(spark, rows, JOB, again), out)
    assert got.filter("job_id = 'done'").first().state == "complete" and got.count() == 52


def event(turn, seq, kind, ident="", payload="", number=0, minute=0):
    return (turn, at(minute), seq, kind, ident, payload, number)


def test_turns_grow_by_batches_and_close(spark, tmp_path):
    out, into = str(tmp_path / "out"), str(tmp_path / "in")
    one = [event("t", 1, "tool-call", "c1", "rivers"), event("t", 20, "text-delta", payload="He"), event("u", 20, "text-delta", payload="x")]
    two = [event("t", 2, "tool-result", "c1", "All", 3, 1), event("t", 21, "text-delta", payload="llo", minute=1)]
    three = [event("t", 22, "data-citation", "c", "node 1", 1, 2), event("t", 23, "finish", minute=2)]
    four = [event("t", 24, "text-delta", payload="late", minute=3)]
    texts = []
    for rows in (one, two, three, four):
        got = {r.turn_id: r for r in turns.run_fold(deliver(spark, rows, TURN, into), out).collect()}
        texts.append((got["t"].text, got["t"].status, got["t"].tool_calls[0].hit_count))
    assert texts == [("He", "streaming", None), ("Hello", "streaming", 3), ("Hello", "complete", 3), ("Hello", "complete", 3)]
    assert got["u"].status == "streaming" and [tuple(c) for c in got["t"].citations] == [(1, "node 1")]


def test_turns_of_times_past_the_year_9999(spark, tmp_path):
    out, into = str(tmp_path / "out"), str(tmp_path / "in")
    hour, far = 3600, 300_000_000_000
    first = [("t", far, 1, "a"), ("old", 1, 1, "x")]
    second = [("t", far + 60, 2, "b"), ("z", far + 20 * hour, 1, "q")]
    third = [("t", far + 120, 3, "late"), ("new", far + 5, 1, "late"), ("z", far + 20 * hour - 60, 2, "r")]
    for rows in (first, second, third):
        made = spark.createDataFrame(rows, "turn_id string, s long, seq int, payload string")
        made = made.selectExpr("turn_id", "timestamp_seconds(s) AS ts", "seq", "'text-delta' AS type", "'' AS id", "payload", "0 AS number")
        made.coalesce(1).write.mode("append").parquet(into)
        got = turns.run_fold(spark.readStream.schema(made.schema).parquet(into), out)
    assert {r.turn_id: r.text for r in got.collect()} == {"t": "ab", "old": "x", "z": "qr"}


def test_turn_state_is_appended(spark, tmp_path):
    """A batch that adds one event to a long turn writes little state: the list is not written again."""
    out, into = str(tmp_path / "out"), str(tmp_path / "in")
    wrote = []
    for rows in ([event("t", i, "text-delta", payload="word " * 40) for i in range(3000)], [event("t", 5000, "text-delta", payload="end", minute=1)]):
        query = turns.fold_stream(deliver(spark, rows, TURN, into)).writeStream.outputMode("update").foreachBatch(lambda b, i: b.count()).option("checkpointLocation", out).trigger(availableNow=True).start()
        query.awaitTermination()
        wrote.append(sum(p["stateOperators"][0]["customMetrics"]["rocksdbTotalBytesWritten"] for p in query.recentProgress))
    assert wrote[0] > 3000 * 200 and wrote[1] < 2000


def test_updates_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "FOLD_EVERY", 3)
    updates = state.Updates(spark, str(tmp_path), "k string, v int", "k")
    for i in range(8):
        updates.save(spark.createDataFrame([(f"k{i % 3}", i), ("same", i)], "k string, v int"), i)
        if i == 4:
            updates.save(spark.createDataFrame([(f"k{i % 3}", i), ("same", i)], "k string, v int"), i)  # runs again
    assert {r.k: r.v for r in updates.latest().collect()} == {"k0": 6, "k1": 7, "k2": 5, "same": 7}
    assert sorted(p.name for p in (tmp_path / "base").iterdir()) == ["until=2", "until=5"]


LEAF = "ord long, subject string, book_slug string, node_id string, title string, body string, publisher string, pages array<int>, paragraph_ids array<int>, authority_rank int, chapter string"


def leaf(i, subject, title, body, chapter="One"):
    return (i, subject, "book", f"new/{i}", title, body, "p", [i], [0], 1, chapter)


def test_deliveries_touch_their_subjects_only(spark, tmp_path):
    root, progress, into = str(tmp_path / "store"), str(tmp_path / "progress"), str(tmp_path / "in")
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    assert ingest.run_merge(deliver(spark, [], LEAF, into), root, progress, "now") is None
    first = ingest.run_merge(deliver(spark, [leaf(1, "geo", "Rivers", long), leaf(2, "law", "Acts", "the water act"), leaf(3, None, "x", "y")], LEAF, into), root, progress, "now")
    store = SnapshotStore(spark, root)
    before = {r.node_id: r for r in store.read().collect()}
    assert {"geo", "geo/01-one", "geo/01-one/01-rivers", "law/01-one/01-acts"} <= set(before)
    kept = {p: p.stat().st_mtime_ns for p in Path(root, "data").rglob("*.parquet") if "s-law" in str(p)}
    # The next delivery appends to a leaf and opens a chapter in one subject.
    last = ingest.run_merge(deliver(spark, [leaf(4, "geo", "Rivers", long), leaf(5, "geo", "Deserts", "sand and more sand")], LEAF, into), root, progress, "then")
    after = {r.node_id: r for r in store.read().collect()}
    assert last == first + 1 and len(after["geo/01-one/01-rivers"].sources) == 2 and "geo/02-deserts/01-deserts" in after
    others = lambda rows: {k: v for k, v in rows.items() if v.subject != "geo"}
    assert others(after) == others(before)
    written = {p for p in Path(root, f"data/version={last}").rglob("*.parquet")}
    assert written and all("s-geo" in str(p) for p in written) and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    assert {r.node_id: r for r in store.read(first).collect()} == before
    # Nothing new: the last version stays; a batch that runs again writes the same version.
    assert ingest.run_merge(spark.readStream.schema(LEAF).parquet(into), root, progress, "then") == last
    batch = spark.createDataFrame([leaf(4, "geo", "Rivers", long), leaf(5, "geo", "Deserts", "sand and more sand")], LEAF)
    ingest.merge_batch(batch, store, first, last, "then")
    assert {r.node_id: r for r in store.read().collect()} == after and store.latest() == last


def test_judge_and_classifier_in_a_batch(spark, tmp_path):
    root, progress, into = str(tmp_path / "store"), str(tmp_path / "progress"), str(tmp_path / "in")
    words = [f"word{chr(97 + i)}" for i in range(20)]
    ingest.run_merge(deliver(spark, [leaf(1, "geo", "Rivers", " ".join(words), "Water"), leaf(2, "geo", "Peaks", "granite quartz", "Hills")], LEAF, into), root, progress, "now")
    near = " ".join(words[:17] + ["otherx", "othery", "otherz"])  # in the grey zone
    said = []
    judge = lambda pairs: said.append(pairs.count()) or pairs.select("new_sig", "existing_sig", F.lit("duplicate").alias("verdict"))
    classify = lambda leaves, chapters: leaves.filter("title = 'Dunes'").select("subject", "node_id", F.lit("geo/02-hills").alias("chapter_id"))
    ingest.run_merge(deliver(spark, [leaf(3, "geo", "Rivers", near), leaf(4, "geo", "Dunes", "sand")], LEAF, into), root, progress, "then", judge, classify)
    after = {r.node_id: r for r in SnapshotStore(spark, root).read().collect()}
    assert said == [1] and len(after["geo/01-water/01-rivers"].sources) == 2 and "geo/02-hills/02-dunes" in after


def test_a_subject_of_a_null_key_is_kept(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    none = dict.fromkeys(COLUMNS)
    store.commit(spark.createDataFrame([tuple((none | {"node_id": "n", "subject": s}).values()) for s in (None, "", "a/b", "x=y")], SCHEMA), 0, None)
    assert {r.subject for r in store.read().collect()} == {None, "", "a/b", "x=y"}
    store.commit(spark.createDataFrame([], SCHEMA), 1, 0)
    assert store.latest() == 1 and store.read().count() == 4


def test_tables_of_one_file_and_of_many_stream_alike(spark, tmp_path):
    from leafloom.plans import catalog, source_queries  # noqa: F401

    rows = spark.range(20).withColumnRenamed("id", "vec_id")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/pages.parquet")
    next((tmp_path / "one").glob("part-*.parquet")).rename(tmp_path / "pages.parquet")
    for directory in (tmp_path, tmp_path / "many"):
        got = ingest.run_append(source_queries.StreamTables(spark, str(directory))("pages"), "copied")
        assert sorted(r.vec_id for r in got.collect()) == list(range(20))
