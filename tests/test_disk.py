"""Bytes that a step leaves in the shared folder."""

from __future__ import annotations

import random
from pathlib import Path

from leafloom.operators import similarity as S
from leafloom.session import prepare, shared_dir
from leafloom.sources.snapshots import SnapshotStore
from leafloom.streaming import ingest


def _bytes(spark) -> int:
    return sum(p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*") if p.is_file())


def test_vectors_are_kept_in_few_bytes(spark):
    dice = random.Random(3)
    rows = [("s", i, f"n{i}", "t", " ".join(f"w{dice.randrange(5000)}" for _ in range(80)), i % 2 == 0) for i in range(800)]
    leaves = spark.createDataFrame(rows, "subject string, ord int, node_id string, title string, body string, is_new boolean")
    before = _bytes(spark)
    S.leaf_pairs(leaves).count()
    entries = 800 * 78  # about: words of a leaf, less those that share a slot
    assert _bytes(spark) - before < 30 * entries


def test_pairs_with_their_cosine_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(S, "FEW_MEETINGS", -1)
    monkeypatch.setattr(S, "MEETING_COST", float("inf"))
    rows = [("s", i, f"n{i}", "t", f"one two three four w{i // 4}", i % 2 == 0) for i in range(40)]
    leaves = spark.createDataFrame(rows, "subject string, ord int, node_id string, title string, body string, is_new boolean")
    pairs = S.leaf_pairs(leaves)
    above, _ = pairs._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")
    assert "Join" not in above and pairs.count() == pairs.filter("new_sig is not null and existing_node is not null").count() > 0


def test_a_merge_keeps_bodies_few_times(spark, tmp_path):
    dice = random.Random(5)
    columns = "subject string, ord bigint, node_id string, title string, body string, pages array<int>, paragraph_ids array<int>, publisher string, book_slug string, authority_rank int"
    rows = [("s", i, f"n{i}", f"t{i}", f"{dice.randbytes(2000).hex()}", [1], [0], "p", f"b{i // 300}", 1) for i in range(600)]
    size, before = 600 * 4000, _bytes(spark)
    for half in (rows[:300], rows[300:]):
        spark.createDataFrame(half, columns).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(columns).parquet(f"{tmp_path}/in")
        ingest.run_merge(stream, f"{tmp_path}/store", f"{tmp_path}/progress", "2024-01-01T00:00:00Z")
    assert SnapshotStore(spark, f"{tmp_path}/store").read().filter("depth = 2").count() == 600
    assert _bytes(spark) - before < 1.5 * size


def test_shuffle_files_go_with_their_job(spark):
    prepare(spark)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
