"""Block-wise ordered operators against plain Python, with blocks far smaller than the groups."""

import random

from pyspark.sql import functions as F

from leafloom.operators import ordered


def _rows(seed):
    rng = random.Random(seed)
    return [(k, o, rng.randint(0, 9)) for k in "ab" for o in rng.sample(range(500), 60 if k == "a" else 5)]


def test_prefix_sum_and_ordinal(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): (r.s, r.n) for r in ordered.ordinal(ordered.prefix_sum(df, ["k"], "o", F.col("v"), "s", 7), ["k"], "o", "n", 7).collect()}
    for k, o, _ in rows:
        before = [v for kk, oo, v in rows if kk == k and oo < o]
        assert got[(k, o)] == (sum(before), len(before))


def test_neighbour_crosses_blocks(spark):
    rows = _rows(2)
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = ordered.neighbour(df, ["k"], "o", {"p": F.col("v")}, -1, block=5)
    got = {(r.k, r.o): (r.p, r.q) for r in ordered.neighbour(got, ["k"], "o", {"q": F.col("v")}, 1, block=5).collect()}
    for k in "ab":
        line = sorted((o, v) for kk, o, v in rows if kk == k)
        for i, (o, _) in enumerate(line):
            assert got[(k, o)] == (line[i - 1][1] if i else None, line[i + 1][1] if i + 1 < len(line) else None)


def test_global_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"))
    got = {r.x: r.place for r in ordered.global_order(df, ["x"], "place").collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_rank_limit_reaches_the_map_side(spark, capsys):
    df = spark.createDataFrame(_rows(3), "k string, o int, v int")
    ordered.best_per_key(df, ["k"], [F.col("o")], 3).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
