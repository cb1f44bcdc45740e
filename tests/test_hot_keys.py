"""Keys that hold most rows: cut into slices, with sums carried from slice to slice; the same rows as by one sort."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import matching as mt
from tidemark.operators import reports as rp
from tidemark.operators import sequences as sq

from .moved import shuffled


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.random(), 0.5]), k, rng.randint(0, 5)) for k in range(3000)]
    got = {r.i: (r.before, r.total) for r in sq.running(spark.createDataFrame(rows, "k string, v double, i long, n long"), ["k"], ["v", "i"], F.col("v"), F.col("n"), "before", "total").collect()}
    for key in ("hot", "a", None):
        total, own = 0, sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for _, _, i, n in own:
            assert got[i] == (total, sum(r[3] for r in own))
            total += n


def test_a_hot_key_lies_in_many_slices(spark):
    rows = spark.range(20_000).selectExpr("if(id % 5 = 0, 'a', 'hot') as k", "id", "pow(id, 3) as v")
    per = sq.sliced(rows, F.col("v")).groupBy("_slice").count().collect()
    assert len(per) == sq.SLICES and max(r["count"] for r in per) < 3 * 20_000 / sq.SLICES
    assert sq.sliced(rows.limit(0), F.col("v")).count() == 0


def test_latest_value_across_slices(spark):
    rng = random.Random(2)
    left = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(4000), k) for k in range(1500)]
    right = [(rng.choice(["hot", "a", None]), rng.randrange(4000), rng.choice([None, 1, 2])) for _ in range(40)]
    got = sq.asof(spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, v int"), ["k"], "t", ["v"])
    expected = {}
    for k, t, i in left:
        held = [(u, v is not None, v or 0, v) for q, u, v in right if q == k and u <= t]
        expected[i] = max(held, key=lambda h: h[:3])[3] if held else None
    assert {r.i: r.v for r in got.collect()} == expected


def test_low_half_of_a_hot_key(spark):
    import statistics

    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), rng.choice([None, 1.0, rng.random() * 9]), float(rng.randrange(7))) for _ in range(2501)] + [("c", 1.0, 4.0)]
    got = {r.k: (r.median, r.n_low) for r in rp.low_half(spark.createDataFrame(rows, "k string, o double, v double"), "o", "v", ["k"]).collect()}
    for key in ("hot", "b", "c"):
        own = sorted((o, v) for k, o, v in rows if k == key and o is not None)
        half = [v for _, v in own[: -(-len(own) // 2)]]
        assert got[key] == (statistics.median(half), len(half))


def test_parts_of_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id < 10, 'a', 'hot') as k", "id as t")
    got = sq.parts_of(rows, ["k"], ["t"], F.col("t"), 100, 300).groupBy("k", "part").agg(F.count("*").alias("n"), F.min("t").alias("least")).collect()
    assert {(r.k, r.part, r.n, r.least) for r in got} == {("a", 0, 10, 0)} | {("hot", k, min(300, 4990 - 300 * k), 10 + 300 * k) for k in range(17)}


def test_texts_stay_out_of_the_word_join(spark):
    texts = [(k, " ".join(f"w{(k * j) % 53}" for j in range(60))) for k in range(50)] + [(99, "w1 w2"), (98, None)]
    items = [(0, "w1 w2 w3 w4"), (1, "w2 w4 w6"), (2, "w50 w1"), (3, "w7"), (4, "nowhere w1 to find")]
    got = mt.containing(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(items, "j long, x string"), "t", "x")
    assert {(r.i, r.j) for r in got.collect()} == {(i, j) for i, t in texts for j, x in items if t and x in t}


def test_parents_of_positions(spark):
    rng = random.Random(7)
    children = [(rng.choice("uv"), rng.randrange(5000)) for _ in range(300)] * 2
    spans = []
    for k in range(40):
        first = rng.randrange(5000)
        spans.append((rng.choice("uv"), first, first + rng.choice([0, 50, 3000]), k))
    got = sq.parents(spark.createDataFrame(children, "v string, at long"), spark.createDataFrame(spans, "v string, first long, last long, place long"), ["v"], "at", "first", "last", "place").collect()
    assert sorted((r.v, r.at, r.place if r.place is not None else -1) for r in got) == sorted((v, at, max((p for w, a, b, p in spans if w == v and a <= at <= b), default=-1)) for v, at in children)


def test_long_spans_are_not_spread(spark):
    far = 50_000_000
    spans = spark.createDataFrame([("u", k, far + k, k) for k in range(5)] + [("u", 7, 7, 9), ("u", 9, 8, 10)], "v string, first long, last long, place long")
    children = spark.createDataFrame([("u", at) for at in (0, 3, 7, 9, far // 2, far + 2, far + 9)], "v string, at long")
    got = sq.parents(children, spans, ["v"], "at", "first", "last", "place")
    rows, _ = shuffled(spark, lambda: got.write.format("noop").mode("overwrite").save())
    assert {(r.at, r.place) for r in got.collect()} == {(0, 0), (3, 3), (7, 9), (9, 4), (far // 2, 4), (far + 2, 4), (far + 9, None)}
    assert rows < 200  # 50,000 cells of 1024 positions a span before
