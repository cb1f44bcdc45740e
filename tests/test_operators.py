from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry as geo
from tidemark.operators import evaluation as ev
from tidemark.operators import matching as mt
from tidemark.operators import sequences as sq

BOXES = "pair int, side string, ordinal int, x0 int, y0 int, x1 int, y1 int, text string, touched boolean"


def boxes(spark, rows):
    return spark.createDataFrame(rows, BOXES).select("pair", "side", "ordinal", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "text", "touched")


def test_keystroke_is_appended(spark):
    made = boxes(spark, [(1, "a", 1, 10, 10, 110, 28, "Title", False), (1, "a", 2, 10, 50, 130, 68, "PS>", True), (1, "a", 3, 300, 150, 330, 168, "x", False), (1, "b", 1, 10, 10, 110, 28, "Title", False), (1, "b", 2, 10, 50, 230, 68, "PS> git status", True)])
    got = {(r.i, r.j): r.kind for r in mt.track(made).collect()}
    assert got == {(1, 1): "unchanged", (2, 2): "appended", (3, None): "flicker_lost"}


def test_moves_pair_kth_with_kth(spark):
    made = boxes(spark, [(1, "a", k, 0, 100 * k, 50, 100 * k + 18, "same", True) for k in (1, 2, 3)] + [(1, "b", k, 300, 100 * k, 350, 100 * k + 18, "same", True) for k in (1, 2)])
    got = {(r.i, r.j): r.kind for r in mt.track(made).collect()}
    assert got == {(1, 1): "moved", (2, 2): "moved", (3, None): "removed"}


def test_touched_by_pixels(spark):
    made = boxes(spark, [(1, "a", 1, 10, 50, 130, 68, "PS>", False), (1, "a", 2, 300, 150, 330, 168, "x", False), (2, "a", 1, 0, 0, 9, 9, "y", False)]).drop("touched")
    pixels = spark.createDataFrame([(1, 140 - 5, 52)], "pair int, x int, y int")
    got = {(r.pair, r.ordinal): r.touched for r in mt.touched(made, pixels, 0.5, 400, 200).collect()}
    assert got == {(1, 1): True, (1, 2): False, (2, 1): True}  # pair 2 was not compared


def test_every_box_ends_up_once(spark):
    rng = random.Random(5)
    rows = []
    for pair in range(20):
        for side in "ab":
            for k in range(rng.randint(0, 9)):
                x, y = rng.randint(0, 300), rng.randint(0, 200)
                rows.append((pair, side, k, x, y, x + rng.randint(5, 150), y + 18, rng.choice("abc"), rng.random() < 0.5))
    got = mt.track(boxes(spark, rows)).collect()
    assert sorted((r.pair, r.i) for r in got if r.i is not None) == sorted((r[0], r[2]) for r in rows if r[1] == "a")
    assert sorted((r.pair, r.j) for r in got if r.j is not None) == sorted((r[0], r[2]) for r in rows if r[1] == "b")


def test_overlap_join_finds_each_pair_once(spark):
    rng = random.Random(9)
    rect = lambda: (x := rng.randint(0, 500), y := rng.randint(0, 500), x + rng.randint(1, 300), y + rng.randint(1, 300))
    a, b = [(1, k, *rect()) for k in range(30)], [(1, k, *rect()) for k in range(30)]
    frame = lambda rows, n: spark.createDataFrame(rows, "p int, k int, x0 int, y0 int, x1 int, y1 int").select("p", F.col("k").alias(n), F.struct("x0", "y0", "x1", "y1").alias(f"{n}_box"))
    got = sorted((r.i, r.j, r.area) for r in geo.overlap_join(frame(a, "i"), frame(b, "j"), ["p"], "i_box", "j_box").collect())
    expected = sorted((i, j, w * h) for _, i, *p in a for _, j, *q in b if (w := min(p[2], q[2]) - max(p[0], q[0])) > 0 and (h := min(p[3], q[3]) - max(p[1], q[1])) > 0)
    assert got == expected


def test_greedy_order(spark):
    made = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 9.0), (1, 2, 2, 9.0), (1, 2, 1, 1.0), (2, 7, 7, 0.5)], "g int, i int, j int, area double")
    assert sorted((r.g, r.i, r.j) for r in mt.greedy_pairs(made, ["g"]).collect()) == [(1, 1, 2), (1, 2, 1), (2, 7, 7)]


def test_sequences(spark):
    rows = spark.createDataFrame([("u", t, v) for t, v in enumerate("aabba")], "k string, t int, v string")
    assert [r.island for r in sq.islands(rows, ["k"], ["t"], "v").orderBy("t").collect()] == [1, 1, 2, 2, 3]
    assert [(r.t, r.hold) for r in sq.reverts(spark.createDataFrame([("u", 0, "a"), ("u", 2, "b"), ("u", 5, "a")], "k string, t int, v string"), ["k"], ["t"], "v", "t").collect()] == [(5, 3)]
    assert sorted((r["first"], r["last"]) for r in sq.ranges(spark.createDataFrame([("u", x) for x in (0, 1, 2, 5, 5)], "k string, n int"), ["k"], "n").collect()) == [(0, 2), (5, 5)]
    m = sq.majority(spark.createDataFrame([("u", 0, "y"), ("u", 1, "x"), ("u", 2, "x"), ("u", 3, "y")], "k string, t int, v string"), ["k"], "v", "t").first()
    assert (m.majority, m.majority_n) == ("y", 2)


@pytest.mark.parametrize(("n", "expected"), [(0, []), (3, [(0, 2)]), (6, [(0, 5)]), (7, [(0, 5), (4, 6)]), (12, [(0, 5), (4, 9), (8, 11)])])
def test_windows(spark, n, expected):
    assert sq.index_windows(n, 6, 2) == expected
    made = sq.windows_of(spark.range(n).selectExpr("1 as k", "id"), ["k"], ["id"], 6, 2)
    got = made.groupBy("window").agg(F.min("place").alias("a"), F.max("place").alias("b")).orderBy("window").collect()
    assert [(r.a, r.b) for r in got] == expected


def test_asof(spark):
    left = spark.createDataFrame([("k", t, f"r{t}") for t in (1, 3, 5)], "k string, t int, name string")
    right = spark.createDataFrame([("k", 2, 20), ("k", 3, 30), ("k", 3, 31), ("q", 1, 9)], "k string, t int, v int")
    assert {r.name: r.v for r in sq.asof(left, right, ["k"], "t", ["v"]).collect()} == {"r1": None, "r3": 31, "r5": 31}


def test_statistics(spark):
    floors = [spark.range(1).select(ev.scaled_floor(F.lit(0.3), F.lit(a), F.lit(b)).alias("x")).first().x for a, b in ((1, 1), (2, 2), (3, 3), (1, 3))]
    assert floors == [0.3, 0.212132, 0.173205, 0.244949]
    a = spark.createDataFrame([("1", 1.0), ("2", 1.0), ("3", 1.0), ("4", 0.0)], "unit string, value double")
    b = spark.createDataFrame([("1", 0.0), ("2", 1.0), ("3", 1.0)], "unit string, value double")
    r = ev.paired_difference(a, b).first()
    assert (r["diff"], r.n_common, r.n_dropped) == (-0.333333, 3, 1)


def test_reasons_are_exclusive(spark):
    rows = spark.range(10)
    got = {r.reason: r.n for r in ev.reason_counts(rows, {"small": F.col("id") < 3, "even": F.col("id") % 2 == 0}).collect()}
    assert got == {"small": 3, "even": 3, "kept": 4}


def test_lines_of_text_lie_in_few_cells(spark):
    from .moved import shuffled

    rows = [(1, side, k, (10, 20 * k, 250, 20 * k + 18), f"t{k}", True) for side in "ab" for k in range(50)]
    boxes = spark.createDataFrame(rows, "pair long, side string, ordinal long, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string, touched boolean")
    got = mt.track(boxes)
    moved, _ = shuffled(spark, lambda: got.write.format("noop").mode("overwrite").save())
    assert got.filter("kind = 'same_place' and i = j").count() == 50 and moved < 300  # at least 400 rows for the join alone in cells of 64
