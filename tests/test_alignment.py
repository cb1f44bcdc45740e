from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment as al

from .moved import shuffled


def plain(needle, text):
    """Least edits of a substring for each end, by the table."""
    column = list(range(len(needle) + 1))
    out = []
    for c in text:
        before, column[0] = column[0], 0
        for k, x in enumerate(needle, 1):
            before, column[k] = column[k], min(column[k] + 1, column[k - 1] + 1, before + (x != c))
        out.append(column[-1])
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(4))
def test_bits_equal_the_table(seed):
    rng = random.Random(seed)
    for _ in range(200):
        letters = rng.choice(["ab", "abcd é"])
        needle = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 70])))
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 90)))
        assert list(al.distances(needle, text)) == plain(needle, text)
        found = al.aligned(needle, text, 0)
        if found:
            score, begin, end, part = found
            d = min(plain(needle, text))
            assert part == text[begin:end] and edits(needle, part) == d and score == 100 * (len(needle) - d) / len(needle)
        else:
            assert not text or min(plain(needle, text)) >= len(needle)


def test_fifty_points():
    assert al.aligned("abcd", "xxabyy", 50)[0] == 50 and al.aligned("abcd", "xxayyy", 50) is None
    assert al.aligned("needle", "a neeedle in", 50)[3] == "eedle" and al.aligned("x", "", 50) is None and al.aligned("", "x", 50) is None


def test_closest_by_column(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("abcdefg ") for _ in range(rng.choice([1, 3, 12]))), "".join(rng.choice("abcdefg ") for _ in range(60))) for _ in range(300)] + [(None, "a"), ("a", None), ("", "a")]
    for least in (50.0, 85.0):
        got = spark.createDataFrame(rows, "n string, t string").select("n", "t", al.closest(F.col("n"), F.col("t"), least).alias("c")).collect()
        for r in got:
            expected = None if r.n is None or r.t is None else al.aligned(r.n, r.t, least)
            assert (tuple(r.c) if r.c and r.c.score is not None else None) == expected


def test_alike_finds_every_pair(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abc") for _ in range(rng.choice([3, 9, 20, 40]))) for _ in range(30)]
    texts = base + ["".join(c if rng.random() > 0.07 else rng.choice("abcd") for c in x) for x in base for _ in range(2)]
    rows = [(rng.choice("gh"), k, t) for k, t in enumerate(texts)] + [("g", 998, "a"), ("g", 999, None)]
    left = spark.createDataFrame(rows, "g string, i long, a string")
    right = left.select("g", F.col("i").alias("j"), F.col("a").alias("b"))
    got = {(r.i, r.j) for r in al.alike(left, right, ["g"], "a", "b").collect()}
    expected = {(i, j) for g, i, a in rows for h, j, b in rows if g == h and a and b and len(a) > 1 and len(b) > 1 and 1 - edits(a, b) / max(len(a), len(b)) >= 0.9 - 1e-9}
    assert got == expected and len(expected) > len(texts)


def test_alike_moves_texts_and_not_runs(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(40, 80))) for _ in range(120)]
    left = spark.createDataFrame([(k % 3, k, t) for k, t in enumerate(texts)], "g long, i long, a string")
    right = left.select("g", F.col("i").alias("j"), F.concat(F.lit("x"), "a").alias("b"))
    found = al.alike(left, right, ["g"], "a", "b")
    rows, _ = shuffled(spark, lambda: found.write.format("noop").mode("overwrite").save())
    assert found.filter("i = j").count() == len(texts) and rows <= 3 * len(texts)


def length(frame_hits, box):
    seen = [box]
    while frame_hits[seen[-1]] in frame_hits and frame_hits[seen[-1]] not in seen:
        seen.append(frame_hits[seen[-1]])
    return len(seen)


def test_chains_with_cycles_and_branches(spark):
    rng = random.Random(8)
    frames = {1: {k: k + 1 for k in range(40)}, 2: {k: (k + 1) % 33 for k in range(33)}, 3: {k: rng.randrange(80) for k in range(60)}, 4: {0: 0, 1: 0, 2: 9, 3: 2}, 5: {k: rng.randrange(50) for k in range(50)}, 6: {0: 1, 1: 0}}
    rows = [(f, a, b) for f, hits in frames.items() for a, b in hits.items()]
    hits = spark.createDataFrame(rows, "frame long, box long, other long")
    got = {(r.frame, r.box): r.length for r in al.chains(hits).collect()}
    assert got == {(f, a): length(frames[f], a) for f, a, _ in rows}
    assert {tuple(r) for r in al.swaps(hits).filter("frame in (4, 6)").collect()} == {(6, 0, 1)}
    assert al.chains(hits.limit(0)).count() == 0


def test_scrambled_readings(spark):
    rect = lambda k: (0, 20 * k, 100, 20 * k + 15)
    texts = ["first line of text", "another line here", "third: something else", "first line of test", None, "ok"]
    boxes = spark.createDataFrame([(1, f"b{k}", k, rect(k), t) for k, t in enumerate(texts)], "frame long, box string, ordinal int, bbox struct<x0:int,y0:int,x1:int,y1:int>, text string")
    read = [(1, "b0", "Another  line here"), (1, "b1", "FIRST line of text"), (1, "b2", "third: something else"), (1, "b3", "third something else"), (1, "b5", "  "), (1, "b4", "another line here"), (1, "b9", "another line here"), (1, "b2", None), (2, "b0", "x y z")]
    got = al.scrambled(boxes, spark.createDataFrame(read, "frame long, box string, text string")).collect()
    assert {(r.box, r.other, r.steps, r.relation) for r in got} == {("b0", "b1", 1, "above"), ("b1", "b0", -1, "below"), ("b3", "b2", -1, "below"), ("b4", "b1", -3, "below")}
