"""Operators on runs: errors, ties and small cases by hand."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import labels as lb
from tidemark.operators import reports as rp
from tidemark.operators import search as op
from tidemark.operators import selection as sl


def test_a_frame_without_a_transition_is_an_error(spark):
    boxes = spark.createDataFrame([("v", 1, "b1"), ("v", 2, "b1"), ("v", 3, "b1")], "video_id string, frame long, box string")
    moves = spark.createDataFrame([("v", 2, 0)], "video_id string, frame long, components int")
    none = boxes.limit(0)
    with pytest.raises(PySparkException, match="no transition into frame 3"):
        sl.plan_calls(boxes, moves, none, none).collect()
    moves = spark.createDataFrame([("v", 2, 0), ("v", 3, None)], "video_id string, frame long, components int")
    got = {r.frame: r.targets for r in sl.plan_calls(boxes, moves, none, none).collect()}
    assert got == {1: ["b1"], 3: []}  # unchanged pixels: no call; not measured: a call without targets
    plan = sl.plan_calls(boxes, moves, none, none)
    assert tuple(sl.projection(plan, boxes).first()) == (3, 3, 2, 1, 1, 0.3333, 0.5, 1.0)


def test_references(spark):
    boxes = spark.createDataFrame([(12, "b4", "text")], "frame long, box string, text string")
    refs = lambda *x: spark.createDataFrame([(r,) for r in x], "ref string")
    assert [r.text for r in lb.texts_of_refs(refs("12:b4"), boxes).collect()] == ["text"]
    with pytest.raises(PySparkException, match="no box 12:b5"):
        lb.texts_of_refs(refs("12:b4", "12:b5"), boxes).collect()
    got = [r.p and tuple(r.p) for r in refs("12:b4", "7:a:b", "b4", "", "x:b1").select(tx.parsed_ref(F.col("ref")).alias("p")).collect()]
    assert got == [(12, "b4"), (7, "a:b"), None, None, None]
    assert tx.frame_span("145-155") == (145, 155) and tx.frame_span(" 7 ") == (7, 7)
    with pytest.raises(ValueError):
        tx.frame_span("9-8")


def test_nothing_flips_among_fractions(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "unit string, value double")
    a, b = rows(("u", 1.0), ("u", 1.0), ("w", 0.0), ("x", 1.0)), rows(("u", 0.0), ("w", 1.0), ("x", 1.0), ("y", 0.0))
    assert {tuple(r) for r in rp.flips(a, b).collect()} == {("u", "A"), ("w", "B")}
    assert rp.flips(a, rows(("u", 0.0), ("w", 0.5))).isEmpty()
    assert rp.flips(a.limit(0), b).isEmpty()


def test_low_half_medians(spark):
    rng = random.Random(4)
    rows = [(k % 3, rng.choice([None, *map(float, range(6))]), rng.randrange(9)) for k in range(200)] + [(7, 1.0, 5)]
    got = {r.key: r.median for r in rp.low_half(spark.createDataFrame(rows, "key int, o double, v int"), "o", "v", ["key"]).collect()}
    for key, median in got.items():
        own = sorted((o, v) for k, o, v in rows if k == key and o is not None)
        assert median == statistics.median(v for _, v in own[: math.ceil(len(own) / 2)])
    assert set(got) == {0, 1, 2, 7}


def test_terms_are_found_with_marks_and_overlaps(spark):
    texts = spark.createDataFrame([("a", "Aaaa élan ELAN elane x-élan"), ("b", "the of the of the"), ("c", None)], "node_id string, text string")
    counts = texts.select("node_id", op._occurrences(F.lower("text"), "aa").alias("aa"), op._occurrences(F.lower("text"), "the").alias("the")).collect()
    assert {r.node_id: (r.aa, r["the"]) for r in counts} == {"a": (3, 0), "b": (0, 3), "c": (None, None)}
    nodes = texts.selectExpr("node_id", "'v' as video_id", "'frame' as level", "1 as ordinal", "0D as t_start", "0D as t_end", "array('x') as apps", "coalesce(text, '') as text")
    for query, expected in (("elan", {"a": 2}), ('"of the"', {"b": 2}), ('"the of the"', {"b": 2}), ("aaa", {"a": 2})):
        tokenizer = "trigram" if query == "aaa" else "word"
        scan = {r.node_id: r.score for r in op.Scan(nodes).bm25(query, tokenizer).collect()}
        index = {r.node_id: r.score for r in op.Index.build(nodes).bm25(query, tokenizer).collect()}
        assert set(scan) == set(expected) and all(math.isclose(scan[k], index[k]) for k in expected)


def test_capped_and_sampled(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 as kind")
    kept = sl.capped(rows, ["kind"], [F.desc("id")], 5).collect()
    assert len(kept) == 15 and {(r.kind, r.left_out) for r in kept} == {(0, 29), (1, 28), (2, 28)}
    lots = [sorted(tuple(r) for r in sl.sampled_by_kind(rows.repartition(n), "kind", "id", 4, "s").collect()) for n in (1, 7)]
    assert lots[0] == lots[1] and len(lots[0]) == 12
