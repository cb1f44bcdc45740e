"""Answers: quotes, times, JSON in prose, words from pieces, tags and requests that are sent again."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import answers as an
from tidemark.operators import lineage as ln
from tidemark.operators import placing as pl
from tidemark.operators import quotes as qu

from .moved import shuffled


@pytest.mark.parametrize(
    "text, body, reason",
    [
        ('{"a": 1}', '{"a": 1}', None), ('Sure:\n```json\n{"a": "}{"}\n```\nbye', '{"a": "}{"}', None), ('```\n{"a": 1}\n```\n```json\n{"b": 2}\n```', '{"a": 1}', None),
        ('use { and }: {"a": {"b": "\\"}"}} "x', '{"a": {"b": "\\"}"}}', None), ('{"a": {"b": 1}, "c": ', None, "cut"), ('{"a": "never', None, "cut"), ('{"a": tr', None, "cut"),
        ("{'a': 1}", None, "not JSON"), ("no braces", None, "no object"), (" \n", None, "empty"), (None, None, "empty"), ("{" * 5000, None, "cut"), ("{x" * 5000, None, "not JSON"),
    ],
)
def test_objects_in_prose(text, body, reason):
    assert an.object_in(text) == (body, reason)


def test_answers_by_schema(spark):
    rows = [('x {"n": 3, "tags": ["a"], "more": 1}',), ('{"n": "three"}',), ('{"tags": []}',), ("{",), (None,)]
    got = spark.createDataFrame(rows, "t string").select(an.parsed_answer(F.col("t"), "n int, tags array<string>", ["n"]).alias("p")).collect()
    assert [(r.p.value.n if r.p.value else None, r.p.reason) for r in got] == [(3, None), (None, "schema: n"), (None, "schema: n"), (None, "cut"), (None, "empty")]


def piece(text, x):
    return {"text": text, "bbox": {"x0": x, "y0": x % 7, "x1": x + 5, "y1": 20 - x % 7}}


def test_words_from_pieces(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    pieces, expected = [], []
    for w in words:
        cuts = sorted({0, len(w), *(rng.randint(0, len(w)) for _ in range(2))})
        own = [piece(w[a:b], 10 * len(pieces) + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        pieces += own
        rects = [p["bbox"] for p in own]
        expected.append({"text": w, "bbox": {"x0": min(r["x0"] for r in rects), "y0": min(r["y0"] for r in rects), "x1": max(r["x1"] for r in rects), "y1": max(r["y1"] for r in rects)}})
    assert an.regrouped(" ".join(words), pieces) == expected
    assert an.regrouped("ab cd", [piece("abc", 0), piece("d", 9)]) is None and an.regrouped("ab", [piece("ab", 0), piece("", 9)]) is None
    assert an.regrouped("ab", [piece("", 0), piece("ab", 9)])[0]["bbox"]["x0"] == 0 and an.regrouped("", []) == [] and an.regrouped(None, None) == []
    rows = [("ab c", [("a", (0, 0, 1, 1)), ("b", (1, 0, 2, 3)), ("c", (5, 0, 6, 1))]), ("x", [("y", (0, 0, 1, 1))]), (None, None)]
    df = spark.createDataFrame(rows, "t string, p array<struct<text:string,bbox:struct<x0:int,y0:int,x1:int,y1:int>>>")
    got = [r.w for r in df.select(an.regroup_words(F.col("t"), F.col("p")).alias("w")).collect()]
    assert [(w.text, tuple(w.bbox)) for w in got[0]] == [("ab", (0, 0, 2, 3)), ("c", (5, 0, 6, 1))] and got[1] is None and got[2] == []


@pytest.mark.parametrize("most", [1, 7, 100_000])
def test_words_by_flat_columns(monkeypatch, most):
    """Slices of a batch give what one row at a time gives."""
    rng = random.Random(most)
    rows = [(None, None), ("", []), ("ab", None), ("ab", []), ("ab", [piece("ab", 0), piece("", 9)]), ("", [piece("", 1)]), (" a  b ", [piece("", 0), piece("a", 1), piece("", 5), piece("b", 3)])]
    for _ in range(200):
        words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 5))]
        joined, cuts = "".join(words), {0}
        for w in words:
            cuts |= {max(cuts) + len(w)} | {max(cuts) + rng.randint(0, len(w)) for _ in range(2)}
        cuts = sorted(c for c in cuts if rng.random() > 0.03 or not c)
        own = [piece(joined[a:b], rng.randint(0, 99)) for a, b in zip(cuts, cuts[1:])]
        if rng.random() < 0.3:
            own.insert(rng.randint(0, len(own)), piece("", rng.randint(0, 99)))
        rows.append((" ".join(words), own))
    monkeypatch.setattr(an, "SLICE", most)
    kind = pa.list_(pa.struct([("text", pa.string()), ("bbox", pa.struct([(c, pa.int32()) for c in ("x0", "y0", "x1", "y1")]))]))
    got = list(an._regroup.func(iter([(pa.array([t for t, _ in rows], pa.string()), pa.array([p for _, p in rows], kind))])))
    assert [x for part in got for x in part.to_pylist()] == [an.regrouped(t, p) for t, p in rows]
    assert most > 1 or len(got) > 100


def plain_tags(boxes, width, height):
    out, placed = {}, []
    for k, (rect, tw, th) in enumerate(boxes):
        x0, y0, x1, y1 = rect
        area = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        tried = []
        for x, y in ((x1 + 2, (y0 + y1) // 2 - th // 2), (x0 - tw - 2, (y0 + y1) // 2 - th // 2), (x0, y0 - th - 1), (x0, y1 + 1)):
            x, y = min(max(x, 0), width - tw), min(max(y, 0), height - th)
            tag = (x, y, x + tw, y + th)
            tried.append((area(tag, rect) + sum(area(tag, b) for b, *_ in boxes if b != rect) + sum(area(tag, p) for p in placed if p != rect), tag))
        over, tag = min(tried, key=lambda t: t[0])
        placed.append(tag)
        out[k] = tag[0], tag[1], over > 0
    return out


def test_tags_cover_nothing_where_they_can(spark):
    rng = random.Random(3)
    kind, rows, expected = "frame long, pos int, box string, bbox struct<x0:int,y0:int,x1:int,y1:int>, tag_width int, tag_height int", [], {}
    for frame in range(4):
        boxes = []
        for _ in range(rng.choice([3, 60, 200])):
            x, y = rng.randrange(0, 560), rng.randrange(0, 380)
            boxes.append(((x, y, x + rng.randint(10, 80), y + rng.randint(8, 20)), rng.randint(8, 30), 12))
        boxes.append(boxes[0])  # a box twice
        expected |= {(frame, k): v for k, v in plain_tags(boxes, 640, 400).items()}
        rows += [(frame, k, f"b{k}", *b) for k, b in enumerate(boxes)]
    got = pl.place_tags(spark.createDataFrame([*rows, (9, 0, "b0", None, 5, 5)], kind), 640, 400).collect()
    assert {(r.frame, r.pos): (r.x, r.y, r.clash) for r in got} == expected and any(r.clash for r in got)


def test_a_frame_of_many_boxes(spark):
    many = spark.range(10_000).selectExpr("1L as frame", "cast(id as int) as pos", "cast(id as string) as box", "named_struct('x0', int(id % 100 * 60), 'y0', int(id div 100 * 30), 'x1', int(id % 100 * 60 + 30), 'y1', int(id div 100 * 30 + 12)) as bbox", "20 as tag_width", "10 as tag_height")
    got = pl.place_tags(many, 6000, 3000).groupBy("clash").count().collect()
    assert [(r.clash, r["count"]) for r in got] == [(False, 10_000)]


def test_quotes_without_a_source(spark):
    answers = [
        (1, "Why “the door” now?", 'He said “Opened  the file” and "the door", then `rm -rf` … "x" and "not there at all".'), (2, None, 'On "save as… → never seen" it "**Saves** AS" well'), (3, "q", None),
        (4, "q", "“It’s — done here — twice”"),
    ]
    sources = [(1, "opened the  FILE"), (1, "run 'rm -rf' now"), (2, "Save as"), (2, "it saves as well"), (3, "x"), (4, "its"), (4, "DONE HERE"), (5, None)]
    got = qu.unsupported(spark.createDataFrame(answers, "id long, question string, answer string"), spark.createDataFrame(sources, "id long, text string"))
    assert {(r.id, r.quote): r.missing for r in got.collect()} == {(1, "not there at all"): ["not there at all"], (2, "save as… → never seen"): ["never seen"], (4, "It’s — done here — twice"): ["twice"]}
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()


def test_contained_equals_in(spark):
    rng = random.Random(9)
    texts = [(k % 3, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 80)))) for k in range(60)] + [(1, "ab" * 4000)]
    parts = [(k % 3, "".join(rng.choice("abc ") for _ in range(rng.randint(4, 7)))) for k in range(200)]
    got = qu.contained(spark.createDataFrame(parts, "g long, p string"), spark.createDataFrame(texts, "g long, t string"), ["g"], "p", "t")
    assert {tuple(r) for r in got.collect()} == {(g, p) for g, p in parts if any(g == h and p in t for h, t in texts)}


def test_mechanical_lines(spark):
    exact, timed = "contains the exact string `a b`", "gives a time between 1:05 and 1:20 (or a frame from 10 to 12)"
    cases = [
        (exact, "x a b y", True), (exact, "a  b", False), (timed, "at 1:10", True), (timed, "at 1:20.5", False), (timed, "at 1:04.99 or 11:10", False), (timed, "66 s in", True), (timed, "t ≈ 70.5", True),
        (timed, "frames 8–10", True), (timed, "frame 13", False), (timed, "frames 1-90", False), (timed, "Frame 12 only", True), (timed, "in 2024", False), ("says who it was", "a b", None), (exact, None, None),
        ("gives a time between 0:01 and 0:02 or frame 3 or 9", "frame 9", True), ("gives a time between 0:01 and 0:02 or frame 3", "frame 9", False),
    ]
    got = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, line string, answer string").select("k", qu.mechanical(F.col("line"), F.col("answer")).alias("m"))
    assert [r.m for r in got.orderBy("k").collect()] == [c[2] for c in cases]
    lines = spark.createDataFrame([("q1", "M1", exact), ("q1", "M2", "free")], "question string, line string, text string")
    answers = spark.createDataFrame([(1, "q1", "a b"), (2, "q1", "b")], "run int, question string, answer string")
    verdicts = spark.createDataFrame([(1, "q1", "M1", False)], "run int, question string, line string, met boolean")
    assert {tuple(r) for r in qu.checked(lines, answers, verdicts).collect()} == {(1, "q1", "M1", True, False, False), (2, "q1", "M1", False, None, False)}


def test_requests_are_sent_again_once(spark, tmp_path):
    requests = spark.range(40).selectExpr("string(id) as key", "10 as bytes", "'p' as params").unionByName(spark.range(3).selectExpr("string(id) as key", "10 as bytes", "'p' as params"))
    path, sent = str(tmp_path / "attempts"), []

    def send(todo, stop=False):
        assert todo.groupBy("lane", "batch").agg(F.sum("bytes").alias("n")).filter("n > 30").isEmpty()
        sent.append(sorted(int(r.key) for r in todo.select("key").collect()))
        if stop:
            raise RuntimeError("the run stops")
        k = F.col("key").cast("int")
        first = F.lit(len(sent) == 1)
        result = F.when(k % 10 == 0, "errored").when((k % 10 == 1) & first, "expired").when(k % 10 == 2, "invalid").otherwise("succeeded")
        return todo.select("key", result.alias("result"), F.when(result == "succeeded", F.concat(F.lit("b"), "key")).alias("body"))

    once = ln.run_passes(requests, path, send, "bytes", 25, most=1)
    assert {r.state for r in once.collect()} == {"done", "failed", "invalid"}
    with pytest.raises(RuntimeError):
        ln.run_passes(requests, path, lambda t: send(t, True), "bytes", 25)
    out = {int(r.key): (r.state, r.body, r.tries) for r in ln.run_passes(requests, path, send, "bytes", 25).collect()}
    again = [k for k in range(40) if k % 10 in (0, 1)]
    assert sent == [list(range(40)), again, again]  # what was written before the stop isn't sent a third time
    assert out == {k: ("failed", None, 2) if k % 10 == 0 else ("done", f"b{k}", 2) if k % 10 == 1 else ("invalid", None, 1) if k % 10 == 2 else ("done", f"b{k}", 1) for k in range(40)}
    assert ln.run_passes(requests, path, send, "bytes", 25).count() == 40 and len(sent) == 3
    open_ = spark.createDataFrame([("a", 1, None, None), ("b", 1, "canceled", None)], ln.ATTEMPTS)
    assert {r.key for r in ln.to_send(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), open_).collect()} == {"b", "c"}


def test_sources_by_place_move_once(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(7)) for _ in range(60)]
    sources = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "g long, at long, text string")
    answers = [(k, k % 2, k, None, f'"{" ".join(rng.choice(texts).split()[:4])}"') for k in range(60)]
    answers = spark.createDataFrame(answers, "id long, g long, at long, question string, answer string")
    every = answers.select("id", "g", F.col("at").alias("_at")).join(sources, "g").filter("at < _at").select("id", "text")
    one, two = qu.unsupported(answers, sources, "g", "at"), qu.unsupported(answers.drop("g", "at"), every)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and 0 < one.count() < 60
    kept = lambda df: shuffled(spark, lambda: df.write.format("noop").mode("overwrite").save())[0]
    assert kept(one) < kept(two)


def test_boxes_of_a_frame_move_once(spark, sf):
    """The shuffle that numbers the boxes serves the placing; only sums by frame move after it."""
    from tidemark import plans

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    rows, _ = shuffled(spark, lambda: plans.queries()["tags_placed"](spark, sf).collect())
    assert rows <= lines.count() + lines.select("l_orderkey").distinct().count()


def test_tags_of_few_and_many_boxes_alike(spark, monkeypatch):
    """A frame's rectangles in a list or in a grid give the same places; a rectangle without an edge has no tag."""
    rng, kind = random.Random(9), "frame long, pos int, box string, bbox struct<x0:int,y0:int,x1:int,y1:int>, tag_width int, tag_height int"
    rows = []
    for frame in range(30):
        for pos in range(rng.choice((1, 5, 24, 25, 60))):
            x, y = rng.randint(-20, 300), rng.randint(-20, 200)
            rows.append((frame, pos, f"b{pos}", (x, y, x + rng.choice((0, 5, 60)), y + rng.randint(0, 30)), rng.randint(1, 40), 12))
    boxes = spark.createDataFrame([*rows, (99, 0, "b0", (1, None, 5, 9), 5, 5)], kind)
    both = []
    for few in (0, 1000):
        monkeypatch.setattr(pl, "FEW", few)
        machines = {}
        for frame, pos, box, rect, *size in rows:
            machines.setdefault(frame, pl._Frame(320, 240)).step(pos, box, *rect, *size)
        both.append(sorted((frame, *r) for frame, m in machines.items() for r in m.close()))
    assert both[0] == both[1] == sorted(map(tuple, pl.place_tags(boxes, 320, 240).collect()))
