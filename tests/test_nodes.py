"""The mini run of four frames: lifetimes, nodes and search goldens; label carrying; repair; sources."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import nodes as nd
from tidemark.operators import search as op
from tidemark.sources import files as fs

TEXTS = {
    10: ["Status", "Creating", "C:\\src> git"],
    11: ["Status", "Creating", "C:\\src> git status"],
    12: ["Status", "Creating", "C:\\src> git status", "On branch main", "C:\\src>"],
    13: ["Status", "Succeeded", "C:\\src> git status", "On branch maln", "C:\\src>"],
}
TIMES = [(10, 20.0, 20.4, 24.0), (11, 24.0, 24.4, 26.0), (12, 26.0, 26.4, 30.0), (13, 30.0, 30.4, 35.0)]


@pytest.fixture(scope="module")
def run(spark):
    frames = spark.createDataFrame([("v", *t) for t in TIMES], "video_id string, frame int, t_change double, t_settled double, t_end double")
    boxes = spark.createDataFrame([("v", f, f"b{k + 1}", k, t) for f, ts in TEXTS.items() for k, t in enumerate(ts)], "video_id string, frame int, box string, ordinal int, text string")
    keep = [(10, 1), (10, 2), (11, 1), (11, 2), (11, 3), (12, 1), (12, 3), (12, 4), (12, 5)]
    edges = spark.createDataFrame([("v", f, f"b{k}", f"b{k}") for f, k in keep], "video_id string, frame int, box string, next_box string")
    return frames, boxes, edges


def test_lifetimes(run):
    frames, boxes, edges = run
    got = {(r.frame, r.box): r.lifetime for r in nd.lifetimes(edges, boxes).collect()}
    assert len(set(got.values())) == 7
    assert got[10, "b1"] == got[13, "b1"] == "L1" and got[10, "b2"] == got[12, "b2"] == "L2" and got[13, "b2"] != "L2"
    assert got[11, "b3"] == got[13, "b3"] == "L4" and got[10, "b3"] == "L3" and got[12, "b4"] == got[13, "b4"] == "L5" and got[13, "b2"] == "L7"


def test_nodes_and_search(spark, run):
    frames, boxes, edges = run
    members = nd.lifetimes(edges, boxes).join(boxes, ["video_id", "frame", "box"])
    changes = spark.createDataFrame([("v", "T1", 24.0, 24.4), ("v", "T2", 26.0, 26.4), ("v", "T3", 30.0, 30.4)], "video_id string, change_id string, t_start double, t_end double")
    lines = spark.createDataFrame([("v", "T1", 0, "appended git status"), ("v", "T2", 0, "appeared On branch main"), ("v", "T3", 0, "changed Creating to Succeeded")], "video_id string, change_id string, pos int, text string")
    every = nd.all_levels(nd.frame_nodes(frames, boxes), nd.lifetime_nodes(members, frames), nd.transition_nodes(changes, lines))
    assert {r.level: r["count"] for r in every.groupBy("level").count().collect()} == {"frame": 4, "lifetime": 7, "transition": 3}
    index = op.Index.build(every)
    hits = {r.node_id: r for r in op.search(index, "Creating").collect()}
    assert {k: h.score for k, h in hits.items()} == {"v:L2": 0.03279, "v:T3": 0.03279, "v:f10": 0.03279}
    assert hits["v:f10"].member_ids == ["v:f10", "v:f11", "v:f12"]
    runs = [r.member_ids for r in op.search(index, "git").filter("level = 'frame'").collect()]
    assert sorted(runs) == [["v:f10"], ["v:f11", "v:f12", "v:f13"]]
    assert sorted(r.member_ids for r in op.search(index, "branch").filter("level = 'frame'").collect()) == [["v:f12"], ["v:f13"]]


def test_labels_are_carried(spark):
    boxes = spark.createDataFrame([("v", "L1", f, "b") for f in (1, 2, 3)] + [("v", "L2", f, "c") for f in (1, 3)], "video_id string, lifetime string, frame int, box string")
    labels = spark.createDataFrame([("v", 2, "b", "x"), ("v", 1, "c", "y")], "video_id string, frame int, box string, label string")
    got = {(r.lifetime, r.frame): (r.label, r.label_frame) for r in nd.carried_labels(boxes, labels).collect()}
    assert got == {("L1", 1): (None, None), ("L1", 2): ("x", 2), ("L1", 3): ("x", 2), ("L2", 1): ("y", 1), ("L2", 3): ("y", 1)}
    links = spark.createDataFrame([("v", "k", 1, "L1"), ("v", "k", 1, "L2")], "video_id string, link string, frame int, lifetime string")
    assert sorted(r.frame for r in nd.in_force(links, boxes).collect()) == [1]


def test_repair_gives_one_reason(spark):
    assign = spark.createDataFrame([(1, 0, "b1", "c1"), (1, 1, "b1", "c1"), (1, 2, "b9", "c1"), (1, 3, "b2", "c1"), (1, 4, "b3", "c9"), (1, 5, "b3", "c1")], "frame int, pos int, box string, container string")
    boxes = spark.createDataFrame([(1, b) for b in ("b1", "b2", "b3", "b4")], "frame int, box string")
    targets = boxes.filter("box <> 'b2'")
    containers = spark.createDataFrame([(1, "c1")], "frame int, container string")
    fixed = nd.repair_assignments(assign, boxes, targets, containers)
    assert {r.pos: r.reason for r in fixed.collect()} == {0: None, 1: "second_assignment", 2: "unknown_box", 3: "not_target", 4: "unknown_container", 5: None}
    assert [r.box for r in nd.unplaced(fixed, targets).collect()] == ["b4"]


def test_citations_are_checked(spark):
    kept, bad = nd.valid_citations(F.array(*map(F.lit, ("a", "x", "b", "a", "x"))), F.array(F.lit("a"), F.lit("b")))
    r = spark.range(1).select(kept.alias("k"), bad.alias("n")).first()
    assert (r.k, r.n) == (["a", "b"], 2)


def test_jsonl(spark, tmp_path):
    assert fs.read_jsonl(spark, str(tmp_path / "none"), "a int").count() == 0
    (tmp_path / "x.jsonl").write_text('{"a": 1, "z": 5}\n\n{"a": null}\n')
    assert [r.a for r in fs.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()] == [1, None]
    (tmp_path / "bad.jsonl").write_text("{no\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        fs.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    fs.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.json"))


def test_markdown(spark, tmp_path):
    (tmp_path / "t.md").write_text("# T\n\n## Executed, in order\n\n| # | text |\n|---|:---|\n| 1 | git \\| status |\n| 2 | ls |\n\n## Never\n\n| text |\n|---|\n| rm |\n")
    got = [(r.heading, r.row, r.column, r.text) for r in fs.markdown_tables(spark, str(tmp_path / "t.md")).orderBy("table", "row", "column").collect()]
    assert got == [("Executed, in order", 1, "#", "1"), ("Executed, in order", 1, "text", "git | status"), ("Executed, in order", 2, "#", "2"), ("Executed, in order", 2, "text", "ls"), ("Never", 1, "text", "rm")]


def test_questions(spark, tmp_path):
    (tmp_path / "q.md").write_text("# Q\n\n### Q1 (positive, exact)\n\nQuestion: What ran\nfirst?\nReference answer: git status\nRubric:\n- M: names git\n- M: names\n  status\n- X: claims a push\n\n### Q2 (negative, open)\nQuestion: Was it pushed?\nReference answer: No\n- M: says no\n")
    one, two = fs.questions(spark, str(tmp_path / "q.md")).orderBy("id").collect()
    assert (one.id, one.polarity, one.style, one.question, one.reference, one.must, one.must_not) == ("Q1", "positive", "exact", "What ran first?", "git status", ["names git", "names status"], ["claims a push"])
    assert one.key.startswith("Q1@") and len(one.key) == 9 and two.must_not == []


def test_outline(spark):
    text = 'Here: [{"start": "1:30", "end": "2:00", "title": "b", "gist": "g"}, {"start": "0", "end": "90.5", "title": "a"}, {"start": "9", "end": "3", "title": "bad"}] done'
    got = [(r.id, r.start_s, r.end_s, r.title) for r in fs.outline(spark.createDataFrame([(text,)], "text string")).orderBy("id").collect()]
    assert got == [("c1", 0.0, 90.5, "a"), ("c2", 90.0, 120.0, "b")]
