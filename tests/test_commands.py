from __future__ import annotations

from tidemark.api import Store
from tidemark.operators import commands as cm
from tidemark.operators import search as op


def test_scores(spark):
    entries = spark.createDataFrame([(1, "git  status", 10, 20.0, 10, 12), (2, "rm -rf", 11, 24.0, 11, 11), (3, "ls", 12, 26.0, 12, 12)], "entry int, text string, frame int, t double, first_frame int, last_frame int")
    lives = spark.createDataFrame([("L10", "C:\\src> git status", 11, 24.4), ("L2", "git status -s", 11, 24.4), ("L3", "Git status", 10, 20.0)], "lifetime string, text string, first_frame int, t_first double")
    assert [r.entry for r in cm.scorable(entries).orderBy("entry").collect()] == [1, 2]
    assert [(r.entry, r.lifetime, r.rank) for r in cm.matching_lifetimes(entries, lives).orderBy("rank").collect()] == [(1, "L2", 1), (1, "L10", 2)]
    exact = cm.score_exact(entries.drop("first_frame", "last_frame"), lives)
    assert [(r.entry, r.exact, r.frames_off, r.seconds_off) for r in exact.orderBy("entry").collect()] == [(1, True, 1, 4.4), (2, False, None, None), (3, False, None, None)]
    hits = spark.createDataFrame([(1, 1, "step", 0, 40), (1, 2, "lifetime", 12, 20), (2, 1, "frame", 1, 3)], "entry int, rank int, level string, frame_start int, frame_end int")
    found = cm.score_found(entries, hits)
    assert [(r.entry, r.found, r.rank, r.level) for r in found.orderBy("entry").collect()] == [(1, True, 2, "lifetime"), (2, False, None, None), (3, False, None, None)]
    assert [(r.metric, r.k, r.n) for r in cm.rates(found, ["found"]).collect()] == [("found", 1, 3)]


def test_costs(spark):
    calls = spark.createDataFrame([("a", 1.0, 9.0), ("a", None, 0.5), ("b", 0.25, None)], "stage string, paid double, estimated double")
    got = {r.stage: (r.dollars, r.per_frame, r.projected, r.n_estimated) for r in cm.cost_summary(calls, 10, 100).collect()}
    assert got == {"a": (1.5, 0.15, 15.0, 1), "b": (0.25, 0.025, 2.5, 0), "all stages": (1.75, 0.175, 17.5, 1)}


def test_store(spark, tmp_path):
    nodes = spark.createDataFrame([("v:L1", "v", "lifetime", None, 0.0, 3.0, [], "alpha"), ("v:S1", "v", "step", None, 0.0, 3.0, [], "beta")], "node_id string, video_id string, level string, ordinal int, t_start double, t_end double, apps array<string>, text string")
    op.Index.build(nodes).save(str(tmp_path))
    spark.createDataFrame([("v", "T1", 1.0, 2.0), ("v", "T2", 5.0, 6.0)], "video_id string, change_id string, t_start double, t_end double").write.parquet(str(tmp_path / "changes"))
    spark.createDataFrame([("v", 1, 1, "b"), ("v", 1, 0, "a")], "video_id string, frame int, ordinal int, text string").write.parquet(str(tmp_path / "boxes"))
    s = Store(spark, str(tmp_path))
    assert s.list_videos().first().n_nodes == 2 and s.get_node("v:L1").count() == 1 and s.get_node("x").count() == 0
    assert [r.node_id for r in s.search("alpha", app="none").collect()] == ["v:L1"]
    assert [r.change_id for r in s.get_transitions("v", 2.0, 4.0).collect()] == ["T1"]
    assert [r.text for r in s.get_frame("v", 1).collect()] == ["a", "b"] and [r.node_id for r in s.summary("v").collect()] == ["v:S1"]
