from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import wording as wd

CHANGE = "run int, change string, from_frame int, to_frame int, t0 double, t1 double, changed_fraction double, components int, textless int, moved int, same_place int, reverts_of string, reverts_share double, reverts_hold double, kind string"
RECORD = "run int, change string, pos int, kind string, before_ref string, before string, after_ref string, after string, added string, removed string, label string, continues string, in_churn boolean, reading string, reading_ref string"
CHANGES = [(1, "T1", 3, 4, 1.25, 2.5, 0.1234, 5, 2, 3, 1, "T0", 0.987, 1.25, "unsettled"), (1, "T2", 4, 5, 2.5, 3.0, None, None, None, 0, 0, None, None, None, "single")]
RECORDS = [
    (1, "T1", 1, "appended", "3:b1", "ab", "4:b1", "abc", "c", "", "Edge window, left", "3:b1/x", True, "abd", "4:b1"), (1, "T1", 2, "truncated", "3:b2", "abc", "4:b2", "a", "", "bc", "", None, False, None, None),
    (1, "T1", 3, "changed", "3:b3", "x", "4:b3", "y" * 90, "", "", None, None, None, "", "4:b3"), (1, "T1", 4, "reread", "3:b4", "l", "4:b1", "I", "", "", None, None, False, None, None),
    (1, "T1", 5, "appeared", None, None, "4:b5", "new", None, None, None, None, False, None, None), (1, "T1", 6, "removed", "3:b6", "old", None, None, None, None, None, None, False, None, None),
]


def test_changes_as_text(spark):
    changes, records = spark.createDataFrame(CHANGES, CHANGE), spark.createDataFrame(RECORDS, RECORD).orderBy(F.desc("pos"))
    got = {r.change: r for r in wd.change_texts(changes, records).collect()}
    assert got["T1"].text.split("\n") == [
        "Transition T1: frame 3 → frame 4, t=1.25–2.50s.", "Pixels changed: 12.34% of the screen; changed areas: 5.", "Text changes:",
        '[4:b1, 3:b1] Edge window, left: "ab" → appended "c"; now "abc"; continues 3:b1 [area was animating]', '    model reads 4:b1: "abd"', '[4:b2, 3:b2] "abc" → truncated, removed "bc"; now "a"',
        f'[4:b3, 3:b3] at this place "x" was replaced by "{"y" * 90}"', '[4:b1, 3:b4] "l" re-read as "I" (same text)', '[4:b5] appeared "new"', '[3:b6] removed "old"', "Texts that only moved: 3.",
        "Boxes with a visual change over unchanged text: 1.", "Changed areas without text: 2.", "Undoes 99% of T0's change after 1.3 s.", "One of these frames was captured while the screen was still changing.",
    ]
    assert got["T1"].ids == ["4:b1", "3:b1", "4:b2", "3:b2", "4:b3", "3:b3", "3:b4", "4:b5", "3:b6"]
    assert got["T2"].text.split("\n")[1:] == ["Pixels: no comparison is available for this pair.", "No text change was recorded; look for a change that is not text."] and got["T2"].ids == []
    lines = {r.change: r.line for r in wd.change_lines(changes, records).collect()}
    assert lines["T1"] == f'T1 [f3→f4, 1.3–2.5s] appended "abc"; truncated "a"; changed "{"y" * 79}…"; +1 more text changes; appeared 1; removed 1; moved 3; undoes T0'
    assert lines["T2"] == "T2 [f4→f5, 2.5–3.0s] no text change"


def test_items_and_context(spark):
    rows = [("l", "types", "ls", "no"), ("l", "opens", None, "yes"), ("l", None, "x", "yes"), ("l", "waits", None, None)]
    got = [r.x for r in spark.createDataFrame(rows, "line string, a string, e string, s string").select(wd.item_line(*map(F.col, ("line", "a", "e", "s"))).alias("x")).collect()]
    assert got == ['l — types [entered "ls", submitted: no]', "l — opens [submitted: yes]", "l", "l — waits"]
    context = spark.createDataFrame([("t", "g", ["a", "b"]), (None, None, []), (None, None, ["a"])], "t string, g string, p array<string>").select(wd.context_text(*map(F.col, "tgp")).alias("x"))
    assert [r.x for r in context.collect()] == ["Chapter: t — g\nPreceding transitions:\na\nb", "No preceding context.", "Preceding transitions:\na"]
    node = spark.range(1).select(wd.node_line(F.lit("s1"), F.lit(3), F.lit(9), F.lit(1.0), F.lit(2.26), F.lit("Setup")).alias("x")).first().x
    assert node == "s1 [f3→f9, 1.0–2.3s] Setup"


def test_links_as_text(spark):
    rows = [("run", [["a"], ["b"]]), ("run", [["a"]]), ("pair", [["k", "x"], ["v"]]), ("record", [["a", "b"], ["c"]])]
    got = wd.link_texts(spark.createDataFrame(rows, "kind string, cells array<array<string>>")).select("lines", wd.link_anchor(F.col("kind"), F.col("cells")).alias("anchor")).collect()
    assert [(r.lines, r.anchor) for r in got] == [(["ab", "a b"], "a"), (["a"], "a"), (["k x v"], "v"), (["a b c"], "a")]


def test_second_readings(spark):
    rows = [("L1", k, t) for k, t in enumerate(["b", "a", "a", "b", " "])] + [("L2", 1, "  "), ("L3", 1, None), ("L4", 2, "x"), ("L4", 1, "y")]
    lives = spark.createDataFrame([("L1", "b"), ("L2", "q"), ("L3", "q"), ("L4", None), ("L5", "z")], "lifetime string, text string")
    got = wd.second_readings(spark.createDataFrame(rows, "lifetime string, frame int, text string"), lives).collect()
    assert {tuple(r) for r in got} == {("L1", "b", 5, False, True), ("L2", None, 1, True, None), ("L4", "y", 2, False, False)}


def test_pairs_off_row(spark):
    boxes = spark.createDataFrame([(1, "k", (0, 0, 10, 10)), (1, "v", (30, 5, 40, 15)), (1, "w", (0, 30, 10, 40))], "frame int, box string, bbox struct<x0:int,y0:int,x1:int,y1:int>")
    pairs = [(1, 1, "key", "k"), (1, 1, "value", "v"), (1, 1, "value", "w"), (1, 2, "key", "k"), (1, 2, "value", "w"), (1, 3, "key", "k"), (1, 3, "value", "gone")]
    got = wd.off_row(spark.createDataFrame(pairs, "frame int, link int, side string, box string"), boxes).collect()
    assert {tuple(r) for r in got} == {(1, 1, 20, 0, False), (1, 2, 0, 20, True), (1, 3, 0, 0, False)}


def test_entered_texts(spark):
    rows = [("git", "git status", None, "none"), ("git", "git status", "GIT", "typed"), ("git s", "git status", "git st", "cursor-char"), ("git s", "git status", "git stat", "SUGGESTION"), ("x", "git status", "git  status", "SUGGESTION"), ("git", "git status", "ls", "other")]
    got = spark.createDataFrame(rows, "t string, s string, e string, k string").select("k", wd.entered_kind(F.col("t"), F.col("s"), F.col("e")).alias("got")).collect()
    assert [r.got for r in got] == [r.k for r in got]
    windows = spark.createDataFrame([(1, 5), (7, None), (None, None), (9, 2)], "a int, b int").select(wd.frame_window(F.col("a"), F.col("b")).alias("w")).collect()
    assert [r.w and tuple(r.w) for r in windows] == [(1, 5), (7, 7), None, (2, 9)]


def test_proposals_by_rectangle(spark):
    boxes = spark.createDataFrame([(1, "b1", 0, (0, 0, 50, 20)), (1, "b2", 1, (60, 0, 90, 20)), (1, "b3", 2, (0, 100, 50, 120))], "record int, box string, pos int, bbox struct<x0:int,y0:int,x1:int,y1:int>")
    rows = [(1, 7, 0, 0, (0, 0, 50, 20)), (1, 7, 0, 1, (2, 2, 40, 18)), (1, 7, 1, 0, (55, 0, 70, 20)), (1, 8, 0, 0, (0, 126, 50, 140)), (1, 8, 0, 1, (500, 500, 510, 510)), (1, 9, 0, 0, None), (2, 1, 0, 0, (0, 0, 50, 20))]
    got = wd.by_rect(spark.createDataFrame(rows, "record int, item int, part int, pos int, rect struct<x0:int,y0:int,x1:int,y1:int>"), boxes, 25.0).collect()
    assert {(r.record, r.item, r.part, r.pos): (r.box, r.again) for r in got} == {(1, 7, 0, 0): ("b1", False), (1, 7, 0, 1): ("b1", True), (1, 7, 1, 0): ("b2", False), (1, 8, 0, 0): ("b3", False), (1, 8, 0, 1): (None, False), (1, 9, 0, 0): (None, False), (2, 1, 0, 0): (None, False)}
