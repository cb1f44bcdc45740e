"""Every reason once, in the order of the checks; one reason an item."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import repair as rp


def ids(a, b):
    return [f"b{k}" for k in range(a, b + 1)]


@pytest.fixture(scope="module")
def make(spark):
    kinds = {
        "containers": "record long, pos int, id string, kind string, owner string, covers array<string>", "assign": "record long, pos int, box string, container string, pane string",
        "unassigned": "record long, pos int, box string", "texts": "record long, pos int, box string, text string", "missed": "record long, pos int, text string, container string",
        "links": "record long, pos int, kind string, refs array<string>, cells int, members array<string>",
    }

    def build(kind, rows):
        return spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], kinds[kind])

    build.boxes = lambda targets, boxes: spark.createDataFrame([(1, b, k, b in targets) for k, b in enumerate(boxes)], "record long, box string, place int, target boolean")
    return build


def counted(counts):
    return {r.reason: r.n for r in rp.totals(counts).collect()}


WINDOWS = [("c1", "window", None, []), ("c2", "window", None, [])]


def test_containers(make):
    rows = [("c1", "window", None, ["c2", "c1", "zz"]), ("c2", "popup", "c9", []), ("c2", "window", None, []), ("c3", "window", "c1", ["c1", "c1", None]), ("c4", "popup", "c2", None), ("c5", "popup", "c1", [])]
    out, counts = rp.repair_containers(make("containers", rows))
    kept = {r.id: r for r in out.collect()}
    assert {k: r.owner for k, r in kept.items()} == {"c1": None, "c2": None, "c3": None, "c4": None, "c5": "c1"}
    assert kept["c1"].covers == ["c2"] and kept["c3"].covers == ["c1"] and kept["c4"].covers == []
    assert counted(counts) == {"dup_container": 1, "bad_owner": 3, "bad_covers": 4}
    again, counts = rp.repair_containers(out)
    assert counted(counts) == {} and {r.id: (r.owner, r.covers) for r in again.collect()} == {k: (r.owner, r.covers) for k, r in kept.items()}


def test_assignments(make):
    rows = [(b, c, p) for b, c, p in (("b1", "c1", " left "), ("b2", "c1", ""), ("b2", "c2", None), ("b9", "c1", None), ("b7", "c1", None), ("b3", "c7", None), ("b4", "c2", None), (None, "c1", None))]
    boxes = make.boxes(ids(1, 6), ids(1, 7))
    kept, left, counts = rp.repair_assign(make("assign", rows), make("unassigned", [("b5",), ("b1",), ("b8",), ("b5",)]), boxes, make("containers", WINDOWS))
    assert [(r.box, r.container, r.pane) for r in kept.filter("reason is null").orderBy("pos").collect()] == [("b1", "c1", "left"), ("b2", "c1", None), ("b4", "c2", None)]
    assert [r.box for r in left.orderBy("pos").collect()] == ["b5", "b3", "b6"]
    assert counted(counts) == {"unknown_box": 2, "not_target": 1, "unknown_container": 1, "second_assignment": 1, "unplaced": 2}


def link(kind, *cells, header=()):
    refs = [b for c in cells for b in c]
    return kind, [*refs, *header], len(refs) if kind == "run" else sum(bool(c) for c in cells), refs


def test_links(make):
    run, pair = lambda *b: link("run", b), lambda a, b: link("pair", a, b)
    rows = [run("b4", "b5"), run("b5", "b6"), run("b1"), run("b1", "b99"), run("b6", "b6"), pair(["b1"], ["b2"]), pair(["b3"], ["b6"]), pair(["b7"], ["b8"]), pair(["b3"], ["b3"]), pair(["b7"], [])]
    out, counts = rp.repair_links(make("links", rows), make.boxes(ids(1, 8), ids(1, 8)))
    assert {r.pos for r in out.collect() if r.reason is None} == {0, 5, 6, 7} and out.count() == len(rows)
    assert counted(counts) == {"link_already_linked": 1, "link_malformed": 4, "link_unknown_box": 1}


def test_records_and_headers(make):
    head, row = ids(1, 3), lambda *c, h=(): link("record", *[[b] for b in c], header=h)
    rows = [row("b4", "b5", "b6", h=head), row("b7", "b8", h=head), row("b4", "b7"), row("b10", "b11", h=["b1", "b99"]), link("record", ["b12"], [], ["b13"]), row("b14"), row("b17", "b18", h=["b17"])]
    out, counts = rp.repair_links(make("links", rows), make.boxes([], ids(1, 18)))
    assert {r.pos for r in out.collect() if r.reason is None} == {0, 1, 4}
    assert counted(counts) == {"link_already_linked": 1, "link_unknown_box": 1, "link_malformed": 2}


def test_texts_and_missed(make):
    boxes = make.boxes(ids(1, 3), ids(1, 4))
    out, counts = rp.repair_texts(make("texts", [("b1", "x"), ("b1", "y"), ("b9", "z"), ("b4", "w"), ("b2", "")]), boxes)
    assert [(r.box, r.text) for r in out.filter("reason is null").orderBy("pos").collect()] == [("b1", "x"), ("b2", "")]
    assert counted(counts) == {"second_text": 1, "text_unknown_box": 1, "text_not_target": 1, "text_missing": 1}
    assert counted(rp.repair_texts(make("texts", []), boxes)[1]) == {}
    out, counts = rp.repair_missed(make("missed", [("Networking", "c1"), ("  ", None), ("Help", "c9"), (None, "c1"), ("More", None)]), make("containers", WINDOWS))
    assert [(r.id, r.text, r.container) for r in out.orderBy("pos").collect()] == [("m1", "Networking", "c1"), ("m2", "Help", None), ("m3", "More", None)]
    assert counted(counts) == {"missed_empty": 2, "missed_unknown_container": 1}


def test_links_against_the_plain_rule(spark, make):
    """A record with thousands of links beside small ones."""
    rng = random.Random(2)
    rows, expected = [], {}
    for record, n, size in [(1, 3000, 900), *[(k, rng.randint(1, 9), 8) for k in range(2, 60)]]:
        taken: set = set()
        for pos in range(n):
            members = rng.sample(range(size), rng.randint(1, 3))
            reason = "link_malformed" if len(members) < 2 else "link_already_linked" if taken & set(members) else None
            taken |= set(members) if reason is None else set()
            expected[record, pos] = reason
            rows.append((record, pos, "run", [str(m) for m in members], len(members), [str(m) for m in members]))
    links = spark.createDataFrame(rows, "record long, pos int, kind string, refs array<string>, cells int, members array<string>")
    boxes = links.selectExpr("record", "explode(refs) as box").distinct().selectExpr("record", "box", "0 as place", "true as target")
    assert {(r.record, r.pos): r.reason for r in rp.repair_links(links, boxes)[0].collect()} == expected


def test_relinked(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for run in range(3):
        standing: list = []
        for frame in range(60):
            standing = [(end, lives) for end, lives in standing if end >= frame]
            for pos in range(rng.randint(0, 3)):
                lives, end = rng.sample(range(12), 2), frame + rng.randint(0, 8)
                ok = not any(set(lives) & set(held) for _, held in standing)
                standing += [(end, lives)] if ok else []
                expected[run, frame, pos] = ok
                rows.append((run, frame, pos, end, lives))
    got = rp.relinked(spark.createDataFrame(rows, "run long, frame int, pos int, end int, lives array<long>"))
    assert {(r.run, r.frame, r.pos): r.accepted for r in got.collect()} == expected and 0 < sum(expected.values()) < len(expected)


def test_lines_of_a_proposal_move_once(spark, sf):
    from tidemark import plans

    from .moved import shuffled

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    rows, _ = shuffled(spark, lambda: plans.queries()["proposal_repair"](spark, sf).collect())
    assert lines <= rows < 2 * lines


def test_proposals_with_nulls_as_sql_has_them(spark, sf, tmp_path):
    """Keys and states that are null, as names, references and kinds."""
    import duckdb

    from tidemark import plans

    from .oracle import assert_same

    folder, name = str(tmp_path), "lineitem.parquet"
    odd = ", ".join(f"case when (l_orderkey * 7 + l_linenumber * {k} + l_partkey) % 6 <> 0 then {c} end as {c}" for k, c in enumerate(("l_partkey", "l_suppkey", "l_linestatus"), 2))
    duckdb.execute(f"copy (select * replace ({odd}) from '{sf}/{name}' where l_orderkey % 3 = 0) to '{folder}/{name}'")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{folder}/{name}'")
    assert_same(plans.queries()["proposal_repair"](spark, folder).toPandas(), con.execute(plans.oracle_sql()["proposal_repair"].strip()).df())
