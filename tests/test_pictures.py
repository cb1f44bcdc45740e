"""Scenarios of cursors and content, and the two drivers against each other."""

from __future__ import annotations

import random

import pytest

from tidemark.streaming.pictures import Blinkers, Pictures, Rules, blinks, settled_pictures, settled_stream

FPS = 30


def shape(x0, y0, x1, y1, v="1"):
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "v": v}


def glyphs(n, x0=10):
    return [shape(x0 + 8 * k, 20, x0 + 8 * k + 6, 30) for k in range(n)]


def states(frames):
    m = Pictures()
    out = [r for k, f in enumerate(frames) for r in m.step(k / FPS, f)] + list(m.close())
    for a, b in zip(out, out[1:]):
        assert a[0] <= a[1] <= a[2] == b[0]
        assert a[3] or b[3] or b[1] - a[1] >= 3 - 1e-6
    return out


def near(x):
    return pytest.approx(x, abs=1e-6)


def test_still_and_single_change():
    assert len(states([[]] * 90)) == 1
    first, second = states([[]] * 30 + [glyphs(1)] * 60)
    assert second[:2] == (near(1.0), near(1.0)) and second[3] and first[2] == second[0] and second[4] == 1


def test_flash_is_no_state():
    assert len(states([[]] * 30 + [glyphs(2)] * 6 + [[]] * 60)) == 1


def test_bar_caret_is_no_state_but_the_caret_of_one():
    out = states([[shape(100, 20, 102, 38)] if k // 15 % 2 else [] for k in range(150)])
    assert len(out) == 1 and out[0][5] == [100, 20, 102, 38]


@pytest.mark.parametrize("first", [15, 30])
def test_block_cursor_is_learned_and_its_state_withheld(first):
    """The cursor's toggles look like changes until the third; the emission waits for them, and times go back to the real motion."""
    frames = [[]] * 15 + [glyphs(1) + ([shape(20, 20, 28, 32)] if k >= first and (k - first) // 15 % 2 == (first == 15) else []) for k in range(15, 240)]
    out = states(frames)
    assert len(out) == 2 and all(s[3] for s in out) and out[1][0] == near(0.5) and abs(out[1][1] - 0.5) < 0.05
    assert out[1][5] == [20, 20, 28, 32]


def test_a_spot_that_never_recurs_becomes_content():
    """It may be a blinker at first, so the emission is held back; with no recurrence in time it comes out, dated by its motion."""
    m, frames = Pictures(), [[]] * 15 + [[shape(20, 20, 28, 32)]] * 60
    out = [(k / FPS, r) for k, f in enumerate(frames) for r in m.step(k / FPS, f)]
    assert len(out) == 1 and out[0][0] > 0.5 + 0.8  # the first state ends when the second is shown
    assert list(m.close())[0][:4] == (near(0.5), near(0.5), near(74 / FPS), True)


def test_typing():
    fast = [[]] * 30 + [f for k in range(1, 6) for f in [glyphs(k)] * 8] + [glyphs(5)] * 60
    out = states(fast)
    assert len(out) == 2 and out[1][:2] == (near(1.0), near((30 + 32) / FPS))
    assert len(states([[]] * 30 + [glyphs(1)] * 30 + [glyphs(2)] * 60)) == 3


def moving(n):
    return [[shape(10 + k * 5 % 140, 30, 30 + k * 5 % 140, 50)] for k in range(n)]


def test_hold_then_settle():
    frames = [[]] * 30 + moving(150)
    out = states(frames + [frames[-1]] * 60)
    held = [s for s in out if not s[3]]
    assert len(held) == 1 and held[0][:2] == (near(1.0), near(4.0)) and out[-1][1] == near((30 + 149) / FPS)
    frames = [[]] * 30 + moving(91)
    out = states(frames + [frames[-1]] * 60)
    assert len(out) == 2 and out[1][3] and out[1][1] == near(4.0)  # the snapshot itself settles


def test_end_of_stream():
    out = states([[]] * 30 + [glyphs(3)] * 5)
    assert len(out) == 2 and out[1][3]
    out = states([[]] * 30 + moving(100))
    assert len(out) == 2 and not out[1][3]  # none right after a snapshot


def test_caret_of_an_interval_that_is_long_over():
    frames = [[shape(100, 20, 102, 38)] if k // 15 % 2 else [] for k in range(60)]
    frames += [glyphs(1, 110) + ([shape(140, 20, 142, 38)] if k // 15 % 2 else []) for k in range(60, 300)]
    out = states(frames)
    assert [s[5][0] for s in out] == [100, 140]


def test_blinkers_match_by_overlap_and_are_forgotten():
    b, box, sure = Blinkers(Rules()), (50, 20, 58, 32), None
    for k in range(120):
        explained, _ = b.observe([box if k % 30 else (51, 20, 59, 32)] if k % 15 == 0 else [], k / 30)
        sure = k / 30 if explained and sure is None else sure
    assert sure == 1.0 and b.known((51, 21, 58, 32)) and b.caret(0.9, 1.6) is not None
    for k in range(120, 220):
        b.observe([], k / 30)
    assert not b.known(box) and b.caret(0.9, 1.6) is not None and b.caret(9, 10) is None
    assert all(b.observe([(0, 0, 41, 40)], k / 2)[0] == set() for k in range(9))  # too large


def test_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for key in ("u", "v", "w"):
        shown: list = []
        for k in range(400):
            if rng.random() < 0.03:
                shown = glyphs(rng.randint(0, 4), rng.choice([10, 60]))
            cursor = [shape(150, 20, 158, 32)] if k > 40 and k // 15 % 2 else []
            rows.append((key, k / FPS, None if key == "w" and k % 97 == 5 else [tuple(s.values()) for s in shown + cursor]))
    kind = "key string, t double, shapes array<struct<x0:int,y0:int,x1:int,y1:int,v:string>>"
    samples = spark.createDataFrame(rows, kind)
    batch = {tuple(map(str, r)) for r in settled_pictures(samples).collect()}
    assert len(batch) > 12 and any(r[-1] != "None" for r in batch)
    for part in range(4):
        chosen = [r for r in rows if int(r[1] // 4) == part]
        made = spark.createDataFrame(chosen, kind).selectExpr("*", "timestamp_micros(cast((t + 1000) * 1000000 as long)) as ts")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    query = settled_stream(stream).writeStream.format("memory").queryName("pictures").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(map(str, r)) for r in spark.table("pictures").collect()}
    assert got <= batch and len(batch) - len(got) <= 2 * 3  # the last states are open until a key times out


def test_blinks_by_row(spark):
    rows = [("k", t, (50, 20, 58, 32)) for t in (0.0, 0.5, 1.0, 1.5, 9.0)] + [("k", 1.0, (0, 0, 90, 90)), (None, 0.0, (0, 0, 1, 1))]
    got = blinks(spark.createDataFrame(rows, "key string, t double, rect struct<x0:int,y0:int,x1:int,y1:int>")).collect()
    assert len(got) == len(rows) and {r.t for r in got if r.blinks} == {1.0, 1.5} and {r.confirmed_at for r in got if r.blinks} == {1.0}
    assert blinks(spark.createDataFrame([], "key string, t double, rect struct<x0:int,y0:int,x1:int,y1:int>")).count() == 0
