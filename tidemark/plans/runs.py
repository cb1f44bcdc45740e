"""Queries on runs: what is taken of them, their labels, figures and comparisons, over the driver's tables; each with its SQL.

Orders stand for frames, their lines for boxes, customers for videos; events and turns of conversations for steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from ..operators import labels as lb
from ..operators import matching as mt
from ..operators import nodes as nd
from ..operators import reports as rp
from ..operators import selection as sl
from ..operators import sequences as sq
from .common import seconds, table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", seconds(F.col("ts")))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes of frames; rectangles come from keys and quantities. An order's repeated line numbers are one box, that of the least part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")).alias("l"))
    x, y = F.col("l.l_partkey") % 300, F.col("l.l_suppkey") % 200
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("l.l_quantity").cast("long") + 10).alias("x1"), (y + 20).alias("y1"))
    return lines.select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("box"), box.alias("bbox"), F.col("l.l_partkey").alias("part"), F.col("l.l_quantity").alias("q"), F.col("l.l_returnflag").alias("flag"), F.col("l.l_linestatus").alias("status"))


_BOXES = """lines as (
  select l_orderkey as frame, l_linenumber as box, min({'p': l_partkey, 's': l_suppkey, 'q': l_quantity, 'r': l_returnflag, 'l': l_linestatus}) as m
  from lineitem group by all
), boxes as (
  select frame, box, m.p as part, m.q as q, m.r as flag, m.l as status, m.p % 300 as x0, m.s % 200 as y0, m.p % 300 + floor(m.q)::bigint + 10 as x1, m.s % 200 + 20 as y1 from lines
)"""


def blank_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sl.kept_lines(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
    return kept.groupBy("conv_id", "turn").agg(F.count("*").alias("n_kept"), F.max("dropped").cast("long").alias("n_dropped"), F.sum(F.length("line") * F.substring("box", 2, 9).cast("int")).alias("weighed"))


def frame_range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("frame"))
    changes = sq.transitions(orders, ["o_custkey"], ["frame"], ["frame"]).select(F.col("prev_frame").alias("from_frame"), F.col("frame").alias("to_frame"))
    sightings = boxes.select("frame", F.col("part").alias("lifetime"))
    parts = sl.frame_range(boxes, changes, sightings, 2000, 9000)
    return _union(*(p.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, p in zip(("boxes", "changes", "sightings"), parts)))


def _union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for m in more:
        first = first.unionByName(m)
    return first


def trigger_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sl.triggered(_boxes(spark, sf_dir), ["frame"], "q", 48, 120)
    return found.groupBy("by_one", "by_all", "triggered").agg(F.count("*").alias("n"))


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame"), F.col("o_custkey").alias("video_id"), "o_totalprice")
    boxes = _boxes(spark, sf_dir).join(orders.select("frame", "video_id"), "frame").select("video_id", "frame", "box", "flag", "status", "q")
    changed = F.when(F.col("o_totalprice") > 400_000, F.lit(None)).otherwise(F.floor(F.col("o_totalprice") / 150_000)).cast("int")
    transitions = orders.select("video_id", "frame", changed.alias("components"))
    return boxes, sl.plan_calls(boxes, transitions, boxes.filter("flag = 'R'"), boxes.filter("status = 'O' and q > 40"))


def call_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir)[1]
    return plan.select("video_id", "frame", F.size("targets").cast("long").alias("n_targets"), F.array_join("targets", ",").alias("targets"))


_PLAN = f"""{_BOXES}, placed as (
  select o_custkey as video_id, frame, box, flag, status, q from boxes join orders on o_orderkey = frame
), frames as (
  select video_id, frame, frame = min(frame) over (partition by video_id) as opening,
    (select case when o_totalprice > 400000 then null else floor(o_totalprice / 150000) end from orders where o_orderkey = frame) as components
  from (select distinct video_id, frame from placed)
), called as (select * from frames where opening or coalesce(components > 0, true)),
plan as (
  select video_id, frame, list(box order by box) filter (opening or flag = 'R' or (status = 'O' and q > 40)) as targets
  from called join placed using (video_id, frame) group by all
)"""


def call_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, plan = _plan(spark, sf_dir)
    return sl.projection(plan, boxes)


def resumed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    answers = events.select("user_id", "event_type", F.when(F.col("value") < 20, "failed").alias("error"))
    left = sl.pending(events.select("user_id", "event_type").distinct(), answers, ["user_id", "event_type"])
    return left.groupBy("event_type").agg(F.count("*").alias("n"), F.min("user_id").alias("first_user"))


def imported_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    digest = lambda old: orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderkey") <= old).alias("digest"))
    mine = digest(1 << 40)
    theirs = mine.withColumn("digest", F.when(F.col("o_orderpriority") < "3", F.col("digest")).otherwise(F.col("digest") + 1))
    rows = sl.imported(orders, 100, 12_000, "o_orderkey", mine, theirs, ["digest"], ["o_orderpriority"])
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))


def untouched_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return sl.without(table(spark, sf_dir, "part"), touched, ["p_partkey"]).select("p_partkey", "p_name")


def context_of_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sl.preceding(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "role", 3)
    return found.select("conv_id", "turn", F.array_join("context", ">").alias("context"))


def capped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.capped(_events(spark, sf_dir), ["user_id"], [F.col("ts"), F.col("event_id")], 4).select("user_id", "event_id", F.col("place").cast("long").alias("place"), F.col("left_out").cast("long").alias("left_out"))


def samples_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.sampled_by_kind(_events(spark, sf_dir), "event_type", "event_id", 7, "seed").select("event_type", "event_id")


def values_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sl.by_count(_events(spark, sf_dir), ["user_id"], "event_type", F.col("value") > 95)
    return found.select("user_id", F.array_join("values", ",").alias("kinds"))


def units_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _events(spark, sf_dir).select(F.concat(F.lit("c"), F.col("user_id") % 120).alias("unit")).distinct()
    return units.orderBy(*sl.unit_order(F.col("unit"))).limit(30)


def segments_of_fixed_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sq.fallback_segments(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 6)
    return found.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("place").cast("long").alias("first"))


def boundaries_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    places = talks.select("conv_id", F.col("turn").alias("id"), (F.row_number().over(sq.Window.partitionBy("conv_id").orderBy("turn")) - 1).alias("place"))
    proposed = talks.filter("(conv_id + turn) % 3 = 0").select("conv_id", F.explode(F.array(F.col("turn"), F.col("turn") + 1)).alias("id"), "role", "turn")
    proposed = proposed.select("conv_id", "id", F.concat_ws("-", "role", "turn").alias("label"), (F.col("turn") * 2 + (F.col("id") != F.col("turn")).cast("int")).alias("pos"))
    return sq.repaired_boundaries(proposed, places, ["conv_id"])


_DAYS = [1704067200.0, 1704153600.0, 1704153700.0, 1704240000.0, 1704326400.0]


def starts_of_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = sq.fallback_segments(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 1)
    return sq.chapter_starts(steps, _DAYS, ["user_id"], "t", "place").select("user_id", F.col("place").cast("long").alias("place"), "label")


def long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sq.parts_of(_events(spark, sf_dir).withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp"))), ["event_type"], ["ts", "event_id"], F.col("_at"), 1500, 400)
    return found.groupBy("event_type", "part").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


def restricted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _boxes(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("box", "part"))), lambda x: x["part"] % 7).alias("refs"))
    kept, invalid = tx.allowed_refs(F.col("refs"), F.array(*map(F.lit, (1, 3, 5))).cast("array<bigint>"))
    cited, wrong = nd.valid_citations(F.col("refs"), F.array(*map(F.lit, (1, 3, 5))).cast("array<bigint>"))
    return refs.select("frame", F.array_join(kept.cast("array<string>"), ",").alias("kept"), invalid.cast("long").alias("invalid"), F.array_join(cited.cast("array<string>"), ",").alias("cited"), wrong.cast("long").alias("wrong"))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("quantity", F.floor("l_quantity")).withColumn("late", (F.col("l_discount") > 0.05).cast("int"))
    return rp.counts_by(lines, {"transitions": "l_returnflag", "records": "l_linestatus"}, ["quantity", "late"])


def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "lineitem").select(F.floor("l_quantity").alias("unchanged"), (F.col("l_linenumber") - 1).alias("variants"), F.floor(F.col("l_discount") * 100).cast("long").alias("lost"))
    return rp.stability(changes)


def text_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    lifetimes = boxes.select(F.concat("flag", "status", (F.col("part") % 500).cast("string")).alias("text"), (F.col("q") > 40).alias("unstable"), (F.col("part") % 4).alias("sightings"))
    return rp.fragmentation(lifetimes)


def likeness_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sq.transitions(table(spark, sf_dir, "part"), ["p_brand"], ["p_partkey"], ["p_name"])
    return rp.marks_matched(pairs, ["p_brand"], tx.similarity(F.col("prev_p_name"), F.col("p_name")), 0.3)


def question_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 3 == 0, "negative").otherwise("positive").alias("polarity"))
    label = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "partial").when(F.col("toxic") == 0, "wrong")
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), label.alias("label"), (F.col("quality") - F.col("toxic") * 0.5).alias("score"))
    return rp.question_section(answers, judged)


def rows_of_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = _events(spark, sf_dir).groupBy(F.col("event_type").alias("config"), (F.col("user_id") % 6).alias("repeat")).agg(F.count("*").alias("n"))
    return rp.config_rows(cards, "n").select("config", "repeats", F.array_join(F.col("per_repeat").cast("array<string>"), ",").alias("per_repeat"), "mean")


def flipped_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = _events(spark, sf_dir).withColumn("unit", F.concat_ws("-", F.col("event_type"), (F.col("user_id") % 400).cast("string")))
    units = units.groupBy("unit", (F.col("event_id") % 2).alias("side")).agg(F.max((F.col("value") > 60).cast("int")).alias("value"))
    return rp.flips(units.filter("side = 0"), units.filter("side = 1"))


def scores_of_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 3).alias("reader"), (F.col("event_type") != "error").alias("exact"), F.when(F.col("value") < 90, F.floor(F.col("value")).cast("long") - 50).alias("error"))
    return rp.by_reader(scored, ["user_id"], "reader").select("user_id", F.col("exact").cast("int").alias("exact"), "error")


def rubric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rp.lines_passed(_boxes(spark, sf_dir), ["frame"], F.col("q") >= 10)
    price = rp.break_even(F.col("lines") * 100.0, F.col("passed") * 2.0, F.lit(3.0))
    return found.select("frame", "passed", "lines", F.col("whole").cast("int").alias("whole"), F.round(price, 4).alias("break_even"))


def low_half_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp.low_half(_events(spark, sf_dir).withColumn("v", F.floor("value").cast("double")), "v", "user_id", ["event_type"]).select("event_type", "median")


def labels_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    sources = boxes.select(tx.box_ref(F.col("frame"), F.col("box").cast("string")).alias("ref"), F.when(F.col("q") > 5, F.col("frame")).alias("frame"), "box")
    assign = boxes.filter("box < 5").select("frame", "box", (F.col("part") % 3).alias("container"), F.col("status").alias("pane"), "part").withColumn("pos", F.col("part"))
    orders = table(spark, sf_dir, "orders")
    containers = orders.select(F.col("o_orderkey").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("container"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("name"))
    texts = boxes.filter("flag = 'R'").select("frame", "box", F.lit("R").alias("reading"), F.col("part").alias("pos"))
    found = lb.box_labels(sources, assign, containers, texts)
    return found.select("ref", "second", lb.shown(F.col("container"), F.col("pane")).alias("label"))


def links_of_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    links = boxes.filter("box <= 2").groupBy("frame").agg(F.array_sort(F.collect_list("box")).alias("boxes")).filter("size(boxes) = 2").select("frame", F.lit(1).alias("link"), F.lit("run").alias("kind"), "boxes")
    lifetimes = boxes.filter("q > 4").select("frame", "box", (F.col("part") % 20).alias("lifetime"))
    return lb.lifetime_links(links, lifetimes).select("lifetime", F.array_join(F.col("relation").cast("array<string>"), ">").alias("relation"), "records", "first_frame")


def texts_of_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir).select("frame", F.col("box").cast("string").alias("box"), F.col("flag").alias("text"))
    refs = boxes.filter("frame % 5 = 0").select(tx.box_ref(F.col("frame"), F.col("box")).alias("ref"))
    found = lb.texts_of_refs(refs, boxes).withColumn("p", tx.parsed_ref(F.col("ref")))
    return found.select("ref", "text", F.col("p.frame").alias("frame_of"), F.col("p.box").alias("box_of"))


def snapped_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    move = (F.col("part") % 4) * 12
    b = F.col("bbox")
    rect = F.struct((b["x0"] + move).alias("x0"), (b["y0"] + move).alias("y0"), (b["x1"] + move).alias("x1"), (b["y1"] + move).alias("y1"))
    rects = boxes.select("frame", (F.col("frame") * 10 + F.col("box")).alias("rect_id"), rect.alias("rect"))
    found = lb.snapped(rects, boxes.select("frame", "box", F.col("box").alias("pos"), "bbox"), 40.0)
    return found.select("rect_id", F.col("box").cast("long").alias("box"))


def rectangles_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sq.transitions(_boxes(spark, sf_dir), ["frame"], ["box"], ["bbox"])
    a, b = F.col("prev_bbox"), F.col("bbox")
    whole = geo.union(a, b)
    grown = geo.grow(b, F.lit(7), F.lit(300), F.lit(200))
    return pairs.select(
        "frame", "box", geo.intersection(a, b).cast("long").alias("shared"), F.round(geo.iou(a, b), 6).alias("iou"), geo.area(whole).cast("long").alias("around"), geo.area(grown).cast("long").alias("grown"),
        F.round(geo.gap(a, b), 6).alias("gap"), F.round(geo.centre_distance(a, b), 6).alias("apart"), geo.relation(a, b).alias("relation"),
    )


def overlapping_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    a = boxes.select("frame", F.col("box").alias("i"), F.col("bbox").alias("p"))
    b = boxes.select("frame", F.col("box").alias("j"), F.col("bbox").alias("q"))
    return geo.overlap_join(a, b, ["frame"], "p", "q").filter("i < j").select("frame", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("area").cast("long").alias("area"))


def margins_of_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    tall = F.struct(F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0"), F.col("bbox.x1").alias("x1"), (F.col("bbox.y0") + F.floor("q").cast("long")).alias("y1"))
    return mt.margin_px(boxes.select(F.col("frame").alias("pair"), tall.alias("bbox")), 0.5).select("pair", F.col("m").cast("long").alias("m"))


def rebuilt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).select("frame", "box", F.concat("flag", "status").alias("text"), (F.col("box") * 20 + F.col("part") % 9).alias("x0"), (F.col("box") * 20 + F.col("part") % 9 + F.floor("q").cast("long") % 20).alias("x1"), F.lit(16).alias("height"))
    return lb.rebuilt(words, ["frame"], "box", 0.25)


def claims_in_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "yes").otherwise("no").alias("submitted"), F.when(F.col("turn") % 7 == 0, "late").alias("error"), F.coalesce("text", F.lit("")).alias("entered"))
    found = lb.claims(changes, tx.norm(F.col("entered")))
    return found.select("conv_id", "turn", F.md5(F.col("claim").cast("binary")).alias("claim_md5"))


def transient_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    error = F.when(k == 0, F.concat(F.lit("api: "), F.col("event_type"))).when(k == 1, "max_tokens").when(k == 2, F.concat(F.lit("schema api:"), F.col("event_type"))).when(k == 3, "")
    return _events(spark, sf_dir).groupBy("event_type", tx.is_transient(error).cast("int").alias("transient")).agg(F.count("*").alias("n"))


def kinds_of_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sq.transitions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderkey"], ["o_orderstatus"])
    kind = tx.transition_kind(F.col("prev_o_orderstatus") != "P", F.col("o_orderstatus") != "P")
    return pairs.groupBy("o_custkey", kind.alias("kind")).agg(F.count("*").alias("n"))


def malformed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _boxes(spark, sf_dir).groupBy("frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("box", "part"))), lambda x: x["part"] % 40).alias("refs"))
    kind = F.element_at(F.array(F.lit("run"), F.lit("pair"), F.lit("record")), (F.col("frame") % 3 + 1).cast("int"))
    return refs.select("frame", nd.malformed(kind, F.col("refs"), F.slice("refs", 2, 3)).cast("int").alias("malformed"))


def collapse_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    key = tx.collapse_key(F.col("text"), F.split("text", r"\.", -1), ["of  the", "and"])
    return talks.select("conv_id", "turn", F.get(key, F.lit(0)).alias("tag"), F.size(key).cast("long").alias("parts"), F.md5(F.array_join(key, "|").cast("binary")).alias("key_md5"))


SQL = {
    "blank_lines_dropped": r"""with l as (select conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from conversations),
k as (select *, row_number() over (partition by conv_id, turn order by i) as b from l where regexp_matches(line, '\S')),
d as (select conv_id, turn, count(*) filter (not regexp_matches(line, '\S')) as n_dropped from l group by all)
select conv_id, turn, count(*) as n_kept, max(n_dropped) as n_dropped, sum(length(line) * b)::bigint as weighed from k join d using (conv_id, turn) group by all""",
    "frame_range_select": f"""with {_BOXES}, c as (select lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as a, o_orderkey as b from orders)
select 'boxes' as kind, count(*) as n from boxes where frame between 2000 and 9000
union all select 'changes', count(*) from c where a >= 2000 and b <= 9000
union all select 'sightings', count(*) from boxes where part in (select part from boxes where frame between 2000 and 9000)""",
    "trigger_frames": f"""with {_BOXES}, f as (select max(q) >= 48 as by_one, sum(q) >= 120 as by_all from boxes group by frame)
select by_one, by_all, by_one or by_all as triggered, count(*) as n from f group by all""",
    "call_plan": f"with {_PLAN} select video_id, frame, coalesce(len(targets), 0)::bigint as n_targets, coalesce(array_to_string(targets, ','), '') as targets from plan",
    "call_projection": f"""with {_PLAN}, n as (select count(distinct frame) as frames, count(*) as boxes from placed),
c as (select count(*) as calls, count(*) filter (coalesce(len(targets), 0) = 0) as calls_without_targets, sum(coalesce(len(targets), 0))::bigint as target_boxes from plan)
select *, round(target_boxes / boxes, 4) as share_of_boxes, round(target_boxes / calls, 2) as targets_per_call, round(boxes / frames, 2) as boxes_per_frame from n, c""",
    "resumed_requests": """with left_ as (select distinct user_id, event_type from events except select user_id, event_type from events where value >= 20 or value is null)
select event_type, count(*) as n, min(user_id) as first_user from left_ group by event_type""",
    "imported_orders": "select o_orderpriority, count(*) as n, max(o_orderkey) as last from orders where o_orderkey between 100 and 12000 and o_orderpriority < '3' group by 1",
    "untouched_parts": "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)",
    "context_of_turns": "select conv_id, turn, coalesce(array_to_string(list(role) over (partition by conv_id order by turn rows between 3 preceding and 1 preceding), '>'), '') as context from conversations",
    "capped_events": """select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as place, greatest(count(*) over (partition by user_id) - 4, 0) as left_out
from events qualify place <= 4""",
    "samples_of_kinds": "select event_type, event_id from events qualify row_number() over (partition by event_type order by md5('seed/' || event_id), event_id) <= 7",
    "values_by_count": """with c as (select user_id, event_type, count(*) as n, max((value > 95)::int) as f from events group by all)
select user_id, string_agg(event_type, ',' order by f desc, n desc, event_type) as kinds from c group by user_id""",
    "units_in_order": "select distinct 'c' || (user_id % 120) as unit from events order by length(unit), unit limit 30",
    "segments_of_fixed_size": """with p as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events)
select user_id, (place // 6 + 1)::int as segment, count(*) as n, min(place) as first from p group by all""",
    "boundaries_repaired": """with p as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) - 1 as place from conversations),
q as (select conv_id, turn as id, role || '-' || turn as label, turn * 2 as pos from p where (conv_id + turn) % 3 = 0 union all select conv_id, turn + 1, role || '-' || turn, turn * 2 + 1 from p where (conv_id + turn) % 3 = 0),
k as (select conv_id, place, arg_min(label, pos) as label from q join p using (conv_id) where q.id = p.turn group by all)
select conv_id, place::int as place, label from k union all select distinct conv_id, 0, 'segment 1' from p where conv_id not in (select conv_id from k where place = 0)""",
    "starts_of_chapters": """with p as (select user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) - 1 as place from events),
f as (select distinct user_id, min(place) as place from p, (values (1704067200.0), (1704153600.0), (1704153700.0), (1704240000.0), (1704326400.0)) as c(s) where t >= s group by user_id, s)
select user_id, place, 'chapter ' || row_number() over (partition by user_id order by place) as label from f""",
    "long_segments": """with p as (select event_type, event_id, row_number() over (partition by event_type order by ts, event_id) - 1 as place, count(*) over (partition by event_type) as n from events)
select event_type, (case when n > 1500 then place // 400 else 0 end)::int as part, count(*) as n, min(event_id) as least from p group by 1, 2""",
    "restricted_references": f"""with {_BOXES}, r as (select frame, list(part % 7 order by box, part) as refs from boxes group by frame)
select frame, array_to_string(list_filter(refs, lambda x: x in (1, 3, 5)), ',') as kept, len(list_filter(refs, lambda x: x not in (1, 3, 5)))::bigint as invalid,
  array_to_string(list_filter(list_filter(refs, lambda x: x in (1, 3, 5)), lambda x, i: list_position(list_filter(refs, lambda y: y in (1, 3, 5)), x) = i), ',') as cited, invalid as wrong from r""",
    "run_totals": """select 'transitions' as metric, l_returnflag as kind, count(*) as n from lineitem group by 2 union all select 'records', l_linestatus, count(*) from lineitem group by 2
union all select 'quantity', null, sum(floor(l_quantity))::bigint from lineitem union all select 'late', null, count(*) filter (l_discount > 0.05) from lineitem""",
    "run_stability": "select round((sum(floor(l_quantity)) - sum(l_linenumber - 1)) / (sum(floor(l_quantity)) + sum(floor(l_discount * 100))), 4) as stability from lineitem",
    "text_fragmentation": f"""with {_BOXES}, t as (select flag || status || (part % 500) as text, count(*) as n, count(*) filter (q > 40) as u, count(*) filter (part % 4 = 1) as s from boxes group by 1),
a as (select sum(n)::bigint as lifetimes, count(*) as distinct_texts, sum(u)::bigint as unstable, sum(s)::bigint as single_sighting, round(sum(n) / count(*), 3) as per_text from t)
select text, n, a.* from (select text, n from t order by n desc, text limit 20), a""",
    "likeness_of_names": """with p as (select p_brand, p_name as b, lag(p_name) over (partition by p_brand order by p_partkey) as a from part)
select p_brand, count(*) filter (1 - levenshtein(a, b) / greatest(length(a), length(b)) >= 0.3) as hits, count(*) as total from p where a is not null group by 1""",
    "question_sections": """with a as (select doc_id as key, case when doc_id % 3 = 0 then 'negative' else 'positive' end as polarity from documents),
j as (select doc_id as key, case when quality = 1 and toxic = 0 then 'correct' when quality = 1 then 'partial' when toxic = 0 then 'wrong' end as label, quality - toxic * 0.5::double as score, true as judged from labels)
select polarity, count(judged) as n, count(*) filter (label = 'correct') as correct, count(*) filter (label = 'partial') as partial, count(*) filter (label = 'wrong') as wrong,
  count(*) filter (judged and label is null) as unscored, round(avg(score) filter (label is not null), 4) as mean, count(*) filter (judged is null) as stale from a left join j using (key) group by polarity""",
    "rows_of_configs": """with c as (select event_type as config, user_id % 6 as repeat, count(*) as n from events group by all)
select config, count(*) as repeats, string_agg(n::varchar, ',' order by repeat) as per_repeat, round(avg(n), 4) as mean from c group by config""",
    "flipped_units": """with u as (select event_type || '-' || (user_id % 400) as unit, event_id % 2 as side, max((value > 60)::int) as value from events group by all)
select a.unit, case when a.value = 1 then 'A' else 'B' end as only from u a join u b on a.unit = b.unit and a.side = 0 and b.side = 1 where a.value <> b.value""",
    "scores_of_readers": """with s as (select user_id, event_id % 3 as reader, event_type <> 'error' as exact, case when value < 90 then floor(value)::bigint - 50 end as error from events),
g as (select user_id, max(exact)::int as exact, min({'a': abs(error), 'o': reader, 'e': error}) filter (exact and error is not null) as m from s group by user_id)
select user_id, exact, m.e as error from g""",
    "rubric_lines": f"""with {_BOXES}, l as (select frame, count(*) filter (q >= 10) as passed, count(*) as lines from boxes group by frame)
select *, (passed = lines)::int as whole, round(case when passed * 2 > 3 then lines * 100.0 / (passed * 2.0 - 3.0) end, 4) as break_even from l""",
    "low_half_by_counts": """with r as (select event_type, user_id, floor(value) as v, row_number() over (partition by event_type order by floor(value), user_id) as k, count(floor(value)) over (partition by event_type) as n from events where value is not null)
select event_type, median(user_id) as median from r where k <= ceil(n / 2) group by 1""",
    "labels_of_boxes": f"""with {_BOXES} select frame || ':' || box as ref, case when q > 5 and flag = 'R' then 'R' end as second,
  array_to_string(list_filter([case when q > 5 and box < 5 and part % 3 < 2 then o_orderstatus || ' ' || o_orderpriority end, case when q > 5 and box < 5 then status end], lambda x: x is not null), ', ') as label
from boxes left join orders on o_orderkey = frame""",
    "links_of_lifetimes": f"""with {_BOXES}, l as (
  select a.frame, a.part % 20 as x, b.part % 20 as y from boxes a join boxes b on a.frame = b.frame and a.box = 1 and b.box = 2 where a.q > 4 and b.q > 4
), m as (select x, y, count(*) as records, min(frame) as first_frame from l group by x, y)
select x as lifetime, x || '>' || y as relation, records, first_frame from m union all select y, x || '>' || y, records, first_frame from m where x <> y""",
    "texts_of_references": f"with {_BOXES} select frame || ':' || box as ref, flag as text, frame as frame_of, box::varchar as box_of from boxes where frame % 5 = 0",
    "snapped_rectangles": f"""with {_BOXES}, r as (select frame, frame * 10 + box as rect_id, x0 + part % 4 * 12 as x0, y0 + part % 4 * 12 as y0, x1 + part % 4 * 12 as x1, y1 + part % 4 * 12 as y1 from boxes),
p as (
  select r.rect_id, b.box, r.x0 = b.x0 and r.y0 = b.y0 and r.x1 = b.x1 and r.y1 = b.y1 as same, greatest(least(r.x1, b.x1) - greatest(r.x0, b.x0), 0) * greatest(least(r.y1, b.y1) - greatest(r.y0, b.y0), 0) as area,
    sqrt(((r.x0 + r.x1 - b.x0 - b.x1) / 2.0) ** 2 + ((r.y0 + r.y1 - b.y0 - b.y1) / 2.0) ** 2) as far from r join boxes b using (frame)
)
select rect_id, (coalesce(min(box) filter (same), arg_min(box, {{'a': -area, 'b': box}}) filter (area > 0), arg_min(box, {{'a': far, 'b': box}}) filter (far <= 40)))::bigint as box from p group by rect_id""",
    "rectangles_compared": f"""with {_BOXES}, p as (select *, lag({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) over (partition by frame order by box) as a from boxes),
w as (select *, least(a.x1, x1) - greatest(a.x0, x0) as dx, least(a.y1, y1) - greatest(a.y0, y0) as dy, (a.x1 - a.x0) * (a.y1 - a.y0) + (x1 - x0) * (y1 - y0) as sum_of from p where a is not null),
s as (select *, greatest(dx, 0) * greatest(dy, 0) as shared from w)
select frame, box, shared, round(shared / (sum_of - shared), 6) as iou, (greatest(a.x1, x1) - least(a.x0, x0)) * (greatest(a.y1, y1) - least(a.y0, y0)) as around,
  (least(x1 + 7, 300) - greatest(x0 - 7, 0)) * (least(y1 + 7, 200) - greatest(y0 - 7, 0)) as grown, round(sqrt(greatest(-dx, 0)::double ** 2 + greatest(-dy, 0)::double ** 2), 6) as gap,
  round(sqrt((a.x0 + a.x1 - x0 - x1)::double ** 2 + (a.y0 + a.y1 - y0 - y1)::double ** 2) / 2, 6) as apart,
  case when dy > 0 and dx > 0 then 'overlap' when dy > 0 then 'beside' when dx > 0 and a.y1 <= y0 then 'above' when dx > 0 then 'below' else 'diagonal' end as relation from s""",
    "overlapping_boxes": f"""with {_BOXES}, p as (
  select a.frame, a.box as i, b.box as j, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) as area from boxes a join boxes b on a.frame = b.frame and a.box < b.box
)
select frame, i::bigint as i, j::bigint as j, area from p where area > 0""",
    "margins_of_frames": f"with {_BOXES} select frame as pair, floor(0.5 * median(floor(q)) + 0.5)::bigint as m from boxes group by frame",
    "rebuilt_lines": f"""with {_BOXES}, w as (select frame, box, flag || status as text, box * 20 + part % 9 as x0, box * 20 + part % 9 + floor(q)::bigint % 20 as x1 from boxes),
g as (select *, x0 - lag(x1) over (partition by frame order by box) as gap from w)
select frame, string_agg(case when gap > 0 and gap >= 4 then ' ' else '' end || text, '' order by box) as line from g group by frame""",
    "claims_in_turns": r"""select conv_id, turn, md5(trim(regexp_replace(translate(text, '“”‘’', '""'''''), '\s+', ' ', 'g'))) as claim_md5
from conversations where role = 'user' and turn % 7 <> 0 and regexp_matches(text, '\S')""",
    "transient_failures": "select event_type, (event_id % 5 < 2)::int as transient, count(*) as n from events group by all",
    "kinds_of_transitions": """with p as (select o_custkey, o_orderstatus as b, lag(o_orderstatus) over (partition by o_custkey order by o_orderkey) as a from orders)
select o_custkey, case when a <> 'P' and b <> 'P' then 'single' else 'unsettled' end as kind, count(*) as n from p where a is not null group by all""",
    "malformed_links": f"""with {_BOXES}, r as (select frame, list(part % 40 order by box, part) as refs from boxes group by frame)
select frame, (len(list_distinct(refs)) <> len(refs) or (frame % 3 = 0 and len(refs) < 2) or (frame % 3 > 0 and len(refs[2:4]) < 2))::int as malformed from r""",
    "collapse_keys": r"""with t as (
  select conv_id, turn, coalesce(text, '') as text, string_split(coalesce(text, ''), '.') as b from conversations
), h as (
  select *, list_filter(list_transform(b, lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), lambda x: contains(x, 'of the') or contains(x, 'and')) as held,
    list_filter(string_split(text, chr(10)), lambda x: contains(lower(x), 'of  the') or contains(lower(x), 'and')) as m from t
), k as (select *, case when len(held) > 0 then ['boxes'] || held when len(m) > 0 then ['lines'] || m else ['lines'] || string_split(text, chr(10)) end as key from h)
select conv_id, turn, key[1] as tag, len(key)::bigint as parts, md5(array_to_string(key, '|')) as key_md5 from k""",
}
QUERIES = {name: globals()[name] for name in SQL}
