"""Nodes of all levels from the tables of a run, labels carried along lifetimes, and ordered repair of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sequences import carried

COLUMNS = ("node_id", "video_id", "level", "item_id", "ordinal", "t_start", "t_end", "apps", "text")


def text_of(lines: DataFrame, key: list[str], order: list[str], line: str = "text", distinct: bool = False) -> DataFrame:
    """Non-empty lines of a key in order, joined by newlines; each once if ``distinct``. Keys without any line are left out."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(*order, line))), lambda x: x[line])
    if distinct:
        texts = F.array_distinct(texts)
    return lines.filter(F.trim(line) != "").groupBy(*key).agg(F.array_join(texts, "\n").alias("text")).filter("text <> ''")


def lifetimes(edges: DataFrame, boxes: DataFrame) -> DataFrame:
    """Chains of boxes over ``edges`` (video_id, frame, box, next_box: same entity in the next frame) as (video_id, frame, box, lifetime).

    A box without an edge into it starts a lifetime, named by its place among starts. Chains are followed by doubling: after k rounds
    a box knows its ancestor 2^k frames back, so n frames take about log2(n) joins.
    """
    me = boxes.select("video_id", "frame", "box")
    into = edges.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("next_box").alias("box"), F.col("frame").alias("up_frame"), F.col("box").alias("up_box"))
    out = me.join(into, ["video_id", "frame", "box"], "left")
    while not out.filter("up_box is not null").isEmpty():
        top = out.select("video_id", F.col("frame").alias("up_frame"), F.col("box").alias("up_box"), F.col("up_frame").alias("to_frame"), F.col("up_box").alias("to_box"), F.coalesce("root_frame", "frame").alias("r_frame") if "root_frame" in out.columns else F.col("frame").alias("r_frame"), F.coalesce("root_box", "box").alias("r_box") if "root_box" in out.columns else F.col("box").alias("r_box"))
        step = out.join(top, ["video_id", "up_frame", "up_box"], "left")
        known = ("root_frame", "root_box") if "root_frame" in out.columns else (None, None)
        root = lambda k, r: F.coalesce(F.col(r), F.col(k)) if k else F.col(r)
        out = step.select("video_id", "frame", "box", F.col("to_frame").alias("up_frame"), F.col("to_box").alias("up_box"), root(known[0], "r_frame").alias("root_frame"), root(known[1], "r_box").alias("root_box"))
        out = cut(out)
    if "root_frame" not in out.columns:
        out = out.withColumn("root_frame", F.lit(None).cast("int")).withColumn("root_box", F.lit(None).cast("string"))
    out = out.select("video_id", "frame", "box", F.coalesce("root_frame", "frame").alias("root_frame"), F.coalesce("root_box", "box").alias("root_box"))
    w = Window.partitionBy("video_id").orderBy("root_frame", "root_box")
    return out.withColumn("lifetime", F.concat(F.lit("L"), F.dense_rank().over(w))).drop("root_frame", "root_box")


def carried_labels(boxes: DataFrame, labels: DataFrame) -> DataFrame:
    """``boxes`` (video_id, lifetime, frame, box) with the label of the latest labelled box at or before them in their lifetime, and that box's frame."""
    own = boxes.join(labels.select("video_id", "frame", "box", "label"), ["video_id", "frame", "box"], "left")
    own = carried(own, ["video_id", "lifetime"], ["frame"], F.when(F.col("label").isNotNull(), F.struct("frame", "label")), "_from")
    return own.withColumn("label", F.col("_from.label")).withColumn("label_frame", F.col("_from.frame")).drop("_from")


def in_force(links: DataFrame, boxes: DataFrame) -> DataFrame:
    """Links (video_id, link, frame, lifetime per member) at each later frame: they hold as long as every member's lifetime has a box there without a break.

    Returns video_id, link, frame. A running minimum over frames ends a link at its first gap for good.
    """
    members = links.groupBy("video_id", "link").agg(F.count("*").alias("size"), F.min("frame").alias("start"))
    at = links.select("video_id", "link", "lifetime").join(boxes.select("video_id", "lifetime", F.col("frame").alias("at")), ["video_id", "lifetime"])
    alive = at.groupBy("video_id", "link", "at").agg(F.count_distinct("lifetime").alias("there")).join(members, ["video_id", "link"]).filter(F.col("at") >= F.col("start"))
    w = Window.partitionBy("video_id", "link").orderBy("at")
    alive = alive.withColumn("whole", (F.col("there") == F.col("size")).cast("int")).withColumn("run", F.col("at") - F.row_number().over(w))
    first = F.first("run").over(w)
    so_far = F.min("whole").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return alive.withColumn("ok", (so_far == 1) & (F.col("run") == first)).filter("ok").select("video_id", "link", F.col("at").alias("frame"))


def first_reason(rules: dict[str, Column]) -> Column:
    """Name of the first rule that a row breaks, null if none."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def repair_assignments(assign: DataFrame, boxes: DataFrame, targets: DataFrame, containers: DataFrame) -> DataFrame:
    """Proposed (frame, pos, box, container) with ``reason``: unknown_box, not_target, unknown_container, second_assignment, or null if kept.

    Every item gets exactly one reason, the first that applies; only kept items count as a box's first assignment.
    """
    rows = assign
    for name, known in (("_box", boxes.select("frame", "box")), ("_target", targets.select("frame", "box"))):
        rows = rows.join(known.distinct().withColumn(name, F.lit(True)), ["frame", "box"], "left")
    rows = rows.join(containers.select("frame", "container").distinct().withColumn("_container", F.lit(True)), ["frame", "container"], "left")
    rows = rows.withColumn("reason", first_reason({"unknown_box": F.col("_box").isNull(), "not_target": F.col("_target").isNull(), "unknown_container": F.col("_container").isNull()}))
    w = Window.partitionBy("frame", "box").orderBy(F.col("reason").isNotNull(), "pos")
    rows = rows.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "second_assignment").otherwise(F.col("reason")))
    return rows.drop("_box", "_target", "_container")


def unplaced(assign: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that no kept assignment places."""
    return targets.join(assign.filter("reason is null").select("frame", "box"), ["frame", "box"], "left_anti")


def malformed(kind: Column, refs: Column, columns: Column) -> Column:
    """A link with repeated references, a run of under two, a pair with an empty side, or a record of under two cells."""
    repeats = F.size(F.array_distinct(refs)) != F.size(refs)
    return repeats | ((kind == "run") & (F.size(refs) < 2)) | ((kind == "pair") & (F.size(columns) < 2)) | ((kind == "record") & (F.size(columns) < 2))


def valid_citations(cited: Column, allowed: Column) -> tuple[Column, Column]:
    """Cited references that are allowed, each once in order, and how many were not, repeats included."""
    return F.array_distinct(F.filter(cited, lambda x: F.array_contains(allowed, x))), F.size(F.filter(cited, lambda x: ~F.array_contains(allowed, x)))


def frame_nodes(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """A node per frame: texts of its boxes in reading order, repeats kept; ordinal is the frame's place in its video."""
    texts = text_of(boxes, ["video_id", "frame"], ["ordinal"])
    w = Window.partitionBy("video_id").orderBy("frame")
    rows = frames.withColumn("place", F.row_number().over(w) - 1).join(texts, ["video_id", "frame"])
    return rows.select(F.concat("video_id", F.lit(":f"), "frame").alias("node_id"), "video_id", F.lit("frame").alias("level"), F.concat(F.lit("f"), "frame").alias("item_id"), F.col("place").cast("int").alias("ordinal"), F.col("t_settled").alias("t_start"), F.col("t_end"), F.array().cast("array<string>").alias("apps"), "text")


def lifetime_nodes(members: DataFrame, frames: DataFrame) -> DataFrame:
    """A node per lifetime: its distinct readings in order, from the first frame's settling to the last one's end."""
    rows = members.join(frames.select("video_id", "frame", "t_settled", "t_end"), ["video_id", "frame"])
    span = rows.groupBy("video_id", "lifetime").agg(F.min_by("t_settled", "frame").alias("t_start"), F.max_by("t_end", "frame").alias("t_end"))
    texts = text_of(rows, ["video_id", "lifetime"], ["frame"], distinct=True)
    rows = span.join(texts, ["video_id", "lifetime"])
    return rows.select(F.concat("video_id", F.lit(":"), "lifetime").alias("node_id"), "video_id", F.lit("lifetime").alias("level"), F.col("lifetime").alias("item_id"), F.lit(None).cast("int").alias("ordinal"), "t_start", "t_end", F.array().cast("array<string>").alias("apps"), "text")


def transition_nodes(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """A node per change with records: its rendered lines (video_id, change_id, pos, text)."""
    rows = changes.join(text_of(lines, ["video_id", "change_id"], ["pos"]), ["video_id", "change_id"])
    return rows.select(F.concat("video_id", F.lit(":"), "change_id").alias("node_id"), "video_id", F.lit("transition").alias("level"), F.col("change_id").alias("item_id"), F.lit(None).cast("int").alias("ordinal"), "t_start", "t_end", F.array().cast("array<string>").alias("apps"), "text")


def summary_nodes(parts: DataFrame) -> DataFrame:
    """A node per step, section, chapter or video (video_id, level, item_id, t_start, t_end, label, description)."""
    text = F.concat_ws("\n", F.nullif("label", F.lit("")), F.nullif("description", F.lit("")))
    rows = parts.withColumn("text", text).filter("text <> ''")
    return rows.select(F.concat("video_id", F.lit(":"), "item_id").alias("node_id"), "video_id", "level", "item_id", F.lit(None).cast("int").alias("ordinal"), "t_start", "t_end", F.array().cast("array<string>").alias("apps"), "text")


def all_levels(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
