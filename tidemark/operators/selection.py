"""What of a run is taken: ranges of frames, planned calls, resumed and imported rows, capped and sampled reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_lines(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The non-blank lines of each row's text, numbered b1, b2, ... in order, as key, ``box`` and ``line``; ``dropped`` is the number of the row's blank ones."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    solid = F.filter(lines, lambda x: x.rlike(r"\S"))
    out = rows.select(*key, (F.size(lines) - F.size(solid)).alias("dropped"), F.posexplode(solid).alias("_n", "line"))
    return out.select(*key, F.concat(F.lit("b"), F.col("_n") + 1).alias("box"), "line", "dropped")


def frame_range(boxes: DataFrame, changes: DataFrame, sightings: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The records of an inclusive range of frames: boxes in it, changes wholly inside, and whole lifetimes (all their sightings) with at least one sighting in it."""
    inside = F.col("frame").between(first, last)
    seen = sightings.filter(inside).select("lifetime").distinct()
    return boxes.filter(inside), changes.filter((F.col("from_frame") >= first) & (F.col("to_frame") <= last)), sightings.join(seen, "lifetime", "left_semi")


def triggered(components: DataFrame, key: list[str], area: str, one: float, together: float) -> DataFrame:
    """Per key whether its components start a change: any area of ``one`` or more, or all together of ``together`` or more."""
    return components.groupBy(*key).agg((F.max(area) >= one).alias("by_one"), (F.sum(area) >= together).alias("by_all")).withColumn("triggered", F.col("by_one") | F.col("by_all"))


def plan_calls(boxes: DataFrame, transitions: DataFrame, starts: DataFrame, moved: DataFrame) -> DataFrame:
    """Calls of incremental annotation with their targets: video_id, frame, targets (ids in order).

    boxes: video_id, frame, box. transitions: video_id, frame (the later one), components (changed ones; null: not measured). starts, moved:
    video_id, frame, box of boxes that begin a lifetime, and of boxes that moved. A video's first frame asks about all its boxes; a later one is called where
    pixels changed or weren't measured, and asks about boxes that start or moved, possibly none. A later frame without a transition is an error.
    """
    frames = boxes.groupBy("video_id", "frame").agg(F.count("*").alias("_n"))
    frames = frames.withColumn("_first", F.col("frame") == F.min("frame").over(Window.partitionBy("video_id")))
    known = transitions.select("video_id", "frame", "components", F.lit(True).alias("_known"))
    frames = frames.join(known, ["video_id", "frame"], "left")
    lost = F.raise_error(F.concat(F.lit("no transition into frame "), F.col("frame"))).cast("boolean")
    called = frames.filter(F.col("_first") | F.when(F.col("_known").isNull(), lost).otherwise(F.coalesce(F.col("components") > 0, F.lit(True))))
    asked = starts.select("video_id", "frame", "box").union(moved.select("video_id", "frame", "box")).distinct().withColumn("_asked", F.lit(True))
    targets = boxes.join(called.select("video_id", "frame", "_first"), ["video_id", "frame"]).join(asked, ["video_id", "frame", "box"], "left")
    targets = targets.filter(F.col("_first") | F.col("_asked")).groupBy("video_id", "frame").agg(F.array_sort(F.collect_list("box")).alias("targets"))
    out = called.select("video_id", "frame").join(targets, ["video_id", "frame"], "left")
    kind = targets.schema["targets"].dataType
    return out.withColumn("targets", F.coalesce("targets", F.array().cast(kind)))


def projection(plan: DataFrame, boxes: DataFrame) -> DataFrame:
    """What a plan's calls come to, as one row of counts and ratios."""
    frames = boxes.groupBy("video_id", "frame").agg(F.count("*").alias("n")).agg(F.count("*").alias("frames"), F.sum("n").alias("boxes"))
    calls = plan.agg(F.count("*").alias("calls"), F.count_if(F.size("targets") == 0).alias("calls_without_targets"), F.sum(F.size("targets")).alias("target_boxes"))
    both = frames.crossJoin(F.broadcast(calls))  # one row each
    ratio = lambda a, b, digits: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), digits)
    return both.withColumns({"share_of_boxes": ratio("target_boxes", "boxes", 4), "targets_per_call": ratio("target_boxes", "calls", 2), "boxes_per_frame": ratio("boxes", "frames", 2)})


def pending(requests: DataFrame, answers: DataFrame, key: list[str], error: str = "error") -> DataFrame:
    """Requests without an answer free of error: what a resumed run still has to ask."""
    return requests.join(answers.filter(F.col(error).isNull()).select(*key).distinct(), key, "left_anti")


def imported(rows: DataFrame, first: int, last: int, at: str, mine: DataFrame, theirs: DataFrame, lineage: list[str], key: list[str]) -> DataFrame:
    """Rows of a span of ``at`` that may be reused: those of keys whose ``lineage`` columns are the same in both manifests."""
    same = mine.select(*key, *lineage).join(theirs.select(*key, *lineage), [*key, *lineage]).select(*key).distinct()
    return rows.filter(F.col(at).between(first, last)).join(same, key, "left_semi")


def without(rows: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """Rows that none of ``touched`` names."""
    return rows.join(touched.select(*key).distinct(), key, "left_anti")


def preceding(rows: DataFrame, key: list[str], order: list[str], line: str, n: int, name: str = "context") -> DataFrame:
    """Adds the lines of the ``n`` rows before each, oldest first."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-n, -1)
    return rows.withColumn(name, F.collect_list(line).over(w))


def capped(rows: DataFrame, key: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key, with ``place`` and ``left_out``, how many more the key has."""
    w = Window.partitionBy(*key)
    counted = rows.withColumn("place", F.row_number().over(w.orderBy(*order))).filter(F.col("place") <= most)
    sizes = rows.groupBy(*key).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    return counted.join(sizes, key)


def sampled_by_kind(rows: DataFrame, kind: str, unique: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows of each kind: those whose id hashes least with the seed, so that reruns agree whatever the layout."""
    lot = F.md5(F.concat_ws("/", F.lit(seed), F.col(unique).cast("string")).cast("binary"))
    return rows.withColumn("_lot", lot).withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy("_lot", unique))).filter(F.col("_k") <= most).drop("_lot", "_k")


def by_count(rows: DataFrame, key: list[str], value: str, first: Column) -> DataFrame:
    """Values of each key, once each: the one for which ``first`` holds in some row, then by falling count, then by value."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("_n"), F.max(first.cast("int")).alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("_first")).alias("a"), (-F.col("_n")).alias("b"), F.col(value).alias("v"))))
    return counted.groupBy(*key).agg(F.transform(ordered, lambda x: x["v"]).alias("values"))


def unit_order(unit: Column) -> list[Column]:
    """Shorter names first, then by name: c2 stands before c10."""
    return [F.length(unit), unit]
