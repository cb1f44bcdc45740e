"""Repair of proposals: what a check refuses is dropped with one reason, the first that applies, and the rest goes on.

Proposals of a record are tables: ``containers`` (record, pos, id, kind, owner, covers), ``assign`` (record, pos, box, container, pane), ``unassigned`` (record,
pos, box), ``links`` (record, pos, kind, refs, cells, members), ``texts`` (record, pos, box, text) and ``missed`` (record, pos, text, container); ``boxes`` (record, box,
place, target) says what is on the record's frame, and which boxes are to be labelled. Items are taken in order of ``pos``, which differs within a record and table.

Most checks look at known sets or at the first of equals. Both are windows whose keys begin with the record, over the items and the rows they name together, so tables that
are dealt by record, as windows over it leave them, stay where they are: nothing is joined. Only links need the order: one is refused because of members that kept links
before it have taken, so they are a fold over the links of a record that no other check refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold
from .nodes import first_reason

#: Every reason, in the order of the checks.
REASONS = (
    "dup_container", "bad_owner", "bad_covers", "bad_rect", "unknown_box", "not_target", "unknown_container", "second_assignment", "unplaced", "outside", "ambiguous",
    "link_unsnapped", "link_unknown_box", "link_malformed", "link_already_linked", "text_unknown_box", "text_not_target", "second_text", "text_missing", "missed_empty",
    "missed_unknown_container", "rect_unplaced",
)


def _first(keys: list[str]) -> Column:
    """Whether a row is the first of its keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) == 1


def _named(key: str) -> tuple[Window, Window, Column]:
    """Of rows and what they name, put together with ``_side`` 0 for the latter: all that have one record and key, those up to a row, and whether record and key aren't null."""
    every = Window.partitionBy("record", key)
    return every, every.orderBy("_side", "pos").rowsBetween(Window.unboundedPreceding, 0), F.col("record").isNotNull() & F.col(key).isNotNull()


def _known(rows: DataFrame, names: DataFrame, key: str, found: str, value: Column) -> DataFrame:
    """``rows`` with ``found``: ``value`` of the row of ``names`` (record, key, pos) that has their record and key, null if there is none."""
    both = rows.withColumn("_side", F.lit(1)).unionByName(names.select("record", key, "pos", value.alias("_value"), F.lit(0).alias("_side")), allowMissingColumns=True)
    _, so_far, real = _named(key)
    both = both.withColumn(found, F.when(real, F.max(F.when(F.col("_side") == 0, F.col("_value"))).over(so_far)))
    return both.filter("_side = 1").drop("_side", "_value")


def _on_frame(rows: DataFrame, boxes: DataFrame, unknown: str, no_target: str) -> tuple[DataFrame, Column]:
    """``rows`` together with ``boxes`` as ``_side`` 0, and the reason of a row whose box isn't on the frame or isn't to be labelled."""
    pos = rows.schema["pos"].dataType
    both = rows.unionByName(boxes.select("record", "box", F.col("place").cast(pos).alias("pos"), F.col("target").alias("_target"), F.lit(0).alias("_side")), allowMissingColumns=True)
    every, _, real = _named("box")
    both = both.withColumn("_on", real & (F.min("_side").over(every) == 0)).withColumn("_wanted", F.max("_target").over(every))
    return both, first_reason({unknown: ~F.col("_on"), no_target: ~F.col("_wanted")})


def repair_containers(containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept containers, with owners and covers repaired, and reasons (record, reason, n).

    The first of equal ids stays. Only a popup has an owner, which is another container and a window. Covers are other containers, each once in order. What is
    repaired once stays as it is.
    """
    rows = containers.withColumn("reason", F.when(~_first(["record", "id"]), "dup_container"))
    kept = rows.filter("reason is null").drop("reason")
    owned = _known(kept, kept.select("record", F.col("id").alias("owner"), "pos", "kind"), "owner", "_kind", F.col("kind"))
    good = (F.col("kind") == "popup") & (F.col("_kind") == "window") & (F.col("owner") != F.col("id"))
    owned = owned.withColumn("bad_owner", F.col("owner").isNotNull() & ~F.coalesce(good, F.lit(False))).withColumn("owner", F.when(~F.col("bad_owner"), F.col("owner"))).drop("_kind")
    cover = owned.select("*", F.posexplode_outer("covers").alias("_nr", "cover")).drop("covers")
    cover = _known(cover, kept.select("record", F.col("id").alias("cover"), "pos"), "cover", "_found", F.lit(True))
    fit = F.coalesce("_found", F.lit(False)) & (F.col("cover") != F.col("id"))
    again = F.row_number().over(Window.partitionBy("record", "cover", "id").orderBy("_nr")) > 1
    cover = cover.withColumn("_ok", F.when(F.col("_nr").isNotNull(), fit & ~again))
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("_ok"), F.struct("_nr", "cover")))), lambda x: x["cover"])
    once = [F.first(c).alias(c) for c in owned.columns if c not in ("record", "id", "covers")]
    out = cover.groupBy("record", "id").agg(*once, held.alias("covers"), F.count_if(~F.col("_ok")).alias("bad_covers"))
    counts = rows.filter("reason is not null").select("record", "reason", F.lit(1).alias("n"))
    bad = F.array(F.struct(F.lit("bad_owner").alias("reason"), F.col("bad_owner").cast("int").alias("n")), F.struct(F.lit("bad_covers").alias("reason"), F.col("bad_covers").cast("int").alias("n")))
    return out.drop("bad_owner", "bad_covers"), counts.unionByName(out.select("record", F.inline(bad)).filter("n > 0"))


def repair_assign(assign: DataFrame, unassigned: DataFrame, boxes: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items of ``assign`` with ``reason`` (null if kept) and their pane trimmed, the unassigned targets in order, and reasons.

    A target that neither a kept assignment nor ``unassigned`` names is unassigned too, after those, and counts as unplaced.
    """
    rows = _known(assign, containers.select("record", F.col("id").alias("container"), "pos"), "container", "_found", F.lit(True)).withColumn("_side", F.lit(2))
    rows = rows.unionByName(unassigned.select("record", "pos", "box", F.lit(1).alias("_side")), allowMissingColumns=True)
    both, reason = _on_frame(rows, boxes, "unknown_box", "not_target")
    every, so_far, real = _named("box")
    both = both.withColumn("reason", F.when(F.col("_side") == 2, F.coalesce(reason, F.when(F.col("_found").isNull(), "unknown_container"))))
    fit = (F.col("_side") == 2) & F.col("reason").isNull()
    both = both.withColumn("_fit", F.count_if(fit).over(so_far)).withColumn("_pos", F.when(real, F.min(F.when(F.col("_side") == 1, F.col("pos"))).over(every)))
    both = both.withColumn("_open", F.coalesce((F.col("_side") == 0) & F.col("_target") & ~(real & (F.max("_fit").over(every) > 0)), F.lit(False)))
    both = both.withColumn("reason", F.when(fit & (F.col("_fit") > 1), "second_assignment").when(F.col("_open") & F.col("_pos").isNull(), "unplaced").otherwise(F.col("reason")))
    counts = both.filter("reason is not null").select("record", "reason", F.lit(1).alias("n"))
    rest = [F.col(c) for c in assign.columns if c not in ("record", "box", "pane")]
    kept = both.filter("_side = 2").select("record", "box", *rest, F.nullif(F.trim("pane"), F.lit("")).alias("pane"), "reason")
    order = Window.partitionBy("record").orderBy(F.col("_pos").isNull(), "_pos", "pos")
    left = both.filter("_open").select("record", "box", F.row_number().over(order).alias("pos"), F.col("_pos").isNull().alias("unplaced"))
    return kept, left, counts


class _Links:
    """Members taken by the links that a record has kept."""

    def __init__(self) -> None:
        self.taken: set = set()

    def step(self, pos, members) -> list[tuple]:
        if not self.taken.isdisjoint(members):
            return [(pos, "link_already_linked")]
        self.taken.update(members)
        return []

    def close(self) -> list[tuple]:
        return []


def repair_links(links: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``links`` with ``reason``, and reasons. ``refs``: all boxes that a link names; ``members``: those that no later link may have, headers are exempt; ``cells``: the number of
    boxes of a run, of filled sides of a pair, or of filled cells of a record. A box named twice, or under two cells, is malformed.

    Unknown boxes are found among single references; the fold then holds the members that one record has taken, and reads numbers and members of sound links only.
    """
    named = links.select("record", "pos", F.explode("refs").alias("box"))
    named = _known(named, boxes.select("record", "box", F.col("place").cast(links.schema["pos"].dataType).alias("pos")), "box", "_found", F.lit(True)).filter("_found is null")
    both = links.withColumn("_link", F.lit(True)).unionByName(named.select("record", "pos"), allowMissingColumns=True)
    both = both.withColumn("_unknown", F.count_if(F.col("_link").isNull()).over(Window.partitionBy("record", "pos")) > 0)
    broken = (F.size(F.array_distinct("refs")) != F.size("refs")) | (F.col("cells") < 2)
    rows = both.filter("_link").withColumn("_reason", first_reason({"link_unknown_box": F.col("_unknown"), "link_malformed": broken})).drop("_unknown", "_link")
    found = fold(rows.filter("_reason is null").select("record", "pos", "members"), ["record"], ["pos"], _Links, f"pos {links.schema['pos'].dataType.simpleString()}, _taken string")
    out = rows.join(found, ["record", "pos"], "left").withColumn("reason", F.coalesce("_reason", "_taken")).drop("_reason", "_taken")
    counts = rows.filter("_reason is not null").select("record", F.col("_reason").alias("reason"), F.lit(1).alias("n"))
    return out, counts.unionByName(found.select("record", F.col("_taken").alias("reason"), F.lit(1).alias("n")))


def repair_texts(texts: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts`` with ``reason``, and reasons. Targets of records that have texts but none for them count as missing; nothing is invented for them."""
    both, reason = _on_frame(texts.withColumn("_side", F.lit(1)), boxes, "text_unknown_box", "text_not_target")
    every, so_far, real = _named("box")
    both = both.withColumn("reason", F.when(F.col("_side") == 1, reason))
    fit = (F.col("_side") == 1) & F.col("reason").isNull()
    both = both.withColumn("_fit", F.count_if(fit).over(so_far)).withColumn("_most", F.when(real, F.max("_fit").over(every)))
    read = F.col("record").isNotNull() & (F.max("_side").over(Window.partitionBy("record")) == 1)
    missing = (F.col("_side") == 0) & F.col("_target") & read & (F.coalesce("_most", F.lit(0)) == 0)
    both = both.withColumn("reason", F.when(fit & (F.col("_fit") > 1), "second_text").when(missing, "text_missing").otherwise(F.col("reason")))
    rows = both.filter("_side = 1").select("record", "box", *[c for c in texts.columns if c not in ("record", "box")], "reason")
    return rows, both.filter("reason is not null").select("record", "reason", F.lit(1).alias("n"))


def repair_missed(missed: DataFrame, containers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept texts that no box has, numbered m1, m2 and so on, without containers that aren't known; and reasons. Blank ones are dropped."""
    rows = _known(missed, containers.select("record", F.col("id").alias("container"), "pos"), "container", "_found", F.lit(True))
    lost = F.col("container").isNotNull() & F.col("_found").isNull()
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    rows = rows.withColumn("_reason", first_reason({"missed_empty": blank, "missed_unknown_container": lost}))
    counts = rows.filter("_reason is not null").select("record", F.col("_reason").alias("reason"), F.lit(1).alias("n"))
    number = F.row_number().over(Window.partitionBy("record").orderBy("pos"))
    kept = rows.filter(~blank)
    return kept.select("record", "pos", F.concat(F.lit("m"), number).alias("id"), "text", F.when(F.col("_reason").isNull(), F.col("container")).alias("container")), counts


def totals(*counts: DataFrame) -> DataFrame:
    """record, reason, n over all checks; only reasons that occur."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("record", "reason").agg(F.sum("n").alias("n"))


def overall(*counts: DataFrame) -> DataFrame:
    """reason, n, n_records over all records. A reason comes from one check, so each table of counts is summed by record where it is, and only sums move."""
    sums = [totals(c).groupBy("reason").agg(F.sum("n").alias("n"), F.count("*").alias("n_records")) for c in counts]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy("reason").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records"))


class _Standing:
    """Of one run: until which frame each lifetime is a member of a link that was accepted."""

    def __init__(self) -> None:
        self.until: dict = {}
        self.frame: object = None

    def step(self, frame, pos, end, lives) -> list[tuple]:
        if frame != self.frame:  # what ended before no longer matters
            self.frame = frame
            self.until = {k: v for k, v in self.until.items() if v >= frame}
        accepted = not any(life in self.until for life in lives)
        if accepted:
            self.until.update((life, end) for life in lives)
        return [(frame, pos, accepted)]

    def close(self) -> list[tuple]:
        return []


def relinked(links: DataFrame) -> DataFrame:
    """Links of records (run, frame, pos, end, lives) with ``accepted``: a link is refused for good if a lifetime among its members is, at its frame, a member of an
    accepted link that stands: one of an earlier record, or of the same record before it.

    ``end``: the last frame at which the link would stand, from lifetimes and sources alone, so it doesn't depend on what is accepted; ``lives``: the lifetimes of its
    members, headers left out. State: the lifetimes that standing links of one run hold.
    """
    rows = links.select("run", "frame", "pos", "end", "lives")
    kind = f"frame {rows.schema['frame'].dataType.simpleString()}, pos {rows.schema['pos'].dataType.simpleString()}, accepted boolean"
    return links.join(fold(rows, ["run"], ["frame", "pos"], _Standing, kind), ["run", "frame", "pos"])
