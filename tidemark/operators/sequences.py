"""Operators over ordered rows: consecutive pairs, islands, lifetimes, carry-forward, reverts, ranges and windows of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def transitions(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the one before it in its key, as ``prev_<column>``; a key's first row has none and is left out."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("_n", F.row_number().over(w))
    for c in columns:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(w))
    return out.filter("_n > 1").drop("_n")


def islands(rows: DataFrame, key: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """Numbers maximal runs of equal ``value`` inside each key from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def ranges(rows: DataFrame, key: list[str], number: str) -> DataFrame:
    """Whole numbers as runs: key, first, last, n. Repeats count once."""
    w = Window.partitionBy(*key).orderBy(number)
    runs = rows.select(*key, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return runs.groupBy(*key, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_run")


def majority(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Most frequent ``value`` of each key; a tie goes to the one seen first."""
    counted = rows.groupBy(*key, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = Window.partitionBy(*key).orderBy(F.desc("_n"), F.asc("_first"), F.asc(value))
    return counted.withColumn("_k", F.row_number().over(best)).filter("_k = 1").select(*key, F.col(value).alias("majority"), F.col("_n").alias("majority_n"))


def carried(rows: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null ``value`` at or before each row: an as-of join of a key with itself, as one window."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


#: Slices that the rows of a key are cut into, at most: what windows over sums of slices see of a key.
SLICES = 256


def sliced(rows: DataFrame, scale: Column, slices: int = SLICES) -> DataFrame:
    """``rows`` with ``_slice``, which rises with the number ``scale``: about equally many rows in each, by quantiles of the whole table (one row of ``slices`` numbers).

    So a key that holds most rows is cut into many slices, while a small key's rows lie in few. Null comes first, in the first slice with the least.
    """
    cuts = F.percentile_approx(scale.cast("double"), [k / slices for k in range(1, slices)], F.lit(slices * 20))
    bounds = rows.agg(F.coalesce(F.array_distinct(cuts), F.array().cast("array<double>")).alias("_bounds"))
    below = F.filter("_bounds", lambda b: b < scale.cast("double"))
    return rows.crossJoin(F.broadcast(bounds)).withColumn("_slice", F.size(below)).drop("_bounds")  # one row


def _with_slices(rows: DataFrame, of_slices: DataFrame, key: list[str]) -> DataFrame:
    """Rows beside what is known of their slice; null keys are keys."""
    named = of_slices.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], F.col("_slice").alias("_s"), *[c for c in of_slices.columns if c not in (*key, "_slice")])
    on = F.col("_slice") == F.col("_s")
    for i, c in enumerate(key):
        on &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(named, on, "left").drop("_s", *[f"_k{i}" for i in range(len(key))])


def running(rows: DataFrame, key: list[str], order: list[str], scale: Column, amount: Column, before: str, total: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over the rows before each in its key's ``order``, and over all of its key.

    ``scale`` is a number that rises with the first column of ``order``. No task sorts a key: sums of slices are added up in order, and rows are sorted inside a slice.
    """
    cut_up = sliced(rows, scale).withColumn("_amount", amount)
    sums = cut_up.groupBy(*key, "_slice").agg(F.sum("_amount").alias("_sum"))
    w = Window.partitionBy(*key)
    sums = sums.select(*key, "_slice", F.coalesce(F.sum("_sum").over(w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_slice_before"), F.sum("_sum").over(w).alias("_slice_total"))
    inside = F.sum("_amount").over(Window.partitionBy(*key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    out = _with_slices(cut_up, sums, key).withColumn(before, F.col("_slice_before") + F.coalesce(inside, F.lit(0))).withColumn(total, F.col("_slice_total"))
    return out.drop("_slice", "_amount", "_slice_before", "_slice_total")


def asof(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` at or before it in its key. Of rows of ``right`` at one time the
    greatest counts. ``at`` is a number; both sides are one stream that is cut into slices, and the last value of the slices before is carried into each, so a
    key with most rows is no single sort."""
    rest = [c for c in left.columns if c not in {*key, at}]
    a = left.select(*key, at, F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    b = right.select(*key, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    both = sliced(a.unionByName(b), F.col(at))
    ends = both.groupBy(*key, "_slice").agg(F.max(F.when(F.col("_side") == 0, F.struct(at, "_v"))).alias("_end"))
    carried_in = F.last("_end", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*key, "_slice", carried_in.getField("_v").alias("_carried"))
    w = Window.partitionBy(*key, "_slice").orderBy(F.col(at), "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    found = _with_slices(both, ends, key).withColumn("_v", F.coalesce(F.last("_v", ignorenulls=True).over(w), "_carried")).filter("_side = 1")
    return found.select(*key, at, "_row.*", "_v.*")


def reverts(rows: DataFrame, key: list[str], order: list[str], value: str, time: str) -> DataFrame:
    """Rows whose value is that of two rows before, with another in between; ``hold`` is how long that one lasted."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = rows.withColumn("_one", F.lag(value).over(w)).withColumn("_two", F.lag(value, 2).over(w)).withColumn("hold", F.col(time) - F.lag(time).over(w))
    return out.filter((F.col(value) == F.col("_two")) & (F.col(value) != F.col("_one"))).drop("_one", "_two")


def index_windows(n: int, window: int, overlap: int) -> list[tuple[int, int]]:
    """Overlapping [first, last] ranges over n places; the last one is clipped to the end."""
    out, start = [], 0
    while n > 0:
        last = min(start + window, n) - 1
        out.append((start, last))
        if last == n - 1:
            break
        start += max(1, window - overlap)
    return out


def windows_of(rows: DataFrame, key: list[str], order: list[str], window: int, overlap: int) -> DataFrame:
    """Rows with their place in the key (from 0) in every window that holds them: ``place``, ``window``, ``window_first``, ``overlapped``.

    Windows start at multiples of window - overlap, the last is the first that reaches the end, so a row's windows follow from its place and the
    key's size: rows are repeated, never joined.
    """
    step = max(1, window - overlap)
    w = Window.partitionBy(*key)
    out = rows.withColumn("place", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    last = F.ceil(F.greatest(F.col("_n") - window, F.lit(0)) / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("place") - window + 1) / step))
    high = F.least(F.floor(F.col("place") / step), last)
    out = out.withColumn("window", F.explode(F.sequence(low, high)))
    return out.withColumn("window_first", F.col("window") * step).withColumn("overlapped", F.col("place") < F.col("window_first") + overlap).withColumn("overlapped", F.col("overlapped") & (F.col("window") > 0)).drop("_n")


def merged_boundaries(votes: DataFrame, key: list[str], overlap: int) -> DataFrame:
    """Boundaries that windows proposed (key, window, window_first, place, label), merged: inside a window a vote counts 2; in
    its overlap with the window before it counts 2 if it is not the window's own first place, else 1. Places of 2 or more
    stay, and place 0 always does; the label is the earliest window's."""
    weak = (F.col("window") > 0) & (F.col("place") == F.col("window_first"))
    merged = votes.groupBy(*key, "place").agg(F.sum(F.when(weak, 1).otherwise(2)).alias("votes"), F.min_by("label", "window").alias("label"))
    return merged.filter("votes >= 2 or place = 0")


def segments(rows: DataFrame, boundaries: DataFrame, key: list[str], place: str = "place") -> DataFrame:
    """``rows`` with ``segment``: the last boundary place at or before their own."""
    marked = rows.join(boundaries.select(*key, place, F.col(place).alias("_start")), [*key, place], "left")
    return carried(marked, key, [place], F.col("_start"), "segment").drop("_start")


def collapsed_ranges(rows: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """First and last of a segment's times."""
    return rows.groupBy(*key).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n"))


def first_range(rows: DataFrame, ranges_: DataFrame, at: str, start: str, end: str, order: str) -> DataFrame:
    """``rows`` with the first (by ``order``) half-open range [start, end) that holds ``at``; null columns where none does.

    Ranges are a short list by contract (chapters of a recording, dates of a calendar): they travel as one row's array, and no row of ``rows`` moves.
    """
    names = ranges_.columns
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*names).alias("r"))))
    one = ranges_.agg(F.transform(F.filter(listed, lambda x: x["_o"].isNotNull()), lambda x: x["r"]).alias("a"), F.transform(F.filter(listed, lambda x: x["_o"].isNull()), lambda x: x["r"]).alias("b"))
    one = one.select(F.concat("a", "b").alias("_ranges"))
    held = F.filter("_ranges", lambda r: (F.col(at) >= r[start]) & (F.col(at) < r[end]))
    out = rows.crossJoin(F.broadcast(one)).withColumn("_r", F.get(held, F.lit(0))).drop("_ranges")
    return out.select(*rows.columns, *(F.col(f"_r.{n}").alias(n) for n in names))


def parents(children: DataFrame, spans: DataFrame, on: list[str], position: str, first: str, last: str, parent_order: str, cell: int = 1024) -> DataFrame:
    """Each child's parent: the span [first, last] of positions that holds it, with the same ``on``; of several the last by ``parent_order``; nulls where there is none.

    Spans and positions, whole numbers, meet by cells, so there is no join by range alone. A span goes to cells of a size that holds it: ``cell``, or that times a power of eight, so it
    makes two rows at most, however long it is; a position is looked up in each size that some span has (one row of a few numbers). The choice is an
    aggregate over different positions: repeated children all get it.
    """
    extra = [c for c in spans.columns if c not in on]
    fits = spans.filter(F.col(last) >= F.col(first))
    bits = F.length(F.bin(F.floor((F.col(last) - F.col(first)) / cell).cast("long")))  # 2 ** bits cells are longer than the span
    size = F.lit(cell) * F.call_function("shiftleft", F.lit(1).cast("long"), (F.ceil(bits / 3) * 3).cast("int"))
    sized = fits.withColumn("_size", F.when(F.col(last) - F.col(first) < cell, F.lit(cell).cast("long")).otherwise(size))
    sizes = sized.agg(F.collect_set("_size").alias("_sizes"))
    at = lambda c: F.floor(F.col(c) / F.col("_size"))
    dealt = sized.withColumn("_cell", F.explode(F.sequence(at(first), at(last))))
    asked = children.select(*on, position).distinct().crossJoin(F.broadcast(sizes)).withColumn("_size", F.explode("_sizes")).drop("_sizes").withColumn("_cell", at(position))
    both = asked.join(dealt, [*on, "_size", "_cell"]).filter((F.col(position) >= F.col(first)) & (F.col(position) <= F.col(last)))
    best = both.groupBy(*on, position).agg(F.max_by(F.struct(*extra), parent_order).alias("_parent"))
    return children.join(best, [*on, position], "left").select(*children.columns, "_parent.*")


def latch(flags: DataFrame, key: list[str], order: list[str], on: Column, off: Column, name: str = "active") -> DataFrame:
    """Hysteresis: on where ``on``, off where ``off``, else as before; off at the start."""
    flag = F.when(on, 1).when(off, 0)
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return flags.withColumn(name, F.coalesce(F.last(flag, ignorenulls=True).over(w), F.lit(0)))


def recurrences(rows: DataFrame, key: list[str], time: str, least: float, most: float, within: int, times: int) -> DataFrame:
    """Periodic keys: a step to the previous row between ``least`` and ``most`` recurs; ``confirmed`` once there are ``times`` steps in the
    last ``within``. ``time`` is a number; ``within`` is whole."""
    w = Window.partitionBy(*key).orderBy(time)
    out = rows.withColumn("step", F.col(time) - F.lag(time).over(w)).withColumn("recurs", F.coalesce((F.col("step") >= least) & (F.col("step") <= most), F.lit(False)))
    recent = Window.partitionBy(*key).orderBy(time).rangeBetween(-within, 0)
    return out.withColumn("n_recent", F.sum(F.col("recurs").cast("int")).over(recent)).withColumn("confirmed", F.col("n_recent") >= times)


def fallback_segments(rows: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``segment``, their number among segments of ``size`` rows, from 1."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w) - 1).withColumn("segment", (F.floor(F.col("place") / size) + 1).cast("int"))


def repaired_boundaries(proposed: DataFrame, places: DataFrame, key: list[str]) -> DataFrame:
    """Boundaries as key, place, label. proposed: key, id, label, pos; places: key, id, place. Unknown ids go, of several proposals for a place the first by ``pos``
    counts, and place 0 is always a boundary, "segment 1" if nothing names it."""
    known = proposed.join(places, [*key, "id"]).groupBy(*key, "place").agg(F.min_by("label", "pos").alias("label"))
    starts = places.select(*key).distinct().withColumn("place", F.lit(0)).withColumn("_forced", F.lit("segment 1"))
    both = known.join(starts, [*key, "place"], "full_outer")
    return both.select(*key, F.col("place").cast("int").alias("place"), F.coalesce("label", "_forced").alias("label"))


def chapter_starts(steps: DataFrame, chapters: list[float], key: list[str], at: str, place: str) -> DataFrame:
    """The first step at or after each chapter's start, as key, place, label ("chapter 1", ...); chapters that share a first step are one. ``chapters``: starts, a short list by contract."""
    starts = F.array(*[F.lit(float(c)) for c in sorted(chapters)])
    # of a step: the chapters that began by then; a chapter's first step is the least place among them
    begun = steps.select(*key, F.col(place).alias("place"), F.explode(F.filter(starts, lambda c: c <= F.col(at))).alias("_c"))
    first = begun.groupBy(*key, "_c").agg(F.min("place").alias("place")).select(*key, "place").distinct()
    number = F.row_number().over(Window.partitionBy(*key).orderBy("place"))
    return first.select(*key, "place", F.concat(F.lit("chapter "), number).alias("label"))


def parts_of(rows: DataFrame, key: list[str], order: list[str], scale: Column, most: int, size: int) -> DataFrame:
    """``rows`` with ``part``: keys of over ``most`` rows are cut into parts of ``size``, others are one part."""
    placed = running(rows, key, order, scale, F.lit(1), "_place", "_of")
    return placed.withColumn("part", F.when(F.col("_of") > most, F.floor(F.col("_place") / size)).otherwise(0).cast("int")).drop("_place", "_of")
