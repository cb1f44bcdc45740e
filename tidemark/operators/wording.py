"""Records as text: changes, links and items in the fixed wording that readers and indexes get; readings by a second reader; pairs that share no row.

``changes``: run, change, from_frame, to_frame, t0, t1, changed_fraction and components (null if the frames were not compared), textless, moved, same_place, reverts_of,
reverts_share, reverts_hold, kind. ``records``: run, change, pos, kind, before_ref, before, after_ref, after, added, removed (texts of the edit script), label,
continues, in_churn, reading and reading_ref (a second reader's text that disagrees, else null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import text as tx
from .labels import snapped

PAIRED = ("reread", "appended", "truncated", "changed")
#: In a one-line summary: records that are quoted, and characters of each.
QUOTED, QUOTE = 3, 80
# What the role of a box in a link is called.
ROLES = {"run": "part of a wrapped text", "member": "table cell", "header": "table heading"}


def _body(r: dict[str, Column]) -> Column:
    say = lambda pattern, *cols: F.format_string(pattern, *cols)
    kind, before, after = r["kind"], r["before"], r["after"]
    return (
        F.when(kind == "appended", say('"%s" → appended "%s"; now "%s"', before, r["added"], after)).when(kind == "truncated", say('"%s" → truncated, removed "%s"; now "%s"', before, r["removed"], after))
        .when(kind == "changed", say('at this place "%s" was replaced by "%s"', before, after)).when(kind == "reread", say('"%s" re-read as "%s" (same text)', before, after))
        .when(kind == "appeared", say('appeared "%s"', after)).otherwise(say('removed "%s"', before))
    )


def record_text(records: DataFrame) -> DataFrame:
    """``records`` with ``refs``, after before before, and ``line``, the record as text."""
    c = {x: F.col(x) for x in records.columns}
    refs = F.array_compact(F.array("after_ref", "before_ref"))
    tail = F.concat(
        F.when(c["continues"].isNotNull(), F.concat(F.lit("; continues "), F.split("continues", "/")[0])).otherwise(""), F.when(c["in_churn"], " [area was animating]").otherwise(""),
        F.when(F.coalesce("reading", F.lit("")) != "", F.format_string('\n    model reads %s: "%s"', "reading_ref", "reading")).otherwise(""),
    )
    head = F.concat(F.lit("["), F.array_join(refs, ", "), F.lit("] "), F.when(F.coalesce("label", F.lit("")) != "", F.concat("label", F.lit(": "))).otherwise(""))
    return records.withColumn("refs", refs).withColumn("line", F.concat(head, _body(c), tail))


def change_texts(changes: DataFrame, records: DataFrame) -> DataFrame:
    """run, change, text and ids: the references that the text names, in order of first appearance. Nothing is capped."""
    lines = record_text(records).groupBy("run", "change").agg(F.array_sort(F.collect_list(F.struct("pos", "line", "refs"))).alias("all"))
    rows = changes.join(lines, ["run", "change"], "left").withColumn("all", F.coalesce("all", F.array()))
    some = F.size("all") > 0
    compared = F.col("changed_fraction").isNotNull()
    parts = [
        F.format_string("Transition %s: frame %s → frame %s, t=%.2f–%.2fs.", "change", F.col("from_frame").cast("string"), F.col("to_frame").cast("string"), "t0", "t1"),
        F.when(compared, F.format_string("Pixels changed: %.2f%% of the screen; changed areas: %s.", F.col("changed_fraction") * 100, F.col("components").cast("string"))).otherwise("Pixels: no comparison is available for this pair."),
        F.when(some, F.concat(F.lit("Text changes:\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"))),
        F.when(F.col("moved") > 0, F.format_string("Texts that only moved: %s.", F.col("moved").cast("string"))),
        F.when(F.col("same_place") > 0, F.format_string("Boxes with a visual change over unchanged text: %s.", F.col("same_place").cast("string"))),
        F.when(compared & (F.col("textless") > 0), F.format_string("Changed areas without text: %s.", F.col("textless").cast("string"))),
        F.when(F.col("reverts_of").isNotNull(), F.format_string("Undoes %.0f%% of %s's change after %.1f s.", F.col("reverts_share") * 100, "reverts_of", "reverts_hold")),
        F.when(F.col("kind") == "unsettled", "One of these frames was captured while the screen was still changing."),
        F.when(~some, "No text change was recorded; look for a change that is not text."),
    ]
    ids = F.array_distinct(F.flatten(F.transform("all", lambda x: x["refs"])))
    return rows.select("run", "change", F.concat_ws("\n", *parts).alias("text"), ids.alias("ids"))


def change_lines(changes: DataFrame, records: DataFrame) -> DataFrame:
    """run, change, line: one line for each change. Only the first ``QUOTED`` paired records are collected; the others are counts."""
    w = Window.partitionBy("run", "change").orderBy("pos")
    paired = records.filter(F.col("kind").isin(*PAIRED)).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= QUOTED)
    cut = F.when(F.length("after") > QUOTE, F.concat(F.substring("after", 1, QUOTE - 1), F.lit("…"))).otherwise(F.col("after"))
    quoted = paired.groupBy("run", "change").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", F.format_string('%s "%s"', "kind", cut).alias("x")))), lambda x: x["x"]), "; ").alias("_quoted"))
    counts = records.groupBy("run", "change").agg(F.count_if(F.col("kind").isin(*PAIRED)).alias("_n"), *[F.count_if(F.col("kind") == k).alias(f"_{k}") for k in ("appeared", "removed")])
    rows = changes.join(counts, ["run", "change"], "left").join(quoted, ["run", "change"], "left")
    more = F.when(F.col("_n") > QUOTED, F.format_string("+%s more text changes", (F.col("_n") - QUOTED).cast("string")))
    number = lambda name, n: F.when(n > 0, F.concat(F.lit(f"{name} "), n.cast("string")))
    what = F.concat_ws("; ", "_quoted", more, number("appeared", F.col("_appeared")), number("removed", F.col("_removed")), number("moved", F.col("moved")), F.when(F.col("reverts_of").isNotNull(), F.concat(F.lit("undoes "), "reverts_of")))
    head = F.format_string("%s [f%s→f%s, %.1f–%.1fs] ", "change", F.col("from_frame").cast("string"), F.col("to_frame").cast("string"), "t0", "t1")
    return rows.select("run", "change", F.concat(head, F.when(what == "", "no text change").otherwise(what)).alias("line"))


def item_line(line: Column, action: Column, entered: Column, submitted: Column) -> Column:
    """A change's line with what an interpretation says of it; the line alone without an action."""
    tail = F.when(entered.isNotNull(), F.format_string(' [entered "%s", submitted: %s]', entered, submitted)).when(submitted == "yes", F.lit(" [submitted: yes]")).otherwise("")
    return F.when(F.coalesce(action, F.lit("")) != "", F.concat(line, F.lit(" — "), action, tail)).otherwise(line)


def node_line(node: Column, first: Column, last: Column, begin: Column, end: Column, label: Column) -> Column:
    return F.format_string("%s [f%s→f%s, %.1f–%.1fs] %s", node, first.cast("string"), last.cast("string"), begin, end, label)


def context_text(title: Column, gist: Column, previous: Column) -> Column:
    """A chapter and the lines of the preceding changes, as one text."""
    chapter = F.when(title.isNotNull(), F.concat(F.lit("Chapter: "), title, F.lit(" — "), gist))
    before = F.when(F.size(previous) > 0, F.concat(F.lit("Preceding transitions:\n"), F.array_join(previous, "\n")))
    text = F.concat_ws("\n", chapter, before)
    return F.when(text == "", "No preceding context.").otherwise(text)


def link_texts(links: DataFrame) -> DataFrame:
    """Links (kind, cells: arrays of texts; boxes of a run are single cells, a pair is key and value) with ``lines`` for an index.

    A run is joined without and with blanks, so that a wrong joiner hides nothing; a pair is key and value; a record its cells. Headers add no line.
    """
    cells = F.transform("cells", lambda c: F.array_join(c, " "))
    spaced = F.array_join(cells, " ")
    return links.withColumn("lines", F.when(F.col("kind") == "run", F.array_distinct(F.array(F.array_join(cells, ""), spaced))).otherwise(F.array(spaced)))


def link_anchor(kind: Column, cells: Column) -> Column:
    """The reference whose entry carries a link's text: the first of a run or record, the first value of a pair. ``cells`` as in ``link_texts``, of references."""
    return F.when(kind == "pair", F.get(F.get(cells, F.lit(1)), F.lit(0))).otherwise(F.get(F.get(cells, F.lit(0)), F.lit(0)))


def second_readings(readings: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """The second reader's majority for each lifetime: of readings (lifetime, frame, text) the non-blank text with most frames, the one seen first on a tie.

    Returns lifetime, reading, n_readings, non_text (there are readings, all blank) and ``agree`` with the lifetime's own text (lifetimes: lifetime, text). Counts are made
    for each text first, so a lifetime of many frames is never one group.
    """
    counts = readings.filter("text is not null").groupBy("lifetime", "text").agg(F.count("*").alias("n"), F.min("frame").alias("first"))
    shown = F.trim("text") != ""
    best = counts.groupBy("lifetime").agg(F.min(F.when(shown, F.struct((-F.col("n")).alias("m"), "first", "text"))).alias("best"), F.sum("n").alias("n_readings"))
    out = best.join(lifetimes.select("lifetime", F.col("text").alias("_own")), "lifetime")
    agree = F.when(F.col("best").isNotNull(), tx.agreement(F.coalesce("_own", F.lit("")), F.col("best.text")))
    return out.select("lifetime", F.col("best.text").alias("reading"), "n_readings", F.col("best").isNull().alias("non_text"), agree.alias("agree"))


def off_row(pairs: DataFrame, boxes: DataFrame, most: int = 12) -> DataFrame:
    """Pair links (frame, link, side 'key' or 'value', box) with the gap between the key and value boxes that are nearest: dx, dy, and ``off_row`` if dy is over ``most``.

    Nearest by 10 * dy + dx. A link without a known box on both sides has a gap of 0. Keys meet values inside one link only.
    """
    placed = pairs.join(boxes.select("frame", "box", "bbox"), ["frame", "box"])
    keys = placed.filter("side = 'key'").select("frame", "link", F.col("bbox").alias("a"))
    values = placed.filter("side = 'value'").select("frame", "link", F.col("bbox").alias("b"))
    apart = lambda lo, hi: F.greatest(F.lit(0), F.greatest(F.col("a")[lo], F.col("b")[lo]) - F.least(F.col("a")[hi], F.col("b")[hi]))
    both = keys.join(values, ["frame", "link"]).select("frame", "link", apart("x0", "x1").alias("dx"), apart("y0", "y1").alias("dy"))
    near = both.groupBy("frame", "link").agg(F.min(F.struct((F.col("dy") * 10 + F.col("dx")).alias("d"), "dx", "dy")).alias("m"))
    out = pairs.select("frame", "link").distinct().join(near, ["frame", "link"], "left")
    out = out.select("frame", "link", F.coalesce("m.dx", F.lit(0)).alias("dx"), F.coalesce("m.dy", F.lit(0)).alias("dy"))
    return out.withColumn("off_row", F.col("dy") > most)


def entered_kind(typed: Column, suggested: Column, entered: Column) -> Column:
    """What an entered text is, beside what was typed and what the screen suggested: none, typed, cursor-char (one character more, from the suggestion), SUGGESTION or other."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    t, s, e = plain(typed), plain(suggested), plain(entered)
    one_more = F.substring(s, F.lit(1), F.length(t) + 1)
    between = F.startswith(e, t) & F.startswith(s, e)
    return (
        F.when(entered.isNull(), "none").when(e == t, "typed").when((e == one_more) | (e == F.trim(F.substring(s, F.lit(1), F.length(F.coalesce(typed, F.lit(""))) + 1))), "cursor-char")
        .when(between, F.when(F.length(e) - F.length(t) >= 2, "SUGGESTION").otherwise("cursor-char")).when(e == s, "SUGGESTION").otherwise("other")
    )


def frame_window(first: Column, last: Column) -> Column:
    """first and last of the frames that are known; null if neither is."""
    return F.when(F.coalesce(first, last).isNotNull(), F.struct(F.least(first, last).alias("first"), F.greatest(first, last).alias("last")))


def by_rect(named: DataFrame, boxes: DataFrame, margin: float) -> DataFrame:
    """Rectangles of proposals (record, item, part, pos, rect) as boxes (record, box, pos, bbox), by the rules of ``labels.snapped``: the same rectangle, the greatest overlap, or
    the nearest centre within ``margin``.

    Returns the rows with ``box``, null where no box fits or there is no rectangle (``rect_unplaced``), and ``again``: in one item (a link, say) a box counts at its first place only.
    """
    rows = named.withColumn("rect_id", F.struct("record", "item", "part", "pos"))
    found = snapped(rows.filter("rect is not null").select(F.col("record").alias("frame"), "rect_id", "rect"), boxes.withColumnRenamed("record", "frame"), margin)
    out = rows.join(found, "rect_id", "left").drop("rect_id")
    again = F.row_number().over(Window.partitionBy("record", "item", "box").orderBy("part", "pos")) > 1
    return out.withColumn("again", F.col("box").isNotNull() & again)
