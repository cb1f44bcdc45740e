"""Texts found inside others with errors, texts that are alike inside a group, and readings that belong to another box."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import text as tx
from ..session import cut, prepare

ALIGNED = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])
#: Length of the character runs that candidates share.
Q = 2


def distances(needle: str, text: str, anchored: bool = False) -> Iterator[int]:
    """After each character of ``text``: the least edits between ``needle`` and a substring that ends there (one that begins at the start if ``anchored``).

    A column of the table of distances is two numbers, a bit for each place of the needle that says whether the distance rises or falls there; a character
    of the text advances all places at once.
    """
    m = len(needle)
    places: dict[str, int] = {}
    for k, c in enumerate(needle):
        places[c] = places.get(c, 0) | 1 << k
    whole, top, edge = (1 << m) - 1, 1 << m - 1, int(anchored)
    up, down, score = whole, 0, m
    for c in text:
        same = places.get(c, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        rise = down | (whole & ~(across | up))
        fall = up & across
        score += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | edge) & whole
        up, down = (fall << 1 | ~(vertical | rise)) & whole, rise & vertical
        yield score


def aligned(needle: str, text: str, least: float) -> tuple[float, int, int, str] | None:
    """Score, begin, end and text of the substring with the fewest edits: the first that ends, and of those the last to begin. None below ``least``."""
    m = len(needle)
    if not m:
        return None
    edits, end = m, 0
    for k, d in enumerate(distances(needle, text), 1):
        if d < edits:
            edits, end = d, k
            if not d:
                break
    score = 100.0 * (m - edits) / m
    if score < least or not end:
        return None
    back = text[max(0, end - m - edits) : end][::-1]
    size = next(k for k, d in enumerate(distances(needle[::-1], back, True), 1) if d == edits)
    return score, end - size, end, text[end - size : end]


def closest(needle: Column, text: Column, least: float = 50.0) -> Column:
    """Where ``needle`` occurs in ``text`` with the fewest edits, as a struct; null if that leaves under ``least`` of 100 points, or either is null.

    A substring within k edits keeps all but Q * k of the needle's runs of Q characters, so pairs that share fewer are settled without an alignment.
    """
    prepare(SparkSession.active())
    runs = F.length(needle) + 1 - Q
    need = runs - Q * F.floor(F.length(needle) * (100 - least) / 100)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(runs, F.lit(1))), lambda k: F.contains(text, F.substring(needle, k, F.lit(Q)))))
    may = F.when(need <= 0, True).otherwise(shared >= need)
    return _closest(F.when(may, needle), F.when(may, text), F.lit(float(least)))


@F.pandas_udf(ALIGNED)
def _closest(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for needles, texts, least in parts:
        found = [None if n is None or t is None else aligned(n, t, low) for n, t, low in zip(needles, texts, least)]
        yield pd.DataFrame([x or (None, None, None, None) for x in found], columns=["score", "begin", "end", "text"]).astype({"begin": "Int32", "end": "Int32"})


def _class_of(length: Column, least: float, away: int) -> Column:
    """The class of lengths that holds ``length`` when it shrinks (``away`` -1), stays or grows (1) by as much as an alike text may differ.

    Classes are as wide as that range from end to end, so the texts alike to one lie in two classes next to each other, or in one.
    """
    step = -math.log(least) + 1e-6
    return F.floor((F.log(length.cast("double")) + away * step) / (2 * step)).cast("int")


#: Characters of the pieces that a text is cut into for ``_may_be_alike``.
PIECE = 5


def _may_be_alike(a: Column, b: Column, most: Column) -> Column:
    """False only where more than ``most`` edits lie between two texts: an edit spoils one of the pieces that ``b`` is cut into, the others are found in ``a``."""
    pieces = F.floor(F.length(b) / PIECE)
    found = F.size(F.filter(F.sequence(F.lit(1), F.greatest(pieces, F.lit(1))), lambda k: F.contains(a, F.substring(b, ((k - 1) * PIECE + 1).cast("int"), F.lit(PIECE)))))
    return F.when(pieces <= most, True).otherwise(found >= pieces - most)


def alike(left: DataFrame, right: DataFrame, group: list[str], a: str, b: str, least: float = 0.9) -> DataFrame:
    """Rows of ``left`` beside rows of ``right`` of the same group whose texts ``a`` and ``b`` have a similarity of ``least`` or more, with ``likeness``.

    Rows meet by classes of lengths: a text of ``left`` travels once, one of ``right`` at most twice, and no pair travels, since it is decided where it is formed: by length, then
    by pieces of one text in the other, then by a distance that gives up beyond the edits allowed. Texts shorter than Q are alike to nothing. ``least`` of 0.7 or more.
    """
    x = left.filter(F.length(a) >= Q).withColumn("_class", _class_of(F.length(a), least, 0))
    y = right.filter(F.length(b) >= Q).withColumn("_class", F.explode(F.sequence(_class_of(F.length(b), least, -1), _class_of(F.length(b), least, 1))))
    longest = F.greatest(F.length(a), F.length(b))
    most = F.floor(longest * (1 - least) + 1e-9).cast("int")
    near = x.join(y, [*group, "_class"]).filter((F.abs(F.length(a) - F.length(b)) <= most) & _may_be_alike(F.col(a), F.col(b), most))
    edits = F.call_function("levenshtein", F.col(a), F.col(b), most)  # -1 beyond
    near = near.withColumn("_edits", edits).filter("_edits >= 0").withColumn("likeness", 1 - F.col("_edits") / longest)
    return near.filter(F.col("likeness") >= least - 1e-9).drop("_class", "_edits")


def scrambled(boxes: DataFrame, readings: DataFrame, own: float = 0.6, other: float = 0.9) -> DataFrame:
    """Readings that are another box's text: they disagree with their box, are less than ``own`` like it and at least ``other`` like another box of the frame.

    ``boxes``: frame, box, ordinal in reading order, bbox, text. ``readings``: frame, box, text. Of several such boxes the nearest in reading order counts, the
    earlier on a tie. Returns frame, box, other, steps (in reading order), relation of the two rectangles. Empty readings and those under three characters are
    skipped, as are null readings and those of no box; a box without text has an empty one. Case and white space don't count.
    """
    plain = lambda c: F.lower(tx.norm(F.col(c)))
    mine = readings.select("frame", "box", F.col("text").alias("read")).join(boxes.select("frame", "box", "ordinal", "bbox", F.coalesce("text", F.lit("")).alias("text")), ["frame", "box"])
    mine = mine.filter(~tx.agreement(F.col("text"), F.col("read"))).withColumn("_read", plain("read")).filter(F.length("_read") >= 3)
    mine = mine.filter(tx.similarity(plain("text"), F.col("_read")) < own).select("frame", "box", "ordinal", "bbox", "_read")
    others = boxes.select("frame", F.col("box").alias("other"), F.col("ordinal").alias("_place"), F.col("bbox").alias("_where"), plain("text").alias("_text"))
    near = alike(mine, others, ["frame"], "_read", "_text", other).filter(F.col("box") != F.col("other"))
    pick = F.min(F.struct(F.abs(F.col("_place") - F.col("ordinal")).alias("far"), F.col("_place").alias("place"), "other", F.col("_where").alias("rect")))
    found = near.groupBy("frame", "box", "ordinal", "bbox").agg(pick.alias("to"))
    return found.select("frame", "box", F.col("to.other").alias("other"), (F.col("to.place") - F.col("ordinal")).alias("steps"), geo.relation(F.col("bbox"), F.col("to.rect")).alias("relation"))


def swaps(hits: DataFrame) -> DataFrame:
    """Pairs of boxes (frame, box, other) that have each other's text, once each."""
    back = hits.select("frame", F.col("box").alias("other"), F.col("other").alias("box"))
    return hits.select("frame", "box", "other").join(back, ["frame", "box", "other"], "left_semi").filter(F.col("box") < F.col("other"))


def _followed(edges: DataFrame) -> DataFrame:
    """Edges (frame, box, other) with the way from each box as far as it goes through boxes that have an edge: ``dist`` boxes on it, ``out`` where it leaves them,
    ``to`` not null if it never does. Each round doubles the way, so n boxes in a frame take log2(n) joins."""
    has = edges.select("frame", F.col("box").alias("other"), F.lit(True).alias("_has"))
    state = edges.join(has, ["frame", "other"], "left").select(
        "frame", "box", F.when(F.col("_has"), F.col("other")).alias("to"), F.lit(1).cast("long").alias("dist"), F.when(F.col("_has").isNull(), F.col("other")).alias("out")
    )
    most = edges.groupBy("frame").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        then = state.select("frame", F.col("box").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("out").alias("_out"))
        state = cut(state.join(then, ["frame", "to"], "left").select("frame", "box", F.col("_to").alias("to"), (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.coalesce("out", "_out").alias("out")))
    return state


def chains(hits: DataFrame) -> DataFrame:
    """``length`` for each hit (frame, box, other): the number of different boxes on the way box, other, other of that and so on, through boxes that are hits.

    Ways that end are followed by doubling. Boxes that ways without end lead to are cycles; a cycle is named by its least box, found by doubling too, and
    a way into it is as long as its tail and the cycle.
    """
    hits = cut(hits)  # read by every step below
    edges = hits.select("frame", "box", "other")
    way = _followed(edges)
    ends = way.filter("to is null").select("frame", "box", F.col("dist").alias("length"))
    round_ = way.filter("to is not null").select("frame", F.col("to").alias("box")).distinct()
    least = edges.join(round_, ["frame", "box"], "left_semi").select("frame", "box", F.col("other").alias("to"), F.col("box").alias("name"))
    most = round_.groupBy("frame").count().agg(F.max("count")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        then = least.select("frame", F.col("box").alias("to"), F.col("to").alias("_to"), F.col("name").alias("_name"))
        least = cut(least.join(then, ["frame", "to"]).select("frame", "box", F.col("_to").alias("to"), F.least("name", "_name").alias("name")))
    cycles = least.select("frame", "box", F.count("*").over(Window.partitionBy("frame", "name")).alias("length"))
    tails = _followed(edges.join(way.filter("to is not null").select("frame", "box"), ["frame", "box"], "left_semi").join(round_, ["frame", "box"], "left_anti"))
    tails = tails.join(cycles.select("frame", F.col("box").alias("out"), F.col("length").alias("_cycle")), ["frame", "out"])
    out = ends.unionByName(cycles).unionByName(tails.select("frame", "box", (F.col("dist") + F.col("_cycle")).alias("length")))
    return hits.join(out, ["frame", "box"])

