"""Scoring against a list of expected texts: which lifetimes show them, whether search finds them, and how near in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from .matching import containing


def scorable(entries: DataFrame) -> DataFrame:
    """Entries of at least four non-blank characters; others stay out of all rates."""
    return entries.filter(F.length(F.regexp_replace("text", r"(?U)\s", "")) >= 4)


def matching_lifetimes(entries: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """(entry, lifetime, rank): lifetimes whose normalised text contains the entry's, case kept, by first frame, then number of the id.

    Entries meet lifetimes by a word of theirs (see ``matching.containing``).
    """
    e = entries.select("entry", norm(F.col("text")).alias("want"))
    both = containing(lifetimes.select("lifetime", "first_frame", norm(F.col("text")).alias("have")), e, "have", "want")
    number = F.regexp_extract("lifetime", r"(\d+)", 1).cast("long")
    w = Window.partitionBy("entry").orderBy("first_frame", number)
    return both.select("entry", "lifetime", "first_frame", F.row_number().over(w).alias("rank"))


def score_exact(entries: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Per entry (entry, text, frame, t): exact, the first lifetime and how far its start is off in frames and seconds (2 places)."""
    first = matching_lifetimes(entries, lifetimes).filter("rank = 1").drop("rank", "first_frame")
    found = first.join(lifetimes.select("lifetime", "first_frame", "t_first"), "lifetime")
    out = entries.join(found, "entry", "left")
    off = F.round(F.col("t_first") - F.col("t"), 2) + F.lit(0.0)
    return out.select("entry", F.col("lifetime").isNotNull().alias("exact"), "lifetime", (F.col("first_frame") - F.col("frame")).alias("frames_off"), off.alias("seconds_off"))


def score_found(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """Per entry (entry, first_frame, last_frame): found, and the rank and level of the first hit (entry, rank, level, frame_start, frame_end)
    whose frames meet the entry's; hits of lifetimes and transitions come before others, which merely cover."""
    meets = (F.col("frame_end") >= F.least("first_frame", "last_frame")) & (F.col("frame_start") <= F.greatest("first_frame", "last_frame"))
    near = entries.join(hits, "entry").filter(meets).withColumn("_tier", F.when(F.col("level").isin("lifetime", "transition"), 0).otherwise(1))
    best = near.groupBy("entry").agg(F.min_by(F.struct("rank", "level"), F.struct("_tier", "rank")).alias("x"))
    return entries.join(best, "entry", "left").select("entry", F.col("x").isNotNull().alias("found"), F.col("x.rank").alias("rank"), F.col("x.level").alias("level"))


def rates(scored: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, k, n) for boolean columns; rows where one is null aren't counted for it."""
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("ok")) for c in columns])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count_if("ok").alias("k"), F.count("ok").alias("n"))


def cost_summary(calls: DataFrame, frames: int, project_to: int) -> DataFrame:
    """Dollars per stage and in total, paid where known and estimated else, per frame, and projected linearly to ``project_to`` frames (4 places)."""
    dollars = F.coalesce("paid", "estimated").cast("decimal(24,10)")
    out = calls.rollup("stage").agg(F.sum(dollars).alias("d"), F.count_if(F.col("paid").isNull()).alias("n_estimated"))
    return out.select(
        F.coalesce("stage", F.lit("all stages")).alias("stage"), F.round("d", 4).cast("double").alias("dollars"), F.round(F.col("d") / frames, 4).cast("double").alias("per_frame"),
        F.round(F.col("d") / frames * project_to, 4).cast("double").alias("projected"), "n_estimated",
    )
