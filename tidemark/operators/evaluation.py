"""Evaluation: paired differences, noise floors and verdicts; label verdicts; claims; costs; repair counters."""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paired_difference(a: DataFrame, b: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """One row: mean of b - a over common units (6 places), number of common and of dropped units."""
    both = a.select(unit, F.col(value).alias("_a")).join(b.select(unit, F.col(value).alias("_b")), unit, "full_outer")
    common = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.agg(
        F.round(F.avg(F.when(common, F.col("_b") - F.col("_a"))), 6).alias("diff"),
        F.count_if(common).alias("n_common"),
        F.count_if(~common).alias("n_dropped"),
    )


def unit_means(cards: DataFrame) -> DataFrame:
    """config, unit, mean over repeats, for units that every repeat of the config has."""
    repeats = cards.groupBy("config").agg(F.count_distinct("repeat").alias("n"))
    means = cards.groupBy("config", "unit").agg(F.avg("value").alias("value"), F.count_distinct("repeat").alias("_n"))
    return means.join(repeats, "config").filter("_n = n").select("config", "unit", "value", "n")


def noise_floors(cards: DataFrame) -> DataFrame:
    """config, floor: the greatest absolute mean difference between two of its repeats over their common units."""
    x = cards.select("config", "unit", F.col("repeat").alias("r"), F.col("value").alias("x"))
    y = cards.select("config", "unit", F.col("repeat").alias("s"), F.col("value").alias("y"))
    pairs = x.join(y, ["config", "unit"]).filter("r < s").groupBy("config", "r", "s").agg(F.abs(F.avg(F.col("y") - F.col("x"))).alias("d"))
    return pairs.groupBy("config").agg(F.max("d").alias("floor"))


def scaled_floor(floor: Column, n_a: Column, n_b: Column) -> Column:
    """A single-run floor for means over ``n_a`` and ``n_b`` repeats, 6 places."""
    return F.round(floor * F.sqrt((1 / n_a + 1 / n_b) / 2), 6)


def compare_configs(cards: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """Every pair of configs (a < b): means over common units, difference, floor, verdict and which side it favours.

    ``cards``: config, repeat, unit, value. A difference is outside only if it exceeds the floor; without a floor the verdict
    is unknown, and without common units the pair is not comparable.
    """
    means = unit_means(cards)
    floors = noise_floors(cards)
    a = means.select(F.col("config").alias("a"), "unit", F.col("value").alias("va"), F.col("n").alias("na"))
    b = means.select(F.col("config").alias("b"), "unit", F.col("value").alias("vb"), F.col("n").alias("nb"))
    pairs = a.join(b, "unit").filter("a < b").groupBy("a", "b").agg(
        F.count("*").alias("n_units"), F.round(F.avg("va"), 6).alias("mean_a"), F.round(F.avg("vb"), 6).alias("mean_b"),
        F.round(F.avg(F.col("vb") - F.col("va")), 6).alias("diff"), F.max("na").alias("na"), F.max("nb").alias("nb"),
    )
    pairs = pairs.join(floors.select(F.col("config").alias("a"), F.col("floor").alias("fa")), "a", "left")
    pairs = pairs.join(floors.select(F.col("config").alias("b"), F.col("floor").alias("fb")), "b", "left")
    pairs = pairs.withColumn("floor", scaled_floor(F.greatest("fa", "fb"), F.col("na"), F.col("nb")))
    verdict = F.when(F.col("floor").isNull(), "unknown").when(F.abs("diff") > F.col("floor"), "outside").otherwise("inside")
    better = F.when(F.col("verdict") != "outside", F.lit(None)).when((F.col("diff") > 0) == F.lit(higher_is_better), F.col("b")).otherwise(F.col("a"))
    return pairs.withColumn("verdict", verdict).withColumn("favours", better).select("a", "b", "n_units", "mean_a", "mean_b", "diff", "floor", "verdict", "favours")


def label_from(must: Column, must_not: Column) -> list[Column]:
    """Aggregate giving the label of a group of rubric lines: ``must`` holds for passed demands (null for other lines), ``must_not`` for hit bans."""
    label = F.when(F.coalesce(F.bool_or(must_not), F.lit(False)) | ~F.coalesce(F.bool_or(must), F.lit(False)), "wrong").when(F.bool_and(must), "correct").otherwise("partial")
    return [label.alias("label")]


def reason_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows by the first rule that they break, in the order of ``rules``; 'kept' if none. Exactly one reason a row."""
    reason = F.lit("kept")
    for name, broken in reversed(rules.items()):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"))


def costs(usage: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Dollars of usage rows (model, tokens_in, tokens_out, batch) by a price table (model, price_in, price_out per million tokens).

    Unknown models take the default prices, batch rows half; sums are decimal, so their order doesn't matter.
    """
    priced = usage.join(prices, "model", "left")
    dollars = (F.col("tokens_in") * F.coalesce("price_in", F.lit(default[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(default[1]))) / F.lit(1e6)
    return priced.withColumn("dollars", (dollars * F.when(F.col("batch"), 0.5).otherwise(1.0)).cast("decimal(24,10)"))


def assign_claims(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (text, claim, at) given to expected rows (text, row, at, executed), one each, by equal text.

    Executed rows in order take the free claim nearest to their time (earlier on a tie; the earliest if they have none), then the others
    take the earliest claims left. Texts are groups, dealt over all tasks and sorted there; a task streams through its rows and holds the claims of
    one text, in order of time, with links over those that are taken. Claims without a time come last.
    """
    r = rows.select("text", F.col("row").cast("long").alias("id"), F.col("at").cast("double").alias("at"), F.col("executed").cast("int").alias("role"))
    c = claims.select("text", F.col("claim").cast("long").alias("id"), F.col("at").cast("double").alias("at"), F.lit(2).alias("role"))

    def give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: object = give  # no text
        times: array = array("d")
        ids: array = array("q")
        before: array = array("q")  # place k + 1: the last free claim up to k, plus one, or a link towards it
        after: array = array("q")  # place k: the first free claim from k, or a link towards it
        timed = 0

        def last(links: array, k: int) -> int:
            end = k
            while links[end] != end:
                end = links[end]
            while links[k] != end:
                links[k], k = end, links[k]
            return end

        for pdf in batches:
            out = []
            for text, id_, at, role in zip(*(pdf[x].tolist() for x in ("text", "id", "at", "role"))):
                if text != now:
                    now, times, ids, before, after, timed = text, array("d"), array("q"), array("q", [0]), array("q", [0]), 0
                if role == 2:
                    times.append(at)
                    ids.append(id_)
                    before.append(len(ids))
                    after.append(len(ids))
                    timed += at == at
                    continue
                best = last(after, 0)
                if best == len(ids):
                    continue
                if role == 1 and at == at and best < timed:
                    place = bisect.bisect_right(times, at, 0, timed)
                    left, right = last(before, place) - 1, last(after, place)
                    if left >= 0:
                        best = last(after, bisect.bisect_left(times, times[left], 0, timed))  # the least id of that time
                    if right < timed and (left < 0 or abs(times[right] - at) < abs(times[left] - at)):
                        best = right
                before[best + 1], after[best] = best, best + 1
                out.append((text, id_, ids[best], bool(role)))
            yield pd.DataFrame(out, columns=["text", "row", "claim", "executed"])

    time = F.col("at").isNull() | F.isnan("at")
    order = [F.desc("role"), F.when(F.col("role") == 2, time), F.when(F.col("role") == 2, F.col("at")), "id"]
    both = r.unionByName(c).filter("role is not null")
    return both.repartition("text").sortWithinPartitions("text", *order).mapInPandas(give, "text string, row long, claim long, executed boolean")
