"""Figures of a run and comparisons of runs, as grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import running


def counts_by(rows: DataFrame, kinds: dict[str, str], sums: list[str]) -> DataFrame:
    """(metric, kind, n): how often each value of each column of ``kinds`` occurs, and the totals of ``sums``. One pass: rows become (metric, kind, amount) triples that are summed before the shuffle."""
    parts = [F.struct(F.lit(name).alias("metric"), F.col(c).cast("string").alias("kind"), F.lit(1).cast("long").alias("n")) for name, c in kinds.items()]
    parts += [F.struct(F.lit(c).alias("metric"), F.lit(None).cast("string").alias("kind"), F.coalesce(F.col(c).cast("long"), F.lit(0)).alias("n")) for c in sums]
    return rows.select(F.explode(F.array(*parts)).alias("p")).select("p.*").groupBy("metric", "kind").agg(F.sum("n").alias("n"))


def stability(changes: DataFrame) -> DataFrame:
    """(unchanged - variants) / (unchanged + lost) over all changes, to four places; null where nothing was unchanged or lost."""
    both = F.sum("unchanged") + F.sum("lost")
    return changes.agg(F.round((F.sum("unchanged") - F.sum("variants")) / F.nullif(both, F.lit(0)), 4).alias("stability"))


def fragmentation(lifetimes: DataFrame, top: int = 20) -> DataFrame:
    """The texts with the most lifetimes, beside totals of all (text, unstable, sightings in)."""
    texts = lifetimes.groupBy("text").agg(F.count("*").alias("n"), F.count_if("unstable").alias("u"), F.count_if(F.col("sightings") == 1).alias("s"))
    total = texts.agg(F.sum("n").alias("lifetimes"), F.count("*").alias("distinct_texts"), F.sum("u").alias("unstable"), F.sum("s").alias("single_sighting"))
    total = total.withColumn("per_text", F.round(F.col("lifetimes") / F.col("distinct_texts"), 3))
    return texts.orderBy(F.desc("n"), "text").limit(top).select("text", "n").crossJoin(F.broadcast(total))  # one row of totals


def marks_matched(pairs: DataFrame, key: list[str], likeness: Column, least: float = 0.8) -> DataFrame:
    """Per key how many pairs are alike, of how many."""
    return pairs.groupBy(*key).agg(F.count_if(likeness >= least).alias("hits"), F.count("*").alias("total"))


def question_section(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """Per polarity of the answers that have been judged: n, the three labels, unscored, mean score; and of all answers the number ``stale``, without a judgment.

    answers: key, polarity. judged: key, label (correct, partial, wrong or null), score.
    """
    both = answers.join(judged.withColumn("_judged", F.lit(True)), "key", "left")
    n = lambda x: F.count_if(x & F.col("_judged"))
    labels = [n(F.col("label") == x).alias(x) for x in ("correct", "partial", "wrong")]
    mean = F.round(F.avg(F.when(F.col("label").isNotNull(), F.col("score"))), 4)
    return both.groupBy("polarity").agg(F.count_if("_judged").alias("n"), *labels, n(F.col("label").isNull()).alias("unscored"), mean.alias("mean"), F.count_if(F.col("_judged").isNull()).alias("stale"))


def config_rows(cards: DataFrame, value: str, digits: int = 4) -> DataFrame:
    """Per configuration the number of repeats, the values of each in order of repeats, and their mean."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("repeat", F.col(value).alias("v")))), lambda x: x["v"])
    return cards.groupBy("config").agg(F.count("*").alias("repeats"), values.alias("per_repeat"), F.round(F.avg(value), digits).alias("mean"))


def flips(a: DataFrame, b: DataFrame, unit: str = "unit", value: str = "value") -> DataFrame:
    """Units that are 1 in every repeat of one side and 0 in every repeat of the other, with that side. Only where all values are 0 or 1 does anything flip."""
    side = lambda df, s: df.select(F.col(unit), F.col(value), F.lit(s).alias("side"))
    both = side(a, "A").unionByName(side(b, "B")).groupBy(unit).agg(*(f(F.when(F.col("side") == s, F.col(value))).alias(f"{n}{s}") for s in "AB" for n, f in (("lo", F.min), ("hi", F.max))))
    plain = both.filter("loA is not null and loB is not null")
    only = F.when((F.col("loA") == 1) & (F.col("hiB") == 0), "A").when((F.col("hiA") == 0) & (F.col("loB") == 1), "B")
    odd = a.select(value).unionByName(b.select(value)).agg(F.coalesce(F.max((~F.col(value).isin(0, 1)).cast("int")), F.lit(0)).alias("_odd"))
    return plain.withColumn("only", only).filter("only is not null").crossJoin(F.broadcast(odd)).filter("_odd = 0").select(unit, "only")  # one row


def by_reader(scored: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows (key, reader, exact, error) of several readers as one per key: ``exact`` if any is, and the smallest absolute error among the exact ones; ``order`` ranks readers in a tie."""
    good = F.col("exact") & F.col("error").isNotNull()
    best = F.min(F.when(good, F.struct(F.abs("error").alias("a"), F.col(order).alias("o"), F.col("error").alias("e"))))
    return scored.groupBy(*key).agg(F.max("exact").alias("exact"), best["e"].alias("error"))


def lines_passed(checks: DataFrame, key: list[str], passed: Column) -> DataFrame:
    """Rubric lines passed of all, and whether all were."""
    return checks.groupBy(*key).agg(F.count_if(passed).alias("passed"), F.count("*").alias("lines")).withColumn("whole", F.col("passed") == F.col("lines"))


def break_even(build: Column, per_a: Column, per_b: Column) -> Column:
    """Uses after which a way with a building cost and ``per_b`` a use is cheaper than ``per_a`` a use; null where it never is."""
    return F.when(per_a > per_b, build / (per_a - per_b))


def low_half(rows: DataFrame, order: str, value: str, key: list[str]) -> DataFrame:
    """key, median of ``value`` and n_low over the lower half of each key's rows by (``order``, ``value``), both numbers.

    Equal rows are counted first; ranks are running sums over slices, so no task sorts the rows of a key, and no list of a key's values is made.
    """
    pairs = rows.filter(F.col(order).isNotNull()).groupBy(*key, order, value).agg(F.count("*").alias("_n"))
    low = running(pairs, key, [order, value], F.col(order), F.col("_n"), "_before", "_all").withColumn("_half", F.ceil(F.col("_all") / 2))
    low = low.withColumn("_n", F.least("_n", F.col("_half") - F.col("_before"))).filter("_n > 0").groupBy(*key, value, "_half").agg(F.sum("_n").alias("_n"))
    low = running(low.drop("_before"), key, [value], F.col(value), F.col("_n"), "_before", "_all")
    middle = lambda k: F.min(F.when(F.col("_before") + F.col("_n") >= k, F.col(value)))
    median = (middle(F.floor((F.col("_half") + 1) / 2)) + middle(F.floor(F.col("_half") / 2) + 1)) / 2
    return low.groupBy(*key).agg(median.alias("median"), F.max("_half").alias("n_low"))
