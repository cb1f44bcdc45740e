"""Connected components by contraction: no link and no component ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns u and v. Returns (node, root) for every node of an edge; root is the component's least node.

    Each round gives every node the least of itself and its neighbours, then replaces both ends of every edge by
    those and drops loops, so at least half of each component's nodes vanish in about every two rounds. Tables of each round are
    written to the shared folder, so a lost executor costs one round at most.
    """
    links = written(edges.select("u", "v").filter("u <> v"), "links")
    known: DataFrame | None = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("to")), "least")
        if known is None:
            step = least.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            step = known.join(least, F.col("root") == F.col("u"), "left").select("node", F.coalesce("to", "root").alias("root"))
        step = written(step, "roots")
        ends = links.join(least, "u").select(F.col("to").alias("u"), "v")
        ends = ends.join(least.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
        fewer = written(ends.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
        for old in (links, known, least):
            if old is not None:
                forget(old)
        links, known = fewer, step
        if links.isEmpty():
            return known
