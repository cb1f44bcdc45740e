"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Texts are equal when they are identical after every character of space and 0x09-0x0D is deleted; a text stands for its SHA-256. Of equal texts the
row with the most code points stays, then the one of the smallest id.

1. A narrow table of digests is written once: no text moves after that.
2. Misra-Gries: frequent-items sketches (counters that are decremented together when the map is full, mergeable) of a 64-bit hash of the digest are made
   in each task and merged in two levels. Every digest with more than ``3.5 / TRACKED`` of all rows is among the at most ``FREQUENT`` items that a sketch gives.
3. Candidates are verified: one row for each whole digest with its exact count and its winner, after partial sums. At most ``FREQUENT`` items, so the
   table that is broadcast is bounded by that parameter, whatever the input.
4. Rows of frequent digests are resolved where they are read, with no shuffle; the others are shuffled by digest, and none of their groups is frequent.

Null texts count as empty, and are one group with texts of spaces only. A null id loses against any other. Rows that agree in id, length and
digest are repeated rows; exactly one row of a group stays. An empty table gives an empty result. Other columns are carried along untouched, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: What doesn't count in a comparison.
BLANK = " \t\n\x0b\f\r"
#: Counters of a sketch, at most; frequent digests looked at, at most; sketches merged at a time in the first level.
TRACKED = 4096
FREQUENT = 1000
FAN = 256


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, digest (binary), points (code points of the original), item (hash for sketches), row (different in all rows), and with ``carry`` the whole
    row as the struct ``doc``. Written as a table, so that row numbers stay the same however often it is read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.translate(text, BLANK, "").cast("binary"), 256))
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest.alias("digest"), F.length(text).cast("long").alias("points"), F.monotonically_increasing_id().alias("row"), *own)
    return written(rows.withColumn("item", F.xxhash64("digest")), "digests")


def frequent_items(rows: DataFrame) -> DataFrame:
    """item: hashes that the merged sketches give as frequent, at most ``FREQUENT``."""
    sketch = lambda c: F.expr(f"approx_top_k_accumulate({c}, {TRACKED})")
    merged = lambda c: F.expr(f"approx_top_k_combine({c}, {TRACKED})")
    parts = rows.groupBy((F.spark_partition_id() % FAN).alias("part")).agg(sketch("item").alias("s"))
    top = parts.groupBy(F.lit(0).alias("all")).agg(merged("s").alias("s"))  # with a key, so that no rows give no sketch
    return top.select(F.explode(F.expr(f"approx_top_k_estimate(s, {FREQUENT})")).alias("t")).select(F.col("t.item").alias("item"))


def decided(rows: DataFrame) -> DataFrame:
    """``rows`` as ``digested`` gives them, with keep_id, group_size and kept."""
    # max takes the row that stays: most code points, then a known and small id, then any
    best = F.struct("points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("back"), "row")
    items = F.broadcast(frequent_items(rows.select("item")))
    winners = rows.join(items, "item").groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    winners = written(winners, "winners")  # used by both branches below
    split = rows.join(F.broadcast(winners), "digest", "left")
    group = Window.partitionBy("digest")
    rest = split.filter("group_size is null").withColumn("best", F.max(best).over(group)).withColumn("group_size", F.count("*").over(group))
    every = split.filter("group_size is not null").unionByName(rest)
    return every.withColumn("keep_id", -F.col("best.back")).withColumn("kept", F.col("best.row") == F.col("row")).drop("best", "item", "row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that lose. Those of frequent digests are dropped where they are read, only the others cross the shuffle."""
    return decided(digested(docs, carry=True)).filter("kept").select("doc.*")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(digested(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = r"""
with plain as (
  select row_number() over () as row_id, doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as same from documents
), ranked as (
  select doc_id, same, row_id, count(*) over (partition by same) as group_size,
    first_value(doc_id) over (partition by same order by length(text) desc, doc_id nulls last, row_id) as keep_id,
    first_value(row_id) over (partition by same order by length(text) desc, doc_id nulls last, row_id) as keep_row
  from plain
)
select doc_id, keep_id, group_size, keep_row = row_id as kept, sha256(same) as text_sha256 from ranked
"""
