"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / weight``: u comes from a hash of its id and a seed, so
reruns agree, and the weight is a quality weight. Taking documents in key order is weighted sampling
without replacement. A source's target is whole epochs (every document once each) and then the rest of the
budget in key order; the document on the boundary is cut, so a source's taken words equal its target rounded.

The prefix sum over a source is split by key range: sums per (source, key bucket), a window over a source's
at most ``BUCKETS`` bucket sums, then a window inside each bucket. No source is ever sorted as a whole, and
rows are joined by (source, bucket), so a source that holds a third of all rows is spread like any other.

Null text has size 0 and is taken 0 times. A null source is a source, ordered last. A null id hashes as the
empty text. Documents of equal keys are ordered by id, then size. Repeated rows are documents of their own.
An empty table gives an empty result. Extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
BUCKETS = 4096
SEED = "mix-1"
MARKS = "#*$%&|<>!"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """Adds size, exponential key and key bucket; narrow, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marks = F.length(text) - F.length(F.translate(text, MARKS, ""))
    weight = (F.col("_mix_size") + F.lit(1.0)) / (F.col("_mix_size") + F.lit(1.0) + marks)
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
    return (
        docs.withColumn("_mix_size", size_of(F.col("text")))
        .withColumn("_mix_key", -F.log(u) / weight)
        .withColumn("_mix_bucket", F.least(F.floor(F.lit(BUCKETS) * (F.lit(1.0) - F.exp(-F.col("_mix_key")))), F.lit(BUCKETS - 1)).cast("int"))
    )


def budgets(sized: DataFrame) -> DataFrame:
    """Per (source, bucket) with rows: words before the bucket in its source, source size, target, epochs and rest.

    Targets by water filling: with sources in order of cap / weight, the level is the largest of
    (budget - caps of the sources before) / (weights from here on).
    """
    sums = sized.groupBy(F.col("source").alias("_mix_source"), "_mix_bucket").agg(F.sum("_mix_size").alias("_mix_sum"))
    sums = sums.withColumn("_mix_before", F.sum("_mix_sum").over(Window.partitionBy("_mix_source").orderBy("_mix_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    sources = sums.groupBy("_mix_source").agg(F.sum("_mix_sum").alias("source_size"))
    # windows over sources only: a row per source, not per document
    order = Window.partitionBy().orderBy(F.col("_mix_source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(WEIGHTS)
    sources = sources.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank + 1).cast("int")).cast("double"))
    sources = sources.withColumn("cap", F.lit(float(MOST_EPOCHS)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    fill = Window.partitionBy().orderBy("ratio", F.col("_mix_source").asc_nulls_last())
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    budget = F.lit(TOTAL_SHARE) * F.sum("source_size").over(whole)
    sources = sources.withColumn("level", (budget - before) / ahead).withColumn("level", F.max("level").over(whole))
    sources = sources.withColumn("target", F.least(F.col("cap"), F.col("level") * F.col("w")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("_mix_epochs", epochs)
    sources = sources.withColumn("_mix_rest", F.floor(F.col("target") - F.col("_mix_epochs") * F.col("source_size") + 0.5).cast("long"))
    sources = sources.select(F.col("_mix_source").alias("_mix_of"), "source_size", "target", "_mix_epochs", "_mix_rest")
    return (
        sums.join(sources, F.col("_mix_source").eqNullSafe(F.col("_mix_of")))
        .select("_mix_source", F.col("_mix_bucket").alias("_mix_in"), F.coalesce("_mix_before", F.lit(0)).alias("_mix_before"), "source_size", "target", "_mix_epochs", "_mix_rest")
    )


def mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and taken to every row of ``sized``."""
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("_mix_source")) & (F.col("_mix_bucket") == F.col("_mix_in")))
    inside = Window.partitionBy("source", "_mix_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_mix_before") + F.coalesce(F.sum("_mix_size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("_mix_size"), F.col("_mix_rest") - before))
    return rows.withColumn("taken", (F.col("_mix_epochs") * F.col("_mix_size") + part).cast("long")).drop("_mix_source", "_mix_in", "_mix_before")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = written(keyed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"), "sizes")
    return mix(sized, budgets(sized)).select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per epoch it is taken whole in, and cut after
    the words that are left of its budget where it is on the boundary; documents not taken are left out."""
    names = docs.columns
    narrow = docs.select("doc_id", "source", "text")
    # the other columns travel as one struct, so that their names can't clash with ours
    rows = mix(keyed(docs.select("doc_id", "source", "text", F.struct(*[c for c in names if c != "text"]).alias("_mix_row"))), budgets(keyed(narrow).drop("text")))
    size, taken = F.col("_mix_size"), F.col("taken")
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(0)).cast("int")
    left = F.when(size > 0, taken - F.floor(taken / size) * size).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("_mix_whole", whole).withColumn("_mix_left", left)
    rows = rows.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.lit(MOST_EPOCHS + 1))))
    rows = rows.filter((F.col("_mix_copy") <= F.col("_mix_whole")) | ((F.col("_mix_copy") == F.col("_mix_whole") + 1) & (F.col("_mix_left") > 0)))
    cut = F.when(F.col("_mix_copy") <= F.col("_mix_whole"), F.col("text")).otherwise(
        # only the one document on each source's boundary gets here
        F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("_mix_left")), "")
    )
    rows = rows.select(cut.alias("text"), "_mix_row").select("text", "_mix_row.*")
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)


ORACLE_SQL = r"""
with sized as (
  select row_number() over () as row_id, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', '')) as marks,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
  from documents
), keyed as (
  select *, -ln(u) / ((size + 1.0) / (size + 1.0 + marks)) as k from sized
), ranked as (
  select *, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from keyed
), sources as (
  select source, sum(size)::bigint as source_size, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from keyed group by source
), levels as (
  select *, 2.0 * source_size as cap, (1.5 * sum(source_size) over ()
    - coalesce(sum(2.0 * source_size) over (order by 2.0 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by 2.0 * source_size / w, source nulls last rows between current row and unbounded following) as level
  from sources
), targets as (
  select source, source_size, least(cap, max(level) over () * w)::double as target from levels
), budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from targets
)
select doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 0.5)::bigint - before)))::bigint as taken
from ranked join budgets on ranked.source is not distinct from budgets.source
"""
