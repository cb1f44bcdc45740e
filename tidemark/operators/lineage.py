"""Content identity and incremental recompute: table digests, stages up to date, call cache, batches by size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table_digest(df: DataFrame) -> DataFrame:
    """One row: number of rows and a digest of them that doesn't depend on their order.

    Rows hash to 64 bits twice; the sums of both are decimal, so partial sums are made before the one shuffle.
    """
    columns = [F.col(c) for c in sorted(df.columns)]
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    summed = df.select(one.cast("decimal(20,0)").alias("a"), two.cast("decimal(20,0)").alias("b")).agg(F.count("*").alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return summed.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.coalesce("a", F.lit(0)).cast("string"), F.coalesce("b", F.lit(0)).cast("string")), 256).alias("digest"))


def up_to_date(manifest: DataFrame, stage: str, inputs: str, config: str) -> bool:
    """Whether the latest run of ``stage`` in ``manifest`` (stage, inputs, config, finished) had these inputs and settings."""
    last = manifest.filter(F.col("stage") == stage).agg(F.max_by(F.struct("inputs", "config"), "finished").alias("x")).first().x
    return last is not None and (last.inputs, last.config) == (inputs, config)


def call_key(*parts: Column) -> Column:
    """Key of a call: SHA-256 of its parts."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def misses(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests whose key has no answer in the cache, one row a key."""
    return requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def batches(rows: DataFrame, size: str, order: str, most: int, lanes: int = 64) -> DataFrame:
    """Adds lane and batch: rows in order, a new batch whenever ``most`` bytes are full. Rows are dealt to ``lanes`` by hash first, so the
    running sum is never over all rows in one task."""
    out = rows.withColumn("lane", F.pmod(F.xxhash64(order), F.lit(lanes)))
    w = Window.partitionBy("lane").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("batch", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / most))


def standing(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Where each key of attempts (key, pass, result, body) stands: ``done`` with its body, ``invalid``, ``failed`` after ``most`` attempts, or ``again``.

    An attempt without a result is still open: the key is ``open``, and is not asked for again. A key that succeeded once is done, whatever else happened to
    it; of several bodies that of the earliest pass counts. Repeated rows of a pass are one attempt.
    """
    rows = attempts.groupBy("key", "pass").agg(F.min(F.struct((F.col("result") != "succeeded").alias("o"), "result", "body")).alias("x"))
    by = rows.groupBy("key").agg(
        F.min(F.when(F.col("x.result") == "succeeded", F.struct("pass", "x.body"))).alias("good"), F.bool_or(F.col("x.result") == "invalid").alias("bad"),
        F.bool_or(F.col("x.result").isNull()).alias("open"), F.count("*").alias("tries"), F.max_by("x.result", "pass").alias("last"),
    )
    state = F.when(F.col("good").isNotNull(), "done").when(F.coalesce("bad", F.lit(False)), "invalid").when(F.col("open"), "open").when(F.col("tries") >= most, "failed").otherwise("again")
    return by.select("key", state.alias("state"), F.col("good.body").alias("body"), "tries", "last")


def to_send(requests: DataFrame, attempts: DataFrame, most: int = 2) -> DataFrame:
    """Requests (key and other columns) that no attempt has settled: new ones, and those whose attempts failed fewer than ``most`` times. One row a key."""
    settled = standing(attempts, most).filter("state <> 'again'").select("key")
    return requests.join(settled, "key", "left_anti").dropDuplicates(["key"])


def run_passes(requests: DataFrame, path: str, send: Callable[[DataFrame], DataFrame], size: str, chunk: int, most: int = 2) -> DataFrame:
    """Send requests (key, ``size`` in bytes and whatever ``send`` reads) in batches of ``chunk`` bytes until each is settled; ``standing`` of all of them.

    ``send`` takes requests with lane and batch and gives key, result and body. The table at ``path`` has every attempt: a pass adds its own in one write, so a run that
    stops goes on from the passes that were written, and a request's second failure is final after a restart too.
    """
    spark = requests.sparkSession
    empty = spark.createDataFrame([], ATTEMPTS)
    for _ in range(most):
        known = spark.read.schema(ATTEMPTS).parquet(path) if _exists(spark, path) else empty
        todo = to_send(requests, known, most)
        if todo.isEmpty():
            break
        number = (known.agg(F.max("pass")).first()[0] or 0) + 1
        found = send(batches(todo, size, "key", chunk))
        found.select(F.col("key").cast("string").alias("key"), F.lit(number).cast("int").alias("pass"), F.col("result").cast("string").alias("result"), F.col("body").cast("string").alias("body")).write.mode("append").parquet(path)
    known = spark.read.schema(ATTEMPTS).parquet(path) if _exists(spark, path) else empty
    return standing(known.join(requests.select("key").distinct(), "key", "left_semi"), most)


ATTEMPTS = "key string, pass int, result string, body string"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
