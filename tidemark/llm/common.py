"""What the training-data operators share: tables, the shared folder, word rules and splits.

Words are maximal runs of bytes outside space and 0x09-0x0D, so ``bytes.split()`` (which splits on
exactly those bytes) is the reference rule in Python and ``WORD`` the same rule for SQL engines.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: What a text with a word matches.
SPACES = r"[^\x20\x09-\x0D]"
#: Rows of an Arrow batch handed to Python: long texts make larger batches costly.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Let executors import this package from where the driver has it, and keep Arrow batches small."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, where it is unset on a single machine, one of our own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The column's texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def by_bytes(texts: list[bytes], most: int = 4 << 20) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` bytes each, so that vectorised work stays in bounded memory."""
    begin = size = 0
    for k, x in enumerate(texts):
        size += len(x) + 1
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
