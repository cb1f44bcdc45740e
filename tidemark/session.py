"""What operators need of a session: workers that can import this package, and cuts in lineage."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint, so that its plan doesn't grow from round to round; the folder is that of ``spark.checkpoint.dir``, one of our own only where none is set
    on a single machine."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = context.getConf().get("spark.checkpoint.dir")
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        context.setCheckpointDir(base)
    return df.checkpoint()
