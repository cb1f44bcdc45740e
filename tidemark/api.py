"""The tool interface: every method gives a DataFrame, an unknown id an empty one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import search as op


@dataclass
class Store:
    """A folder with an index (postings, statistics, nodes) and the tables of its runs: changes, boxes, and summaries if there are any."""

    spark: SparkSession
    path: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def index(self) -> op.Index:
        return op.Index.load(self.spark, self.path)

    def list_videos(self) -> DataFrame:
        return self.index().nodes.groupBy("video_id").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.count("*").alias("n_nodes"), F.count_if(F.col("level") == "frame").alias("n_frames"))

    def search(self, query: str, limit: int | None = None, **where) -> DataFrame:
        """Hits by rank. If an app filter finds no node with any app, it is left out: the run has no labels."""
        index = self.index()
        if where.get("app") and index.nodes.filter(F.size("apps") > 0).isEmpty():
            where = {k: v for k, v in where.items() if k != "app"}
        return op.search(index, query, limit=limit, **where)

    def get_node(self, node_id: str) -> DataFrame:
        return self.index().nodes.filter(F.col("node_id") == node_id)

    def get_transitions(self, video_id: str, t_from: float, t_to: float) -> DataFrame:
        """Changes that meet the closed range, in order."""
        return self._table("changes").filter((F.col("video_id") == video_id) & (F.col("t_end") >= t_from) & (F.col("t_start") <= t_to)).orderBy("t_start", "change_id")

    def get_frame(self, video_id: str, frame: int) -> DataFrame:
        """Boxes of a frame in reading order."""
        return self._table("boxes").filter((F.col("video_id") == video_id) & (F.col("frame") == frame)).orderBy("ordinal")

    def summary(self, video_id: str, level: str | None = None) -> DataFrame:
        wanted = F.col("level").isin("step", "section", "chapter", "video") if level is None else F.col("level") == level
        return self.index().nodes.filter((F.col("video_id") == video_id) & wanted).orderBy("t_start", "node_id")
