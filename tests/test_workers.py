"""Queries with Python stages, each the first of its session, in a process whose workers have no PYTHONPATH."""

from __future__ import annotations

import os
import subprocess
import sys

from .conftest import ROOT

PYTHON_QUERIES = (
    "track_cascade", "turn_char_diff", "settle_events", "greedy_matching", "claims_assignment", "picture_states", "blinking_places", "optimal_grouping", "closest_in_next_turn",
    "proposal_repair", "links_refused", "words_regrouped", "answers_parsed", "tags_placed",
)

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tidemark import plans
for name in {names!r}:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    df = plans.queries()[name](spark, {sf!r})
    df.write.format("noop").mode("overwrite").save()
    print("ran", name, flush=True)
    spark.stop()
"""


def test_python_stages_without_a_path(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(root=ROOT, names=PYTHON_QUERIES, sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert [x.split()[1] for x in out.stdout.splitlines() if x.startswith("ran ")] == list(PYTHON_QUERIES), out.stderr[-2000:]


def test_every_query_with_a_python_stage_is_listed(spark, sf):
    from tidemark import plans

    def in_python(name):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().toString()
        return any(x in plan for x in ("MapInPandas", "MapInArrow", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsIn"))

    # these run their Python stages while they build their plan, and leave tables
    eager = {"proposal_repair"}
    names = [n for n in plans.queries() if n in PYTHON_QUERIES or n in ("nodes_by_level", "search_rrf_fused", "cost_rollup", "margins_of_frames", "collapse_keys")]
    assert {n for n in names if in_python(n)} | eager == set(PYTHON_QUERIES)
