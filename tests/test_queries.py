from __future__ import annotations

import pytest

from tidemark import plans

from .oracle import assert_same, by_sql


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    assert_same(plans.queries()[name](spark, sf).toPandas(), by_sql(plans.oracle_sql()[name], sf))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_edit_scripts_rebuild_both_texts(spark, sf):
    bad = plans.queries()["turn_char_diff"](spark, sf).filter("not before_ok or not after_ok")
    assert bad.isEmpty()


def test_greedy_pairs_agree_with_mutual_best_rounds(spark, sf):
    from tidemark.operators import matching
    from tidemark.plans import events

    candidates = events._candidates(spark, sf)
    greedy = {(r.left_key, r.i, r.j) for r in matching.greedy_pairs(candidates, ["left_key"]).collect()}
    rounds = {(r.left_key, r.i, r.j) for r in matching.mutual_best(candidates, ["left_key"]).collect()}
    assert rounds == greedy


def test_claims_are_given_once(spark, sf):
    rows = plans.queries()["claims_assignment"](spark, sf).collect()
    assert len({r.claim for r in rows}) == len({r.row for r in rows}) == len(rows) > 0


def test_digest_ignores_order_and_sees_changes(spark):
    from tidemark.operators.lineage import table_digest

    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    digest = lambda df: table_digest(df).first().digest
    assert digest(a) == digest(a.orderBy("x", ascending=False).repartition(3))
    assert digest(a) != digest(a.distinct()) and digest(a) != digest(a.withColumnRenamed("x", "z").selectExpr("z + 1 as z", "y"))


def test_edit_scripts_are_of_whole_turns(spark, tmp_path):
    long = "x" * 90
    rows = [(1, 1, f"{long}\nsecond line"), (1, 2, f"{long}\nsecond lime"), (2, 1, f"{long} a"), (2, 2, f"{long} b"), (2, 3, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = plans.queries()["turn_char_diff"](spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn, r.n_runs) for r in got) == [(1, 2, 4), (2, 2, 3), (2, 3, 1)]
    assert all(r.before_ok and r.after_ok for r in got)


def test_claims_of_a_hot_text(spark):
    """Against a plain search of all free claims; then a text with so many that this search would not end."""
    import random

    from tidemark.operators import evaluation as ev

    rng = random.Random(3)
    rows = [(rng.choice("abc"), k, rng.choice([None, float(rng.randrange(30)), float(rng.randrange(30))]), rng.random() < 0.6) for k in range(150)]
    claims = [(rng.choice("abc"), 1000 + k, float(rng.randrange(30))) for k in range(110)]
    expected = set()
    for text in "abc":
        free = sorted((at, claim) for t, claim, at in claims if t == text)
        for executed in (True, False):
            for _, row, at, _ in [r for r in rows if r[0] == text and r[3] == executed]:
                if free:
                    best = min(free, key=lambda f: (abs(f[0] - at), f)) if executed and at is not None else free[0]
                    free.remove(best)
                    expected.add((text, row, best[1], executed))
    frames = spark.createDataFrame(rows, "text string, row long, at double, executed boolean"), spark.createDataFrame(claims, "text string, claim long, at double")
    assert {tuple(r) for r in ev.assign_claims(*frames).collect()} == expected
    many = spark.range(120_000).selectExpr("'hot' as text", "id", "cast(id * 7919 % 120000 as double) as at")
    plan = ev.assign_claims(many.selectExpr("text", "id as row", "at", "true as executed"), many.selectExpr("text", "id as claim", "at"))
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    assert plan.filter("row = claim").count() == 120_000


def test_agreement_reads_whole_texts(spark, tmp_path):
    same = "line one\nline  two"
    rows = [(1, 1, "user", same), (1, 2, "assistant", "ok line one line two"), (1, 3, "user", "line one\nline three"), (2, 1, "user", "it’s"), (2, 2, "assistant", "it's"), (2, 3, "user", None), (2, 4, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = plans.queries()["agreement_of_texts"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == {("assistant", "user", 3, 3), ("user", "assistant", 0, 2)}


def test_all_levels_of_the_hierarchy(spark, sf):
    import pandas as pd

    lines, orders, customers = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("lineitem", "orders", "customer"))
    every = lines.merge(orders, left_on="l_orderkey", right_on="o_orderkey").merge(customers, left_on="o_custkey", right_on="c_custkey")
    got = plans.queries()["nodes_of_all_levels"](spark, sf).toPandas()
    keys = {"line": ["l_orderkey", "l_linenumber"], "order": ["l_orderkey"], "customer": ["o_custkey"], "nation": ["c_nationkey"]}
    assert set(got.level) == set(keys)
    for level, key in keys.items():
        texts = every.sort_values(["l_orderkey", "l_linenumber", "l_returnflag"] if level != "nation" else ["o_custkey", "l_orderkey", "l_linenumber", "l_returnflag"])
        texts = texts.groupby(key).l_returnflag.agg(lambda x: "\n".join(x.unique()))
        own = got[got.level == level]
        assert dict(zip(own.text, own.n_nodes)) == texts.value_counts().to_dict() and own.n_lines.sum() == len(every)
    tree = plans.queries()["hierarchy_of_all_levels"](spark, sf).groupBy("depth").count().collect()
    placed = orders[orders.o_custkey.isin(customers.c_custkey)]
    assert {r.depth: r["count"] for r in tree}.items() >= {15: 1, 1: placed.o_custkey.nunique(), 0: len(placed)}.items()


def test_every_table_has_a_digest(spark, sf):
    from .oracle import TABLES

    got = {r.name: r.n_rows for r in plans.queries()["lineage_digest"](spark, sf).collect()}
    assert got == {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in TABLES}


def test_candidates_need_no_aggregate_after_the_join(spark, sf):
    from tidemark.plans import events

    found = events._candidates(spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")
    assert found.count() == found.select("left_key", "i", "j").distinct().count()


def test_rounds_of_mutual_best_join_nothing(spark):
    from tidemark.operators import matching

    made = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 5.0), (1, 2, 1, 5.0), (1, 2, 2, 4.0), (2, 1, 1, 1.0)], "g long, i long, j long, area double")
    found = matching.mutual_best(made, ["g"], 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, matching.mutual_best(made, ["g"]).collect())) == [(1, 1, 1, 5.0), (1, 2, 2, 4.0), (2, 1, 1, 1.0)]
