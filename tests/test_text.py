from __future__ import annotations

import random
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.text import edit_script
from tidemark.operators import search as op


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_norm_and_similarity(spark):
    assert one(spark, tx.norm(F.lit("  git \u00a0 status "))) == "git status"
    assert one(spark, tx.norm(F.lit("“It’s” Ok"))) == "\"It's\" Ok"
    assert one(spark, tx.similarity(F.lit("ls"), F.lit("1s"))) == 0.5
    assert one(spark, tx.similarity(F.lit(" "), F.lit(""))) == 1.0
    assert one(spark, tx.lcp_len(F.lit("git status"), F.lit("git stauts"))) == 7
    assert one(spark, tx.lcp_len(F.lit("git status"), F.lit("git status -s"))) == 10


@pytest.mark.parametrize(("a", "b", "kind"), [("a b", "ab", "reread"), ("git", "git status", "appended"), ("git status", "git", "truncated"), ("x", "y", "changed"), ("", "y", "appended"), ("", "", "reread")])
def test_kind_of(spark, a, b, kind):
    assert one(spark, tx.kind_of(F.lit(a), F.lit(b))) == kind


@pytest.mark.parametrize(("a", "b", "same"), [("Save", "Save", True), ("x Save", "Save", True), ("Save", "Save ok", True), ("Save as", "Save", True), ("Save", "Open", False), ("Save all", "Save", False)])
def test_agreement(spark, a, b, same):
    assert one(spark, tx.agreement(F.lit(a), F.lit(b))) is same


def test_citations(spark):
    assert one(spark, tx.citations(F.lit("see 12:b4, Frame 12 and L3; T7 again 12:b4"))) == ["12:b4", "f12", "L3", "T7"]


def test_edit_script_golden():
    assert edit_script("git stauts", "git status") == [("=", "git sta"), ("-", "u"), ("=", "t"), ("+", "u"), ("=", "s")]
    assert edit_script("", "") == [] and edit_script("", "a") == [("+", "a")] and edit_script("a", "") == [("-", "a")]


def test_edit_scripts_are_shortest():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 10))) for _ in range(2))
        script = edit_script(a, b)
        assert "".join(t for o, t in script if o != "+") == a and "".join(t for o, t in script if o != "-") == b
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert sum(len(t) for o, t in script if o != "=") == len(a) + len(b) - 2 * table[-1][-1]


def test_edit_scripts_of_texts_that_are_cut(monkeypatch):
    """With a table of a few bits every pair is cut in two again and again; scripts stay as short."""
    import random

    from tidemark.functions import text as tx

    rng, whole = random.Random(4), tx.edit_script
    for _ in range(300):
        a, b = ("".join(rng.choice(rng.choice(["ab", "abcdé "])) for _ in range(rng.randint(0, 50))) for _ in range(2))
        kept = sum(len(t) for o, t in whole(a, b) if o == "=")
        with monkeypatch.context() as m:
            m.setattr(tx, "TABLE_BITS", 30)
            script = tx.edit_script(a, b)
        assert "".join(t for o, t in script if o != "+") == a and "".join(t for o, t in script if o != "-") == b
        assert sum(len(t) for o, t in script if o == "=") == kept
        assert all(x[0] != y[0] and (x[0], y[0]) != ("+", "-") for x, y in zip(script, script[1:]))
    long = "x" * 200_000
    assert whole(long + "a" + long, long + "b" + long) == [("=", long), ("-", "a"), ("+", "b"), ("=", long)]


TEXTS = ["az aks create --resource-group RG1 --name aks", "kubectl get nodes get nodes", "Configure the storage account", "C:\\src> git status", "café git", "git git git commit -m git", "nothing here"]


def nodes(spark, level="lifetime"):
    rows = [(f"n{k}", "v", level, k, float(k), float(k + 1), ["Terminal"], t) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "node_id string, video_id string, level string, ordinal int, t_start double, t_end double, apps array<string>, text string")


@pytest.mark.parametrize(("query", "tokenizer"), [("git", "word"), ("--name", "word"), ('"get nodes" storage', "word"), ("cafe", "word"), ("git", "trigram"), ("stor stat", "trigram")])
def test_bm25_is_that_of_fts5(spark, query, tokenizer):
    con = sqlite3.connect(":memory:")
    how = "unicode61 remove_diacritics 2 tokenchars '-_./:\\'" if tokenizer == "word" else "trigram"
    con.execute(f'create virtual table t using fts5(id unindexed, body, tokenize="{how}")')
    con.executemany("insert into t values (?, ?)", [(f"n{k}", x) for k, x in enumerate(TEXTS)])
    match = " OR ".join(f'"{x}"' for x in op.terms(query))
    expected = {r[0]: -r[1] for r in con.execute("select id, bm25(t) from t where t match ?", (match,))}
    got = {r.node_id: r.score for r in op.Index.build(nodes(spark)).bm25(query, tokenizer).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)
    scan = {r.node_id: r.score for r in op.Scan(nodes(spark)).bm25(query, tokenizer).collect()}
    assert scan.keys() == got.keys() and all(abs(got[k] - scan[k]) < 1e-9 for k in got)


@pytest.mark.parametrize("query", ["--name", "C:\\src>", '"git status', "*", "a", "git AND NOT status", "(", ""])
def test_any_query_is_fine(spark, query):
    op.search(op.Index.build(nodes(spark)), query).collect()


def test_search_collapses_runs_and_filters(spark, tmp_path):
    rows = [("f0", "v", "frame", 0, 0.0, 1.0, ["Azure"], "alpha"), ("f1", "v", "frame", 1, 1.0, 2.0, ["Azure"], "alpha"), ("f2", "v", "frame", 2, 2.0, 3.0, ["Shell"], "alpha beta"), ("L1", "v", "lifetime", None, 0.0, 3.0, [], "alpha")]
    made = spark.createDataFrame(rows, "node_id string, video_id string, level string, ordinal int, t_start double, t_end double, apps array<string>, text string")
    index = op.Index.build(made)
    index.save(str(tmp_path))
    index = op.Index.load(spark, str(tmp_path))
    hits = {r.node_id: r for r in op.search(index, "alpha").collect()}
    assert hits["f0"].members == 2 and hits["f0"].member_ids == ["f0", "f1"] and hits["f2"].members == 1 and "f1" not in hits
    assert {r.node_id for r in op.search(index, "alpha", app="azu").collect()} == {"f0"}
    assert op.search(index, "alpha", level="region").count() == 0
    assert {r.node_id for r in op.search(index, "alpha", collapse=False, t_from=2.5).collect()} == {"f2", "L1"}


def test_edit_scripts_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(tx, "RUNS", 10)
    rows = [("kitten", "sitting"), (None, "x"), ("", ""), ("abc", "abd")] * 20
    got = list(tx._char_diff.func(iter([(pa.array([a for a, _ in rows]), pa.array([b for _, b in rows]))])))
    assert [[(r["op"], r["text"]) for r in x] for part in got for x in part.to_pylist()] == [tx.edit_script(a or "", b or "") for a, b in rows]
    assert len(got) > 10 and max(len(part.flatten()) for part in got) < 20
