from __future__ import annotations

import random

import pytest

from tidemark.operators.assignment import Assigner, grouping_difference, optimal_pairs


def exhaustive(weights, left, taken):
    if not left:
        return 0
    rest = exhaustive(weights, left[1:], taken)
    for (i, j), w in weights.items():
        if i == left[0] and j not in taken:
            rest = max(rest, w + exhaustive(weights, left[1:], taken | {j}))
    return rest


def solve(weights: dict) -> list:
    m = Assigner()
    for (i, j), w in sorted(weights.items()):
        m.step(i, j, w)
    return m.close()


@pytest.mark.parametrize("seed", range(8))
def test_total_equals_exhaustive_search(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        top = rng.choice([1, 2, 9, 1000])
        weights = {(i, j): rng.randint(0, top) for i in range(n) for j in range(m) if rng.random() < rng.choice([0.3, 1])}
        got = solve(weights)
        assert len({i for i, _, _ in got}) == len({j for _, j, _ in got}) == len(got)
        assert all(weights[i, j] == w > 0 for i, j, w in got)
        assert sum(w for *_, w in got) == exhaustive({k: w for k, w in weights.items() if w > 0}, sorted({i for i, _ in weights}), set())


def test_greedy_is_not_enough():
    assert solve({(0, 0): 10, (0, 1): 9, (1, 0): 9}) == [(0, 1, 9), (1, 0, 9)]


def test_a_large_sparse_group():
    rng = random.Random(1)
    weights = {(i, (i + k) % 4000): rng.randint(1, 50) for i in range(4000) for k in range(3)}
    got = solve(weights)
    assert len(got) <= 4000 and sum(w for *_, w in got) >= sum(weights[i, i] for i in range(4000))


def test_pairs_by_group(spark):
    rows = [("a", 0, 0, 10), ("a", 0, 1, 9), ("a", 1, 0, 9), ("a", 1, 0, 3), ("b", 0, 0, 0), ("b", None, 1, 5), (None, 3, 3, 1), ("b", 2, 2, None)]
    got = optimal_pairs(spark.createDataFrame(rows, "g string, i long, j long, weight long"), ["g"]).collect()
    assert {tuple(r) for r in got} == {("a", 0, 1, 9), ("a", 1, 0, 9), (None, 3, 3, 1)}


def test_groupings_compared_whatever_their_labels(spark):
    rows = [("f", k, "x" if k < 3 else "y", "p" if k < 2 else "q") for k in range(6)] + [("f", 6, None, None), ("f", 7, "x", None), (None, 8, "x", "z")]
    got = grouping_difference(spark.createDataFrame(rows, "g string, item long, a string, b string"), ["g"], "a", "b").collect()
    assert {r.item for r in got if r.differs} == {2, 7} and len(got) == len(rows)
