"""The one-sided top-n against Spark's all-pairs form and against plain sorting."""

from __future__ import annotations

import numpy as np
import pytest

from tastemill.levels import LEVELS
from tastemill.operators import recommend, topn
from tastemill.plans.taste_queries import profile
from tastemill.sources.retail import RetailData


def lists(df):
    return {r["user_id"]: [(x["product_id"], x["rating"]) for x in r["recommendations"]] for r in df.collect()}


@pytest.mark.parametrize("level", list(LEVELS))
def test_same_lists_as_all_pairs(spark, level):
    data = RetailData(spark, "/root/testdata/sf0.01")
    scores, _, _ = recommend.indexed_scores(profile(data, LEVELS[level]), LEVELS[level])
    model = recommend.fit_als(scores, recommend.ALSSettings(iterations=2, user_blocks=4))
    ours, theirs = lists(topn.best_products(model.userFactors, model.itemFactors)), lists(model.recommendForAllUsers(15))
    assert ours.keys() == theirs.keys() and len(ours) > 100
    for user, wanted in theirs.items():
        got = ours[user]
        assert [s for _, s in got] == pytest.approx([s for _, s in wanted], rel=1e-5, abs=1e-6)
        # where scores are not apart, the two may name equals in another order
        for (a, s), (b, _), near in zip(got, wanted, zip([None, *wanted], [*wanted[1:], None])):
            apart = all(x is not None and abs(x[1] - s) > 1e-5 * abs(s) + 1e-6 for x in near)
            assert a == b or not apart


def table(spark, factors, ids):
    rows = [(int(i), [float(x) for x in f]) for i, f in zip(ids, factors)]
    return spark.createDataFrame(rows, "id int, features array<float>").repartition(3)


def sorted_all(users, products, ids, n):
    score = (users.astype(np.float64) @ products.astype(np.float64).T).astype(np.float32)
    return [[(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:n]] for s in score]


@pytest.mark.parametrize("chunk, block", [(1000, 64), (7, 3), (50, 1), (1, 1)])
def test_blocks_chunks_and_signs(spark, chunk, block):
    rng = np.random.default_rng(2)
    # whole numbers: many ties, negative scores, zero vectors
    users, products = rng.integers(-3, 4, (60, 3)).astype(np.float32), rng.integers(-2, 5, (20 if chunk == 1 else 120, 3)).astype(np.float32)
    ids = rng.permutation(1000)[: len(products)].astype(np.int32)
    got = lists(topn.best_products(table(spark, users, range(60)), table(spark, products, ids), 6, chunk, block))
    assert [got[u] for u in range(60)] == sorted_all(users, products, ids, 6)


def test_fewer_products_than_wanted(spark):
    users, products = table(spark, np.ones((3, 2)), range(3)), table(spark, np.ones((2, 2)), [5, 4])
    assert lists(topn.best_products(users, products)) == {u: [(4, 2.0), (5, 2.0)] for u in range(3)}
    assert lists(topn.best_products(users, products.where("false"))) == {}
    assert lists(topn.best_products(users.where("false"), products)) == {}


def test_no_pairs_in_the_plan(spark):
    users, products = table(spark, np.ones((3, 2)), range(3)), table(spark, np.ones((2, 2)), [5, 4])
    plan = topn.best_products(users, products)._jdf.queryExecution().executedPlan().toString()
    for word in ("Join", "CartesianProduct", "Exchange hash"):
        assert word not in plan


def test_users_stop_early(spark):
    """Long products first: a user with a full list of high scores never sees the short ones."""
    rng = np.random.default_rng(7)
    products = np.concatenate((rng.uniform(5, 6, (40, 3)), rng.uniform(0, 0.1, (5000, 3)))).astype(np.float32)
    seen = []
    for ids, _, _ in topn.by_length(table(spark, products, range(len(products))), 64):
        seen.append(ids)
        if len(seen) == 2:
            break
    assert set(range(40)) <= set(seen[0].tolist())
    users = table(spark, rng.uniform(1, 2, (30, 3)), range(30))
    runs = []
    original = topn.walk
    try:
        topn.walk = lambda *a: runs.append(1) or original(*a)
        got = lists(topn.best_products(users, table(spark, products, range(len(products))), 15, 64))
    finally:
        topn.walk = original
    assert len(runs) == 1 and all({p for p, _ in x} <= set(range(40)) for x in got.values())


def test_zeros_of_both_signs_are_equal(spark):
    factors = np.array([[1.0, -0.0], [1.0, 0.0], [-1.0, 0.0], [2.0, 1.0]], np.float32)
    users = np.array([[0.0, 1.0], [0.0, -1.0], [-0.0, 0.0]], np.float32)
    got = lists(topn.best_products(table(spark, users, range(3)), table(spark, factors, [9, 4, 7, 5]), 3, 100, 2))
    assert [[p for p, _ in got[u]] for u in range(3)] == [[5, 4, 7], [4, 7, 9], [4, 5, 7]]
