"""Every registered query with SQL gives the rows DuckDB gives on the same tables."""

from __future__ import annotations

import pytest
from verify import compare, connect

from tastemill.levels import LEVELS
from tastemill.plans.catalog import all_oracles, all_queries

FAMILIES = ("taste_profile_", "rerank_unseen_", "publish_", "publish_and_load_")


@pytest.fixture(scope="module")
def duck(root):
    return connect(root)


@pytest.mark.parametrize("name", list(all_oracles()))
def test_matches_sql(spark, duck, root, name):
    problem, _ = compare(all_queries()[name](spark, root), duck, all_oracles()[name])
    assert problem is None, problem


def test_every_level_is_registered():
    names = set(all_queries())
    for family in (*FAMILIES, "recommend_"):
        assert {f"{family}{level}" for level in LEVELS} <= names


def test_only_learning_queries_lack_an_oracle():
    without = set(all_queries()) - set(all_oracles())
    models = {f"recommend_{level}" for level in LEVELS} | {"recommend_division_for_all"}
    assert without == models | {"category_recommendations", "tune_als", "kmeans_elbow", "cluster_feature"}
    for family in ("fit_als_residual_", "tune_als_", "recommend_"):
        assert {f"{family}{level}" for level in LEVELS} <= set(all_queries())


def test_entry(spark):
    from __spark_entry__ import entry

    frame = entry(spark)
    assert frame.columns == ["cust_id", "category", "division_id", "division", "score"]
    assert frame.count() > 0
