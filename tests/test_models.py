"""Invariants of what SQL cannot check: recommendations and clusters."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tastemill.levels import LEVELS
from tastemill.operators import clusters, recommend
from tastemill.plans.taste_queries import profile

LEVEL = LEVELS["designer_class"]
SETTINGS = recommend.ALSSettings(iterations=3, user_blocks=4)


@pytest.fixture(scope="module")
def recs(data):
    return recommend.recommend(profile(data, LEVEL), LEVEL, SETTINGS).collect()


def test_recommendations(recs, data):
    assert len({(r.cust_id, r.category) for r in recs}) == len(recs)
    by: dict = {}
    for r in recs:
        by.setdefault(r.cust_id, []).append((r.propensity_rank, r.propensity_score))
    for ranks in by.values():
        ranks.sort()
        assert [k for k, _ in ranks] == list(range(1, len(ranks) + 1)) and len(ranks) <= 15
        assert all(a[1] >= b[1] for a, b in zip(ranks, ranks[1:]))
    scores = [r.propensity_score for r in recs]
    assert min(scores) == pytest.approx(1) and max(scores) == pytest.approx(100)


def test_same_seed_same_list(recs, data):
    again = recommend.recommend(profile(data, LEVEL), LEVEL, SETTINGS).collect()
    key = lambda r: (r.cust_id, r.propensity_rank)
    assert [(key(r), r.category) for r in sorted(recs, key=key)] == [(key(r), r.category) for r in sorted(again, key=key)]


def test_split_is_a_partition_and_repeats(spark):
    df = spark.range(20000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    train, validation = recommend.split_train_validation(df, ["a", "b"])
    assert train.count() + validation.count() == 20000
    assert train.intersect(validation).isEmpty()
    assert 0.78 < train.count() / 20000 < 0.82
    assert train.count() == recommend.split_train_validation(df.repartition(5), ["a", "b"])[0].count()


def test_model_beats_the_variance(data):
    scores, _, _ = recommend.indexed_scores(profile(data, LEVELS["division"]), LEVELS["division"])
    error = recommend.evaluate(recommend.fit_als(scores, SETTINGS).transform(scores)).first()
    spread = scores.agg(F.stddev_pop("score")).first()[0]
    assert error["rmse"] < spread and error["n"] == scores.count()


def test_elbow(data):
    got = {r.k: r.within_ss for r in clusters.kmeans_elbow(data.table("part"), "p_size", range(1, 5), iterations=50).collect()}
    assert list(sorted(got)) == [1, 2, 3, 4] and got[1] > got[2] > got[3] > got[4]


@pytest.mark.parametrize("ascending", [True, False])
def test_cluster_numbers_follow_the_mean(data, ascending):
    rows = clusters.cluster_feature(data.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4, ascending)
    means = [r[1] for r in rows.groupBy("c_acctbal_cluster").agg(F.avg("c_acctbal")).orderBy("c_acctbal_cluster").collect()]
    assert means == sorted(means, reverse=not ascending) and len(means) == 4
    assert rows.count() == data.table("customer").count()


def test_residual_is_the_gradient(spark):
    """Against the ridge equations written out for every user."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(u, p, float(rng.integers(1, 6))) for u in range(40) for p in range(12) if rng.random() < 0.5]
    ratings = spark.createDataFrame(rows, "user_id int, product_id int, score double")
    settings = recommend.ALSSettings(iterations=2, user_blocks=2, reg=0.1)
    model = recommend.fit_als(ratings, settings)
    u, v = ({r["id"]: np.array(r["features"], float) for r in side.collect()} for side in (model.userFactors, model.itemFactors))
    got = {r["user_id"]: r for r in recommend.als_residuals(model, ratings, settings).collect()}
    for user in u:
        mine = [(p, s) for w, p, s in rows if w == user]
        gradient = sum(v[p] * (v[p] @ u[user] - s) for p, s in mine) / len(mine) + 0.1 * u[user]
        assert got[user]["n_ratings"] == len(mine) and got[user]["residual"] == pytest.approx(abs(gradient).max(), abs=1e-9)
        assert got[user]["residual"] < 1e-4
    off = recommend.als_residuals(model, ratings.withColumn("score", F.col("score") + 1), settings)
    assert off.where("residual > 0.1").count() > 30


def test_grid_side_by_side_finds_what_fits_in_a_row_find(data):
    scores, _, _ = recommend.indexed_scores(profile(data, LEVEL), LEVEL)
    train, validation = recommend.split_train_validation(scores, ["user_id", "product_id"])
    grid, best = recommend.tune_als(train, validation, settings=SETTINGS)
    got = {(r["rank"], r["reg"]): r["rmse"] for r in grid.collect()}
    from dataclasses import replace

    for rank, reg in got:
        tried = replace(SETTINGS, rank=rank, reg=reg)
        assert recommend.evaluate(recommend.fit_als(train, tried).transform(validation)).first()["rmse"] == pytest.approx(got[rank, reg], rel=1e-5)
    assert got[best.rank, best.reg] == min(got.values()) and best.iterations == SETTINGS.iterations


def test_fits_run_over_as_few_partitions_as_the_values_need(spark, monkeypatch):
    from types import SimpleNamespace

    seen, real = [], clusters._kmeans

    def recorded(*settings):
        return SimpleNamespace(fit=lambda points: seen.append((points.rdd.getNumPartitions(), points.count())) or real(*settings).fit(points))

    monkeypatch.setattr(clusters, "_kmeans", recorded)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = clusters.fixed_points(spark.range(3000).select((F.col("id") % 1000).alias("v")), "v", [2, 3]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [n for _, n in seen] == [1000, 1000] and max(parts for parts, _ in seen) <= 8
    assert sorted((r["k"], r["n_clusters"], r["n_astray"]) for r in found) == [(2, 2, 0), (3, 3, 0)]


def test_a_partition_of_the_layout_is_a_block_of_users(spark):
    ratings = spark.range(400).select((F.col("id") % 50).cast("int").alias("user_id"), (F.col("id") % 8).cast("int").alias("product_id"), F.lit(1.0).alias("score"))
    held = recommend.steady_layout(ratings, 7).select("user_id", F.spark_partition_id().alias("part")).collect()
    assert len(held) == 400 and all(r.part == r.user_id % 7 for r in held)


def test_lists_meet_their_customers_before_they_are_opened(data, monkeypatch):
    seen = []

    def noted(df, *label):
        seen.append(df.columns)
        return df

    tastes = recommend.cut(profile(data, LEVEL))
    indexed = recommend.indexed_scores(tastes, LEVEL)
    monkeypatch.setattr(recommend, "cut", noted)
    recommend.recommend(tastes, LEVEL, SETTINGS, indexed=indexed)
    assert seen == [["cust_id", "product_id", "propensity_rank", "propensity_score"]]


def test_the_categories_side_of_a_fit_runs_in_more_than_four_tasks():
    assert recommend.als(recommend.ALSSettings(), 200).getNumItemBlocks() > 4


def test_a_fit_works_its_ratings_out_once(spark):
    """The fit asks for its rows twice; what is behind them runs once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(score):
        seen.add(1)
        return score

    rows = [(u, p, float((u * p) % 5 + 1)) for u in range(30) for p in range(8)]
    ratings = spark.createDataFrame(rows, "user_id int, product_id int, score double").withColumn("score", F.udf(counted, "double")("score"))
    recommend.fit_als(ratings, SETTINGS)
    assert seen.value == len(rows)


def test_a_held_profile_of_nothing(spark):
    from tastemill.operators import taste

    columns = ", ".join(f"{c} {'bigint' if c.endswith('_id') else 'string'}" for c in ["cust_id", *LEVEL.columns])
    nothing = spark.createDataFrame([], columns)
    assert taste.taste_profile(nothing, nothing, LEVEL, held=True).isEmpty()
