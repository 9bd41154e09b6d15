"""The worked examples of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastemill.functions import scoring
from tastemill.operators import ratings, rerank
from tastemill.levels import Level

RECS = "cust_id string, category string, propensity_score double, propensity_rank int"
G1 = [
    ("c1", "A", 27.4, 1), ("c1", "B", 24.4, 2), ("c1", "C", 18.6, 3), ("c1", "D", 15.8, 4), ("c1", "E", 10.2, 5),
    ("c2", "F", 14.1, 1), ("c2", "G", 12.5, 2), ("c2", "H", 12.5, 3), ("c2", "I", 12.1, 4), ("c2", "E", 11.0, 5),
]


def test_next_best_rank(spark):
    recs = spark.createDataFrame(G1, RECS)
    recent = spark.createDataFrame([("c1", "C"), ("c1", "F"), ("c2", "F"), ("c2", "D")], "cust_id string, category string")
    keys = ["cust_id", "category"]
    ranked = rerank.next_best_rank(rerank.unseen(recs, recent, keys))
    full = {(r.cust_id, r.category): r.next_best_rank for r in rerank.attach_rank(recs, ranked, keys).collect()}
    assert full == {
        ("c1", "A"): 1, ("c1", "B"): 2, ("c1", "C"): None, ("c1", "D"): 3, ("c1", "E"): 4,
        ("c2", "F"): None, ("c2", "G"): 1, ("c2", "H"): 2, ("c2", "I"): 3, ("c2", "E"): 4,
    }


def test_one_pass_rerank_equals_the_steps(spark):
    level = Level(("class",))
    recs = spark.createDataFrame(G1, RECS).withColumns({"class": F.col("category"), "class_id": F.ascii("category")})
    recent = spark.createDataFrame([("c1", "C"), ("c1", "F"), ("c2", "F"), ("c2", "F"), ("c2", "D")], "cust_id string, class string").withColumn("class_id", F.ascii("class"))
    got = {(r.cust_id, r.category): r.next_best_rank for r in rerank.rerank_unseen(recs, recent, level).collect()}
    assert got[("c1", "C")] is None and got[("c2", "F")] is None
    assert [got[("c2", c)] for c in "GHIE"] == [1, 2, 3, 4]
    assert len(got) == len(G1)


def test_next_best_rank_top_k(spark):
    recs = spark.createDataFrame([
        ("x", "P", 27.4, 1), ("x", "Q", 24.4, 2), ("x", "R", 18.6, 3), ("x", "S", 15.8, 4), ("y", "T", 14.1, 1), ("y", "R", 12.5, 2)], RECS)
    recent = spark.createDataFrame([("x", "U"), ("x", "Q"), ("x", "R"), ("x", "V"), ("y", "T"), ("z", "W")], "cust_id string, category string")
    keys = ["cust_id", "category"]
    ranked = rerank.next_best_rank_top_k(rerank.unseen(recs, recent, keys))
    full = {(r.cust_id, r.category): r.next_best_rank for r in rerank.attach_rank(recs, ranked, keys).collect()}
    assert full == {("x", "P"): 1, ("x", "Q"): None, ("x", "R"): None, ("x", "S"): 2, ("y", "T"): None, ("y", "R"): 1}


def test_top_k_ties_share_a_rank(spark):
    recs = spark.createDataFrame([("a", str(i), s, i) for i, s in enumerate([9.0, 9.0, 8.0, 7.0, 6.0, 5.0, 4.0], 1)], RECS)
    ranks = sorted(r.next_best_rank for r in rerank.next_best_rank_top_k(recs).collect())
    assert ranks == [1, 1, 3, 4, 5]


def test_publish_rule(spark):
    lists = {"a": [None, 1, 2, 3], "b": [1, 2, None, 3], "c": [None, None, 1, 2], "d": [1, 2, 3, 4]}
    recs = spark.createDataFrame(
        [(c, i, n) for c, ns in lists.items() for i, n in enumerate(ns, 1)], "cust_id string, propensity_rank int, next_best_rank int")
    counts = {r.cust_id: r.null_count for r in rerank.null_rank_count(recs).collect()}
    assert counts == {"a": 1, "b": 1, "c": 2, "d": 0}
    kept = sorted((r.cust_id, r.propensity_rank) for r in rerank.publish_window(recs, 2, 2).collect())
    assert kept == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("c", 4), ("d", 1), ("d", 2)]


def test_rating_position(spark):
    events = spark.createDataFrame(
        [("u", "Purchase", f"i{d}", f"2020-01-0{d}") for d in (1, 2, 3)] + [("w", "Purchase", "i1", "2020-01-01")],
        "cust_id string, action_type string, web_item_id string, day string").withColumn("day", F.to_date("day"))
    mix = spark.createDataFrame([("Product_Page", 50.0), ("Cart_Add", 30.0), ("Purchase", 20.0)], "action_type string, percent_dist double")
    bands = {r.action_type: (r.low, r.high) for r in ratings.action_bands(mix).collect()}
    assert bands == {"Product_Page": (0.0, 50.0), "Cart_Add": (50.0, 80.0), "Purchase": (80.0, 100.0)}
    for bounded in (True, False):
        placed = ratings.recency_position(events, bounded=bounded).join(ratings.action_bands(mix), "action_type")
        got = placed.withColumn("rating", scoring.action_rating(F.col("low"), F.col("high"), F.col("pu"))).collect()
        by = {(r.cust_id, r.web_item_id): (r.number_of_events, r.sum_of_events, r.pu, r.rating) for r in got}
        assert by[("u", "i3")] == (0, 3, 0.0, 100.0)
        assert by[("u", "i2")] == (1, 3, 0.5, 90.0)
        assert by[("u", "i1")] == (2, 3, 1.0, 80.0)
        assert by[("w", "i1")] == (0, 1, 0.0, 100.0)
