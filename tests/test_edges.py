"""Null keys, sentinels, short entries, one-row groups, hot keys."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastemill.functions import dates, fixed, scoring, text
from tastemill.levels import LEVELS, Level
from tastemill.operators import clicks, customers, features, filters, inventory, keys, ratings, sales, taste


def test_levels():
    assert list(LEVELS) == ["division", "designer", "class", "designer_class", "division_class", "designer_division", "designer_division_class"]
    assert LEVELS["designer_class"].columns == ["designer_id", "designer", "class_id", "class"]


def test_short_entries_and_empty_lists(spark):
    df = spark.createDataFrame([(1, "c;NM_1;2;3.5,c;NM_2,x"), (2, None), (3, "")], "id int, product_list string")
    got = [(r.id, r.item_code, r.qty, r.total_price) for r in clicks.parse_product_list(df).orderBy("id").collect()]
    assert got == [(1, "NM_1", "2", "3.5"), (1, "NM_2", None, None), (1, None, None, None), (3, None, None, None)]


def test_action_order_and_case(spark):
    df = spark.createDataFrame([("My Cart", 1), ("product detail", 1), ("x", 1), ("cart", None)], "page string, pid int")
    got = [r[0] for r in df.select(text.action_type(F.col("page"), F.col("pid"))).collect()]
    assert got == ["Cart_Add", "Product_Page", "Purchase", "Other"]


def test_null_description_drops(spark):
    df = spark.createDataFrame([("blue shirt",), ("SWIM short",), (None,), ("Misc item",)], "description string")
    assert [r[0] for r in filters.description_exclusions(df).collect()] == ["blue shirt"]


def test_exclusion_list_with_null_removes_only_matches(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    out = spark.createDataFrame([(2,), (None,)], "k int")
    kept, gone = keys.without_keys(df, out), keys.with_keys(df, out)
    assert rows(kept) == [(1,), (None,)] and rows(gone) == [(2,)]


def test_counts_leave_null_keys_out(spark, rows):
    level = Level(("class",))
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, "x"), (None, 1, "x")], "cust_id string, class_id int, class string")
    counted = taste.count_by_level(taste.with_category(df, level), level, "n")
    assert rows(counted) == [("a", "x", 1, "x", 2)]


def test_unknown_customer_is_left_out_of_browses(spark):
    df = spark.createDataFrame([("-1", 1, "x"), ("7", 1, "x"), (None, 1, "x")], "cust_id string, class_id int, class string")
    assert sorted(str(r.cust_id) for r in taste.browse_by_level(df, Level(("class",))).collect()) == ["7", "None"]


def test_taste_counts_equal_the_outer_merge(data, rows):
    from tastemill.plans.taste_queries import click_views, history

    level = LEVELS["class"]
    one = taste.taste_counts(click_views(data), history(data, level), level)
    b = taste.count_by_level(taste.browse_by_level(click_views(data), level), level, "times_browse")
    t = taste.count_by_level(taste.trans_by_level(history(data, level), level), level, "total_transactions")
    two = taste.outer_merge_counts(b, t, level).select(one.columns)
    assert rows(one) == rows(two)


def test_taste_score_is_monotone(data):
    from tastemill.plans.taste_queries import click_views, history

    level = LEVELS["designer_class"]
    ranked = taste.score_taste(taste.with_implicit_rank(taste.taste_counts(click_views(data), history(data, level), level)))
    seen = [(r.rank_implicit, r.score) for r in ranked.select("rank_implicit", "score").distinct().collect()]
    assert all(s1 <= s2 for (v1, s1) in seen for (v2, s2) in seen if v1 <= v2)
    assert {s for _, s in seen} <= {1, 2, 3, 4, 5}


def test_scaling_when_all_scores_are_equal(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(scoring.minmax_scale(F.col("v"), F.lit(5.0), F.lit(5.0))).collect()] == [1.0, 1.0]
    assert df.select(scoring.renormalize(F.col("v"), (F.lit(5.0), F.lit(5.0)), (1, 5))).first()[0] is None


@pytest.mark.parametrize("day, saturday", [("2024-01-06", "2023-12-30"), ("2024-01-07", "2024-01-06"), ("2024-01-10", "2024-01-06")])
def test_last_saturday(spark, day, saturday):
    got = spark.range(1).select(dates.last_saturday(F.to_date(F.lit(day)))).first()[0]
    assert got == dt.date.fromisoformat(saturday)
    assert dates.run_windows(dt.date.fromisoformat(day))["browse"][1] == got


def test_date_from_text(spark):
    df = spark.createDataFrame([("2020-02-03 04:05:06",), ("2020-02-03",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(dates.date_from_text(F.col("t"))).collect()] == [dt.date(2020, 2, 3)] * 2 + [None, None]


def test_return_reference(spark):
    df = spark.createDataFrame([("0612/000004/0011234/010295",), ("12",), (None,)], "r string")
    got = df.select(*[c.alias(n) for n, c in text.return_reference(F.col("r")).items()]).collect()
    assert tuple(got[0]) == (612, 4, 1234, dt.date(1995, 1, 2))
    assert tuple(got[1]) == (12, None, None, None) and tuple(got[2]) == (None,) * 4


def test_time_features_of_one_day(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 6)), ("a", dt.date(2020, 1, 6))], "cust_id string, trans_date date")
    r = features.time_features(df, dt.date(2020, 1, 10)).collect()
    assert len(r) == 1 and (r[0].frequency, r[0].interarrival_days, r[0].recency, r[0].active_duration, r[0].day) == (1, 0, 4, 0, 0)


def test_secondary_associate_keeps_the_line_once(spark, rows):
    lines = spark.createDataFrame([(1, 10, 20), (2, -1, 20), (3, 30, None), (4, None, 10), (5, 10, 10)], "cust_id int, assoc1 bigint, assoc2 bigint")
    active = spark.createDataFrame([(10,), (20,), (20,)], "assoc_id bigint")
    assert rows(customers.keep_active_associates(lines, active)) == [(1, 10, 20), (2, -1, 20), (4, -1, 10), (5, 10, 10)]
    assert customers.matched_by_associate(lines, active).count() == 4


def test_web_only_stock_gets_its_own_location(spark, rows):
    stores = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (1, "b", 2)], "location_id int, brand_class string, brand_class_qty bigint")
    online = spark.createDataFrame([("a", 4), ("c", 9)], "brand_class string, online_brand_class_qty bigint")
    assert set(rows(inventory.merged_inventory(stores, online))) == {(1, "a", 9), (1, "b", 2), (2, "a", 7), (124, "c", 9)}


def test_omni_status(spark):
    visits = spark.createDataFrame([("a", "Store"), ("a", "Online"), ("b", "Store"), ("c", "Catalog"), ("d", "Online")], "cust_id string, channel string")
    got = {(r.cust_id, r.omni_status) for r in customers.customer_channel_status(visits).collect()}
    assert got == {("a", "Omni"), ("b", "Store_Only"), ("c", "Catalog_Only"), ("d", "Online_Only")}


# --- hot keys --------------------------------------------------------------------------

def _skewed(spark, n=6000):
    """One customer holds a third of the rows."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500 + 1).alias("cust_id"), F.col("id").alias("v"))


def test_hot_keys_come_from_a_sketch(spark):
    df = _skewed(spark, 60_000)
    found = {r["_hash"]: r["_hot"] for r in keys.heavy_hitters(df, ["cust_id"]).collect()}
    share = {r[0]: r[1] for r in df.groupBy(F.xxhash64("cust_id")).count().collect()}
    assert all(found[k] == (n * keys.HOT_SHARE > 60_000) for k, n in share.items() if n * keys.HOT_SHARE > 45_000)
    assert len(found) < 2 * keys.HOT_SHARE and keys.heavy_hitters(df.where("false"), ["cust_id"]).count() == 0


def test_attaching_starts_no_job(spark):
    """Plans of sliced joins and of the combined rating are built without running anything."""
    df = _skewed(spark)
    profile = spark.createDataFrame([(0, "x", 3), (5, "y", 2)], "cust_id long, category string, score int")
    context = spark.sparkContext
    context.setJobGroup("building", "no job wanted")
    try:
        taste.combined_rating(profile, df.withColumnRenamed("v", "rating"))
        keys.attach_per_key(df, keys.key_counts(df, ["cust_id"]), ["cust_id"])
        assert list(context.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys_are_few(spark):
    counts = keys.key_counts(_skewed(spark), ["cust_id"])
    hot = keys.hot_keys(counts, ["cust_id"])
    assert 0 in [r[0] for r in hot.collect()] and hot.count() < keys.HOT_SHARE


def test_sliced_join_equals_the_plain_join(spark, rows):
    df = _skewed(spark)
    lookup = keys.key_counts(df, ["cust_id"]).where("cust_id % 7 <> 3")
    sliced = keys.attach_per_key(df, lookup, ["cust_id"], slices=16)
    assert "_slice" in sliced._jdf.queryExecution().analyzed().toString()
    assert rows(sliced.select("cust_id", "v", "n")) == rows(df.join(lookup, "cust_id").select("cust_id", "v", "n"))


def test_support_filter_drops_hot_keys_exactly(spark, rows):
    events = _skewed(spark).select("cust_id", F.concat(F.lit("w"), F.col("v") % 40).alias("web_item_id"), "v")
    kept = ratings.frequency_support_filter(events, (3, 100), (20, 200))
    per_customer = {r["cust_id"]: r["count"] for r in events.groupBy("cust_id").count().collect()}
    per_item = {r["web_item_id"]: r["count"] for r in events.groupBy("web_item_id").count().collect()}
    expected = [r for r in rows(events) if 3 < per_customer[r[0]] <= 100 and 20 < per_item[r[1]] < 200]
    assert rows(kept.select(*events.columns)) == expected and expected and per_customer[0] > 100


def test_split_position_equals_the_single_window(spark, rows):
    events = _skewed(spark).select(
        "cust_id", F.when(F.col("v") % 2 == 0, "Purchase").otherwise("Cart_Add").alias("action_type"),
        F.concat(F.lit("w"), F.col("v")).alias("web_item_id"), F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("v") % 90).cast("int")).alias("day"))
    assert rows(ratings.recency_position(events)) == rows(ratings.recency_position(events, bounded=True))


def test_one_day_of_one_customer_over_all_partitions(spark, rows, monkeypatch):
    """Nothing but one customer, one action and one day: the numbering is spread and the same."""
    events = spark.range(6000, numPartitions=4).select(
        F.lit(1).cast("bigint").alias("cust_id"), F.lit("Cart_Add").alias("action_type"), F.format_string("w%06d", F.col("id") * 7919 % 6000).alias("web_item_id"),
        F.lit(dt.date(2020, 1, 1)).alias("day"))
    ranged, original = [], keys.cut
    monkeypatch.setattr(keys, "cut", lambda df, label="cut": ranged.append(original(df, label)) or ranged[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows(ratings.recency_position(events))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == rows(ratings.recency_position(events, bounded=True))
    shares = [r["count"] for r in ranged[0].groupBy(F.shiftrightunsigned("_at", 33)).count().collect()]
    assert len(shares) >= 4 and max(shares) < 3000


def test_lists_are_chunked_and_whole(spark, rows):
    events = _skewed(spark, 900).select(
        "cust_id", F.lit("Purchase").alias("action_type"), F.concat(F.lit("w"), F.col("v")).alias("web_item_id"), F.lit(dt.date(2020, 1, 1)).alias("day"))
    lists = ratings.collect_lists(events, chunk=50)
    assert lists.agg(F.max(F.size("items"))).first()[0] == 50
    opened = ratings.explode_aligned(lists, {"items": "web_item_id", "days": "day"})
    assert rows(opened.select(*events.columns)) == rows(events)


def test_empty_lists_stay(spark, rows):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], [])], "id int, n array<int>, s array<string>")
    assert rows(ratings.explode_aligned(df, {"n": "number", "s": "text"})) == [(1, 1, "a"), (1, 2, "b"), (2, None, None)]


def test_ordered_index_is_dense_and_ordered(spark):
    labels = spark.range(5000).select(F.format_string("k%05d", F.col("id") * 7919 % 5000).alias("label")).repartition(9)
    got = {r.label: r.code for r in keys.ordered_index(labels, [F.col("label")], "code").collect()}
    assert [got[k] for k in sorted(got)] == list(range(5000))


def test_combined_rating_equals_the_left_join(spark, rows):
    profile = spark.createDataFrame([("a", "x", 3), ("a", "y", 2), ("b", "x", 5)], "cust_id string, category string, score int")
    rated = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("z", 1.0)], "cust_id string, rating double")
    got = rows(taste.combined_rating(profile, rated))
    assert got == [("a", "x", 3, 13.0), ("a", "x", 3, 23.0), ("a", "y", 2, 12.0), ("a", "y", 2, 22.0), ("b", "x", 5, 0.0)]


@pytest.mark.parametrize("values", [[1.0], [2.0, 2.0, 2.0], [0.2, 0.4, 3.0, 3.0, 700.2, 1e9, 5e9], [-3.0, -0.5, 0.0, 0.5, 4.0, None], [0.2 * (i * i % 997) for i in range(3000)]])
def test_quantiles_are_exact(spark, values):
    """Running counts over bands give the interpolated quantiles of all values."""
    df = spark.createDataFrame([(v,) for v in values], "rank_implicit double")
    want = df.agg(F.percentile("rank_implicit", F.array(*[F.lit(q) for q in fixed.TASTE_QUANTILES]))).first()[0]
    assert taste.taste_quantiles(df).first()["quantiles"] == want


def test_quantiles_of_nothing(spark):
    for rows in ([], [(None,)]):
        assert taste.taste_quantiles(spark.createDataFrame(rows, "rank_implicit double")).first()["quantiles"] is None


def test_price_of_the_line_goes_before_that_of_the_product(spark):
    lines = spark.createDataFrame([(1, 5.0), (2, 6.0)], "item_id int, unit_retail double")
    product = spark.createDataFrame([(1, 9.0, "a"), (2, 9.0, "b")], "item_id int, unit_retail double, class_name string")
    both = sales.with_product(lines, product, ["unit_retail", "class_name"])
    assert sorted(both.collect()) == [(1, 5.0, "a"), (2, 6.0, "b")]
    assert sorted(sales.with_product(both, product, ["class_name"]).collect()) == sorted(both.collect())
