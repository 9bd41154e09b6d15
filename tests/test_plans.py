"""What the planner makes of the operators."""

from __future__ import annotations

import pytest

from tastemill.levels import LEVELS
from tastemill.operators import taste
from tastemill.plans.catalog import all_queries

WIDE = [
    "taste_profile_designer_division_class", "clickstream_products", "transaction_spend", "inter_shopping_days",
    "recent_product_lines", "rerank_unseen_division", "publish_division", "keep_active_associates", "rolling_ty_ly",
    "combined_rating", "frequency_support_filter",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> str:
    """The formatted plan, whose scan details are not shortened."""
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


@pytest.mark.parametrize("name", WIDE)
def test_no_cartesian_product_and_no_python(spark, root, name):
    text = plan(all_queries()[name](spark, root))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in text


def test_date_range_reaches_the_scan(spark, root):
    text = scans(all_queries()["sales_base_filter"](spark, root))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text


def test_history_range_reaches_the_scan(spark, root):
    text = scans(all_queries()["trans_by_level"](spark, root))
    assert "GreaterThanOrEqual(o_orderdate,1998-07-29" in text and "LessThan(o_orderdate,2001-07-29" in text


@pytest.mark.parametrize("name", ["keep_active_associates", "matched_by_associate", "customer_channel_status"])
def test_lines_are_read_once(spark, root, name):
    assert plan(all_queries()[name](spark, root)).count("lineitem.parquet") == 1


# The gap table behind the product lines has a filter on parts of its own.
@pytest.mark.parametrize("name, scans_of_parts", [("transaction_spend", 1), ("item_price_catalog", 1), ("recent_product_lines", 2)])
def test_attributes_come_from_one_join(spark, root, name, scans_of_parts):
    assert plan(all_queries()[name](spark, root)).count("part.parquet") == scans_of_parts


def test_no_percentile_over_all_values(spark, root):
    assert "percentile" not in plan(all_queries()["taste_quantiles"](spark, root))


def test_only_used_columns_are_read(spark, root):
    text = plan(all_queries()["days_since_last_purchase"](spark, root))
    assert "ReadSchema: struct<l_orderkey:bigint>" in text
    assert "part.parquet" not in text and "supplier.parquet" not in text


@pytest.mark.parametrize("name", ["top_n_per_customer", "first_per_key", "favorite_store"])
def test_top_rows_are_limited_before_the_shuffle(spark, root, name):
    assert "WindowGroupLimit" in plan(all_queries()[name](spark, root))


def test_profile_counts_once(spark, root):
    df = all_queries()["taste_profile_division"](spark, root)
    df.collect()
    assert "ReusedExchange" in plan(df)


@pytest.fixture()
def eager_skew(spark):
    """No broadcasts, and thresholds low enough for a small table to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_busy_associate_is_split_and_unserved_lines_are_spread(eager_skew):
    """A third of the lines names one associate, a third none."""
    from pyspark.sql import functions as F

    from tastemill.operators import customers

    spark = eager_skew
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.when(F.col("id") % 2 == 0, -1)).otherwise(F.col("id") % 50)
    lines = spark.range(30000, numPartitions=8).select("id", key.alias("assoc1"), F.lit(-1).cast("long").alias("assoc2"), F.md5(F.col("id").cast("string")).alias("w"))
    active = spark.range(0, 50, 2).select(F.explode(F.array(F.col("id"), F.col("id") + 7)).alias("assoc_id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("assoc_id")))
    known = {r[0] for r in active.collect()} - {-1}
    found = customers.matched_by_associate(lines, active)
    assert found.count() == sum(r["assoc1"] in known for r in lines.collect())
    found.collect()
    text = plan(found)
    assert "skew=true" in text and "hashpartitioning(assoc1" in text and "_share" in text


def test_hot_customer_is_split(eager_skew):
    """A third of the lines belongs to one customer; the join with the allowed customers splits it."""
    from pyspark.sql import functions as F

    from tastemill.operators import sales

    spark = eager_skew
    lines = spark.range(30000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 3000).alias("cust_id"), F.col("id").alias("v"), F.md5(F.col("id").cast("string")).alias("w"))
    people = spark.range(3000).select(F.col("id").alias("cust_id"))
    suppression = people.select("cust_id", F.when(F.col("cust_id") % 10 == 5, "1").otherwise("0").alias("bits"))
    df = sales.reachable_customers(lines, people, suppression)
    assert df.count() == lines.where("cust_id % 10 <> 5").count()
    df.collect()
    assert "skew=true" in plan(df)


def test_tuned_lists_index_the_profile_once(spark, root, monkeypatch):
    from tastemill import session

    labels, fresh = [], session.fresh_folder
    monkeypatch.setattr(session, "fresh_folder", lambda s, label: labels.append(label) or fresh(s, label))
    all_queries()["recommend_tuned_class_contract"](spark, root)
    # ranks, profile, one range sort for each id, scores, lists
    assert sorted(labels) == ["cut", "cut", "profile", "ranges", "ranges", "ranks"]


def test_parts_grow_in_number_with_the_input(spark, tmp_path):
    from tastemill import session

    keys = [*session.TASK_BYTES, session.INITIAL_PARTITIONS]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8m")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64MB")
        (tmp_path / "large.parquet").write_bytes(bytes(10 * session.INPUT_PER_PARTITION))
        session.bound_tasks(spark, [str(tmp_path / "large.parquet"), str(tmp_path / "none.parquet")])
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8m"
        assert session.setting_bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")) == 16 << 20
        assert spark.conf.get(session.INITIAL_PARTITIONS) == "10"
        session.bound_tasks(spark, [])
        assert spark.conf.get(session.INITIAL_PARTITIONS, None) is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_counts_do_not_shuffle_the_name(data):
    level = LEVELS["designer_class"]
    rows = data.sales("cust_id", *level.columns)
    views = data.spark.createDataFrame([(1, "a", 2, "b", 3), (1, "a", 2, None, 3), (None, "a", 2, "b", 3)], "cust_id long, designer string, designer_id int, class string, class_id int")
    counts = taste.taste_counts(views, rows, level)
    exchanges = [line for line in plan(counts).splitlines() if "Exchange hashpartitioning(cust_id" in line]
    assert exchanges and not any("category" in line for line in exchanges)
    assert counts.columns == [*level.keys, "times_browse", "total_transactions"]
    only = taste.taste_counts(views, rows.where("false"), level).collect()
    assert [tuple(r) for r in only] == [(1, "a b", 2, "a", 3, "b", 1, 0)]


def test_an_event_is_parsed_once(data):
    """A parse in a filter and in a column would be two."""
    views = data.clickstream().where("product_list IS NOT NULL").select("event_id", "product_list")
    assert plan(views).count("get_json_object(") == 1


def test_what_a_part_says_is_worked_out_below_the_join(data):
    lines = data.sales("cust_id", "class_id", "class")
    above = lines._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)[0]
    assert "split" not in above and "ascii" not in above
