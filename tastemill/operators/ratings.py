"""Ratings from actions: views, carts and purchases, newest first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions import fixed, scoring
from tastemill.operators import filters
from tastemill.operators.keys import hot_keys, key_counts, number_within
from tastemill.session import cut

GROUP = ["cust_id", "action_type"]
EVENT = ["cust_id", "web_item_id", "date_time", "action_type", "regular_price"]


def usable_clicks(views: DataFrame, divisions: tuple = fixed.EXCLUDED_DIVISION_NAMES,
                  group: str = fixed.EXCLUDED_GROUP) -> DataFrame:
    """Click events fit for ratings, each once."""
    kept = filters.usable_click_filter(views)
    kept = filters.merch_exclusions(filters.description_exclusions(kept), divisions, group)
    return kept.select(*EVENT).distinct()


def union_actions(purchases: DataFrame, clicks: DataFrame) -> DataFrame:
    """Distinct purchases followed by the clicks as they are."""
    bought = purchases.distinct().withColumn("action_type", F.lit("Purchase"))
    return bought.select(*EVENT).unionByName(clicks.select(*EVENT))


def _support(events: DataFrame, key: str, low: int, high: int, closed: bool) -> tuple[DataFrame, DataFrame]:
    """Keys with enough but not too many events, and the hot ones among the rest."""
    counts = cut(key_counts(events, [key]), "support")
    n = F.col("n")
    good = counts.where((n > low) & ((n <= high) if closed else (n < high))).select(key)
    # only keys above their bound: these fail whatever the rest of the rule says
    hot = hot_keys(counts, [key, "n"]).where(F.col("n") > high).select(key)
    return good, hot


def frequency_support_filter(events: DataFrame, customers: tuple[int, int], items: tuple[int, int]) -> DataFrame:
    """Keep events of customers and items with enough, but not too many, events.

    Both counts are taken on all events. Customers may reach their upper bound,
    items must stay below theirs. A hot key lies above its bound and fails anyway; there
    are few of them, so they leave by a broadcast and never crowd a shuffle task.
    """
    supports = {
        "cust_id": _support(events, "cust_id", *customers, closed=True),
        "web_item_id": _support(events, "web_item_id", *items, closed=False),
    }
    for key, (_, hot) in supports.items():
        events = events.join(F.broadcast(hot), key, "left_anti")
    for key, (good, _) in supports.items():
        events = events.join(good, key, "left_semi")
    return events


def action_mix(events: DataFrame) -> DataFrame:
    """Count and share in percent per action."""
    counts = events.groupBy("action_type").agg(F.count("action_type").alias("action_count"))
    total = counts.agg(F.sum("action_count")).scalar()
    return counts.withColumn("percent_dist", F.col("action_count") / total * 100)


def action_bands(mix: DataFrame) -> DataFrame:
    """Low and high end of the rating band per action, in percent.

    The bands stack: page views from 0, carts on top of them, purchases on top of
    both, each as wide as the action's share of all events. One row per action.
    """
    place = F.when(F.col("action_type") == "Product_Page", 0).when(F.col("action_type") == "Cart_Add", 1).otherwise(2)
    stacked = Window.orderBy(place)
    high = F.sum("percent_dist").over(stacked)
    low = F.coalesce(F.sum("percent_dist").over(stacked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return mix.select("action_type", low.alias("low"), high.alias("high"))


def recency_position(events: DataFrame, bounded: bool = False) -> DataFrame:
    """Position by day, newest first, within customer and action, and the group's size.

    ``bounded=True`` says that groups are known to be small (the support filter bounds
    them), and one window does. Otherwise a global sort numbers them, so a group, even one
    day of it, may be larger than any task.
    """
    if bounded:
        newest = Window.partitionBy(*GROUP).orderBy(F.col("day").desc(), "web_item_id")
        placed = events.withColumns({
            "number_of_events": F.row_number().over(newest) - 1,
            "sum_of_events": F.count("*").over(Window.partitionBy(*GROUP)).cast("int"),
        })
    else:
        newest_first = [F.col("day").desc(), F.col("web_item_id")]
        placed = number_within(events, GROUP, newest_first, "number_of_events", "sum_of_events")
        placed = placed.withColumns({c: F.col(c).cast("int") for c in ("number_of_events", "sum_of_events")})
    share = scoring.recency_share(F.col("number_of_events"), F.col("sum_of_events"))
    return placed.select(*GROUP, "web_item_id", "day", "number_of_events", "sum_of_events", share.alias("pu"))


def training_events(supported: DataFrame, begin: dt.date, end: dt.date) -> DataFrame:
    """Distinct customer, action, item and day within the training window."""
    day = F.to_date("date_time")
    return supported.where(day.between(F.lit(begin), F.lit(end))).select(*GROUP, "web_item_id", day.alias("day")).distinct()


def action_ratings(purchases: DataFrame, views: DataFrame, customers: tuple[int, int], items: tuple[int, int],
                   begin: dt.date, end: dt.date, divisions: tuple = fixed.EXCLUDED_DIVISION_NAMES) -> DataFrame:
    """Rating of every event: newer is higher, and purchases rate above carts above views.

    Events are cut once, since both supports count them, and the supported events
    once, since the mix and the training rows read them.
    """
    events = cut(union_actions(purchases, usable_clicks(views, divisions)), "actions")
    supported = cut(frequency_support_filter(events, customers, items), "supported")
    return rate_events(supported, training_events(supported, begin, end))


def rate_events(supported: DataFrame, training: DataFrame) -> DataFrame:
    """Ratings of training events from the action mix of the supported events."""
    bands = F.broadcast(action_bands(action_mix(supported)))
    placed = recency_position(training, bounded=True).join(bands, "action_type")
    rating = scoring.action_rating(F.col("low"), F.col("high"), F.col("pu"))
    return placed.withColumn("rating", rating).drop("low", "high")


def holdout_pairs(supported: DataFrame, begin: dt.date, end: dt.date) -> DataFrame:
    """Customer and item pairs of the test window, each once."""
    day = F.to_date("date_time")
    return supported.where(day.between(F.lit(begin), F.lit(end))).select("cust_id", "web_item_id").distinct()


def collect_lists(events: DataFrame, chunk: int = 1000) -> DataFrame:
    """Item and day lists per customer and action, newest day first.

    A list holds up to ``chunk`` entries and longer histories go on in the next row,
    so no list grows with the data and none is cut short.
    """
    placed = recency_position(events).withColumn("chunk", F.floor(F.col("number_of_events") / chunk).cast("int"))
    entry = F.struct("number_of_events", "web_item_id", "day")
    lists = placed.groupBy(*GROUP, "chunk").agg(F.sort_array(F.collect_list(entry)).alias("_list"))
    field = lambda n: F.transform("_list", lambda e: e[n])
    return lists.select(*GROUP, "chunk", field("web_item_id").alias("items"), field("day").alias("days"))


def explode_aligned(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Open parallel lists side by side; a row whose lists are empty stays, with nulls."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.explode_outer(zipped).alias("_e")).select(
        *rest, *[F.col("_e").getField(n).alias(n) for n in columns.values()])
