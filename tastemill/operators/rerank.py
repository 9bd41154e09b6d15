"""Re-ranking after recent purchases, and the published window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.levels import Level
from tastemill.operators.keys import without_keys


def _best_first(*ties: str) -> Window:
    return Window.partitionBy("cust_id").orderBy(F.col("propensity_score").desc(), *ties)


def unseen(recs: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """Recommendations the customer did not buy recently, matched on real columns."""
    return without_keys(recs, recent, keys)


def next_best_rank(recs: DataFrame) -> DataFrame:
    """1, 2, 3 ... per customer by score; ties keep their first rank's order."""
    return recs.withColumn("next_best_rank", F.row_number().over(_best_first("propensity_rank")))


def next_best_rank_top_k(recs: DataFrame, k: int = 5) -> DataFrame:
    """Rank by score up to k; equal scores share a rank."""
    return recs.withColumn("next_best_rank", F.rank().over(_best_first())).where(F.col("next_best_rank") <= k)


def attach_rank(recs: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """The full list with the new rank where there is one."""
    return recs.join(ranked.select(*keys, "next_best_rank"), keys, "left")


def rerank_unseen(recs: DataFrame, recent: DataFrame, level: Level) -> DataFrame:
    """Recommendations with ``next_best_rank``: null for what was bought recently.

    One join and one window: bought rows are flagged and numbered apart from the
    others, so the list is neither filtered nor joined to itself again.
    """
    keys = ["cust_id", *level.columns]
    bought = recent.select(*keys).distinct().withColumn("_bought", F.lit(True))
    flagged = recs.join(bought, keys, "left")
    apart = Window.partitionBy("cust_id", F.col("_bought").isNull()).orderBy(
        F.col("propensity_score").desc(), "propensity_rank")
    rank = F.when(F.col("_bought").isNull(), F.row_number().over(apart))
    return flagged.withColumn("next_best_rank", rank).select(
        *level.keys, "propensity_score", "propensity_rank", "next_best_rank")


def order_recs(recs: DataFrame, by_rank: bool = False) -> DataFrame:
    """The reader's order: by customer and score, or by customer and rank."""
    order = ["propensity_rank"] if by_rank else [F.col("propensity_score").desc(), "next_best_rank"]
    return recs.orderBy("cust_id", *order)


def null_rank_count(recs: DataFrame) -> DataFrame:
    """Recommendations per customer that were bought recently."""
    return recs.groupBy("cust_id").agg(F.count_if(F.col("next_best_rank").isNull()).alias("null_count"))


def publish_window(recs: DataFrame, n: int = 10, extra: int = 5) -> DataFrame:
    """The first n ranks, or n + extra for a customer who bought n of the list.

    The window holds one customer's recommendations, at most the 15 computed.
    """
    bought = F.count_if(F.col("next_best_rank").isNull()).over(Window.partitionBy("cust_id"))
    limit = F.when(bought < n, n).otherwise(n + extra)
    return recs.withColumn("_limit", limit).where(F.col("propensity_rank") <= F.col("_limit")).drop("_limit")


def audit_columns(df: DataFrame, stamp: dt.datetime | Column) -> DataFrame:
    """Creation and update time of a published row."""
    at = stamp if isinstance(stamp, Column) else F.lit(stamp)
    return df.withColumns({"record_creation_datetime": at, "record_updated_datetime": at})


def publish(recs: DataFrame, stamp: dt.datetime | Column, n: int = 10, extra: int = 5) -> DataFrame:
    """Published rows of one level; sorting is left to the sink."""
    return audit_columns(publish_window(recs, n, extra), stamp)
