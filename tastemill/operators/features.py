"""Customer time features: shopping gaps, recency and frequency, product lines.

Every window over a customer runs on one row per day, so its size is bounded by
the days in the date range, however many lines a customer has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions import dates, text
from tastemill.operators.filters import suppressed_customers
from tastemill.operators.keys import without_keys
from tastemill.operators.sales import MONEY, known_customers, line_amount


def _customer() -> Window:
    return Window.partitionBy("cust_id")


def _gap_columns(as_of: dt.date) -> dict[str, Column]:
    """First and last day of a customer and the distances between them."""
    first, last = F.min("trans_date").over(_customer()), F.max("trans_date").over(_customer())
    return {
        "last_shopd_day": last,
        "days_since_last_shopd": F.datediff(F.lit(as_of), last),
        "first_shopd_day": first,
        "days_betn_first_shopd_and_last_shopd": F.datediff(last, first),
    }


def inter_shopping_days(sales: DataFrame, customers: DataFrame, suppression: DataFrame,
                        as_of: dt.date, recent_days: int) -> DataFrame:
    """Gap to the previous shopping day, trip number, spend and span per customer and day."""
    day = known_customers(
        sales.groupBy("cust_id", "trans_date").agg(
            F.sum(line_amount().cast(MONEY)).cast("double").alias("spent_in_this_shopd_day")),
        customers,
    )
    by_date = _customer().orderBy("trans_date")
    trips = day.withColumns({
        "inter_shopping_days": F.datediff(F.col("trans_date"), F.lag("trans_date").over(by_date)),
        "trip_number": F.count("trans_date").over(by_date),
        **_gap_columns(as_of),
    })
    recent = trips.where(F.col("days_since_last_shopd") < recent_days)
    return without_keys(recent, suppressed_customers(suppression)).select(
        "cust_id", "trans_date", "inter_shopping_days", "trip_number", "spent_in_this_shopd_day", "last_shopd_day",
        "days_since_last_shopd", "first_shopd_day", "days_betn_first_shopd_and_last_shopd")


def inter_shopping_days_by_location(sales: DataFrame, customers: DataFrame, suppression: DataFrame,
                                    location: DataFrame, as_of: dt.date, recent_days: int) -> DataFrame:
    """The same with one row per location and day.

    Rows of one day are peers: all of them carry the trip number of the day, and only
    the day's first location (by name) sees the gap to the day before. So the windows
    need just one row per day, which is joined back to the locations.
    """
    place = known_customers(
        sales.join(location.select("location_id", "location_name"), "location_id")
        .groupBy("cust_id", "trans_date", "location_name")
        .agg(F.sum(line_amount().cast(MONEY)).cast("double").alias("spent_in_this_shopd_day")),
        customers,
    )
    day = place.groupBy("cust_id", "trans_date").agg(
        F.count("*").alias("_places"), F.min("location_name").alias("_first_place"))
    by_date = _customer().orderBy("trans_date")
    day = day.withColumns({
        "_gap": F.datediff(F.col("trans_date"), F.lag("trans_date").over(by_date)),
        "trip_number": F.sum("_places").over(by_date),
        **_gap_columns(as_of),
    }).where(F.col("days_since_last_shopd") < recent_days)
    day = without_keys(day, suppressed_customers(suppression))
    gap = F.when(F.col("location_name") == F.col("_first_place"), F.col("_gap")).otherwise(0)
    return place.join(day, ["cust_id", "trans_date"]).select(
        "cust_id", "trans_date", gap.alias("inter_shopping_days"), "trip_number",
        text.location_bucket(F.col("location_name")).alias("location_name"), "spent_in_this_shopd_day",
        "last_shopd_day", "days_since_last_shopd", "first_shopd_day", "days_betn_first_shopd_and_last_shopd")


def rfm(daily: DataFrame, as_of: dt.date, amount: str = "total_spent") -> DataFrame:
    """Recency, frequency and money per customer from a daily spend table."""
    first, last = F.min("trans_date"), F.max("trans_date")
    exact = F.sum(F.col(amount).cast(MONEY)).cast("double")
    return daily.groupBy("cust_id").agg(
        (F.count_distinct("trans_date") - 1).alias("frequency"),
        F.datediff(last, first).alias("days_betn_first_shopd_and_last_shopd"),
        (exact / F.count(amount)).alias("avg_monetary_value"),
        exact.alias("now_lifetime_spent"),
        F.datediff(F.lit(as_of), first).alias("days_betn_first_shopd_and_today"),
        F.datediff(F.lit(as_of), last).alias("days_since_last_shopd"),
        first.alias("first_shopd_day"),
        last.alias("last_shopd_day"),
    )


def rfm_from_trips(trips: DataFrame, as_of: dt.date) -> DataFrame:
    """The same from the shopping gap table."""
    return rfm(trips, as_of, amount="spent_in_this_shopd_day")


def time_features(customer_days: DataFrame, as_of: dt.date) -> DataFrame:
    """Calendar parts, gaps and span per customer and distinct day."""
    days = customer_days.select("cust_id", "trans_date").distinct()
    day, first, last = F.col("trans_date"), F.min("trans_date").over(_customer()), F.max("trans_date").over(_customer())
    before = F.lag("trans_date").over(_customer().orderBy("trans_date"))
    return days.select(
        "cust_id",
        "trans_date",
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        dates.iso_week(day).alias("week"),
        dates.weekday_mon0(day).alias("day"),
        F.count("*").over(_customer()).alias("frequency"),
        F.coalesce(F.datediff(day, before), F.lit(0)).alias("interarrival_days"),
        F.datediff(F.lit(as_of), last).alias("recency"),
        F.datediff(last, first).alias("active_duration"),
        last.alias("max_purchase_date"),
        first.alias("min_purchase_date"),
    )


def days_since_last_purchase(sales: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per customer with the last day and its distance; a plain aggregate."""
    last = sales.groupBy("cust_id").agg(F.max("trans_date").alias("trans_date"))
    return last.withColumn("days_since_lpurchase", F.datediff(F.lit(as_of), F.col("trans_date")))


def recent_product_lines(trips: DataFrame, sales: DataFrame, product: DataFrame) -> DataFrame:
    """Lines of the customers in the gap table with day features and cleaned attributes. The retail
    price comes from the product where the lines have none."""
    columns = ["cust_id", "trans_date", "item_id", "unit_price", "qty", "unit_discount", "unit_retail"]
    held = [c for c in columns if c in sales.columns]
    attributes = product.select(
        "item_id", "initial_cost", "initial_retail", *[c for c in columns if c not in held],
        text.division_short_name(F.col("division_name")).alias("division_name"),
        "department_name", "group_name", "class_name",
        text.brand_clean(F.col("brand_name")).alias("brand_name"),
        text.gender_code(F.col("gender")).alias("gender"),
        text.color_clean(F.col("color")).alias("color"),
        text.size_clean(F.col("size")).alias("size"),
    )
    day = trips.select("cust_id", "trans_date", "inter_shopping_days", "trip_number", "first_shopd_day",
                       "last_shopd_day", "days_since_last_shopd", "days_betn_first_shopd_and_last_shopd")
    lines = sales.where("status <> 'V'").select(*held)
    return lines.join(day, ["cust_id", "trans_date"]).join(attributes, "item_id").distinct()


def cohort_lines(lines: DataFrame, cohort: DataFrame) -> DataFrame:
    """Lines on the customer days of a cohort, ordered for the reader."""
    days = cohort.select("cust_id", "trans_date")
    return lines.join(days, ["cust_id", "trans_date"], "left_semi").distinct().orderBy("cust_id", "trans_date")
