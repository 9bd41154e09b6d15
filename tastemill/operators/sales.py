"""Sales figures per customer, channel, location and day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions import fixed, scoring, text
from tastemill.operators import filters
from tastemill.operators.keys import detached, first_per_key, with_keys, without_keys

MONEY = "decimal(18,2)"


def line_amount() -> Column:
    return F.col("unit_price") * F.col("qty")


def money_sum(amount: Column) -> Column:
    """Exact sum in cents, handed on as double."""
    return F.sum(amount.cast(MONEY)).cast("double")


def with_product(lines: DataFrame, product: DataFrame, columns: list[str]) -> DataFrame:
    """Lines next to attributes of their product. Attributes that the lines carry already are
    kept, and without others the product table is not joined."""
    missing = [c for c in columns if c not in lines.columns]
    return lines.join(product.select("item_id", *missing), "item_id") if missing else lines


def known_customers(df: DataFrame, customers: DataFrame) -> DataFrame:
    """Rows of customers that exist; no customer column is needed, so a semi join."""
    return with_keys(df, customers, ["cust_id"])


def reachable_customers(df: DataFrame, customers: DataFrame, suppression: DataFrame) -> DataFrame:
    """Rows of existing customers that may be contacted: one join instead of two."""
    allowed = without_keys(customers.select("cust_id"), filters.suppressed_customers(suppression))
    return with_keys(df, detached(allowed), ["cust_id"])


def enrich_lines(sales: DataFrame, customers: DataFrame, product: DataFrame, location: DataFrame) -> DataFrame:
    """Lines with product and location names; lines without a match drop."""
    names = product.select("item_id", "department_name", "class_name")
    places = location.select("location_id", "location_name")
    return known_customers(sales.join(names, "item_id").join(places, "location_id"), customers)


def transaction_spend(sales: DataFrame, customers: DataFrame, suppression: DataFrame, product: DataFrame,
                      location: DataFrame, dedupe: bool = True) -> DataFrame:
    """Spend per customer, day, product, place, associates, channel and transaction.

    Lines that look alike count once, which defines the figures; ``dedupe=False``
    counts them all. Lines are folded before they meet the customer tables.
    """
    keys = ["cust_id", "trans_date", "brand_name", "class_name", "item_id", "location_id", "department_id",
            "department_name", "division_id", "assoc1", "assoc2", "channel", "tran_no"]
    lines = (
        with_product(sales, product, ["department_name", "class_name"])
        .join(location.select("location_id"), "location_id", "left_semi")
        .withColumn("brand_name", F.col("designer"))
        .select(*keys, line_amount().alias("amount"))
    )
    lines = lines.distinct() if dedupe else lines
    spent = lines.groupBy(*keys).agg(money_sum(F.col("amount")).alias("total_spent"))
    label = text.brand_class(F.col("brand_name"), F.col("class_name"), " ")
    return reachable_customers(spent, customers, suppression).withColumn("brand_class", label)


def daily_channel_revenue(sales: DataFrame, customers: DataFrame, channels: list[str]) -> DataFrame:
    """Revenue per day in millions, one column per channel and their total.

    The channel list is given, so the pivot needs no extra pass over the data.
    """
    lines = sales.select("cust_id", "trans_date", "channel", line_amount().alias("amount")).distinct()
    by_day = (
        known_customers(lines, customers)
        .groupBy("trans_date")
        .pivot("channel", channels)
        .agg(F.sum(F.col("amount").cast(MONEY)))
    )
    parts = {c.lower(): scoring.scale_millions(F.col(c).cast("double")) for c in channels}
    zero = F.lit(0).cast(MONEY)
    total = sum((F.coalesce(F.col(c), zero) for c in channels[1:]), F.coalesce(F.col(channels[0]), zero))
    return by_day.select(
        "trans_date",
        *[col.alias(name) for name, col in parts.items()],
        scoring.scale_millions(total.cast("double")).alias("total"),
    )


def daily_customer_spend(sales: DataFrame, customers: DataFrame, suppression: DataFrame, whole: bool = True) -> DataFrame:
    """Money spent per customer and day; equal amounts of a transaction count once.

    ``whole`` cuts the exact sums to whole units, as the published table shows them;
    figures computed further take the exact ones.
    """
    lines = sales.select("cust_id", "trans_date", "tran_no", line_amount().alias("amount")).distinct()
    daily = lines.groupBy("cust_id", "trans_date").agg(F.sum(F.col("amount").cast(MONEY)).alias("spent"))
    kept = daily.where(F.col("trans_date").isNotNull() & F.col("spent").isNotNull())
    return reachable_customers(kept, customers, suppression).select(
        "cust_id", "trans_date", F.col("spent").cast("bigint" if whole else MONEY).alias("total_spent"))


def trips(sales: DataFrame, customers: DataFrame, suppression: DataFrame, location: DataFrame,
          by: list[str], channel: str | None = None) -> DataFrame:
    """Distinct shopping days per customer and the columns in ``by``.

    Covers store trips, trips by channel and store, and trips by channel and division.
    """
    lines = sales if channel is None else sales.where(F.col("channel") == channel)
    places = location.select("location_id", F.col("location_name").alias("store_name"))
    days = lines.join(places, "location_id").groupBy("cust_id", *by).agg(
        F.count_distinct("trans_date").alias("number_of_visits"))
    return reachable_customers(days, customers, suppression)


def daily_revenue(lines: DataFrame, customers: DataFrame, location: DataFrame,
                  areas: tuple = fixed.REVENUE_AREAS, regions: tuple = fixed.REVENUE_REGIONS,
                  districts: tuple = fixed.REVENUE_DISTRICTS, *, begin: dt.date, end: dt.date,
                  departments: tuple = fixed.EXCLUDED_DEPARTMENTS) -> DataFrame:
    """Revenue per day in millions over the locations that fit one of three rules.

    ``lines`` are register lines; their customer key leads to the customer. Voided lines and
    the unwanted departments stay out, no chain or division does.
    """
    counted = location.where(
        F.col("area_id").isin(*areas) | F.col("region_id").isin(*regions) | F.col("district_id").isin(*districts)
    ).select("location_id")
    valid = lines.where(
        F.col("trans_date").between(F.lit(begin), F.lit(end)) & (F.col("status") != "V") & ~F.col("department_id").isin(*departments))
    people = customers.where(F.col("cust_id").cast("string") != filters.NO_CUSTOMER).select("customer_key", "cust_id")
    amounts = (
        valid.join(counted, "location_id", "left_semi")
        .select("trans_date", "customer_key", line_amount().alias("amount"))
        .distinct()
    )
    return (
        amounts.join(people, "customer_key")
        .select("trans_date", "cust_id", "amount")
        .distinct()
        .groupBy("trans_date")
        .agg(scoring.scale_millions(money_sum(F.col("amount"))).alias("revenue"))
    )


def customer_history(sales: DataFrame, customers: DataFrame, product: DataFrame, location: DataFrame, cust_id, after: dt.date) -> DataFrame:
    """Valid lines of one existing customer after a day, in date order."""
    lines = sales.where((F.col("cust_id") == cust_id) & (F.col("status") != "V") & (F.col("trans_date") > F.lit(after)))
    attributes = product.select("item_id", "division_name", "department_name", "group_name", "class_name", "brand_name", "gender", "color", "size")
    return (
        known_customers(lines, customers.where(F.col("cust_id") == cust_id))
        .join(attributes, "item_id")
        .join(location.select("location_id", "location_name"), "location_id")
        .select("cust_id", "trans_date", "tran_no", "location_name", "item_id", "unit_price", "qty", "unit_discount", "unit_retail",
                "assoc1", "assoc2", "division_name", "department_name", "group_name", "class_name", "brand_name", "gender", "color", "size")
        .distinct()
        .orderBy("trans_date", "tran_no", "item_id")
    )


def web_sales_items(lines: DataFrame, customers: DataFrame, product: DataFrame, catalog: DataFrame,
                    begin: dt.date, end: dt.date, prefix: str = fixed.ITEM_PREFIX,
                    divisions: tuple = fixed.EXCLUDED_DIVISION_NAMES) -> DataFrame:
    """Sold web items with their attributes, unwanted merchandise left out."""
    sold = filters.purchase_line_filter(lines, begin, end, prefix)
    goods = (
        filters.merch_exclusions(filters.known_products(product, known_brand=False), divisions)
        .select("product_key", "division_name", "group_id", "group_name", "class_name", "subclass", "department_name", "designer")
        .distinct()
    )
    items = (
        filters.description_exclusions(catalog)
        .select("catalog_key", "web_item_id", "web_item_name", "description", "regular_price", "sale_price")
        .distinct()
    )
    people = customers.where(F.col("cust_id").cast("string") != filters.UNKNOWN_KEY).select("customer_key", "cust_id")
    return (
        sold.select("customer_key", "product_key", "catalog_key", "tran_time")
        .distinct()
        .join(people, "customer_key")
        .join(goods, "product_key")
        .join(items, "catalog_key")
        .select("cust_id", "tran_time", "web_item_id", "web_item_name", "division_name", "group_id", "group_name", "class_name",
                "subclass", "department_name", "designer", "description", "regular_price", "sale_price")
        .distinct()
    )


def web_sales_thin(items: DataFrame) -> DataFrame:
    """The purchase columns the ratings need."""
    return items.select("cust_id", "web_item_id", F.col("tran_time").alias("date_time"), "regular_price").distinct()


def brand_class_purchases(sales: DataFrame, customers: DataFrame, suppression: DataFrame, product: DataFrame) -> DataFrame:
    """Products bought per customer and day; one row however many pieces."""
    days = sales.select("cust_id", "item_id", F.col("trans_date").alias("event_date")).distinct()
    named = days.join(product.select("item_id", F.col("brand_name").alias("brand"), F.col("class_name").alias("class")), "item_id")
    return reachable_customers(named, customers, suppression).select("cust_id", "item_id", "event_date", "brand", "class")


def item_price_catalog(sales: DataFrame, recent_lines: DataFrame, product: DataFrame) -> DataFrame:
    """Distinct price points and attributes of the items sold recently. The retail price comes from
    the product where the lines have none."""
    prices = ["item_id", "unit_price", "unit_discount", "unit_retail"]
    attributes = ["brand_name", "class_name", "initial_cost", "initial_retail", "tax_category_id", "gender",
                  "color", "size", "department_name", "division_name", "group_name"]
    points = sales.select(*[c for c in prices if c in sales.columns]).distinct()
    recent = recent_lines.select("item_id").distinct()
    named = with_product(points.join(recent, "item_id", "left_semi"), product, [*prices, *attributes])
    return named.select(*prices, *attributes).distinct()


def latest_fiscal_month(summary: DataFrame, after: int, chain: str) -> DataFrame:
    return summary.where((F.col("chain") == chain) & (F.col("fiscal_month_end") > after)).agg(F.max("fiscal_month_end").alias("latest_year_month"))


def rolling_ty_ly(summary: DataFrame, after: int, chain: str) -> DataFrame:
    """Rolling amount and segment of a chain's latest month next to the same month a year before.

    The latest month is a scalar subquery, so nothing comes back to the driver.
    Both months are narrowed to one row per customer before they meet.
    """
    latest = latest_fiscal_month(summary, after, chain).scalar()
    month, own = F.col("fiscal_month_end"), summary.where(F.col("chain") == chain)

    def one(df: DataFrame, prefix: str) -> DataFrame:
        best = first_per_key(df, ["cust_id"], [F.col("rolling_amt").desc(), F.col("segment").asc()])
        return best.select("cust_id", F.col("rolling_amt").alias(f"{prefix}_rolling_amt"),
                           F.col("segment").alias(f"{prefix}_cgroup"))

    this_year = one(own.where(month == latest), "ty")
    last_year = one(own.where(month == latest - 100), "ly")
    joined = this_year.join(last_year, "cust_id", "left")
    return filters.coalesce_counts(joined, ["ty_rolling_amt", "ty_cgroup", "ly_rolling_amt", "ly_cgroup"])


def return_lines(lines: DataFrame) -> DataFrame:
    """Returned lines with the original sale read from their reference text."""
    parts = text.return_reference(F.col("reference"))
    return (
        lines.where(F.col("status") == "R")
        .withColumns(parts)
        .withColumn("total_ret_amount", line_amount())
        # Stores 500 to 1499: the store number in thousands rounds to one.
        .where((F.round(F.col("sale_store") / 1000) == 1) & (F.col("sale_tran_no") != 0))
        .select("return_location", "return_date", "sale_store", "sale_register", "sale_tran_no", "sale_date",
                "total_ret_amount")
    )
