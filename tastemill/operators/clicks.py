"""From raw click lines to product views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions import fixed, text
from tastemill.operators import filters

CATALOG_COLUMNS = ["item_code", "item_id", "web_item_id", "description", "regular_price"]
PRODUCT_COLUMNS = ["item_id", "designer_id", "designer", "division_id", "division", "division_name",
                   "class_id", "class", "subclass", "group_id", "group_name", "department_name"]


def flatten(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row per list element; a null or empty list gives none."""
    return df.withColumn(name, F.explode(column)).drop(column)


def parse_product_list(clicks: DataFrame) -> DataFrame:
    """One row per entry of the product list, with its code, quantity and price."""
    entry = F.col("entry")
    return (
        clicks.withColumn("entry", F.explode(text.product_entries(F.col("product_list"))))
        .withColumns({
            "item_code": text.entry_field(entry, 1),
            "qty": text.entry_field(entry, 2),
            "total_price": text.entry_field(entry, 3),
        })
        .drop("entry", "product_list")
    )


def click_items(clicks: DataFrame, begin: dt.date, end: dt.date, chain: str | None = None,
                prefix: str = fixed.ITEM_PREFIX) -> DataFrame:
    """Item-level clicks other than purchases, each once.

    Only what the later joins read is kept, so copies fold on the map side.
    """
    good = filters.click_quality_filter(clicks, begin, end, chain)
    action = text.action_type(F.col("pagename"), F.col("purchase_id"))
    # The action is settled before the list is opened: fewer rows to explode.
    acted = good.withColumn("action_type", action).where(F.col("action_type") != "Purchase")
    items = parse_product_list(acted.select("date_time", "visitor_id", "action_type", "product_list"))
    return items.where(F.col("item_code").startswith(prefix)).select(
        "date_time", "visitor_id", "action_type", "item_code").distinct()


def clickstream_products(clicks: DataFrame, cookies: DataFrame, catalog: DataFrame, product: DataFrame,
                         begin: dt.date, end: dt.date, chain: str | None = None,
                         prefix: str = fixed.ITEM_PREFIX, known_brand: bool = True,
                         with_ids: bool = True) -> DataFrame:
    """Item clicks with customer and product; clicks that match nothing stay, with nulls.

    The lookup sides are made distinct before the joins, since a repeated lookup row
    would repeat the click. All joins keep the click side, so AQE may split a hot
    visitor or item.
    """
    items = click_items(clicks, begin, end, chain, prefix)
    who = cookies.where(F.col("cust_id").isNotNull()).select("visitor_id", "cust_id").distinct()
    what = catalog.select(*CATALOG_COLUMNS).distinct()
    columns = PRODUCT_COLUMNS if with_ids else [
        c for c in PRODUCT_COLUMNS if c not in ("designer_id", "division_id", "class_id")]
    sort = filters.known_products(product, known_brand).select(*columns).distinct()
    return (
        items.join(who, "visitor_id", "left")
        .join(what, "item_code", "left")
        .join(sort, "item_id", "left")
        .select("date_time", "cust_id", "web_item_id", "action_type", "description", "regular_price",
                *[c for c in columns if c != "item_id"])
        .distinct()
    )


def brand_class_browses(clicks: DataFrame, emails: DataFrame, catalog: DataFrame, suppression: DataFrame,
                        after: dt.date, chain: str | None = None) -> DataFrame:
    """Items seen per customer and day, by brand and class; one row however often seen."""
    keep = (
        F.col("email").isNotNull()
        & (F.col("event_date") > F.lit(after))
        & (F.col("exclude_hit") == 0)
        & (F.col("duplicate_purchase") == 0)
        & F.col("product_list").isNotNull()
        & F.col("purchase_id").isNull()
        & F.lower("pagename").contains("detail")
    )
    if chain is not None:
        keep = keep & (F.col("chain") == chain)
    code = text.suffix_code(text.entry_field(F.col("entry"), 1))
    seen = (
        clicks.where(keep)
        .select("email", "event_date", F.explode(text.product_entries(F.col("product_list"))).alias("entry"))
        .select("email", "event_date", code.alias("item_suffix"))
        .distinct()
    )
    sort = catalog.select("item_suffix", "brand", "class").distinct()
    views = (
        seen.join(sort, "item_suffix")
        .join(emails.select("cust_id", "email"), "email")
        .select("cust_id", "item_suffix", "event_date", "brand", "class")
        .distinct()
    )
    return filters.suppression_filter(views, suppression)


def brand_class_counts(views: DataFrame, name: str, sep: str = "_") -> DataFrame:
    """Rows per customer and brand-class."""
    labelled = views.select("cust_id", text.brand_class(F.col("brand"), F.col("class"), sep).alias("brand_class"))
    return labelled.dropna().groupBy("cust_id", "brand_class").agg(F.count("*").alias(name))


def events_by_item_action(views: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent customer, item and action combinations."""
    keys = ["cust_id", "web_item_id", "action_type"]
    return (
        views.groupBy(*keys)
        .agg(F.count("action_type").alias("n_events"))
        .orderBy(F.col("n_events").desc(), *[F.col(k).asc_nulls_last() for k in keys])
        .limit(n)
    )
