"""Stock per location and brand-class, and recommendations that are out of stock."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions import fixed
from tastemill.functions.text import brand_class
from tastemill.operators.keys import detached, first_per_key, without_keys


def _label(sep: str):
    return brand_class(F.col("brand_name"), F.col("class_name"), sep).alias("brand_class")


def store_inventory(stock: DataFrame, product: DataFrame, selling_group: str, sep: str = "_",
                    dedupe: bool = True) -> DataFrame:
    """Stock per location and brand-class of unblocked items; equal quantities count once."""
    open_items = stock.where((F.col("selling_group") == selling_group) & (F.col("block_flag") == "FALSE"))
    rows = open_items.join(product.select("item_id", "brand_name", "class_name"), "item_id").select(
        "qty", "location_id", _label(sep))
    rows = rows.distinct() if dedupe else rows
    return rows.groupBy("location_id", "brand_class").agg(F.sum("qty").alias("brand_class_qty"))


def online_inventory(stock: DataFrame, product: DataFrame, retailer: str, sep: str = "_",
                     dedupe: bool = True) -> DataFrame:
    """Web stock per brand-class of one retailer."""
    rows = stock.where(F.col("retailer") == retailer).join(
        product.select("item_id", "brand_name", "class_name"), "item_id").select("qty", _label(sep))
    rows = rows.distinct() if dedupe else rows
    return rows.groupBy("brand_class").agg(F.sum("qty").alias("online_brand_class_qty"))


def merged_inventory(stores: DataFrame, online: DataFrame,
                     web_location: int = fixed.WEB_STOCK_LOCATION) -> DataFrame:
    """Web stock added to every location's; web-only stock goes to a location of its own."""
    both = stores.join(online, "brand_class", "full_outer").withColumns({
        "brand_class_qty": F.coalesce("brand_class_qty", F.lit(0)) + F.coalesce("online_brand_class_qty", F.lit(0)),
        "location_id": F.coalesce("location_id", F.lit(web_location)).cast("bigint"),
    })
    one = first_per_key(both, ["location_id", "brand_class"], [F.col("brand_class_qty").desc()])
    return one.select("location_id", "brand_class", "brand_class_qty")


def low_stock_items(inventory: DataFrame, location: DataFrame, n: int = 10) -> DataFrame:
    """Locations and brand-classes with fewer than n pieces."""
    low = inventory.where(F.col("brand_class_qty") < n)
    places = location.where(F.col("location_id").isNotNull()).select(
        F.col("location_id"), F.col("location_no").cast("bigint").alias("location_no"))
    return low.join(places, "location_id").select("location_no", "brand_class").distinct()


def drop_low_stock(wishes: DataFrame, low: DataFrame, keys: list[str]) -> DataFrame:
    """Customers' brand-classes that are in stock, each once."""
    return without_keys(wishes, detached(low.select(*keys)), keys).select("cust_id", "brand_class").distinct()
