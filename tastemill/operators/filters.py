"""Row filters shared by the sales, click and recommendation operators."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.functions import fixed, text
from tastemill.operators.keys import without_keys

NO_CUSTOMER = "0"
UNKNOWN_KEY = "-1"


def coalesce_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null becomes 0, as after an outer join of counts."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in columns})


def sales_base_filter(sales: DataFrame, begin: dt.date, end: dt.date, chain: str | None = None,
                      departments: tuple = fixed.EXCLUDED_DEPARTMENTS,
                      divisions: tuple = fixed.FLASH_DIVISION) -> DataFrame:
    """Valid lines of known customers in a date range; plain comparisons, so they push down."""
    keep = [
        F.col("trans_date").between(F.lit(begin), F.lit(end)),
        F.col("status") != "V",
        F.col("cust_id") != F.lit(NO_CUSTOMER).cast(sales.schema["cust_id"].dataType),
    ]
    if chain is not None:
        keep.append(F.col("chain") == chain)
    if departments:
        keep.append(~F.col("department_id").isin(*departments))
    if divisions:
        keep.append(~F.col("division_id").isin(*divisions))
    return sales.where(reduce(lambda a, b: a & b, keep))


def is_suppressed(bits: Column) -> Column:
    """Whether one of the excluding positions of the bit string is set."""
    flags = [F.substring(bits, p, 1) == "1" for p in fixed.SUPPRESSION_POSITIONS]
    return reduce(lambda a, b: a | b, flags)


def suppressed_customers(suppression: DataFrame) -> DataFrame:
    return suppression.where(is_suppressed(F.col("bits"))).select("cust_id")


def suppression_filter(df: DataFrame, suppression: DataFrame) -> DataFrame:
    """Rows of customers that may be contacted."""
    return without_keys(df, suppressed_customers(suppression), ["cust_id"])


def description_exclusions(df: DataFrame, column: str = "description",
                           words: tuple = fixed.EXCLUDED_DESCRIPTION_WORDS) -> DataFrame:
    """Rows whose description holds none of the words; a null description drops too."""
    return df.where(text.free_of_words(F.col(column), words))


def merch_exclusions(df: DataFrame, divisions: tuple = fixed.EXCLUDED_DIVISION_NAMES,
                     group: str = fixed.EXCLUDED_GROUP) -> DataFrame:
    return df.where(~F.col("division_name").isin(*divisions) & (F.col("group_id") != group))


def known_products(product: DataFrame, known_brand: bool = True) -> DataFrame:
    """Products with an id and, unless switched off, a known brand."""
    keep = F.col("item_id").cast("string") != "UNKNOWN"
    if known_brand:
        keep = keep & (F.col("brand_name") != "UNKNOWN BRAND")
    return product.where(keep)


def click_quality_filter(clicks: DataFrame, begin: dt.date, end: dt.date, chain: str | None = None) -> DataFrame:
    keep = (
        F.col("email").isNotNull()
        & F.col("event_date").between(F.lit(begin), F.lit(end))
        & (F.col("exclude_hit") == 0)
        & (F.col("duplicate_purchase") == 0)
        & F.col("product_list").isNotNull()
    )
    if chain is not None:
        keep = keep & (F.col("chain") == chain)
    return clicks.where(keep)


def usable_click_filter(clicks: DataFrame) -> DataFrame:
    """Clicks that name a customer, an item, an action, a time and a division."""
    known = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != UNKNOWN_KEY)
    return clicks.where(
        known("cust_id")
        & known("web_item_id")
        & (F.col("action_type") != "Other")
        & F.col("date_time").isNotNull()
        & F.col("division_name").isNotNull()
    )


def internal_email_filter(df: DataFrame, domains: list[str], column: str = "email") -> DataFrame:
    """Rows whose e-mail mentions none of the caller's own domains."""
    return df.where(reduce(lambda a, b: a & b, [~F.col(column).contains(d) for d in domains]))


def keyword_exclusion(df: DataFrame, column: str = "brand_class",
                      patterns: tuple = fixed.EXCLUDED_BRAND_CLASS) -> DataFrame:
    return df.where(~text.matches_any(F.col(column), patterns))


def division_exclusion(df: DataFrame, division_id: int = fixed.BEAUTY_DIVISION) -> DataFrame:
    return df.where(F.col("division_id") != division_id)


def brand_exclusion_list(df: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Rows that match no line of an exclusion list; the list's columns are the key."""
    return without_keys(df, exclusions)


def purchase_line_filter(lines: DataFrame, begin: dt.date, end: dt.date,
                         prefix: str = fixed.ITEM_PREFIX) -> DataFrame:
    """Sold register lines whose keys are all known."""
    known = [F.col(c).cast("string") != UNKNOWN_KEY for c in ("product_key", "customer_key", "catalog_key")]
    return lines.where(
        (F.col("qty") > 0)
        & (F.col("tran_type") == "SALE")
        & (F.col("status") == "S")
        & F.col("item_code").startswith(prefix)
        & reduce(lambda a, b: a & b, known)
        & F.col("trans_date").between(F.lit(begin), F.lit(end))
    )


def preview(df: DataFrame, order: list[Column], n: int = 500) -> DataFrame:
    """The first n rows of the ordered output."""
    return df.orderBy(*order).limit(n)
