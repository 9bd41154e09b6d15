"""Customer, associate and loyalty queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions import dates, fixed, text
from tastemill.operators.keys import detached, first_per_key, with_keys, without_keys
from tastemill.operators.sales import known_customers

# Shares into which lines without an associate are dealt.
UNSERVED_SHARES = 4096


# --- exclusions -----------------------------------------------------------------

def vip_exclusion(df: DataFrame, sources: DataFrame, source: str = fixed.VIP_SOURCE) -> DataFrame:
    """Rows of customers that a given source does not list."""
    return without_keys(df, sources.where(F.col("source") == source), ["cust_id"])


def digital_only_customers(sales: DataFrame, customers: DataFrame, begin: dt.date, end: dt.date, chain: str) -> DataFrame:
    """Customers none of whose valid lines at a chain in a date range names an associate; one pass over the lines."""
    named = F.max(F.when(F.col("assoc1") != -1, 1).otherwise(0))
    ranged = F.col("trans_date").between(F.lit(begin), F.lit(end)) & (F.col("chain") == chain)
    lines = sales.where(ranged).where("status <> 'V' AND assoc1 IS NOT NULL AND cust_id <> 0")
    only = lines.groupBy("cust_id").agg(named.alias("_named")).where("_named = 0").select("cust_id")
    return known_customers(only, customers)


def matched_by_associate(lines: DataFrame, active: DataFrame) -> DataFrame:
    """Lines whose first or second associate is active, each once.

    The lines run once: each meets the distinct associates by its first and by its second key,
    in joins on equal keys rather than one on an OR, which would compare every line with every
    associate. Lines without an associate, marked -1 or null, match nothing and are spread over
    all tasks of a join; those of a busy associate come from an exchange on both sides, so AQE
    may split them.
    """
    return _marked_by_associate(lines, active).select(*lines.columns).distinct()


def _marked_by_associate(lines: DataFrame, active: DataFrame) -> DataFrame:
    known = active.where("assoc_id <> -1").select("assoc_id").distinct()
    marked = lines
    for key, mark in (("assoc1", "_first"), ("assoc2", "_second")):
        spread = F.pmod(F.xxhash64(*lines.columns), F.lit(UNSERVED_SHARES)) + 1
        listed = detached(known.select(F.col("assoc_id").alias(key), F.lit(0).cast("bigint").alias("_share"), F.lit(True).alias(mark)))
        marked = marked.withColumn("_share", F.when(F.col(key) != -1, 0).otherwise(spread)).join(listed, [key, "_share"], "left").drop("_share")
    return marked.where("_first OR _second")


def keep_active_associates(lines: DataFrame, active: DataFrame) -> DataFrame:
    """The same lines with both associate keys filled in; -1 where there is none."""
    matched = _marked_by_associate(lines, active)
    filled = matched.withColumns({c: F.coalesce(c, F.lit(-1)).cast("bigint") for c in ("assoc1", "assoc2")})
    return filled.select(*lines.columns).distinct()


def clienteling_transactions(lines: DataFrame, sources: DataFrame, digital: DataFrame, active: DataFrame) -> DataFrame:
    """Spend lines of ordinary customers who are served by an active associate."""
    served = without_keys(vip_exclusion(lines, sources), detached(digital), ["cust_id"])
    return keep_active_associates(served, active)


# --- channels and stores ----------------------------------------------------------

def channel_count(visits: DataFrame) -> DataFrame:
    """Visits with the number of distinct channels of their customer.

    A customer has at most one row per channel and store, so one window holds them and the
    visits are worked out once.
    """
    seen = F.collect_set("channel").over(Window.partitionBy("cust_id"))
    return visits.withColumn("channel_count", F.size(seen).cast("bigint"))


def customer_channel_status(visits: DataFrame) -> DataFrame:
    return channel_count(visits).withColumn("omni_status", text.omni_status(F.col("channel_count"), F.col("channel")))


def favorite_store(visits: DataFrame, legacy_order: bool = False) -> DataFrame:
    """The store a customer visits most; the last store by name with ``legacy_order``."""
    most, name = F.col("number_of_visits").desc(), F.col("store_name")
    order = [name.desc(), most] if legacy_order else [most, name.asc()]
    best = first_per_key(visits.where("channel = 'Store'"), ["cust_id"], order)
    return best.select("cust_id", F.col("store_name").alias("favorite_store"))


# --- metric tables ----------------------------------------------------------------

def segment_snapshot(segments: DataFrame, extract_date: dt.date) -> DataFrame:
    """Complete segment rows of one extract."""
    return segments.where(F.col("extract_date") == F.lit(extract_date)).select(
        "cust_id", "segment", "net_spend_bin_12m").dropna()


def segment_file_dates(segments: DataFrame) -> DataFrame:
    """Load dates that brought usable rows."""
    return segments.dropna(subset=["cust_id", "net_spend_bin_12m"]).select("extract_date").distinct()


def client_list(metrics: DataFrame) -> DataFrame:
    """Customers that are neither VIP nor abroad and know an associate."""
    return metrics.where((F.col("dle_flag") == 0) & (F.col("associates_l24m") >= 1) & (F.col("loc_status") != fixed.ABROAD)).select(*fixed.METRICS_COLUMNS).distinct()


def high_spend_customers(metrics: DataFrame, min_spend: float = fixed.HIGH_SPEND) -> DataFrame:
    return client_list(metrics.where(F.col("spent_l12m") >= min_spend))


def relationship_recent(relations: DataFrame) -> DataFrame:
    """Customer and associate pairs with positive net spend over twelve months."""
    return relations.where("net_spent_l12m > 0").select(*fixed.RELATION_COLUMNS).distinct()


def relationship_lapsed(relations: DataFrame) -> DataFrame:
    """Pairs positive over two years but negative over the last."""
    return relations.where("net_spent_l24m > 0 AND net_spent_l12m < 0").select(*fixed.RELATION_COLUMNS).distinct()


def _served(associates: DataFrame, min_customers: int) -> DataFrame:
    return associates.where((F.col("status") == "Active") & (F.col("customers_l24m") >= min_customers))


def active_associates(associates: DataFrame, min_customers: int = 1) -> DataFrame:
    return _served(associates, min_customers).select(*fixed.ASSOCIATE_COLUMNS).distinct()


def associate_pins(associates: DataFrame, store: int, min_customers: int = 1) -> DataFrame:
    """Pins of one store's active associates."""
    return _served(associates, min_customers).where(F.col("location_id") == store).select("associate_pin").distinct()


def customer_profile(customers: DataFrame) -> DataFrame:
    return customers.select(*fixed.PROFILE_COLUMNS).dropna(subset=["cust_id"]).distinct()


def store_names(location: DataFrame) -> DataFrame:
    return location.select("location_id", "location_name").distinct()


def lifecycle_levels(lifecycle: DataFrame) -> DataFrame:
    """One level per customer: the one with the highest spend."""
    rows = lifecycle.select("cust_id", "total_spent", "level")
    return first_per_key(rows, ["cust_id"], [F.col("total_spent").desc(), F.col("level")])


def cfa_cohorts(metrics: DataFrame) -> DataFrame:
    return metrics.select("cust_id", "cf_segment", "cf_segment_start", "cf_rung_ladder", "cf_customer_status",
                          "favorite_location_1", "favorite_location_2").distinct()


def campaign_sends(sends: DataFrame, begin: str) -> DataFrame:
    """Sends from a day on with their parsed day and ISO week; unreadable days are null."""
    day = F.try_to_date(F.col("start_text"), "yyyy-MM-dd")
    return (
        sends.where(F.col("start_text") >= begin)
        .select("cust_id", "associate_pin", "start_text", "end_text")
        .distinct()
        .withColumns({"date": day, "week": dates.iso_week(day)})
    )


# --- loyalty and associates ----------------------------------------------------------

def loyalty_accounts(accounts: DataFrame, customers: DataFrame,
                     types: tuple = fixed.LOYALTY_TENDER_TYPES) -> DataFrame:
    rows = accounts.where(F.col("tender_type").isin(*types)).select("cust_id", "tender_id", "tender_key").distinct()
    return known_customers(rows, customers)


def latest_email_per_tender(tender_emails: DataFrame, placeholders: tuple = fixed.PLACEHOLDER_EMAILS,
                            owner: str = fixed.EXCLUDED_EMAIL_OWNER) -> DataFrame:
    """Latest date per e-mail and tender, placeholder addresses left out."""
    real = F.col("email").isNotNull() & ~F.col("email").isin(*placeholders) & (F.col("owner") != owner)
    return tender_emails.where(real).groupBy("email", "tender_id").agg(F.max("rdate").alias("rdate"))


def loyalty_emails(accounts: DataFrame, emails: DataFrame) -> DataFrame:
    """One e-mail per loyalty customer: the latest, then the first by name."""
    best = first_per_key(emails, ["tender_id"], [F.col("rdate").desc(), F.col("email")])
    joined = accounts.join(best, "tender_id")
    order = [F.col("rdate").desc(), F.col("email"), F.col("tender_id"), F.col("tender_key")]
    return first_per_key(joined, ["cust_id"], order).select("cust_id", "tender_id", "tender_key", "email")


def associate_profile(associates: DataFrame) -> DataFrame:
    """Associates with a work location."""
    rows = associates.select("assoc_id", "associate_pin", "first_name", "last_name", "department", "department_id", "location_id")
    return rows.dropna(subset=["location_id"]).withColumn("location_id", F.col("location_id").cast("bigint")).distinct()


def selling_locations(sales: DataFrame, chain: str) -> DataFrame:
    """Locations a chain sold from."""
    return sales.where(F.col("chain") == chain).select(F.col("location_id").cast("bigint").alias("location_id")).dropna().distinct()


def channel_locations(location_channels: DataFrame, location: DataFrame, channels: list[str]) -> DataFrame:
    """Locations of the given channels."""
    wanted = location_channels.where(F.col("channel").isin(*channels))
    return location.join(wanted, "location_id", "left_semi").select(
        F.col("location_id").cast("bigint").alias("location_id")).dropna().distinct()


def associates_of_chain(associates: DataFrame, locations: DataFrame) -> DataFrame:
    return associate_profile(associates).join(locations, "location_id")
