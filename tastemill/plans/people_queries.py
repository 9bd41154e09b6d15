"""Customers, associates, loyalty, segments and exclusions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tastemill.functions import fixed
from tastemill.operators import customers as cu
from tastemill.plans.registry import AS_OF, CHAIN, SALES_BEGIN, SALES_END, query
from tastemill.plans.sales_queries import SPEND, TRIP_VIEWS, VISITS, spend, visits

METRICS = ", ".join(fixed.METRICS_COLUMNS)
RELATION = ", ".join(fixed.RELATION_COLUMNS)
ASSOCIATE = ", ".join(fixed.ASSOCIATE_COLUMNS)
SPEND_VIEWS = ["sales", "product", "location", "customers", "suppressed"]


def _spend_columns(df):
    return df.select("cust_id", "trans_date", "tran_no", "item_id", "assoc1", "assoc2", "total_spent")


@query("vip_exclusion", ["sales", "customer_source"], """SELECT cust_id, tran_no, item_id FROM sales s WHERE NOT EXISTS
 (SELECT 1 FROM customer_source c WHERE c.source='DLE' AND c.cust_id=s.cust_id)""")
def _(d):
    return cu.vip_exclusion(d.sales("cust_id", "tran_no", "item_id"), d.customer_source()).select("cust_id", "tran_no", "item_id")


DIGITAL = """digital AS (SELECT DISTINCT cust_id FROM sales s WHERE status<>'V' AND assoc1=-1 AND cust_id<>0 AND cust_id IN (SELECT cust_id FROM customers)
 AND chain='MAIN' AND trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' AND NOT EXISTS (SELECT 1 FROM sales o WHERE o.cust_id=s.cust_id AND o.status<>'V'
 AND o.assoc1<>-1 AND o.chain='MAIN' AND o.trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01'))"""


def digital(d):
    lines = d.sales("cust_id", "trans_date", "chain", "status", "assoc1", between=(SALES_BEGIN, SALES_END))
    return cu.digital_only_customers(lines, d.customers(), SALES_BEGIN, SALES_END, CHAIN)


@query("digital_only_customers", ["sales", "customers"], f"WITH {DIGITAL} SELECT * FROM digital")
def _(d):
    return digital(d)


ACTIVE = "active AS (SELECT assoc_id FROM associates WHERE status='Active')"
TOUCHED = "(assoc1 IN (SELECT assoc_id FROM active) OR assoc2 IN (SELECT assoc_id FROM active))"


@query("keep_active_associates", ["sales", "associates"], f"""WITH {ACTIVE} SELECT DISTINCT cust_id, tran_no, item_id, coalesce(assoc1,-1) AS assoc1, coalesce(assoc2,-1) AS assoc2
 FROM sales WHERE {TOUCHED}""")
def _(d):
    return cu.keep_active_associates(d.sales("cust_id", "tran_no", "item_id", "assoc1", "assoc2"), d.active_associates())


@query("matched_by_associate", ["sales", "associates"], f"WITH {ACTIVE} SELECT DISTINCT cust_id, tran_no, item_id, assoc1, assoc2 FROM sales WHERE {TOUCHED}")
def _(d):
    return cu.matched_by_associate(d.sales("cust_id", "tran_no", "item_id", "assoc1", "assoc2"), d.active_associates())


@query("clienteling_transactions", [*SPEND_VIEWS, "customer_source", "associates"], f"""WITH {SPEND}, {DIGITAL}, {ACTIVE} SELECT DISTINCT cust_id, trans_date, tran_no, item_id,
 coalesce(assoc1,-1) AS assoc1, coalesce(assoc2,-1) AS assoc2, total_spent FROM spend s WHERE NOT EXISTS (SELECT 1 FROM customer_source c WHERE c.source='DLE' AND c.cust_id=s.cust_id)
 AND NOT EXISTS (SELECT 1 FROM digital g WHERE g.cust_id=s.cust_id) AND {TOUCHED}""")
def _(d):
    lines = _spend_columns(spend(d))
    return cu.clienteling_transactions(lines, d.customer_source(), digital(d), d.active_associates())


@query("channel_count", TRIP_VIEWS, f"""WITH {VISITS} SELECT v.*, channel_count FROM visits v JOIN (SELECT cust_id, count(DISTINCT channel) AS channel_count FROM visits GROUP BY 1) c ON v.cust_id=c.cust_id""")
def _(d):
    return cu.channel_count(visits(d))


@query("customer_channel_status", TRIP_VIEWS, f"""WITH {VISITS} SELECT *, CASE WHEN channel_count>1 THEN 'Omni' WHEN channel='Store' THEN 'Store_Only' WHEN channel='Online' THEN 'Online_Only'
 WHEN channel='Catalog' THEN 'Catalog_Only' END AS omni_status FROM (SELECT v.*, channel_count FROM visits v JOIN (SELECT cust_id, count(DISTINCT channel) AS channel_count FROM visits GROUP BY 1) c ON v.cust_id=c.cust_id)""")
def _(d):
    return cu.customer_channel_status(visits(d))


@query("favorite_store", TRIP_VIEWS, f"""WITH {VISITS} SELECT cust_id, store_name AS favorite_store FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY number_of_visits DESC, store_name) AS r
 FROM visits WHERE channel='Store') WHERE r=1""")
def _(d):
    return cu.favorite_store(visits(d))


@query("favorite_store_legacy_order", TRIP_VIEWS, f"""WITH {VISITS} SELECT cust_id, store_name AS favorite_store FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY store_name DESC, number_of_visits DESC) AS r
 FROM visits WHERE channel='Store') WHERE r=1""")
def _(d):
    return cu.favorite_store(visits(d), legacy_order=True)


# --- metric tables -------------------------------------------------------------------

@query("segment_snapshot", ["segments"], """SELECT cust_id, segment, net_spend_bin_12m FROM segments WHERE extract_date=DATE '2001-07-02' AND cust_id IS NOT NULL AND segment IS NOT NULL
 AND net_spend_bin_12m IS NOT NULL""")
def _(d):
    return cu.segment_snapshot(d.segments(), dt.date(2001, 7, 2))


@query("segment_file_dates", ["segments"], "SELECT DISTINCT CAST(extract_date AS DATE) AS extract_date FROM segments WHERE cust_id IS NOT NULL AND net_spend_bin_12m IS NOT NULL")
def _(d):
    return cu.segment_file_dates(d.segments())


CLIENTS = "dle_flag=0 AND associates_l24m>=1 AND loc_status<>'International'"


@query("client_list", ["customer_metrics"], f"SELECT DISTINCT {METRICS} FROM customer_metrics WHERE {CLIENTS}")
def _(d):
    return cu.client_list(d.customer_metrics())


@query("high_spend_customers", ["customer_metrics"], f"SELECT DISTINCT {METRICS} FROM customer_metrics WHERE {CLIENTS} AND spent_l12m>=500000")
def _(d):
    return cu.high_spend_customers(d.customer_metrics())


@query("relationship_recent", ["relationships"], f"SELECT DISTINCT {RELATION} FROM relationships WHERE net_spent_l12m>0")
def _(d):
    return cu.relationship_recent(d.relationships(AS_OF))


@query("relationship_lapsed", ["relationships"], f"SELECT DISTINCT {RELATION} FROM relationships WHERE net_spent_l24m>0 AND net_spent_l12m<0")
def _(d):
    return cu.relationship_lapsed(d.relationships(AS_OF))


@query("active_associates", ["associates"], f"SELECT DISTINCT {ASSOCIATE} FROM associates WHERE status='Active' AND customers_l24m>=1")
def _(d):
    return cu.active_associates(d.associates())


@query("associate_pins", ["associates"], "SELECT DISTINCT associate_pin FROM associates WHERE status='Active' AND customers_l24m>=1 AND location_id=16")
def _(d):
    return cu.associate_pins(d.associates(), 16)


@query("customer_profile", ["customer_metrics"], "SELECT DISTINCT cust_id, prefix, first_name, middle_initial, last_name FROM customer_metrics WHERE cust_id IS NOT NULL")
def _(d):
    return cu.customer_profile(d.customer_metrics())


@query("store_names", ["location"], "SELECT DISTINCT location_id, location_name FROM location")
def _(d):
    return cu.store_names(d.location())


@query("lifecycle_levels", ["lifecycle"], "SELECT cust_id, total_spent, level FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY total_spent DESC, level) AS r FROM lifecycle) WHERE r=1")
def _(d):
    return cu.lifecycle_levels(d.lifecycle())


@query("cfa_cohorts", ["customer_metrics"], "SELECT DISTINCT cust_id, cf_segment, cf_segment_start, cf_rung_ladder, cf_customer_status, favorite_location_1, favorite_location_2 FROM customer_metrics")
def _(d):
    return cu.cfa_cohorts(d.customer_metrics())


@query("campaign_sends", ["campaign"], """SELECT DISTINCT cust_id, associate_pin, start_text, end_text, TRY_CAST(start_text AS DATE) AS date, CAST(week(TRY_CAST(start_text AS DATE)) AS INTEGER) AS week
 FROM campaign WHERE start_text>='1998-01-01'""")
def _(d):
    return cu.campaign_sends(d.campaign_sends(), "1998-01-01")


# --- loyalty and associates --------------------------------------------------------------

ACCOUNTS = "accounts AS (SELECT DISTINCT cust_id, tender_id, tender_key FROM loyalty_tenders WHERE tender_type IN ('BG','CHG') AND cust_id IN (SELECT cust_id FROM customers))"
EMAILS = """emails AS (SELECT email, tender_id, max(rdate) AS rdate FROM tender_emails WHERE email IS NOT NULL AND email NOT IN ('None','none@capitalone-no-email.com') AND owner<>'AM' GROUP BY 1,2)"""


@query("loyalty_accounts", ["loyalty_tenders", "customers"], f"WITH {ACCOUNTS} SELECT * FROM accounts")
def _(d):
    return cu.loyalty_accounts(d.loyalty_tenders(), d.customers())


@query("latest_email_per_tender", ["tender_emails"], f"WITH {EMAILS} SELECT * FROM emails")
def _(d):
    return cu.latest_email_per_tender(d.tender_emails())


@query("loyalty_emails", ["loyalty_tenders", "customers", "tender_emails"], f"""WITH {ACCOUNTS}, {EMAILS} SELECT cust_id, tender_id, tender_key, email FROM (SELECT a.*, email,
 row_number() OVER (PARTITION BY cust_id ORDER BY rdate DESC, email, a.tender_id, tender_key) AS r FROM accounts a JOIN emails e ON a.tender_id=e.tender_id) WHERE r=1""")
def _(d):
    accounts = cu.loyalty_accounts(d.loyalty_tenders(), d.customers())
    return cu.loyalty_emails(accounts, cu.latest_email_per_tender(d.tender_emails()))


PEOPLE = """people AS (SELECT DISTINCT assoc_id, associate_pin, first_name, last_name, department, department_id, CAST(location_id AS BIGINT) AS location_id FROM associates WHERE location_id IS NOT NULL)"""


@query("associate_profile", ["associates"], f"WITH {PEOPLE} SELECT * FROM people")
def _(d):
    return cu.associate_profile(d.associates())


@query("selling_locations", ["sales"], "SELECT DISTINCT CAST(location_id AS BIGINT) AS location_id FROM sales WHERE chain='SECOND'")
def _(d):
    return cu.selling_locations(d.sales("location_id", "chain"), "SECOND")


@query("channel_locations", ["location", "location_channels"], """SELECT DISTINCT CAST(l.location_id AS BIGINT) AS location_id FROM location l JOIN location_channels c ON l.location_id=c.location_id
 WHERE channel IN ('store','online','catalog')""")
def _(d):
    return cu.channel_locations(d.location_channels(), d.location(), ["store", "online", "catalog"])


@query("associates_of_chain", ["sales", "associates"], f"""WITH {PEOPLE} SELECT p.* FROM people p WHERE location_id IN (SELECT location_id FROM sales WHERE chain='SECOND')""")
def _(d):
    return cu.associates_of_chain(d.associates(), cu.selling_locations(d.sales("location_id", "chain"), "SECOND"))


@query("associates_of_channels", ["location", "location_channels", "associates"], f"""WITH {PEOPLE} SELECT p.* FROM people p WHERE location_id IN (SELECT l.location_id FROM location l
 JOIN location_channels c ON l.location_id=c.location_id WHERE channel IN ('store','online','catalog'))""")
def _(d):
    return cu.associates_of_chain(d.associates(), cu.channel_locations(d.location_channels(), d.location(), ["store", "online", "catalog"]))


@query("omni_status", TRIP_VIEWS, f"""WITH {VISITS} SELECT omni_status, count(*) AS customers FROM (SELECT cust_id, CASE WHEN count(DISTINCT channel)>1 THEN 'Omni' WHEN max(channel)='Store' THEN 'Store_Only'
 WHEN max(channel)='Online' THEN 'Online_Only' ELSE 'Catalog_Only' END AS omni_status FROM visits GROUP BY 1) GROUP BY 1""")
def _(d):
    status = cu.customer_channel_status(visits(d)).select("cust_id", "omni_status").distinct()
    return status.groupBy("omni_status").agg(F.count("*").alias("customers"))
