"""Sales, customer features and inventory over the whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tastemill.functions import fixed, text
from tastemill.operators import features, inventory, sales
from tastemill.plans.registry import AS_OF, BASE, BASE_ALL_DIVISIONS, BASE_DATED, CHAIN, DEPARTMENTS, REACHABLE, RECENT, RECENT_SQL, SALES_BEGIN, SALES_END, base_sales, dated_sales, query
from tastemill.plans.scalar_queries import MERCH, SHORT_NAME, WORDS

CHANNELS = ["Catalog", "Online", "Store"]
ALL_SPEND_COLUMNS = ["cust_id", "trans_date", "designer", "item_id", "location_id", "department_id", "division_id",
                     "assoc1", "assoc2", "channel", "tran_no", "unit_price", "qty", "department_name", "class_name"]


def spend(d):
    return sales.transaction_spend(base_sales(d, *ALL_SPEND_COLUMNS), d.customers(), d.suppression(), d.product(), d.location())


SPEND = f"""{BASE}, spend AS (SELECT cust_id, trans_date, designer AS brand_name, class_name, item_id, location_id, department_id, department_name,
 division_id, assoc1, assoc2, channel, tran_no, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS total_spent, designer||' '||class_name AS brand_class
 FROM (SELECT DISTINCT b.cust_id, trans_date, b.designer, p.class_name, b.item_id, b.location_id, b.department_id, p.department_name, b.division_id,
 assoc1, assoc2, channel, tran_no, unit_price*qty AS amount FROM base b JOIN product p ON b.item_id=p.item_id JOIN location l ON b.location_id=l.location_id) x
 WHERE {REACHABLE.format('x')} GROUP BY ALL)"""


@query("enriched_lines", ["sales", "customers", "product", "location"], """SELECT s.cust_id, s.tran_no, s.item_id, s.location_id, p.department_name, p.class_name, l.location_name
 FROM sales s JOIN customers c ON s.cust_id=c.cust_id JOIN product p ON s.item_id=p.item_id JOIN location l ON s.location_id=l.location_id""")
def _(d):
    return sales.enrich_lines(d.sales("cust_id", "tran_no", "item_id", "location_id"), d.customers(), d.product(), d.location())


@query("transaction_spend", ["sales", "product", "location", "customers", "suppressed"], f"WITH {SPEND} SELECT * FROM spend")
def _(d):
    return spend(d)


@query("daily_channel_revenue", ["sales", "customers"], f"""WITH {BASE_ALL_DIVISIONS}, r AS (SELECT trans_date, channel, sum(CAST(amount AS DECIMAL(18,2))) AS v
 FROM (SELECT DISTINCT cust_id, trans_date, channel, unit_price*qty AS amount FROM base WHERE cust_id IN (SELECT cust_id FROM customers)) GROUP BY 1,2)
 SELECT trans_date, CAST(max(v) FILTER (channel='Catalog') AS DOUBLE)/1000000.0::DOUBLE AS catalog, CAST(max(v) FILTER (channel='Online') AS DOUBLE)/1000000.0::DOUBLE AS online,
 CAST(max(v) FILTER (channel='Store') AS DOUBLE)/1000000.0::DOUBLE AS store, CAST(sum(v) AS DOUBLE)/1000000.0::DOUBLE AS total FROM r GROUP BY 1""")
def _(d):
    return sales.daily_channel_revenue(base_sales(d, "cust_id", "trans_date", "channel", "unit_price", "qty", divisions=()), d.customers(), CHANNELS)


def daily_spend(d, whole: bool = True):
    lines = base_sales(d, "cust_id", "trans_date", "tran_no", "unit_price", "qty")
    return sales.daily_customer_spend(lines, d.customers(), d.suppression(), whole)


DAILY = f"""{BASE}, daily AS (SELECT cust_id, trans_date, CAST(trunc(sum(CAST(amount AS DECIMAL(18,2)))) AS BIGINT) AS total_spent
 FROM (SELECT DISTINCT cust_id, trans_date, tran_no, unit_price*qty AS amount FROM base) x WHERE {REACHABLE.format('x')} GROUP BY 1,2)"""


@query("daily_customer_spend", ["sales", "customers", "suppressed"], f"WITH {DAILY} SELECT * FROM daily")
def _(d):
    return daily_spend(d)


EXACT = DAILY.replace("CAST(trunc(sum(CAST(amount AS DECIMAL(18,2)))) AS BIGINT)", "sum(CAST(amount AS DECIMAL(18,2)))")


@query("rfm", ["sales", "customers", "suppressed"], f"""WITH {EXACT} SELECT cust_id, count(DISTINCT trans_date)-1 AS frequency,
 CAST(max(trans_date)-min(trans_date) AS INTEGER) AS days_betn_first_shopd_and_last_shopd,
 CAST(sum(total_spent) AS DOUBLE)/count(*) AS avg_monetary_value, CAST(sum(total_spent) AS DOUBLE) AS now_lifetime_spent,
 CAST(DATE '2001-08-01'-min(trans_date) AS INTEGER) AS days_betn_first_shopd_and_today, CAST(DATE '2001-08-01'-max(trans_date) AS INTEGER) AS days_since_last_shopd,
 min(trans_date) AS first_shopd_day, max(trans_date) AS last_shopd_day FROM daily GROUP BY 1""")
def _(d):
    return features.rfm(daily_spend(d, whole=False), AS_OF)


# Shopping days, then first and last day of each customer as an aggregate joined back.
GAP_BASE = f"""{BASE}, gap_base AS (SELECT * FROM base WHERE cust_id IN (SELECT cust_id FROM customers))"""
SPENT = "CAST(sum(CAST(unit_price*qty AS DECIMAL(18,2))) AS DOUBLE) AS spent_in_this_shopd_day"
ENDS = """ends AS (SELECT cust_id, min(trans_date) AS first_shopd_day, max(trans_date) AS last_shopd_day, CAST(DATE '2001-08-01'-max(trans_date) AS INTEGER) AS days_since_last_shopd,
 CAST(max(trans_date)-min(trans_date) AS INTEGER) AS days_betn_first_shopd_and_last_shopd FROM trip GROUP BY 1)"""
ACTIVE_ENDS = "JOIN (SELECT * FROM ends e WHERE days_since_last_shopd<365 AND e.cust_id NOT IN (SELECT cust_id FROM suppressed)) USING (cust_id)"
GAP = f"""{GAP_BASE}, trip AS (SELECT cust_id, trans_date, {SPENT} FROM gap_base GROUP BY 1,2), {ENDS},
 gap AS (SELECT cust_id, trans_date, CAST(trans_date-lag(trans_date) OVER w AS INTEGER) AS inter_shopping_days, row_number() OVER w AS trip_number, spent_in_this_shopd_day,
 last_shopd_day, days_since_last_shopd, first_shopd_day, days_betn_first_shopd_and_last_shopd FROM trip {ACTIVE_ENDS} WINDOW w AS (PARTITION BY cust_id ORDER BY trans_date))"""
GAP_VIEWS = ["sales", "customers", "suppressed"]


def gaps(d):
    lines = base_sales(d, "cust_id", "trans_date", "unit_price", "qty")
    return features.inter_shopping_days(lines, d.customers(), d.suppression(), AS_OF, 365)


@query("inter_shopping_days", GAP_VIEWS, f"WITH {GAP} SELECT * FROM gap")
def _(d):
    return gaps(d)


@query("inter_shopping_days_by_location", [*GAP_VIEWS, "location"], f"""WITH {GAP_BASE}, trip AS (SELECT cust_id, trans_date, location_name, {SPENT}
 FROM gap_base JOIN location USING (location_id) GROUP BY 1,2,3), {ENDS}
 SELECT cust_id, trans_date, CAST(trans_date-lag(trans_date) OVER (w ORDER BY trans_date, location_name) AS INTEGER) AS inter_shopping_days, count(*) OVER (w ORDER BY trans_date) AS trip_number,
 CASE WHEN contains(location_name,'Online') THEN 'online' WHEN contains(location_name,'Catalog') THEN 'catalog' ELSE location_name END AS location_name, spent_in_this_shopd_day,
 last_shopd_day, days_since_last_shopd, first_shopd_day, days_betn_first_shopd_and_last_shopd FROM trip {ACTIVE_ENDS} WINDOW w AS (PARTITION BY cust_id)""")
def _(d):
    lines = base_sales(d, "cust_id", "trans_date", "location_id", "unit_price", "qty")
    return features.inter_shopping_days_by_location(lines, d.customers(), d.suppression(), d.location(), AS_OF, 365)


@query("rfm_from_trips", GAP_VIEWS, f"""WITH {GAP} SELECT cust_id, count(DISTINCT trans_date)-1 AS frequency,
 CAST(max(trans_date)-min(trans_date) AS INTEGER) AS days_betn_first_shopd_and_last_shopd,
 CAST(sum(CAST(spent_in_this_shopd_day AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS avg_monetary_value, CAST(sum(CAST(spent_in_this_shopd_day AS DECIMAL(18,2))) AS DOUBLE) AS now_lifetime_spent,
 CAST(DATE '2001-08-01'-min(trans_date) AS INTEGER) AS days_betn_first_shopd_and_today, CAST(DATE '2001-08-01'-max(trans_date) AS INTEGER) AS days_since_last_shopd,
 min(trans_date) AS first_shopd_day, max(trans_date) AS last_shopd_day FROM gap GROUP BY 1""")
def _(d):
    return features.rfm_from_trips(gaps(d), AS_OF)


LINES = f"""{GAP}, plines AS (SELECT DISTINCT s.cust_id, s.trans_date, s.item_id, unit_price, qty, unit_discount, unit_retail, inter_shopping_days, trip_number,
 first_shopd_day, last_shopd_day, days_since_last_shopd, days_betn_first_shopd_and_last_shopd, initial_cost, initial_retail,
 {SHORT_NAME} AS division_name, department_name, group_name, class_name,
 CASE WHEN brand_name LIKE 'UNKNOWN%' THEN '?' ELSE brand_name END AS brand_name,
 CASE WHEN left(gender,1) IN {fixed.GENDER_CODES} THEN left(gender,1) ELSE 'N' END AS gender,
 CASE WHEN color LIKE 'NO COLO%' THEN '?' ELSE color END AS color, CASE WHEN size LIKE 'NO SIZ%' THEN '?' ELSE size END AS size
 FROM sales s JOIN gap g ON s.cust_id=g.cust_id AND s.trans_date=g.trans_date JOIN product p ON s.item_id=p.item_id WHERE s.status<>'V')"""
LINE_COLUMNS = ["cust_id", "trans_date", "item_id", "status", "unit_price", "qty", "unit_discount"]


def product_lines(d):
    return features.recent_product_lines(gaps(d), d.sales(*LINE_COLUMNS, between=(SALES_BEGIN, SALES_END)), d.product())


@query("recent_product_lines", [*GAP_VIEWS, "product"], f"WITH {LINES} SELECT * FROM plines")
def _(d):
    return product_lines(d)


@query("cohort_lines", [*GAP_VIEWS, "product"], f"""WITH {LINES}, cohort AS (SELECT o_custkey AS cust_id, CAST(o_orderdate AS DATE) AS trans_date FROM orders WHERE o_orderstatus='F')
 SELECT DISTINCT l.* FROM plines l WHERE EXISTS (SELECT 1 FROM cohort c WHERE c.cust_id=l.cust_id AND c.trans_date=l.trans_date)""")
def _(d):
    cohort = d.table("orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("cust_id"), F.to_date("o_orderdate").alias("trans_date"))
    return features.cohort_lines(product_lines(d), cohort)


@query("item_price_catalog", ["sales", "product"], f"""WITH {BASE_DATED} SELECT DISTINCT b.item_id, unit_price, unit_discount, unit_retail, brand_name, class_name, initial_cost, initial_retail, tax_category_id, gender, color, size,
 department_name, division_name, group_name FROM base b JOIN product p ON b.item_id=p.item_id
 WHERE b.item_id IN (SELECT item_id FROM sales WHERE {RECENT_SQL})""")
def _(d):
    recent = d.sales("item_id", between=RECENT)
    return sales.item_price_catalog(dated_sales(d, "item_id", "unit_price", "unit_discount"), recent, d.product())


def _trips(d, by, channel=None):
    lines = base_sales(d, *dict.fromkeys(["cust_id", "trans_date", "channel", "division_id", "location_id"]))
    return sales.trips(lines, d.customers(), d.suppression(), d.location(), by, channel)


def visits(d):
    return _trips(d, ["channel", "store_name"])


TRIP_VIEWS = ["sales", "customers", "suppressed", "location"]
VISITS = f"""{BASE}, visits AS (SELECT cust_id, channel, location_name AS store_name, count(DISTINCT trans_date) AS number_of_visits
 FROM base x JOIN location l ON x.location_id=l.location_id WHERE {REACHABLE.format('x')} GROUP BY 1,2,3)"""


@query("store_trips", TRIP_VIEWS, f"""WITH {BASE} SELECT cust_id, count(DISTINCT trans_date) AS number_of_visits FROM base x JOIN location l ON x.location_id=l.location_id
 WHERE channel='Store' AND {REACHABLE.format('x')} GROUP BY 1""")
def _(d):
    return _trips(d, [], "Store")


@query("channel_store_trips", TRIP_VIEWS, f"WITH {VISITS} SELECT * FROM visits")
def _(d):
    return visits(d)


@query("channel_division_trips", TRIP_VIEWS, f"""WITH {BASE} SELECT cust_id, channel, division_id, count(DISTINCT trans_date) AS number_of_visits
 FROM base x JOIN location l ON x.location_id=l.location_id WHERE {REACHABLE.format('x')} GROUP BY 1,2,3""")
def _(d):
    return _trips(d, ["channel", "division_id"])


@query("daily_revenue", ["register_lines", "customers", "location"], f"""SELECT trans_date, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)/1000000.0::DOUBLE AS revenue FROM (
 SELECT DISTINCT trans_date, c.cust_id, unit_price*qty AS amount FROM register_lines r JOIN customers c ON r.customer_key=c.customer_key JOIN location l ON r.location_id=l.location_id
 WHERE trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' AND status<>'V' AND department_id NOT IN {DEPARTMENTS} AND c.cust_id<>0
 AND (area_id=14 OR region_id=201 OR district_id IN {fixed.REVENUE_DISTRICTS})) GROUP BY 1""")
def _(d):
    return sales.daily_revenue(d.register_lines(), d.customers(), d.location(), begin=SALES_BEGIN, end=SALES_END, departments=DEPARTMENTS)


@query("customer_history", ["sales", "customers", "product", "location"], """SELECT DISTINCT s.cust_id, trans_date, tran_no, location_name, s.item_id, unit_price, qty, unit_discount, unit_retail, assoc1, assoc2,
 division_name, department_name, group_name, class_name, brand_name, gender, color, size
 FROM sales s JOIN customers c ON s.cust_id=c.cust_id JOIN product p ON s.item_id=p.item_id JOIN location l ON s.location_id=l.location_id
 WHERE s.cust_id=5 AND status<>'V' AND trans_date>DATE '1995-06-30'""")
def _(d):
    lines = d.sales("cust_id", "trans_date", "tran_no", "location_id", "item_id", "status", "unit_price", "qty", "unit_discount", "unit_retail", "assoc1", "assoc2")
    return sales.customer_history(lines, d.customers(), d.product(), d.location(), 5, dt.date(1995, 6, 30))


WEB_ITEMS_VIEWS = ["register_lines", "customers", "product", "catalog"]
WEB_ITEMS = f"""web_items AS (SELECT DISTINCT c.cust_id, tran_time, web_item_id, web_item_name, division_name, group_id, group_name, class_name, subclass, department_name, p.designer, description,
 regular_price, sale_price FROM register_lines r JOIN customers c ON r.customer_key=c.customer_key JOIN product p ON r.product_key=p.product_key JOIN catalog q ON r.catalog_key=q.catalog_key
 WHERE qty>0 AND tran_type='SALE' AND status='S' AND starts_with(r.item_code,'{fixed.ITEM_PREFIX}') AND r.product_key<>-1 AND r.customer_key<>-1 AND r.catalog_key<>-1
 AND trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01' AND c.cust_id<>-1 AND {MERCH} AND {WORDS})"""


def web_items(d):
    return sales.web_sales_items(d.register_lines(), d.customers(), d.product(), d.catalog(), dt.date(1995, 1, 1), AS_OF)


@query("web_sales_items", WEB_ITEMS_VIEWS, f"WITH {WEB_ITEMS} SELECT * FROM web_items")
def _(d):
    return web_items(d)


@query("web_sales_thin", WEB_ITEMS_VIEWS, f"WITH {WEB_ITEMS} SELECT DISTINCT cust_id, web_item_id, tran_time AS date_time, regular_price FROM web_items")
def _(d):
    return sales.web_sales_thin(web_items(d))


BRAND_BUYS = f"""buys AS (SELECT DISTINCT x.cust_id, x.item_id, trans_date AS event_date, brand_name AS brand, class_name AS class FROM base x JOIN product p ON x.item_id=p.item_id
 WHERE {REACHABLE.format('x')})"""


def brand_buys(d):
    return sales.brand_class_purchases(base_sales(d, "cust_id", "item_id", "trans_date", divisions=()), d.customers(), d.suppression(), d.product())


@query("brand_class_purchases", ["sales", "customers", "suppressed", "product"], f"WITH {BASE_ALL_DIVISIONS}, {BRAND_BUYS} SELECT * FROM buys")
def _(d):
    return brand_buys(d)


@query("brand_class_purchase_counts", ["sales", "customers", "suppressed", "product"], f"""WITH {BASE_ALL_DIVISIONS}, {BRAND_BUYS} SELECT cust_id, brand||'_'||class AS brand_class, count(*) AS total_transactions FROM buys GROUP BY 1,2""")
def _(d):
    from tastemill.operators.clicks import brand_class_counts

    return brand_class_counts(brand_buys(d), "total_transactions")


@query("latest_fiscal_month", ["rolling_summary"], "SELECT max(fiscal_month_end) AS latest_year_month FROM rolling_summary WHERE fiscal_month_end>200000 AND chain='MAIN'")
def _(d):
    return sales.latest_fiscal_month(d.rolling_summary(), 200000, CHAIN)


ROLLING = """SELECT t.cust_id, t.rolling_amt AS ty_rolling_amt, t.segment AS ty_cgroup, coalesce(l.rolling_amt,0) AS ly_rolling_amt, coalesce(l.segment,0) AS ly_cgroup
 FROM (SELECT * FROM rolling_summary WHERE fiscal_month_end=(SELECT max(fiscal_month_end) FROM rolling_summary WHERE fiscal_month_end>{0} AND chain='MAIN') AND chain='MAIN') t
 LEFT JOIN (SELECT * FROM rolling_summary WHERE fiscal_month_end=(SELECT max(fiscal_month_end)-100 FROM rolling_summary WHERE fiscal_month_end>{0} AND chain='MAIN') AND chain='MAIN') l ON t.cust_id=l.cust_id"""


@query("rolling_ty_ly", ["rolling_summary"], ROLLING.format(200000))
def _(d):
    return sales.rolling_ty_ly(d.rolling_summary(), 200000, CHAIN)


@query("time_features", ["sales"], """SELECT cust_id, trans_date, CAST(year(trans_date) AS INTEGER) AS year, CAST(month(trans_date) AS INTEGER) AS month, CAST(week(trans_date) AS INTEGER) AS week,
 CAST(isodow(trans_date)-1 AS INTEGER) AS day, count(*) OVER c AS frequency, CAST(coalesce(trans_date-lag(trans_date) OVER (PARTITION BY cust_id ORDER BY trans_date),0) AS INTEGER) AS interarrival_days,
 CAST(DATE '2001-08-01'-max(trans_date) OVER c AS INTEGER) AS recency, CAST(max(trans_date) OVER c-min(trans_date) OVER c AS INTEGER) AS active_duration,
 max(trans_date) OVER c AS max_purchase_date, min(trans_date) OVER c AS min_purchase_date FROM (SELECT DISTINCT cust_id, trans_date FROM sales) WINDOW c AS (PARTITION BY cust_id)""")
def _(d):
    return features.time_features(d.sales("cust_id", "trans_date"), AS_OF)


@query("days_since_last_purchase", ["sales"], "SELECT cust_id, max(trans_date) AS trans_date, CAST(DATE '2001-08-01'-max(trans_date) AS INTEGER) AS days_since_lpurchase FROM sales GROUP BY 1")
def _(d):
    return features.days_since_last_purchase(d.sales("cust_id", "trans_date"), AS_OF)


# --- inventory -----------------------------------------------------------------------

STOCK = """stores AS (SELECT location_id, brand_class, CAST(sum(qty) AS BIGINT) AS brand_class_qty FROM (SELECT DISTINCT qty, location_id, brand_name||'_'||class_name AS brand_class
 FROM store_stock s JOIN product p ON s.item_id=p.item_id WHERE selling_group='STORES' AND block_flag='FALSE') GROUP BY 1,2),
 online AS (SELECT brand_class, CAST(sum(qty) AS BIGINT) AS online_brand_class_qty FROM (SELECT DISTINCT qty, brand_name||'_'||class_name AS brand_class
 FROM web_stock w JOIN product p ON w.item_id=p.item_id WHERE retailer='MAIN') GROUP BY 1),
 merged AS (SELECT CAST(coalesce(location_id,124) AS BIGINT) AS location_id, brand_class, coalesce(brand_class_qty,0)+coalesce(online_brand_class_qty,0) AS brand_class_qty
 FROM stores FULL JOIN online USING (brand_class)),
 low AS (SELECT DISTINCT CAST(location_no AS BIGINT) AS location_no, brand_class FROM merged m JOIN location l ON m.location_id=l.location_id WHERE brand_class_qty<40)"""
STOCK_VIEWS = ["store_stock", "web_stock", "product", "location"]


def _stores(d):
    return inventory.store_inventory(d.store_inventory(), d.product(), "STORES")


def _online(d):
    return inventory.online_inventory(d.web_inventory(), d.product(), "MAIN")


def _low(d):
    return inventory.low_stock_items(inventory.merged_inventory(_stores(d), _online(d)), d.location(), 40)


@query("store_inventory", STOCK_VIEWS, f"WITH {STOCK} SELECT * FROM stores")
def _(d):
    return _stores(d)


@query("online_inventory", STOCK_VIEWS, f"WITH {STOCK} SELECT * FROM online")
def _(d):
    return _online(d)


@query("merged_inventory", STOCK_VIEWS, f"WITH {STOCK} SELECT * FROM merged")
def _(d):
    return inventory.merged_inventory(_stores(d), _online(d))


@query("low_stock_items", STOCK_VIEWS, f"WITH {STOCK} SELECT * FROM low")
def _(d):
    return _low(d)


@query("drop_low_stock", ["sales", *STOCK_VIEWS], f"""WITH {STOCK}, wishes AS (SELECT DISTINCT s.cust_id, p.brand_name||'_'||p.class_name AS brand_class, CAST(s.location_id+1000 AS BIGINT) AS location_no
 FROM sales s JOIN product p ON s.item_id=p.item_id)
 SELECT DISTINCT cust_id, brand_class FROM wishes w WHERE NOT EXISTS (SELECT 1 FROM low l WHERE l.location_no=w.location_no AND l.brand_class=w.brand_class)""")
def _(d):
    label = text.brand_class(F.col("brand_name"), F.col("class_name"), "_").alias("brand_class")
    wishes = d.sales("cust_id", "item_id", "location_id").join(d.product().select("item_id", "brand_name", "class_name"), "item_id").select(
        "cust_id", label, (F.col("location_id") + 1000).cast("bigint").alias("location_no")).distinct()
    return inventory.drop_low_stock(wishes, _low(d), ["location_no", "brand_class"])


@query("default_item_stock", STOCK_VIEWS, f"WITH {STOCK} SELECT brand_class, brand_class_qty FROM merged WHERE location_id=124")
def _(d):
    merged = inventory.merged_inventory(_stores(d), _online(d))
    return merged.where("location_id = 124").select("brand_class", "brand_class_qty")
