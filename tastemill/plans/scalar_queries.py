"""Functions, filters and key tools, each over a whole table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions import dates, fixed, scoring, text
from tastemill.operators import clicks, filters, keys
from tastemill.plans.registry import AS_OF, BASE, CLICK_BEGIN, CLICK_END, CLICKS_SQL, SALES_BEGIN, SALES_END, base_sales, query
from tastemill.sources.retail import RetailData

# --- functions -------------------------------------------------------------------

ACTION = """CASE WHEN pagename LIKE '%Cart%' THEN 'Cart_Add' WHEN pagename='product detail' THEN 'Product_Page'
 WHEN purchase_id IS NOT NULL THEN 'Purchase' ELSE 'Other' END"""


@query("action_type", ["clickstream"], f"SELECT event_id, {ACTION} AS action_type FROM clickstream")
def _(d: RetailData) -> DataFrame:
    return d.clickstream().select("event_id", text.action_type(F.col("pagename"), F.col("purchase_id")).alias("action_type"))


@query("product_list_parse", ["clickstream"], """SELECT event_id, string_split(e,';')[2] AS item_code, string_split(e,';')[3] AS qty,
 string_split(e,';')[4] AS total_price FROM (SELECT event_id, unnest(string_split(product_list,',')) AS e FROM clickstream)""")
def _(d):
    return clicks.parse_product_list(d.clickstream().select("event_id", "product_list"))


@query("suffix_code", ["catalog"], "SELECT item_id, right(item_code,5) AS suffix FROM catalog")
def _(d):
    return d.catalog().select("item_id", text.suffix_code(F.col("item_code")).alias("suffix"))


@query("concat_key", ["catalog"], "SELECT item_id, brand||'_'||class||'_'||item_id AS key FROM catalog")
def _(d):
    return d.catalog().select("item_id", text.concat_key(*map(F.col, ("brand", "class", "item_id")), sep="_").alias("key"))


@query("brand_class", ["product"], "SELECT item_id, brand_name||' '||class_name AS blank, brand_name||'_'||class_name AS underscore FROM product")
def _(d):
    b, c = F.col("brand_name"), F.col("class_name")
    return d.product().select("item_id", text.brand_class(b, c, " ").alias("blank"), text.brand_class(b, c, "_").alias("underscore"))


SHORT_NAME = "CASE " + " ".join(f"WHEN starts_with(division_name,'{p}') THEN '{n}'" for p, n in fixed.DIVISION_SHORT_NAMES) + " ELSE division_name END"


@query("division_short_name", ["product"], f"SELECT item_id, {SHORT_NAME} AS division_name FROM product")
def _(d):
    return d.product().select("item_id", text.division_short_name(F.col("division_name")).alias("division_name"))


@query("attribute_clean_up", ["product"], """SELECT item_id, CASE WHEN gender LIKE 'W%' THEN 'W' WHEN gender LIKE 'U%' THEN 'U' WHEN gender LIKE 'M%' THEN 'M'
 WHEN gender LIKE 'G%' THEN 'G' WHEN gender LIKE 'B%' THEN 'B' ELSE 'N' END AS gender,
 CASE WHEN color LIKE 'NO COLO%' THEN '?' ELSE color END AS color, CASE WHEN size LIKE 'NO SIZ%' THEN '?' ELSE size END AS size,
 CASE WHEN brand_name LIKE 'UNKNOWN%' THEN '?' ELSE brand_name END AS brand FROM product""")
def _(d):
    return d.product().select(
        "item_id", text.gender_code(F.col("gender")).alias("gender"), text.color_clean(F.col("color")).alias("color"),
        text.size_clean(F.col("size")).alias("size"), text.brand_clean(F.col("brand_name")).alias("brand"))


@query("location_bucket", ["location"], """SELECT location_id, CASE WHEN location_name LIKE '%Online%' THEN 'online' WHEN location_name LIKE '%Catalog%' THEN 'catalog'
 ELSE location_name END AS location_name FROM location""")
def _(d):
    return d.location().select("location_id", text.location_bucket(F.col("location_name")).alias("location_name"))


CHAIN_CODE = "CASE " + " ".join(
    f"WHEN {c} IN ({','.join(map(str, v))}) THEN '{n}'" for c, v, n in fixed.CHAIN_RULES) + " ELSE 'Other' END"


@query("chain_code", ["location"], f"SELECT location_id, {CHAIN_CODE} AS chain FROM location")
def _(d):
    cols = {c: F.col(c) for c in ("chain_id", "district_id", "area_id", "region_id")}
    return d.location().select("location_id", text.chain_code(cols).alias("chain"))


@query("last_saturday", [], """SELECT day, CAST(day-1-CAST(isodow(day) AS INTEGER)%7 AS DATE) AS last_saturday, CAST(day+(7-CAST(isodow(day) AS INTEGER)) AS DATE) AS next_sunday
 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)""")
def _(d):
    day = F.col("day")
    days = d.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", dates.last_saturday(day).alias("last_saturday"), dates.next_sunday(day).alias("next_sunday"))


@query("date_windows", [], """SELECT day, day-56 AS this_year_begin, day AS this_year_end, day-420 AS last_year_begin, day-364 AS last_year_end,
 sat-366 AS year_begin, sat AS year_end, sat-731 AS two_year_begin, sat-49 AS browse_begin, sat-30 AS recent_begin, sat-1095 AS history_begin,
 day-60 AS feed_begin, day-7 AS cart_begin, CAST(day+(7-CAST(isodow(day) AS INTEGER)) AS DATE) AS week_begin, CAST(day+(13-CAST(isodow(day) AS INTEGER)) AS DATE) AS week_end
 FROM (SELECT day, CAST(day-1-CAST(isodow(day) AS INTEGER)%7 AS DATE) AS sat FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders))""")
def _(d):
    days = d.table("orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", *[c.alias(n) for n, c in dates.date_windows(F.col("day")).items()])


@query("date_from_text", [], """SELECT event_id, CAST(split_part(strftime(ts,'%Y-%m-%d %H:%M:%S'),' ',1) AS DATE) AS day FROM events""")
def _(d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return d.table("events").select("event_id", dates.date_from_text(stamp).alias("day"))


@query("calendar_parts", [], """SELECT o_orderkey, CAST(week(o_orderdate) AS INTEGER) AS iso_week, CAST(isodow(o_orderdate)-1 AS INTEGER) AS weekday FROM orders""")
def _(d):
    day = F.to_date("o_orderdate")
    return d.table("orders").select("o_orderkey", dates.iso_week(day).alias("iso_week"), dates.weekday_mon0(day).alias("weekday"))


@query("same_month_last_year", ["rolling_summary"], "SELECT DISTINCT fiscal_month_end, fiscal_month_end-100 AS last_year FROM rolling_summary")
def _(d):
    month = F.col("fiscal_month_end")
    return d.rolling_summary().select(month, dates.same_month_last_year(month).alias("last_year")).distinct()


@query("renormalize", [], """SELECT o_orderkey, round((CAST(4 AS DOUBLE)*(o_totalprice-CAST(1 AS DOUBLE)))/CAST(499999 AS DOUBLE)+1,6) AS rating FROM orders""")
def _(d):
    value = scoring.renormalize(F.col("o_totalprice"), (F.lit(1.0), F.lit(500000.0)), (1.0, 5.0))
    return d.table("orders").select("o_orderkey", F.round(value, 6).alias("rating"))


@query("minmax_scale", [], """SELECT o_orderkey, round(99*(o_totalprice-lo)/(hi-lo)+1,6) AS score
 FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)""")
def _(d):
    orders = d.table("orders")
    price = F.col("o_totalprice")
    span = orders.agg(F.struct(F.min(price).alias("low"), F.max(price).alias("high"))).scalar()
    return orders.select("o_orderkey", F.round(scoring.minmax_scale(price, span["low"], span["high"]), 6).alias("score"))


@query("score_range", [], "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def _(d):
    return d.table("orders").agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("scale_and_loss", ["sales"], """SELECT channel, CAST(sum(CAST(unit_price*qty AS DECIMAL(18,2))) AS DOUBLE)/1000000.0::DOUBLE AS millions,
 CAST(ceil(count(*) FILTER (status='V')*100.0::DOUBLE/count(*)) AS BIGINT) AS void_percent FROM sales GROUP BY channel""")
def _(d):
    money = F.sum((F.col("unit_price") * F.col("qty")).cast("decimal(18,2)")).cast("double")
    kept = F.count_if(F.col("status") != "V")
    return d.sales("channel", "status", "unit_price", "qty").groupBy("channel").agg(
        scoring.scale_millions(money).alias("millions"), scoring.percent_loss(F.count("*"), kept).cast("bigint").alias("void_percent"))


@query("return_reference", ["returned"], """SELECT return_location, return_date, sale_store, sale_register, sale_tran_no, sale_date, total_ret_amount FROM (
 SELECT return_location, return_date, CAST(split_part(reference,'/',1) AS INTEGER) AS sale_store, CAST(split_part(reference,'/',2) AS INTEGER) AS sale_register,
 CAST(substr(split_part(reference,'/',3),4,4) AS INTEGER) AS sale_tran_no,
 CAST(strptime((CASE WHEN right(reference,2)>='26' THEN '19' ELSE '20' END)||right(reference,2)||substr(split_part(reference,'/',4),1,4),'%Y%m%d') AS DATE) AS sale_date,
 unit_price*qty AS total_ret_amount FROM returned WHERE status='R') WHERE round(sale_store/1000.0)=1 AND sale_tran_no<>0""")
def _(d):
    from tastemill.operators.sales import return_lines

    return return_lines(d.returns())


# --- filters ----------------------------------------------------------------------

@query("sales_base_filter", ["sales"], f"""WITH {BASE} SELECT cust_id, trans_date, tran_no, item_id, department_id, division_id, unit_price, qty FROM base""")
def _(d):
    return base_sales(d, "cust_id", "trans_date", "tran_no", "item_id", "department_id", "division_id", "unit_price", "qty")


@query("suppression_filter", ["customers", "suppressed"], "SELECT cust_id FROM customers WHERE cust_id NOT IN (SELECT cust_id FROM suppressed)")
def _(d):
    return filters.suppression_filter(d.customers().select("cust_id"), d.suppression())


@query("suppress_customers", ["sales", "suppressed"], """SELECT s.cust_id, tran_no, item_id, qty FROM sales s
 WHERE NOT EXISTS (SELECT 1 FROM suppressed z WHERE z.cust_id=s.cust_id)""")
def _(d):
    return filters.suppression_filter(d.sales("cust_id", "tran_no", "item_id", "qty"), d.suppression())


WORDS = " AND ".join(f"description NOT ILIKE '%{w}%'" for w in fixed.EXCLUDED_DESCRIPTION_WORDS)


@query("description_exclusions", ["catalog"], f"SELECT item_id, description FROM catalog WHERE {WORDS}")
def _(d):
    return filters.description_exclusions(d.catalog().select("item_id", "description"))


MERCH = f"division_name NOT IN {fixed.EXCLUDED_DIVISION_NAMES} AND group_id<>'{fixed.EXCLUDED_GROUP}'"


@query("merch_exclusions", ["product"], f"SELECT item_id, division_name, group_id FROM product WHERE {MERCH} AND brand_name<>'UNKNOWN BRAND'")
def _(d):
    return filters.merch_exclusions(filters.known_products(d.product())).select("item_id", "division_name", "group_id")


@query("click_quality_filter", ["clickstream"], f"""SELECT event_id, email, event_date FROM clickstream WHERE email IS NOT NULL
 AND {CLICKS_SQL} AND chain='MAIN' AND exclude_hit=0 AND duplicate_purchase=0 AND product_list IS NOT NULL""")
def _(d):
    return filters.click_quality_filter(d.clickstream(), CLICK_BEGIN, CLICK_END, "MAIN").select("event_id", "email", "event_date")


@query("internal_email_filter", ["clickstream"], "SELECT event_id, email FROM clickstream WHERE NOT contains(email,'staff.example') AND NOT contains(email,'intern.example')")
def _(d):
    return filters.internal_email_filter(d.clickstream(), ["staff.example", "intern.example"]).select("event_id", "email")


@query("keyword_exclusion", ["product"], """SELECT item_id, brand_name||' '||class_name AS brand_class FROM product
 WHERE NOT regexp_matches(brand_name||' '||class_name, 'UNKNOWN BRAND|Trunk Show|Swimsuit|Swim|Unclassified|GWP|Bow Ties|Napkins|Travel|Ingestibles|Socks|Desserts|Gentlemen?s|Hardware|Louis Vuitton|Christmas|[gG]izmo')""")
def _(d):
    from tastemill.functions import fixed

    rows = d.product().select("item_id", text.brand_class(F.col("brand_name"), F.col("class_name")).alias("brand_class"))
    return filters.keyword_exclusion(rows, patterns=(*fixed.EXCLUDED_BRAND_CLASS, "[gG]izmo"))


@query("division_exclusion", ["sales"], "SELECT cust_id, tran_no, item_id, division_id FROM sales WHERE division_id<>5")
def _(d):
    return filters.division_exclusion(d.sales("cust_id", "tran_no", "item_id", "division_id"), 5)


@query("purchase_line_filter", ["register_lines"], """SELECT customer_key, product_key, catalog_key, tran_time, qty FROM register_lines WHERE qty>0 AND tran_type='SALE'
 AND status='S' AND item_code LIKE 'NM%' AND product_key<>-1 AND customer_key<>-1 AND catalog_key<>-1
 AND trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01'""")
def _(d):
    kept = filters.purchase_line_filter(d.register_lines(), SALES_BEGIN, SALES_END)
    return kept.select("customer_key", "product_key", "catalog_key", "tran_time", "qty")


@query("drop_incomplete", ["sales"], "SELECT cust_id, tran_no, item_id, assoc2 FROM sales WHERE assoc2 IS NOT NULL")
def _(d):
    return keys.drop_incomplete(d.sales("cust_id", "tran_no", "item_id", "assoc2"))


@query("coalesce_counts", ["sales"], "SELECT cust_id, tran_no, item_id, coalesce(assoc2,0) AS assoc2 FROM sales")
def _(d):
    return filters.coalesce_counts(d.sales("cust_id", "tran_no", "item_id", "assoc2"), ["assoc2"])


@query("preview", [], "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def _(d):
    rows = d.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return filters.preview(rows, [F.col("o_totalprice").desc(), F.col("o_orderkey")])


# --- row sets -----------------------------------------------------------------------

@query("anti_join_by_keys", ["sales", "store_stock"], """SELECT cust_id, tran_no, s.item_id, s.location_id FROM sales s
 WHERE NOT EXISTS (SELECT 1 FROM store_stock k WHERE k.item_id=s.item_id AND k.location_id=s.location_id)""")
def _(d):
    lines = d.sales("cust_id", "tran_no", "item_id", "location_id")
    return keys.without_keys(lines, d.store_inventory(), ["item_id", "location_id"]).select(*lines.columns)


@query("not_in_with_nulls", ["customers", "customer_metrics"], """SELECT cust_id FROM customers c
 WHERE NOT EXISTS (SELECT 1 FROM customer_metrics m WHERE m.cust_id=c.cust_id AND m.loc_status='International')""")
def _(d):
    # The exclusion list holds nulls; NOT IN would return nothing.
    return keys.without_keys(d.customers().select("cust_id"), d.customer_metrics().where("loc_status = 'International'"), ["cust_id"])


@query("semi_join_by_frequency", ["sales"], """SELECT cust_id, tran_no, item_id FROM sales WHERE cust_id IN (SELECT cust_id FROM sales GROUP BY 1 HAVING count(*)>3 AND count(*)<=100)
 AND item_id IN (SELECT item_id FROM sales GROUP BY 1 HAVING count(*)>20)""")
def _(d):
    lines = d.sales("cust_id", "tran_no", "item_id")
    n = F.col("n")
    people = keys.key_counts(lines, ["cust_id"]).where((n > 3) & (n <= 100))
    items = keys.key_counts(lines, ["item_id"]).where(n > 20)
    return keys.with_keys(keys.with_keys(lines, people, ["cust_id"]), items, ["item_id"]).select("cust_id", "tran_no", "item_id")


@query("first_per_key", [], """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r=1""")
def _(d):
    rows = d.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return keys.first_per_key(rows, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("distinct_rows", ["sales"], "SELECT DISTINCT cust_id, item_id, channel, status FROM sales")
def _(d):
    return d.sales("cust_id", "item_id", "channel", "status").distinct()


@query("concat_dedupe", ["sales"], "SELECT cust_id, item_id FROM sales WHERE channel='Store' UNION SELECT cust_id, item_id FROM sales WHERE status='V'")
def _(d):
    lines = d.sales("cust_id", "item_id", "channel", "status")
    pick = lambda c: lines.where(c).select("cust_id", "item_id")
    return keys.union_distinct(pick("channel = 'Store'"), pick("status = 'V'"))


@query("distinct_count", ["sales"], "SELECT count(DISTINCT cust_id) AS n FROM sales")
def _(d):
    return keys.distinct_count(d.sales("cust_id"), "cust_id")


@query("flatten_list", ["clickstream"], "SELECT event_id, unnest(string_split(product_list,',')) AS entry FROM clickstream")
def _(d):
    lists = d.clickstream().select("event_id", text.product_entries(F.col("product_list")).alias("entries"))
    return clicks.flatten(lists, "entries", "entry")
