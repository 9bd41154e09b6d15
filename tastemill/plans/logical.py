"""The logical tables once more, as DuckDB SQL over the given tables.

Written apart from the Spark definitions so that the oracle does not lean on them.
"""

from __future__ import annotations

from tastemill.functions.fixed import EXCLUDED_DESCRIPTION_WORDS, SUPPRESSION_POSITIONS
from tastemill.sources.retail import DIVISION_NAMES, GENDERS


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


_PART = """p_size AS department_id, p_type AS division,
 CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS INTEGER) AS division_id,
 split_part(p_name,' ',2) AS class,
 CAST(ascii(split_part(p_name,' ',2))*100+length(split_part(p_name,' ',2)) AS INTEGER) AS class_id,
 p_brand AS designer, CAST(split_part(p_brand,'#',2) AS INTEGER) AS designer_id"""

_EMAIL = "CASE WHEN user_id%7=0 THEN 'u'||user_id||'@staff.example.com' ELSE 'u'||user_id||'@example.com' END"
_K = "CAST(json_extract_string(props,'$.k') AS INTEGER)"

VIEWS: dict[str, str] = {
    "sales": f"""SELECT CAST(CASE WHEN o_orderkey%101=0 THEN 0 ELSE o_custkey END AS BIGINT) AS cust_id, CAST(o_orderdate AS DATE) AS trans_date, l_orderkey AS tran_no, l_partkey AS item_id,
 s_nationkey AS location_id, {_PART},
 CASE WHEN l_returnflag='R' THEN 'V' ELSE 'S' END AS status,
 CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'Store' WHEN o_orderpriority='5-LOW' THEN 'Catalog' ELSE 'Online' END AS channel,
 CAST(CASE WHEN o_custkey%10=0 OR l_linenumber%3=0 THEN -1 ELSE l_suppkey END AS BIGINT) AS assoc1,
 CASE WHEN l_linenumber%2=0 THEN l_suppkey+1 END AS assoc2,
 l_extendedprice AS unit_price, CAST(l_quantity AS INTEGER) AS qty, l_discount AS unit_discount, p_retailprice AS unit_retail,
 CASE WHEN l_suppkey%7=0 THEN 'SECOND' ELSE 'MAIN' END AS chain
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey""",
    "product": f"""SELECT p_partkey AS item_id, p_partkey AS product_key, {_PART},
 CASE WHEN CAST(split_part(p_brand,'#',2) AS INTEGER)=25 THEN 'UNKNOWN BRAND' ELSE p_brand END AS brand_name,
 split_part(p_name,' ',2) AS class_name, 'Dept '||p_size AS department_name, 'Sub '||(p_size%4) AS subclass, p_size%3 AS tax_category_id, CAST(p_size%20+800 AS VARCHAR) AS group_id,
 'Group '||(p_size%20) AS group_name, {_list(DIVISION_NAMES)}[p_partkey%{len(DIVISION_NAMES)}+1] AS division_name,
 {_list(GENDERS)}[p_partkey%{len(GENDERS)}+1] AS gender,
 CASE WHEN p_name LIKE 'hot %' THEN 'NO COLOR' ELSE split_part(p_name,' ',1) END AS color,
 CASE WHEN p_size%10=0 THEN 'NO SIZE' ELSE CAST(p_size AS VARCHAR) END AS size,
 p_retailprice*CAST(0.5 AS DOUBLE) AS initial_cost, p_retailprice AS initial_retail FROM part""",
    "catalog": f"""SELECT p_partkey AS catalog_key, 'NM_'||p_partkey AS item_code, right('NM_'||p_partkey,5) AS item_suffix, p_partkey AS item_id,
 'W'||p_partkey AS web_item_id, 'Web '||p_name AS web_item_name,
 CASE WHEN p_partkey%7=0 THEN p_name||' '||upper({_list(EXCLUDED_DESCRIPTION_WORDS)}[(p_partkey//7)%{len(EXCLUDED_DESCRIPTION_WORDS)}+1])||' set' ELSE p_name END AS description,
 p_retailprice AS regular_price, CASE WHEN p_partkey%4=0 THEN p_retailprice*CAST(0.5 AS DOUBLE) ELSE p_retailprice END AS sale_price, p_brand AS brand, split_part(p_name,' ',2) AS class FROM part""",
    "location": """SELECT n_nationkey AS location_id, CASE WHEN n_nationkey<>24 THEN n_nationkey+1000 END AS location_no,
 CASE WHEN n_regionkey=0 THEN n_name||' Online' WHEN n_regionkey=1 THEN n_name||' Catalog' ELSE n_name END AS location_name,
 n_nationkey%7 AS chain_id, n_nationkey%6+10 AS area_id, n_regionkey+200 AS region_id,
 CASE WHEN n_nationkey=6 THEN 12031 ELSE n_nationkey%14+13011 END AS district_id FROM nation""",
    "location_channels": "SELECT n_nationkey AS location_id, ['store','online','catalog','outlet'][n_nationkey%4+1] AS channel FROM nation",
    "store_stock": """SELECT p_partkey AS item_id, p_partkey%25 AS location_id, p_size AS qty,
 CASE WHEN p_partkey%11=0 THEN 'TRUE' ELSE 'FALSE' END AS block_flag,
 CASE WHEN p_partkey%5=0 THEN 'OUTLET' ELSE 'STORES' END AS selling_group FROM part""",
    "web_stock": "SELECT p_partkey AS item_id, p_size%7 AS qty, CASE WHEN p_partkey%9=0 THEN 'OTHER' ELSE 'MAIN' END AS retailer FROM part",
    "register_lines": """SELECT o_orderdate AS tran_time, CAST(o_orderdate AS DATE) AS trans_date,
 CASE WHEN l_tax<=CAST(0.06 AS DOUBLE) THEN 'SALE' ELSE 'VOID' END AS tran_type, CASE WHEN l_tax>CAST(0.07 AS DOUBLE) THEN 'V' WHEN l_returnflag='R' THEN 'R' ELSE 'S' END AS status,
 l_partkey%50+1 AS department_id, l_suppkey%25 AS location_id, l_extendedprice AS unit_price,
 CASE WHEN l_linenumber=7 THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS qty, CASE WHEN l_suppkey%37=1 THEN -1 ELSE l_partkey END AS product_key,
 CASE WHEN l_linenumber=5 THEN -1 ELSE l_partkey END AS catalog_key,
 CASE WHEN l_suppkey%50=0 THEN -1 ELSE o_custkey END AS customer_key,
 CASE WHEN l_suppkey%9=0 THEN 'XX_'||l_partkey ELSE 'NM_'||l_partkey END AS item_code
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "purchases": """SELECT CAST(CASE WHEN o_orderkey%101=0 THEN 0 ELSE o_custkey END AS BIGINT) AS cust_id, 'W'||l_partkey AS web_item_id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS date_time,
 p_retailprice AS regular_price FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN part ON l_partkey=p_partkey WHERE l_returnflag<>'R'""",
    "returned": """SELECT CASE WHEN l_returnflag='R' THEN 'R' ELSE 'S' END AS status, l_suppkey AS return_location,
 CAST(l_shipdate AS DATE) AS return_date, l_extendedprice AS unit_price, CAST(l_quantity AS INTEGER) AS qty,
 lpad(CAST(l_suppkey*7%2000 AS VARCHAR),4,'0')||'/'||lpad(CAST(l_linenumber AS VARCHAR),6,'0')||'/001'||lpad(CAST(l_orderkey%10000 AS VARCHAR),4,'0')
 ||'/'||strftime(o_orderdate,'%m%d%y') AS reference FROM lineitem JOIN orders ON l_orderkey=o_orderkey""",
    "rolling_summary": """SELECT o_custkey AS cust_id, CASE WHEN o_custkey%6=0 THEN 'SECOND' ELSE 'MAIN' END AS chain, CAST(year(o_orderdate)*100+month(o_orderdate) AS INTEGER) AS fiscal_month_end,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS rolling_amt, CASE WHEN count(*)>1 THEN 2 ELSE 1 END AS segment
 FROM orders GROUP BY 1,2,3""",
    "clickstream": f"""SELECT event_id, ts AS date_time, CAST(ts AS DATE) AS event_date, 'v'||user_id AS visitor_id, CASE WHEN event_id%33<>5 THEN {_EMAIL} END AS email,
 CASE event_type WHEN 'view' THEN 'product detail' WHEN 'click' THEN 'Shopping Cart' WHEN 'purchase' THEN 'order confirmation' ELSE 'home' END AS pagename,
 CASE WHEN event_type='purchase' THEN event_id END AS purchase_id,
 CASE WHEN event_id%40<>7 THEN CASE WHEN event_id%21=3 THEN 'c;XX_' ELSE 'c;NM_' END||{_K}||';1;'||{_K}||',c;NM_'||({_K}+1)||';2;'||({_K}+1) END AS product_list,
 CASE WHEN event_id%50=0 THEN 1 ELSE 0 END AS exclude_hit, CASE WHEN event_id%30=11 THEN 1 ELSE 0 END AS duplicate_purchase,
 CASE WHEN event_id%6=0 THEN 'SECOND' ELSE 'MAIN' END AS chain FROM events""",
    "cookie_map": """SELECT DISTINCT 'v'||user_id AS visitor_id, CASE WHEN user_id%13=12 THEN -1 WHEN user_id%11<>10 THEN user_id END AS cust_id
 FROM events WHERE user_id%10<>9""",
    "email_map": f"SELECT DISTINCT {_EMAIL} AS email, user_id AS cust_id FROM events WHERE user_id%10<>9",
    "customers": "SELECT c_custkey AS cust_id, c_custkey AS customer_key FROM customer",
    "suppression": """SELECT c_custkey AS cust_id, (c_nationkey=3)::INT||''||(c_custkey%5=1)::INT||(c_custkey%61=0)::INT||'0'||(c_custkey%67=0)::INT
 ||(c_custkey%71=0)::INT||(c_custkey%29=0)::INT||'00'||(c_custkey%4=3)::INT||repeat('0',31)||(c_mktsegment='MACHINERY')::INT AS bits FROM customer""",
    "suppressed": "SELECT cust_id FROM suppression WHERE " + " OR ".join(f"substr(bits,{p},1)='1'" for p in SUPPRESSION_POSITIONS),
    "customer_source": "SELECT c_custkey AS cust_id, CASE WHEN c_custkey%20=0 THEN 'DLE' ELSE 'STD' END AS source FROM customer",
    "customer_metrics": """SELECT CASE WHEN c_custkey%53<>0 THEN c_custkey END AS cust_id, CASE WHEN c_custkey%2=0 THEN 'Dr' ELSE 'Mx' END AS prefix,
 split_part(c_name,'#',1) AS first_name, left(c_mktsegment,1) AS middle_initial, split_part(c_name,'#',2) AS last_name,
 'L'||(c_custkey%6) AS level, CAST(c_custkey%100 AS DOUBLE)/100 AS alive_probability, c_custkey%12 AS predicted_purchases,
 c_custkey%15 AS clv_frequency, c_custkey%365 AS clv_recency, c_acctbal AS clv_monetary_value, c_custkey%11 AS cf_segment,
 c_custkey%7 AS cf_segment_start, 'L'||(c_custkey%7) AS cf_rung_ladder, ['New','Loyal','Transient'][c_custkey%3+1] AS cf_customer_status,
 c_nationkey AS favorite_location_1, (c_nationkey+1)%25 AS favorite_location_2, CASE WHEN c_custkey%20=0 THEN 1 ELSE 0 END AS dle_flag,
 c_custkey%3 AS associates_l24m, c_acctbal*100 AS spent_l12m,
 CASE WHEN c_nationkey%5=0 THEN 'International' ELSE 'Domestic' END AS loc_status FROM customer""",
    "lifecycle": "SELECT o_custkey AS cust_id, o_totalprice AS total_spent, 'L'||(o_orderkey%5) AS level FROM orders",
    "segments": """SELECT CASE WHEN c_custkey%37<>0 THEN c_custkey END AS cust_id, CASE WHEN c_acctbal>=0 THEN 'S'||(c_custkey%9) END AS segment,
 CASE WHEN c_custkey%41<>0 THEN CAST(floor(c_acctbal/1000) AS INTEGER) END AS net_spend_bin_12m,
 DATE '2001-07-01'+c_nationkey%3 AS extract_date FROM customer""",
    "relationships": """SELECT cust_id, assoc1 AS assoc_id,
 CAST(coalesce(sum(CASE WHEN trans_date>DATE '2001-08-01'-365 THEN net END),0) AS DOUBLE) AS net_spent_l12m,
 CAST(coalesce(sum(CASE WHEN trans_date>DATE '2001-08-01'-730 THEN net END),0) AS DOUBLE) AS net_spent_l24m,
 count(DISTINCT CASE WHEN trans_date>DATE '2001-08-01'-730 THEN trans_date END) AS l24m_trips,
 CASE WHEN count(DISTINCT CASE WHEN trans_date>DATE '2001-08-01'-730 THEN trans_date END)>=2 THEN 'Strong' ELSE 'Weak' END AS relationship_l24m
 FROM (SELECT *, CASE WHEN status='V' THEN -CAST(unit_price*qty AS DECIMAL(18,2)) ELSE CAST(unit_price*qty AS DECIMAL(18,2)) END AS net
 FROM sales WHERE assoc1<>-1) GROUP BY 1,2""",
    "campaign": """SELECT o_custkey AS cust_id, 'P'||(o_orderkey%100) AS associate_pin,
 CASE WHEN o_orderkey%17=0 THEN 'unknown' ELSE strftime(o_orderdate,'%Y-%m-%d') END AS start_text,
 strftime(o_orderdate+INTERVAL 7 DAY,'%Y-%m-%d') AS end_text FROM orders""",
    "loyalty_tenders": """SELECT c_custkey AS cust_id, 'T'||(c_custkey//2) AS tender_id, c_custkey*10 AS tender_key,
 CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'BG' WHEN 'BUILDING' THEN 'CHG' ELSE 'OTH' END AS tender_type FROM customer""",
    "tender_emails": """SELECT CASE WHEN o_orderkey%13=0 THEN 'None' WHEN o_orderkey%19<>0 THEN 'u'||o_custkey||'@example.com' END AS email,
 'T'||(o_custkey//2) AS tender_id, CAST(o_orderdate AS DATE) AS rdate, CASE WHEN o_orderpriority='5-LOW' THEN 'AM' ELSE 'CO' END AS owner FROM orders""",
    "associates": """SELECT s_suppkey AS assoc_id, 'P'||s_suppkey AS associate_pin, split_part(s_name,'#',1) AS first_name, split_part(s_name,'#',2) AS last_name,
 'Dept '||s_nationkey AS department, s_nationkey AS department_id, CASE WHEN s_suppkey%10<>9 THEN s_nationkey END AS location_id,
 s_suppkey*3 AS age_days, s_acctbal AS revenue_l12m, s_suppkey%40 AS transactions_l12m, s_suppkey%30 AS customers_l12m,
 s_suppkey%4 AS customers_l24m, CASE WHEN s_acctbal>0 THEN 'Active' ELSE 'Left' END AS status FROM supplier""",
    "excluded_brands": "SELECT DISTINCT designer FROM product WHERE designer_id%6=0",
}

_NEEDS = {"suppressed": ["suppression"], "relationships": ["sales"], "excluded_brands": ["product"]}


def with_views(names: list[str], body: str) -> str:
    """Put the definitions of the named tables, and what they need, in front of a query."""
    chosen: list[str] = []
    for name in names:
        chosen += [n for n in [*_NEEDS.get(name, []), name] if n not in chosen]
    body = body.strip()
    if not chosen:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in chosen)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
