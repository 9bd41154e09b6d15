"""Clicks, taste profiles, ratings, re-ranking and publishing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tastemill.functions.fixed import ITEM_PREFIX
from tastemill.levels import DIVISION, LEVELS, Level
from tastemill.operators import clicks, ratings, rerank, taste
from tastemill.operators.keys import first_per_key
from tastemill.plans.registry import (
    CHAIN, CLICK_BEGIN, CLICK_END, CLICKS_SQL, CUSTOMER_SUPPORT, HISTORY, HISTORY_SQL, ITEM_SUPPORT, RECENT, RECENT_SQL, SALES_BEGIN, query,
)
from tastemill.plans.scalar_queries import ACTION, MERCH, WORDS
from tastemill.session import cut

CLICK_VIEWS = ["clickstream", "cookie_map", "catalog", "product"]
STAMP = dt.datetime(2001, 8, 1, 6, 0, 0)


# --- clicks -------------------------------------------------------------------------

def click_views(d, known_brand: bool = True, with_ids: bool = True):
    return clicks.clickstream_products(
        d.clickstream(), d.cookie_map(), d.catalog(), d.product(), CLICK_BEGIN, CLICK_END, CHAIN,
        known_brand=known_brand, with_ids=with_ids)


def click_sql(brand_rule: str = "WHERE brand_name<>'UNKNOWN BRAND'", ids: bool = True) -> str:
    """Parsed entries, then one lookup each for customer, item and product."""
    id_cols = "designer_id, division_id, class_id," if ids else ""
    return f"""good_clicks AS (SELECT *, {ACTION} AS action_type FROM clickstream
 WHERE {CLICKS_SQL} AND chain='MAIN' AND exclude_hit+duplicate_purchase=0 AND email IS NOT NULL AND product_list IS NOT NULL),
 click_items AS (SELECT DISTINCT date_time, visitor_id, action_type, split_part(entry,';',2) AS item_code
 FROM (SELECT date_time, visitor_id, action_type, unnest(string_split(product_list,',')) AS entry FROM good_clicks WHERE action_type<>'Purchase')
 WHERE starts_with(split_part(entry,';',2),'{ITEM_PREFIX}')),
 who AS (SELECT DISTINCT visitor_id, cust_id FROM cookie_map WHERE cust_id IS NOT NULL),
 what AS (SELECT DISTINCT item_code, item_id, web_item_id, description, regular_price FROM catalog),
 sort AS (SELECT DISTINCT item_id, designer, division, division_name, class, subclass, group_id, group_name, {id_cols} department_name FROM product {brand_rule}),
 clicked AS (SELECT DISTINCT date_time, cust_id, web_item_id, action_type, description, regular_price, sort.* EXCLUDE (item_id)
 FROM click_items LEFT JOIN who USING (visitor_id) LEFT JOIN what USING (item_code) LEFT JOIN sort ON sort.item_id=what.item_id)"""


@query("clickstream_products", CLICK_VIEWS, f"WITH {click_sql()} SELECT * FROM clicked")
def _(d):
    return click_views(d)


@query("clickstream_products_without_ids", CLICK_VIEWS, f"WITH {click_sql(ids=False)} SELECT * FROM clicked")
def _(d):
    return click_views(d, with_ids=False)


@query("clickstream_products_any_brand", CLICK_VIEWS, f"WITH {click_sql('', ids=False)} SELECT * FROM clicked")
def _(d):
    return click_views(d, known_brand=False, with_ids=False)


@query("left_join_chain", CLICK_VIEWS, f"WITH {click_sql()} SELECT action_type, count(*) AS n, count(cust_id) AS with_customer, count(web_item_id) AS with_item, count(designer) AS with_product FROM clicked GROUP BY 1")
def _(d):
    return click_views(d).groupBy("action_type").agg(
        F.count("*").alias("n"), F.count("cust_id").alias("with_customer"), F.count("web_item_id").alias("with_item"),
        F.count("designer").alias("with_product"))


@query("events_by_item_action", CLICK_VIEWS, f"""WITH {click_sql('', ids=False)} SELECT cust_id, web_item_id, action_type, count(*) AS n_events FROM clicked
 GROUP BY 1,2,3 ORDER BY n_events DESC, cust_id ASC NULLS LAST, web_item_id ASC NULLS LAST, action_type ASC NULLS LAST LIMIT 10""")
def _(d):
    return clicks.events_by_item_action(click_views(d, known_brand=False, with_ids=False))


BROWSES = """browses AS (SELECT DISTINCT m.cust_id, b.item_suffix, event_date, brand, class FROM (SELECT DISTINCT email, event_date, right(string_split(e,';')[2],5) AS item_suffix
 FROM (SELECT *, unnest(string_split(product_list,',')) AS e FROM clickstream WHERE email IS NOT NULL AND event_date>DATE '2023-12-09' AND chain='MAIN' AND exclude_hit=0
 AND duplicate_purchase=0 AND product_list IS NOT NULL AND purchase_id IS NULL AND lower(pagename) LIKE '%detail%')) b
 JOIN (SELECT DISTINCT item_suffix, brand, class FROM catalog) k ON b.item_suffix=k.item_suffix JOIN email_map m ON b.email=m.email
 WHERE NOT EXISTS (SELECT 1 FROM suppressed z WHERE z.cust_id=m.cust_id))"""
BROWSE_VIEWS = ["clickstream", "catalog", "email_map", "suppressed"]


def brand_browses(d):
    return clicks.brand_class_browses(d.clickstream(), d.email_map(), d.catalog(), d.suppression(), CLICK_BEGIN, "MAIN")


@query("brand_class_browses", BROWSE_VIEWS, f"WITH {BROWSES} SELECT * FROM browses")
def _(d):
    return brand_browses(d)


@query("brand_class_browse_counts", BROWSE_VIEWS, f"WITH {BROWSES} SELECT cust_id, brand||'_'||class AS brand_class, count(*) AS times_browse FROM browses GROUP BY 1,2")
def _(d):
    return clicks.brand_class_counts(brand_browses(d), "times_browse")


# --- taste --------------------------------------------------------------------------

def history(d, level: Level):
    """Valid lines of the last three years; the range reaches the scan of the orders."""
    return d.sales("cust_id", "status", *level.columns, between=HISTORY).where("status <> 'V'").drop("status")


def taste_sql(level: Level) -> str:
    plain = ", ".join(level.columns)
    category = "||' '||".join(level.parts)
    keys = f"cust_id, category, {plain}"
    complete = " AND ".join(f"{c} IS NOT NULL" for c in ["cust_id", *level.columns])
    return f"""{click_sql()}, bc AS (SELECT cust_id, {category} AS category, {plain}, count(*) AS times_browse FROM clicked
 WHERE cust_id<>-1 AND {complete} GROUP BY ALL),
 tc AS (SELECT cust_id, {category} AS category, {plain}, count(*) AS total_transactions FROM sales WHERE status<>'V' AND {HISTORY_SQL} AND {complete} GROUP BY ALL),
 merged AS (SELECT {keys}, coalesce(times_browse,0) AS times_browse, coalesce(total_transactions,0) AS total_transactions FROM bc FULL JOIN tc USING ({keys})),
 ranked AS (SELECT *, total_transactions*CAST(0.8 AS DOUBLE)+times_browse*CAST(0.2 AS DOUBLE) AS rank_implicit FROM merged),
 q AS (SELECT quantile_cont(rank_implicit,[0.25,0.5,0.75,0.85]) AS q FROM ranked),
 profile AS (SELECT {keys}, CAST(CASE WHEN rank_implicit<q[1] THEN 1 WHEN rank_implicit<q[2] THEN 2 WHEN rank_implicit<q[3] THEN 3 WHEN rank_implicit<q[4] THEN 4 ELSE 5 END AS INTEGER) AS score FROM ranked, q),
 best AS (SELECT *, CAST(row_number() OVER (PARTITION BY cust_id ORDER BY rank_implicit DESC, category) AS INTEGER) AS propensity_rank FROM ranked),
 recs AS (SELECT {keys}, 99*(rank_implicit-lo)/(hi-lo)+1 AS propensity_score, propensity_rank FROM best,
 (SELECT min(rank_implicit) AS lo, max(rank_implicit) AS hi FROM best WHERE propensity_rank<=15) WHERE propensity_rank<=15),
 recent AS (SELECT DISTINCT cust_id, {plain} FROM sales WHERE {RECENT_SQL}),
 reranked AS (SELECT r.*, CASE WHEN k.cust_id IS NULL THEN CAST(row_number() OVER (PARTITION BY r.cust_id, k.cust_id IS NULL ORDER BY propensity_score DESC, propensity_rank) AS INTEGER) END AS next_best_rank
 FROM recs r LEFT JOIN recent k ON {' AND '.join(f'r.{c}=k.{c}' for c in ['cust_id', *level.columns])})"""


TASTE_VIEWS = ["sales", *CLICK_VIEWS]


def profile(d, level: Level, held: bool = False):
    return taste.taste_profile(click_views(d), history(d, level), level, held)


def deterministic_recs(d, level: Level):
    """Recommendations with a known outcome: a customer's 15 highest implicit ranks."""
    counts = taste.taste_counts(click_views(d), history(d, level), level)
    best = taste.top_n_per_customer(taste.with_implicit_rank(counts), 15, "rank_implicit", place="propensity_rank")
    from tastemill.operators.recommend import scale_scores

    return scale_scores(best.withColumnRenamed("rank_implicit", "propensity_score")).select(
        *level.keys, "propensity_score", "propensity_rank")


def recent(d, level: Level):
    return d.recent_history(*RECENT).select("cust_id", *level.columns)


def rounded_score(df):
    return df.withColumn("propensity_score", F.round("propensity_score", 6))


ROUNDED = "* REPLACE (round(propensity_score,6) AS propensity_score)"


def publish_sql(level: Level) -> str:
    return f"""WITH {taste_sql(level)} SELECT r.{ROUNDED}, TIMESTAMP '2001-08-01 06:00:00' AS record_creation_datetime, TIMESTAMP '2001-08-01 06:00:00' AS record_updated_datetime
 FROM reranked r JOIN (SELECT cust_id AS cid, count(*) FILTER (next_best_rank IS NULL) AS bought FROM reranked GROUP BY 1) b ON r.cust_id=b.cid
 WHERE propensity_rank<=CASE WHEN bought<10 THEN 10 ELSE 15 END"""


def _register_level(level: Level) -> None:
    @query(f"taste_profile_{level.name}", TASTE_VIEWS, f"WITH {taste_sql(level)} SELECT * FROM profile")
    def _(d):
        return profile(d, level)

    @query(f"rerank_unseen_{level.name}", TASTE_VIEWS, f"WITH {taste_sql(level)} SELECT {ROUNDED} FROM reranked")
    def _(d):
        return rounded_score(rerank.rerank_unseen(deterministic_recs(d, level), recent(d, level), level))

    @query(f"publish_{level.name}", TASTE_VIEWS, publish_sql(level))
    def _(d):
        stamp = F.lit(STAMP).cast("timestamp_ntz")
        return rounded_score(rerank.publish(rerank.rerank_unseen(deterministic_recs(d, level), recent(d, level), level), stamp))


for _level in LEVELS.values():
    _register_level(_level)

FINEST = LEVELS["designer_division_class"]


@query("browse_by_level", TASTE_VIEWS, f"WITH {click_sql()} SELECT cust_id, class AS category, class_id, class FROM clicked WHERE cust_id IS NULL OR cust_id<>-1")
def _(d):
    return taste.browse_by_level(click_views(d), LEVELS["class"])


@query("trans_by_level", ["sales"], f"SELECT cust_id, designer||' '||division||' '||class AS category, designer_id, designer, division_id, division, class_id, class FROM sales WHERE status<>'V' AND {HISTORY_SQL}")
def _(d):
    return taste.trans_by_level(history(d, FINEST), FINEST)


@query("concat_columns", ["sales"], "SELECT cust_id, designer||' '||class AS category, designer_id, designer, class_id, class FROM sales")
def _(d):
    level = LEVELS["designer_class"]
    return taste.with_category(d.sales("cust_id", *level.columns), level)


@query("count_by_level", ["sales"], f"SELECT cust_id, division||' '||class AS category, division_id, division, class_id, class, count(*) AS total_transactions FROM sales WHERE status<>'V' AND {HISTORY_SQL} GROUP BY ALL")
def _(d):
    level = LEVELS["division_class"]
    return taste.count_by_level(taste.trans_by_level(history(d, level), level), level, "total_transactions")


@query("outer_merge_counts", TASTE_VIEWS, f"WITH {taste_sql(FINEST)} SELECT * FROM merged")
def _(d):
    b = taste.count_by_level(taste.browse_by_level(click_views(d), FINEST), FINEST, "times_browse")
    t = taste.count_by_level(taste.trans_by_level(history(d, FINEST), FINEST), FINEST, "total_transactions")
    return taste.outer_merge_counts(b, t, FINEST)


def _ranked(d, level: Level):
    return taste.with_implicit_rank(taste.taste_counts(click_views(d), history(d, level), level))


@query("implicit_rank", TASTE_VIEWS, f"WITH {taste_sql(FINEST)} SELECT cust_id, category, times_browse, total_transactions, round(rank_implicit,6) AS rank_implicit FROM ranked")
def _(d):
    return _ranked(d, FINEST).select("cust_id", "category", "times_browse", "total_transactions", F.round("rank_implicit", 6).alias("rank_implicit"))


@query("taste_quantiles", TASTE_VIEWS, f"WITH {taste_sql(FINEST)} SELECT round(q[1],6) AS q25, round(q[2],6) AS q50, round(q[3],6) AS q75, round(q[4],6) AS q85 FROM q")
def _(d):
    q = taste.taste_quantiles(_ranked(d, FINEST))
    return q.select(*[F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("q25", "q50", "q75", "q85"))])


@query("top_n_per_customer", TASTE_VIEWS, f"""WITH {taste_sql(FINEST)} SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY score DESC, category) AS r FROM profile) WHERE r<=15""")
def _(d):
    return taste.top_n_per_customer(profile(d, FINEST))


# --- re-ranking pieces --------------------------------------------------------------------

@query("unseen_recommendations", TASTE_VIEWS, f"WITH {taste_sql(DIVISION)} SELECT cust_id, category, division_id, division, propensity_rank FROM reranked WHERE next_best_rank IS NOT NULL")
def _(d):
    keys = ["cust_id", *DIVISION.columns]
    return rerank.unseen(deterministic_recs(d, DIVISION), recent(d, DIVISION), keys).select(*DIVISION.keys, "propensity_rank")


@query("next_best_rank", TASTE_VIEWS, f"WITH {taste_sql(FINEST)} SELECT cust_id, category, propensity_rank, next_best_rank FROM reranked WHERE next_best_rank IS NOT NULL")
def _(d):
    left = rerank.unseen(deterministic_recs(d, FINEST), recent(d, FINEST), ["cust_id", *FINEST.columns])
    return rerank.next_best_rank(left).select("cust_id", "category", "propensity_rank", "next_best_rank")


@query("next_best_rank_top_k", TASTE_VIEWS, f"""WITH {taste_sql(FINEST)} SELECT * FROM (SELECT cust_id, category, propensity_rank, CAST(rank() OVER (PARTITION BY cust_id ORDER BY propensity_score DESC) AS INTEGER) AS next_best_rank
 FROM reranked WHERE next_best_rank IS NOT NULL) WHERE next_best_rank<=5""")
def _(d):
    left = rerank.unseen(deterministic_recs(d, FINEST), recent(d, FINEST), ["cust_id", *FINEST.columns])
    return rerank.next_best_rank_top_k(left).select("cust_id", "category", "propensity_rank", "next_best_rank")


@query("attach_rank", TASTE_VIEWS, f"WITH {taste_sql(FINEST)} SELECT cust_id, category, propensity_rank, next_best_rank FROM reranked")
def _(d):
    recs = deterministic_recs(d, FINEST)
    keys = ["cust_id", *FINEST.columns]
    ranked = rerank.next_best_rank(rerank.unseen(recs, recent(d, FINEST), keys))
    return rerank.attach_rank(recs, ranked, keys).select("cust_id", "category", "propensity_rank", "next_best_rank")


def _reranked(d, level: Level):
    return rerank.rerank_unseen(deterministic_recs(d, level), recent(d, level), level)


@query("null_rank_count", TASTE_VIEWS, f"WITH {taste_sql(DIVISION)} SELECT cust_id, count(*) FILTER (next_best_rank IS NULL) AS null_count FROM reranked GROUP BY 1")
def _(d):
    return rerank.null_rank_count(_reranked(d, DIVISION))


@query("publish_window", TASTE_VIEWS, f"""WITH {taste_sql(FINEST)} SELECT cust_id, category, propensity_rank, next_best_rank FROM reranked r
 JOIN (SELECT cust_id AS cid, count(*) FILTER (next_best_rank IS NULL) AS bought FROM reranked GROUP BY 1) b ON r.cust_id=b.cid WHERE propensity_rank<=CASE WHEN bought<10 THEN 10 ELSE 15 END""")
def _(d):
    return rerank.publish_window(_reranked(d, FINEST)).select("cust_id", "category", "propensity_rank", "next_best_rank")


@query("order_recs", TASTE_VIEWS, f"WITH {taste_sql(DIVISION)} SELECT cust_id, category, propensity_rank, next_best_rank FROM reranked ORDER BY cust_id, propensity_rank")
def _(d):
    return rerank.order_recs(_reranked(d, DIVISION), by_rank=True).select("cust_id", "category", "propensity_rank", "next_best_rank")


@query("audit_columns", [], "SELECT c_custkey, TIMESTAMP '2001-08-01 06:00:00' AS record_creation_datetime, TIMESTAMP '2001-08-01 06:00:00' AS record_updated_datetime FROM customer")
def _(d):
    return rerank.audit_columns(d.table("customer").select("c_custkey"), F.lit(STAMP).cast("timestamp_ntz"))


@query("product_key", ["product"], "SELECT DISTINCT designer||' '||class||'_'||designer_id||'_'||designer||'_'||class_id||'_'||class AS product_key FROM product")
def _(d):
    from tastemill.operators.recommend import product_key

    level = LEVELS["designer_class"]
    rows = taste.with_category(d.product().withColumn("cust_id", F.lit(0)), level)
    return rows.select(product_key(level).alias("product_key")).distinct()


# --- ratings -------------------------------------------------------------------------

USABLE = f"""usable AS (SELECT DISTINCT cust_id, web_item_id, date_time, action_type, regular_price FROM clicked WHERE cust_id IS NOT NULL AND cust_id<>-1 AND web_item_id IS NOT NULL
 AND web_item_id<>'-1' AND action_type<>'Other' AND date_time IS NOT NULL AND division_name IS NOT NULL AND {MERCH} AND {WORDS})"""
UNION = f"""{click_sql('', ids=False)}, {USABLE}, actions AS (SELECT cust_id, web_item_id, date_time, 'Purchase' AS action_type, regular_price FROM (SELECT DISTINCT * FROM purchases)
 UNION ALL SELECT cust_id, web_item_id, date_time, action_type, regular_price FROM usable)"""
SUPPORT = f"""{UNION}, supported AS (SELECT * FROM actions WHERE cust_id IN (SELECT cust_id FROM actions GROUP BY 1 HAVING count(*)>3 AND count(*)<=100)
 AND web_item_id IN (SELECT web_item_id FROM actions GROUP BY 1 HAVING count(*)>20 AND count(*)<120)),
 mix AS (SELECT action_type, count(*) AS action_count, count(*)/(SELECT count(*) FROM supported)*100 AS percent_dist FROM supported GROUP BY 1),
 train AS (SELECT DISTINCT cust_id, action_type, web_item_id, CAST(date_time AS DATE) AS day FROM supported)"""
POSITION = """SELECT cust_id, action_type, web_item_id, day, CAST(row_number() OVER w-1 AS INTEGER) AS number_of_events, CAST(count(*) OVER (PARTITION BY cust_id, action_type) AS INTEGER) AS sum_of_events
 FROM {0} WINDOW w AS (PARTITION BY cust_id, action_type ORDER BY day DESC, web_item_id)"""
PU = "CASE WHEN number_of_events=0 THEN CAST(0 AS DOUBLE) ELSE number_of_events/(sum_of_events-1) END AS pu"
RATED = f"""{SUPPORT}, pos AS ({POSITION.format('train')}), pos_pu AS (SELECT *, {PU} FROM pos),
 bands AS (SELECT coalesce(max(percent_dist) FILTER (action_type='Product_Page'),0) AS page, coalesce(max(percent_dist) FILTER (action_type='Cart_Add'),0) AS cart,
 coalesce(max(percent_dist) FILTER (action_type='Purchase'),0) AS bought FROM mix),
 rated AS (SELECT * EXCLUDE (page,cart,bought,hi,lo), hi-(hi-lo)*pu AS rating FROM (SELECT *, CASE action_type WHEN 'Product_Page' THEN page WHEN 'Cart_Add' THEN cart+page ELSE cart+page+bought END AS hi,
 CASE action_type WHEN 'Product_Page' THEN 0 WHEN 'Cart_Add' THEN page ELSE cart+page END AS lo FROM pos_pu, bands))"""
ACTION_VIEWS = ["purchases", *CLICK_VIEWS]


def rating_views(d):
    return click_views(d, known_brand=False, with_ids=False)


def actions(d):
    return ratings.union_actions(d.purchases(), ratings.usable_clicks(rating_views(d)))


def supported(d):
    return ratings.frequency_support_filter(cut(actions(d), "actions"), CUSTOMER_SUPPORT, ITEM_SUPPORT)


def rated(d):
    return ratings.action_ratings(d.purchases(), rating_views(d), CUSTOMER_SUPPORT, ITEM_SUPPORT, SALES_BEGIN, CLICK_END)


@query("usable_click_filter", CLICK_VIEWS, f"WITH {click_sql('', ids=False)}, {USABLE} SELECT * FROM usable")
def _(d):
    return ratings.usable_clicks(rating_views(d))


@query("union_actions", ACTION_VIEWS, f"WITH {UNION} SELECT * FROM actions")
def _(d):
    return actions(d)


@query("frequency_support_filter", ACTION_VIEWS, f"WITH {SUPPORT} SELECT * FROM supported")
def _(d):
    return supported(d)


@query("action_mix", ACTION_VIEWS, f"WITH {SUPPORT} SELECT action_type, action_count, round(percent_dist,6) AS percent_dist FROM mix")
def _(d):
    return ratings.action_mix(supported(d)).withColumn("percent_dist", F.round("percent_dist", 6))


@query("recency_position", ACTION_VIEWS, f"""WITH {UNION}, days AS (SELECT DISTINCT cust_id, action_type, web_item_id, CAST(date_time AS DATE) AS day FROM actions), pos AS ({POSITION.format('days')})
 SELECT * EXCLUDE (pu), round(pu,6) AS pu FROM (SELECT *, {PU} FROM pos)""")
def _(d):
    events = ratings.training_events(actions(d), SALES_BEGIN, CLICK_END)
    return ratings.recency_position(events).withColumn("pu", F.round("pu", 6))


@query("action_ratings", ACTION_VIEWS, f"WITH {RATED} SELECT * REPLACE (round(pu,6) AS pu, round(rating,6) AS rating) FROM rated")
def _(d):
    return rated(d).withColumns({"pu": F.round("pu", 6), "rating": F.round("rating", 6)})


@query("holdout_pairs", ACTION_VIEWS, f"WITH {SUPPORT} SELECT DISTINCT cust_id, web_item_id FROM supported WHERE CAST(date_time AS DATE) BETWEEN DATE '2000-06-01' AND DATE '2024-01-31'")
def _(d):
    return ratings.holdout_pairs(supported(d), dt.date(2000, 6, 1), CLICK_END)


LISTED = f"""{SUPPORT}, pos AS ({POSITION.format('train')}), lists AS (SELECT cust_id, action_type, CAST(number_of_events//40 AS INTEGER) AS chunk,
 list(web_item_id ORDER BY number_of_events) AS items, list(day ORDER BY number_of_events) AS days FROM pos GROUP BY 1,2,3)"""


def _lists(d):
    return ratings.collect_lists(ratings.training_events(supported(d), SALES_BEGIN, CLICK_END), chunk=40)


@query("collect_lists", ACTION_VIEWS, f"WITH {LISTED} SELECT cust_id, action_type, chunk, array_to_string(items,',') AS items, array_to_string(list_transform(days, lambda x: CAST(x AS VARCHAR)),',') AS days FROM lists")
def _(d):
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return _lists(d).select("cust_id", "action_type", "chunk", text_of("items"), text_of("days"))


@query("explode_aligned", ACTION_VIEWS, f"WITH {LISTED} SELECT cust_id, action_type, chunk, unnest(items) AS item, unnest(days) AS day FROM lists")
def _(d):
    return ratings.explode_aligned(_lists(d), {"items": "item", "days": "day"})


@query("combined_rating", TASTE_VIEWS + ["purchases"], f"""WITH best AS (SELECT *, row_number() OVER (PARTITION BY cust_id ORDER BY score DESC, category) AS r
 FROM (WITH {taste_sql(DIVISION)} SELECT * FROM profile)), marks AS (SELECT cust_id, rating FROM (WITH {RATED} SELECT * FROM rated))
 SELECT b.cust_id, category, division_id, division, score, round(coalesce(score+rating,0),6) AS combined_rating FROM best b LEFT JOIN marks t ON b.cust_id=t.cust_id WHERE r<=15""")
def _(d):
    joined = taste.combined_rating(taste.top_n_per_customer(profile(d, DIVISION)), cut(rated(d), "rated"))
    return joined.withColumn("combined_rating", F.round("combined_rating", 6))


@query("brand_exclusion_list", ["product", "excluded_brands", *[v for v in CLICK_VIEWS if v != "product"]], f"""WITH {click_sql()} SELECT cust_id, web_item_id, designer, date_time FROM clicked c
 WHERE NOT EXISTS (SELECT 1 FROM excluded_brands x WHERE x.designer=c.designer)""")
def _(d):
    from tastemill.operators.filters import brand_exclusion_list

    return brand_exclusion_list(click_views(d).select("cust_id", "web_item_id", "designer", "date_time"), d.excluded_brands()).select(
        "cust_id", "web_item_id", "designer", "date_time")
