"""Learning operators, and sources and sinks by round trip."""

from __future__ import annotations

from pyspark.sql import Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tastemill.levels import DIVISION, LEVELS, Level
from tastemill.operators import clusters, recommend, rerank, taste
from tastemill.plans.registry import query
from tastemill.plans.taste_queries import (
    STAMP, TASTE_VIEWS, click_views, deterministic_recs, history, profile, publish_sql, recent, rounded_score, taste_sql,
)
from tastemill.session import cut, fresh_folder
from tastemill.sources import tables

# --- recommendation -----------------------------------------------------------------

@query("index_ids", ["sales"], """SELECT cust_id, CAST(row_number() OVER (ORDER BY n DESC, cust_id)-1 AS INTEGER) AS user_id FROM (SELECT cust_id, count(*) AS n FROM sales GROUP BY 1)""")
def _(d):
    return recommend.index_ids(d.sales("cust_id"), ["cust_id"], "user_id")


@query("index_products", ["sales"], """SELECT designer||' '||class AS category, designer_id, designer, class_id, class, CAST(row_number() OVER (ORDER BY n DESC, designer||' '||class, designer_id, designer, class_id, class)-1 AS INTEGER) AS product_id
 FROM (SELECT designer_id, designer, class_id, class, count(*) AS n FROM sales WHERE status<>'V' AND trans_date BETWEEN DATE '1998-07-29' AND DATE '2001-07-28' GROUP BY ALL)""")
def _(d):
    level = LEVELS["designer_class"]
    return recommend.index_ids(taste.trans_by_level(history(d, level), level), level.product_columns, "product_id")


@query("label_encode", [], "SELECT c_name, CAST(row_number() OVER (ORDER BY c_name)-1 AS INTEGER) AS code FROM customer")
def _(d):
    return recommend.label_encode(d.table("customer"), "c_name", "code")


@query("split_train_validation", ["sales"], """SELECT o_orderkey, CAST(CASE WHEN CAST('0x'||substr(md5('7|'||o_custkey||'|'||o_orderkey),1,8) AS BIGINT)<3435973836 THEN 1 ELSE 0 END AS INTEGER) AS in_train FROM orders""")
def _(d):
    orders = d.table("orders").select("o_orderkey", "o_custkey")
    train, validation = recommend.split_train_validation(orders, ["o_custkey", "o_orderkey"])
    mark = lambda df, n: df.select("o_orderkey", F.lit(n).alias("in_train"))
    return mark(train, 1).unionByName(mark(validation, 0))


@query("evaluate", TASTE_VIEWS, f"""WITH {taste_sql(DIVISION)} SELECT round(sqrt(avg((score-prediction)*(score-prediction))),6) AS rmse, round(avg(abs(score-prediction)),6) AS mae, count(*) AS n
 FROM (SELECT score, avg(score) OVER (PARTITION BY category) AS prediction FROM profile)""")
def _(d):
    rows = profile(d, DIVISION)
    means = rows.groupBy("category").agg(F.avg("score").alias("prediction"))
    result = recommend.evaluate(rows.join(means, "category"))
    return result.withColumns({c: F.round(c, 6) for c in ("rmse", "mae")})


def _recommended(d, level: Level):
    return recommend.recommend(profile(d, level, held=True), level)


def split_sql(level: Level) -> str:
    """Profile rows with whether the training share has them, as the hash of the ids says."""
    columns = ", ".join(level.product_columns[1:])
    return f"""{taste_sql(level)}, users AS (SELECT cust_id, row_number() OVER (ORDER BY n DESC, cust_id)-1 AS user_id FROM (SELECT cust_id, count(*) AS n FROM profile GROUP BY 1)),
 goods AS (SELECT category, {columns}, row_number() OVER (ORDER BY n DESC, category, {columns})-1 AS product_id FROM (SELECT category, {columns}, count(*) AS n FROM profile GROUP BY ALL)),
 split AS (SELECT cust_id, product_id, CAST('0x'||substr(md5('7|'||user_id||'|'||product_id),1,8) AS BIGINT)<3435973836 AS in_train
 FROM profile JOIN users USING (cust_id) JOIN goods USING (category, {columns}))"""


def contract_sql(level: Level) -> str:
    """What any model must give: a full list for each customer in the training share."""
    return f"""WITH {split_sql(level)}, known AS (SELECT count(DISTINCT product_id) AS n FROM split WHERE in_train)
 SELECT cust_id, CASE WHEN trained THEN least(15, n) ELSE 0 END AS n_recs, true AS ranks_whole, true AS scores_fall, true AS scores_in_range
 FROM (SELECT cust_id, bool_or(in_train) AS trained FROM split GROUP BY 1), known"""


def complete_sql(level: Level) -> str:
    """The complete form: every customer has a full list."""
    return f"""WITH {taste_sql(level)}, known AS (SELECT count(DISTINCT (category, {", ".join(level.product_columns[1:])})) AS n FROM profile)
 SELECT cust_id, least(15, n) AS n_recs, true AS ranks_whole, true AS scores_fall, true AS scores_in_range FROM (SELECT DISTINCT cust_id FROM profile), known"""


GRID_SQL = """SELECT CAST(r AS INTEGER) AS rank, CAST(g AS DOUBLE) AS reg, true AS errors_ordered, true AS beats_zero
 FROM (VALUES (3),(5)) a(r), (VALUES (0.05),(0.1)) b(g)"""
MOST_RESIDUAL = 1e-3


def recommendation_contract(recs, profile, level: Level):
    """Per customer of a profile: length of the list, whether ranks run 1, 2, 3 ..., whether scores fall
    with them and stay in 1 to 100. A customer without a list is reported with length 0."""
    place, score = F.col("propensity_rank"), F.col("propensity_score")
    before = F.lag("propensity_score").over(Window.partitionBy("cust_id").orderBy("propensity_rank"))
    held = recs.withColumn("_falls", F.coalesce(score <= before, F.lit(True))).groupBy("cust_id").agg(
        F.count("*").alias("n_recs"),
        ((F.min(place) == 1) & (F.max(place) == F.count("*")) & (F.count_distinct(place) == F.count("*"))).alias("ranks_whole"),
        F.min("_falls").alias("scores_fall"),
        F.min(score.between(1, 100)).alias("scores_in_range"))
    joined = profile.select("cust_id").distinct().join(held, "cust_id", "left")
    flags = {c: F.coalesce(c, F.lit(True)) for c in ("ranks_whole", "scores_fall", "scores_in_range")}
    return joined.withColumns({"n_recs": F.coalesce("n_recs", F.lit(0)), **flags})


def tuned(indexed):
    """Errors of the grid on a level's validation share, and the settings it chooses."""
    scores, _users, _products = indexed
    train, validation = recommend.split_train_validation(scores, ["user_id", "product_id"])
    return recommend.tune_als(train, validation)


def grid_contract(d, level: Level):
    """Each pair of the grid once; the errors are in order and smaller than those of a model that says 0."""
    tastes = cut(profile(d, level, held=True), "profile")
    nothing = tastes.agg(F.sqrt(F.avg(F.col("score") * F.col("score")))).scalar()
    grid = tuned(recommend.indexed_scores(tastes, level))[0]
    return grid.select("rank", "reg", ((F.col("mae") > 0) & (F.col("rmse") >= F.col("mae"))).alias("errors_ordered"), (F.col("rmse") < nothing).alias("beats_zero"))


def published(d, level: Level):
    stamp = F.lit(STAMP).cast("timestamp_ntz")
    return rerank.publish(rerank.rerank_unseen(deterministic_recs(d, level), recent(d, level), level), stamp)


COMPLETE = recommend.ALSSettings(refit_on_all=True)


def _register_level(level: Level) -> None:
    @query(f"recommend_{level.name}")
    def _(d):
        return _recommended(d, level)

    @query(f"recommend_{level.name}_contract", TASTE_VIEWS, contract_sql(level))
    def _(d):
        tastes = cut(profile(d, level, held=True), "profile")
        return recommendation_contract(recommend.recommend(tastes, level), tastes, level)

    @query(f"recommend_{level.name}_for_all_contract", TASTE_VIEWS, complete_sql(level))
    def _(d):
        tastes = cut(profile(d, level, held=True), "profile")
        return recommendation_contract(recommend.recommend(tastes, level, COMPLETE), tastes, level)

    @query(f"fit_als_residual_{level.name}", TASTE_VIEWS, f"WITH {split_sql(level)} SELECT cust_id, count(*) AS n_ratings, true AS solved FROM split WHERE in_train GROUP BY 1")
    def _(d):
        """Every trained customer's factors solve the ridge equations of the customer's scores."""
        scores, users, _products = recommend.indexed_scores(profile(d, level, held=True), level)
        train, _ = recommend.split_train_validation(scores, ["user_id", "product_id"])
        left = recommend.als_residuals(recommend.fit_als(train), train)
        return left.join(users, "user_id").select("cust_id", "n_ratings", (F.col("residual") < MOST_RESIDUAL).alias("solved"))

    @query(f"tune_als_{level.name}", [], GRID_SQL)
    def _(d):
        return grid_contract(d, level)

    @query(f"publish_and_load_{level.name}", TASTE_VIEWS, publish_sql(level).replace("SELECT r.* REPLACE", "SELECT 0 AS n_rejected, r.* REPLACE"))
    def _(d):
        """Rule, gzip file, then a refresh of the table that is there, with the rejects counted."""
        rows, table = published(d, level), f"tastemill_published_{level.name}"
        path = fresh_folder(d.spark, "publish")
        tables.write_csv_gz(rows, path, header=False)
        d.spark.sql(f"DROP TABLE IF EXISTS {table}")
        tables.create_table_as(rows.limit(0), table, path=fresh_folder(d.spark, "publish-table"))
        seen = Observation("load")
        loaded, _bad = tables.full_refresh_load(d.spark, path, table, rows.schema, seen=seen)
        return rounded_score(loaded.withColumn("n_rejected", F.lit(seen.get["n_rejected"])))


for _level in LEVELS.values():
    _register_level(_level)


@query("recommend_division_for_all")
def _(d):
    """The complete form: the model is fitted on every score, so each customer gets a list."""
    return recommend.recommend(profile(d, DIVISION, held=True), DIVISION, COMPLETE)


@query("recommend_tuned_class_contract", TASTE_VIEWS, contract_sql(LEVELS["class"]))
def _(d):
    """The lists of the model whose settings the grid has chosen."""
    level = LEVELS["class"]
    tastes = cut(profile(d, level, held=True), "profile")
    indexed = recommend.indexed_scores(tastes, level)
    return recommendation_contract(recommend.recommend(tastes, level, tuned(indexed)[1], indexed=indexed), tastes, level)


@query("category_recommendations")
def _(d):
    """All steps for one level: profile, model, re-rank, publish."""
    level = LEVELS["class"]
    recs = rerank.rerank_unseen(_recommended(d, level), recent(d, level), level)
    return rerank.publish(recs, F.lit(STAMP).cast("timestamp_ntz"))


@query("tune_als")
def _(d):
    return tuned(recommend.indexed_scores(profile(d, DIVISION, held=True), DIVISION))[0]


@query("tune_als_contract", [], GRID_SQL)
def _(d):
    return grid_contract(d, DIVISION)


@query("open_recommendations", TASTE_VIEWS, f"WITH {taste_sql(DIVISION)} SELECT cust_id AS user_id, division_id AS product_id, propensity_rank, rank_implicit AS propensity_score FROM best WHERE propensity_rank<=15")
def _(d):
    """Every customer's 15 highest implicit ranks, packed into a list as the model packs its own, and opened."""
    counts = taste.taste_counts(click_views(d), history(d, DIVISION), DIVISION)
    best = taste.top_n_per_customer(taste.with_implicit_rank(counts), 15, "rank_implicit", place="place")
    entry = F.struct("place", F.col("division_id").alias("product_id"), F.col("rank_implicit").alias("rating"))
    packed = best.groupBy(F.col("cust_id").alias("user_id")).agg(F.sort_array(F.collect_list(entry)).alias("recommendations"))
    return recommend.open_recommendations(packed)


# --- clusters --------------------------------------------------------------------------

@query("cluster_means", [], "SELECT c_nationkey AS cluster, round(avg(c_acctbal),4) AS mean_value FROM customer GROUP BY 1")
def _(d):
    rows = d.table("customer").select(F.col("c_nationkey").alias("cluster"), "c_acctbal")
    return clusters.cluster_means(rows, "cluster", "c_acctbal").withColumn("mean_value", F.round("mean_value", 4))


@query("relabel_clusters", [], """SELECT c_custkey, c_acctbal, CAST(r AS INTEGER) AS cluster FROM customer JOIN (SELECT c_nationkey AS k, row_number() OVER (ORDER BY avg(c_acctbal) DESC, c_nationkey)-1 AS r FROM customer GROUP BY 1) ON c_nationkey=k""")
def _(d):
    rows = d.table("customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("cluster"))
    return clusters.relabel_clusters(rows, "cluster", "c_acctbal", ascending=False)


@query("single_cluster_spread", [], "SELECT CAST(1 AS INTEGER) AS k, round(var_pop(p_size)*count(p_size),3) AS within_ss FROM part")
def _(d):
    return clusters.single_cluster_spread(d.table("part"), "p_size").withColumn("within_ss", F.round("within_ss", 3))


@query("kmeans_elbow")
def _(d):
    return clusters.kmeans_elbow(d.table("part"), "p_size")


@query("kmeans_elbow_contract", [], """SELECT CAST(k AS INTEGER) AS k, CASE WHEN k=1 THEN (SELECT round(var_pop(p_size)*count(p_size),3) FROM part) END AS first_ss, true AS falls
 FROM range(1,10) t(k)""")
def _(d):
    """Every k once, the exact spread of one cluster, and squares that fall with k."""
    place = Window.orderBy("k")  # nine rows
    ss = F.col("within_ss")
    found = clusters.kmeans_elbow(d.table("part"), "p_size")
    return found.select("k", F.when(F.col("k") == 1, F.round(ss, 3)).alias("first_ss"), F.coalesce((ss >= 0) & (ss < F.lag(ss).over(place)), F.lit(True)).alias("falls"))


@query("cluster_feature_separated", [], "SELECT c_custkey, CAST((c_nationkey%3)*1000+c_custkey%7 AS DOUBLE) AS place, CAST(c_nationkey%3 AS INTEGER) AS place_cluster FROM customer")
def _(d):
    """Groups so far apart that every sound clustering finds them: SQL knows the labels."""
    place = (F.col("c_nationkey") % 3 * 1000 + F.col("c_custkey") % 7).cast("double")
    return clusters.cluster_feature(d.table("customer").select("c_custkey", place.alias("place")), "place", 3)


@query("kmeans_fixed_point", [], "SELECT CAST(k AS INTEGER) AS k, CAST(k AS INTEGER) AS n_clusters, true AS nearest, true AS centred FROM range(2,10) t(k)")
def _(d):
    """Two to nine clusters of the sizes: each value lies nearest to its own cluster's mean, each centre at it."""
    found = clusters.fixed_points(d.table("part"), "p_size", list(range(2, 10)))
    return found.select("k", "n_clusters", (F.col("n_astray") == 0).alias("nearest"), (F.col("off") < 1e-2).alias("centred"))


@query("cluster_feature_fixed_point", [], "SELECT CAST(k AS INTEGER) AS k, CAST(k AS INTEGER) AS n_clusters, true AS nearest, true AS centred FROM range(2,10) t(k)")
def _(d):
    """The same on balances, which hardly repeat: none of a thousand lies nearer to another mean."""
    found = clusters.fixed_points(d.table("customer"), "c_acctbal", list(range(2, 10)))
    values = d.table("customer").agg(F.count_distinct("c_acctbal")).scalar()
    return found.select("k", "n_clusters", (F.col("n_astray") * 1000 <= values).alias("nearest"), (F.col("off") < 1).alias("centred"))


@query("cluster_feature")
def _(d):
    return clusters.cluster_feature(d.table("customer").select("c_custkey", "c_acctbal"), "c_acctbal", 4)


# --- sources and sinks: written to the shared folder and read back ------------------------

CUSTOMER = StructType([
    StructField("c_custkey", LongType()), StructField("c_name", StringType()), StructField("c_nationkey", IntegerType()),
    StructField("c_acctbal", DoubleType()), StructField("c_mktsegment", StringType()),
])
CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_TEXT = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
 c_mktsegment FROM customer"""
NAME_SQL = "CASE WHEN c_custkey%7=0 THEN c_name||' and company' ELSE c_name END"


@query("read_relation_distinct", [], "SELECT DISTINCT * FROM lineitem")
def _(d):
    rows = d.table("lineitem").withColumnsRenamed({"l_orderkey": "L_OrderKey", "l_linenumber": "L_LineNumber"})
    rows.createOrReplaceTempView("tastemill_lines")
    return tables.read_relation(d.spark, "tastemill_lines")


@query("read_relation_with_duplicates", [], "SELECT * FROM lineitem")
def _(d):
    rows = d.table("lineitem").withColumnsRenamed({"l_orderkey": "L_OrderKey", "l_linenumber": "L_LineNumber"})
    rows.createOrReplaceTempView("tastemill_lines_all")
    return tables.read_relation(d.spark, "tastemill_lines_all", distinct=False)


@query("csv_round_trip", [], "SELECT c_custkey, c_acctbal FROM customer")
def _(d):
    path = fresh_folder(d.spark, "csv")
    tables.write_csv(d.table("customer"), path)
    return tables.read_csv(d.spark, path, CUSTOMER, ["c_custkey", "c_acctbal"])


@query("csv_gz_round_trip", [], CUSTOMER_TEXT)
def _(d):
    path = fresh_folder(d.spark, "csv-gz")
    rows = d.table("customer")
    tables.write_csv_gz(rows, path)
    return tables.read_csv_gz(d.spark, path, rows.columns)


@query("delimited_round_trip", [], CUSTOMER_SQL)
def _(d):
    path = fresh_folder(d.spark, "delimited")
    tables.write_csv_gz(d.table("customer"), path, sep="|", header=False)
    return tables.read_delimited(d.spark, path, CUSTOMER)


@query("parquet_round_trip", [], "SELECT * FROM orders")
def _(d):
    path = fresh_folder(d.spark, "parquet")
    tables.write_parquet(d.table("orders"), path, partition_by=["o_orderpriority"])
    return tables.read_parquet_dataset(d.spark, path)


@query("single_csv_round_trip", [], "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(d):
    path = fresh_folder(d.spark, "single")
    rows = d.table("nation")
    tables.write_single_csv(rows, path, gzip=True, header=True)
    return tables.read_csv(d.spark, path, rows.schema)


@query("create_table_as", [], CUSTOMER_SQL)
def _(d):
    name = "tastemill_customer"
    tables.create_table_as(d.table("customer"), name, path=fresh_folder(d.spark, "table"))
    return tables.create_table_as(d.table("customer"), name, refresh=False)


@query("full_refresh_load", [], """SELECT CASE WHEN c_custkey%10<>0 THEN c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, c_custkey%10=0 AS rejected FROM customer""")
def _(d):
    """A table that holds other rows is emptied and filled from a file in which every tenth key is unreadable."""
    path, key = fresh_folder(d.spark, "refresh"), F.col("c_custkey")
    tables.write_csv_gz(d.table("customer").withColumn("c_custkey", F.when(key % 10 == 0, F.concat(F.lit("no. "), key)).otherwise(key.cast("string"))), path)
    d.spark.sql("DROP TABLE IF EXISTS tastemill_refresh")
    tables.create_table_as(d.table("customer").where("c_custkey % 2 = 0"), "tastemill_refresh", path=fresh_folder(d.spark, "refresh-table"))
    loaded, bad = tables.full_refresh_load(d.spark, path, "tastemill_refresh", CUSTOMER, header=True)
    return loaded.withColumn("rejected", F.lit(False)).unionByName(bad.drop(tables.BAD).withColumn("rejected", F.lit(True)))


@query("load_as_strings", [], f"SELECT *, length(c_name)>18 AS rejected FROM ({CUSTOMER_TEXT.replace('c_name,', NAME_SQL + ' AS c_name,')})")
def _(d):
    """Names of every seventh customer are too wide and come back as rejects."""
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" and company"))).otherwise(F.col("c_name"))
    loaded, wide = tables.load_as_strings(d.table("customer").withColumn("c_name", name), "tastemill_text", width=18, path=fresh_folder(d.spark, "text-table"))
    return loaded.withColumn("rejected", F.lit(False)).unionByName(wide.withColumn("rejected", F.lit(True)))


@query("copy_dataset", [], CUSTOMER_SQL)
def _(d):
    source, target = fresh_folder(d.spark, "copy-from"), fresh_folder(d.spark, "copy-to")
    tables.write_csv(d.table("customer"), source)
    tables.copy_dataset(d.spark, source, target, CUSTOMER)
    return tables.read_csv(d.spark, target, CUSTOMER)
