"""The logical retail tables, derived by Spark from the given star schema.

Every table is a lazy projection; nothing is sampled or cut. ``FIXTURES.md`` lists the
definitions, and ``plans/logical.py`` states them again as SQL for the oracle.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions import fixed, text

DIVISION_IDS = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5}
DIVISION_NAMES = (
    "Womens Apparel", "Contemporary", "Childrens", "Gifts and Home", "Ladies Shoes", "Designer Handbags",
    "Fashion Accessories", "Mens", "Beauty", "Jewelry", "Fine Apparel", "Precious", *fixed.EXCLUDED_DIVISION_NAMES,
)
GENDERS = ("Womens", "Unisex", "Mens", "Girls", "Boys", "None")

# Declared schemas: no read infers anything, and no job runs to look at a footer.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_c = F.col


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _pick(values: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _division_id(name: Column) -> Column:
    rules = [(n, i) for n, i in DIVISION_IDS.items()]
    first = F.when(name == rules[0][0], rules[0][1])
    return reduce(lambda acc, r: acc.when(name == r[0], r[1]), rules[1:], first).otherwise(6)


class RetailData:
    """Logical tables over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    # --- products and places -------------------------------------------------------

    def _part_columns(self) -> dict[str, Column]:
        klass = F.split_part(_c("p_name"), F.lit(" "), F.lit(2))
        return {
            "department_id": _c("p_size"),
            "division": _c("p_type"),
            "division_id": _division_id(_c("p_type")),
            "class": klass,
            "class_id": F.ascii(klass) * 100 + F.length(klass),
            "designer": _c("p_brand"),
            "designer_id": F.split_part(_c("p_brand"), F.lit("#"), F.lit(2)).cast("int"),
            "unit_retail": _c("p_retailprice"),
            "class_name": klass,
            "department_name": _text("Dept ", _c("p_size")),
        }

    def product(self) -> DataFrame:
        cols = self._part_columns()
        key = _c("p_partkey")
        return self.table("part").select(
            key.alias("item_id"),
            key.alias("product_key"),
            *[cols[n].alias(n) for n in cols],
            F.when(cols["designer_id"] == 25, "UNKNOWN BRAND").otherwise(_c("p_brand")).alias("brand_name"),
            _text("Sub ", _c("p_size") % 4).alias("subclass"),
            (_c("p_size") % 3).alias("tax_category_id"),
            (_c("p_size") % 20 + 800).cast("string").alias("group_id"),
            _text("Group ", _c("p_size") % 20).alias("group_name"),
            _pick(DIVISION_NAMES, key).alias("division_name"),
            _pick(GENDERS, key).alias("gender"),
            F.when(_c("p_name").startswith("hot "), "NO COLOR").otherwise(F.split_part(_c("p_name"), F.lit(" "), F.lit(1))).alias("color"),
            F.when(_c("p_size") % 10 == 0, "NO SIZE").otherwise(_c("p_size").cast("string")).alias("size"),
            (_c("p_retailprice") * 0.5).alias("initial_cost"),
            _c("p_retailprice").alias("initial_retail"),
        )

    def catalog(self) -> DataFrame:
        key, name = _c("p_partkey"), _c("p_name")
        code = _text(fixed.ITEM_PREFIX, "_", key)
        return self.table("part").select(
            key.alias("catalog_key"),
            code.alias("item_code"),
            text.suffix_code(code).alias("item_suffix"),
            key.alias("item_id"),
            _text("W", key).alias("web_item_id"),
            _text("Web ", name).alias("web_item_name"),
            F.when(key % 7 == 0, _text(name, " ", F.upper(_pick(fixed.EXCLUDED_DESCRIPTION_WORDS, F.floor(key / 7).cast("int"))), " set")).otherwise(name).alias("description"),
            _c("p_retailprice").alias("regular_price"),
            F.when(key % 4 == 0, _c("p_retailprice") * 0.5).otherwise(_c("p_retailprice")).alias("sale_price"),
            _c("p_brand").alias("brand"),
            F.split_part(name, F.lit(" "), F.lit(2)).alias("class"),
        )

    def location(self) -> DataFrame:
        key, region = _c("n_nationkey"), _c("n_regionkey")
        return self.table("nation").select(
            key.alias("location_id"),
            F.when(key != 24, key + 1000).alias("location_no"),
            F.when(region == 0, _text(_c("n_name"), " Online")).when(region == 1, _text(_c("n_name"), " Catalog")).otherwise(_c("n_name")).alias("location_name"),
            (key % 7).alias("chain_id"),
            (key % 6 + 10).alias("area_id"),
            (region + 200).alias("region_id"),
            F.when(key == 6, 12031).otherwise(key % 14 + 13011).alias("district_id"),
        )

    def location_channels(self) -> DataFrame:
        return self.table("nation").select(
            _c("n_nationkey").alias("location_id"),
            _pick(("store", "online", "catalog", "outlet"), _c("n_nationkey")).alias("channel"))

    def store_inventory(self) -> DataFrame:
        key = _c("p_partkey")
        return self.table("part").select(
            key.alias("item_id"), (key % 25).alias("location_id"), _c("p_size").alias("qty"),
            F.when(key % 11 == 0, "TRUE").otherwise("FALSE").alias("block_flag"),
            F.when(key % 5 == 0, "OUTLET").otherwise("STORES").alias("selling_group"))

    def web_inventory(self) -> DataFrame:
        key = _c("p_partkey")
        return self.table("part").select(
            key.alias("item_id"), (_c("p_size") % 7).alias("qty"),
            F.when(key % 9 == 0, "OTHER").otherwise("MAIN").alias("retailer"))

    # --- sales ---------------------------------------------------------------------

    def sales(self, *columns: str, between: tuple[dt.date, dt.date] | None = None) -> DataFrame:
        """Order lines. ``columns`` limits the output and the dimensions joined for it:
        the foreign keys are complete, so a join that feeds no column changes nothing.
        ``between`` also filters the raw order time, which the parquet scan can use."""
        line_cols = {
            "tran_no": _c("l_orderkey"),
            "item_id": _c("l_partkey"),
            "status": F.when(_c("l_returnflag") == "R", "V").otherwise("S"),
            "assoc1": F.when((_c("o_custkey") % 10 == 0) | (_c("l_linenumber") % 3 == 0), F.lit(-1)).otherwise(_c("l_suppkey")).cast("bigint"),
            "assoc2": F.when(_c("l_linenumber") % 2 == 0, _c("l_suppkey") + 1),
            "unit_price": _c("l_extendedprice"),
            "qty": _c("l_quantity").cast("int"),
            "unit_discount": _c("l_discount"),
            "chain": F.when(_c("l_suppkey") % 7 == 0, "SECOND").otherwise("MAIN"),
        }
        order_cols = {
            "cust_id": F.when(_c("o_orderkey") % 101 == 0, F.lit(0).cast("bigint")).otherwise(_c("o_custkey")),
            "trans_date": _c("o_orderdate").cast("date"),
            "channel": F.when(_c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "Store").when(_c("o_orderpriority") == "5-LOW", "Catalog").otherwise("Online"),
        }
        part_cols = self._part_columns()
        place_cols = {"location_id": _c("s_nationkey")}
        every = {**order_cols, **line_cols, **part_cols, **place_cols}
        wanted = list(columns) or list(every)
        orders = self.table("orders")
        if between:
            begin, end = between
            orders = orders.where(
                (_c("o_orderdate") >= F.lit(begin).cast("timestamp_ntz"))
                & (_c("o_orderdate") < F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz")))
        rows = self.table("lineitem").join(orders, _c("l_orderkey") == _c("o_orderkey"))
        of_part = [c for c in wanted if c in part_cols]
        if of_part:
            # What a part says is worked out once a part, not once a line.
            part = self.table("part").select("p_partkey", *[part_cols[c].alias(c) for c in of_part])
            rows = rows.join(part, _c("l_partkey") == _c("p_partkey"))
        if any(c in place_cols for c in wanted):
            rows = rows.join(self.table("supplier"), _c("l_suppkey") == _c("s_suppkey"))
        return rows.select(*[_c(c) if c in part_cols else every[c].alias(c) for c in wanted])

    def register_lines(self) -> DataFrame:
        rows = self.table("lineitem").join(self.table("orders"), _c("l_orderkey") == _c("o_orderkey"))
        return rows.select(
            _c("o_orderdate").alias("tran_time"),
            _c("o_orderdate").cast("date").alias("trans_date"),
            F.when(_c("l_tax") <= 0.06, "SALE").otherwise("VOID").alias("tran_type"),
            F.when(_c("l_tax") > 0.07, "V").when(_c("l_returnflag") == "R", "R").otherwise("S").alias("status"),
            (_c("l_partkey") % 50 + 1).alias("department_id"),
            (_c("l_suppkey") % 25).alias("location_id"),
            _c("l_extendedprice").alias("unit_price"),
            F.when(_c("l_linenumber") == 7, 0).otherwise(_c("l_quantity").cast("int")).alias("qty"),
            F.when(_c("l_suppkey") % 37 == 1, F.lit(-1)).otherwise(_c("l_partkey")).cast("bigint").alias("product_key"),
            F.when(_c("l_linenumber") == 5, F.lit(-1)).otherwise(_c("l_partkey")).cast("bigint").alias("catalog_key"),
            F.when(_c("l_suppkey") % 50 == 0, F.lit(-1)).otherwise(_c("o_custkey")).cast("bigint").alias("customer_key"),
            F.when(_c("l_suppkey") % 9 == 0, _text("XX_", _c("l_partkey"))).otherwise(_text(fixed.ITEM_PREFIX, "_", _c("l_partkey"))).alias("item_code"),
        )

    def purchases(self) -> DataFrame:
        """Valid purchases in the shape of rating events."""
        return self.sales("cust_id", "item_id", "trans_date", "status", "unit_retail").where("status <> 'V'").select(
            "cust_id", _text("W", _c("item_id")).alias("web_item_id"),
            _c("trans_date").cast("timestamp_ntz").alias("date_time"), _c("unit_retail").alias("regular_price"))

    def recent_history(self, begin: dt.date, end: dt.date) -> DataFrame:
        return self.sales("cust_id", "designer_id", "designer", "division_id", "division", "class_id", "class",
                          between=(begin, end)).distinct()

    def returns(self) -> DataFrame:
        rows = self.table("lineitem").join(self.table("orders"), _c("l_orderkey") == _c("o_orderkey"))
        pad = lambda col, n: F.lpad(col.cast("string"), n, "0")
        return rows.select(
            F.when(_c("l_returnflag") == "R", "R").otherwise("S").alias("status"),
            _c("l_suppkey").alias("return_location"),
            _c("l_shipdate").cast("date").alias("return_date"),
            _c("l_extendedprice").alias("unit_price"),
            _c("l_quantity").cast("int").alias("qty"),
            _text(pad(_c("l_suppkey") * 7 % 2000, 4), "/", pad(_c("l_linenumber"), 6), "/001", pad(_c("l_orderkey") % 10000, 4),
                  "/", F.date_format(_c("o_orderdate"), "MMddyy")).alias("reference"),
        )

    def rolling_summary(self) -> DataFrame:
        day = _c("o_orderdate")
        return (
            self.table("orders")
            .groupBy(_c("o_custkey").alias("cust_id"), F.when(_c("o_custkey") % 6 == 0, "SECOND").otherwise("MAIN").alias("chain"),
                     (F.year(day) * 100 + F.month(day)).alias("fiscal_month_end"))
            .agg(F.sum(_c("o_totalprice").cast("decimal(18,2)")).cast("double").alias("rolling_amt"),
                 F.when(F.count("*") > 1, 2).otherwise(1).alias("segment"))
        )

    # --- clicks ----------------------------------------------------------------------

    def _email(self) -> Column:
        return F.when(_c("user_id") % 7 == 0, _text("u", _c("user_id"), "@staff.example.com")).otherwise(
            _text("u", _c("user_id"), "@example.com"))

    def _clicked_by(self) -> Column:
        """The customer behind a user: every thirteenth is unknown, every eleventh has none."""
        return F.when(_c("user_id") % 13 == 12, F.lit(-1).cast("bigint")).when(_c("user_id") % 11 != 10, _c("user_id"))

    def clickstream(self) -> DataFrame:
        kind = _c("event_type")
        item = F.get_json_object("props", "$.k").cast("int")
        # A list of one, opened: later filters on the product list would repeat the JSON parse otherwise.
        return self.table("events").withColumn("k", F.explode(F.array(item))).select(
            "event_id",
            _c("ts").alias("date_time"),
            _c("ts").cast("date").alias("event_date"),
            _text("v", _c("user_id")).alias("visitor_id"),
            F.when(_c("event_id") % 33 != 5, self._email()).alias("email"),
            F.when(kind == "view", "product detail").when(kind == "click", "Shopping Cart").when(kind == "purchase", "order confirmation").otherwise("home").alias("pagename"),
            F.when(kind == "purchase", _c("event_id")).alias("purchase_id"),
            F.when(_c("event_id") % 40 != 7, _text(
                "c;", F.when(_c("event_id") % 21 == 3, "XX_").otherwise(fixed.ITEM_PREFIX + "_"), _c("k"), ";1;", _c("k"),
                ",c;", fixed.ITEM_PREFIX + "_", _c("k") + 1, ";2;", _c("k") + 1)).alias("product_list"),
            F.when(_c("event_id") % 50 == 0, 1).otherwise(0).alias("exclude_hit"),
            F.when(_c("event_id") % 30 == 11, 1).otherwise(0).alias("duplicate_purchase"),
            F.when(_c("event_id") % 6 == 0, "SECOND").otherwise("MAIN").alias("chain"),
        )

    def cookie_map(self) -> DataFrame:
        return self.table("events").where("user_id % 10 <> 9").select(
            _text("v", _c("user_id")).alias("visitor_id"), self._clicked_by().alias("cust_id")).distinct()

    def email_map(self) -> DataFrame:
        return self.table("events").where("user_id % 10 <> 9").select(
            self._email().alias("email"), _c("user_id").alias("cust_id")).distinct()

    # --- customers ---------------------------------------------------------------------

    def customers(self) -> DataFrame:
        return self.table("customer").select(_c("c_custkey").alias("cust_id"), _c("c_custkey").alias("customer_key"))

    def suppression(self) -> DataFrame:
        """Bit strings of 42 characters; positions 2 and 10 are set too, and exclude nobody."""
        key = _c("c_custkey")
        rules = {1: _c("c_nationkey") == 3, 2: key % 5 == 1, 3: key % 61 == 0, 5: key % 67 == 0, 6: key % 71 == 0, 7: key % 29 == 0,
                 10: key % 4 == 3, 42: _c("c_mktsegment") == "MACHINERY"}
        bits = [F.when(rules[p], "1").otherwise("0") if p in rules else F.lit("0") for p in range(1, 43)]
        return self.table("customer").select(key.alias("cust_id"), F.concat(*bits).alias("bits"))

    def customer_source(self) -> DataFrame:
        return self.table("customer").select(
            _c("c_custkey").alias("cust_id"), F.when(_c("c_custkey") % 20 == 0, "DLE").otherwise("STD").alias("source"))

    def customer_metrics(self) -> DataFrame:
        key = _c("c_custkey")
        return self.table("customer").select(
            F.when(key % 53 != 0, key).alias("cust_id"),
            F.when(key % 2 == 0, "Dr").otherwise("Mx").alias("prefix"),
            F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
            F.left("c_mktsegment", F.lit(1)).alias("middle_initial"),
            F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
            _text("L", key % 6).alias("level"),
            ((key % 100) / 100).alias("alive_probability"),
            (key % 12).alias("predicted_purchases"),
            (key % 15).alias("clv_frequency"),
            (key % 365).alias("clv_recency"),
            _c("c_acctbal").alias("clv_monetary_value"),
            (key % 11).alias("cf_segment"),
            (key % 7).alias("cf_segment_start"),
            _text("L", key % 7).alias("cf_rung_ladder"),
            _pick(("New", "Loyal", "Transient"), key).alias("cf_customer_status"),
            _c("c_nationkey").alias("favorite_location_1"),
            ((_c("c_nationkey") + 1) % 25).alias("favorite_location_2"),
            F.when(key % 20 == 0, 1).otherwise(0).alias("dle_flag"),
            (key % 3).alias("associates_l24m"),
            (_c("c_acctbal") * 100).alias("spent_l12m"),
            F.when(_c("c_nationkey") % 5 == 0, "International").otherwise("Domestic").alias("loc_status"),
        )

    def lifecycle(self) -> DataFrame:
        return self.table("orders").select(
            _c("o_custkey").alias("cust_id"), _c("o_totalprice").alias("total_spent"), _text("L", _c("o_orderkey") % 5).alias("level"))

    def segments(self) -> DataFrame:
        key = _c("c_custkey")
        return self.table("customer").select(
            F.when(key % 37 != 0, key).alias("cust_id"),
            F.when(_c("c_acctbal") >= 0, _text("S", key % 9)).alias("segment"),
            F.when(key % 41 != 0, F.floor(_c("c_acctbal") / 1000).cast("int")).alias("net_spend_bin_12m"),
            F.date_add(F.lit(dt.date(2001, 7, 1)), _c("c_nationkey") % 3).alias("extract_date"),
        )

    def relationships(self, as_of: dt.date) -> DataFrame:
        """Net spend and trips per customer and associate; voided lines count negative."""
        lines = self.sales("cust_id", "trans_date", "assoc1", "status", "unit_price", "qty").where("assoc1 <> -1")
        amount = (_c("unit_price") * _c("qty")).cast("decimal(18,2)")
        net = F.when(_c("status") == "V", -amount).otherwise(amount)
        since = lambda days: _c("trans_date") > F.lit(as_of - dt.timedelta(days=days))
        spent = lambda days: F.coalesce(F.sum(F.when(since(days), net)), F.lit(0)).cast("double")
        trips = F.count_distinct(F.when(since(730), _c("trans_date")))
        return lines.groupBy("cust_id", _c("assoc1").alias("assoc_id")).agg(
            spent(365).alias("net_spent_l12m"), spent(730).alias("net_spent_l24m"), trips.alias("l24m_trips"),
            F.when(trips >= 2, "Strong").otherwise("Weak").alias("relationship_l24m"))

    def campaign_sends(self) -> DataFrame:
        day = F.date_format("o_orderdate", "yyyy-MM-dd")
        return self.table("orders").select(
            _c("o_custkey").alias("cust_id"),
            _text("P", _c("o_orderkey") % 100).alias("associate_pin"),
            F.when(_c("o_orderkey") % 17 == 0, "unknown").otherwise(day).alias("start_text"),
            F.date_format(F.date_add(_c("o_orderdate").cast("date"), 7), "yyyy-MM-dd").alias("end_text"))

    def loyalty_tenders(self) -> DataFrame:
        key = _c("c_custkey")
        return self.table("customer").select(
            key.alias("cust_id"),
            _text("T", F.floor(key / 2).cast("bigint")).alias("tender_id"),
            (key * 10).alias("tender_key"),
            F.when(_c("c_mktsegment") == "AUTOMOBILE", "BG").when(_c("c_mktsegment") == "BUILDING", "CHG").otherwise("OTH").alias("tender_type"))

    def tender_emails(self) -> DataFrame:
        order, key = _c("o_orderkey"), _c("o_custkey")
        return self.table("orders").select(
            F.when(order % 13 == 0, "None").when(order % 19 != 0, _text("u", key, "@example.com")).alias("email"),
            _text("T", F.floor(key / 2).cast("bigint")).alias("tender_id"),
            _c("o_orderdate").cast("date").alias("rdate"),
            F.when(_c("o_orderpriority") == "5-LOW", "AM").otherwise("CO").alias("owner"))

    # --- associates ---------------------------------------------------------------------

    def associates(self) -> DataFrame:
        key = _c("s_suppkey")
        return self.table("supplier").select(
            key.alias("assoc_id"),
            _text("P", key).alias("associate_pin"),
            F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
            F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"),
            _text("Dept ", _c("s_nationkey")).alias("department"),
            _c("s_nationkey").alias("department_id"),
            F.when(key % 10 != 9, _c("s_nationkey")).alias("location_id"),
            (key * 3).alias("age_days"),
            _c("s_acctbal").alias("revenue_l12m"),
            (key % 40).alias("transactions_l12m"),
            (key % 30).alias("customers_l12m"),
            (key % 4).alias("customers_l24m"),
            F.when(_c("s_acctbal") > 0, "Active").otherwise("Left").alias("status"),
        )

    def active_associates(self) -> DataFrame:
        return self.associates().where("status = 'Active'").select("assoc_id")

    def excluded_brands(self) -> DataFrame:
        return self.product().where("designer_id % 6 = 0").select("designer").distinct()
