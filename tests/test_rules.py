"""Rules that a query must not have: putting them back changes its rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tastemill.functions import fixed
from tastemill.levels import LEVELS
from tastemill.operators import filters, sales
from tastemill.plans.registry import DEPARTMENTS, SALES_BEGIN, SALES_END, base_sales, dated_sales
from tastemill.plans.taste_queries import history


@pytest.mark.parametrize(("loose", "strict"), [
    ({"divisions": ()}, {}),
    ({"chain": None, "divisions": ()}, {"divisions": ()}),
])
def test_each_base_rule_bites(data, loose, strict):
    columns = ("cust_id", "trans_date", "item_id")
    assert base_sales(data, *columns, **loose).count() > base_sales(data, *columns, **strict).count()


def test_price_points_include_voided_and_anonymous_lines(data):
    assert dated_sales(data, "status").where("status = 'V'").count() > 0
    assert dated_sales(data, "item_id").count() > base_sales(data, "item_id").count()


def test_channel_revenue_has_all_divisions(data):
    lines = base_sales(data, "cust_id", "trans_date", "channel", "unit_price", "qty", divisions=())
    fewer = base_sales(data, "cust_id", "trans_date", "channel", "unit_price", "qty")
    total = lambda df: sales.daily_channel_revenue(df, data.customers(), ["Catalog", "Online", "Store"]).agg(F.sum("total")).first()[0]
    assert total(lines) > total(fewer)


def test_exact_spend_keeps_cents(data):
    lines = base_sales(data, "cust_id", "trans_date", "tran_no", "unit_price", "qty")
    spent = lambda whole: sales.daily_customer_spend(lines, data.customers(), data.suppression(), whole).agg(F.sum("total_spent")).first()[0]
    assert float(spent(False)) > float(spent(True))


@pytest.mark.parametrize("position", fixed.SUPPRESSION_POSITIONS)
def test_each_suppression_position_alone_excludes_somebody(data, position):
    others = [p for p in fixed.SUPPRESSION_POSITIONS if p != position]
    alone = data.suppression().where(F.substring("bits", position, 1) == "1")
    assert alone.where(" AND ".join(f"substring(bits, {p}, 1) = '0'" for p in others)).count() > 0


def test_other_bits_exclude_nobody(data):
    bits = data.suppression().where("substring(bits, 2, 1) = '1' OR substring(bits, 10, 1) = '1'")
    assert bits.where(~filters.is_suppressed(F.col("bits"))).count() > 0


@pytest.mark.parametrize("broken", ["email IS NULL", "product_list IS NULL", "exclude_hit = 1", "duplicate_purchase = 1", "chain <> 'MAIN'",
                                    "event_date > DATE'2024-01-27'", "NOT contains(split_part(product_list, ',', 1), 'NM_')"])
def test_each_click_rule_bites(data, broken):
    """For every rule there are clicks that break it and no other."""
    fine = {"email IS NULL", "product_list IS NULL", "exclude_hit = 1", "duplicate_purchase = 1", "chain <> 'MAIN'"} - {broken}
    assert data.clickstream().where(broken).where(" AND ".join(f"NOT ({rule})" for rule in fine)).count() > 0


def test_every_word_and_division_occurs(data):
    catalog, product = data.catalog(), data.product()
    for word in fixed.EXCLUDED_DESCRIPTION_WORDS:
        hit = F.lower("description").contains(word)
        others = [w for w in fixed.EXCLUDED_DESCRIPTION_WORDS if w not in word]
        assert catalog.where(hit).where(~F.lower("description").rlike("|".join(others))).count() > 0, word
    for name in fixed.EXCLUDED_DIVISION_NAMES:
        assert product.where((F.col("division_name") == name) & (F.col("group_id") != fixed.EXCLUDED_GROUP)).count() > 0, name


def test_unknown_customers_and_products_occur(data):
    assert data.cookie_map().where("cust_id = -1").count() > 0 and data.cookie_map().where("cust_id IS NULL").count() > 0
    assert data.sales("cust_id").where("cust_id = 0").count() > 0
    assert data.register_lines().where("product_key = -1 AND customer_key <> -1 AND catalog_key <> -1").count() > 0


def test_revenue_leaves_voided_lines_and_departments_out(data):
    lines = data.register_lines()
    total = lambda rows, out: sales.daily_revenue(rows, data.customers(), data.location(), begin=SALES_BEGIN, end=SALES_END, departments=out).agg(F.sum("revenue")).first()[0]
    assert total(lines.withColumn("status", F.lit("S")), DEPARTMENTS) > total(lines, DEPARTMENTS)
    assert total(lines, (-1,)) > total(lines, DEPARTMENTS)


def test_history_is_three_years(data):
    level = LEVELS["division"]
    assert 0 < history(data, level).count() < data.sales("status").where("status <> 'V'").count()
