"""Text rules: click actions, item codes, attribute clean-up, return references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tastemill.functions import fixed


def action_type(page: Column, purchase_id: Column) -> Column:
    """What a click was. The order of the rules and the letter case count."""
    return (
        F.when(page.contains("Cart"), "Cart_Add")
        .when(page == "product detail", "Product_Page")
        .when(purchase_id.isNotNull(), "Purchase")
        .otherwise("Other")
    )


def product_entries(product_list: Column) -> Column:
    """The comma separated entries of a product list."""
    return F.split(product_list, ",")


def entry_field(entry: Column, position: int) -> Column:
    """A semicolon separated field, counted from 0; null when the entry is shorter."""
    return F.get(F.split(entry, ";"), F.lit(position))


def suffix_code(code: Column, length: int = 5) -> Column:
    return F.right(code, F.lit(length))


def concat_key(*parts: Column, sep: str = "") -> Column:
    """Joined text; null as soon as one part is null."""
    pieces = [p.cast("string") for p in parts]
    if sep:
        pieces = [q for p in pieces for q in (F.lit(sep), p)][1:]
    return F.concat(*pieces)


def brand_class(brand: Column, klass: Column, sep: str = " ") -> Column:
    return concat_key(brand, klass, sep=sep)


def division_short_name(name: Column) -> Column:
    rules = reduce(
        lambda acc, rule: acc.when(name.startswith(rule[0]), rule[1]),
        fixed.DIVISION_SHORT_NAMES[1:],
        F.when(name.startswith(fixed.DIVISION_SHORT_NAMES[0][0]), fixed.DIVISION_SHORT_NAMES[0][1]),
    )
    return rules.otherwise(name)


def gender_code(gender: Column) -> Column:
    first = F.left(gender, F.lit(1))
    return F.when(first.isin(*fixed.GENDER_CODES), first).otherwise("N")


def placeholder(text: Column, prefix: str) -> Column:
    """A question mark for texts that only say that nothing is known."""
    return F.when(text.startswith(prefix), "?").otherwise(text)


def color_clean(color: Column) -> Column:
    return placeholder(color, "NO COLO")


def size_clean(size: Column) -> Column:
    return placeholder(size, "NO SIZ")


def brand_clean(brand: Column) -> Column:
    return placeholder(brand, "UNKNOWN")


def location_bucket(name: Column) -> Column:
    return (
        F.when(name.contains("Online"), "online")
        .when(name.contains("Catalog"), "catalog")
        .otherwise(name)
    )


def chain_code(columns: dict[str, Column]) -> Column:
    """Chain of a location from its chain, district, area and region ids."""
    (first_col, first_ids, first_code), *rest = fixed.CHAIN_RULES
    start = F.when(columns[first_col].isin(*first_ids), first_code)
    rules = reduce(lambda acc, r: acc.when(columns[r[0]].isin(*r[1]), r[2]), rest, start)
    return rules.otherwise("Other")


def omni_status(channel_count: Column, channel: Column) -> Column:
    return (
        F.when(channel_count > 1, "Omni")
        .when(channel == "Store", "Store_Only")
        .when(channel == "Online", "Online_Only")
        .when(channel == "Catalog", "Catalog_Only")
    )


def matches_any(text: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """Whether one of the regular expressions is found in the text."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def free_of_words(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    """No word occurs, any case. A null text is neither free nor not: the row drops."""
    return reduce(lambda a, b: a & b, [~text.ilike(f"%{w}%") for w in words])


def two_digit_year_date(digits: Column, first_year: int = 1926) -> Column:
    """A day written MMDDYY; the hundred years from ``first_year`` on are meant."""
    year = F.right(digits, F.lit(2))
    century = F.when(year >= f"{first_year % 100:02d}", str(first_year // 100)).otherwise(str(first_year // 100 + 1))
    return F.try_to_date(F.concat(century, year, F.left(digits, F.lit(4))), "yyyyMMdd")


def return_reference(reference: Column) -> dict[str, Column]:
    """Original store, register, transaction number and date of a returned line."""
    parts = F.split(reference, "/")
    field = lambda i: F.get(parts, F.lit(i))
    return {
        "sale_store": field(0).try_cast("int"),
        "sale_register": field(1).try_cast("int"),
        "sale_tran_no": F.substring(field(2), 4, 4).try_cast("int"),
        "sale_date": two_digit_year_date(field(3)),
    }
