"""The registered queries: a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.dates import run_windows
from tastemill.plans.logical import with_views
from tastemill.session import bound_tasks, configure
from tastemill.sources.retail import SCHEMAS, RetailData

# Parameters of the runs on the given tables.
AS_OF = dt.date(2001, 8, 1)
SALES_BEGIN, SALES_END = dt.date(1995, 1, 1), AS_OF
CLICKS_AS_OF = dt.date(2024, 1, 31)
HISTORY, RECENT = (run_windows(AS_OF)[w] for w in ("history", "recent"))
CLICK_BEGIN, CLICK_END = run_windows(CLICKS_AS_OF)["browse"]
CHAIN = "MAIN"
DEPARTMENTS = (7, 13, 21)
DIVISIONS = (3,)
CUSTOMER_SUPPORT = (3, 100)
ITEM_SUPPORT = (20, 120)

# The same windows for the oracles: three years of sales, 30 days of sales and 49 days of clicks up to the last Saturday.
HISTORY_SQL = "trans_date BETWEEN DATE '1998-07-29' AND DATE '2001-07-28'"
RECENT_SQL = "trans_date BETWEEN DATE '2001-06-28' AND DATE '2001-07-28'"
CLICKS_SQL = "event_date BETWEEN DATE '2023-12-09' AND DATE '2024-01-27'"

# The base filters as SQL, for oracles that start from sales lines: with the division rule,
# without it, and by date and chain alone.
_DATED = "SELECT * FROM sales WHERE trans_date BETWEEN DATE '1995-01-01' AND DATE '2001-08-01'"
_VALID = "status<>'V' AND cust_id<>0 AND department_id NOT IN (7,13,21)"
BASE = f"base AS ({_DATED} AND {_VALID} AND chain='MAIN' AND division_id<>3)"
BASE_ALL_DIVISIONS = f"base AS ({_DATED} AND {_VALID} AND chain='MAIN')"
BASE_DATED = f"base AS ({_DATED} AND chain='MAIN')"
# Lines of existing customers that may be contacted.
REACHABLE = "cust_id IN (SELECT cust_id FROM customers) AND NOT EXISTS (SELECT 1 FROM suppressed z WHERE z.cust_id={0}.cust_id)"


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[RetailData], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        data = RetailData(configure(spark), root)
        bound_tasks(spark, (f"{data.root}/{table}.parquet" for table in SCHEMAS))
        return self.run(data)


QUERIES: dict[str, Query] = {}


def query(name: str, views: tuple[str, ...] | list[str] = (), sql: str | None = None):
    """Register a query; ``sql`` is its oracle over the named logical tables."""

    def add(run: Callable[[RetailData], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, with_views(list(views), sql) if sql else None)
        return run

    return add


def base_sales(d: RetailData, *columns: str, chain: str | None = CHAIN, divisions: tuple = DIVISIONS) -> DataFrame:
    """Sales lines under the base filter of a query, reduced to what the query reads."""
    from tastemill.operators.filters import sales_base_filter

    needed = ["cust_id", "trans_date", "status", "department_id", *(["chain"] if chain else []), *(["division_id"] if divisions else [])]
    wanted = [*columns, *[c for c in needed if c not in columns]]
    lines = d.sales(*wanted, between=(SALES_BEGIN, SALES_END))
    return sales_base_filter(lines, SALES_BEGIN, SALES_END, chain, DEPARTMENTS, divisions).select(*columns)


def dated_sales(d: RetailData, *columns: str) -> DataFrame:
    """All sales lines of the chain in the date range, voided and anonymous ones included."""
    wanted = [*columns, *[c for c in ("trans_date", "chain") if c not in columns]]
    lines = d.sales(*wanted, between=(SALES_BEGIN, SALES_END))
    return lines.where(F.col("trans_date").between(F.lit(SALES_BEGIN), F.lit(SALES_END)) & (F.col("chain") == CHAIN)).select(*columns)
