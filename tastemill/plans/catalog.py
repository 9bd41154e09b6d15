"""Everything that is registered."""

from __future__ import annotations

from tastemill.plans import model_queries, people_queries, sales_queries, scalar_queries, taste_queries  # noqa: F401
from tastemill.plans.registry import QUERIES, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return {name: q.oracle for name, q in QUERIES.items() if q.oracle}
