"""All registered queries of the reference operators and their SQL counterparts."""

from __future__ import annotations

from kvflow.plans import file_queries  # noqa: F401  (registers its queries)
from kvflow.plans.queries import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
