"""Registered queries of the engine and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base import Family
from .changes import F5
from .relational import F1
from .scalar import F3
from .statements import F6
from .search import F4
from .windows import F2

_MAIN = Family()
_MAIN.same(
    "agg_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, CAST(count(*) AS BIGINT) AS count_order
    FROM {lineitem} WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
)
_FAMILIES = (_MAIN, F1, F2, F3, F4, F5, F6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for f in _FAMILIES for k, v in f.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for f in _FAMILIES for k, v in f.oracles.items()}
