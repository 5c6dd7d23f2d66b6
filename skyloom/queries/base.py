"""Registration of runnable queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.sources import derived

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(ids: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its function name.

    ``ids`` are the inventory rows it shows, ``views`` the derived tables that
    the SQL text uses.
    """

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        OPERATORS[fn.__name__] = ids
        if sql is not None:
            ORACLES[fn.__name__] = derived.with_views(sql, *views)
        return fn

    return add


def dbl(value: float) -> str:
    """A double literal that SQL engines read without rounding."""
    text = repr(float(value))
    return text if "e" in text else text + "e0"


def r(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


# A reproducible order over observations that plain SQL can state as well.
ORDER_RANGE = 1_000_003
ORDER_SQL = (
    "(l_orderkey * 7919 + l_linenumber * 104729 + loc_id * 1299709 + image_id * 15485863)"
    f" % {ORDER_RANGE}"
)
OBS_TIES = ["l_orderkey", "l_linenumber", "loc_id", "image_id", "l_extendedprice", "ts",
            "l_quantity", "l_discount", "l_tax"]
