"""Where queries and their SQL are registered."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.plans.views import with_views
from pixelseries.streaming.arrivals import work_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, *views: str, dates: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL over the named views. Dates are returned as ISO strings."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = lambda s, d: f(s, d).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})
        if sql:
            text = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates)
            ORACLES[f.__name__] = with_views(f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql, *views)
        return f

    return add


def r6(c: Column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def place(s: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{work_folder(s)}/{name}-{uuid.uuid4().hex}"
