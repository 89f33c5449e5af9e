"""Registered queries: a Spark function for each name, and SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slopewatch.functions.common import rounded
from slopewatch.plans.bindings import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def nudge(places: int) -> float:
    """Added before rounding on both sides: means of short decimals often end in an exact half, which would fall either way."""
    return 0.017 * 10.0**-places


def query(name: str, sql: str | None = None, places: int = 6):
    """Registers f(tables) -> DataFrame. Doubles are rounded on both sides, to six places by default; sql may name
    the bound views."""

    def add(f: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # tables are dealt by site; joins on the site and more keys take them as they lie
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            return rounded(f(Tables(spark, sf_dir)), places, nudge(places))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            # `round(x, 6)` gets the nudge; the end of a list of grouped columns is left alone
            ORACLE[name] = with_views(re.sub(r"(GROUP BY [\d, ]+)?, 6\)", lambda m: m[0] if m[1] else f" + {nudge(places)!r}, {places})", sql))
        return f

    return add
