"""Registry of named queries: a Spark builder and (optionally) an equivalent oracle SQL.

Each query runs a library operator over the domain views of one driver-table directory.
The oracle SQL is written independently against the same views (DuckDB dialect) and is
used only to check results.
"""
from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import Domain, cte_prefix

_DOMAINS: dict = {}


MATERIALIZE = True


def domain_for(spark: SparkSession, sf_dir: str) -> Domain:
    """One Domain per (session, directory), its tables materialised on first use."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _DOMAINS:
        _DOMAINS.clear()
        _DOMAINS[key] = Domain(spark, sf_dir, materialize=MATERIALIZE)
    return _DOMAINS[key]


QUERIES: "OrderedDict[str, Callable[[SparkSession, str], DataFrame]]" = OrderedDict()
ORACLES: "OrderedDict[str, str]" = OrderedDict()


def register(name: str, views: tuple[str, ...] = (), oracle: str | None = None):
    """Decorator: ``fn(domain) -> DataFrame`` becomes ``QUERIES[name](spark, sf_dir)``.

    The oracle text follows the domain-view CTEs: it starts with ``SELECT`` or with
    ``, extra AS (...)`` for further CTEs."""
    def deco(fn: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(domain_for(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = (cte_prefix(views) + "\n" + oracle.strip()) if views else oracle.strip()
        return fn
    return deco


def r2(expr: str) -> str:
    """Oracle-side half-up rounding to 2 decimals of the double's decimal text - the rule
    Spark's ``round`` (and PostgreSQL numeric) follow; DuckDB's double ``round`` does not."""
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,20)), 2) AS DOUBLE)"


def r2e(expr: str) -> str:
    """As ``r2`` with ties to the even digit."""
    return f"CAST(round_even(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,20)), 2) AS DOUBLE)"


def pct(num: str, den: str) -> str:
    return r2(f"100.0 * CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0)")
