"""Registration of a query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .derived import DUCK, ctes, load, spelled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None, more: str = ""):
    """Register ``f(table, ...)`` under a name.

    ``sql`` selects from the derived tables of the same names, and from those
    that ``more`` defines.
    """

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*load(spark, sf_dir, *tables))
        if sql:
            defined = [c for c in (ctes(*tables), more) if c]
            ORACLES[name] = spelled(("WITH RECURSIVE " + ",\n".join(defined) + "\n" if defined else "") + sql, DUCK)
        return f

    return register
