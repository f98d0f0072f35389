"""The query registry and small staging helpers shared by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import kept, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STAGED: dict[tuple[str, str, str], object] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object]):
    """Staging tables that several queries read are written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        value = build()
        _STAGED[key] = kept(value) if isinstance(value, DataFrame) else value
    return _STAGED[key]


def is_staged(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _STAGED


def forget() -> None:
    """Drop the staging references (the bench uses it to time cold runs)."""
    _STAGED.clear()


def secs(c: str) -> Column:
    return F.unix_seconds(c).cast("bigint")


def big(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def r6(c, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def joined(c: Column) -> Column:
    return F.concat_ws(",", c.cast("array<string>"))
