"""Ordered prefix scans that never put a whole key into one task.

A plain window over ``partitionBy(key)`` sorts every row of a key in a single task, so one key
holding a third of the rows becomes the job. Here a key is cut by a coarse bucket of its order
column (an hour, a day): the window runs inside (key, bucket), each bucket is folded to one
summary row, the summaries are scanned (one row per key and bucket) and the carried-in value is
joined back. The rows equal the plain window's, null keys included, so which of the two plans runs is a
matter of cost alone: plain windows while no key is large (the largest key is counted first, or the
caller passes what it already knows), the cut above.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut

BUCKET = "__bucket"
SPLIT_ABOVE = 2_000_000   # rows of one key a single task may sort


def has_large_key(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """True when some key holds more rows than one task should get (a map-side combined count)."""
    cap = SPLIT_ABOVE if limit is None else limit
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")) if keys else df.agg(F.count("*").alias("n"))
    return not counted.filter(F.col("n") > cap).isEmpty()



@dataclass(frozen=True)
class Carry:
    """One running value: ``how`` is sum, max, min, last or first (nulls are skipped)."""

    name: str
    how: str
    col: Column
    inclusive: bool = True


def _agg(how: str, value: Column, pos: Column) -> Column:
    if how == "sum":
        return F.sum(value)
    if how == "max":
        return F.max(value)
    if how == "min":
        return F.min(value)
    at = F.when(value.isNotNull(), pos)
    return F.max_by(value, at) if how == "last" else F.min_by(value, at)


def _windowed(how: str, value: Column, w) -> Column:
    if how == "sum":
        return F.sum(value).over(w)
    if how == "max":
        return F.max(value).over(w)
    if how == "min":
        return F.min(value).over(w)
    if how == "last":
        return F.last(value, ignorenulls=True).over(w)
    return F.first(value, ignorenulls=True).over(w)


def _combine(how: str, before: Column, here: Column) -> Column:
    if how == "sum":
        return F.coalesce(before + here, before, here)
    if how == "max":
        return F.greatest(before, here)
    if how == "min":
        return F.least(before, here)
    return F.coalesce(here, before) if how == "last" else F.coalesce(before, here)


def prefix_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, carries: Sequence[Carry],
    split: bool | None = None,
) -> DataFrame:
    """Add running values per ``keys`` in ``order``; ``bucket`` must not decrease along the order.

    ``split``: True cuts keys by bucket, False uses plain windows, None decides by the largest key.
    """
    keys = list(keys)
    if split is None:
        split = has_large_key(df, keys)
    if not split:
        whole = Window.partitionBy(*keys).orderBy(*order)
        upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = whole.rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[_windowed(c.how, c.col, upto if c.inclusive else before).alias(c.name) for c in carries])
    base = cut(df).withColumn(BUCKET, bucket)
    for i, c in enumerate(carries):
        base = base.withColumn(f"__v{i}", c.col)
    pos = F.struct(*[F.col(o) for o in order])
    local = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    summary = base.groupBy(*keys, BUCKET).agg(
        *[_agg(c.how, F.col(f"__v{i}"), pos).alias(f"__s{i}") for i, c in enumerate(carries)]
    )
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate([*keys, BUCKET])],
        *[_windowed(c.how, F.col(f"__s{i}"), earlier).alias(f"__c{i}") for i, c in enumerate(carries)],
    )
    here = base.select(
        "*",
        *[_windowed(c.how, F.col(f"__v{i}"), upto if c.inclusive else before).alias(f"__l{i}")
          for i, c in enumerate(carries)],
    )
    # a null key or bucket is a key or bucket like any other
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate([*keys, BUCKET])])
    joined = here.join(carried, same, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[_combine(c.how, F.col(f"__c{i}"), F.col(f"__l{i}")).alias(c.name) for i, c in enumerate(carries)],
    )


def hours(ts: str, width: int = 24) -> Column:
    """Time bucket of ``width`` hours for a timestamp column."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(width * 3600))


def asof_last(
    probes: DataFrame, facts: DataFrame, keys: Sequence[str], order: str, bucket: Column,
    take: Sequence[str], strict: bool = False, tie: str | None = None, split: bool | None = None,
) -> DataFrame:
    """Latest fact at or before (``strict``: before) each probe, per key, without pairing rows.

    Probes and facts are stacked and scanned once; ``take`` columns are null where no fact exists.
    """
    keys = list(keys)
    kind = 0 if strict else 1
    extra = [c for c in probes.columns if c not in {*keys, order}]
    left = probes.select(
        *keys, order, F.lit(kind).alias("__kind"), F.lit(0).cast("bigint").alias("__tie"),
        F.struct(*[F.col(c) for c in extra]).alias("__probe") if extra else F.lit(True).alias("__probe"),
        F.lit(None).cast(facts.select(F.struct(*take).alias("f")).schema["f"].dataType).alias("__fact"),
    )
    right = facts.select(
        *keys, order, F.lit(1 - kind).alias("__kind"),
        (F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")).alias("__tie"),
        F.lit(None).cast(left.schema["__probe"].dataType).alias("__probe"),
        F.struct(*take).alias("__fact"),
    )
    both = left.unionByName(right)
    out = prefix_scan(both, keys, [order, "__kind", "__tie"], bucket, [Carry("__hit", "last", F.col("__fact"))], split)
    out = out.filter(F.col("__probe").isNotNull())
    return out.select(
        *keys, order, *[F.col(f"__probe.{c}").alias(c) for c in extra],
        *[F.col(f"__hit.{c}").alias(c) for c in take],
    )
