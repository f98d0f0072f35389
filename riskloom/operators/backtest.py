"""Look-ahead-safe back-test of weight snapshots on daily open and close series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scan import asof_last, hours
from riskloom.operators.market import fill_forward


def sessions(closes: DataFrame, market: str, start: str, end: str) -> DataFrame:
    """Days on which the market series traded, numbered; one row per day."""
    days = closes.filter((F.col("series") == market) & F.col("value").isNotNull() & F.col("date").between(
        F.to_date(F.lit(start)), F.to_date(F.lit(end)))).select("date").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def effective_snapshots(days: DataFrame, snapshots: DataFrame, cutoff_seconds: int = 34_200, zone: str = "UTC") -> DataFrame:
    """As-of join: the latest snapshot at or before each session's cutoff in the market's time; the first one before that.

    Days and snapshots are scanned in buckets of a month, whatever the number of snapshots.
    """
    snaps = snapshots.select("snapshot_id", "as_of").distinct()
    first = snaps.agg(F.min_by("snapshot_id", "as_of").alias("first_id"))
    local = F.to_timestamp("date") + F.make_dt_interval(secs=F.lit(cutoff_seconds))
    probes = days.select(F.to_utc_timestamp(local, zone).alias("at"), "date", "pos")
    facts = snaps.select(F.col("as_of").alias("at"), F.col("snapshot_id").alias("snap"))
    return asof_last(probes, facts, [], "at", hours("at", 24 * 30), ["snap"], split=True).join(F.broadcast(first)).select(
        "date", "pos", F.coalesce("snap", "first_id").alias("snapshot_id"))


def replay(snapshots: DataFrame, closes: DataFrame, opens: DataFrame, market: str, start: str, end: str,
           cost_bps: float = 5.0, trade_at: str = "open", hours_of: tuple[str, int, int] = ("UTC", 34_200, 56_700)) -> DataFrame:
    """Daily return, cost and value (base 100) per portfolio.

    ``snapshots``: snapshot_id, as_of, portfolio, ticker, weight; ``hours_of``: the exchange's zone, open and last decision.
    """
    days = sessions(closes, market, start, end)
    names = snapshots.select("ticker").distinct()
    px = closes.join(names, closes["series"] == F.col("ticker"), "left_semi").join(days.select("date"), "date")
    filled = fill_forward(px, days, None).withColumnRenamed("series", "ticker").join(days, "date")
    w_t = Window.partitionBy("ticker").orderBy("pos")
    filled = filled.withColumn("prev_close", F.lag("value").over(w_t))
    op = opens.select("date", F.col("series").alias("ticker"), F.col("value").alias("open"))
    priced = filled.join(op, ["date", "ticker"], "left")
    n_names = names.agg(F.count("*").alias("n_names"))
    complete = priced.groupBy("date").agg(F.count("open").alias("n_open")).join(F.broadcast(n_names)).select(
        "date", (F.col("n_open") == F.col("n_names")).alias("at_open"))
    zone, opens_at, decides_at = hours_of
    eff = effective_snapshots(days, snapshots, opens_at if trade_at == "open" else decides_at, zone)
    weights = eff.join(snapshots.select("snapshot_id", "portfolio", "ticker", "weight"), "snapshot_id")
    w_p = Window.partitionBy("portfolio", "ticker").orderBy("pos")
    # session 0 only provides the previous close; the first traded session pays no cost
    held = weights.filter("pos > 0").withColumn("old", F.lag("weight").over(w_p)).join(
        priced.select("date", "ticker", "value", "prev_close", "open"), ["date", "ticker"]).join(complete, "date")
    w_old = F.coalesce("old", "weight")
    use_open = F.col("at_open") & F.lit(trade_at == "open")
    day = held.groupBy("portfolio", "date", "pos").agg(
        F.first(use_open).alias("use_open"), F.sum(w_old * (F.col("open") / F.col("prev_close") - 1.0)).alias("gap"),
        F.sum(F.col("weight") * (F.col("value") / F.col("open") - 1.0)).alias("intraday"),
        F.sum(F.col("weight") * (F.col("value") / F.col("prev_close") - 1.0)).alias("close_close"),
        F.sum(F.abs(F.col("weight") - w_old)).alias("turnover"))
    r = F.when(F.col("use_open"), (1.0 + F.col("gap")) * (1.0 + F.col("intraday")) - 1.0).otherwise(F.col("close_close"))
    day = day.withColumn("ret", r).withColumn("cost", F.col("turnover") * cost_bps / 1e4)
    path = Window.partitionBy("portfolio").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("portfolio", "date", "pos", "ret", "turnover", "cost").withColumn(
        "value", 100.0 * F.exp(F.sum(F.ln(1.0 + F.col("ret") - F.col("cost"))).over(path))).withColumn("total_turnover", F.sum("turnover").over(path))


def summary(paths: DataFrame) -> DataFrame:
    """Total return and maximum drawdown per portfolio."""
    w = Window.partitionBy("portfolio").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    dd = paths.withColumn("peak", F.greatest(F.max("value").over(w), F.lit(100.0)))
    return dd.groupBy("portfolio").agg(
        (F.max_by("value", "pos") / 100.0 - 1.0).alias("total_return"),
        F.least(F.min(F.col("value") / F.col("peak") - 1.0), F.lit(0.0)).alias("max_drawdown"),
        F.sum("turnover").alias("turnover"))
