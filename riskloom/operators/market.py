"""Daily series in long form: fills, returns, volatility, caps, scenario excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.dims import finance as fin

EWMA_DECAY, EWMA_ROWS, EWMA_MIN, TRADING_DAYS = 0.97, 260, 20, 252


def calendar(prices: DataFrame) -> DataFrame:
    """Distinct dates with their row position; one row per day, so the one-partition sort is small."""
    return prices.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def fill_forward(prices: DataFrame, days: DataFrame, limit: int | None = None, value: str = "value") -> DataFrame:
    """Repeat each series' last value over later calendar rows, at most ``limit`` of them."""
    last_pos = days.agg(F.max("pos").alias("last_pos"))
    w = Window.partitionBy("series").orderBy("pos")
    at = prices.filter(F.col(value).isNotNull()).join(days, "date").withColumn("next", F.lead("pos").over(w))
    at = at.crossJoin(F.broadcast(last_pos)) if limit is None else at   # one-row table
    end = F.coalesce(F.col("next") - 1, F.col("last_pos") if limit is None else F.col("pos") + limit)
    stop = end if limit is None else F.least(end, F.col("pos") + limit)
    wide = at.select("series", F.col(value), F.explode(F.sequence("pos", F.greatest("pos", stop))).alias("pos"))
    return wide.join(days, "pos").select("date", "series", value)


def log_returns(prices: DataFrame, value: str = "value") -> DataFrame:
    """ln(p) - ln(previous p) per series; nulls are dropped first."""
    w = Window.partitionBy("series").orderBy("date")
    clean = prices.filter(F.col(value).isNotNull() & (F.col(value) > 0))
    return clean.select("date", "series", (F.ln(value) - F.lag(F.ln(value)).over(w)).alias("r"))


def ewma_volatility(prices: DataFrame, as_of: str | None = None, value: str = "value") -> DataFrame:
    """Annualised EWMA volatility per series over the last 260 calendar rows before ``as_of``."""
    px = prices.filter(F.col("date") < F.to_date(F.lit(as_of))) if as_of else prices
    days = calendar(px)
    first = days.agg((F.max("pos") - (EWMA_ROWS - 1)).alias("from_pos"))
    recent = px.join(days.join(F.broadcast(first), F.col("pos") >= F.col("from_pos")).select("date"), "date")
    back = Window.partitionBy("series").orderBy(F.desc("date"))
    r = log_returns(recent, value).filter(F.col("r").isNotNull()).withColumn("k", F.row_number().over(back) - 1)
    wt = F.pow(F.lit(EWMA_DECAY), F.col("k"))
    return r.groupBy("series").agg(
        F.count("*").alias("n"), (F.sum(wt * F.col("r") * F.col("r")) / F.sum(wt)).alias("var")).filter(
            F.col("n") >= EWMA_MIN).select("series", "n", F.sqrt(F.col("var") * TRADING_DAYS).alias("vol"))


def trailing_volatility(returns: DataFrame, rows: int = 20) -> DataFrame:
    """Population deviation of the ``rows`` returns before each day."""
    w = Window.partitionBy("series").orderBy("date").rowsBetween(-rows, -1)
    return returns.withColumn("vol20", F.stddev_pop("r").over(w))


def last_close_before(prices: DataFrame, cutoff: str, value: str = "value") -> DataFrame:
    """As-of join to a date: last non-null value strictly before the cutoff."""
    return prices.filter((F.col("date") < F.to_date(F.lit(cutoff))) & F.col(value).isNotNull()).groupBy("series").agg(
        F.max_by(value, "date").alias("close"), F.max("date").alias("close_date"))


def caps_from_shares(shares: DataFrame, prices: DataFrame, cutoff: str) -> DataFrame:
    good = shares.filter((F.col("shares") > 0) & ~F.isnan("shares"))
    return good.join(last_close_before(prices, cutoff), good["ticker"] == F.col("series")).select(
        "ticker", (F.col("shares") * F.col("close")).alias("cap"))


# ------------------------------------------------------------------ scenario shocks
def scenario_dim(spark, scenarios=fin.SCENARIOS) -> DataFrame:
    rows = [(s[0], s[1], s[2], s[3], list(s[4]), s[5]) for s in scenarios]
    return spark.createDataFrame(rows, "scenario string, label string, start string, end string, epicenters array<string>, scope string").withColumn(
        "start", F.to_date("start")).withColumn("end", F.to_date("end"))


def factor_dim(spark, factors=fin.FACTORS) -> DataFrame:
    rows = [(f, kind, i, s, float(k), s if i == 0 else f"fallback:{s}" + (f"x{k:g}" if k != 1 else ""))
            for f, kind, cols in factors for i, (s, k) in enumerate(cols)]
    return spark.createDataFrame(rows, "factor string, kind string, priority int, series string, scale double, source string")


def excursions(prices: DataFrame, scenarios: DataFrame, value: str = "value") -> DataFrame:
    """Per scenario and series: base value and the largest moves of each kind after it.

    The base is the last value at or before the start, at most 7 days old; the window is (start, end].
    """
    s = F.broadcast(scenarios.select("scenario", "start", "end"))
    near = prices.filter(F.col(value).isNotNull()).join(
        s, (F.col("date") <= F.col("end")) & (F.col("date") >= F.date_sub("start", 7)))
    base = near.filter(F.col("date") <= F.col("start")).groupBy("scenario", "series").agg(F.max_by(value, "date").alias("x0"))
    moved = near.filter(F.col("date") > F.col("start")).join(base, ["scenario", "series"])
    kinds = F.array(
        F.struct(F.lit("ret").alias("kind"), (F.col(value) / F.col("x0") - 1.0).alias("move")),
        F.struct(F.lit("bp").alias("kind"), ((F.col(value) - F.col("x0")) * 100.0).alias("move")),
        F.struct(F.lit("pts").alias("kind"), (F.col(value) - F.col("x0")).alias("move")))
    each = moved.select("scenario", "series", "date", F.explode(kinds).alias("k")).select(
        "scenario", "series", "date", "k.kind", "k.move")
    # the first date wins a tie: order by |move| then earliest
    rank = F.struct(F.abs("move"), -F.datediff("date", F.lit("1970-01-01")))
    return each.groupBy("scenario", "series", "kind").agg(
        F.max_by("move", rank).alias("move"), F.max_by("date", rank).alias("peak_date"))


def analog_shocks(prices: DataFrame, scenarios: DataFrame, factors: DataFrame, name_suffix: str | None = fin.NAME_SUFFIX, value: str = "value") -> DataFrame:
    """Shock per (scenario, factor): the first available series of the factor, scaled; plus one per name (a series with the suffix)."""
    moves = excursions(prices, scenarios, value)
    ranked = moves.join(F.broadcast(factors), ["series", "kind"])
    first = ranked.groupBy("scenario", "factor", "kind").agg(
        F.min_by(F.struct((F.col("move") * F.col("scale")).alias("v"), "source", "peak_date"), "priority").alias("b"))
    out = first.select("scenario", "factor", F.bround("b.v", 6).alias("value"), "kind", "b.source", "b.peak_date")
    if name_suffix is not None:
        names = moves.filter((F.col("kind") == "ret") & F.col("series").endswith(name_suffix)).select(
            "scenario", F.concat(F.lit("EQN:"), "series").alias("factor"), F.bround("move", 6).alias("value"), "kind",
            F.col("series").alias("source"), "peak_date")
        out = out.unionByName(names)
    return out


def shock_vectors(shocks: DataFrame) -> DataFrame:
    """scenario -> map<factor, value>; a scenario has some tens of factors."""
    return shocks.groupBy("scenario").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", "value")))).alias("shock"))
