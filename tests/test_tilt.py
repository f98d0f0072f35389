"""The tilt for any number of indices and configurations in one job."""

import pytest
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.operators import tilt
from riskloom.plans import market_queries as mq

SF = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted((r.config, r.index_name, r.seq, tuple(r.tickers), tuple(round(x, 9) for x in r.target)) for r in rows)


def test_two_indices_and_two_settings_equal_one_at_a_time(spark):
    events, decisions = mq.events(spark, SF), mq.decisions(spark, SF)
    both = mq.holdings(spark, SF, ("BRANDS", "EVEN"))
    grid = tilt.grid_of((0.3,), (6.0, 24.0), (False,))
    together = rounded(tilt.tilt_targets(events, decisions, both, grid).collect())
    apart = []
    for index in ("BRANDS", "EVEN"):
        for cfg in grid:
            apart += tilt.tilt_targets(events, decisions, both.filter(F.col("index_name") == index), [cfg]).collect()
    assert together == rounded(apart) and {r[1] for r in together} == {"BRANDS", "EVEN"}


def test_an_index_of_many_names(spark):
    """More names than a driver-held index took; weights stay invested and inside their caps."""
    n = 2500
    members = spark.range(n).select(F.lit("WIDE").alias("index_name"), F.concat(F.lit("N"), "id").alias("ticker"), F.lit(1.0 / n).alias("bench"), F.lit(0.2).alias("vol"),
                                    F.concat(F.lit("S"), F.col("id") % 7).alias("sector"), F.lit("").alias("group"))
    events = mq.events(spark, SF).filter("seq < 40").withColumn("ticker", F.concat(F.lit("N"), F.col("seq") % n))
    cfg = fin.TiltConfig()
    rows = tilt.tilt_targets(events, None, members, [cfg]).collect()
    assert len(rows) == events.count() > 10
    for r in rows:
        assert len(r.tickers) == n and sum(r.target) == pytest.approx(1.0, abs=1e-6)
        assert max(abs(t - b) for t, b in zip(r.target, r.bench)) <= cfg.active_cap + 1e-9


def test_grid_and_attribution(spark):
    grid = tilt.grid_of((0.3, 0.6), (6.0, 24.0))
    assert len({c.name for c in grid}) == 8 and {tilt.setting_of(c) for c in grid} == {tilt.setting_of(c) for c in grid if c.kappa == 0.3}
    p = tilt.sweep(mq.events(spark, SF), mq.decisions(spark, SF), mq.holdings(spark, SF), grid[:2])
    a = tilt.attribution(p).groupBy("config", "seq").agg(F.sum("change").alias("c"), F.sum(F.col("from_signal") + F.col("from_constraints") + F.col("bench") - F.col("final")).alias("d")).collect()
    assert a and all(abs(r.c) < 1e-9 and abs(r.d) < 1e-9 for r in a)


def test_updates_are_not_multiplied_by_members(spark, monkeypatch):
    """The rows on the way to the solver are changes, updates and one row per block and member; values equal a plain replay."""
    monkeypatch.setattr(tilt, "BLOCK_UPDATES", 16)
    monkeypatch.setattr(tilt, "CELLS", 40)
    n = 30
    members = spark.range(n).select(F.lit("I").alias("index_name"), F.format_string("N%02d", "id").alias("ticker"), F.lit(1.0 / n).alias("bench"), F.lit(0.2).alias("vol"), F.lit("S").alias("sector"), F.lit("").alias("group"))
    facts = [(1000 + 3 * i, f"N{i * 7 % n:02d}", (i * 37 % 100) / 50 - 1.0, i % 9) for i in range(200)]
    values = spark.createDataFrame([("s", t, q, x, k) for q, t, x, k in facts], "setting string, ticker string, seq bigint, index_value double, stories int")
    flags = [(1000 + 15 * i, f"N{i * 11 % n:02d}", i % 2 == 0) for i in range(40)]
    breakers = spark.createDataFrame(flags, "seq bigint, ticker string, breaker boolean")
    updates = values.select(F.lit("I").alias("index_name"), "seq", F.timestamp_seconds("seq").alias("as_of"), F.lit(False).alias("forced"))
    cfg = fin.TiltConfig()
    monkeypatch.setattr(tilt, "setting_of", lambda c: "s")
    rows = tilt.panel(updates, values, breakers, members, ["s"])
    assert rows.count() < 200 * n / 2
    got = {r.seq: r for r in tilt.targets(rows, [cfg]).collect()}
    x, stories, b = {}, {}, {}
    assert len(got) == 200
    for q, t, v, k in facts:
        x[t], stories[t] = v, k
        b |= {name: on for at, name, on in flags if q - 3 < at <= q}
        names = [f"N{i:02d}" for i in range(n)]
        xs = [x.get(m, 0.0) for m in names]
        mean = sum(xs) / n
        sd = max((sum((v - mean) ** 2 for v in xs) / (n - 1)) ** 0.5, 0.05)
        assert got[q].tickers == names and got[q].b == [b.get(m, False) for m in names]
        assert got[q].z == pytest.approx([(x.get(m, 0.0) - mean) / sd * stories.get(m, 0) / (stories.get(m, 0) + cfg.shrink_k) for m in names], abs=1e-9)
