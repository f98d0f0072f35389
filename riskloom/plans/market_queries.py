"""Series, tilt, back-test and event study over the derived market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.dims import finance as fin
from riskloom.dims.text_rules import FILING_ITEMS
from riskloom.operators import backtest, market, marts, study, tilt
from riskloom.plans.registry import big, is_staged, query, r6, secs, staged
from riskloom.plans.signal_queries import S, decisions, events, sig
from riskloom.plans.text_queries import ORDER_ITEMS
from riskloom.sources import tables as ref

M = corpus.MARKET_SQL


def px(spark, sf) -> DataFrame:
    return staged(spark, sf, "market", lambda: corpus.market(spark, sf))


@query("s08_market_long", f"WITH {M} SELECT date::VARCHAR AS date, series, value FROM px")
def s08(spark, sf):
    """Wide text files (one with unreadable cells) -> numeric long series; the outer join is a union."""
    m = px(spark, sf)
    names = sorted(r["series"] for r in m.select("series").distinct().collect())   # the columns of wide files
    halves = [[n for n in names if n != "VIX"], ["VIX"]]

    def wide(cols: list[str], empty: str | None) -> DataFrame:
        w = m.filter(F.col("series").isin(cols)).groupBy("date").pivot("series", cols).agg(F.first("value"))
        cell = lambda c: F.col(f"`{c}`").cast("string")
        return w.select(F.col("date").cast("string").alias("date"), *[(F.coalesce(cell(c), F.lit(empty)) if empty else cell(c)).alias(c) for c in cols])

    return ref.load_market([wide(halves[0], "n/a"), wide(halves[1], None)]).select(F.col("date").cast("string").alias("date"), "series", "value")


DAYS = "days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM px))"


@query("w12_fill_limited", f"""WITH {M}, {DAYS}, b AS (SELECT pos, series, value, lead(pos) OVER (PARTITION BY series ORDER BY pos) AS nx FROM px JOIN days USING (date)),
 f AS (SELECT series, value, unnest(range(pos, least(coalesce(nx - 1, (SELECT max(pos) FROM days)), pos + 5) + 1)) AS pos FROM b) SELECT series, count(*) AS n, round(sum(value), 2) AS total FROM f JOIN days USING (pos) GROUP BY series""")
def w12(spark, sf):
    """Forward fill of at most five calendar rows."""
    p = px(spark, sf)
    days = market.calendar(p)
    return market.fill_forward(p, days, 5).groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("w17_fill_unlimited", f"""WITH {M}, {DAYS}, b AS (SELECT pos, series, value, lead(pos) OVER (PARTITION BY series ORDER BY pos) AS nx FROM px JOIN days USING (date)),
 f AS (SELECT series, value, unnest(range(pos, coalesce(nx, (SELECT max(pos) FROM days) + 1))) AS pos FROM b) SELECT series, count(*) AS n, round(sum(value), 2) AS total FROM f GROUP BY series""")
def w17(spark, sf):
    p = px(spark, sf)
    return market.fill_forward(p, market.calendar(p), None).groupBy("series").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("w10_log_returns", f"WITH {M} SELECT series, date::VARCHAR AS date, round(ln(value) - lag(ln(value)) OVER (PARTITION BY series ORDER BY date), 6) AS r FROM px WHERE value > 0")
def w10(spark, sf):
    return market.log_returns(px(spark, sf)).select("series", F.col("date").cast("string").alias("date"), r6("r").alias("r"))


@query("w13_ewma_volatility", f"""WITH {M}, c AS (SELECT * FROM px WHERE date < DATE '2001-06-01'), d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM c)),
 r AS (SELECT series, date, ln(value) - lag(ln(value)) OVER (PARTITION BY series ORDER BY date) AS r FROM c JOIN d USING (date) WHERE back <= 260 AND value > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) - 1 AS k FROM r WHERE r IS NOT NULL)
SELECT series, count(*) AS n, round(sqrt(sum(pow(0.97::DOUBLE, k) * r * r) / sum(pow(0.97::DOUBLE, k)) * 252), 6) AS vol FROM k GROUP BY series HAVING count(*) >= 20""")
def w13(spark, sf):
    return market.ewma_volatility(px(spark, sf), "2001-06-01").select("series", "n", r6("vol").alias("vol"))


@query("w14_trailing_volatility", f"WITH {M}, r AS (SELECT series, date, ln(value) - lag(ln(value)) OVER (PARTITION BY series ORDER BY date) AS r FROM px WHERE value > 0) SELECT series, date::VARCHAR AS date, round(stddev_pop(r) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS vol20 FROM r")
def w14(spark, sf):
    r = market.log_returns(px(spark, sf))
    return market.trailing_volatility(r).select("series", F.col("date").cast("string").alias("date"), r6("vol20").alias("vol20"))


@query("j12_caps_as_of", f"""WITH {M}, s AS (SELECT p_brand, sum(p_size) AS shares FROM part GROUP BY 1), l AS (SELECT series, arg_max(value, date) AS c FROM px WHERE date < DATE '2000-01-01' GROUP BY 1)
SELECT p_brand AS ticker, round(shares * c, 2) AS cap FROM s JOIN l ON series = p_brand""")
def j12(spark, sf):
    """Cap on a date: shares x last close before it."""
    s = corpus.table(spark, sf, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.sum("p_size").cast("double").alias("shares"))
    return market.caps_from_shares(s, px(spark, sf), "2000-01-01").select("ticker", F.round("cap", 2).alias("cap"))


# ------------------------------------------------------------------ scenario shocks
SCEN = "(VALUES " + ", ".join(f"('{s[0]}', DATE '{s[2]}', DATE '{s[3]}')" for s in corpus.CORPUS_SCENARIOS) + ") AS sc(scenario, st, en)"
FACT = "(VALUES " + ", ".join(f"('{f}', '{k}', {i}, '{s}', {x}::DOUBLE)" for f, k, cols in corpus.CORPUS_FACTORS for i, (s, x) in enumerate(cols)) + ") AS fc(factor, kind, priority, series, scale)"
SHOCK_SQL = f"""base0 AS (SELECT scenario, series, arg_max(value, date) AS x0 FROM px JOIN {SCEN} ON date <= st AND date >= st - 7 GROUP BY ALL),
mv AS (SELECT scenario, series, date, value / x0 - 1 AS ret, (value - x0) * 100 AS bp, value - x0 AS pts FROM px JOIN {SCEN} ON date > st AND date <= en JOIN base0 USING (scenario, series)),
mx AS (SELECT scenario, series, 'ret' AS kind, arg_max(ret, (abs(ret), -(date - DATE '1970-01-01'))) AS move FROM mv GROUP BY ALL UNION ALL SELECT scenario, series, 'bp', arg_max(bp, (abs(bp), -(date - DATE '1970-01-01'))) FROM mv GROUP BY ALL
  UNION ALL SELECT scenario, series, 'pts', arg_max(pts, (abs(pts), -(date - DATE '1970-01-01'))) FROM mv GROUP BY ALL),
shock AS (SELECT scenario, factor, round_even(arg_min(move * scale, priority), 6) AS value, arg_min(series, priority) AS src FROM mx JOIN {FACT} USING (series, kind) GROUP BY ALL)"""


def scenarios(spark):
    return market.scenario_dim(spark, corpus.CORPUS_SCENARIOS)


def shocks(spark, sf) -> DataFrame:
    return staged(spark, sf, "shocks", lambda: market.analog_shocks(px(spark, sf), scenarios(spark), market.factor_dim(spark, corpus.CORPUS_FACTORS)))


@query("m12_analog_shocks", f"WITH {M}, {SHOCK_SQL} SELECT scenario, factor, value FROM shock")
def m12(spark, sf):
    """Largest move per factor in each scenario window, with fallback series."""
    return shocks(spark, sf).select("scenario", "factor", "value")


@query("m12_name_shocks", f"WITH {M}, {SHOCK_SQL} SELECT scenario, 'EQN:' || series || '{fin.NAME_SUFFIX}' AS factor, round_even(move, 6) AS value FROM mx WHERE kind = 'ret' AND starts_with(series, 'Brand#')")
def m12n(spark, sf):
    """A shock for every name: brands as the listed names of a market."""
    p = px(spark, sf).filter(F.col("series").startswith("Brand#")).withColumn("series", F.concat("series", F.lit(fin.NAME_SUFFIX)))
    return market.analog_shocks(p, scenarios(spark), market.factor_dim(spark, corpus.CORPUS_FACTORS)).select("scenario", "factor", "value")


@query("s11_shock_vectors", f"WITH {M}, {SHOCK_SQL} SELECT scenario, count(*) AS factors, round(sum(value), 6) AS total FROM shock GROUP BY 1")
def s11(spark, sf):
    v = market.shock_vectors(shocks(spark, sf))
    return v.select("scenario", big(F.size("shock")).alias("factors"), r6(F.aggregate(F.map_values("shock"), F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("u05_missing_series", f"WITH {M}, w AS (SELECT DISTINCT series FROM {FACT}) SELECT series FROM w WHERE series NOT IN (SELECT series FROM px)")
def u05(spark, sf):
    """Series a factor asks for that the market does not have."""
    return market.factor_dim(spark, corpus.CORPUS_FACTORS).select("series").distinct().join(px(spark, sf).select("series").distinct(), "series", "left_anti")


@query("p20_sessions", f"WITH {M} SELECT date::VARCHAR AS date, row_number() OVER (ORDER BY date) - 1 AS pos FROM px WHERE series = 'MKT' AND date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def p20(spark, sf):
    return backtest.sessions(px(spark, sf), "MKT", "1999-01-01", "1999-12-31").select(F.col("date").cast("string").alias("date"), big("pos").alias("pos"))


# ------------------------------------------------------------------ index
BENCH_SQL = """cp AS (SELECT series AS ticker, sum(value) AS cap FROM px WHERE starts_with(series, 'Brand#') GROUP BY 1), top AS (SELECT * FROM cp), wf0 AS (SELECT *, cap / sum(cap) OVER () AS v FROM top),
wf AS (SELECT *, row_number() OVER (ORDER BY v DESC, ticker) - 1 AS i, sum(v) OVER (ORDER BY v DESC, ticker ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM wf0),
wk AS (SELECT *, (1 - i * 0.052) / tail AS sc, (1 - i * 0.052) / tail * v <= 0.052 + 1e-12 AS fits FROM wf), wb AS (SELECT arg_min(sc, i) AS bs, min(i) AS bi FROM wk WHERE fits),
bench AS (SELECT ticker, CASE WHEN bi IS NULL OR i < bi THEN 0.052 ELSE bs * v END AS bench FROM wk, wb)"""


def members(spark, sf) -> DataFrame:
    caps = px(spark, sf).filter(F.col("series").startswith("Brand#")).groupBy(F.col("series").alias("ticker")).agg(F.sum("value").alias("cap"))
    return tilt.capped_weights(caps.withColumn("index_name", F.lit("BRANDS")), ["index_name"], cap=0.052)


@query("m07_capped_weights", f"WITH {M}, {BENCH_SQL} SELECT ticker, round(bench, 6) AS bench FROM bench")
def m07(spark, sf):
    """Capped cap-weights of all brands."""
    return members(spark, sf).select("ticker", r6("bench").alias("bench"))


def holdings(spark, sf, indices=("BRANDS",)) -> DataFrame:
    """Members of the indices with volatility, sector and group: all brands, and the brands of even number."""
    def build():
        vol = market.ewma_volatility(px(spark, sf)).select(F.col("series").alias("ticker"), "vol")
        k = F.regexp_extract("ticker", r"(\d+)", 1).cast("int")
        caps = px(spark, sf).filter(F.col("series").startswith("Brand#")).groupBy(F.col("series").alias("ticker")).agg(F.sum("value").alias("cap"))
        even = tilt.capped_weights(caps.filter(k % 2 == 0).withColumn("index_name", F.lit("EVEN")), ["index_name"], cap=0.12)
        h = members(spark, sf).unionByName(even).join(vol, "ticker", "left")
        return h.select("index_name", "ticker", "bench", F.coalesce("vol", F.lit(0.25)).alias("vol"), F.concat(F.lit("S"), (k % 5).cast("string")).alias("sector"), F.when(k % 7 == 0, "G").otherwise("").alias("group"))
    return staged(spark, sf, "holdings", build).filter(F.col("index_name").isin(*indices))


@query("w08_shrunk_scores", f"""WITH {S}, d AS (SELECT cluster_id, entity_id, arg_max(sentiment, seq) AS x, count(*) AS n FROM signals GROUP BY ALL), s AS (SELECT *, avg(x) OVER (PARTITION BY entity_id) AS mu, greatest(coalesce(stddev_samp(x) OVER (PARTITION BY entity_id), 0), 0.05) AS sd FROM d)
SELECT cluster_id, round((x - mu) / sd * n / (n + 2.0), 6) AS z FROM s""")
def w08(spark, sf):
    """Cross-sectional z-scores shrunk by the number of supporting rows."""
    v = sig(spark, sf).groupBy("cluster_id", "entity_id").agg(F.max_by("sentiment", "seq").alias("index_value"), F.count("*").alias("stories"))
    return tilt.shrunk_z(v, ["entity_id"]).select("cluster_id", r6("z").alias("z"))


@query("m06_naive_turnover", f"""WITH {S}, {M}, {BENCH_SQL}, d AS (SELECT s.seq, s.ticker, bench, bench * greatest(0, 1 + sentiment) AS nw, bench * greatest(0, 1 + coalesce(lag(sentiment) OVER (PARTITION BY s.ticker ORDER BY s.seq), 0)) AS ow FROM signals s JOIN bench USING (ticker) WHERE grain = 'document'),
 t AS (SELECT *, 1 + sum(nw - ow) OVER (ORDER BY seq) AS t1 FROM d) SELECT seq, round(nw / t1, 6) AS weight, round((t1 - nw) * abs(1 / t1 - 1 / (t1 - nw + ow)) + abs(nw / t1 - ow / (t1 - nw + ow)), 6) AS turnover FROM t""")
def m06(spark, sf):
    """Naive tilt comparator: weight of the updated name and turnover per document."""
    d = sig(spark, sf).filter("grain = 'document'")
    return tilt.naive_turnover(d, members(spark, sf)).select("seq", r6("weight").alias("weight"), r6("turnover").alias("turnover"))


def all_targets(spark, sf) -> DataFrame:
    return tilt.tilt_targets(events(spark, sf), decisions(spark, sf), holdings(spark, sf), [fin.TiltConfig()])


def solved(spark, sf) -> DataFrame:
    return staged(spark, sf, "targets", lambda: all_targets(spark, sf))


def path(spark, sf) -> DataFrame:
    """The path reads half of a target's columns; the others are written only where a query asks for them."""
    def build():
        some = solved(spark, sf) if is_staged(spark, sf, "targets") else staged(spark, sf, "band_rows", lambda: tilt.band_rows(all_targets(spark, sf)))
        return tilt.rebalance_path(some)
    return staged(spark, sf, "path", build)


@query("m08_targets")
def m08(spark, sf):
    """Constrained target weights at every update."""
    t = solved(spark, sf)
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return t.select("seq", r6(s(F.col("target"))).alias("invested"), r6(F.array_max("target")).alias("largest"), big(F.col("forced").cast("int")).alias("forced"))


@query("m09_rebalance_path")
def m09(spark, sf):
    """Adopted snapshots under the no-trade band, with turnover and cost of each."""
    p = path(spark, sf)
    return p.select("seq", r6("turnover").alias("turnover"), r6("cost_bps").alias("cost_bps"))


@query("m09_attribution")
def m09a(spark, sf):
    """Each snapshot split into signal and constraint effects per name."""
    a = tilt.attribution(path(spark, sf))
    return a.select("seq", "ticker", r6("final").alias("final"), r6("from_signal").alias("from_signal"), r6("from_constraints").alias("from_constraints"))


@query("k07_movers")
def k07(spark, sf):
    """Top six names by largest active weight over the path."""
    a = tilt.attribution(path(spark, sf)).withColumnRenamed("final", "weight")
    return marts.movers(a).select("ticker", r6("max_active").alias("max_active"))


@query("m08_two_indices")
def m08i(spark, sf):
    """Targets of two indices in one job: names, weight invested and the largest weight at every update."""
    both = holdings(spark, sf, ("BRANDS", "EVEN"))
    t = tilt.tilt_targets(events(spark, sf), decisions(spark, sf), both, [fin.TiltConfig()])
    s = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return t.select("index_name", "seq", big(F.size("tickers")).alias("names"), r6(s(F.col("target"))).alias("invested"), r6(F.array_max("target")).alias("largest"))


@query("m10_parameter_sweep")
def m10(spark, sf):
    """Rebalance paths over aggressiveness x half-life x filters x market, as one job."""
    p = tilt.sweep(events(spark, sf), decisions(spark, sf), holdings(spark, sf, ("BRANDS", "EVEN")), tilt.grid_of((0.3, 0.6, 0.9), (6.0, 24.0)))
    return p.groupBy("config", "index_name").agg(F.count("*").alias("rebalances"), r6(F.sum("turnover")).alias("turnover"))


# ------------------------------------------------------------------ back-test
SNAP_SQL = """mo AS (SELECT date_trunc('month', date)::DATE AS m, series AS ticker, sum(value) AS v, sum(open) AS o FROM px JOIN bench ON bench.ticker = px.series GROUP BY ALL),
ms AS (SELECT (m + INTERVAL 1 MONTH)::DATE AS m2, ticker, v / sum(v) OVER (PARTITION BY m) AS tilt, 1.0 / count(*) OVER (PARTITION BY m) AS flat, o / sum(o) OVER (PARTITION BY m) AS naive, count(*) OVER (PARTITION BY m) AS names FROM mo),
snp AS (SELECT strftime(m2, '%Y-%m') AS sid, m2, ticker, unnest(['tilt', 'flat', 'naive']) AS portfolio, unnest([tilt, flat, naive]) AS weight FROM ms WHERE names = (SELECT count(*) FROM bench))"""


def snapshots(spark, sf) -> DataFrame:
    m = px(spark, sf).join(members(spark, sf).select(F.col("ticker").alias("series")), "series").groupBy(
        F.trunc("date", "month").alias("m"), F.col("series").alias("ticker")).agg(F.sum("value").alias("v"), F.sum("open").alias("o"))
    every = members(spark, sf).agg(F.count("*").alias("names"))   # one row
    t = m.groupBy("m").agg(F.sum("v").alias("tv"), F.sum("o").alias("to"), F.count("*").alias("names")).join(F.broadcast(every), "names")
    j = m.join(t, "m").withColumn("m2", F.add_months("m", 1))
    w = F.array(F.struct(F.lit("tilt").alias("portfolio"), (F.col("v") / F.col("tv")).alias("weight")), F.struct(F.lit("flat").alias("portfolio"), (F.lit(1.0) / F.col("names")).alias("weight")),
                F.struct(F.lit("naive").alias("portfolio"), (F.col("o") / F.col("to")).alias("weight")))
    return j.select(F.date_format("m2", "yyyy-MM").alias("snapshot_id"), F.col("m2").cast("timestamp").alias("as_of"), "ticker", F.explode(w).alias("x")).select("snapshot_id", "as_of", "ticker", "x.*")


BT = ("1998-01-01", "1999-12-31")
BT_SQL = f"""se AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM px WHERE series = 'MKT' AND date BETWEEN DATE '{BT[0]}' AND DATE '{BT[1]}'),
nm AS (SELECT DISTINCT ticker FROM snp), grid AS (SELECT date, pos, ticker FROM se, nm),
cl0 AS (SELECT grid.*, px.value AS c0, px.open AS op FROM grid LEFT JOIN px ON px.date = grid.date AND px.series = grid.ticker),
cl AS (SELECT *, last_value(c0 IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY pos ROWS UNBOUNDED PRECEDING) AS c FROM cl0),
cp2 AS (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY pos) AS pc FROM cl), allop AS (SELECT date, count(op) = (SELECT count(*) FROM nm) AS full_open FROM cp2 GROUP BY 1),
ef AS (SELECT se.date, se.pos, coalesce((SELECT arg_max(sid, m2) FROM snp WHERE m2 <= se.date), (SELECT arg_min(sid, m2) FROM snp)) AS sid FROM se),
hw AS (SELECT ef.date, ef.pos, portfolio, ticker, weight, lag(weight) OVER (PARTITION BY portfolio, ticker ORDER BY ef.pos) AS old FROM ef JOIN snp USING (sid) WHERE ef.pos > 0),
dy AS (SELECT portfolio, hw.date, hw.pos, any_value(full_open) AS fo, sum(coalesce(old, weight) * (op / pc - 1)) AS gap, sum(weight * (c / op - 1)) AS intra, sum(weight * (c / pc - 1)) AS cc, sum(abs(weight - coalesce(old, weight))) AS tov FROM hw JOIN cp2 USING (date, ticker) JOIN allop USING (date) GROUP BY portfolio, hw.date, hw.pos),
rt AS (SELECT portfolio, date, pos, CASE WHEN fo THEN (1 + gap) * (1 + intra) - 1 ELSE cc END AS r, tov FROM dy),
pt AS (SELECT *, 100 * exp(sum(ln(1 + r - tov * 5.0 / 10000.0)) OVER (PARTITION BY portfolio ORDER BY pos)) AS val FROM rt)"""


def replayed(spark, sf) -> DataFrame:
    def build():
        p = px(spark, sf)
        return backtest.replay(snapshots(spark, sf), p.select("date", "series", "value"), p.filter("open is not null").select("date", "series", F.col("open").alias("value")), "MKT", *BT)
    return staged(spark, sf, "replay", build)


@query("j13_effective_snapshots", f"WITH {M}, {BENCH_SQL}, {SNAP_SQL}, {BT_SQL} SELECT date::VARCHAR AS date, sid AS snapshot_id FROM ef")
def j13(spark, sf):
    days = backtest.sessions(px(spark, sf), "MKT", *BT)
    return backtest.effective_snapshots(days, snapshots(spark, sf)).select(F.col("date").cast("string").alias("date"), "snapshot_id")


@query("j13_market_time", f"""WITH {M}, {BENCH_SQL}, {SNAP_SQL}, {BT_SQL}, sx AS (SELECT DISTINCT sid || '-' || h AS sid, m2 + to_seconds(h * 7300) AS tm FROM snp, range(0, 12) r(h))
SELECT se.date::VARCHAR AS date, coalesce((SELECT arg_max(sid, tm) FROM sx WHERE tm <= se.date + INTERVAL 3 HOUR + INTERVAL 45 MINUTE), (SELECT arg_min(sid, tm) FROM sx)) AS snapshot_id FROM se""")
def j13z(spark, sf):
    """Snapshots inside the day against sessions that open at 09:15 in Mumbai."""
    zone, opens_at, _ = fin.MARKET_HOURS["IN"]
    days = backtest.sessions(px(spark, sf), "MKT", *BT)
    s = snapshots(spark, sf).select("snapshot_id", "as_of").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(11))))
    s = s.select(F.concat_ws("-", "snapshot_id", "h").alias("snapshot_id"), (F.col("as_of") + F.make_dt_interval(secs=F.col("h") * 7300)).alias("as_of"))
    return backtest.effective_snapshots(days, s, opens_at, zone).select(F.col("date").cast("string").alias("date"), "snapshot_id")


@query("m11_backtest", f"WITH {M}, {BENCH_SQL}, {SNAP_SQL}, {BT_SQL} SELECT portfolio, date::VARCHAR AS date, round(r, 6) AS ret, round(tov, 6) AS turnover FROM rt")
def m11(spark, sf):
    """Daily returns and turnover of three portfolios, trading at the next open."""
    return replayed(spark, sf).select("portfolio", F.col("date").cast("string").alias("date"), r6("ret").alias("ret"), r6("turnover").alias("turnover"))


@query("w16_value_paths", f"WITH {M}, {BENCH_SQL}, {SNAP_SQL}, {BT_SQL} SELECT portfolio, date::VARCHAR AS date, round(val, 4) AS value, round(sum(tov) OVER (PARTITION BY portfolio ORDER BY pos), 6) AS total_turnover FROM pt")
def w16(spark, sf):
    return replayed(spark, sf).select("portfolio", F.col("date").cast("string").alias("date"), F.round("value", 4).alias("value"), r6("total_turnover").alias("total_turnover"))


@query("a32_backtest_summary", f"""WITH {M}, {BENCH_SQL}, {SNAP_SQL}, {BT_SQL}, dd AS (SELECT *, greatest(100, max(val) OVER (PARTITION BY portfolio ORDER BY pos)) AS pk FROM pt)
SELECT portfolio, round(arg_max(val, pos) / 100 - 1, 6) AS total_return, round(least(min(val / pk - 1), 0), 6) AS max_drawdown, round(sum(tov), 6) AS turnover FROM dd GROUP BY 1""")
def a32(spark, sf):
    """Total return, drawdown (W09) and turnover (A33) per portfolio."""
    s = backtest.summary(replayed(spark, sf))
    return s.select("portfolio", r6("total_return").alias("total_return"), r6("max_drawdown").alias("max_drawdown"), r6("turnover").alias("turnover"))


@query("j22_turnover_full_join", f"WITH {M}, {BENCH_SQL}, {SNAP_SQL}, a AS (SELECT * FROM snp WHERE sid = '1998-02' AND portfolio = 'tilt'), b AS (SELECT * FROM snp WHERE sid = '1998-03' AND portfolio = 'tilt') SELECT coalesce(a.ticker, b.ticker) AS ticker, round(abs(coalesce(b.weight, 0) - coalesce(a.weight, 0)), 6) AS turnover FROM a FULL JOIN b ON a.ticker = b.ticker")
def j22(spark, sf):
    s = snapshots(spark, sf).filter("portfolio = 'tilt'")
    return tilt.full_turnover(s.filter("snapshot_id = '1998-02'"), s.filter("snapshot_id = '1998-03'"), ["ticker"]).select("ticker", r6("turnover").alias("turnover"))


@query("k11_first_cuts", f"WITH {M}, {BENCH_SQL}, {SNAP_SQL} SELECT s.ticker, coalesce(min(sid) FILTER (WHERE weight < bench - 1e-6), '') AS first_cut FROM snp s JOIN bench USING (ticker) WHERE portfolio = 'tilt' GROUP BY 1")
def k11(spark, sf):
    s = snapshots(spark, sf).filter("portfolio = 'tilt'").join(members(spark, sf).select("ticker", "bench"), "ticker")
    return marts.first_cut(s).select("ticker", F.coalesce(F.date_format("first_cut", "yyyy-MM"), F.lit("")).alias("first_cut"))


# ------------------------------------------------------------------ event study
TYPES = "['ECONOMY', 'SMALL', 'MEDIUM', 'PROMO', 'STANDARD', 'LARGE']"
ITEMS_V = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in FILING_ITEMS) + ") AS im(code, cls, sub, rank)"
STUDY_SQL = f"""fl AS (SELECT o_orderkey AS acc, 'TYPE_' || {TYPES}[o_orderkey % 6 + 1] AS ticker, o_orderdate + to_hours(o_orderkey % 24) AS ts, [{ORDER_ITEMS}[o_orderkey % 17 + 1], {ORDER_ITEMS}[o_custkey % 17 + 1]] AS items FROM orders),
{DAYS}, s1 AS (SELECT fl.*, (SELECT min(pos) FROM days WHERE date >= CAST(ts AS DATE)) AS p0 FROM fl), s2 AS (SELECT s1.*, p0 + CASE WHEN d.date = CAST(ts AS DATE) AND hour(ts) >= 16 THEN 1 ELSE 0 END AS pos, CASE WHEN strftime(ts, '%H:%M') < '09:30' THEN 'pre' WHEN hour(ts) < 16 THEN 'intraday' ELSE 'after' END AS timing FROM s1 JOIN days d ON d.pos = p0),
s3 AS (SELECT * FROM s2 WHERE pos + 1 <= (SELECT max(pos) FROM days) AND pos >= 260),
s4 AS (SELECT acc, ticker, pos, timing, arg_max(cls, (rank, -i)) AS cls, max(rank) AS rank FROM (SELECT s3.acc, ticker, pos, timing, unnest(items) AS code, unnest([1, 2]) AS i FROM s3) x LEFT JOIN {ITEMS_V} USING (code) GROUP BY ALL),
ev AS (SELECT ticker, pos, coalesce(arg_min(cls, (-coalesce(rank, 0), lpad(acc::VARCHAR, 12, '0'))) FILTER (WHERE true), 'OTHER') AS cls0, arg_min(coalesce(cls, 'OTHER'), (-coalesce(rank, 0), lpad(acc::VARCHAR, 12, '0'))) AS cls, arg_min(timing, (-coalesce(rank, 0), lpad(acc::VARCHAR, 12, '0'))) AS timing, max(coalesce(rank, 0)) AS rank, 2 * count(*) AS n_items, count(*) AS filings FROM s4 GROUP BY ticker, pos),
rr AS (SELECT series, date, pos, CASE WHEN lag(pos) OVER w = pos - 1 THEN ln(value) - lag(ln(value)) OVER w END AS r FROM px JOIN days USING (date) WINDOW w AS (PARTITION BY series ORDER BY pos)),
mm AS (SELECT a.series, a.date, a.pos, a.r, b.r AS x FROM rr a LEFT JOIN rr b ON b.pos = a.pos AND b.series = 'MKT' WHERE starts_with(a.series, 'TYPE_')),
md AS (SELECT *, count(CASE WHEN r IS NOT NULL AND x IS NOT NULL THEN 1 END) OVER e AS n, regr_slope(r, x) OVER e AS b, regr_intercept(r, x) OVER e AS a, regr_syy(r, x) OVER e AS syy, regr_sxx(r, x) OVER e AS sxx, stddev_pop(r) OVER t AS vol20, first_value(r) OVER f AS r1, first_value(x) OVER f AS x1
  FROM mm WINDOW e AS (PARTITION BY series ORDER BY pos RANGE BETWEEN 250 PRECEDING AND 31 PRECEDING), t AS (PARTITION BY series ORDER BY pos RANGE BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY series ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING)),
se2 AS (SELECT *, sqrt(greatest(syy - b * b * sxx, 0) / (n - 2)) AS s_e, r - (a + b * x) AS ar0, r1 - (a + b * x1) AS ar1 FROM md),
stu AS (SELECT ev.*, se2.date AS t0, (ar0 + ar1) / (s_e * sqrt(2.0)) AS scar, vol20 / s_e AS vol_ratio, v.value AS vix FROM ev JOIN se2 ON se2.series = ev.ticker AND se2.pos = ev.pos LEFT JOIN (SELECT pos + 1 AS pos, value FROM px JOIN days USING (date) WHERE series = 'VIX') v ON v.pos = ev.pos WHERE n >= 120 AND ar0 IS NOT NULL AND ar1 IS NOT NULL AND s_e > 0)"""


def filings(spark, sf) -> DataFrame:
    o = corpus.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    codes = F.array(*[F.lit(i[0]) for i in FILING_ITEMS], F.lit("8.01"), F.lit("9.01"))
    types = F.array(*[F.lit("TYPE_" + t) for t in ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")])
    return o.select(F.element_at(types, (k % 6 + 1).cast("int")).alias("ticker"), F.lpad(k.cast("string"), 12, "0").alias("accession"),
                    (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("accepted"),
                    F.concat_ws(", ", F.element_at(codes, (k % 17 + 1).cast("int")), F.element_at(codes, (c % 17 + 1).cast("int"))).alias("items"))


def studied(spark, sf) -> DataFrame:
    return staged(spark, sf, "study", lambda: study.study_events(filings(spark, sf), px(spark, sf).select("date", "series", "value"), "MKT", "VIX"))


@query("j14_event_sessions", f"WITH {M}, {STUDY_SQL} SELECT lpad(acc::VARCHAR, 12, '0') AS accession, pos, timing FROM s3")
def j14(spark, sf):
    """Forward as-of: filing -> first session at or after it."""
    return study.event_sessions(filings(spark, sf), market.calendar(px(spark, sf))).select("accession", big("pos").alias("pos"), "timing")


@query("a20_merged_filings", f"WITH {M}, {STUDY_SQL} SELECT ticker, pos, cls, timing, rank::BIGINT AS rank, n_items::BIGINT AS n_items, filings FROM ev")
def a20(spark, sf):
    m = study.merge_filings(study.event_sessions(filings(spark, sf), market.calendar(px(spark, sf))))
    return m.select("ticker", big("pos").alias("pos"), "cls", "timing", big("rank").alias("rank"), big("n_items").alias("n_items"), big("filings").alias("filings"))


@query("a21_market_model", f"WITH {M}, {STUDY_SQL} SELECT series, pos, round(b, 6) AS beta, round(a, 6) AS alpha, round(s_e, 6) AS s_e FROM se2 WHERE n >= 120")
def a21(spark, sf):
    """Rolling market model per series and day."""
    m = study.market_model(px(spark, sf).select("date", "series", "value").filter(F.col("series").startswith("TYPE_") | F.col("series").isin("MKT", "VIX")), "MKT", "VIX")
    return m.filter(F.col("series").startswith("TYPE_") & (F.col("n") >= 120)).select("series", big("pos").alias("pos"), r6("beta").alias("beta"), r6("alpha").alias("alpha"), r6("s_e").alias("s_e"))


@query("m16_event_study", f"WITH {M}, {STUDY_SQL} SELECT ticker, pos, cls, round(scar, 5) AS scar, (abs(scar) > 2)::BIGINT AS y, round(vol_ratio, 5) AS vol_ratio, vix FROM stu")
def m16(spark, sf):
    """Labelled events: standardised abnormal return, two-sigma flag, features."""
    return studied(spark, sf).select("ticker", big("pos").alias("pos"), "cls", F.round("scar", 5).alias("scar"), big("y").alias("y"), F.round("vol_ratio", 5).alias("vol_ratio"), "vix")


@query("a22_class_rates", f"WITH {M}, {STUDY_SQL} SELECT cls, count(*) AS n, round(avg((abs(scar) > 2)::INT), 6) AS two_sigma_rate, round(avg(abs(scar)), 6) AS mean_abs_scar FROM stu GROUP BY 1")
def a22(spark, sf):
    return study.class_rates(studied(spark, sf)).select("cls", "n", r6("two_sigma_rate").alias("two_sigma_rate"), r6("mean_abs_scar").alias("mean_abs_scar"))


@query("f27_study_features", f"WITH {M}, {STUDY_SQL}, md2 AS (SELECT median(vix) AS mv FROM stu) SELECT ticker, pos, round(ln(1 + n_items), 6) AS f_items, (filings > 1)::BIGINT AS f_multi, round(ln(greatest(0.2, least(5.0, coalesce(vol_ratio, 1.0)))), 6) AS f_vol, round(greatest(9.0, least(80.0, coalesce(vix, mv))) / 20.0, 6) AS f_vix FROM stu, md2")
def f27(spark, sf):
    f = study.features(studied(spark, sf))
    return f.select("ticker", big("pos").alias("pos"), r6("f_items").alias("f_items"), big("f_multi").alias("f_multi"), r6("f_vol").alias("f_vol"), r6("f_vix").alias("f_vix"))


SCORE_SQL = "sg AS (SELECT ticker AS pack, seq, (1 + (seq % 97)) / 100.0::DOUBLE AS p, (impact >= 6)::INT AS y, abs(sentiment) AS a, t FROM signals)"


def scored(spark, sf):
    return sig(spark, sf).select(F.col("ticker").alias("pack"), "seq", ((1 + F.col("seq") % 97) / 100.0).alias("p"), (F.col("impact") >= 6).cast("int").alias("y"), F.abs("sentiment").alias("a"))


@query("a23_reliability", f"WITH {S}, {SCORE_SQL} SELECT pack, least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM sg GROUP BY ALL")
def a23(spark, sf):
    r = study.reliability(scored(spark, sf), ["pack"])
    return r.select("pack", big("bin").alias("bin"), "n", r6("predicted").alias("predicted"), r6("observed").alias("observed"))


@query("a24_ranking_metrics", f"""WITH {S}, {SCORE_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY pack ORDER BY p) + (count(*) OVER (PARTITION BY pack, p) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY pack ORDER BY a) + (count(*) OVER (PARTITION BY pack, a) - 1) / 2.0 AS ra FROM sg)
SELECT pack, round((sum(rp) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg((p - y) * (p - y)), 6) AS brier, round(corr(rp, ra), 6) AS spearman FROM rk GROUP BY 1""")
def a24(spark, sf):
    """ROC AUC, Brier score and Spearman correlation per pack, ranks by bucketed scans."""
    s = scored(spark, sf)
    j = study.auc(s, ["pack"]).join(study.brier(s, ["pack"], 0.5), "pack").join(study.spearman(s, ["pack"], "p", "a"), "pack")
    return j.select("pack", r6("auc").alias("auc"), r6("brier").alias("brier"), r6("spearman").alias("spearman"))


@query("w15_decile_gap", f"WITH {S}, {SCORE_SQL}, d AS (SELECT *, floor((row_number() OVER (PARTITION BY pack ORDER BY p, seq) - 1) * 10 / count(*) OVER (PARTITION BY pack)) AS dec FROM sg) SELECT pack, round(avg(a) FILTER (WHERE dec = 9), 6) AS top, round(avg(a) FILTER (WHERE dec = 0), 6) AS bottom FROM d GROUP BY 1")
def w15(spark, sf):
    return study.decile_gap(scored(spark, sf), ["pack"], ["seq"], "p", "a").select("pack", r6("top").alias("top"), r6("bottom").alias("bottom"))


def calibration(spark, sf):
    """The fitted impact model and the scored study rows."""
    return staged(spark, sf, "calibration", lambda: study.calibrate(studied(spark, sf), corpus.STUDY_SPLITS))


@query("m17_impact_calibration")
def m17(spark, sf):
    """Logistic model on the training years, isotonic map on the next year, metrics per split."""
    _, rows = calibration(spark, sf)
    j = study.auc(rows, ["split"]).join(study.brier(rows, ["split"], 0.05), "split")
    return j.select("split", "n", big("pos").alias("positives"), r6("auc").alias("auc"), r6("brier").alias("brier"))
