"""Portfolio stress: every request and severity multiple in one pass over the positions.

A run is one (request, m). Runs are a small table (checked); each position is expanded by the run
numbers, meets its run by hash join, is revalued by column expressions and folded on the map side,
so the exchange carries totals, not positions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.functions import risk
from riskloom.operators.book import _by_notch, capital_weighted
from riskloom.session import cut

BROADCAST_RUNS = 4096
CLASSES = ("Loans", "Bonds", "Equities")   # with formulas of their own; anything else is a derivative
COARSE_GRID = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0)


def _cap(factor: Column, value: Column) -> Column:
    """Scaled shocks stay physical: prices above -95%, yields above zero, spreads above -50 bp."""
    rate = {f: -_base(t) * 10_000 for t, f in fin.TENORS}
    floor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rate.items() for x in kv]), factor), F.lit(-_base(10.0) * 10_000))
    return (
        F.when(factor.rlike("^(EQ|EQN|FX|CM):"), F.greatest(F.lit(-0.95), value)).when(factor.startswith("IR:"), F.greatest(floor, value))
        .when(factor.startswith("CR:"), F.greatest(F.lit(-50.0), value)).when(factor == "VOL:VIX", F.greatest(F.lit(-10.0), value)).otherwise(value))


def _base(years: float) -> float:
    for (t0, r0), (t1, r1) in zip(fin.CURVE, fin.CURVE[1:]):
        if years <= t1:
            return r0 + (r1 - r0) * (max(years, t0) - t0) / (t1 - t0)
    return fin.CURVE[-1][1]


def scoped_shocks(vectors: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Shock vector per scenario; an india-scope scenario keeps Indian factors and name-level moves."""
    s = scenarios.select("scenario", "scope", "epicenters").join(vectors, "scenario", "left")
    keep = F.map_filter("shock", lambda k, v: k.isin(*fin.INDIA_FACTORS) | k.startswith("EQN:"))
    out = s.withColumn("shock", F.when(F.col("scope") == "india", keep).otherwise(F.col("shock")))
    at = lambda k: F.abs(F.coalesce(F.try_element_at("shock", F.lit(k)), F.lit(0.0)))
    raw = F.greatest(at("EQ:MKT") / 0.20, at("CR:HY") / 400.0, at("EQ:IN") / 0.20)
    return out.withColumn("systemic", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.1), raw)), 3))


RUN_SHOCKS = {"s_inr": "FX:USDINR", "s_in10": "IR:IN10Y", "s_eur": "FX:EURUSD", "s_vix": "VOL:VIX", "s_mkt": "EQ:MKT",
              "s_ig": "CR:IG", "s_bbb": "CR:BBB", "s_hy": "CR:HY"}


def _rate_at(pts: Column, years: Column) -> Column:
    """Linear interpolation over the present tenors, flat outside, 0 without any."""
    below = F.filter(pts, lambda p: p["t"] < years)
    above = F.filter(pts, lambda p: p["t"] >= years)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    return F.when(F.size(pts) == 0, 0.0).when(F.size(below) == 0, b["v"]).when(F.size(above) == 0, a["v"]).otherwise(
        a["v"] + (b["v"] - a["v"]) * (years - a["t"]) / (b["t"] - a["t"]))


def build_runs(requests: DataFrame, obligors: DataFrame, vectors: DataFrame, scenarios: DataFrame) -> DataFrame:
    """One row per (request, m): scaled shocks, systematic factor, overlay and epicentre attributes.

    ``requests``: req_id, scenario, impact, epicenter, event_class, subtype, m.
    """
    sev = F.array(*[F.struct(F.lit(m).alias("mult"), F.lit(z).alias("z")) for _, m, z in fin.SEVERITY])
    lo, hi = fin.SEVERITY[0][0], fin.SEVERITY[-1][0]
    level = F.element_at(sev, F.least(F.lit(hi), F.greatest(F.lit(lo), F.col("impact"))).cast("int") - lo + 1)
    over = F.create_map(*[x for c, n, eq, bp, dmin, con in fin.OVERLAYS for x in (F.lit(c), F.struct(
        F.lit(n).alias("notches"), F.lit(eq).alias("equity"), F.lit(bp).alias("bp"), F.lit(dmin).alias("default_from"), F.lit(con).alias("contagion")))])
    r = requests.join(scoped_shocks(vectors, scenarios), "scenario", "left")
    r = r.withColumn("ov", F.coalesce(F.try_element_at(over, F.coalesce("event_class", F.lit("default"))), F.try_element_at(over, F.lit("default"))))
    epi = obligors.join(requests.select(F.col("epicenter").alias("obligor_id")).distinct(), "obligor_id", "left_semi").select(
        F.col("obligor_id").alias("epicenter"), F.struct("sector", "bank", "country", "group").alias("epi"))
    r = r.join(epi, "epicenter", "left")
    m = F.col("m")
    scaled = F.transform_values("shock", lambda k, v: _cap(k, v * F.col("mult")))
    on = F.col("epi").isNotNull() & (m > 0)
    n = F.bround(F.col("ov.notches") * m, 0).cast("int")
    r = r.withColumn("mult", level["mult"] * m).withColumn("z", level["z"] * F.coalesce("systemic", F.lit(0.1)) * m).withColumn("shock", F.coalesce(scaled, F.create_map().cast("map<string,double>")))
    share = F.when(F.col("ov.contagion") == "group", fin.GROUP_SHARE).otherwise(fin.CONTAGION_SHARE)
    defaulted = on & F.coalesce("subtype", F.lit("")).isin(*fin.DEFAULT_SUBTYPES) & (F.col("impact") >= F.col("ov.default_from")) & (m >= 0.5)
    own_move = F.coalesce(F.array_contains("epicenters", F.col("epicenter")), F.lit(False))
    # what a position needs often becomes a plain column of the run; a missing tenor takes the value
    # interpolated from the present ones, which leaves the curve unchanged
    rates = F.filter(F.array(*[F.struct(F.lit(t).alias("t"), F.try_element_at("shock", F.lit(f)).alias("v")) for t, f in fin.TENORS]), lambda p: p["v"].isNotNull())
    flat = [F.coalesce(F.try_element_at("shock", F.lit(f)), F.lit(0.0)).alias(c) for c, f in RUN_SHOCKS.items()]
    r = r.withColumn("rates", rates)
    tenors = [_rate_at(F.col("rates"), F.lit(t)).alias(f"t{i}") for i, (t, _) in enumerate(fin.TENORS)]
    out = r.select(
        "req_id", "scenario", "impact", "m", "mult", "z", "shock", "systemic", *flat, *tenors, F.when(on, F.col("epicenter")).alias("epi_id"), F.col("epicenter"), "epi",
        F.when(on, n).otherwise(0).alias("epi_notches"),
        F.when(on, F.bround(n * share, 0).cast("int")).otherwise(0).alias("peer_notches"), F.col("ov.contagion").alias("contagion"),
        defaulted.alias("epi_defaults"), F.when(on & ~own_move, F.col("ov.equity") * m).otherwise(0.0).alias("equity_idio"), F.col("ov.bp").alias("bp_per_notch"))
    return cut(with_migration(cut(out.withColumn("run", F.row_number().over(Window.orderBy("req_id", "m")) - 1))))


def with_migration(runs: DataFrame) -> DataFrame:
    """Add what a run's factor ``z`` does to each rating: ``n2_of`` (the rating after migration) and ``pds_of`` (the stressed
    default probability of that rating), by the rating before. Positions look them up; the normal distribution stays here."""
    rows, top, z = fin.rating_rows(), fin.NOTCH["D"], F.col("z")
    pd, *rest = ([getattr(r, c) for r in rows] for c in ("pd", "threshold", "sqrt_rho", "sqrt_one_less_rho"))

    def stressed(n: Column) -> Column:
        return risk.stressed_pd(_by_notch(pd, n), *(_by_notch(v, n) for v in rest), z)

    after = F.transform(F.sequence(F.lit(0), F.lit(top)), lambda n: F.least(n + risk.systematic_notches(_by_notch(pd, n), stressed(n), z), F.lit(top)))
    return runs.withColumn("n2_of", after).withColumn("pds_of", F.transform("n2_of", lambda n: F.when(
        z < 0, F.greatest(_by_notch(pd, n), stressed(n))).otherwise(_by_notch(pd, n))))


def with_multiples(requests: DataFrame, multiples: Sequence[float]) -> DataFrame:
    return requests.withColumn("m", F.explode(F.array(*[F.lit(float(x)) for x in multiples])))


def revalue(positions: DataFrame, runs: DataFrame) -> DataFrame:
    """(position, run) rows: value change, stressed rating, stage, expected loss and capital.

    Positions are expanded by run number, so the join has as many keys as runs; asset classes apart, because all their
    formulas together are more than Spark compiles. Up to ``BROADCAST_RUNS`` runs (a few
    kilobytes each) travel to the positions; more are joined by a shuffle over their many numbers.
    """
    n_runs = runs.count()
    every = F.explode(F.slice(F.sequence(F.lit(0), F.lit(max(n_runs, 1) - 1)), 1, n_runs))
    kind = F.coalesce("asset_class", F.lit(""))
    parts = [(kind == k, k) for k in CLASSES] + [(~kind.isin(*CLASSES), "Derivatives")]
    runs = F.broadcast(runs) if n_runs <= BROADCAST_RUNS else runs
    return reduce(DataFrame.unionByName, [_revalued(positions.filter(rows).withColumn("run", every).join(runs, "run"), F.lit(k)) for rows, k in parts])


def _revalued(x: DataFrame, asset: Column) -> DataFrame:
    """(position, run) rows of one asset class, a literal, so that only its own formulas are left."""
    rows = fin.rating_rows()
    is_epi = F.col("obligor_id") == F.col("epi_id")
    group_peer = (F.col("contagion") == "group") & (F.coalesce("epi.group", F.lit("")) != "") & (F.col("group") == F.col("epi.group"))
    sector_peer = (F.col("contagion") != "group") & (F.col("sector") == F.col("epi.sector")) & (F.col("bank") == F.col("epi.bank")) & (F.col("country") == F.col("epi.country"))
    named = F.col("instrument").isin("TERM_LOAN", "REVOLVER", "BOND", "CDS", "EQUITY") & ~F.col("sovereign")
    x = x.withColumn("hit", F.coalesce(named & is_epi, F.lit(False))).withColumn("peer", F.coalesce(named & (group_peer | sector_peer), F.lit(False)))
    x = x.withColumn("n", F.when(F.col("hit"), F.col("epi_notches")).when(F.col("peer"), F.col("peer_notches")).otherwise(0)).withColumn(
        "dflt", F.col("hit") & F.col("epi_defaults"))
    top = fin.NOTCH["D"]
    bucket = F.when(F.col("notch").isNull(), F.col("s_bbb")).when(F.col("notch") <= fin.NOTCH["A-"], F.col("s_ig")).when(
        F.col("notch") <= fin.NOTCH["BBB-"], F.col("s_bbb")).otherwise(F.col("s_hy"))
    # what is used more than once is a column of its own, so each projection stays small enough to be compiled
    x = x.withColumn("spread", bucket + F.col("bp_per_notch") * F.col("n"))
    spread = F.col("spread")
    usdinr = F.col("s_inr")
    inr = F.col("currency") == "INR"
    knots = [(t, F.col(f"t{i}")) for i, (t, _) in enumerate(fin.TENORS)]
    r_at = F.when(F.col("years") <= knots[0][0], knots[0][1])
    for (t0, v0), (t1, v1) in zip(knots, knots[1:]):
        r_at = r_at.when(F.col("years") <= t1, v0 + (v1 - v0) * (F.col("years") - t0) / (t1 - t0))
    x = x.withColumn("r_at", r_at.otherwise(knots[-1][1]))
    dy_bp = F.when(inr, F.col("s_in10")).otherwise(F.col("r_at")) + F.when(F.col("sovereign"), 0.0).otherwise(spread)
    x = x.withColumn("dy", dy_bp / 10_000.0)
    dy = F.col("dy")
    x = x.withColumn("b0", F.col("v0") * (-F.col("mod_dur") * dy + 0.5 * F.col("convexity") * dy * dy))
    b0 = F.col("b0")
    bond = F.when(F.col("dflt"), F.col("face") * (1.0 - F.col("lgd")) - F.col("v0")).otherwise(
        F.when(inr, b0 + (F.col("v0") + b0) * (1.0 / (1.0 + usdinr) - 1.0)).otherwise(b0))
    fx = F.col("notional") * F.when(F.col("pair") == "USDINR", F.col("s_inr")).otherwise(F.col("s_eur")) * F.col("sign")
    payout = F.col("notional") * F.col("lgd")
    cds = F.when(F.col("dflt"), F.when(F.col("bought"), payout).otherwise(-payout)).otherwise(F.col("cs01") * spread)
    under = F.coalesce(F.try_element_at("shock", F.col("underlying")), F.col("s_mkt"))
    x = x.withColumn("ds", F.when((asset == "Derivatives") & (F.col("instrument") == "EQ_OPTION"), 100.0 * under))
    ds = F.col("ds")
    option = F.col("units") * (F.col("delta") * ds + 0.5 * F.col("gamma") * ds * ds + F.col("vega") * F.col("s_vix") / 100.0)
    own = F.try_element_at("shock", F.concat(F.lit("EQN:"), F.col("obligor_id")))
    market = F.coalesce(F.try_element_at("shock", F.col("factor")), F.col("s_mkt")) * F.col("beta")
    x = x.withColumn("base_ret", F.when(asset == "Equities", F.coalesce(own, market)))
    base_ret = F.col("base_ret")
    ret = F.greatest(F.lit(-1.0), F.when(F.col("dflt"), -0.95).when(F.col("obligor_id") == F.col("epicenter"), (1.0 + base_ret) * (1.0 + F.col("equity_idio")) - 1.0).otherwise(base_ret))
    equity = F.when(inr, F.col("value") * ((1.0 + ret) / (1.0 + usdinr) - 1.0)).otherwise(F.col("value") * ret)
    inst = F.col("instrument")
    d_mtm = (
        F.when(asset == "Bonds", bond).when(asset == "Equities", equity).when(inst == "IRS", F.col("dv01") * F.col("r_at")).when(inst == "FX_FWD", fx).when(inst == "CDS", cds)
        .when(inst == "EQ_OPTION", option).otherwise(0.0))
    # credit: idiosyncratic notches, then systematic migration from the stressed PD
    loan = asset == "Loans"
    by = lambda values, notch: _by_notch(values, notch)
    pds = [r.pd for r in rows]
    x = x.withColumn("n1", F.least(F.col("notch") + F.col("n"), F.lit(top)))
    x = x.withColumn("n2", F.when(loan, F.get("n2_of", F.col("n1")))).withColumn("pds", F.when(loan, F.get("pds_of", F.col("n1"))))
    x = x.withColumn("pd2", by(pds, F.col("n2")))
    x = x.withColumn("stage1", F.when(loan & F.col("dflt"), 3).when(loan, risk.stage_of(F.coalesce("orig_notch", "notch"), F.col("n2"))))
    ecl1 = F.when(loan & F.col("dflt"), F.col("lgd") * F.col("ead")).when(
        loan, risk.expected_loss(F.col("stage1"), F.col("pds"), F.col("lgd"), F.col("ead"), F.col("years"), F.col("pd2"))).otherwise(0.0)
    x = x.withColumn("ecl1", ecl1).withColumn("pnl", F.when(loan, F.col("ecl0") - F.col("ecl1")).otherwise(d_mtm))
    notch1 = F.when(loan, F.when(F.col("dflt"), top).otherwise(F.col("n2"))).when(
        (asset == "Bonds") & ~F.col("sovereign"), F.when(F.col("dflt"), top).otherwise(F.col("n1"))).otherwise(F.col("notch"))
    x = x.withColumn("notch1", notch1)
    bad = F.when(loan, F.col("stage1") == 3).otherwise(F.col("dflt"))
    x = x.withColumn("rwa1", capital_weighted(F.col("notch1"), bad, F.col("v0") + F.col("pnl"), asset))
    return x.select("run", "req_id", "m", "pos_id", "asset_class", "instrument", "obligor_id", "sector", "v0", "pnl", "stage0", "stage1", "ecl0", "ecl1",
                    "ead", "notch", "notch1", "rwa0", "rwa1", "dflt")


def by_class(rows: DataFrame) -> DataFrame:
    """Value before and after and P&L per asset class; loans are net of their allowance on both sides."""
    return rows.groupBy("req_id", "m", "asset_class").agg(
        F.sum(F.col("v0") - F.col("ecl0")).alias("value_before"),
        F.sum(F.when(F.col("asset_class") == "Loans", F.col("v0") - F.col("ecl1")).otherwise(F.col("v0") + F.col("pnl"))).alias("value_after"),
        F.sum("pnl").alias("pnl"))


def capital_after(rows: DataFrame) -> DataFrame:
    """Per run: expected loss before and after, pre-tax loss, CET1 and its ratio."""
    t = rows.groupBy("req_id", "m").agg(
        F.sum("ecl0").alias("ecl_before"), F.sum("ecl1").alias("ecl_after"), F.sum("rwa0").alias("rwa_before"), F.sum("rwa1").alias("rwa_after"),
        (-F.sum("pnl")).alias("pre_tax_loss"))
    cet1 = fin.START_CET1 * F.col("rwa_before") - (1.0 - fin.TAX_RATE) * F.col("pre_tax_loss")
    return t.withColumn("cet1_before", fin.START_CET1 * F.col("rwa_before")).withColumn("cet1_after", cet1).withColumn(
        "cet1_ratio", F.col("cet1_after") / F.col("rwa_after"))


def stage_losses(rows: DataFrame) -> DataFrame:
    """Expected loss by stage before and after."""
    loans = rows.filter("asset_class = 'Loans'")
    both = loans.select("req_id", "m", F.explode(F.array(
        F.struct(F.col("stage0").alias("stage"), F.col("ecl0").alias("before"), F.lit(0.0).alias("after")),
        F.struct(F.col("stage1").alias("stage"), F.lit(0.0).alias("before"), F.col("ecl1").alias("after")))).alias("s"))
    return both.groupBy("req_id", "m", "s.stage").agg(F.sum("s.before").alias("ecl_before"), F.sum("s.after").alias("ecl_after"))


def stage_flows(rows: DataFrame) -> DataFrame:
    return rows.filter("asset_class = 'Loans'").groupBy("req_id", "m", "stage0", "stage1").agg(
        F.count("*").alias("facilities"), F.sum("ead").alias("ead"))


def loss_heatmap(rows: DataFrame) -> DataFrame:
    return rows.groupBy("req_id", "m", "sector", "asset_class").agg((-F.sum("pnl")).alias("loss"))


def top_contributors(rows: DataFrame, k: int = 10) -> DataFrame:
    """Ten largest losses per run, then only the positive ones; the limit is applied before the shuffle."""
    w = Window.partitionBy("run").orderBy(F.col("pnl"), "pos_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).filter(F.col("pnl") < 0).select(
        "req_id", "m", "rank", "pos_id", "asset_class", "sector", (-F.col("pnl")).alias("loss"))


def weighted_ecl(totals: DataFrame) -> DataFrame:
    """Probability-weighted expected loss: base, half severity and full severity."""
    e = fin.ECL_WEIGHTS
    half = totals.select("req_id", (F.col("m") * 2.0).alias("m"), F.col("ecl_after").alias("adverse"))
    return totals.join(half, ["req_id", "m"]).select("req_id", "m", (
        e["base"] * F.col("ecl_before") + e["adverse"] * F.col("adverse") + e["severe"] * F.col("ecl_after")).alias("ecl_weighted"))


def ratios(positions: DataFrame, requests: DataFrame, obligors: DataFrame, vectors: DataFrame, scenarios: DataFrame, multiples: Sequence[float]) -> DataFrame:
    runs = build_runs(with_multiples(requests, multiples), obligors, vectors, scenarios)
    return capital_after(revalue(positions, runs)).select("req_id", "m", "cet1_ratio")


def reverse_stress(positions: DataFrame, requests: DataFrame, obligors: DataFrame, vectors: DataFrame, scenarios: DataFrame,
                   floors: dict[str, float] | None = None) -> DataFrame:
    """Multiple (on a 0.01 grid) at which CET1 first reaches each floor inside the first coarse bracket that ends below it.

    A coarse grid finds the bracket, one more job evaluates the 0.01 grid inside it; null where no coarse point up to 10x
    is below. A ratio that dips under the floor and recovers between two coarse points is not seen.
    """
    floors = floors or {"rbi": fin.RBI_FLOOR, "basel": fin.BASEL_FLOOR}
    coarse = cut(ratios(positions, requests, obligors, vectors, scenarios, COARSE_GRID))
    levels = F.array(*[F.struct(F.lit(k).alias("floor"), F.lit(v).alias("level")) for k, v in floors.items()])
    lower = F.create_map(*[F.lit(x) for a, b in zip((0.0, *COARSE_GRID), COARSE_GRID) for x in (b, a)])
    hit = coarse.withColumn("f", F.explode(levels)).filter(F.col("cet1_ratio") <= F.col("f.level")).groupBy("req_id", F.col("f.floor").alias("floor")).agg(
        F.min("m").alias("hi"))
    fine = hit.withColumn("lo", F.try_element_at(lower, F.col("hi"))).withColumn("m", F.explode(F.transform(
        F.sequence(F.bround(F.col("lo") * 100 + 1, 0).cast("int"), F.bround(F.col("hi") * 100, 0).cast("int")), lambda i: i / 100.0)))
    runs = build_runs(requests.join(fine.select("req_id", "m").distinct(), "req_id"), obligors, vectors, scenarios)
    values = capital_after(revalue(positions, runs)).select("req_id", "m", "cet1_ratio")
    found = fine.select("req_id", "floor", "m").join(values, ["req_id", "m"]).withColumn(
        "level", F.try_element_at(F.create_map(*[F.lit(x) for kv in floors.items() for x in kv]), F.col("floor"))).filter(
            F.col("cet1_ratio") <= F.col("level")).groupBy("req_id", "floor").agg(F.min("m").alias("reverse_m"))
    every = requests.select("req_id").distinct().withColumn("floor", F.explode(F.array(*[F.lit(k) for k in floors])))
    return every.join(found, ["req_id", "floor"], "left")


def memo_facts(rows: DataFrame) -> DataFrame:
    """The numbers of a risk memo, one wide row per run."""
    totals = capital_after(rows)
    classes = by_class(rows).groupBy("req_id", "m").agg(
        F.sum("value_before").alias("value_before"), F.sum("value_after").alias("value_after"),
        F.min_by("asset_class", F.struct("pnl", "asset_class")).alias("worst_class"), F.min("pnl").alias("worst_pnl"))
    moves = stage_flows(rows).groupBy("req_id", "m").agg(
        F.sum(F.when((F.col("stage0") == 1) & (F.col("stage1") == 2), F.col("facilities")).otherwise(0)).alias("to_stage2"),
        F.sum(F.when((F.col("stage0") == 1) & (F.col("stage1") == 2), F.col("ead")).otherwise(0.0)).alias("ead_to_stage2"),
        F.sum(F.when((F.col("stage0") != 3) & (F.col("stage1") == 3), F.col("facilities")).otherwise(0)).alias("to_stage3"))
    top = top_contributors(rows).filter("rank <= 5").groupBy("req_id", "m").agg(
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos_id"))), lambda s: s["pos_id"])).alias("top5"))
    return totals.join(classes, ["req_id", "m"]).join(moves, ["req_id", "m"], "left").join(top, ["req_id", "m"], "left").withColumn(
        "breach", F.col("cet1_ratio") <= fin.RBI_FLOOR)
