"""Pricing, credit and tilt identities."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.functions import risk
from riskloom.operators import tilt


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_normal_cdf(spark):
    zs = [-9.0, -3.2, -0.5, 0.0, 0.7, 2.5, 8.0]
    got = [r["c"] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(risk.normal_cdf(F.col("z")).alias("c")).collect()]
    assert all(abs(g - NormalDist().cdf(z)) < 1e-14 for g, z in zip(got, zs))


def test_par_bond_and_put_call_parity(spark):
    r = one(spark, b=risk.bond_measures(F.lit(0.04), F.lit(10.0), F.lit(0.04)), z=risk.bond_measures(F.lit(0.05), F.lit(3.0), F.lit(0.0)),
            c=risk.option_greeks(F.lit(100.0), F.lit(95.0), F.lit(1.0), F.lit(0.2), F.lit(0.04), F.lit(True)),
            p=risk.option_greeks(F.lit(100.0), F.lit(95.0), F.lit(1.0), F.lit(0.2), F.lit(0.04), F.lit(False)))
    assert abs(r["b"]["price"] - 100) < 1e-9 and abs(r["z"]["price"] - 115) < 1e-9
    assert abs(r["c"]["delta"] - r["p"]["delta"] - 1) < 1e-12
    assert abs(r["c"]["price"] - r["p"]["price"] - (100 - 95 * math.exp(-0.04))) < 1e-9


def test_staging_and_stressed_pd(spark):
    bbb = next(x for x in fin.rating_rows() if x.rating == "BBB")
    lit = F.lit
    r = one(spark, a=risk.stage_of(lit(8), lit(8)), b=risk.stage_of(lit(8), lit(11)), c=risk.stage_of(lit(12), lit(12)), d=risk.stage_of(lit(8), lit(17)),
            p1=risk.stressed_pd(lit(bbb.pd), lit(bbb.threshold), lit(bbb.sqrt_rho), lit(bbb.sqrt_one_less_rho), lit(-1.5)),
            p2=risk.stressed_pd(lit(bbb.pd), lit(bbb.threshold), lit(bbb.sqrt_rho), lit(bbb.sqrt_one_less_rho), lit(-2.33)))
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 2, 2, 3)
    assert bbb.pd < r["p1"] < r["p2"]


def test_impact_grows_with_evidence(spark):
    def at(pubs, s):
        return risk.to_impact(risk.sigmoid(risk.prior_logit(F.lit("CREDIT_EVENT"), F.lit("BANK_RUN"), F.lit(s), F.lit(pubs), F.lit(0), F.lit(False), F.lit(100), F.lit(100))))

    r = one(spark, a=at(0, 0.1), b=at(1, 0.8), c=at(6, 0.9))
    assert r["a"] < r["b"] < r["c"] <= 10


def test_capped_weights(spark):
    caps = spark.createDataFrame([("i", t, v) for t, v in zip("abcdefgh", [50.0, 20.0, 10.0, 6.0, 5.0, 4.0, 3.0, 2.0])], "g string, ticker string, cap double")
    w = {r["ticker"]: r["bench"] for r in tilt.capped_weights(caps, ["g"], cap=0.15).collect()}
    v = np.array([50.0, 20.0, 10.0, 6.0, 5.0, 4.0, 3.0, 2.0]) / 100
    for _ in range(200):                      # the iterative rule
        over = v > 0.15 + 1e-12
        if not over.any():
            break
        extra = (v[over] - 0.15).sum()
        v[~over] += extra * v[~over] / v[~over].sum()
        v[over] = 0.15
    assert abs(sum(w.values()) - 1) < 1e-9 and np.allclose([w[t] for t in "abcdefgh"], v, atol=1e-9)


def test_projection_respects_caps_and_breakers():
    bench = np.full(10, 0.1)
    sectors = [np.arange(0, 5), np.arange(5, 10)]
    groups = np.array(["", "G", "G"] + [""] * 7)
    raw = np.array([np.linspace(0.02, 0.18, 10)] * 2)
    raw /= raw.sum(1)[:, None]
    brk = np.zeros((2, 10), bool)
    brk[1, 1] = True
    w = tilt._project_rows(raw, brk, bench, sectors, groups, fin.TiltConfig())
    assert np.allclose(w.sum(1), 1, atol=1e-6) and (w <= 0.15 + 1e-9).all() and (w >= 0.05 - 1e-9).all()
    assert abs((w[0, 5:] - 0.1).sum()) <= 0.05 + 1e-6
    assert abs(w[1, 1] - 0.05) < 1e-12 and w[1, 2] <= 0.1 + 1e-12


def test_stress_by_class_looks_up_migration(spark):
    """Every position and run once, whatever the asset class; ratings after migration equal the formulas at every rating."""
    import datetime as dt

    from riskloom.operators import book, stress
    from riskloom.session import cut

    kinds = ("TERM_LOAN", "REVOLVER", "BOND", "IRS", "FX_FWD", "CDS", "EQ_OPTION", "EQUITY")
    extra = {"CDS": "reference=C2", "FX_FWD": "pair=USDINR", "EQ_OPTION": "underlying=EQ:MKT;type=CALL"}
    trades = spark.createDataFrame([
        (f"F{i}{n}", k, dt.date(2001, 1, 1), "t", f"C{n}", "DRAW" if i < 2 else "BUY" if k == "BOND" else "LONG", 1000.0, 0.05, dt.date(2001 + 2 * (n + 1), 6, 1), "SECURED", "INR" if n % 2 else "USD", extra.get(k, ""))
        for i, k in enumerate(kinds) for n in range(17)],
        "facility_id string, instrument string, trade_date date, trade_id string, counterparty string, direction string, notional double, rate double, maturity date, "
        "collateral string, currency string, extra string")
    obligors = spark.createDataFrame([(f"C{n}", f"N{n}", "Financials", "US", n, max(0, n - 1), n == 2, "") for n in range(17)],
                                     "obligor_id string, name string, sector string, country string, notch int, orig_notch int, bank boolean, group string")
    positions = cut(book.build_positions(book.net_trades(book.parse_extra(trades)), obligors, "2001-12-31"))
    vectors = spark.createDataFrame([("s", {"EQ:MKT": -0.3, "IR:2Y": 50.0, "CR:HY": 300.0, "FX:USDINR": 0.1, "VOL:VIX": 20.0})], "scenario string, shock map<string,double>")
    scenarios = spark.createDataFrame([("s", "global", [])], "scenario string, scope string, epicenters array<string>")
    requests = spark.createDataFrame([("r", "s", 10, "C2", "CREDIT_EVENT", "BANK_RUN")], "req_id string, scenario string, impact int, epicenter string, event_class string, subtype string")
    runs = stress.build_runs(stress.with_multiples(requests, (0.0, 0.5, 1.0)), obligors, vectors, scenarios)
    spark.conf.set("spark.sql.codegen.fallback", "false")   # a stage that is too large to compile is an error
    try:
        found = stress.revalue(positions, runs).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(found) == 17 * len(kinds) * 3
    assert {r.asset_class for r in found} == {"Loans", "Bonds", "Equities", "Derivatives"}
    assert all(r.pnl is not None and r.rwa1 is not None for r in found)
    rows = fin.rating_rows()
    by = lambda c, n: F.get(F.array(*[F.lit(getattr(r, c)) for r in rows]), n)
    z, n = F.col("z"), F.col("n")
    at = lambda n: risk.stressed_pd(by("pd", n), by("threshold", n), by("sqrt_rho", n), by("sqrt_one_less_rho", n), z)
    direct = runs.select("m", "z", "n2_of", "pds_of", F.explode(F.sequence(F.lit(0), F.lit(17))).alias("n")).withColumn(
        "n2", F.least(n + risk.systematic_notches(by("pd", n), at(n), z), F.lit(17))).withColumn("p2", F.when(z < 0, F.greatest(by("pd", F.col("n2")), at(F.col("n2")))).otherwise(by("pd", F.col("n2"))))
    want = direct.collect()
    assert all(r.n2_of[r.n] == r.n2 and r.pds_of[r.n] == r.p2 for r in want) and any(r.n2 > r.n for r in want)
    after = {(r.m, r.n): r.n2 for r in want}
    loans = [r for r in found if r.asset_class == "Loans" and not r.dflt and r.obligor_id != "C2"]
    assert loans and all(r.notch1 == after[r.m, r.notch] for r in loans)
