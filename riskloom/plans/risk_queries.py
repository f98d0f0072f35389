"""Book, stress, capital and reverse stress over ``lineitem``, ``orders`` and ``customer``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.dims import finance as fin
from riskloom.functions import risk
from riskloom.operators import book, market, marts, stress
from riskloom.plans.market_queries import FACT, M, SHOCK_SQL, scenarios, shocks
from riskloom.plans.registry import big, query, r6, staged
from riskloom.session import cut

RT = fin.rating_rows()
O, T = corpus.OBLIGOR_SQL, corpus.TRADES_SQL


def arr(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in values) + "]"


def sql_curve(y: str) -> str:
    c = fin.CURVE
    out = f"CASE WHEN {y} <= {c[0][0]} THEN {c[0][1]}::DOUBLE "
    for (t0, r0), (t1, r1) in zip(c, c[1:]):
        out += f"WHEN {y} <= {t1} THEN {r0}::DOUBLE + ({y} - {t0}::DOUBLE) / {t1 - t0}::DOUBLE * {r1 - r0!r}::DOUBLE "
    return out + f"ELSE {c[-1][1]}::DOUBLE END"


def sql_cdf(z: str) -> str:
    """The normal distribution as SQL text (same rational function)."""
    x = f"abs({z})"
    num = f"{risk._NUM[0]!r}::DOUBLE"
    den = f"{risk._DEN[0]!r}::DOUBLE"
    for c in risk._NUM[1:]:
        num = f"({num} * {x} + {c!r}::DOUBLE)"
    for c in risk._DEN[1:]:
        den = f"({den} * {x} + {c!r}::DOUBLE)"
    low = f"CASE WHEN {x} > 37 THEN 0.0 WHEN {x} < {risk._SPLIT!r}::DOUBLE THEN exp(-{x} * {x} / 2) * {num} / {den} ELSE exp(-{x} * {x} / 2) / ({x} + 1 / ({x} + 2 / ({x} + 3 / ({x} + 4 / ({x} + 0.65))))) / {risk._ROOT_TWO_PI!r}::DOUBLE END"
    return f"(CASE WHEN {z} > 0 THEN 1 - ({low}) ELSE ({low}) END)"


NET_SQL = f"""t2 AS (SELECT *, (trade_date, trade_id) AS tord, CASE WHEN inst = 'BOND' AND o_custkey % 9 = 0 THEN 'UST' WHEN inst = 'BOND' AND o_custkey % 9 = 1 THEN 'GSEC' ELSE cust END AS party,
  CASE WHEN inst = 'EQ_OPTION' THEN 0.8 + d * 4 WHEN inst = 'CDS' THEN 0.005 + d / 10 ELSE 0.01 + d END AS rate, CASE WHEN ls = 'F' THEN 0.25 WHEN ln % 2 = 1 THEN 0.40 ELSE 0.75 END AS lgd0 FROM trades),
net AS (SELECT facility_id, any_value(inst) AS inst, any_value(party) AS party, any_value(o_custkey) AS ck, any_value(cust) AS cust, arg_max(rate, tord) AS rate, any_value(maturity) AS maturity, arg_max(lgd0, tord) AS lgd0, arg_max(rf, tord) AS last_rf, arg_min(rf, tord) AS first_rf, count(*) AS n,
  sum(CASE WHEN inst IN ('TERM_LOAN', 'REVOLVER') AND rf = 'A' THEN notional ELSE 0 END) AS lim, sum(CASE WHEN inst NOT IN ('TERM_LOAN', 'REVOLVER') THEN 0 WHEN rf = 'N' THEN notional WHEN rf = 'R' THEN -notional ELSE 0 END) AS drawn0,
  sum(CASE WHEN inst <> 'BOND' THEN 0 WHEN rf = 'R' THEN -notional ELSE notional END) AS face, sum(CASE WHEN inst IN ('TERM_LOAN', 'REVOLVER', 'BOND') THEN 0 ELSE notional END) AS notional FROM t2 GROUP BY facility_id)"""


def blotter(spark, sf) -> DataFrame:
    return book.parse_extra(corpus.trades(spark, sf))


@query("a13_net_trades", f"WITH {T}, {NET_SQL} SELECT facility_id, inst AS instrument, round(lim, 2) AS lim, round(drawn0, 2) AS drawn, round(face, 2) AS face, round(notional, 2) AS notional, n AS trades, round(rate, 6) AS rate FROM net")
def a13(spark, sf):
    """Trades netted per facility with the last trade's terms."""
    n = book.net_trades(blotter(spark, sf))
    return n.select("facility_id", "instrument", F.round("limit", 2).alias("lim"), F.round("drawn", 2).alias("drawn"), F.round("face", 2).alias("face"), F.round("notional", 2).alias("notional"), "trades", r6("rate").alias("rate"))


Y = "years"
D1 = "((ln(1.0 / rate) + (0.04 + 0.5 * 0.04) * greatest(years, 1.0 / 365)) / (0.2 * sqrt(greatest(years, 1.0 / 365))))".replace("0.5 * 0.04", "0.5 * 0.2 * 0.2")
POS_SQL = f"""j AS (SELECT net.*, inst = 'BOND' AND party IN ('UST', 'GSEC') AS sov, o.sector AS osec, o.country AS oc, o.notch AS on_, o.orig_notch AS oo, o.bank AS ob, o.grp, greatest(0.05, (maturity - DATE '{corpus.BOOK_DATE}') / 365.25) AS years FROM net LEFT JOIN obligors o ON o.obligor_id = CASE WHEN inst = 'CDS' THEN cust ELSE party END),
j2 AS (SELECT *, CASE WHEN inst IN ('TERM_LOAN', 'REVOLVER') THEN 'Loans' WHEN inst = 'BOND' THEN 'Bonds' WHEN inst = 'EQUITY' THEN 'Equities' ELSE 'Derivatives' END AS ac, CASE WHEN sov THEN CASE WHEN party = 'UST' THEN 1 ELSE 9 END WHEN inst IN ('IRS', 'FX_FWD', 'EQ_OPTION') THEN NULL ELSE on_ END AS notch,
  CASE WHEN sov THEN 'Sovereign' WHEN inst = 'EQ_OPTION' THEN 'Index' ELSE osec END AS sector, CASE WHEN party = 'UST' THEN 'USD' WHEN party = 'GSEC' OR ck % 5 = 0 THEN 'INR' ELSE 'USD' END AS cur, CASE WHEN sov THEN party WHEN inst = 'EQ_OPTION' THEN 'DEALER' ELSE cust END AS oid FROM j),
j3 AS (SELECT *, greatest(0, drawn0) AS drawn, CASE WHEN inst = 'REVOLVER' THEN greatest(lim, greatest(0, drawn0)) - greatest(0, drawn0) ELSE 0 END AS undrawn, CASE WHEN party = 'GSEC' THEN rate WHEN party = 'UST' THEN {sql_curve(Y)} ELSE {sql_curve(Y)} + coalesce({arr([r.spread for r in RT])}[notch + 1], 0.013) END AS ytm,
  greatest(1, round_even(years * 2, 0))::INTEGER AS nper FROM j2 WHERE inst <> 'BOND' OR face > 0),
b1 AS (SELECT *, CASE WHEN inst = 'IRS' THEN rate ELSE ytm END / 2 AS yy, 100 * rate / 2 AS cc FROM j3),
b2 AS (SELECT *, CASE WHEN inst IN ('BOND', 'IRS') THEN list_sum(list_transform(range(1, nper + 1), lambda k: (cc + CASE WHEN k = nper THEN 100 ELSE 0 END) * pow(1 + yy, -k))) END AS price,
  CASE WHEN inst IN ('BOND', 'IRS') THEN list_sum(list_transform(range(1, nper + 1), lambda k: k / 2.0 * (cc + CASE WHEN k = nper THEN 100 ELSE 0 END) * pow(1 + yy, -k))) END AS mac,
  CASE WHEN inst IN ('BOND', 'IRS') THEN list_sum(list_transform(range(1, nper + 1), lambda k: (cc + CASE WHEN k = nper THEN 100 ELSE 0 END) * k * (k + 1) * pow(1 + yy, -k) / (pow(1 + yy, 2) * 4))) END AS cv FROM b1),
b3 AS (SELECT *, mac / price / (1 + yy) AS md, cv / price AS convexity, CASE WHEN inst IN ('TERM_LOAN', 'REVOLVER') THEN drawn + 0.75 * undrawn END AS ead, CASE WHEN inst = 'EQ_OPTION' THEN {D1} END AS d1, CASE WHEN inst = 'EQ_OPTION' THEN notional / 100 * CASE WHEN last_rf = 'R' THEN -1 ELSE 1 END END AS units,
  ck % 2 = 1 AS odd, greatest(years, 1.0 / 365) AS ty FROM b2),
b4 AS MATERIALIZED (SELECT *, CASE WHEN inst = 'EQ_OPTION' THEN {sql_cdf("d1")} END AS nd1, CASE WHEN inst = 'EQ_OPTION' THEN {sql_cdf("(d1 - 0.2 * sqrt(ty))")} END AS nd2, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) AS pdf FROM b3),
pos AS (SELECT *, CASE WHEN inst = 'EQ_OPTION' THEN units * CASE WHEN odd THEN 100 * nd1 - 100 * rate * exp(-0.04 * ty) * nd2 ELSE 100 * rate * exp(-0.04 * ty) * (1 - nd2) - 100 * (1 - nd1) END END AS opt_mtm, CASE WHEN odd THEN nd1 ELSE nd1 - 1 END AS delta, pdf / (100 * 0.2 * sqrt(ty)) AS gamma, 100 * pdf * sqrt(ty) AS vega,
  CASE WHEN inst = 'IRS' THEN notional * md * 1e-4 * CASE WHEN last_rf = 'A' THEN -1 ELSE 1 END END AS dv01, CASE WHEN inst = 'CDS' THEN notional * (1 - exp(-(0.04 + rate / 0.6) * years)) / (0.04 + rate / 0.6) * 1e-4 * CASE WHEN last_rf = 'A' THEN 1 ELSE -1 END END AS cs01 FROM b4),
pds AS (SELECT {arr([r.pd for r in RT])} AS pd, {arr([r.threshold for r in RT])} AS th, {arr([r.sqrt_rho for r in RT])} AS sr, {arr([r.sqrt_one_less_rho for r in RT])} AS sq, {arr([r.risk_weight for r in RT])} AS rw),
p0 AS MATERIALIZED (SELECT pos.*, CASE ac WHEN 'Loans' THEN drawn WHEN 'Bonds' THEN face * price / 100 WHEN 'Equities' THEN notional ELSE coalesce(opt_mtm, 0) END AS v0, CASE WHEN ac = 'Loans' THEN CASE WHEN notch = 17 THEN 3 WHEN notch - oo >= 3 OR notch >= 12 THEN 2 ELSE 1 END END AS st0, pd, th, sr, sq, rw FROM pos, pds),
p1 AS MATERIALIZED (SELECT *, CASE WHEN ac <> 'Loans' THEN 0 WHEN st0 = 3 THEN lgd0 * ead WHEN st0 = 2 THEN (1 - (1 - pd[notch + 1]) * pow(1 - pd[notch + 1], greatest(1, years) - 1)) * lgd0 * ead ELSE pd[notch + 1] * lgd0 * ead END AS ecl0,
  CASE ac WHEN 'Loans' THEN ead * rw[notch + 1] WHEN 'Bonds' THEN v0 * CASE WHEN sov THEN 0 ELSE rw[notch + 1] END WHEN 'Equities' THEN greatest(0, v0) * 2.5 ELSE notional * CASE inst WHEN 'IRS' THEN 0.005 WHEN 'FX_FWD' THEN 0.01 WHEN 'CDS' THEN 0.05 ELSE 0.06 END END AS rwa0 FROM p0)"""
BOOK = f"{O}, {T}, {NET_SQL}, {POS_SQL}"


def positions(spark, sf) -> DataFrame:
    return staged(spark, sf, "positions", lambda: book.build_positions(book.net_trades(blotter(spark, sf)), corpus.obligors(spark, sf), corpus.BOOK_DATE))


@query("m13_positions", f"WITH {BOOK} SELECT facility_id AS pos_id, ac AS asset_class, inst AS instrument, oid AS obligor_id, round(v0, 2) AS v0, round(CASE WHEN inst = 'EQUITY' THEN 0 ELSE years END, 6) AS years, coalesce(notch, -1)::BIGINT AS notch FROM p1")
def m13(spark, sf):
    """Positions per facility with obligor terms."""
    return positions(spark, sf).select("pos_id", "asset_class", "instrument", "obligor_id", F.round("v0", 2).alias("v0"), r6("years").alias("years"), big(F.coalesce("notch", F.lit(-1))).alias("notch"))


@query("f33_bond_measures", f"WITH {BOOK} SELECT facility_id AS pos_id, round(price, 6) AS price, round(md, 6) AS mod_dur, round(convexity, 5) AS convexity, round(ytm, 6) AS ytm FROM p1 WHERE inst = 'BOND'")
def f33(spark, sf):
    """Price, duration, convexity in closed form, against the cash-flow sum in SQL."""
    return positions(spark, sf).filter("instrument = 'BOND'").select("pos_id", r6("price").alias("price"), r6("mod_dur").alias("mod_dur"), F.round("convexity", 5).alias("convexity"), r6("ytm").alias("ytm"))


@query("f34_swap_cds_risk", f"WITH {BOOK} SELECT facility_id AS pos_id, round(coalesce(dv01, cs01), 4) AS risk FROM p1 WHERE inst IN ('IRS', 'CDS')")
def f34(spark, sf):
    return positions(spark, sf).filter("instrument in ('IRS', 'CDS')").select("pos_id", F.round(F.coalesce("dv01", "cs01"), 4).alias("risk"))


@query("f35_option_greeks", f"WITH {BOOK} SELECT facility_id AS pos_id, round(delta, 6) AS delta, round(gamma, 6) AS gamma, round(vega, 5) AS vega, round(opt_mtm, 3) AS mtm FROM p1 WHERE inst = 'EQ_OPTION'")
def f35(spark, sf):
    """Option price and greeks with a native normal distribution."""
    return positions(spark, sf).filter("instrument = 'EQ_OPTION'").select("pos_id", r6("delta").alias("delta"), r6("gamma").alias("gamma"), F.round("vega", 5).alias("vega"), F.round("mtm", 3).alias("mtm"))


@query("f32_baseline_ecl", f"WITH {BOOK} SELECT facility_id AS pos_id, st0::BIGINT AS stage, round(ecl0, 3) AS ecl FROM p1 WHERE ac = 'Loans'")
def f32(spark, sf):
    return positions(spark, sf).filter("asset_class = 'Loans'").select("pos_id", big("stage0").alias("stage"), F.round("ecl0", 3).alias("ecl"))


@query("f38_risk_weighted", f"WITH {BOOK} SELECT facility_id AS pos_id, round(rwa0, 7) AS rwa FROM p1")
def f38(spark, sf):
    return positions(spark, sf).select("pos_id", F.round("rwa0", 7).alias("rwa"))


@query("a14_book_summary", f"WITH {BOOK} SELECT ac AS asset_class, count(*) AS positions, round(sum(v0), 1) AS value FROM p1 GROUP BY 1")
def a14(spark, sf):
    return book.book_summary(positions(spark, sf)).select("asset_class", "positions", F.round("value", 1).alias("value"))


@query("a15_capital", f"WITH {BOOK} SELECT round(sum(rwa0), 1) AS rwa, round(0.13 * sum(rwa0), 1) AS cet1 FROM p1")
def a15(spark, sf):
    return book.capital(positions(spark, sf)).select(F.round("rwa", 1).alias("rwa"), F.round("cet1", 1).alias("cet1"))


@query("f40_equity_factors", f"WITH {BOOK} SELECT facility_id AS pos_id, CASE WHEN oc = 'IN' AND ob THEN 'EQ:IN_BANKS' WHEN oc = 'IN' THEN 'EQ:IN' ELSE CASE sector WHEN 'Financials' THEN 'EQ:FIN' WHEN 'Materials' THEN 'EQ:MAT' WHEN 'Industrials' THEN 'EQ:IND' WHEN 'Consumer Staples' THEN 'EQ:CS' WHEN 'Consumer Discretionary' THEN 'EQ:CD' ELSE 'EQ:IT' END END AS factor FROM p1 WHERE inst = 'EQUITY'")
def f40(spark, sf):
    return positions(spark, sf).filter("instrument = 'EQUITY'").select("pos_id", "factor")


# ------------------------------------------------------------------ stress
REQUESTS = (
    ("r1", "svb_2023", 10, "C000000013", "CREDIT_EVENT", "BANK_RUN"), ("r2", "tariff_2025", 8, None, "GEOPOLITICAL", "TRADE_WAR"),
    ("r3", "adani_2023", 9, "C000000022", "MANAGEMENT_GOVERNANCE", "FRAUD_ALLEGATION"), ("r4", "lehman_2008", 10, "C000000014", "CREDIT_EVENT", "BANKRUPTCY"),
    ("r5", "deepseek_2025", 9, "C000000005", "PRODUCT_STRATEGY", "COMPETITIVE_THREAT"),
)
REQ_SCHEMA = "req_id string, scenario string, impact int, epicenter string, event_class string, subtype string"


def requests(spark) -> DataFrame:
    return spark.createDataFrame(REQUESTS, REQ_SCHEMA)


OV = {c: (n, eq, bp, dm, con) for c, n, eq, bp, dm, con in fin.OVERLAYS}
SEVD = {i: (m, z) for i, m, z in fin.SEVERITY}
SCOPE = {s[0]: s[5] for s in corpus.CORPUS_SCENARIOS}
EPIS = {s[0]: s[4] for s in corpus.CORPUS_SCENARIOS}


def _req_sql(multiples) -> str:
    rows = []
    for rid, sc, imp, epi, cls, sub in REQUESTS:
        n, eq, bp, dm, con = OV.get(cls, OV["default"])
        mult, z = SEVD[min(10, max(8, imp))]
        for m in multiples:
            own = epi in EPIS[sc]
            dflt = sub in fin.DEFAULT_SUBTYPES and imp >= dm and m >= 0.5
            rows.append(f"('{rid}', '{sc}', {m}::DOUBLE, {mult}::DOUBLE, {z}::DOUBLE, {repr(epi) if epi else 'NULL'}, {n}, {0.0 if own else eq}::DOUBLE, {bp}::DOUBLE, {str(dflt).lower()}, '{con}', '{SCOPE[sc]}')")
    return "(VALUES " + ", ".join(rows) + ") AS rq(rid, scenario, m, mult, z0, epi, n0, eq, bp, dflt, con, scope)"


FLOOR_IR = {f: -stress._base(t) * 10_000 for t, f in fin.TENORS}
CAP_SQL = ("CASE WHEN regexp_matches(factor, '^(EQ|EQN|FX|CM):') THEN greatest(-0.95, v) WHEN starts_with(factor, 'IR:') THEN greatest(CASE factor " + " ".join(f"WHEN '{f}' THEN {v!r}::DOUBLE" for f, v in FLOOR_IR.items()) +
           f" ELSE {-stress._base(10.0) * 10_000!r}::DOUBLE END, v) WHEN starts_with(factor, 'CR:') THEN greatest(-50, v) WHEN factor = 'VOL:VIX' THEN greatest(-10, v) ELSE v END")


def fx(f: str) -> str:
    return f"coalesce(sh['{f}'], 0.0)"


def pd_at(n: str, z: str) -> str:
    return sql_cdf(f"((th[{n} + 1] - sr[{n} + 1] * {z}) / sq[{n} + 1])")


RATE = "CASE WHEN years <= 0.25 THEN t1 WHEN years <= 2 THEN t1 + (t2 - t1) * (years - 0.25) / 1.75 WHEN years <= 5 THEN t2 + (t3 - t2) * (years - 2) / 3 WHEN years <= 10 THEN t3 + (t4 - t3) * (years - 5) / 5 WHEN years <= 30 THEN t4 + (t5 - t4) * (years - 10) / 20 ELSE t5 END"


def stress_sql(multiples) -> str:
    return f"""rq0 AS (SELECT * FROM {_req_sql(multiples)}), shs AS (SELECT rid, m, rq0.scenario, factor, value * mult * m AS v, value FROM rq0 JOIN shock ON shock.scenario = rq0.scenario WHERE scope <> 'india' OR factor IN ('EQ:IN', 'EQ:IN_BANKS', 'FX:USDINR', 'IR:IN10Y')),
shm AS MATERIALIZED (SELECT rid, m, map_from_entries(list((factor, {CAP_SQL}))) AS sh, round_even(least(1, greatest(0.1, max(CASE factor WHEN 'EQ:MKT' THEN abs(value) / 0.2 WHEN 'EQ:IN' THEN abs(value) / 0.2 WHEN 'CR:HY' THEN abs(value) / 400 ELSE 0 END))), 3) AS sys FROM shs GROUP BY ALL),
run AS MATERIALIZED (SELECT rq0.*, sh, z0 * sys * m AS z, e.sector AS esec, e.bank AS eb, e.country AS ec, e.grp AS eg, CASE WHEN epi IS NULL OR e.obligor_id IS NULL OR m <= 0 THEN 0 ELSE round_even(n0 * m, 0) END::INT AS en, e.obligor_id AS eo FROM rq0 JOIN shm USING (rid, m) LEFT JOIN obligors e ON e.obligor_id = epi),
x0 AS MATERIALIZED (SELECT p1.*, run.* EXCLUDE (dflt), run.dflt AS rd, inst IN ('TERM_LOAN', 'REVOLVER', 'BOND', 'CDS', 'EQUITY') AND NOT sov AS named, coalesce(sh['IR:3M'], 0) AS t1, coalesce(sh['IR:2Y'], 0) AS t2, coalesce(sh['IR:5Y'], 0) AS t3, coalesce(sh['IR:10Y'], 0) AS t4, coalesce(sh['IR:30Y'], 0) AS t5 FROM p1, run),
x1 AS MATERIALIZED (SELECT *, coalesce(named AND oid = eo, false) AS hit, coalesce(named AND oid <> eo AND CASE WHEN con = 'group' THEN eg <> '' AND grp = eg ELSE osec = esec AND ob = eb AND oc = ec END, false) AS peer, {RATE} AS rt FROM x0),
x2 AS MATERIALIZED (SELECT *, CASE WHEN hit THEN en WHEN peer THEN round_even(en * CASE WHEN con = 'group' THEN 0.67 ELSE 0.34 END, 0)::INT ELSE 0 END AS nn, hit AND rd AS df FROM x1),
x3 AS MATERIALIZED (SELECT *, CASE WHEN notch IS NULL OR (notch > 6 AND notch <= 9) THEN {fx('CR:BBB')} WHEN notch <= 6 THEN {fx('CR:IG')} ELSE {fx('CR:HY')} END + bp * nn AS spr, least(notch + nn, 17) AS n1 FROM x2),
x4 AS MATERIALIZED (SELECT *, (CASE WHEN cur = 'INR' THEN {fx('IR:IN10Y')} ELSE rt END + CASE WHEN sov THEN 0 ELSE spr END) / 10000 AS dy, CASE WHEN ac = 'Loans' THEN CASE WHEN z >= 0 OR pd[n1 + 1] >= 1 THEN 0 ELSE greatest(0, round_even(0.75 * log2({pd_at('n1', 'z')} / greatest(pd[n1 + 1], 0.0003)), 0))::INT END END AS sn FROM x3),
x5 AS MATERIALIZED (SELECT *, v0 * (-md * dy + 0.5 * convexity * dy * dy) AS b0, least(n1 + sn, 17) AS n2, CASE WHEN oc = 'IN' AND ob THEN {fx('EQ:IN_BANKS')} WHEN oc = 'IN' THEN {fx('EQ:IN')} ELSE coalesce(sh[CASE sector WHEN 'Financials' THEN 'EQ:FIN' WHEN 'Materials' THEN 'EQ:MAT' WHEN 'Industrials' THEN 'EQ:IND' WHEN 'Consumer Staples' THEN 'EQ:CS' WHEN 'Consumer Discretionary' THEN 'EQ:CD' ELSE 'EQ:IT' END], {fx('EQ:MKT')}) END AS eq0,
  100 * coalesce(sh[CASE WHEN odd THEN 'EQ:IT' ELSE 'EQ:MKT' END], {fx('EQ:MKT')}) AS ds FROM x4),
x6 AS MATERIALIZED (SELECT *, CASE WHEN z < 0 AND n2 < 17 THEN greatest(pd[n2 + 1], {pd_at('n2', 'z')}) ELSE pd[n2 + 1] END AS pz, CASE WHEN df THEN 3 WHEN n2 = 17 THEN 3 WHEN n2 - oo >= 3 OR n2 >= 12 THEN 2 ELSE 1 END AS s1, greatest(-1, CASE WHEN df THEN -0.95 WHEN oid = epi THEN (1 + eq0) * (1 + CASE WHEN eo IS NULL THEN 0 ELSE eq * m END) - 1 ELSE eq0 END) AS er FROM x5),
x7 AS MATERIALIZED (SELECT *, CASE WHEN ac <> 'Loans' THEN 0 WHEN s1 = 3 THEN lgd0 * ead WHEN s1 = 2 THEN (1 - (1 - least(pz, 1)) * pow(1 - pd[n2 + 1], greatest(1, years) - 1)) * lgd0 * ead ELSE least(pz, 1) * lgd0 * ead END AS ecl1 FROM x6),
x8 AS MATERIALIZED (SELECT *, CASE WHEN ac = 'Loans' THEN ecl0 - ecl1 WHEN ac = 'Bonds' THEN CASE WHEN df THEN face * 0.6 - v0 WHEN cur = 'INR' THEN b0 + (v0 + b0) * (1 / (1 + {fx('FX:USDINR')}) - 1) ELSE b0 END WHEN inst = 'IRS' THEN dv01 * rt WHEN inst = 'FX_FWD' THEN notional * CASE WHEN odd THEN {fx('FX:USDINR')} ELSE {fx('FX:EURUSD')} END * CASE WHEN last_rf = 'N' THEN 1 ELSE -1 END * CASE WHEN odd THEN 1 ELSE -1 END
  WHEN inst = 'CDS' THEN CASE WHEN df THEN notional * 0.6 * CASE WHEN last_rf = 'A' THEN 1 ELSE -1 END ELSE cs01 * spr END WHEN inst = 'EQ_OPTION' THEN units * (delta * ds + 0.5 * gamma * ds * ds + vega * {fx('VOL:VIX')} / 100) WHEN cur = 'INR' THEN notional * ((1 + er) / (1 + {fx('FX:USDINR')}) - 1) ELSE notional * er END AS pnl FROM x7),
st AS MATERIALIZED (SELECT *, CASE ac WHEN 'Loans' THEN ead * CASE WHEN s1 = 3 THEN 1.5 ELSE rw[n2 + 1] END WHEN 'Bonds' THEN (v0 + pnl) * CASE WHEN df THEN 1.5 WHEN sov THEN 0 ELSE rw[n1 + 1] END WHEN 'Equities' THEN greatest(0, v0 + pnl) * 2.5 ELSE notional * CASE inst WHEN 'IRS' THEN 0.005 WHEN 'FX_FWD' THEN 0.01 WHEN 'CDS' THEN 0.05 ELSE 0.06 END END AS rwa1 FROM x8)"""


STRESS = f"{M}, {SHOCK_SQL}, {BOOK}, {stress_sql((0.5, 1.0))}"


def stressed(spark, sf) -> DataFrame:
    """Positions times runs; never written, because every reader folds or filters the rows and a row costs less than its copy on disk."""
    runs = staged(spark, sf, "runs", lambda: stress.build_runs(
        stress.with_multiples(requests(spark), (0.5, 1.0)), corpus.obligors(spark, sf), market.shock_vectors(shocks(spark, sf)), scenarios(spark)))
    return stress.revalue(positions(spark, sf), runs)


@query("m14_stress_capital", f"""WITH {STRESS} SELECT rid AS req_id, m, round(sum(ecl0), 1) AS ecl_before, round(sum(ecl1), 1) AS ecl_after, round(-sum(pnl), 0) AS pre_tax_loss, round(sum(rwa1), 0) AS rwa_after, round((0.13 * sum(rwa0) + 0.75 * sum(pnl)) / sum(rwa1), 6) AS cet1_ratio FROM st GROUP BY ALL""")
def m14(spark, sf):
    """Five requests at half and full severity in one pass: losses, capital, ratio."""
    c = stress.capital_after(stressed(spark, sf))
    return c.select("req_id", "m", F.round("ecl_before", 1).alias("ecl_before"), F.round("ecl_after", 1).alias("ecl_after"), F.round("pre_tax_loss", 0).alias("pre_tax_loss"), F.round("rwa_after", 0).alias("rwa_after"), r6("cet1_ratio").alias("cet1_ratio"))


@query("f37_revaluation", f"WITH {STRESS} SELECT rid AS req_id, m, inst AS instrument, sector, count(*) AS positions, round(sum(pnl), 1) AS pnl FROM st WHERE ac <> 'Loans' GROUP BY ALL")
def f37(spark, sf):
    """Value change by instrument and sector per run."""
    r = stressed(spark, sf).filter("asset_class <> 'Loans'").groupBy("req_id", "m", "instrument", "sector").agg(F.count("*").alias("positions"), F.round(F.sum("pnl"), 1).alias("pnl"))
    return r.select("req_id", "m", "instrument", "sector", "positions", "pnl")


@query("f31_migration", f"WITH {STRESS} SELECT rid AS req_id, m, facility_id AS pos_id, CASE WHEN df THEN 17 ELSE n2 END::BIGINT AS notch, s1::BIGINT AS stage FROM st WHERE ac = 'Loans'")
def f31(spark, sf):
    """Stressed rating and stage per loan, request and multiple."""
    return stressed(spark, sf).filter("asset_class = 'Loans'").select("req_id", "m", "pos_id", big("notch1").alias("notch"), big("stage1").alias("stage"))


@query("a16_class_rollup", f"WITH {STRESS} SELECT rid AS req_id, m, ac AS asset_class, round(sum(v0 - ecl0), 0) AS value_before, round(sum(CASE WHEN ac = 'Loans' THEN v0 - ecl1 ELSE v0 + pnl END), 0) AS value_after, round(sum(pnl), 0) AS pnl FROM st GROUP BY ALL")
def a16(spark, sf):
    b = stress.by_class(stressed(spark, sf))
    return b.select("req_id", "m", "asset_class", F.round("value_before", 0).alias("value_before"), F.round("value_after", 0).alias("value_after"), F.round("pnl", 0).alias("pnl"))


@query("a16_stage_losses", f"WITH {STRESS}, b AS (SELECT rid, m, st0 AS s, ecl0 AS e0, 0 AS e1 FROM st WHERE ac = 'Loans' UNION ALL SELECT rid, m, s1, 0, ecl1 FROM st WHERE ac = 'Loans') SELECT rid AS req_id, m, s::BIGINT AS stage, round(sum(e0), 1) AS ecl_before, round(sum(e1), 1) AS ecl_after FROM b GROUP BY ALL")
def a16s(spark, sf):
    s = stress.stage_losses(stressed(spark, sf))
    return s.select("req_id", "m", big("stage").alias("stage"), F.round("ecl_before", 1).alias("ecl_before"), F.round("ecl_after", 1).alias("ecl_after"))


@query("a17_stage_flows", f"WITH {STRESS} SELECT rid AS req_id, m, st0::BIGINT AS stage0, s1::BIGINT AS stage1, count(*) AS facilities, round(sum(ead), 1) AS ead FROM st WHERE ac = 'Loans' GROUP BY ALL")
def a17(spark, sf):
    f = stress.stage_flows(stressed(spark, sf))
    return f.select("req_id", "m", big("stage0").alias("stage0"), big("stage1").alias("stage1"), "facilities", F.round("ead", 1).alias("ead"))


@query("a18_loss_heatmap", f"WITH {STRESS} SELECT rid AS req_id, m, sector, round(coalesce(-sum(pnl) FILTER (WHERE ac = 'Loans'), 0), 0) AS \"Loans\", round(coalesce(-sum(pnl) FILTER (WHERE ac = 'Bonds'), 0), 0) AS \"Bonds\", round(coalesce(-sum(pnl) FILTER (WHERE ac = 'Derivatives'), 0), 0) AS \"Derivatives\", round(coalesce(-sum(pnl) FILTER (WHERE ac = 'Equities'), 0), 0) AS \"Equities\" FROM st GROUP BY ALL")
def a18(spark, sf):
    h = marts.heat_pivot(stress.loss_heatmap(stressed(spark, sf)))
    return h.select("req_id", "m", "sector", *[F.round(c, 0).alias(c) for c in ("Loans", "Bonds", "Derivatives", "Equities")])


@query("a19_weighted_ecl", f"WITH {STRESS}, t AS (SELECT rid, m, sum(ecl0) AS b, sum(ecl1) AS a FROM st GROUP BY ALL) SELECT x.rid AS req_id, x.m, round(0.5 * x.b + 0.3 * y.a + 0.2 * x.a, 1) AS ecl_weighted FROM t x JOIN t y ON y.rid = x.rid AND y.m = x.m / 2")
def a19(spark, sf):
    return stress.weighted_ecl(cut(stress.capital_after(stressed(spark, sf)))).select("req_id", "m", F.round("ecl_weighted", 1).alias("ecl_weighted"))


@query("k04_top_contributors", f"WITH {STRESS}, r AS (SELECT rid, m, facility_id, pnl, row_number() OVER (PARTITION BY rid, m ORDER BY pnl, facility_id) AS rank FROM st) SELECT rid AS req_id, m, rank, facility_id AS pos_id, round(-pnl, 1) AS loss FROM r WHERE rank <= 10 AND pnl < 0")
def k04(spark, sf):
    t = stress.top_contributors(stressed(spark, sf))
    return t.select("req_id", "m", big("rank").alias("rank"), "pos_id", F.round("loss", 1).alias("loss"))


@query("k10_worst_runs", f"WITH {STRESS}, t AS (SELECT rid, m, (0.13 * sum(rwa0) + 0.75 * sum(pnl)) / sum(rwa1) AS c FROM st GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY c, rid) AS rank FROM t) SELECT m, rid AS req_id, rank FROM r WHERE rank <= 3")
def k10(spark, sf):
    return marts.worst_runs(stress.capital_after(stressed(spark, sf)), "m").select("m", "req_id", big("rank").alias("rank"))


@query("m21_waterfall", f"WITH {STRESS}, c AS (SELECT rid, m, ac, sum(v0 - ecl0) AS b, sum(CASE WHEN ac = 'Loans' THEN v0 - ecl1 ELSE v0 + pnl END) AS a, sum(pnl) AS p FROM st GROUP BY ALL) SELECT rid AS req_id, m, 'Before' AS step, round(sum(b), 0) AS amount FROM c GROUP BY ALL UNION ALL SELECT rid, m, 'After', round(sum(a), 0) FROM c GROUP BY ALL UNION ALL SELECT rid, m, ac, round(p, 0) FROM c")
def m21w(spark, sf):
    return marts.waterfall(cut(stress.by_class(stressed(spark, sf)))).select("req_id", "m", "step", F.round("amount", 0).alias("amount"))


@query("f44_memo_facts", f"""WITH {STRESS}, c AS (SELECT rid, m, ac, sum(pnl) AS p FROM st GROUP BY ALL), w AS (SELECT rid, m, arg_min(ac, (p, ac)) AS worst_class FROM c GROUP BY ALL)
SELECT rid AS req_id, m, worst_class, count(*) FILTER (WHERE st0 = 1 AND s1 = 2) AS to_stage2, count(*) FILTER (WHERE st0 <> 3 AND s1 = 3 AND ac = 'Loans') AS to_stage3, ((0.13 * sum(rwa0) + 0.75 * sum(pnl)) / sum(rwa1) <= 0.08)::BIGINT AS breach FROM st JOIN w USING (rid, m) GROUP BY ALL""")
def f44(spark, sf):
    """The numbers of the risk memo, one row per run."""
    m = stress.memo_facts(stressed(spark, sf))
    return m.select("req_id", "m", "worst_class", big("to_stage2").alias("to_stage2"), big("to_stage3").alias("to_stage3"), big(F.col("breach").cast("int")).alias("breach"))


@query("p15_scope_filter", f"WITH {M}, {SHOCK_SQL} SELECT factor, value FROM shock WHERE scenario = 'adani_2023' AND factor IN ('EQ:IN', 'EQ:IN_BANKS', 'FX:USDINR', 'IR:IN10Y')")
def p15(spark, sf):
    s = stress.scoped_shocks(market.shock_vectors(shocks(spark, sf)), scenarios(spark)).filter("scenario = 'adani_2023'")
    return s.select(F.explode("shock").alias("factor", "value"))


CURVE_M = fin.CURVE_POINTS


@query("m15_severity_curve", f"WITH {M}, {SHOCK_SQL}, {BOOK}, {stress_sql(CURVE_M)} SELECT rid AS req_id, m, round((0.13 * sum(rwa0) + 0.75 * sum(pnl)) / sum(rwa1), 5) AS cet1_ratio FROM st GROUP BY ALL")
def m15c(spark, sf):
    """CET1 ratio over severity multiples, all requests in one job."""
    r = stress.ratios(positions(spark, sf), requests(spark), corpus.obligors(spark, sf), market.shock_vectors(shocks(spark, sf)), scenarios(spark), CURVE_M)
    return r.select("req_id", "m", F.round("cet1_ratio", 5).alias("cet1_ratio"))


@query("m15_reverse_stress")
def m15(spark, sf):
    """Smallest multiple on a 0.01 grid at which CET1 reaches the floors: two jobs for all requests."""
    r = stress.reverse_stress(positions(spark, sf), requests(spark), corpus.obligors(spark, sf), market.shock_vectors(shocks(spark, sf)), scenarios(spark))
    return r.select("req_id", "floor", F.round("reverse_m", 2).alias("reverse_m"))


del math, FACT
