"""Trades -> positions with sensitivities, carrying values, baseline credit loss and capital."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.functions import risk

LOANS = ["TERM_LOAN", "REVOLVER"]
REGIONAL_BANKS = ("SIVB", "FRC", "SBNY", "HNB")   # fixed value


def parse_extra(trades: DataFrame) -> DataFrame:
    """``extra`` "k=v;k=v" -> map."""
    return trades.withColumn("extra_map", F.when(
        F.coalesce("extra", F.lit("")) != "", F.str_to_map("extra", F.lit(";"), F.lit("="))))


def net_trades(trades: DataFrame) -> DataFrame:
    """Net trades per facility: amounts by direction, the last trade's terms, the first loan direction."""
    at = F.struct("trade_date", "trade_id")
    d, n, inst = F.col("direction"), F.col("notional"), F.col("instrument")
    loan, bond = inst.isin(*LOANS), inst == "BOND"
    agg = trades.groupBy("facility_id").agg(
        F.max_by(F.struct("instrument", "counterparty", "rate", "maturity", "collateral", "currency", "extra_map", "direction"), at).alias("t"),
        F.min_by("direction", at).alias("first_direction"), F.count("*").alias("trades"),
        F.sum(F.when(loan & (d == "COMMIT"), n).otherwise(0.0)).alias("limit"),
        F.sum(F.when(loan & (d == "DRAW"), n).when(loan & (d == "REPAY"), -n).otherwise(0.0)).alias("drawn"),
        F.sum(F.when(bond & (d == "BUY"), n).when(bond, -n).otherwise(0.0)).alias("face"),
        F.sum(F.when(~loan & ~bond, n).otherwise(0.0)).alias("notional"))
    inst = F.col("t.instrument")
    return agg.select(
        "facility_id", "t.instrument", "t.counterparty", "t.rate", "t.maturity", "t.collateral", "t.currency", "t.extra_map",
        F.when(inst.isin(*LOANS), F.col("first_direction")).when(inst == "BOND", "LONG").otherwise(F.col("t.direction")).alias("direction"),
        "trades", "limit", "drawn", "face", "notional")


def _by_notch(values: list[float], notch: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), notch)


def equity_factor(country: Column, bank: Column, obligor: Column, sector: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fin.SECTOR_FACTOR.items() for x in kv])
    return (
        F.when((country == "IN") & bank, "EQ:IN_BANKS").when(country == "IN", "EQ:IN")
        .when(bank & obligor.isin(*REGIONAL_BANKS), "EQ:BANKS").otherwise(F.coalesce(F.try_element_at(table, sector), F.lit("EQ:MKT"))))


def build_positions(net: DataFrame, obligors: DataFrame, as_of: str) -> DataFrame:
    """Netted facilities -> positions. Sovereign bonds need no obligor; a CDS follows its reference name."""
    rows = fin.rating_rows()
    key = F.when(F.col("instrument") == "CDS", F.try_element_at("extra_map", F.lit("reference"))).otherwise(F.col("counterparty"))
    sov = (F.col("instrument") == "BOND") & F.col("counterparty").isin("UST", "GSEC")
    j = net.withColumn("ob_key", key).withColumn("sovereign", sov).join(
        obligors.select(F.col("obligor_id").alias("ob_key"), "name", "sector", "country", "notch", "orig_notch", "bank", "group"), "ob_key", "left")
    j = j.withColumn("years", risk.years_to(F.col("maturity"), F.to_date(F.lit(as_of))))
    inst = F.col("instrument")
    asset = F.when(inst.isin(*LOANS), "Loans").when(inst == "BOND", "Bonds").when(inst == "EQUITY", "Equities").otherwise("Derivatives")
    ust = F.col("counterparty") == "UST"
    j = j.withColumn("asset_class", asset).withColumn(
        "country", F.when(sov, F.when(ust, "US").otherwise("IN")).when(inst.isin("IRS", "FX_FWD", "EQ_OPTION"), "US").otherwise(F.col("country"))).withColumn(
        "sector", F.when(sov, "Sovereign").when(inst == "EQ_OPTION", "Index").otherwise(F.col("sector"))).withColumn(
        "notch", F.when(sov, F.when(ust, fin.NOTCH["AA+"]).otherwise(fin.NOTCH["BBB-"])).when(
            inst.isin("IRS", "FX_FWD", "EQ_OPTION"), None).otherwise(F.col("notch"))).withColumn(
        "orig_notch", F.when(sov, F.col("notch")).otherwise(F.col("orig_notch"))).withColumn(
        "bank", F.when(sov | inst.isin("IRS", "FX_FWD", "EQ_OPTION"), False).otherwise(F.col("bank"))).withColumn(
        "obligor_id", F.when(sov, F.col("counterparty")).when(inst == "EQ_OPTION", "DEALER").otherwise(F.col("ob_key"))).withColumn(
        "years", F.when(inst == "EQUITY", 0.0).otherwise(F.col("years")))
    drawn = F.greatest(F.lit(0.0), F.col("drawn"))
    limit = F.greatest(F.col("limit"), drawn)
    undrawn = F.when(inst == "REVOLVER", limit - drawn).otherwise(0.0)
    lgd_map = F.create_map(*[F.lit(x) for kv in fin.COLLATERAL_LGD.items() for x in kv])
    lgd = F.when(inst.isin(*LOANS), F.coalesce(F.try_element_at(lgd_map, F.col("collateral")), F.lit(fin.DEFAULT_LGD))).when(
        inst == "BOND", fin.BOND_LGD).when(inst == "CDS", fin.CDS_LGD)
    ytm = F.when(sov & ~ust, F.col("rate")).when(sov, risk.base_rate(F.col("years"))).otherwise(
        risk.base_rate(F.col("years")) + F.coalesce(_by_notch([r.spread for r in rows], F.col("notch")), F.lit(fin.RATING_SPREAD["BBB"])))
    j = j.withColumn("ytm", F.when(inst == "BOND", ytm))
    extra = lambda k: F.try_element_at("extra_map", F.lit(k))
    receive = F.col("direction") == "RECEIVE_FIXED"
    bought = F.col("direction") == "BUY_PROTECTION"
    pair = F.coalesce(extra("pair"), F.lit("USDINR"))
    j = j.withColumn("bond", F.when(inst == "BOND", risk.bond_measures(F.col("rate"), F.col("years"), F.col("ytm")))).withColumn(
        "opt", F.when(inst == "EQ_OPTION", risk.option_greeks(
            F.lit(100.0), 100.0 * F.col("rate"), F.col("years"), F.lit(fin.OPTION_VOL), F.lit(fin.OPTION_RATE), extra("type") == "CALL"))).withColumn(
        "units", F.when(inst == "EQ_OPTION", F.col("notional") / 100.0 * F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)))
    out = j.filter((inst != "BOND") | (F.col("face") > 0)).select(
        F.col("facility_id").alias("pos_id"), "asset_class", "instrument", "obligor_id", "sector", "country", "notch", "orig_notch",
        "currency", "years", "bank", "group", "sovereign", F.when(inst.isin(*LOANS), drawn).alias("drawn"),
        F.when(inst.isin(*LOANS), undrawn).alias("undrawn"), F.when(inst.isin(*LOANS), drawn + fin.UNDRAWN_FACTOR * undrawn).alias("ead"),
        lgd.alias("lgd"), F.when(inst == "BOND", F.col("face")).alias("face"), "ytm", F.col("bond.price").alias("price"),
        F.col("bond.mod_dur").alias("mod_dur"), F.col("bond.convexity").alias("convexity"), "notional",
        F.when(inst == "IRS", risk.swap_dv01(F.col("notional"), F.col("years"), F.col("rate"), receive)).alias("dv01"),
        F.when(inst == "FX_FWD", pair).alias("pair"),
        F.when(inst == "FX_FWD", F.when(F.col("direction") == "BUY_USD", 1.0).otherwise(-1.0) * F.when(pair == "USDINR", 1.0).otherwise(-1.0)).alias("sign"),
        F.when(inst == "CDS", risk.cds_cs01(F.col("notional"), F.col("years"), F.col("rate"), bought)).alias("cs01"),
        F.when(inst == "CDS", bought).alias("bought"), F.col("opt.delta").alias("delta"), F.col("opt.gamma").alias("gamma"),
        F.col("opt.vega").alias("vega"), "units", F.when(inst == "EQ_OPTION", F.col("units") * F.col("opt.price")).otherwise(
            F.when(asset == "Derivatives", 0.0)).alias("mtm"),
        F.when(inst == "EQ_OPTION", extra("underlying")).alias("underlying"), F.when(inst == "EQUITY", F.col("notional")).alias("value"),
        F.when(inst == "EQUITY", 1.0).alias("beta"), F.when(inst == "EQUITY", equity_factor(
            F.col("country"), F.col("bank"), F.col("obligor_id"), F.col("sector"))).alias("factor"))
    return with_baseline(out)


def carrying_value() -> Column:
    return (
        F.when(F.col("asset_class") == "Loans", F.col("drawn")).when(F.col("asset_class") == "Bonds", F.col("face") * F.col("price") / 100.0)
        .when(F.col("asset_class") == "Equities", F.col("value")).otherwise(F.coalesce("mtm", F.lit(0.0))))


def capital_weighted(notch: Column, defaulted: Column, value: Column, asset: Column | None = None) -> Column:
    """Risk-weighted assets: loans on EAD, bonds on value, equities 2.5x, derivatives by add-on."""
    asset = F.col("asset_class") if asset is None else asset
    weights = [r.risk_weight for r in fin.rating_rows()]
    rw = F.coalesce(_by_notch(weights, notch), F.lit(fin.UNRATED_RISK_WEIGHT))
    addon = F.create_map(*[F.lit(x) for kv in fin.DERIVATIVE_ADDON.items() for x in kv])
    bad = F.lit(fin.DEFAULTED_RISK_WEIGHT)
    return (
        F.when(asset == "Loans", F.col("ead") * F.when(defaulted, bad).otherwise(rw))
        .when(asset == "Bonds", value * F.when(defaulted, bad).when(F.col("sovereign"), 0.0).otherwise(rw))
        .when(asset == "Equities", F.greatest(F.lit(0.0), value) * fin.EQUITY_RISK_WEIGHT)
        .otherwise(F.col("notional") * F.coalesce(F.try_element_at(addon, F.col("instrument")), F.lit(fin.OTHER_ADDON))))


def with_baseline(positions: DataFrame) -> DataFrame:
    """Add carrying value, stage, expected loss and risk-weighted assets before any stress."""
    pds = [r.pd for r in fin.rating_rows()]
    loan = F.col("asset_class") == "Loans"
    pd = _by_notch(pds, F.col("notch"))
    stage = F.when(loan, risk.stage_of(F.coalesce("orig_notch", "notch"), F.col("notch")))
    p = positions.withColumn("v0", carrying_value()).withColumn("stage0", stage)
    p = p.withColumn("ecl0", F.when(loan, risk.expected_loss(F.col("stage0"), pd, F.col("lgd"), F.col("ead"), F.col("years"), pd)).otherwise(0.0))
    return p.withColumn("rwa0", capital_weighted(F.col("notch"), F.lit(False), F.col("v0")))


def book_summary(positions: DataFrame) -> DataFrame:
    return positions.groupBy("asset_class").agg(F.count("*").alias("positions"), F.sum("v0").alias("value"))


def capital(positions: DataFrame) -> DataFrame:
    """Total risk-weighted assets and the starting CET1 (13% of them)."""
    return positions.agg(F.sum("rwa0").alias("rwa")).withColumn("cet1", fin.START_CET1 * F.col("rwa"))
