"""Impact, credit and pricing formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.dims import finance as fin


def _lookup(table: dict, key: Column, default: float) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


# ------------------------------------------------------------------ impact
def diffusion_logit(publishers: Column, social: Column, novelty: Column, relevance: Column) -> Column:
    return (
        fin.W_PUBLISHERS * F.log2(1.0 + F.greatest(F.lit(0), publishers))
        + fin.W_SOCIAL * F.log2(1.0 + F.least(F.lit(fin.SOCIAL_CAP), F.greatest(F.lit(0), social)))
        + fin.W_NOVELTY * novelty / 100.0 + fin.W_RELEVANCE * relevance / 100.0
    )


def prior_logit(event: Column, subtype: Column, sentiment: Column, publishers: Column, social: Column,
                authoritative: Column, novelty: Column, relevance: Column) -> Column:
    return (
        fin.IMPACT_INTERCEPT + _lookup(fin.CLASS_PRIOR, event, fin.CLASS_PRIOR["OTHER"])
        + F.coalesce(_lookup(fin.SUBTYPE_PRIOR, subtype, 0.0), F.lit(0.0))
        + fin.W_SENTIMENT * F.least(F.lit(1.0), F.abs(sentiment))
        + fin.W_AUTHORITY * authoritative.cast("double")
        + diffusion_logit(publishers, social, novelty, relevance)
    )


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def to_impact(p: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(10.0 * p - 1e-9).cast("int")))


def interpolate(z: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise-linear map through sorted knots, flat outside."""
    out = F.when(z <= knots[0][0], F.lit(knots[0][1]))
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        out = out.when(z <= x1, y0 + (z - x0) / max(1e-12, x1 - x0) * (y1 - y0))
    return out.otherwise(F.lit(knots[-1][1]))


def calibrated_score(model: dict, event: Column, subtype: Column, sentiment: Column, publishers: Column,
                     social: Column, authoritative: Column, novelty: Column, relevance: Column) -> Column:
    """struct<impact, p, calibrated>; thinly supported classes and special subtypes keep the prior.

    ``model``: class_logit, default_logit, class_support, knots [(x, y)], diffusion_centre.
    """
    prior = sigmoid(prior_logit(event, subtype, sentiment, publishers, social, authoritative, novelty, relevance))
    parts = calibrated_parts(model, event, subtype, sentiment, publishers, social, authoritative, novelty, relevance)
    p = F.when(parts["use"], interpolate(parts["z"], model["knots"])).otherwise(prior)
    return F.struct(to_impact(p).alias("impact"), p.alias("p"), parts["use"].alias("calibrated"))


def calibrated_parts(model: dict, event: Column, subtype: Column, sentiment: Column, publishers: Column, social: Column,
                     authoritative: Column, novelty: Column, relevance: Column) -> Column:
    """struct<z, use>: the fitted logit, and whether the class has support enough to use it."""
    supported = [c for c, n in model["class_support"].items() if n >= fin.MIN_CLASS_SUPPORT]
    z = (
        _lookup(model["class_logit"], event, model["default_logit"])
        + fin.W_SENTIMENT * (F.least(F.lit(1.0), F.abs(sentiment)) - 0.5)
        + diffusion_logit(publishers, social, novelty, relevance) - model.get("diffusion_centre", fin.DIFFUSION_CENTRE)
    )
    use = event.isin(supported) & ~F.coalesce(subtype, F.lit("")).isin(sorted(fin.SUBTYPE_PRIOR))
    return F.struct(z.alias("z"), use.alias("use"))


def naive_impact(sentiment: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(10), F.bround(10.0 * F.abs(sentiment), 0).cast("int")))


def severity_band(impact: Column) -> Column:
    return F.when(impact >= 8, "severe").when(impact == 7, "serious").when(impact >= 4, "watch").otherwise("calm")


def sign_of(x: Column, eps: float = 0.1) -> Column:
    return F.when(F.abs(x) < eps, 0).when(x > 0, 1).otherwise(-1)


# ------------------------------------------------------------------ normal distribution
# fixed values: coefficients of Hart's rational approximation (West 2005), |error| < 1e-15
_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
        221.213596169931, 220.206867912376)
_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
        637.333633378831, 793.826512519948, 440.413735824752)
_SPLIT, _ROOT_TWO_PI = 7.07106781186547, 2.506628274631
# end of fixed values


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution without Python: a rational function and a tail fraction."""
    x = F.abs(z)
    e = F.exp(-x * x / 2.0)
    num, den = F.lit(_NUM[0]), F.lit(_DEN[0])
    for c in _NUM[1:]:
        num = num * x + c
    for c in _DEN[1:]:
        den = den * x + c
    tail = x + 1.0 / (x + 2.0 / (x + 3.0 / (x + 4.0 / (x + 0.65))))
    low = F.when(x > 37.0, 0.0).when(x < _SPLIT, e * num / den).otherwise(e / tail / _ROOT_TWO_PI)
    return F.when(z > 0, 1.0 - low).otherwise(low)


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


# ------------------------------------------------------------------ credit
def stressed_pd(pd: Column, threshold: Column, sqrt_rho: Column, sqrt_rest: Column, z: Column) -> Column:
    return F.when(pd >= 1.0, 1.0).otherwise(normal_cdf((threshold - sqrt_rho * z) / sqrt_rest))


def systematic_notches(pd: Column, pd_z: Column, z: Column) -> Column:
    ratio = pd_z / F.greatest(pd, F.lit(fin.PD_FLOOR))
    moved = F.greatest(F.lit(0), F.bround(fin.MIGRATION_ELASTICITY * F.log2(ratio), 0).cast("int"))
    return F.when((z >= 0) | (pd >= 1.0), 0).otherwise(moved)


def lifetime_pd(pd: Column, years: Column, later: Column) -> Column:
    span = F.greatest(F.lit(1.0), years)
    return 1.0 - (1.0 - F.least(pd, F.lit(1.0))) * F.pow(1.0 - F.least(later, F.lit(1.0)), span - 1.0)


def stage_of(orig_notch: Column, notch: Column) -> Column:
    return (
        F.when(notch == fin.NOTCH["D"], 3)
        .when((notch - orig_notch >= fin.STAGE2_NOTCHES) | (notch >= fin.NOTCH["BB-"]), 2)
        .otherwise(1)
    )


def expected_loss(stage: Column, pd: Column, lgd: Column, ead: Column, years: Column, later: Column) -> Column:
    return (
        F.when(stage == 3, lgd * ead)
        .when(stage == 2, lifetime_pd(pd, years, later) * lgd * ead)
        .otherwise(F.least(pd, F.lit(1.0)) * lgd * ead)
    )


# ------------------------------------------------------------------ curves and prices
def base_rate(years: Column) -> Column:
    return interpolate(years, list(fin.CURVE))


def years_to(maturity: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.05), F.datediff(maturity, as_of) / 365.25)


def bond_measures(coupon: Column, maturity: Column, ytm: Column, freq: int = 2) -> Column:
    """struct<price, mod_dur, convexity> of a plain bond.

    The coupon strip is a geometric sum, so the three measures have closed forms in the discount
    factor: no cash-flow rows, no loop over periods.
    """
    n = F.greatest(F.lit(1.0), F.bround(maturity * freq, 0).cast("double"))
    c = 100.0 * coupon / freq
    y = ytm / freq
    v = 1.0 / (1.0 + y)
    vn = F.pow(v, n)
    safe = F.when(F.abs(y) > 1e-12, y)
    # sums over k=1..n of v^k, k v^k and k(k+1) v^k
    s0 = F.coalesce((1.0 - vn) / safe, n)
    s1 = F.coalesce(((1.0 + y) * s0 - n * vn) / safe, n * (n + 1.0) / 2.0)
    s2 = F.coalesce((2.0 * (1.0 + y) * s1 - n * (n + 1.0) * vn) / safe, n * (n + 1.0) * (n + 2.0) / 3.0)
    price = c * s0 + 100.0 * vn
    mac = (c * s1 + 100.0 * n * vn) / freq / price
    conv = (c * s2 + 100.0 * n * (n + 1.0) * vn) * v * v / (freq * freq) / price
    return F.struct(price.alias("price"), (mac * v).alias("mod_dur"), conv.alias("convexity"))


def swap_dv01(notional: Column, maturity: Column, rate: Column, receive: Column) -> Column:
    dv01 = notional * bond_measures(rate, maturity, rate)["mod_dur"] * 1e-4
    return F.when(receive, -dv01).otherwise(dv01)


def cds_cs01(notional: Column, maturity: Column, spread: Column, bought: Column) -> Column:
    k = F.lit(fin.CDS_RATE) + spread / fin.CDS_LGD
    cs01 = notional * ((1.0 - F.exp(-k * maturity)) / k) * 1e-4
    return F.when(bought, cs01).otherwise(-cs01)


def option_greeks(spot: Column, strike: Column, years: Column, vol: Column, rate: Column, call: Column) -> Column:
    t = F.greatest(years, F.lit(1.0 / 365.0))
    s = F.greatest(vol, F.lit(0.01))
    root = s * F.sqrt(t)
    d1 = (F.ln(spot / strike) + (rate + 0.5 * s * s) * t) / root
    d2 = d1 - root
    disc = strike * F.exp(-rate * t)
    pdf = normal_pdf(d1)
    price = F.when(call, spot * normal_cdf(d1) - disc * normal_cdf(d2)).otherwise(
        disc * normal_cdf(-d2) - spot * normal_cdf(-d1))
    delta = F.when(call, normal_cdf(d1)).otherwise(normal_cdf(d1) - 1.0)
    return F.struct(price.alias("price"), delta.alias("delta"), (pdf / (spot * root)).alias("gamma"),
                    (spot * pdf * F.sqrt(t)).alias("vega"))
