"""Event study of filings: sessions, market model, abnormal returns, calibration, reports."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.dims.text_rules import FILING_ITEMS, PRIORITY
from riskloom.functions.scan import Carry, prefix_scan
from riskloom.operators.market import calendar
from riskloom.session import cut

# fixed values: windows of the study
ESTIMATION, GAP_ROWS, MIN_PAIRS, FIRST_POS = (-250, -31), 20, 120, 260
SPLITS = (("train", "2015-01-01", "2020-12-31"), ("valid", "2021-01-01", "2021-12-31"),
          ("test", "2022-01-01", "2023-12-31"), ("post", "2024-01-01", "2026-12-31"))
# end of fixed values


def timing_bucket(ts: Column) -> Column:
    hm = F.date_format(ts, "HH:mm:ss")
    return F.when(hm < "09:30:00", "pre").when(hm < "16:00:00", "intraday").otherwise("after")


def classify_items(items: Column, dims=FILING_ITEMS) -> Column:
    """struct<cls, sub, rank, n_items> of a comma list: the most severe mapped item wins, first on a tie."""
    codes = F.filter(F.transform(F.split(F.coalesce(items, F.lit("")), ","), lambda c: F.trim(c)), lambda c: c != "")
    table = F.create_map(*[x for code, cls, sub, rank in dims for x in (
        F.lit(code), F.struct(F.lit(-rank).alias("neg"), F.lit(cls).alias("cls"), F.lit(sub).alias("sub")))])
    hit = F.transform(codes, lambda c, i: F.struct(F.try_element_at(table, c)["neg"].alias("neg"), i.alias("i"),
                                                   F.try_element_at(table, c)["cls"].alias("cls"), F.try_element_at(table, c)["sub"].alias("sub")))
    best = F.get(F.array_sort(F.filter(hit, lambda h: h["neg"].isNotNull())), F.lit(0))
    return F.struct(F.coalesce(best["cls"], F.lit("OTHER")).alias("cls"), best["sub"].alias("sub"),
                    F.coalesce(-best["neg"], F.lit(0)).alias("rank"), F.size(codes).alias("n_items"))


def event_sessions(filings: DataFrame, days: DataFrame) -> DataFrame:
    """Forward as-of: filing -> first session at or after its date, the next one if accepted after the close.

    The calendar becomes half-open intervals (previous session, session], so the join is one
    bounded lookup per filing date, not a range join per filing.
    """
    last = days.agg(F.max("pos").alias("last_pos"))
    w = Window.orderBy("date")
    spans = days.withColumn("after", F.lag("date").over(w)).withColumn("from", F.coalesce(F.date_add("after", 1), F.date_sub("date", 3660)))
    lookup = spans.select("pos", F.col("date").alias("session"), F.explode(F.sequence("from", "date")).alias("filed"))
    f = filings.withColumn("filed", F.to_date("accepted")).join(lookup, "filed")
    pos = F.col("pos") + F.when((F.col("session") == F.col("filed")) & (timing_bucket(F.col("accepted")) == "after"), 1).otherwise(0)
    f = f.withColumn("pos", pos).withColumn("c", classify_items(F.col("items"))).withColumn("timing", timing_bucket(F.col("accepted")))
    return f.join(F.broadcast(last)).filter((F.col("pos") + 1 <= F.col("last_pos")) & (F.col("pos") >= FIRST_POS)).select(
        "ticker", "pos", "accession", "c.cls", "c.sub", "c.rank", "c.n_items", "timing")


def merge_filings(events: DataFrame) -> DataFrame:
    """One row per ticker and session: the most severe filing's class, all items counted."""
    first = F.struct((-F.col("rank")).alias("r"), "accession")
    return events.groupBy("ticker", "pos").agg(
        F.min_by(F.struct("cls", "sub", "timing"), first).alias("f"), F.max("rank").alias("rank"),
        F.sum("n_items").cast("int").alias("n_items"), F.count("*").cast("int").alias("filings")).select(
            "ticker", "pos", "f.cls", "f.sub", "f.timing", "rank", "n_items", "filings")


def market_model(prices: DataFrame, market: str, vix: str | None = None, value: str = "value") -> DataFrame:
    """Per series and calendar row: rolling market model, abnormal returns, trailing volatility.

    The estimation window depends on the row only, so it is a window frame over one row per series
    and day, shared by every event on it.
    """
    days = calendar(prices)
    px = prices.join(days, "date")
    w = Window.partitionBy("series").orderBy("pos")
    gap_free = F.when(F.lag("pos").over(w) == F.col("pos") - 1, F.ln(value) - F.lag(F.ln(value)).over(w))
    r = px.withColumn("r", gap_free)
    m = r.filter(F.col("series") == market).select("pos", F.col("r").alias("x"))
    both = r.filter(F.col("series") != market).select("series", "date", "pos", "r").join(m, "pos", "left")
    y, x = F.col("r"), F.col("x")
    pair = y.isNotNull() & x.isNotNull()
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x, "syy": y * y}
    # running sums once per row; a window is the difference of two of them, whatever its length
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    cum = both.withColumn("cum", F.struct(*[F.sum(F.when(pair, v).otherwise(0.0)).over(upto).alias(k) for k, v in terms.items()]))
    at = cum.withColumn("hi", F.last("cum").over(w.rangeBetween(Window.unboundedPreceding, ESTIMATION[1]))).withColumn(
        "lo", F.last("cum").over(w.rangeBetween(Window.unboundedPreceding, ESTIMATION[0] - 1)))
    d = {k: F.col(f"hi.{k}") - F.coalesce(F.col(f"lo.{k}"), F.lit(0.0)) for k in terms}
    n = F.when(d["n"] > 0, d["n"])
    cxx, cyy, cxy = d["sxx"] - d["sx"] * d["sx"] / n, d["syy"] - d["sy"] * d["sy"] / n, d["sxy"] - d["sx"] * d["sy"] / n
    beta = cxy / F.when(cxx > 0, cxx)
    out = at.select(
        "series", "date", "pos", "r", "x", F.coalesce(d["n"], F.lit(0.0)).cast("bigint").alias("n"), beta.alias("beta"),
        ((d["sy"] - beta * d["sx"]) / n).alias("alpha"), cyy.alias("syy"), cxx.alias("sxx"),
        F.stddev_pop("r").over(w.rangeBetween(-GAP_ROWS, -1)).alias("vol20"),
        F.first("r").over(w.rangeBetween(1, 1)).alias("r1"), F.first("x").over(w.rangeBetween(1, 1)).alias("x1"))
    resid = F.sqrt(F.greatest((F.col("syy") - F.col("beta") * F.col("beta") * F.col("sxx")), F.lit(0.0)) / F.when(F.col("n") > 2, F.col("n") - 2))
    out = out.withColumn("s_e", resid)
    if vix:
        v = px.filter(F.col("series") == vix).select((F.col("pos") + 1).alias("pos"), F.col(value).alias("vix"))
        return out.join(v, "pos", "left")
    return out.withColumn("vix", F.lit(None).cast("double"))


def study_events(filings: DataFrame, prices: DataFrame, market: str, vix: str | None = None) -> DataFrame:
    """Filings -> labelled events: SCAR, |SCAR| > 2, volatility ratio, VIX the day before."""
    merged = merge_filings(event_sessions(filings, calendar(prices)))
    model = market_model(prices, market, vix)
    e = merged.join(model.withColumnRenamed("series", "ticker"), ["ticker", "pos"])
    ar0 = F.col("r") - (F.col("alpha") + F.col("beta") * F.col("x"))
    ar1 = F.col("r1") - (F.col("alpha") + F.col("beta") * F.col("x1"))
    e = e.filter((F.col("n") >= MIN_PAIRS) & ar0.isNotNull() & ar1.isNotNull() & (F.col("s_e") > 0))
    scar = (ar0 + ar1) / (F.col("s_e") * F.sqrt(F.lit(2.0)))
    return e.select("ticker", "pos", F.col("date").alias("t0"), "cls", "sub", "rank", "n_items", "timing", "filings", scar.alias("scar"),
                    F.abs(scar).alias("abs_scar"), (F.abs(scar) > 2).cast("int").alias("y"), (F.col("vol20") / F.col("s_e")).alias("vol_ratio"),
                    "vix", ((ar0 + ar1) * 1e4).alias("ar_bps"))


def features(events: DataFrame, split: str | None = None) -> DataFrame:
    """Class and timing indicators, item counts, volatility ratio, VIX (median of the set where missing)."""
    w = Window.partitionBy(F.col(split) if split else F.lit(1))
    key = [split] if split else []
    med = events.groupBy(*key).agg(F.median("vix").alias("_med")) if key else events.agg(F.median("vix").alias("_med"))
    e = events.join(F.broadcast(med), key) if key else events.join(F.broadcast(med))
    cols = {f"cls_{c}": (F.col("cls") == c).cast("double") for c in PRIORITY}
    cols["f_items"] = F.ln(1.0 + F.col("n_items"))
    cols["f_multi"] = (F.col("filings") > 1).cast("double")
    cols.update({f"timing_{t}": (F.col("timing") == t).cast("double") for t in ("pre", "intraday", "after")})
    clip = lambda c, a, b: F.greatest(F.lit(a), F.least(F.lit(b), c))
    cols["f_vol"] = F.ln(clip(F.coalesce("vol_ratio", F.lit(1.0)), 0.2, 5.0))
    cols["f_vix"] = clip(F.coalesce("vix", "_med", F.lit(20.0)), 9.0, 80.0) / 20.0
    return e.select("*", *[v.alias(k) for k, v in cols.items()]).drop("_med")


FEATURES = [f"cls_{c}" for c in PRIORITY] + ["f_items", "f_multi", "timing_pre", "timing_intraday", "timing_after", "f_vol", "f_vix"]


def with_split(events: DataFrame, splits=SPLITS) -> DataFrame:
    s = F.lit(None).cast("string")
    for name, lo, hi in splits:
        s = F.when(F.col("t0").between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi))), name).otherwise(s)
    return events.withColumn("split", s)


def calibrate(events: DataFrame, splits=SPLITS, c: float = 0.5, knots: int = 60) -> tuple[dict, DataFrame]:
    """Logistic model on the training years, isotonic map on the next year.

    Returns the impact model (class logits, support, knots) and all split rows with ``p``.
    """
    e = cut(features(with_split(events, splits).filter(F.col("split").isNotNull()), "split"))
    n = e.filter("split = 'train'").count()
    if n < 200:
        raise ValueError(f"Too few training events ({n})")
    vec = VectorAssembler(inputCols=FEATURES, outputCol="x")
    train = vec.transform(e.filter("split = 'train'"))
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8).fit(train)
    scored = lr.transform(vec.transform(e)).withColumn("zlogit", F.get(vector_to_array("rawPrediction"), F.lit(1)))
    iso = IsotonicRegression(featuresCol="zlogit", labelCol="y", predictionCol="p_raw").fit(
        scored.filter("split = 'valid'").select("zlogit", F.col("y").cast("double").alias("y")))
    out = iso.transform(scored.drop("prediction", "probability", "rawPrediction")).withColumn(
        "p", F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.col("p_raw")))).drop("p_raw", "x")
    # class logits at average features, the class switched on
    means = train.agg(*[F.avg(f).alias(f) for f in FEATURES]).first()
    coef = dict(zip(FEATURES, [float(v) for v in lr.coefficients]))
    rest = float(lr.intercept) + sum(coef[f] * means[f] for f in FEATURES if not f.startswith("cls_"))
    logits = {cl: rest + coef[f"cls_{cl}"] for cl in PRIORITY}
    support = {r["cls"]: r["n"] for r in train.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    zs = scored.filter("split = 'valid'").agg(F.min("zlogit"), F.max("zlogit")).first()
    lo, hi = min(zs[0] if zs[0] is not None else -6.0, -6.0), max(zs[1] if zs[1] is not None else 2.0, 2.0)
    grid = events.sparkSession.range(knots).select((F.lit(lo) + F.col("id") * ((hi - lo) / (knots - 1))).alias("zlogit"))
    ks = sorted((r["zlogit"], min(0.999, max(0.001, r["p_raw"]))) for r in iso.transform(grid).collect())
    model = {"class_logit": logits, "default_logit": logits["OTHER"], "class_support": support, "knots": ks,
             "diffusion_centre": fin.DIFFUSION_CENTRE, "coefficients": coef, "intercept": float(lr.intercept)}
    return model, out


def class_rates(events: DataFrame) -> DataFrame:
    return events.groupBy("cls").agg(F.count("*").alias("n"), F.avg("y").alias("two_sigma_rate"), F.avg("abs_scar").alias("mean_abs_scar"))


def reliability(scored: DataFrame, by: list[str], p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(y).alias("observed"))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str, width: float = 1e-3) -> DataFrame:
    """Rank with ties averaged, per group, without one window over the group.

    Equal values are counted once; the running count over the distinct values is a bucketed scan.
    """
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_c"))
    run = prefix_scan(counts, by, [value], F.floor(F.col(value) / width), [Carry("_upto", "sum", F.col("_c"))])
    return rows.join(run.select(*by, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(name)), [*by, value])


def auc(scored: DataFrame, by: list[str], score: str = "p", y: str = "y") -> DataFrame:
    """ROC AUC by the rank-sum identity."""
    r = average_ranks(scored, by, score, "_rank")
    pos, n = F.sum(y), F.count("*")
    sums = r.groupBy(*by).agg(F.sum(F.when(F.col(y) == 1, F.col("_rank"))).alias("s"), pos.alias("pos"), n.alias("n"))
    neg = F.col("n") - F.col("pos")
    return sums.select(*by, "n", "pos", F.when((F.col("pos") > 0) & (neg > 0), (F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * neg)).alias("auc"))


def brier(scored: DataFrame, by: list[str], base: float, p: str = "p", y: str = "y") -> DataFrame:
    return scored.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"), F.avg((F.lit(base) - F.col(y)) ** 2).alias("brier_base"))


def spearman(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    r = average_ranks(average_ranks(rows, by, a, "_ra"), by, b, "_rb")
    return r.groupBy(*by).agg(F.corr("_ra", "_rb").alias("spearman"))


def decile_gap(scored: DataFrame, by: list[str], row_id: list[str], p: str = "p", what: str = "abs_scar") -> DataFrame:
    """Mean of ``what`` in the top and bottom tenth of ``p``; ranks come from a bucketed scan."""
    total = scored.groupBy(*by).agg(F.count("*").alias("_n"))
    ranked = prefix_scan(scored, by, [p, *row_id], F.floor(F.col(p) * 1000), [Carry("_i", "sum", F.lit(1).cast("bigint"))])
    d = ranked.join(total, by).withColumn("decile", F.floor((F.col("_i") - 1) * 10 / F.col("_n")).cast("int"))
    return d.groupBy(*by).agg(F.avg(F.when(F.col("decile") == 9, F.col(what))).alias("top"), F.avg(F.when(F.col("decile") == 0, F.col(what))).alias("bottom"))
