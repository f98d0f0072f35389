"""Signals, gate, index, scorecards and marts over ``events`` read as a signal stream."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import corpus
from riskloom.dims import finance as fin
from riskloom.functions import risk
from riskloom.operators import evaluate, gate, index, marts, neardup
from riskloom.plans.registry import big, query, r6, secs, staged
from riskloom.sources import documents as src, tables as ref

S = corpus.SIGNALS_SQL


def sig(spark, sf) -> DataFrame:
    return corpus.signals(spark, sf)


def events(spark, sf) -> DataFrame:
    return sig(spark, sf).filter("grain = 'event'")


@query("p10_newest_signals", f"WITH {S} SELECT seq, entity_id, impact::BIGINT AS impact FROM signals WHERE grain = 'event' AND impact >= 8 ORDER BY t DESC, seq DESC LIMIT 200")
def p10(spark, sf):
    """Filtered newest-first listing (the limit is the feature)."""
    return evaluate.newest(sig(spark, sf), grain="event", min_impact=8).select("seq", "entity_id", big("impact").alias("impact"))


@query("p11_after_sequence", f"WITH {S} SELECT seq, signal_id FROM signals WHERE seq > 1000 ORDER BY seq LIMIT 500")
def p11(spark, sf):
    return evaluate.after_sequence(sig(spark, sf), 1000).select("seq", "signal_id")


@query("p12_point_lookup", f"WITH {S} SELECT seq, signal_id, entity_id FROM signals WHERE signal_id = 'sig_77'")
def p12(spark, sf):
    return sig(spark, sf).filter("signal_id = 'sig_77'").select("seq", "signal_id", "entity_id")


@query("p13_eligible_stories", f"WITH {S} SELECT seq, CAST(relevance >= 100 AND novelty >= 100 AND abs(sentiment) >= 0.6 AS BIGINT) AS strict FROM signals WHERE grain = 'event' AND NOT retracted AND relevance >= 60 AND novelty >= 50 AND abs(sentiment) >= 0.3")
def p13(spark, sf):
    e = events(spark, sf).filter("status <> 'retracted' AND relevance >= 60 AND novelty >= 50 AND abs(sentiment) >= 0.3")
    return e.select("seq", big(((F.col("relevance") >= 100) & (F.col("novelty") >= 100) & (F.abs("sentiment") >= 0.6)).cast("int")).alias("strict"))


@query("p14_severity_bands", f"WITH {S} SELECT CASE WHEN impact >= 8 THEN 'severe' WHEN impact = 7 THEN 'serious' WHEN impact >= 4 THEN 'watch' ELSE 'calm' END AS band, count(*) AS n FROM signals GROUP BY 1")
def p14(spark, sf):
    return sig(spark, sf).groupBy(risk.severity_band(F.col("impact")).alias("band")).agg(F.count("*").alias("n"))


@query("p16_contract_violations", f"""WITH {S}, b AS (SELECT seq, CASE WHEN seq % 10 = 3 THEN sentiment * 3 ELSE sentiment END AS s, CASE WHEN seq % 14 = 5 THEN impact + 9 ELSE impact END AS i FROM signals)
SELECT seq, array_to_string(list_filter([CASE WHEN s < -1 OR s > 1 THEN 'sentiment' END, CASE WHEN i > 10 OR i < 1 THEN 'impact' END], lambda x: x IS NOT NULL), ',') AS reason FROM b WHERE s < -1 OR s > 1 OR i > 10 OR i < 1""")
def p16(spark, sf):
    """Rows outside the signal contract with the fields at fault."""
    s = sig(spark, sf)
    bad = s.withColumn("sentiment", F.when(F.col("seq") % 10 == 3, F.col("sentiment") * 3).otherwise(F.col("sentiment"))).withColumn(
        "impact", F.when(F.col("seq") % 14 == 5, F.col("impact") + 9).otherwise(F.col("impact")))
    return src.validate(bad).filter("reason is not null").select("seq", "reason")


@query("f02_utc_times", f"WITH {S} SELECT seq, t AS at, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H') AS hour FROM signals")
def f02(spark, sf):
    return sig(spark, sf).select("seq", secs("as_of").alias("at"), F.date_format("as_of", "yyyy-MM-dd HH").alias("hour"))


@query("s13_upserts", f"""WITH {S} SELECT cluster_id, min(seq) AS first_seq, arg_max(impact, seq)::BIGINT AS impact, round(arg_max(sentiment, seq), 6) AS sentiment FROM signals GROUP BY cluster_id""")
def s13(spark, sf):
    """Keyed upsert: newest values win, the first sequence number stays."""
    s = sig(spark, sf).select("cluster_id", F.col("seq").alias("first_seq"), "seq", "impact", "sentiment")
    a, b = s.filter("seq % 2 = 0"), s.filter("seq % 2 = 1")
    out = ref.upsert(a, b, ["cluster_id"], "seq", keep_first=["first_seq"])
    return out.select("cluster_id", "first_seq", big("impact").alias("impact"), r6("sentiment").alias("sentiment"))


IMPACT_SQL = f"""imp AS (SELECT *, {fin.IMPACT_INTERCEPT} + CASE cls {" ".join(f"WHEN '{k}' THEN {v}" for k, v in fin.CLASS_PRIOR.items())} END + {fin.W_SENTIMENT} * least(1.0, abs(sentiment)) + {fin.W_AUTHORITY} * authoritative::INT
  + {fin.W_PUBLISHERS} * log2(1.0 + publishers) + {fin.W_SOCIAL} * log2(1.0 + least(32, social_authors)) + {fin.W_NOVELTY} * novelty / 100.0 + {fin.W_RELEVANCE} * relevance / 100.0 AS z FROM signals)"""


@query("f23_prior_impact", f"WITH {S}, {IMPACT_SQL} SELECT seq, greatest(1, least(10, ceil(10.0 / (1.0 + exp(-z)) - 1e-9)))::BIGINT AS impact, round(1.0 / (1.0 + exp(-z)), 6) AS p FROM imp")
def f23(spark, sf):
    s = sig(spark, sf)
    z = risk.prior_logit(F.col("event"), F.col("subtype"), F.col("sentiment"), F.col("publishers"), F.col("social_authors"), F.col("authoritative"), F.col("novelty"), F.col("relevance"))
    p = risk.sigmoid(z)
    return s.select("seq", big(risk.to_impact(p)).alias("impact"), r6(p).alias("p"))


MODEL = {"class_logit": {"CREDIT_EVENT": -0.4, "GEOPOLITICAL": -1.1, "OTHER": -1.6}, "default_logit": -1.6, "class_support": {"CREDIT_EVENT": 120, "GEOPOLITICAL": 45, "OTHER": 12},
         "knots": [(-6.0, 0.01), (-2.0, 0.12), (-1.0, 0.3), (0.0, 0.45), (1.0, 0.7), (2.0, 0.9)], "diffusion_centre": 1.6}
ISO = "CASE WHEN zc <= -6.0 THEN 0.01 " + " ".join(
    f"WHEN zc <= {x1} THEN {y0} + (zc - ({x0})) / {x1 - x0} * {y1 - y0}" for (x0, y0), (x1, y1) in zip(MODEL["knots"], MODEL["knots"][1:])) + " ELSE 0.9 END"


@query("f24_calibrated_impact", f"""WITH {S}, {IMPACT_SQL}, c AS (SELECT *, CASE cls WHEN 'CREDIT_EVENT' THEN -0.4 WHEN 'GEOPOLITICAL' THEN -1.1 ELSE -1.6 END + {fin.W_SENTIMENT} * (least(1.0, abs(sentiment)) - 0.5)
  + {fin.W_PUBLISHERS} * log2(1.0 + publishers) + {fin.W_SOCIAL} * log2(1.0 + least(32, social_authors)) + {fin.W_NOVELTY} * novelty / 100.0 + {fin.W_RELEVANCE} * relevance / 100.0 - 1.6 AS zc FROM imp),
 p AS (SELECT seq, CASE WHEN cls IN ('CREDIT_EVENT', 'GEOPOLITICAL') THEN {ISO} ELSE 1.0 / (1.0 + exp(-z)) END AS p, cls IN ('CREDIT_EVENT', 'GEOPOLITICAL') AS cal FROM c)
SELECT seq, round(p, 9) AS p, greatest(1, least(10, ceil(10.0 * p - 1e-9)))::BIGINT AS impact, cal::BIGINT AS calibrated FROM p""")
def f24(spark, sf):
    """Class logits and a piecewise-linear map where the class has support; the prior elsewhere."""
    s = sig(spark, sf)
    c = risk.calibrated_score(MODEL, F.col("event"), F.col("subtype"), F.col("sentiment"), F.col("publishers"), F.col("social_authors"), F.col("authoritative"), F.col("novelty"), F.col("relevance"))
    return s.select("seq", c.alias("c")).select("seq", r6("c.p", 9).alias("p"), big("c.impact").alias("impact"), big(F.col("c.calibrated").cast("int")).alias("calibrated"))


@query("f25_naive_impact", f"WITH {S} SELECT seq, greatest(1, least(10, round_even(10 * abs(sentiment), 0)))::BIGINT AS naive FROM signals")
def f25(spark, sf):
    return sig(spark, sf).select("seq", big(risk.naive_impact(F.col("sentiment"))).alias("naive"))


# ------------------------------------------------------------------ gate
MAP_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fin.EVENT_MAP) + ") AS m(k, scenario)"
GATE_SQL = f"""ev AS (SELECT * FROM signals WHERE grain = 'event'), dc AS (SELECT * FROM signals WHERE grain = 'document'),
g0 AS (SELECT ev.*, (SELECT arg_max(sentiment, dc.seq) FROM dc WHERE dc.cluster_id = ev.cluster_id AND dc.seq <= ev.seq) AS doc_sentiment FROM ev),
g1 AS (SELECT g0.*, coalesce(m1.scenario, m2.scenario) AS scenario FROM g0 LEFT JOIN {MAP_SQL} ON m.k = cls || '/' || subtype LEFT JOIN {MAP_SQL.replace(" AS m(", " AS m2(")} ON m2.k = cls || '/*')""".replace("m1.scenario", "m.scenario") + f""",
g AS (SELECT *, CASE WHEN retracted THEN 'RETRACT' WHEN impact < 8 THEN 'LOG' WHEN scenario IS NOT NULL AND event_conf >= 0.7 AND (publishers_60m >= 3 OR authoritative) THEN 'TRIGGER' ELSE 'REVIEW' END AS decision,
  CASE WHEN greatest(1, least(10, round_even(10 * abs(coalesce(doc_sentiment, sentiment)), 0))) > 7 AND NOT retracted THEN 'TRIGGER' ELSE 'LOG' END AS naive,
  array_to_string(list_filter([CASE WHEN impact < 8 THEN 'impact' END, CASE WHEN scenario IS NULL THEN 'scenario' END, CASE WHEN event_conf < 0.7 THEN 'confidence' END,
   CASE WHEN NOT (publishers_60m >= 3 OR authoritative) THEN 'corroboration' END, CASE WHEN retracted THEN 'not_disputed' END], lambda x: x IS NOT NULL), ',') AS failed FROM g1),
glog AS (SELECT * FROM (SELECT *, lag((decision, naive, impact)) OVER (PARTITION BY cluster_id ORDER BY seq) AS pv FROM g) WHERE pv IS NULL OR pv <> (decision, naive, impact))"""


def decisions(spark, sf) -> DataFrame:
    s = sig(spark, sf)
    return staged(spark, sf, "decisions", lambda: gate.evaluate(gate.with_last_document(
        s.filter("grain = 'event'"), s.filter("grain = 'document'"))))


@query("j10_last_document", f"WITH {S}, {GATE_SQL} SELECT seq, round(doc_sentiment, 6) AS doc_sentiment FROM g0")
def j10(spark, sf):
    """As-of join: latest document sentiment of the story at each event signal."""
    s = sig(spark, sf)
    return gate.with_last_document(s.filter("grain = 'event'"), s.filter("grain = 'document'")).select("seq", r6("doc_sentiment").alias("doc_sentiment"))


@query("j11_scenarios", f"WITH {S}, {GATE_SQL} SELECT cls AS event, coalesce(subtype, '') AS subtype, coalesce(scenario, '') AS scenario, count(*) AS n FROM g1 GROUP BY ALL")
def j11(spark, sf):
    e = events(spark, sf)
    return e.groupBy("event", F.coalesce("subtype", F.lit("")).alias("subtype"), F.coalesce(gate.scenario_of(F.col("event"), F.col("subtype")), F.lit("")).alias("scenario")).agg(F.count("*").alias("n"))


@query("m05_gate", f"WITH {S}, {GATE_SQL} SELECT seq, decision, naive AS naive_decision, coalesce(scenario, '') AS scenario, failed FROM g")
def m05(spark, sf):
    """Five checks, decision and naive comparator per event signal."""
    return decisions(spark, sf).select("seq", "decision", "naive_decision", F.coalesce("scenario", F.lit("")).alias("scenario"), "failed")


@query("w05_gate_changes", f"WITH {S}, {GATE_SQL} SELECT seq, cluster_id, decision, naive AS naive_decision FROM glog")
def w05(spark, sf):
    return gate.changes(decisions(spark, sf)).select("seq", "cluster_id", "decision", "naive_decision")


@query("a31_gate_summary", f"WITH {S}, {GATE_SQL} SELECT count(DISTINCT cluster_id) FILTER (WHERE decision = 'TRIGGER') AS triggered, count(DISTINCT cluster_id) FILTER (WHERE naive = 'TRIGGER') AS naive, count(DISTINCT cluster_id) FILTER (WHERE decision = 'REVIEW') AS reviewed, count(DISTINCT cluster_id) FILTER (WHERE decision = 'RETRACT') AS retracted FROM glog")
def a31(spark, sf):
    return evaluate.gate_summary(gate.changes(decisions(spark, sf)))


OBLIGORS = "(SELECT 'U' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS id FROM customer WHERE c_custkey % 2 = 0)"


@query("t13_stress_requests", f"""WITH {S}, {GATE_SQL}, f AS (SELECT *, max(CASE WHEN decision = 'TRIGGER' AND scenario IS NOT NULL THEN impact END) OVER (PARTITION BY cluster_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM glog)
SELECT seq, cluster_id, 'run' AS action, coalesce(CASE WHEN entity_id IN {OBLIGORS} THEN entity_id END, '') AS epicenter FROM f WHERE decision = 'TRIGGER' AND scenario IS NOT NULL AND coalesce(best, 0) < impact
UNION ALL SELECT seq, cluster_id, 'withdraw', '' FROM f WHERE decision = 'RETRACT' AND best IS NOT NULL""")
def t13(spark, sf):
    """Idempotent stress triggers and withdrawals from the gate log."""
    obligors = corpus.table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("U"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("obligor_id"))
    return gate.stress_requests(gate.changes(decisions(spark, sf)), obligors).select("seq", "cluster_id", "action", F.coalesce("epicenter", F.lit("")).alias("epicenter"))


@query("t14_breakers", f"""WITH {S}, {GATE_SQL}, m AS (SELECT seq, ticker, CASE WHEN decision = 'TRIGGER' AND cls IN ('CREDIT_EVENT', 'OPERATIONAL_ESG') AND impact >= 8 THEN 1 WHEN decision = 'RETRACT' THEN -1 END AS mk FROM g)
SELECT seq, ticker, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1, false)::BIGINT AS breaker FROM m""")
def t14(spark, sf):
    """Circuit breaker per name: set by a credit or operational trigger, cleared by a retraction."""
    return gate.breaker_state(decisions(spark, sf), "ticker").select("seq", "ticker", big(F.col("breaker").cast("int")).alias("breaker"))


@query("j23_story_context", f"""WITH {S}, {GATE_SQL}, l AS (SELECT cluster_id, arg_max(decision, seq) AS latest FROM g GROUP BY 1) SELECT seq, decision, latest AS latest_decision FROM g JOIN l USING (cluster_id)""")
def j23(spark, sf):
    d = decisions(spark, sf)
    return marts.story_context(events(spark, sf), d).select("seq", "decision", "latest_decision")


@query("m21_gate_frame", f"WITH {S}, {GATE_SQL} SELECT seq, CASE WHEN decision IN ('REVIEW', 'LOG') THEN failed ELSE '' END AS failed, coalesce(scenario, '') AS analog, strftime(make_timestamp(t * 1000000), '%m-%d %H:%M') AS time FROM glog")
def m21g(spark, sf):
    return marts.gate_frame(gate.changes(decisions(spark, sf))).select("seq", "failed", "analog", "time")


@query("m21_trigger_log", f"WITH {S}, {GATE_SQL} SELECT seq, cls || '/' || coalesce(subtype, '-') AS event, CASE WHEN decision <> 'TRIGGER' THEN failed ELSE '' END AS failed FROM glog")
def m21t(spark, sf):
    return marts.trigger_frame(gate.changes(decisions(spark, sf))).select("seq", "event", "failed")


@query("m21_story_frame", f"WITH {S}, l AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) AS n FROM signals WHERE grain = 'event') SELECT cluster_id, strftime(make_timestamp(t * 1000000), '%m-%d %H:%M') AS updated, cls || coalesce(' / ' || lower(replace(subtype, '_', ' ')), '') AS event, CASE WHEN retracted THEN 'retracted' ELSE 'active' END AS status FROM l WHERE n = 1")
def m21s(spark, sf):
    return marts.story_frame(evaluate.latest_by(events(spark, sf), ["cluster_id"], "seq")).select("cluster_id", "updated", "event", "status")


@query("m22_rumour_timeline", f"""WITH {S}, {GATE_SQL} SELECT cluster_id, count(*) AS updates, count(*) FILTER (WHERE naive = 'TRIGGER') AS naive_fires, count(*) FILTER (WHERE decision = 'TRIGGER') AS triggers,
 max(impact) FILTER (WHERE decision = 'REVIEW')::BIGINT AS peak_in_review, CASE WHEN arg_max(retracted, seq) THEN 'retracted' ELSE 'active' END AS final_status, max(social_authors)::BIGINT AS accounts FROM g GROUP BY 1""")
def m22(spark, sf):
    t = marts.rumour_timeline(decisions(spark, sf))
    return t.select("cluster_id", "updates", big("naive_fires").alias("naive_fires"), big("triggers").alias("triggers"), big("peak_in_review").alias("peak_in_review"), "final_status", big("accounts").alias("accounts"))


@query("m22_rumour_updates", f"""WITH {S}, {GATE_SQL} SELECT cluster_id, seq, row_number() OVER w AS update, t AS at, impact::BIGINT AS impact, decision, naive AS naive_decision, social_authors::BIGINT AS accounts, publishers::BIGINT AS publishers,
 CASE WHEN retracted THEN 'retracted' ELSE 'active' END AS status, max(CASE WHEN decision = 'REVIEW' THEN impact END) OVER w::BIGINT AS peak_in_review FROM g WINDOW w AS (PARTITION BY cluster_id ORDER BY seq)""")
def m22u(spark, sf):
    """The timeline update by update."""
    u = marts.rumour_updates(decisions(spark, sf))
    return u.select("cluster_id", "seq", "update", secs("as_of").alias("at"), big("impact").alias("impact"), "decision", "naive_decision", big("accounts").alias("accounts"), big("publishers").alias("publishers"),
                    "status", big("peak_in_review").alias("peak_in_review"))


# ------------------------------------------------------------------ latest state and index
@query("j21_latest_entities", f"WITH {S} SELECT entity_id, max(seq) AS seq FROM signals WHERE grain = 'event' GROUP BY entity_id")
def j21(spark, sf):
    return evaluate.latest_by(events(spark, sf), ["entity_id"], "seq").select("entity_id", "seq")


@query("w06_latest_stories", f"WITH {S} SELECT cluster_id, seq, impact::BIGINT AS impact FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC) AS n FROM signals WHERE grain = 'event') WHERE n = 1")
def w06(spark, sf):
    return evaluate.latest_by(events(spark, sf), ["cluster_id"], "seq").select("cluster_id", "seq", big("impact").alias("impact"))


@query("k06_entities_by_impact", f"WITH {S}, l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) AS n FROM signals WHERE grain = 'event') SELECT entity_id, impact::BIGINT AS impact FROM l WHERE n = 1 ORDER BY impact DESC, abs(sentiment) DESC, entity_id LIMIT 50")
def k06(spark, sf):
    l = evaluate.latest_by(events(spark, sf), ["entity_id"], "seq")
    return l.orderBy(F.desc("impact"), F.desc(F.abs("sentiment")), "entity_id").limit(50).select("entity_id", big("impact").alias("impact"))


LAM = math.log(2) / (6 * 3600.0)
INDEX_SQL = f"""ev AS (SELECT *, CASE WHEN retracted THEN 0.0 ELSE relevance / 100.0 * greatest(sent_conf, 0.05) * (1 + log2(1 + publishers)) END AS w FROM signals WHERE grain = 'event'),
pr AS (SELECT u.seq AS useq, u.t AS now, u.entity_id, s.cluster_id, max(s.seq) AS sseq FROM ev u JOIN ev s ON s.entity_id = u.entity_id AND s.seq <= u.seq GROUP BY ALL),
st AS (SELECT pr.useq, pr.now, pr.entity_id, ev.*EXCLUDE (entity_id), now - ev.t AS age FROM pr JOIN ev ON ev.seq = pr.sseq WHERE now - ev.t <= 259200),
ix AS (SELECT useq, sum(w * exp(-{LAM!r} * greatest(age, 0)) * sentiment) AS num, sum(w * exp(-{LAM!r} * greatest(age, 0))) AS den, count(*) AS stories, max(relevance) AS relevance,
  arg_max(cluster_id, (impact, t, cluster_id)) FILTER (WHERE NOT retracted AND age >= 0 AND age <= 21600) AS top, max(impact) FILTER (WHERE NOT retracted AND age >= 0 AND age <= 21600) AS top_impact FROM st GROUP BY useq)"""


def entity_rows(spark, sf):
    return staged(spark, sf, "entity_index", lambda: index.entity_index(events(spark, sf)))


@query("a09_entity_index", f"WITH {S}, {INDEX_SQL} SELECT 'sig_' || CAST(useq AS VARCHAR) AS source_signal, round(CASE WHEN den > 0 THEN num / den ELSE 0 END, 6) AS sentiment, round(den / (den + 0.5), 6) AS sent_conf, stories FROM ix")
def a09(spark, sf):
    """Decayed entity index at every update over the latest state of each story."""
    return entity_rows(spark, sf).select("source_signal", r6("sentiment").alias("sentiment"), r6("sent_conf").alias("sent_conf"), "stories")


@query("a10_top_story", f"WITH {S}, {INDEX_SQL} SELECT 'sig_' || CAST(useq AS VARCHAR) AS source_signal, coalesce(top, '') AS cluster_id, coalesce(top_impact, 1)::BIGINT AS impact FROM ix")
def a10(spark, sf):
    return entity_rows(spark, sf).select("source_signal", F.coalesce("cluster_id", F.lit("")).alias("cluster_id"), big("impact").alias("impact"))


@query("a11_story_counts", f"WITH {S}, {INDEX_SQL} SELECT 'sig_' || CAST(useq AS VARCHAR) AS source_signal, stories, relevance::BIGINT AS relevance FROM ix")
def a11(spark, sf):
    return entity_rows(spark, sf).select("source_signal", "stories", big("relevance").alias("relevance"))


HYST_SQL = """hy AS (SELECT *, CASE WHEN relevance < 60 OR retracted THEN NULL WHEN abs(sentiment) >= 0.3 THEN 1 WHEN abs(sentiment) < 0.15 THEN 0 END AS mk FROM signals WHERE grain = 'event'),
q AS (SELECT *, NOT (relevance < 60 OR retracted) AND coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY cluster_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS ok FROM hy)"""


@query("w07_hysteresis", f"WITH {S}, {HYST_SQL} SELECT seq, ok::BIGINT AS qualified FROM q")
def w07(spark, sf):
    return index.hysteresis(events(spark, sf), 0.3, 60).select("seq", big(F.col("qualified").cast("int")).alias("qualified"))


@query("a12_tilt_index", f"""WITH {S}, {HYST_SQL}, e AS (SELECT *, CASE WHEN ok AND novelty >= 50 THEN relevance / 100.0 * greatest(sent_conf, 0.05) * (1 + log2(1 + publishers)) ELSE 0 END AS w, (ok AND novelty >= 50)::INT AS cnt FROM q),
 pr AS (SELECT u.seq AS useq, u.t AS now, s.cluster_id, max(s.seq) AS sseq FROM e u JOIN e s ON s.ticker = u.ticker AND s.seq <= u.seq GROUP BY ALL),
 st AS (SELECT useq, now, e.*, now - e.t AS age FROM pr JOIN e ON e.seq = pr.sseq)
SELECT useq AS seq, round(CASE WHEN sum(w) > 0 THEN sum(w * exp(-{LAM!r} * greatest(age, 0)) * sentiment) / sum(w * exp(-{LAM!r} * greatest(age, 0))) ELSE 0 END, 6) AS index_value, sum(cnt)::BIGINT AS stories FROM st GROUP BY useq""")
def a12(spark, sf):
    """Tilt index per name at each of its updates."""
    return index.tilt_index(events(spark, sf), 6.0, 50, 0.3, 60).select("seq", r6("index_value").alias("index_value"), big("stories").alias("stories"))


@query("w03_gap_chains", f"WITH {S}, p AS (SELECT *, lag(t) OVER (PARTITION BY entity_id ORDER BY t, seq) AS pv FROM signals) SELECT seq, (sum(CASE WHEN pv IS NULL OR t - pv > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS chain FROM p")
def w03(spark, sf):
    """24-hour gap chains per entity."""
    return neardup.gap_chains(sig(spark, sf), ["entity_id"], "as_of", "seq").select("seq", big("chain").alias("chain"))


# ------------------------------------------------------------------ scorecards
@query("a28_scorecard", f"""WITH {S}, {GATE_SQL}, d AS (SELECT ticker AS pack, count(DISTINCT seq) AS documents, count(DISTINCT seq) FILTER (WHERE round_even(10 * abs(sentiment), 0) > 7) AS naive_fires FROM dc GROUP BY 1),
 k AS (SELECT ticker AS pack, count(DISTINCT cluster_id) FILTER (WHERE decision = 'TRIGGER') AS triggers, count(DISTINCT cluster_id) FILTER (WHERE decision = 'REVIEW') AS reviews, count(*) FILTER (WHERE decision = 'RETRACT') AS retractions, min(t) FILTER (WHERE decision = 'TRIGGER') AS first_at FROM glog GROUP BY 1)
SELECT pack, documents, naive_fires, coalesce(triggers, 0) AS triggers, coalesce(reviews, 0) AS reviews, coalesce(retractions, 0)::BIGINT AS retractions, round((1706745600 - first_at) / 3600.0, 6) AS lead_hours FROM d LEFT JOIN k USING (pack)""")
def a28(spark, sf):
    """Gate scorecard per pack with lead time against a reference moment."""
    docs = sig(spark, sf).filter("grain = 'document'").select(F.col("ticker").alias("pack"), F.col("seq").alias("doc_id"), "sentiment", "as_of")
    log = gate.changes(decisions(spark, sf)).select(F.col("ticker").alias("pack"), "cluster_id", "decision", "as_of")
    refs = docs.select("pack").distinct().withColumn("reference_at", F.timestamp_seconds(F.lit(1706745600))).withColumn("expected", F.lit(True))
    s = evaluate.gate_scorecard(log, docs, "pack", refs)
    return s.select("pack", "documents", "naive_fires", "triggers", "reviews", big("retractions").alias("retractions"), r6("lead_hours").alias("lead_hours"))


@query("a30_operational_stats", f"""WITH {S}, d AS (SELECT * FROM signals WHERE grain = 'document'), r AS (SELECT engine_ms FROM d ORDER BY seq DESC LIMIT 500)
SELECT count(*) AS signals, count(*) FILTER (WHERE impact >= 8) AS severe, round(quantile_cont(engine_ms, 0.5), 6) AS p50_ms, round(quantile_cont(engine_ms, 0.95), 6) AS p95_ms, round(1000.0 * count(*) / sum(engine_ms), 6) AS per_second, round((SELECT quantile_cont(engine_ms, 0.5) FROM r), 6) AS median_recent_ms FROM d""")
def a30(spark, sf):
    s = evaluate.operational_stats(sig(spark, sf))
    return s.select("signals", big("severe").alias("severe"), r6("p50_ms").alias("p50_ms"), r6("p95_ms").alias("p95_ms"), r6("per_second").alias("per_second"), r6("median_recent_ms").alias("median_recent_ms"))


@query("a34_distinct_ids", "SELECT count(DISTINCT (user_id, event_type, props)) AS n FROM events")
def a34(spark, sf):
    """Distinct keys across polls."""
    return corpus.table(spark, sf, "events").dropDuplicates(["user_id", "event_type", "props"]).agg(F.count("*").alias("n"))


@query("t06_tumbling_slots", "SELECT event_type, epoch(time_bucket(INTERVAL '15 minutes', ts))::BIGINT AS slot, count(*) AS n FROM events GROUP BY 1, 2")
def t06(spark, sf):
    e = corpus.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("ts", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    return g.select("event_type", secs("w.start").alias("slot"), "n")
