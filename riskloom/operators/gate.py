"""Trigger gate over event signals: five checks, a decision, a naive comparator, a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.dims import finance as fin
from riskloom.functions.risk import naive_impact
from riskloom.functions.scan import Carry, asof_last, has_large_key, prefix_scan
from riskloom.functions.text import stable_id


def scenario_of(event: Column, subtype: Column, event_map=fin.EVENT_MAP) -> Column:
    """(class, subtype) -> scenario with the class-level "CLASS/*" fallback."""
    pairs = F.create_map(*[F.lit(x) for kv in event_map for x in kv])
    exact = F.when(subtype.isNotNull(), F.try_element_at(pairs, F.concat_ws("/", event, subtype)))
    return F.coalesce(exact, F.try_element_at(pairs, F.concat(event, F.lit("/*"))))


def with_last_document(events: DataFrame, documents: DataFrame, split: bool | None = None) -> DataFrame:
    """As-of join: the sentiment of the story's latest document signal before each event signal.

    ``seq`` orders both; needs cluster_id, seq, sentiment, as_of on both sides.
    """
    facts = documents.filter(F.col("cluster_id").isNotNull()).select("cluster_id", "seq", F.col("sentiment").alias("doc_sentiment"))
    return asof_last(events, facts, ["cluster_id"], "seq", F.floor(F.col("seq") / 1_000_000), ["doc_sentiment"], split=split)


def evaluate(signals: DataFrame, cfg: fin.GateConfig = fin.GateConfig(), event_map=fin.EVENT_MAP) -> DataFrame:
    """Decision per event signal. ``doc_sentiment`` (may be null) feeds the naive comparator."""
    scenario = scenario_of(F.col("event"), F.col("subtype"), event_map)
    retracted = F.col("status") == "retracted"
    corroborated = (F.col("publishers_60m") >= cfg.min_publishers) | F.col("authoritative")
    parts = (("impact", F.col("impact") >= cfg.min_impact), ("scenario", scenario.isNotNull()),
             ("confidence", F.col("event_conf") >= cfg.min_confidence), ("corroboration", corroborated), ("not_disputed", ~retracted))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), ok.alias("passed")) for n, ok in parts])
    all_pass = parts[0][1]
    for _, ok in parts[1:]:
        all_pass = all_pass & ok
    decision = (
        F.when(retracted, "RETRACT").when(F.col("impact") < cfg.min_impact, "LOG").when(all_pass, "TRIGGER").otherwise("REVIEW"))
    naive = F.when((naive_impact(F.coalesce("doc_sentiment", "sentiment")) > cfg.naive_threshold) & ~retracted, "TRIGGER").otherwise("LOG")
    return signals.select(
        "*", stable_id("gate", F.col("signal_id")).alias("decision_id"), checks.alias("checks"), decision.alias("decision"),
        naive.alias("naive_decision"), scenario.alias("scenario"),
        F.concat_ws(",", F.transform(F.filter(checks, lambda c: ~c["passed"]), lambda c: c["name"])).alias("failed"))


def changes(decisions: DataFrame, order: str = "seq", split: bool | None = None) -> DataFrame:
    """Gate log: keep a decision only when (decision, naive, impact) differs from the story's previous one."""
    state = F.struct("decision", "naive_decision", "impact")
    bucket = F.floor(F.col(order) / 1_000_000)
    prev = prefix_scan(decisions, ["cluster_id"], [order], bucket, [Carry("_prev", "last", state, inclusive=False)], split)
    return prev.filter(F.col("_prev").isNull() | (F.col("_prev") != state)).drop("_prev")


def stress_requests(log: DataFrame, obligors: DataFrame, order: str = "seq", split: bool | None = None) -> DataFrame:
    """Idempotent stress triggers: a story runs again only when its impact rose above all earlier runs.

    RETRACT rows of a story that already ran come out as withdrawals.
    """
    bucket = F.floor(F.col(order) / 1_000_000)
    fires = (F.col("decision") == "TRIGGER") & F.col("scenario").isNotNull()
    split = has_large_key(log, ["cluster_id"]) if split is None else split
    seen = prefix_scan(log, ["cluster_id"], [order], bucket, [
        Carry("_best", "max", F.when(fires, F.col("impact")), inclusive=False)], split)
    runs = seen.filter(fires & (F.coalesce("_best", F.lit(0)) < F.col("impact")))
    known = obligors.select(F.col("obligor_id").alias("entity_id"), F.lit(True).alias("_known")).distinct()
    out = runs.join(known, "entity_id", "left").select(
        stable_id("stress", F.col("decision_id")).alias("run_id"), "cluster_id", order, "scenario", "impact",
        F.when(F.col("_known"), F.col("entity_id")).alias("epicenter"), "event", "subtype", F.lit("run").alias("action"))
    gone = seen.filter((F.col("decision") == "RETRACT") & F.col("_best").isNotNull()).select(
        stable_id("stress", F.col("decision_id")).alias("run_id"), "cluster_id", order, "scenario", "impact",
        F.lit(None).cast("string").alias("epicenter"), "event", "subtype", F.lit("withdraw").alias("action"))
    return out.unionByName(gone)


def breaker_events(decisions: DataFrame) -> Column:
    """+1 sets the breaker of a name, -1 clears it, null leaves it."""
    risky = F.col("event").isin(*fin.BREAKER_CLASSES) | F.coalesce(F.col("subtype"), F.lit("")).isin(*fin.BREAKER_SUBTYPES)
    return F.when((F.col("decision") == "TRIGGER") & risky & (F.col("impact") >= 8), 1).when(F.col("decision") == "RETRACT", -1)


def breaker_state(decisions: DataFrame, key: str = "entity_id", order: str = "seq", split: bool | None = None) -> DataFrame:
    marked = decisions.withColumn("_mark", breaker_events(decisions))
    out = prefix_scan(marked, [key], [order], F.floor(F.col(order) / 1_000_000), [Carry("_on", "last", F.col("_mark"))], split)
    return out.withColumn("breaker", F.coalesce(F.col("_on") == 1, F.lit(False))).drop("_mark", "_on")
