"""Scorecards over labelled sets, gate logs and story tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.risk import naive_impact


def classification_scores(rows: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """Accuracy and macro-F1 over the union of labels seen as truth or prediction."""
    cell = rows.groupBy(*by, y, p).agg(F.count("*").alias("c"))
    both = cell.select(*by, F.explode(F.array(
        F.struct(F.col(y).alias("label"), F.when(F.col(y) == F.col(p), F.col("c")).otherwise(0).alias("tp"),
                 F.when(F.col(y) != F.col(p), F.col("c")).otherwise(0).alias("fn"), F.lit(0).cast("bigint").alias("fp")),
        F.struct(F.col(p).alias("label"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fn"),
                 F.when(F.col(y) != F.col(p), F.col("c")).otherwise(0).alias("fp")))).alias("s"))
    per = both.groupBy(*by, "s.label").agg(F.sum("s.tp").alias("tp"), F.sum("s.fn").alias("fn"), F.sum("s.fp").alias("fp"))
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(denom > 0, 2.0 * F.col("tp") / denom).otherwise(0.0)
    return per.groupBy(*by).agg(
        (F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"), F.avg(f1).alias("macro_f1"), F.sum(F.col("tp") + F.col("fn")).alias("n"))


def label_mix(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    c = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return c.withColumn("share", F.col("n") / F.sum("n").over(total))


def majority(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    c = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    return c.groupBy(*by).agg(F.min_by(label, F.struct((-F.col("n")).alias("x"), label)).alias("majority"), (F.max("n") / F.sum("n")).alias("share"))


def pair_scores(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision and recall of two sets of keys (full join of distinct pairs)."""
    g = gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    p = predicted.select(*keys).distinct().withColumn("_p", F.lit(1))
    j = g.join(p, keys, "full").agg(
        F.sum(F.when(F.col("_g").isNotNull() & F.col("_p").isNotNull(), 1).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("_g").isNull(), 1).otherwise(0)).alias("fp"), F.sum(F.when(F.col("_p").isNull(), 1).otherwise(0)).alias("fn"))
    return j.select("tp", "fp", "fn", (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"),
                    (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))).alias("recall"))


def alias_baseline(docs: DataFrame, entities: list) -> DataFrame:
    """Naive linker: any alias, ambiguous or not, anywhere in the text, ignoring case."""
    low = F.lower("text")
    hits = F.array(*[F.when(_any_alias(low, e), F.lit(e.entity_id)) for e in entities if e.entity_type == "company"])
    return docs.select("doc_id", F.explode_outer(F.filter(hits, lambda h: h.isNotNull())).alias("entity_id")).filter(F.col("entity_id").isNotNull())


def _any_alias(low: Column, e) -> Column:
    out = F.lit(False)
    for a in (*e.aliases, *e.ambiguous_aliases):
        out = out | low.contains(a.lower())
    return out


def gate_scorecard(log: DataFrame, documents: DataFrame, by: str, reference: DataFrame | None = None) -> DataFrame:
    """Per pack: triggered / reviewed stories, retractions, naive fires, first trigger and its lead time in hours.

    ``log`` has by, cluster_id, decision, as_of; ``documents`` has by, doc_id, sentiment, as_of.
    """
    hit = lambda d: F.when(F.col("decision") == d, F.col("cluster_id"))
    g = log.groupBy(by).agg(
        F.count_distinct(hit("TRIGGER")).alias("triggers"), F.count_distinct(hit("REVIEW")).alias("reviews"),
        F.sum((F.col("decision") == "RETRACT").cast("int")).alias("retractions"),
        F.min(F.when(F.col("decision") == "TRIGGER", F.col("as_of"))).alias("first_trigger"))
    d = documents.withColumn("_fire", naive_impact(F.col("sentiment")) > 7).groupBy(by).agg(
        F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("_fire"), F.col("doc_id"))).alias("naive_fires"),
        F.min(F.when(F.col("_fire"), F.col("as_of"))).alias("first_naive"))
    out = d.join(g, by, "left").fillna(0, ["triggers", "reviews", "retractions"])
    if reference is not None:
        out = out.join(reference.select(by, "reference_at", "expected"), by, "left").withColumn(
            "lead_hours", (F.unix_seconds("reference_at") - F.unix_seconds("first_trigger")) / 3600.0).withColumn(
            "correct", (F.col("triggers") > 0) == F.col("expected"))
    return out


def dedup_report(documents: DataFrame, latest: DataFrame, by: str) -> DataFrame:
    """Documents, reports, posts, publishers against stories, voices and coordinated groups."""
    d = documents.groupBy(by).agg(
        F.count_distinct("doc_id").alias("documents"), F.count_distinct(F.when(F.col("source_type") != "social", F.col("doc_id"))).alias("reports"),
        F.count_distinct(F.when(F.col("source_type") == "social", F.col("doc_id"))).alias("posts"), F.count_distinct("publisher").alias("outlets"))
    s = latest.groupBy(by).agg(
        F.count("*").alias("stories"), F.sum((F.col("impact") >= 8).cast("int")).alias("severe_stories"),
        F.max("publishers").alias("max_publishers"), F.sum(F.col("coordinated").cast("int")).alias("coordinated_groups"))
    return d.join(s, by, "left")


def operational_stats(signals: DataFrame, newest: int = 500) -> DataFrame:
    """Signal counts, severe count, median of the newest latencies, exact p50 / p95 and throughput."""
    docs = signals.filter("grain = 'document'")
    recent = docs.filter(F.col("engine_ms").isNotNull()).orderBy(F.desc("seq")).limit(newest).agg(F.median("engine_ms").alias("median_recent_ms"))
    return docs.agg(
        F.count("*").alias("signals"), F.sum((F.col("impact") >= 8).cast("int")).alias("severe"),
        F.percentile("engine_ms", F.lit(0.5)).alias("p50_ms"), F.percentile("engine_ms", F.lit(0.95)).alias("p95_ms"),
        (1000.0 * F.count("engine_ms") / F.sum("engine_ms")).alias("per_second")).join(F.broadcast(recent))


def gate_summary(log: DataFrame) -> DataFrame:
    hit = lambda c, d: F.count_distinct(F.when(F.col(c) == d, F.col("cluster_id")))
    return log.agg(hit("decision", "TRIGGER").alias("triggered"), hit("naive_decision", "TRIGGER").alias("naive"),
                   hit("decision", "REVIEW").alias("reviewed"), hit("decision", "RETRACT").alias("retracted"))


def latest_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Latest row per key (row_number = 1; the limit is applied before the shuffle)."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def newest(rows: DataFrame, grain: str | None = None, entity: str | None = None, min_impact: int | None = None, limit: int = 200) -> DataFrame:
    """Newest-first listing with optional filters."""
    out = rows
    if grain:
        out = out.filter(F.col("grain") == grain)
    if entity:
        out = out.filter(F.col("entity_id") == entity)
    if min_impact is not None:
        out = out.filter(F.col("impact") >= min_impact)
    return out.orderBy(F.desc("as_of"), F.desc("seq")).limit(limit)


def after_sequence(rows: DataFrame, seq: int, limit: int = 500) -> DataFrame:
    return rows.filter(F.col("seq") > seq).orderBy("seq").limit(limit)
