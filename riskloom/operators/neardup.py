"""Near-duplicate matching of documents that speak about the same entity within 24 hours.

Copies are collapsed first: a node is one distinct key text per (entity, day), so a story copied
a million times is one node, and only distinct texts are compared. Candidates come from two exact
filters (rare-word prefixes for the word overlap, single signature slots for MinHash); how many
earlier documents a node stands for is then read from running counts, never from document pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.dims.text_rules import TextDims
from riskloom.functions import minhash as mh, text as tx
from riskloom.functions.scan import Carry, asof_last, has_large_key, prefix_scan
from riskloom.session import cut, in_tasks, kept

JOIN_JACCARD, JOIN_SIM, DUP_SIM, COORD_SIM = 0.3, 0.5, 0.8, 0.7
DAY = 86_400


def day_of(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / DAY)


def with_node(rows: DataFrame, dims: TextDims) -> DataFrame:
    """Add the token text of the story key (``key_tokens``) and its ``day``."""
    return rows.withColumn("key_tokens", F.concat_ws(" ", tx.tokens(F.col("key_text"), dims.stop))).withColumn(
        "day", day_of("published_at"))


def nodes_of(rows: DataFrame) -> DataFrame:
    """Distinct key texts per entity and day with their words and signature."""
    distinct = in_tasks(rows.select("entity_id", "day", "key_tokens").distinct(), ["entity_id", "day", "key_tokens"])
    toks = F.when(F.col("key_tokens") == "", F.array().cast("array<string>")).otherwise(F.split("key_tokens", " "))
    out = distinct.withColumn("_t", toks)
    return out.select(
        "entity_id", "day", "key_tokens", F.xxhash64("key_tokens").alias("node"),
        tx.content_words(F.col("_t")).alias("words"), mh.signature(tx.shingles(F.col("_t"))).alias("sig"))


def word_candidates(nodes: DataFrame, threshold: float = JOIN_JACCARD) -> DataFrame:
    """Node pairs that can reach the word overlap: they share one of their rarest words.

    Two sets with overlap >= t share a word among the first n - ceil(t n) + 1 of any common order;
    ordering by rarity keeps the hot words out of the join keys.
    """
    words = nodes.select("entity_id", "day", "node", F.size("words").alias("n"), F.explode("words").alias("word"))
    freq = words.groupBy("entity_id", "word").agg(F.count("*").alias("df"))
    ranked = words.join(freq, ["entity_id", "word"]).groupBy("entity_id", "day", "node", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ws"))
    keep = F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1
    prefix = ranked.select("entity_id", "day", "node", "n", F.explode(F.slice("ws", F.lit(1), keep)).alias("w")).select(
        "entity_id", "day", "node", "n", F.col("w.word").alias("word"))
    return _pair_on(prefix, ["word"]).filter(
        (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    ).select("entity_id", "day_a", "node_a", "day_b", "node_b").distinct()


def slot_candidates(nodes: DataFrame, threshold: float = JOIN_SIM) -> DataFrame:
    """Node pairs that can agree on >= ``threshold`` of the slots: they agree on one of the first few."""
    width = mh.PERMUTATIONS - math.ceil(threshold * mh.PERMUTATIONS) + 1
    slots = nodes.select(
        "entity_id", "day", "node", F.size("words").alias("n"), F.posexplode(F.slice("sig", 1, width)).alias("slot", "value"))
    return _pair_on(slots, ["slot", "value"]).select("entity_id", "day_a", "node_a", "day_b", "node_b").distinct()


def _pair_on(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """Earlier-or-same-day node (a) with node (b); a day meets itself and the day before."""
    a = keyed.select("entity_id", *keys, F.col("day").alias("day_a"), F.col("node").alias("node_a"), F.col("n").alias("n_a"),
                     F.explode(F.array(F.col("day"), F.col("day") + 1)).alias("day_b"))
    b = keyed.select("entity_id", *keys, F.col("day").alias("day_b"), F.col("node").alias("node_b"), F.col("n").alias("n_b"))
    return a.join(b, ["entity_id", "day_b", *keys]).filter((F.col("day_a") < F.col("day_b")) | (F.col("node_a") != F.col("node_b")))


def similar_nodes(nodes: DataFrame) -> DataFrame:
    """(entity, day_b, node_b) <- (day_a, node_a) with sim and overlap; a node is similar to itself."""
    pairs = word_candidates(nodes).unionByName(slot_candidates(nodes)).distinct()
    left = nodes.select("entity_id", F.col("day").alias("day_a"), F.col("node").alias("node_a"),
                        F.col("words").alias("w_a"), F.col("sig").alias("s_a"))
    right = nodes.select("entity_id", F.col("day").alias("day_b"), F.col("node").alias("node_b"),
                         F.col("words").alias("w_b"), F.col("sig").alias("s_b"))
    checked = pairs.join(left, ["entity_id", "day_a", "node_a"]).join(right, ["entity_id", "day_b", "node_b"]).select(
        "entity_id", "day_a", "node_a", "day_b", "node_b",
        mh.similarity(F.col("s_a"), F.col("s_b")).alias("sim"), tx.jaccard(F.col("w_a"), F.col("w_b")).alias("jac"))
    itself = nodes.select("entity_id", F.col("day").alias("day_a"), F.col("node").alias("node_a"), F.col("day").alias("day_b"),
                          F.col("node").alias("node_b"), F.lit(1.0).alias("sim"), F.lit(1.0).alias("jac"))
    return checked.filter((F.col("sim") >= JOIN_SIM) | (F.col("jac") >= JOIN_JACCARD)).unionByName(itself)


def earlier_similar(rows: DataFrame, dims: TextDims, split: bool | None = None) -> DataFrame:
    """Per row: ``similar`` = earlier similar rows of the entity within 24 h; ``near_*`` = best copy source.

    Needs entity_id, doc_id, published_at, key_text, source_type, own_key.
    """
    base = (rows if {"key_tokens", "day"} <= {*rows.columns} else with_node(rows, dims)).withColumn("node", F.xxhash64("key_tokens")).withColumn(
        "ord", F.struct("published_at", "doc_id"))
    slim = kept(base.select("entity_id", "day", "node", "key_tokens", "doc_id", "published_at", "ord", "source_type", "own_key"))
    split = has_large_key(slim, ["entity_id"]) if split is None else split
    near = kept(similar_nodes(kept(nodes_of(slim))))
    bucket = F.floor(F.unix_seconds("ord.published_at") / 3600)
    place = ["entity_id", "day_a", "node_a"]
    facts = prefix_scan(
        slim.select("entity_id", F.col("day").alias("day_a"), F.col("node").alias("node_a"), "ord", "source_type", "own_key"),
        place, ["ord"], bucket, [Carry("idx", "sum", F.lit(1).cast("bigint"))], split)
    probes = slim.select("entity_id", F.col("day").alias("day_b"), F.col("node").alias("node_b"), "doc_id", "published_at", "ord").join(
        near, ["entity_id", "day_b", "node_b"]).select(
            *place, "doc_id", "published_at", "ord", "sim")
    upper = asof_last(probes, facts, place, "ord", bucket, ["idx"], strict=True, split=split).select(
        *place, "doc_id", "published_at", "sim", F.coalesce("idx", F.lit(0)).alias("c1"))
    low = upper.filter("c1 > 0").withColumn(
        "ord", F.struct((F.col("published_at") - F.expr("INTERVAL 24 HOURS")).alias("published_at"), F.lit("").alias("doc_id")))
    both = asof_last(low, facts, place, "ord", bucket, ["idx"], strict=True, split=split).select(
        *place, "doc_id", "sim", "c1", F.coalesce("idx", F.lit(0)).alias("c0")).filter("c1 > c0")
    # the earliest document of the node inside the window is number c0 + 1
    first = facts.select(*place, F.col("idx").alias("at"), F.col("ord.published_at").alias("near_at"),
                         F.col("ord.doc_id").alias("near_doc"), F.col("source_type").alias("near_type"), F.col("own_key").alias("near_own"))
    sources = both.withColumn("at", F.when(F.col("sim") >= DUP_SIM, F.col("c0") + 1)).join(first, [*place, "at"], "left")
    best = sources.groupBy("entity_id", "doc_id").agg(
        F.sum(F.col("c1") - F.col("c0")).alias("similar"),
        F.min(F.when(F.col("near_doc").isNotNull(), F.struct(
            (-F.col("sim")).alias("neg"), "near_at", "near_doc", "near_type", "near_own"))).alias("near"))
    return rows.join(best, ["entity_id", "doc_id"], "left").withColumn("similar", F.coalesce("similar", F.lit(0)))


def novelty_of(similar: Column) -> Column:
    """100 for the first story, 100 / (1 + n) after n similar ones, rounded half to even."""
    return F.bround(100.0 / (1 + similar), 0).cast("int")


def with_voice(rows: DataFrame) -> DataFrame:
    """Syndicated copies speak with the original's voice; inheritance is followed to its root.

    Adds ``voice`` and ``syndicated``. Pointers are doubled, so a chain of n copies takes log2(n) joins.
    """
    press = (F.col("source_type") != "social") & (F.col("near.near_type") != "social")
    links = cut(rows.filter(F.col("near").isNotNull() & press).select(
        "entity_id", "doc_id", F.col("near.near_doc").alias("parent"), F.col("near.near_own").alias("root_key")))
    while True:
        up = links.select("entity_id", F.col("doc_id").alias("parent"), F.col("parent").alias("grand"), F.col("root_key").alias("grand_key"))
        hop = links.join(up, ["entity_id", "parent"], "left")
        moved = hop.filter(F.col("grand").isNotNull()).limit(1).count()
        if not moved:
            break
        links = cut(hop.select("entity_id", "doc_id", F.coalesce("grand", "parent").alias("parent"),
                               F.coalesce("grand_key", "root_key").alias("root_key")))
    return rows.join(links.select("entity_id", "doc_id", "root_key"), ["entity_id", "doc_id"], "left").withColumn(
        "voice", F.coalesce("root_key", "own_key")).withColumn(
        "syndicated", F.coalesce(F.col("root_key") != F.col("own_key"), F.lit(False))).drop("root_key", "near")


def fingerprint_novelty(rows: DataFrame, dims: TextDims, split: bool | None = None) -> DataFrame:
    """Title-fingerprint novelty: earlier rows with the same first ten words within 24 h."""
    base = rows.withColumn("fp", tx.fingerprint(F.col("title"), F.col("body"), dims.fingerprint_stop)).withColumn(
        "ord", F.struct("published_at", "doc_id"))
    bucket = F.floor(F.unix_seconds("ord.published_at") / 3600)
    base = cut(base.select("entity_id", "fp", "ord"))
    split = has_large_key(base, ["entity_id", "fp"]) if split is None else split
    facts = prefix_scan(base, ["entity_id", "fp"], ["ord"], bucket, [Carry("idx", "sum", F.lit(1).cast("bigint"))], split)
    low = facts.select("entity_id", "fp", F.col("ord.doc_id").alias("doc_id"), F.col("ord.published_at").alias("published_at"), F.col("idx").alias("c1"),
                       F.struct((F.col("ord.published_at") - F.expr("INTERVAL 24 HOURS")).alias("published_at"), F.lit("").alias("doc_id")).alias("ord"))
    out = asof_last(low, facts, ["entity_id", "fp"], "ord", bucket, ["idx"], strict=True, split=split)
    n = F.col("c1") - 1 - F.coalesce("idx", F.lit(0))
    return out.select("entity_id", "doc_id", "published_at", "fp", n.alias("repeats"), novelty_of(n).alias("novelty"))


def gap_chains(rows: DataFrame, keys: list[str], ts: str, row_id: str, gap_hours: int = 24,
               split: bool | None = None) -> DataFrame:
    """Session chains: a gap of more than ``gap_hours`` starts a new chain; adds ``chain`` (0, 1, ...)."""
    order = [ts, row_id]
    bucket = F.floor(F.unix_seconds(F.col(ts)) / DAY)
    split = has_large_key(rows, keys) if split is None else split
    prev = prefix_scan(rows, keys, order, bucket, [Carry("_prev", "last", F.col(ts), inclusive=False)], split)
    new = F.col("_prev").isNull() | (F.unix_seconds(F.col(ts)) - F.unix_seconds("_prev") > gap_hours * 3600)
    marked = prev.withColumn("_new", new.cast("int"))
    return prefix_scan(marked, keys, order, bucket, [Carry("chain", "sum", F.col("_new").cast("bigint"))], split).withColumn(
        "chain", F.col("chain") - 1).drop("_new", "_prev")
