"""Mixing sources to target weights by hash-threshold histograms, by DataFrame functions only.

A document's place inside its source is a 60-bit hash of its doc_id. Sizes are summed by source and the first 12 bits;
the bucket in which a source's budget ends is summed again by the next 12 bits, and so on to the whole hash. That gives
one threshold per source, and documents are taken by comparing their hash with it: nothing is sorted, reruns agree, and
a larger budget takes a superset. Budgets above a source's size take whole copies first.

Defined cases: a null text has size 0; a null source is a source of its own, the last; documents of equal hash (rows
that repeat a doc_id) are taken together; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import identified, written

WEIGHTS = (5, 2, 1)      # of the sources by code point, null last, repeating
SHARE = 1.5              # of all sizes that the mix has
MOST = 2                 # times its size that a source gives at most
STEP, BITS = 12, 60
SALTS = 32               # pieces that a source's rows are dealt to, where its row is not broadcast
SMALL_SOURCES = 10_000   # source rows that may be broadcast


def place(doc_id: Column) -> Column:
    """The first 60 bits of the md5 of the id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> and target, weight: shares by weight, stopped at ``most`` times the size, the rest reshared.

    One row per source. In order of size over weight, a source is stopped as long as its limit is within what the budget
    left by the stopped ones gives for its weight; the first that is not sets the level for all after it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (k + 1).cast("int"))
    limited = sizes.withColumn("weight", weight).withColumn("limit", F.lit(most).cast("bigint") * F.col("source_size"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    led = (limited.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("stopped_before", F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    stop = F.col("limit") * F.col("open_weight") <= F.col("weight") * (F.col("budget") - F.col("stopped_before"))
    flagged = led.withColumn("stop", stop)
    level = F.min_by(F.when(~F.col("stop"), F.struct("budget", "stopped_before", "open_weight")), F.when(~F.col("stop"), F.col("limit") / F.col("weight"))).over(everything)
    rated = flagged.withColumn("level", level)
    target = F.when(F.col("stop"), F.col("limit").cast("double")).otherwise(F.col("weight") * (F.col("level.budget") - F.col("level.stopped_before")) / F.col("level.open_weight"))
    return rated.select("source", "source_size", "weight", target.alias("target"))


def with_source(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """Rows with their source's row of ``table`` (``source`` and further columns, one row per source).

    A table of more than SMALL_SOURCES rows is joined by source and a salt, so a source's rows lie in SALTS pieces.
    """
    side = table.select(F.col("source").alias("__source"), *[c for c in table.columns if c != "source"])
    if small:
        return rows.join(F.broadcast(side), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    side = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("__piece", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(side, F.col("source").eqNullSafe(F.col("__source")) & (F.col("__piece") == F.col("__salt"))).drop("__source", "__salt", "__piece")


def thresholds(light: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """source, source_size, target, copies, below: a document is taken ``copies`` times, and once more if its hash is below.

    ``light``: doc_id, source, size, hash.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    state = table.select("source", "source_size", "target", copies.alias("copies"), F.lit(0).cast("bigint").alias("path"), F.lit(True).alias("open"))
    state = state.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    for shift in range(BITS - STEP, -1, -STEP):
        state = written(state, "mix")
        inside = with_source(light, state.where("open").select("source", "path", "rest"), small)
        if shift < BITS - STEP:
            inside = inside.where(F.shiftright("hash", shift + STEP) == F.col("path"))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket"), "rest").agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        crossed = sums.withColumn("upto", F.sum("n").over(upto)).where("upto > rest")
        first = crossed.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), "n"), "bucket").alias("first"))
        both = state.alias("s").join(first.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")), "left").select("s.*", "first")
        state = both.select(
            "source", "source_size", "target", "copies", F.coalesce("first.bucket", "path").alias("path"),
            (F.col("open") & F.col("first").isNotNull()).alias("open"),
            (F.col("rest") - F.coalesce("first.before", F.lit(0))).alias("rest"), F.coalesce("first.n", F.lit(0)).alias("last"))
        if shift:
            state = state.drop("last")
    # the last bucket is one hash: it is taken if that comes nearer to the budget
    below = F.when(F.col("open"), F.col("path") + (F.col("last") / 2 <= F.col("rest")).cast("bigint")).otherwise(F.lit(1 << BITS))
    return written(state.select("source", "source_size", "target", "copies", below.alias("below")), "thresholds")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame, bool]:
    """The documents' sizes and hashes (text read once), the thresholds per source, and whether those may be broadcast."""
    light = written(identified(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", size_of(F.col("text")).alias("size"), place(F.col("doc_id")).alias("hash")), "sizes")
    table = written(targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    small = table.count() <= SMALL_SOURCES
    return light, thresholds(light, table, small), small


def taken_times(hash_: Column) -> Column:
    return F.col("copies") + (hash_ < F.col("below")).cast("int")


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, size, source_size, target, times, taken (words: size times the number of times the document is taken)."""
    light, table, small = plan_mix(docs, **parameters)
    rows = with_source(light, table, small).withColumn("times", taken_times(F.col("hash")))
    return rows.select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given. Texts are not shuffled."""
    _, table, small = plan_mix(docs, **parameters)
    named = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.struct(*docs.columns).alias("__row"))
    rows = with_source(named, table.select("source", "copies", "below"), small)
    times = taken_times(place(F.col("doc_id")))
    return rows.where(times > 0).select(F.explode(F.array_repeat(F.col("__row"), times)).alias("__row")).select("__row.*")
