"""Document fingerprints: threshold-scaled sketches of word shingles, by DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed part of the hash range, so its size follows the document's and
two sketches can be merged or compared however unequal the documents are. The smallest hash is kept as well, which
leaves no text with words without a sketch and survives merging. A text of fewer words than a shingle is one shingle.

Defined cases: a null text counts as empty; a text without words has an empty sketch, and two empty sketches have
likeness 1; of rows that repeat a doc_id each gets its own sketch, and the one with the smallest text hash stands for
the doc_id as somebody's next document; a lone document is its own next one; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import identified, let, words, written

WIDTH = 5     # words of a shingle
PART = 8      # one in PART of the hash range is kept


def limit(part: int = PART) -> Column:
    """Hashes are signed: the range starts at -2^63."""
    return F.lit(-(1 << 63) + (1 << 64) // part)


def sketch(text: Column, width: int = WIDTH, part: int = PART) -> Column:
    """Sorted array of the kept hashes."""

    def kept(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - F.lit(width - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(ws, i, F.lit(width))))
        return F.when(F.size(ws) == 0, F.array().cast("array<bigint>")).otherwise(let(hashes, lambda h: trimmed(h, part)))

    return let(words(text), kept)


def trimmed(hashes: Column, part: int = PART) -> Column:
    """The hashes a sketch keeps of an array of hashes (a sketch of the union, when given two sketches put together)."""
    low = F.filter(hashes, lambda h: h < limit(part))
    return F.sort_array(F.array_distinct(F.concat(low, F.array(F.array_min(hashes)))))


def merge(a: Column, b: Column, part: int = PART) -> Column:
    return F.when(F.size(a) + F.size(b) == 0, a).otherwise(trimmed(F.concat(a, b), part))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has; 1 for an empty sketch."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def fingerprint(kept: Column) -> Column:
    """The sketch as a string: 16 hex digits a hash."""
    return F.array_join(F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def previous(ids: DataFrame) -> DataFrame:
    """doc_id, prev_id, prev_chars of one row per doc_id; the first follows the last.

    Rows are dealt by ranges of doc_id and written with their range's number, so order is settled inside ranges; only one
    row per range goes through the window over all ranges.
    """
    dealt = written(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy("doc_id")
    last = dealt.groupBy("part").agg(F.max_by(F.struct("doc_id", "n_chars"), "doc_id").alias("last"))
    end = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = last.select("part", F.coalesce(F.lag("last").over(end), F.last("last").over(whole)).alias("before"))
    lag = dealt.select("doc_id", "part", F.lag(F.struct("doc_id", "n_chars")).over(inside).alias("lag")).join(before, "part")
    at = F.coalesce("lag", "before")
    return lag.select("doc_id", at["doc_id"].alias("prev_id"), at["n_chars"].alias("prev_chars"))


def fingerprints(docs: DataFrame, width: int = WIDTH, part: int = PART) -> DataFrame:
    """doc_id, text, sketch of every whole text."""
    return identified(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), width, part))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, sketch, edited_sketch, next_sketch.

    The edited text ends in the start of the next document instead of its own last quarter. Texts are shuffled once by
    doc_id; what moves to the document before is the start that it needs, and the sketch.
    """
    ids = identified(docs).groupBy("doc_id").agg(F.max(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("n_chars"))
    order = previous(ids)
    base = fingerprints(docs).repartition("doc_id")   # one exchange, which both sides of the join below read
    earlier = F.lag("doc_id").over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    heads = base.withColumn("earlier", earlier).where("earlier IS NULL").join(order, "doc_id").select(
        F.col("prev_id").alias("doc_id"), F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), F.col("sketch").alias("next_sketch"))
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("head", F.lit(1), quarter))
    joined = base.join(heads, "doc_id").select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    return joined.withColumn("edited_sketch", sketch(F.col("edited")))
