"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

A document's set is its distinct shingles (of four words unless told otherwise). Documents of equal sets are one class, which its smallest doc_id
stands for. A class is posted under each pair of coordinate and value of a 64-coordinate signature. Two sets of
similarity 0.8 agree in at least 36 coordinates (but for four in a million), so a match threshold of 36 lets postings be
skipped: pairs seen once cannot collide, and of a class's coordinates, rarest first, only the first 64 - 36 + 1 need
posting - two classes that agree in 36 must meet in one of them. A class of which 29 coordinates are its own posts
nothing. Common passages make frequent values, which come last and are skipped. Lists are then compared as in
``links``; links are confirmed on full sets.

Defined cases: null texts and texts without words have an empty set and are linked with nothing; fewer words than a
shingle are one; each row's component follows its own text, also where rows repeat a doc_id; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import identified, released, written
from riskloom.llm.links import maybe_in, similar_components
from riskloom.llm.shingles import coordinate_keys, digest, minhash, permutations, shingle_set, split_words

WIDTH = 4
COORDINATES = 64
MATCHES = 36
PERCENT = 80


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_id, n_shingles, set_id (16 bytes; null for empty sets), keys (one a coordinate)."""
    a, b = permutations(COORDINATES)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in (b.slice(at, 1024) for b in released(batches) for at in range(0, b.num_rows, 1024)):
            sets = [shingle_set(split_words(x or ""), width) for x in t.column(1).to_pylist()]
            keys = [coordinate_keys(minhash(s, a, b)) for s in sets if len(s)]
            ends = np.cumsum([0] + [COORDINATES * (len(s) > 0) for s in sets]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [t.column(0), t.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "text_id", "n_shingles", "set_id", "keys"])

    return identified(docs).withColumn("text_id", text_id(F.col("text"))).mapInArrow(run, "doc_id bigint, text_id bigint, n_shingles bigint, set_id binary, keys array<bigint>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, set_id, hashes of the full sets."""

    def run(batches):
        import pyarrow as pa

        for t in (b.slice(at, 1024) for b in released(batches) for at in range(0, b.num_rows, 1024)):
            sets = [shingle_set(split_words(x or ""), width) for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [t.column(0), pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "set_id", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, set_id binary, hashes binary")


def prefix_lists(reps: DataFrame, coordinates: int = COORDINATES, matches: int = MATCHES) -> DataFrame:
    """key, id of the postings that candidates can meet in; ``reps``: id, keys."""
    posted = reps.select("id", F.explode("keys").alias("key"))
    common = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posted.join(common, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("by_rarity"))   # 64 at most
    take = F.lit(coordinates - matches + 1) - (F.lit(coordinates) - F.size("by_rarity"))
    return shared.where(take > 0).select("id", F.explode(F.slice("by_rarity", F.lit(1), take)).alias("p")).select("p.key", "id")


def classed(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id of every row. Classes have numbers of their own, so that texts which share
    a doc_id stay apart; the smallest doc_id names a component at the end."""
    light = written(signed(docs, width), "signed")
    classes = light.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    one = classes.select("id", F.col("set_id").alias("of"), "first")
    reps = light.join(one, (F.col("doc_id") == F.col("first")) & (F.col("set_id") == F.col("of"))).dropDuplicates(["id"]).select("id", "keys")
    lists = written(prefix_lists(reps), "lists")
    posted = one.join(lists.select("id").distinct(), "id").join(classes.select("id", "weight"), "id")
    full = shingle_sets(maybe_in(identified(docs), "doc_id", posted.select("first").distinct()), width)
    sets = written(full.join(posted, (F.col("doc_id") == F.col("first")) & (F.col("set_id") == F.col("of")))
                   .select("id", "weight", "hashes").dropDuplicates(["id"]), "sets")
    found = similar_components(lists, sets, percent)
    grouped = classes.select("id", "set_id", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "component").select(F.col("set_id").alias("of"), "component_id")
    placed = light.select("doc_id", "text_id", "n_shingles", "set_id").join(named, F.col("set_id") == F.col("of"), "left")
    return placed.select("doc_id", "text_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (it is its own component's first)."""
    return classed(docs, percent, width).select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """One row of each component (the smallest doc_id's, of its texts in the component the one with the smallest hash),
    columns as given; rows without words have no component and one of each doc_id and text stays."""
    kept = classed(docs, percent, width).where("component_id = doc_id")
    one = kept.where("n_shingles > 0").groupBy("component_id").agg(F.min("text_id").alias("__text")).select(F.col("component_id").alias("__id"), "__text")
    empty = kept.where("n_shingles = 0").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__text")).distinct()
    row = (F.col("doc_id").cast("bigint") == F.col("__id")) & (text_id(F.col("text")) == F.col("__text"))
    return docs.join(one.unionByName(empty), row, "left_semi").withColumn("__text", text_id(F.col("text"))).dropDuplicates(["doc_id", "__text"]).drop("__text")
