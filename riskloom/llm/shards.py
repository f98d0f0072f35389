"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards.

Documents are vertices with a size; links come as pairs. All linked vertices start in the shard their hash names. In
each round a vertex counts its neighbours' weight by shard (one join of the links with the current labels, combined
before the shuffle) and asks to move to the shard that holds more of it than its own. The driver sees one row per
(from, to, gain bucket) and grants each pair of shards what both directions ask for plus the room under the target's
quota, highest gains first; inside the last bucket that fits in part, a hash decides. In even rounds a vertex may
only follow its smallest neighbour, in odd rounds one half of all may move, others each time, so two neighbours do not
swap places for ever. Cut links only fall by moves that were granted, and no shard ends
a round above its quota by more than one bucket's rounding.

Documents without links fill the shards up to equal sizes: their sizes are summed by hash bucket (a fixed number of
buckets), and each shard takes a run of buckets; the bucket in which a shard becomes full is cut again by a second hash.

Defined cases: a null text has size 1; an empty table gives no rows; rows that repeat a doc_id share its place; texts
that are equal are linked, null and empty texts are not linked with anything (they are filler without weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import identified, written

BUCKETS = 4096        # hash buckets of the documents without links; a boundary bucket has as many again
SLOT_BUCKETS = 4096   # hash buckets inside a shard, numbered apart
GAINS = 16            # gain buckets, by powers of two
QUOTA = 0.98          # of a shard's even part that linked documents may fill; the rest is left to documents without links


def _hash(seed: int, *cols: str) -> Column:
    """0 .. 2^31 - 1"""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 33)


def propose(labels: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """id, size, shard of all vertices, and target and bucket (of the gain) of those that would rather be elsewhere and may move."""
    there = labels.select(F.col("id").alias("dst"), F.col("shard").alias("there"))
    pull = links.join(there, "dst").groupBy(F.col("src").alias("id"), "there").agg(F.sum("weight").alias("pull"), F.min("dst").alias("dst"))
    best = pull.groupBy("id").agg(F.max_by(F.struct("there", "pull"), F.struct("pull", -F.col("there"))).alias("best"), F.map_from_entries(F.collect_list(F.struct("there", "pull"))).alias("pulls"), F.min(F.struct("dst", "there")).alias("first"))
    gain = F.col("best.pull") - F.coalesce(F.try_element_at("pulls", F.col("shard")), F.lit(0))
    # even rounds move towards a smaller neighbour only, which no two do to each other; odd rounds move one half of all
    turn = (F.pmod(_hash(100 + k, "id"), F.lit(2)) == 0) if k % 2 else (F.col("first.dst") < F.col("id")) & (F.col("first.there") == F.col("best.there"))
    wish = (F.col("best.there") != F.col("shard")) & (gain > 0) & turn
    bucket = F.least(F.lit(GAINS - 1), F.floor(F.log2(gain)).cast("int"))
    return labels.join(best, "id", "left").select("id", "size", "shard", F.when(wish, F.col("best.there")).alias("target"), F.when(wish, bucket).alias("bucket"))


def grant(asked: list, load: list[int], quota: float) -> dict[tuple[int, int], tuple[int, int, float]]:
    """(from, to) -> (lowest gain bucket that moves in full, the next one, the part of that which moves).

    ``asked``: rows of (shard, target, bucket, size); at most shards^2 * GAINS of them.
    """
    by: dict[tuple[int, int], dict[int, int]] = {}
    for a, b, g, n in asked:
        by.setdefault((a, b), {})[g] = n
    wish = {k: sum(v.values()) for k, v in by.items()}
    room = {b: max(0.0, quota - load[b]) for b in range(len(load))}
    over = {b: sum(max(0, n - wish.get((b, a), 0)) for (a, t), n in wish.items() if t == b) for b in room}
    out = {}
    for (a, b), n in wish.items():
        back = wish.get((b, a), 0)
        extra = max(0, n - back)
        budget = min(n, back) + (min(1.0, room[b] / over[b]) * extra if over[b] else 0)
        full, edge, part = GAINS, -1, 0.0
        for g in sorted(by[a, b], reverse=True):
            if by[a, b][g] <= budget:
                budget -= by[a, b][g]
                full = g
            else:
                edge, part = g, budget / by[a, b][g]
                break
        out[a, b] = (full, edge, part)
    return out


def propagate(vertices: DataFrame, links: DataFrame, shards: int, quota: float, rounds: int = 8, least: float = 0.002) -> DataFrame:
    """id, size, shard of linked vertices; ``links``: src, dst, weight in both directions.

    Stops after ``rounds``, or when under ``least`` of the linked size was granted a move in two rounds running.
    """
    labels = written(vertices.select("id", "size", F.pmod(_hash(0, "id"), F.lit(shards)).cast("int").alias("shard")), "labels")
    quiet = 0
    for k in range(rounds):
        round_ = written(propose(labels, links, k), "round")
        sums = [tuple(r) for r in round_.groupBy("shard", "target", "bucket").agg(F.sum("size").alias("n")).collect()]
        load = [sum(r[3] for r in sums if r[0] == a) for a in range(shards)]
        asked = [r for r in sums if r[1] is not None]
        grants = grant(asked, load, quota)
        if grants:
            pair = F.col("shard") * shards + F.col("target")
            table = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for (a, b), g in grants.items() for x in (a * shards + b, g[i])]), pair)
            chance = _hash(2 + k, "id") / F.lit(float(1 << 31))
            go = (F.col("bucket") >= table(0)) | ((F.col("bucket") == table(1)) & (chance < table(2)))
            labels = round_.select("id", "size", F.when(go, F.col("target")).otherwise(F.col("shard")).alias("shard"))
        moved = sum(n if g >= grants[a, b][0] else n * grants[a, b][2] * (g == grants[a, b][1]) for a, b, g, n in asked)
        quiet = quiet + 1 if moved <= least * sum(load) else 0
        if quiet >= 2:
            break
    return labels


def fill(free: DataFrame, load: list[int], total: int) -> DataFrame:
    """id, size, shard of the vertices without links: runs of hash buckets bring every shard to its even part."""
    shards = len(load)
    need = [max(0.0, total / shards - n) for n in load]
    have = free.select("id", "size", F.pmod(_hash(20, "id"), F.lit(BUCKETS)).cast("int").alias("b1"), F.pmod(_hash(21, "id"), F.lit(BUCKETS)).cast("int").alias("b2"))
    sizes = dict(map(tuple, have.groupBy("b1").agg(F.sum("size")).collect()))   # BUCKETS rows at most
    scale = sum(sizes.values()) / (sum(need) or 1)
    ends, at = [], 0.0
    for n in need[:-1]:
        at += n * scale
        ends.append(at)
    cuts, done, b = [], 0, 0
    for e in ends:   # the bucket in which each shard becomes full, and what it still takes of it
        while b < BUCKETS and done + sizes.get(b, 0) <= e:
            done += sizes.get(b, 0)
            b += 1
        cuts.append((b, e - done))
    edge = sorted({b for b, _ in cuts if b < BUCKETS})
    inner: dict[int, dict[int, int]] = {}
    for b1, b2, n in have.where(F.col("b1").isin(edge)).groupBy("b1", "b2").agg(F.sum("size")).collect() if edge else []:
        inner.setdefault(b1, {})[b2] = n   # BUCKETS rows for each of the shards - 1 cuts at most
    places = []
    for b, rest in cuts:
        at, c = 0, 0
        while c < BUCKETS and b in inner and at + inner[b].get(c, 0) / 2 <= rest:
            at += inner[b].get(c, 0)
            c += 1
        places.append(b * BUCKETS + c)
    place = F.col("b1").cast("bigint") * BUCKETS + F.col("b2")
    shard = F.lit(0)
    for p in places:
        shard = shard + (place >= F.lit(p)).cast("int")
    return have.select("id", "size", shard.alias("shard"))


def slots(placed: DataFrame) -> DataFrame:
    """Number the rows of each shard from 0 without gaps: count per (shard, hash bucket), number inside buckets."""
    b = placed.withColumn("__b", F.pmod(_hash(30, "doc_id"), F.lit(SLOT_BUCKETS)).cast("int"))
    counts = b.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("shard", "__b").orderBy("doc_id", "text_crc32"))
    return b.withColumn("__k", inside).join(base, ["shard", "__b"]).withColumn("slot", F.col("__base") + F.col("__k") - 1).drop("__b", "__n", "__base", "__k")


def equal_text_links(docs: DataFrame) -> DataFrame:
    """src, dst, weight: every document with the smallest doc_id of its text, in both directions; no pairs inside groups.

    ``docs``: doc_id, key (equal for equal texts).
    """
    hub = docs.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    spokes = docs.join(hub, "key").where("doc_id <> hub")
    return spokes.select(F.explode(F.array(
        F.struct(F.col("doc_id").alias("src"), F.col("hub").alias("dst")), F.struct(F.col("hub").alias("src"), F.col("doc_id").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1).alias("weight"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 8) -> DataFrame:
    """doc_id, size (bytes of the text plus 1), text_crc32, shard, slot: sizes near equal, equal texts together where they fit."""
    raw = F.coalesce(F.encode(F.col("text"), "UTF-8"), F.lit(b""))
    light = written(identified(docs).select(
        "doc_id", (F.length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.length("text") > 0, F.sha2(F.col("text"), 256)).alias("key")), "sizes")
    one = light.groupBy(F.col("doc_id").alias("id")).agg(F.sum("size").alias("size"))
    links = written(equal_text_links(light.select("doc_id", "key").distinct()), "links")
    linked = links.select(F.col("src").alias("id")).distinct()
    total = light.agg(F.sum("size")).first()[0] or 0
    labels = propagate(one.join(linked, "id"), links, shards, QUOTA * total / shards, rounds)
    load = [0] * shards
    for r in labels.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        load[r["shard"]] = r["n"]
    rest = fill(one.join(linked, "id", "left_anti"), load, total)
    where = labels.unionByName(rest).select(F.col("id").alias("doc_id"), "shard")
    return slots(light.drop("key").join(where, "doc_id"))
