"""Components of items whose shingle sets are similar, from posting lists of candidate keys.

No list is expanded into all its pairs. First come rounds in which a member proposes itself to one leader: that of the
largest component in the longest list where it is not yet in that component. They settle most of a group of near copies
and make one pair a member at most. Then only members of lists that still hold several components are compared, in blocks
of bounded size: signatures name the members that have a candidate in another component (a pair is looked at in one of
the lists that hold both), the full sets of those members meet in the same block, and the block verifies exactly, joining
components as it goes, and returns a forest: one link fewer than it has members at most. Large lists first try the best
candidates of each member; lists with further candidates go through a last round that tries all that remain. After it
every pair of a common list that could pass has been verified or lies in one component already.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import released, written
from riskloom.llm.shingles import minhash, permutations

BITS = 1 << 23          # size of the filter that picks candidate rows before Python sees them
BLOCK = 2048            # members of a list that one task compares with as many others
BLOCK_HASHES = 1 << 22  # hashes of the members of a block, about
SMALL = 32              # members of a list whose pairs are looked at together with those of other lists
PAIRS = 1 << 16         # pairs looked at together
SIGNATURE = 128         # coordinates of the long signature
MATCHES = 82            # of them that a pair at similarity 0.8 reaches (but for four in a million)
BEST = 8                # candidates of a member that the first round of blocks tries
LEADER_ROUNDS = 2


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among ``ids`` (one column): a bitmap of fixed size, so it can be broadcast."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(BITS))
    name = ids.columns[0]
    bits = ids.select(at(name).alias("h")).groupBy(F.shiftright("h", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("__mask"))
    h = rows.withColumn("__h", at(key))
    hit = (F.shiftright("__h", 6) == F.col("__word")) & (F.expr("shiftright(__mask, cast(__h & 63 as int)) & 1") == 1)
    return h.join(F.broadcast(bits), hit).drop("__h", "__word", "__mask")


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if not len(p) or 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(p) + len(q) - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their sets (id, hashes)."""

    def run(batches):
        import pyarrow as pa

        for t in released(batches):
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True):
                ok.append(alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id it is connected with) of all ids in ``links`` (a, b).

    Large-star and small-star steps: each round hangs neighbours under the smallest one; the tables hold links only, and
    a round's result is written before the next.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "edges")
        # done when all are stars: an id hangs under one other, which hangs under none
        seen = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if seen.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break
    leaves = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return written(leaves.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")


def _signatures(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """id, n (set size), sig (16 bits a coordinate), keys (the item's lists)."""
    a, b = permutations(SIGNATURE)

    def run(batches):
        import pyarrow as pa

        for t in released(batches):
            h = [np.frombuffer(x, np.uint64) for x in t.column(1).to_pylist()]
            sig = [(minhash(x, a, b) & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for x in h]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([len(x) for x in h], pa.int64()), pa.array(sig, pa.binary())], names=["id", "n", "sig"])

    keys = lists.groupBy("id").agg(F.collect_set("key").alias("keys"))   # an item has one key a coordinate or band at most
    return sets.select("id", "hashes").mapInArrow(run, "id bigint, n bigint, sig binary").join(keys, "id")


def _with_components(lists: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return lists.withColumn("comp", F.col("id"))
    return lists.join(found.withColumnRenamed("component", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _proposals(lists: DataFrame, found: DataFrame | None, sets: DataFrame) -> DataFrame:
    """a, b: each member with the leader (most copies, then smallest id) of the largest component of one list."""
    here = _with_components(lists, found).join(sets.select("id", "weight"), "id")
    lead = F.min_by("id", F.struct(-F.col("weight"), F.col("id")))
    per = here.groupBy("key", "comp").agg(F.sum("weight").alias("w"), F.count("*").alias("c"), lead.alias("b"))
    main = per.groupBy("key").agg(F.max_by(F.struct("comp", "b"), F.struct("w", -F.col("comp"))).alias("m"), F.sum("c").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    apart = here.join(main.select("key", F.col("m.comp").alias("into"), F.col("m.b").alias("b"), "all"), "key").where("comp <> into")
    return apart.groupBy(F.col("id").alias("a")).agg(F.max_by("b", F.struct("all", -F.col("b"))).alias("b"))


def _blocks(lists: DataFrame, found: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members of lists that hold several components, dealt to blocks: key, kind, i, j, mine, is_main, id, comp, n, sig, keys.

    A list's largest component is never compared within itself; its other members (stragglers) are compared with each
    other (kind 0) and with it (kind 1).
    """
    here = _with_components(lists, found).join(sigs, "id")
    per = here.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    open_ = per.groupBy("key").agg(F.count("*").alias("comps"), F.max_by(F.struct("comp", "c", "h"), F.struct("c", "comp")).alias("main"), F.sum("c").alias("all"), F.sum("h").alias("hashes")).where("comps > 1")
    parts = lambda n, h: F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK)), F.ceil(h / F.lit(BLOCK_HASHES))).cast("int")
    at = here.join(open_, "key").withColumn("is_main", F.col("comp") == F.col("main.comp"))
    at = at.withColumn("bs", parts(F.col("all") - F.col("main.c"), F.col("hashes") - F.col("main.h"))).withColumn("bm", parts(F.col("main.c"), F.col("main.h")))
    at = at.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("bm")).otherwise(F.col("bs"))).cast("int"))
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    mains = upto("bs", lambda i: place(1, i, F.col("mine")))
    rest = F.concat(upto("bs", lambda j: place(0, F.least("mine", j), F.greatest("mine", j))), upto("bm", lambda j: place(1, F.col("mine"), j)))
    return at.select("key", F.explode(F.when(F.col("is_main"), mains).otherwise(rest)).alias("p"), "mine", "is_main", "id", "comp", "n", "sig", "keys").select("key", "p.*", "mine", "is_main", "id", "comp", "n", "sig", "keys")


WHERE = ["key", "kind", "i", "j"]


def _by_block(rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over Arrow tables that hold whole blocks, many at a time: rows are dealt by block and sorted, and the last
    block of a batch waits for the next one."""

    def held(batches):
        import pyarrow as pa

        rest = None
        for t in released(batches):
            t = pa.Table.from_batches([t])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            starts = _starts(t)
            rest, done = t.slice(int(starts[-1])), t.slice(0, int(starts[-1]))
            if done.num_rows:
                yield from run(done, starts[:-1]).to_batches()
        if rest is not None and rest.num_rows:
            yield from run(rest, np.zeros(1, np.int64)).to_batches()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *WHERE).sortWithinPartitions(*WHERE).mapInArrow(held, schema)


def _starts(t) -> np.ndarray:
    """Where a block's rows begin."""
    cols = [t.column(c).to_numpy() for c in WHERE]
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new)


def _pairs_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y), x < y, of all pairs inside small runs of rows."""
    first = np.repeat(starts, sizes)
    at = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)     # place inside the run
    x = first + at
    many = np.repeat(sizes, sizes) - 1 - at
    left = np.repeat(x, many)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)


def _flagged(blocks: DataFrame, best: int, percent: int) -> DataFrame:
    """The rows (key, kind, i, j, mine, is_main, id, comp) of members with a candidate in another component; ``more``
    marks a row of a block in which candidates were left for later (``best`` > 0 tries that many for each straggler)."""

    def run(t, starts):
        import pyarrow as pa

        n, comp, mine, main = (t.column(c).to_numpy() for c in ("n", "comp", "mine", "is_main"))
        i, kind, key = (t.column(c).to_numpy() for c in ("i", "kind", "key"))
        j = t.column("j").to_numpy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, SIGNATURE)
        owned = t.column("keys").combine_chunks()
        ends = owned.offsets.to_numpy()
        own = owned.flatten().to_numpy()
        keys = lambda r: frozenset(own[ends[r] - ends[0]: ends[r + 1] - ends[0]].tolist())
        flag, more = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool)
        sizes = np.diff(np.append(starts, t.num_rows))

        def mark(x: np.ndarray, y: np.ndarray, k) -> None:
            # of the lists that hold both, one compares them
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if not (flag[a] and flag[b]) and min(keys(a) & keys(b)) == k(a):
                    flag[a] = flag[b] = True

        small = np.flatnonzero(sizes <= SMALL)
        pairs = np.cumsum(sizes[small] * (sizes[small] - 1) // 2)
        for part in np.split(small, np.flatnonzero(np.diff(pairs // PAIRS)) + 1) if len(small) else []:
            x, y = _pairs_of(starts[part], sizes[part])
            ok = (comp[x] != comp[y]) & ~(main[x] & main[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            x, y = x[ok], y[ok]
            ok = (sig[x] == sig[y]).sum(axis=1) >= MATCHES
            mark(x[ok], y[ok], lambda a: key[a])
        for b in np.flatnonzero(sizes > SMALL).tolist():
            lo, hi = int(starts[b]), int(starts[b] + sizes[b])
            at = np.arange(lo, hi)
            rows = at[~main[lo:hi] & (mine[lo:hi] == i[lo])]
            cols = at[main[lo:hi] if kind[lo] else mine[lo:hi] == j[lo]]
            for r in rows.tolist():
                with_ = cols[cols > r] if not kind[lo] and i[lo] == j[lo] else cols
                with_ = with_[(comp[with_] != comp[r]) & (100 * np.minimum(n[with_], n[r]) >= percent * np.maximum(n[with_], n[r]))]
                if not len(with_):
                    continue
                same = (sig[with_] == sig[r]).sum(axis=1)
                keep = np.flatnonzero(same >= MATCHES)
                if best and len(keep) > best:
                    more[lo] = True
                    keep = keep[np.argsort(-same[keep], kind="stable")[:best]]
                o = with_[keep]
                mark(np.full(len(o), r), o, lambda a: key[a])
        flag |= more
        keep = pa.array(flag)
        return t.select(["key", "kind", "i", "j", "mine", "is_main", "id", "comp"]).append_column("more", pa.array(more)).filter(keep)

    return _by_block(blocks, run, "key bigint, kind int, i int, j int, mine int, is_main boolean, id bigint, comp bigint, more boolean")


def _forest(flagged: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of verified pairs that join the components met in each block: one fewer than its members at most."""

    def run(t, starts):
        import pyarrow as pa

        ids, comp, kind = (t.column(c).to_numpy() for c in ("id", "comp", "kind"))
        main, hashes = t.column("is_main").to_numpy(), t.column("hashes").to_pylist()
        a, b = [], []
        for lo, hi in zip(starts.tolist(), np.append(starts[1:], t.num_rows).tolist(), strict=True):
            for x, y in _joined(comp[lo:hi], main[lo:hi], [np.frombuffer(h, np.uint64) for h in hashes[lo:hi]], percent):
                a.append(ids[lo + x])
                b.append(ids[lo + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _by_block(flagged.drop("more").join(sets.select("id", "hashes"), "id"), run, "a bigint, b bigint")


def _joined(comp: np.ndarray, main: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs of places that join different components, each verified on full sets."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, ends = np.concatenate(sets), np.cumsum(n)
    words, place = np.unique(flat, return_inverse=True)
    of = comp.copy()                                   # component as joined so far
    seen = np.zeros(len(words), bool)
    out = []
    for r in np.flatnonzero(~main).tolist():
        others = np.flatnonzero((of != of[r]) & (main | (np.arange(len(n)) > r)) & (100 * np.minimum(n, n[r]) >= percent * np.maximum(n, n[r])))
        if not len(others):
            continue
        seen[place[ends[r] - n[r]: ends[r]]] = True
        cut = np.repeat(ends[others] - n[others], n[others]) + np.arange(n[others].sum()) - np.repeat(np.cumsum(n[others]) - n[others], n[others])
        both = np.add.reduceat(seen[place[cut]].astype(np.int64), np.cumsum(n[others]) - n[others])
        seen[place[ends[r] - n[r]: ends[r]]] = False
        for o in others[100 * both >= percent * (n[others] + n[r] - both)].tolist():
            if of[o] != of[r]:
                out.append((r, o))
                of[of == of[o]] = of[r]
    return out


def similar_components(lists: DataFrame, sets: DataFrame, percent: int = 80) -> DataFrame:
    """id and component of the items linked with another one.

    ``lists``: key, id (distinct); ``sets``: id, weight (copies it stands for), hashes (sorted 64-bit hashes as bytes, not empty).
    """
    found, links = None, None
    for _ in range(LEADER_ROUNDS):
        new = written(verified(_proposals(lists, found, sets), sets, percent), "links")
        if links is not None and new.isEmpty():
            break
        links = new if links is None else links.unionByName(new)
        found = components(links)
    sigs = written(_signatures(sets, lists), "signatures")
    todo = lists
    for best in (BEST, 0):
        tried = written(_flagged(_blocks(todo, found, sigs), best, percent), "flagged")
        new = written(_forest(tried, sets, percent), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)
        more = tried.where("more").select("key").distinct()
        if more.isEmpty():
            break
        todo = lists.join(more, "key")
    return found
