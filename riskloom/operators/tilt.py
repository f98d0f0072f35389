"""Index tilt: benchmark weights, shrunk scores, constrained targets, rebalance path, naive comparator."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.dims.finance import STRICT_TILT, TiltConfig
from riskloom.functions.rounds import block_fold
from riskloom.functions.scan import Carry, prefix_scan
from riskloom.operators.index import tilt_indices
from riskloom.session import cut, in_tasks, kept


def capped_weights(caps: DataFrame, group: Sequence[str], name: str = "ticker", cap: float = 0.15, value: str = "cap") -> DataFrame:
    """Capped cap-weights by water filling: sort, cap the largest, spread the rest pro rata.

    The k largest sit at the cap for the smallest k whose remaining names fit under it.
    """
    g = list(group)
    total = Window.partitionBy(*g)
    down = Window.partitionBy(*g).orderBy(F.desc("v"), name)
    rest = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = caps.withColumn("v", F.greatest(F.col(value).cast("double"), F.lit(0.0)))
    w = w.withColumn("v", F.col("v") / F.greatest(F.sum("v").over(total), F.lit(1e-300)))
    w = w.withColumn("i", F.row_number().over(down) - 1).withColumn("tail", F.sum("v").over(rest))
    scale = (1.0 - F.col("i") * cap) / F.when(F.col("tail") > 0, F.col("tail"))
    w = w.withColumn("fits", (F.col("i") * cap < 1.0) & (scale * F.col("v") <= cap + 1e-12)).withColumn("scale", scale)
    best = F.min(F.when(F.col("fits"), F.struct("i", "scale"))).over(total)
    w = w.withColumn("best", best)
    return w.withColumn("bench", F.when(F.col("best").isNull() | (F.col("i") < F.col("best.i")), F.lit(cap)).otherwise(
        F.col("best.scale") * F.col("v"))).drop("v", "i", "tail", "fits", "scale", "best")


def shrunk_z(values: DataFrame, group: Sequence[str], k: float = 2.0, value: str = "index_value", count: str = "stories") -> DataFrame:
    """(x - mean) / max(sample sd, .05) x n / (n + k) across the names of a group."""
    w = Window.partitionBy(*group)
    x, n = F.col(value), F.col(count)
    sd = F.greatest(F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(0.05))
    return values.withColumn("z", (x - F.avg(x).over(w)) / sd * n / (n + F.lit(k)))


MEMBER = ["ticker", "bench", "vol", "sector", "group"]


BLOCK_UPDATES, CELLS = 2_048, 400_000   # updates of a block on average; numbers (updates x members) solved at once


def panel(updates: DataFrame, values: DataFrame, breakers: DataFrame, members: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Ordered rows from which every (setting, index, update) reads all members of its index as of then.

    A member's index does not move between its own updates (all its stories decay alike), so the panel is a last value per
    member. It is not written out: sequence numbers are cut into blocks, a block of an index begins with one row per member
    (its state before the block, phase 0), then come the changes and the updates of the block in order. Members are a
    table: index_name, ticker, bench, vol, sector, group.
    """
    asked = cut(updates.groupBy("index_name", "seq", "as_of", "forced").agg(F.count("*").cast("int").alias("k")))
    lo, hi, n = asked.agg(F.min("seq"), F.max("seq"), F.count("seq")).first()
    lo, width = (lo, max(1, -(-(hi - lo + 1) * BLOCK_UPDATES // n))) if n else (0, 1)
    last = (hi - lo) // width if n else -1
    block = F.coalesce(F.greatest(F.lit(-1).cast("bigint"), F.least(F.lit(last + 1).cast("bigint"), F.floor((F.col("seq") - lo) / width))), F.lit(-1).cast("bigint"))
    asked = asked.withColumn("block", block)
    v = kept(values.select("setting", "ticker", "seq", F.coalesce("index_value", F.lit(0.0)).alias("x"), F.coalesce("stories", F.lit(0)).cast("double").alias("n")).withColumn("block", block))
    r = kept(breakers.select("ticker", "seq", F.coalesce("breaker", F.lit(False)).alias("b")).withColumn("block", block))

    def before(facts: DataFrame, keys: list[str], take: list[str]) -> DataFrame:
        """The last fact of a block holds in the blocks after it, up to the next block with a fact."""
        ends = facts.groupBy(*keys, "block").agg(F.max_by(F.struct(*take), F.struct("seq")).alias("_s"))
        nxt = F.coalesce(F.lead("block").over(Window.partitionBy(*keys).orderBy("block")), F.lit(last).cast("bigint"))
        spans = ends.withColumn("_to", nxt).filter(F.col("_to") > F.col("block"))
        return spans.select(*keys, F.explode(F.sequence(F.col("block") + 1, F.col("_to"))).alias("block"), *[F.col(f"_s.{c}").alias(c) for c in take])

    some = F.explode(F.array(*[F.lit(x) for x in settings])).alias("setting")
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    cell, held = ["setting", "index_name", "block"], members.select("index_name", "ticker").distinct()
    rows = [asked.select("index_name", "block", "seq", "as_of", "forced", "k", some).select(*cell, F.lit(2).alias("phase"), "seq", F.lit(1).alias("kind"), "as_of", "forced", "k")]
    heads = asked.select("index_name", "block").distinct().select("*", some).join(members.select("index_name", *MEMBER), "index_name")
    heads = heads.join(before(v, ["setting", "ticker"], ["x", "n"]), ["setting", "ticker", "block"], "left").join(before(r, ["ticker"], ["b"]), ["ticker", "block"], "left")
    rows.append(heads.select(*cell, F.lit(0).alias("phase"), *MEMBER, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("n", F.lit(0.0)).alias("n"), F.coalesce("b", F.lit(False)).alias("b")))
    rows.append(v.join(held, "ticker").select(*cell, F.lit(2).alias("phase"), "seq", F.lit(0).alias("kind"), "ticker", "x", "n"))
    rows.append(r.join(held, "ticker").select("*", some).select(*cell, F.lit(2).alias("phase"), "seq", F.lit(0).alias("kind"), "ticker", "b"))
    both = reduce(lambda one, two: one.unionByName(two, allowMissingColumns=True), rows)
    return in_tasks(both, cell).sortWithinPartitions(*cell, "phase", "seq", "kind", *MEMBER)


def _project_rows(raw: np.ndarray, breaker: np.ndarray, bench: np.ndarray, sectors: list[np.ndarray], groups: np.ndarray,
                  cfg: TiltConfig) -> np.ndarray:
    """Name, active and sector caps with full investment, for a whole batch of rows at once."""
    floor = np.maximum(0.0, bench - cfg.active_cap)
    lo = np.repeat(floor[None, :], len(raw), 0)
    hi = np.repeat(np.minimum(cfg.name_cap, bench + cfg.active_cap)[None, :], len(raw), 0)
    # peers of a name under the breaker may not rise above benchmark
    named = groups != ""
    peers = ((groups[None, :] == groups[:, None]) & named[None, :] & named[:, None]).astype(float)
    held = (breaker.astype(float) @ peers > 0) & ~breaker
    hi = np.where(held, np.minimum(hi, bench), hi)
    lo = np.where(held, np.minimum(lo, hi), lo)
    hi = np.where(breaker, floor, hi)
    lo = np.where(breaker, floor, lo)
    w = raw.copy()
    open_rows = np.ones(len(w), bool)
    for _ in range(50):
        idx = np.flatnonzero(open_rows)
        if not len(idx):
            break
        v = np.minimum(hi[idx], np.maximum(lo[idx], w[idx]))
        for cols in sectors:
            active = (v[:, cols] - bench[cols]).sum(1)
            over = np.abs(active) > cfg.sector_active_cap + 1e-12
            scale = np.where(over, cfg.sector_active_cap / np.where(over, np.abs(active), 1.0), 1.0)
            pulled = bench[cols] + (v[:, cols] - bench[cols]) * scale[:, None]
            v[:, cols] = np.where(breaker[idx][:, cols], v[:, cols], pulled)
        resid = 1.0 - v.sum(1)
        room = np.where(resid[:, None] > 0, hi[idx] - v, v - lo[idx])
        room = np.where(breaker[idx], 0.0, np.maximum(0.0, room))
        total = room.sum(1)
        more = (np.abs(resid) >= 1e-10) & (total > 1e-12)
        v = np.where(more[:, None], v + resid[:, None] * room / np.where(total > 0, total, 1.0)[:, None], v)
        w[idx] = v
        open_rows[idx] = more
    return w


TARGETS = ("config string, index_name string, seq bigint, as_of timestamp, forced boolean, band double, cost_bps double, tickers array<string>, bench array<double>, z array<double>, "
           "raw array<double>, target array<double>, alpha array<double>, b array<boolean>")


def targets(rows: DataFrame, configs: Sequence[TiltConfig]) -> DataFrame:
    """Panel rows -> target weights under every configuration: z, exponential tilt scaled by inverse volatility, projection.

    The rows of a block are read in order, a bounded number of updates at a time: the last values of the members are filled
    down a matrix of updates and members, whose rows are small problems solved together.
    """
    by_setting: dict[str, list[TiltConfig]] = {}
    for c in configs:
        by_setting.setdefault(setting_of(c), []).append(c)
    project, cells = _project_rows, CELLS

    def solved(setting, index, head, part, x, n, b):
        """``part``: the update rows of these matrices, all given equally often."""
        times = part["k"][0]
        if times > 1:   # an update given twice holds every member twice
            x, n, b = (np.repeat(a, times, 1) for a in (x, n, b))
        names, sector = (np.repeat(np.array(head[c], object), times) for c in ("ticker", "sector"))
        group = np.repeat(np.array(head["group"], str), times)
        bench, vol = (np.repeat(np.array(head[c], float), times) for c in ("bench", "vol"))
        u, m = x.shape
        lists = lambda flat, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, u * m + 1, m), pa.int32()), pa.array(flat, kind))
        numbers = lambda a: lists(np.ascontiguousarray(a, float).ravel(), pa.float64())
        tickers, benches = pa.ListArray.from_arrays(pa.array(np.arange(0, u * m + 1, m), pa.int32()), pa.array(names.tolist(), pa.string()).take(pa.array(np.tile(np.arange(m), u)))), numbers(np.tile(bench, (u, 1)))
        for cfg in by_setting[setting]:
            sd = np.maximum(x.std(1, ddof=1) if m > 1 else np.zeros(u), 0.05)
            z = (x - x.mean(1)[:, None]) / sd[:, None] * n / (n + cfg.shrink_k)
            raw = bench * np.exp(cfg.kappa * z * vol.mean() / np.maximum(vol, 1e-6))
            raw = raw / raw.sum(1)[:, None]
            w = project(raw, b, bench, [np.flatnonzero(sector == s) for s in sorted(set(sector))], group, cfg)
            same = lambda v, kind: pa.array([v] * u, kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([
                same(cfg.name, pa.string()), same(index, pa.string()), part["seq"], part["as_of"], part["forced"], same(float(cfg.band), pa.float64()), same(float(cfg.cost_bps), pa.float64()),
                tickers, benches, numbers(z), numbers(raw), numbers(w), numbers(cfg.ic * vol * z), lists(b.ravel(), pa.bool_())],
                ["config", "index_name", "seq", "as_of", "forced", "band", "cost_bps", "tickers", "bench", "z", "raw", "target", "alpha", "b"])

    def filled(changed, at, new, u, start):
        """Last new value per member and update, else the one it starts with; and the ones after the last update."""
        where = np.full((u + 1, len(start)), -1)
        for i, places in enumerate(changed):
            where[at[i], places] = i
        where = np.maximum.accumulate(where, 0)
        if not len(new):
            return np.repeat(start[None, :], u, 0), start
        out = np.where(where >= 0, new[where], start[None, :])
        return out[:u], out[u]

    def run(batches):
        current = head = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("setting", "index_name", "block"))))
            phase = batch.column("phase").to_pylist()
            i = 0
            while i < len(keys):
                if keys[i] != current:
                    current, head = keys[i], {c: [] for c in [*MEMBER, "x", "n", "b"]}
                j, updates = i, 0
                while j < len(keys) and keys[j] == current and phase[j] == phase[i]:
                    j += 1
                    if phase[i]:
                        updates += 1
                        if updates * len(head["ticker"]) > cells:
                            break
                part, i = batch.slice(i, j - i), j
                if not phase[j - 1]:
                    for c in head:
                        head[c] += part.column(c).to_pylist()
                    places = None
                    continue
                if places is None:
                    places = {}
                    for p, t in enumerate(head["ticker"]):
                        places.setdefault(t, []).append(p)
                    state = {c: np.array(head[c], kind) for c, kind in (("x", float), ("n", float), ("b", bool))}
                kind = np.array(part.column("kind").to_pylist())
                ask = np.flatnonzero(kind == 1)
                done, grids = np.cumsum(kind == 1), {}
                for c in ("x", "n", "b"):
                    col = part.column(c)
                    new = np.flatnonzero(np.array(col.is_valid()) & (kind == 0))
                    names = part.column("ticker").take(pa.array(new)).to_pylist()
                    grids[c], state[c] = filled([places[t] for t in names], done[new], np.array(col.take(pa.array(new)).to_pylist(), state[c].dtype), len(ask), state[c])
                k = np.array(part.column("k").take(pa.array(ask)).to_pylist(), int)
                for times in sorted(set(k.tolist())):
                    sel = np.flatnonzero(k == times)
                    rows_of = part.take(pa.array(ask[sel]))
                    yield from solved(current[0], current[1], head, {"k": [times], **{c: rows_of.column(c) for c in ("seq", "as_of", "forced")}}, *(np.ascontiguousarray(grids[c][sel]) for c in ("x", "n", "b")))

    return rows.mapInArrow(run, TARGETS)


def setting_of(c: TiltConfig) -> str:
    """Names what the signal side of a configuration depends on."""
    return f"{c.half_life_hours}|{c.min_novelty}|{c.min_abs_sentiment}|{c.min_relevance}"


def tilt_targets(events: DataFrame, decisions: DataFrame | None, members: DataFrame, configs: Sequence[TiltConfig], split: bool | None = None) -> DataFrame:
    """Events of index members -> target weights of every index at each of its updates (breakers from gate decisions).

    All indices and configurations are one job: signal settings and configurations are exploded from a short list, indices
    come from the members table.
    """
    from riskloom.operators.gate import breaker_state

    names, held = members.select("ticker").distinct(), members.select("index_name", "ticker")
    own = events.join(names, "ticker", "left_semi")
    settings = {setting_of(c): c for c in configs}
    table = F.array(*[F.struct(F.lit(k).alias("setting"), F.lit(float(c.half_life_hours)).alias("half_life_h"), F.lit(c.min_novelty).alias("min_novelty"),
                               F.lit(float(c.min_abs_sentiment)).alias("threshold"), F.lit(c.min_relevance).alias("min_relevance")) for k, c in settings.items()])
    values = tilt_indices(own, table, split=split)
    updates = own.join(held, "ticker").select("index_name", "seq", "as_of", F.lit(False).alias("forced"))
    if decisions is None:
        breakers = own.select("ticker", "seq", F.lit(False).alias("breaker")).limit(0)
    else:
        state = breaker_state(decisions.join(names, "ticker", "left_semi"), "ticker", split=split)
        prev = prefix_scan(state, ["ticker"], ["seq"], F.floor(F.col("seq") / 1_000_000), [
            Carry("_was", "last", F.col("breaker"), inclusive=False)], split)
        breakers = state.select("ticker", "seq", "breaker")
        flips = prev.filter(F.coalesce("_was", F.lit(False)) != F.col("breaker")).join(held, "ticker").select("index_name", "seq", F.lit(True).alias("_flip")).distinct()
        updates = updates.join(flips, ["index_name", "seq"], "left").select("index_name", "seq", "as_of", F.col("_flip").isNotNull().alias("forced"))
    return targets(panel(updates, values, breakers, members, list(settings)), configs)


PATH = ("config string, index_name string, block bigint, seq bigint, as_of timestamp, tickers array<string>, bench array<double>, prev array<double>, weights array<double>, "
        "raw array<double>, turnover double, cost_bps double")


def band_rows(solved: DataFrame) -> DataFrame:
    """What the no-trade band reads of the targets."""
    return solved.select("config", "index_name", "seq", "as_of", "forced", "band", "cost_bps", "tickers", "bench", "target", "raw")


def rebalance_path(solved: DataFrame, block_hours: int = 24) -> DataFrame:
    """No-trade band over the targets in order: adopt when the change exceeds the band or is forced.

    Path dependent, so it is a block fold per (config, index): days are folded in parallel and re-folded where the
    weights they start from turn out different.
    """
    rows = solved.select("config", "index_name", F.floor(F.unix_seconds("as_of") / (block_hours * 3600)).alias("block"), "seq", "as_of", "forced", "band", F.col("cost_bps").alias("bps"),
                         "tickers", "bench", "target", "raw")
    return block_fold(rows, ["config", "index_name"], "block", _fold_band, PATH, "null").drop("block")


def _fold_band(state: str, pdf: pd.DataFrame) -> tuple[pd.DataFrame, str]:
    """``state``: the weights held, or null for the benchmark itself."""
    import json as js

    import numpy as np_
    import pandas as pd_

    rows = pdf.sort_values("seq")
    held = js.loads(state)
    current = np_.array(rows["bench"].iloc[0] if held is None else held, float)
    wide = len({len(t) for t in rows["target"]}) == 1
    goal = np_.array(rows["target"].tolist(), float) if wide else [np_.asarray(t, float) for t in rows["target"]]
    band, forced, i, step, out = rows["band"].to_numpy(float), rows["forced"].to_numpy(bool), 0, 16, []
    while i < len(rows):
        # the next row that is adopted, looked for in growing pieces
        piece = slice(i, i + step)
        moved = np_.abs(goal[piece] - current).sum(1) if wide else np_.array([np_.abs(g - current).sum() for g in goal[piece]])
        hits = np_.flatnonzero(~(moved < band[piece]) | forced[piece])
        if not len(hits):
            i, step = i + step, min(step * 2, 4096)
            continue
        i, step, by = i + int(hits[0]), 16, float(moved[hits[0]])
        r = rows.iloc[i]
        out.append((r["config"], r["index_name"], r["block"], r["seq"], r["as_of"], list(r["tickers"]), list(r["bench"]), current.tolist(), goal[i].tolist(), list(r["raw"]), by, by * r["bps"]))
        current, i = goal[i], i + 1
    cols = ["config", "index_name", "block", "seq", "as_of", "tickers", "bench", "prev", "weights", "raw", "turnover", "cost_bps"]
    return pd_.DataFrame(out, columns=cols), js.dumps(current.tolist()) if out else state


def attribution(path: DataFrame) -> DataFrame:
    """Snapshot rows -> one row per name: benchmark, before, signal target, after, and the two causes."""
    one = path.select("config", "index_name", "seq", "as_of", F.explode(F.arrays_zip(
        F.col("tickers").alias("ticker"), F.col("bench"), F.col("prev"), F.col("raw").alias("signal_target"), F.col("weights").alias("final"))).alias("a"))
    a = one.select("config", "index_name", "seq", "as_of", "a.*")
    return a.select("*", (F.col("signal_target") - F.col("bench")).alias("from_signal"),
                    (F.col("final") - F.col("signal_target")).alias("from_constraints"), (F.col("final") - F.col("prev")).alias("change"))


def sweep(events: DataFrame, decisions: DataFrame | None, members: DataFrame, grid: Sequence[TiltConfig], split: bool | None = None) -> DataFrame:
    """Rebalance paths of every index under every configuration of a grid, as one job."""
    return rebalance_path(tilt_targets(events, decisions, members, grid, split))


def grid_of(kappas: Sequence[float], half_lives: Sequence[float], strict: Sequence[bool] = (False, True)) -> list[TiltConfig]:
    """Every combination of aggressiveness, half-life and filters."""
    return [replace(STRICT_TILT if s else TiltConfig(), name=f"k{k:g}-h{h:g}-{'strict' if s else 'base'}", kappa=k, half_life_hours=h) for k in kappas for h in half_lives for s in strict]


def naive_turnover(documents: DataFrame, bench: DataFrame, split: bool | None = None) -> DataFrame:
    """Naive comparator: latest document sentiment, w = bench x max(0, 1 + s), renormalised.

    One name changes per document, so the turnover needs only that name's old and new raw weight
    and the running total of all of them.
    """
    bucket = F.floor(F.col("seq") / 1_000_000)
    d = documents.join(bench.select("ticker", "bench"), "ticker")
    prev = prefix_scan(d, ["ticker"], ["seq"], bucket, [Carry("_s", "last", F.col("sentiment"), inclusive=False)], split)
    new = F.col("bench") * F.greatest(F.lit(0.0), 1.0 + F.col("sentiment"))
    old = F.col("bench") * F.greatest(F.lit(0.0), 1.0 + F.coalesce("_s", F.lit(0.0)))
    moved = prev.withColumn("_new", new).withColumn("_old", old).withColumn("_all", F.lit(1))
    total = prefix_scan(moved, ["_all"], ["seq"], bucket, [Carry("_run", "sum", F.col("_new") - F.col("_old"))], split)
    t1 = 1.0 + F.col("_run")
    t0 = t1 - F.col("_new") + F.col("_old")
    others = (t0 - F.col("_old")) * F.abs(1.0 / t1 - 1.0 / t0)
    return total.select("seq", "as_of", "ticker", (F.col("_new") / t1).alias("weight"),
                        (others + F.abs(F.col("_new") / t1 - F.col("_old") / t0)).alias("turnover"))


def full_turnover(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turnover between two weight tables; a missing name counts as zero."""
    a = old.select(*keys, F.col("weight").alias("w0"))
    b = new.select(*keys, F.col("weight").alias("w1"))
    return a.join(b, list(keys), "full").select(
        *keys, F.coalesce("w0", F.lit(0.0)).alias("w0"), F.coalesce("w1", F.lit(0.0)).alias("w1")).withColumn(
            "turnover", F.abs(F.col("w1") - F.col("w0")))
