"""Hard negatives by Fagin's threshold algorithm over blocks of rows.

Rows are dealt to blocks of about ``BLOCK`` by a hash, anchors to groups of about ``ANCHORS``, and each block meets each
group in one task. A block keeps one list a dimension, sorted by component. For an anchor the lists are read side by
side, from the top where the anchor's component is positive and from the bottom where it is negative; every row met is
scored at once (random access, whole integers). No unread row can score above the sum of the anchor's components times
the values read last. Reading stops when that threshold is strictly below the k-th score of every window (or below the
window's lower end while it holds fewer), so ties are never cut. The first k of a window are among the first k of its
blocks; a ranked window over the anchor puts them together.

First the positives are found (window without ends, blocks of the anchor's label alone), then each positive's score opens
the window of its negatives, and the blocks are read once more for all windows of an anchor.

Defined cases: rows with a null id, label, vector or component, or a component that is not finite, take no part; of rows
that repeat an id the first by (label, vector) does; shorter vectors count as if zeros followed; a vector of zeros scores
0 with all; scores beyond 64 bits are held at the ends of that range; an anchor without another row of its label has no
rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90             # per cent of the positive's score
BLOCK, ANCHORS = 8192, 4096      # rows of a block, anchors of a group: what one task holds
STEP = 16                        # entries of each list read first; doubled after each look at the threshold
LONG = (1 << 63) - 1


def usable(rows: DataFrame, vec_id: Column, label: Column, vector: Column, anchor: Column) -> DataFrame:
    """id, label, x, anchor of the rows that take part, one an id."""
    picked = rows.select(vec_id.cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = picked.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    return whole.groupBy("id").agg(F.min(F.struct("label", "x", "anchor")).alias("r")).select("id", "r.*")


def matrix(column, width: int) -> np.ndarray:
    """Vectors as rows of whole numbers, zeros behind shorter ones."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out, at = np.zeros((len(sizes), width)), 0
    for k, n in enumerate(sizes):
        out[k, :n] = flat[at: at + n]
        at += n
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, as Python integers where sums of products leave the range in which doubles are exact."""
    most = lambda m: float(np.abs(m).max(initial=0))
    if max(1, a.shape[1]) * most(a) * most(b) < 2.0**53:
        return a, b
    whole = np.frompyfunc(int, 1, 1)
    return whole(a), whole(b)


class SortedLists:
    """Rows of a block, by id, with one list a dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[self.order], x[self.order]
        self.down = np.argsort(-self.x, axis=0, kind="stable").T          # dimension, place from the top
        self.values = np.take_along_axis(self.x.T, self.down, axis=1)

    def first(self, anchor: np.ndarray, allowed: np.ndarray, windows: list[tuple], k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (low, high): ids and scores of its first k allowed rows; and how many rows were scored."""
        n = len(self.ids)
        up, low = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        score = np.zeros(n, self.x.dtype)
        seen = np.zeros(n, bool) if len(up) + len(low) else np.ones(n, bool)
        open_ = [w for w in windows if w[0] <= w[1]]
        at, step = 0, STEP
        while at < n and open_ and len(up) + len(low):
            to = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.down[up, at:to].ravel()] = True
            met[self.down[low, n - to: n - at].ravel()] = True
            new = np.flatnonzero(met & ~seen)
            score[new] = self.x[new] @ anchor
            seen[new] = True
            threshold = (anchor[up] * self.values[up, to - 1]).sum() + (anchor[low] * self.values[low, n - to]).sum()
            at, step = to, 2 * step
            rising = np.sort(score[seen & allowed])
            if all(threshold < self._needed(rising, w, k) for w in open_):
                break
        found = []
        usable_ = seen & allowed
        for lo, hi in windows:
            at_ = np.flatnonzero(usable_ & (score >= lo) & (score <= hi))
            best = at_[np.argsort(-score[at_], kind="stable")[:k]]         # rows stand by id, so ties go to the smaller
            found.append((self.ids[best], score[best]))
        return found, int(seen.sum())

    @staticmethod
    def _needed(rising: np.ndarray, window: tuple, k: int):
        """The k-th score in the window, or its lower end."""
        end = np.searchsorted(rising, window[1], side="right")
        return rising[end - k] if end >= k and rising[end - k] >= window[0] else window[0]


def window_of(positive_score: int) -> tuple[int, int]:
    """Negative scores s with LEAST * positive <= 100 * s <= MOST * positive."""
    return -((-LEAST * positive_score) // 100), (MOST * positive_score) // 100


def _answers(rows, asked, k: int, same_label: bool):
    """One block against one group of anchors: anchor_id, positive_id, positive_score, other_id, score."""
    import pyarrow as pa

    out: list[list] = [[], [], [], [], []]
    if rows.num_rows and asked.num_rows:
        longest = lambda t: int(np.diff(t.column("x").combine_chunks().offsets.to_numpy()).max(initial=0))
        width = max(longest(rows), longest(asked))
        x, a = exact(matrix(rows.column("x"), width), matrix(asked.column("x"), width))
        block = SortedLists(rows.column("id").to_numpy(), x)
        labels = rows.column("label").to_numpy()[block.order]
        for v, anchor, label, opened in zip(a, asked.column("id").to_pylist(), asked.column("label").to_pylist(), asked.column("opened").to_pylist(), strict=True):
            allowed = block.ids != anchor if same_label else labels != label
            windows = [(-math.inf, math.inf)] if same_label else [window_of(p["score"]) for p in opened]
            found, _ = block.first(v, allowed, windows, k)
            for p, (ids, scores) in zip(opened if opened else [{"id": None, "score": None}], found, strict=True):
                out[0] += [anchor] * len(ids)
                out[1] += [p["id"]] * len(ids)
                out[2] += [p["score"]] * len(ids)
                out[3] += ids.tolist()
                out[4] += [max(-LONG, min(LONG, int(s))) for s in scores]
    names = ["anchor_id", "positive_id", "positive_score", "other_id", "score"]
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, out, strict=True)})


ANSWER = "anchor_id bigint, positive_id bigint, positive_score bigint, other_id bigint, score bigint"


def _asked(rows: DataFrame, anchors: DataFrame, keys: list[str], sizes: tuple[int, int], k: int) -> DataFrame:
    """Each block with each group of anchors. ``keys``: what else a block holds one value of."""
    blocks, groups = sizes
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    cells = rows.select("id", "label", "x", of(blocks, 1).alias("block"), every(groups).alias("grp"))
    # by new names, then back: both sides come from one table
    asked = anchors.toDF("__id", "__label", "__x", "__opened").toDF("id", "label", "x", "opened").select("id", "label", "x", "opened", of(groups, 2).alias("grp"), every(blocks).alias("block"))
    key = [*keys, "block", "grp"]
    return cells.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(lambda left, right: _answers(left, right, k, bool(keys)), ANSWER)


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` as ``usable`` gives them."""
    rows = written(rows, "vectors")
    n, asking = rows.agg(F.count("*"), F.count_if("anchor")).first()
    sizes = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asking / ANCHORS))
    opened = "array<struct<id:bigint,score:bigint>>"
    anchors = rows.where("anchor").select("id", "label", "x")
    near = _asked(rows, anchors.withColumn("opened", F.lit(None).cast(opened)), ["label"], sizes, positives)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    near = written(near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives), "positives")
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("opened"))   # five at most
    far = _asked(rows, anchors.join(windows, F.col("id") == F.col("anchor_id")).select("id", "label", "x", "opened"), [], sizes, negatives)
    first = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "other_id")
    ranked = far.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
