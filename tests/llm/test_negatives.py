import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import negatives, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor_id int, score string"


def table(seed, n, dims, values):
    r = random.Random(seed)
    rows = [(k, [float(r.choice(values)) for _ in range(dims)], r.choice([0, 0, 0, 1, 2]), 5, "x") for k in range(n)]
    rows += [(n, None, 1, 5, "x"), (n + 1, [1.0, None], 0, 5, "x"), (n + 2, [float("nan")] * dims, 0, 5, "x"), (n + 3, [float("inf")] + [0.0] * (dims - 1), 0, 5, "x"), (n + 4, [1.0] * dims, None, 5, "x"),
             (None, [1.0] * dims, 0, 5, "x"), (n + 5, [0.0] * dims, 0, 5, "x"), (n + 6, [0.5], 1, 5, "x"), (n + 7, [], 0, 5, "x"), rows[3]]
    return rows


def brute(rows, every):
    ok = {r[0]: (r[2], [math.floor(256 * x) for x in r[1]]) for r in rows
          if None not in (r[0], r[1], r[2]) and all(x is not None and math.isfinite(x) for x in r[1])}
    out = []
    for a, (label, v) in ok.items():
        if a % every:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w)), b) for b, (_, w) in ok.items() if b != a))
        for s, p in [(-s, b) for s, b in scores if ok[b][0] == label][:5]:
            fit = [(b, -t) for t, b in scores if ok[b][0] != label and 30 * s <= -100 * t <= 90 * s][:10]
            out += [(a, p, k + 1, b, s, t) for k, (b, t) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every):
    e = spark.createDataFrame(rows, SCHEMA).repartition(3)
    u = negatives.usable(e, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in negatives.hard_negatives(u).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)       # several blocks and groups
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    for seed, dims, values in ((1, 6, [-1, -0.5, 0, 0.25, 0.5, 1, 2]), (2, 3, [0, 1]), (3, 1, [-1, 0, 1])):
        rows = table(seed, 160, dims, values)
        want = brute(rows, 7)
        assert want and mined(spark, rows, 7) == want


def test_huge_components_and_no_rows(spark):
    rows = [(k, [1e30 * (k + 1), -3e37, 1e20], k % 2, 5, "x") for k in range(8)]
    assert {r[:4] for r in mined(spark, rows, 4)} == {r[:4] for r in brute(rows, 4)}
    assert mined(spark, [], 4) == []


def test_reading_stops_early():
    """Clustered vectors: the lists are not read to the end, and nothing of the first k is missing."""
    r = np.random.default_rng(5)
    x = np.floor(256 * r.exponential(0.2, (4000, 4)))
    block = negatives.SortedLists(np.arange(4000), x)
    for a in x[:20]:
        (found,), read = block.first(a, np.ones(4000, bool), [(-math.inf, math.inf)], 5)
        s = x @ a
        assert found[0].tolist() == np.lexsort((np.arange(4000), -s))[:5].tolist() and read < 2000


def test_query_labels_and_anchors(spark):
    rows = queries.op11_threshold_negatives(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.anchor_id % 100 == 0 for r in rows)
