import numpy as np
import pytest

from riskloom.llm import pu, queries

SF = "/root/testdata/sf0.01"


def two_kinds(n_pos, n_mixed, prior, seed=1, apart=1.2):
    r = np.random.default_rng(seed)
    draw = lambda n, at: np.abs(r.normal(at, 0.5, (n, pu.WIDTH))).astype(np.float32) * np.where(np.arange(pu.WIDTH) < 20, 1, 0.05).astype(np.float32)
    k = int(prior * n_mixed)
    return draw(n_pos, 0.3), np.concatenate([draw(k, 0.3), draw(n_mixed - k, apart)]), k


def test_prior_and_boundary_without_negatives():
    for prior in (0.85, 0.5, 0.25):
        p, u, k = two_kinds(800, 2400, prior)
        m = pu.fit_arrays(p, u)
        assert abs(m.prior - prior) < 0.1
        said = m.margin(u) > 0
        assert (said[:k].mean() + (~said[k:]).mean()) / 2 > 0.95


def test_slopes_are_those_of_the_risk():
    """Numeric derivative of the estimator on both of its sides."""
    def risk(zp, zu, prior):
        loss = lambda z: 1 / (1 + np.exp(z))
        negative = loss(-zu).mean() - prior * loss(-zp).mean()
        return prior * loss(zp).mean() + negative if negative >= 0 else -negative, negative >= 0

    r = np.random.default_rng(2)
    for prior, shift in ((0.3, 0.0), (0.95, -3.0)):
        zp, zu = r.normal(1, 1, 7), r.normal(shift, 1, 9)
        dp, du = pu.non_negative_slopes(prior)(zp, zu)
        value, side = risk(zp, zu, prior)
        assert side == (prior == 0.3)
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            assert (risk(zp + e, zu, prior)[0] - value) / 1e-6 == pytest.approx(dp[k], abs=1e-5)
        for k in range(9):
            e = np.eye(9)[k] * 1e-6
            assert (risk(zp, zu + e, prior)[0] - value) / 1e-6 == pytest.approx(du[k], abs=1e-5)


def test_held_out_accuracy_and_whole_result(spark):
    got = {r.doc_id: r for r in queries.op13_positive_unlabelled(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    marks = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    held = [(q, r) for q, r in marks if r.held_out]
    right = {k: np.mean([r.predicted == k for q, r in held if q == k]) for k in (0, 1)}
    assert min(right.values()) >= 0.9 and all(0 <= r.score <= 1 for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "word " * 40_000, 1), (4, "\U0001f600 é", 1), (4, "\U0001f600 é", 1), (None, "x", 1)], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert pu.fit(docs, labels) is None                     # no trusted positive
    said = pu.score(docs, None).collect()
    assert sorted(r.doc_id for r in said) == [1, 2, 3, 4, 4] and {r.score for r in said} == {0.5}
    rng = np.random.default_rng(1)
    model = pu.Scorer.new(rng)
    assert np.allclose(pu.Scorer.unpack(model.pack()).w, model.w)
    scored = {r.doc_id: r.score for r in pu.score(docs, model).collect()}
    assert scored[1] == scored[2] and all(0 <= s <= 1 for s in scored.values())
    assert pu.score(docs.limit(0), model).collect() == []


def test_sample_leaves_the_held_out_third(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    sample = pu.samples(docs, labels, positives=50, unlabelled=100).groupBy("trusted").count().collect()
    assert {r["trusted"]: r["count"] for r in sample}[True] < 90 and {r["trusted"]: r["count"] for r in sample}[False] < 160
    texts = docs.where(~pu.held_out(docs.doc_id)).count()
    assert pu.samples(docs, labels, positives=10**9, unlabelled=10**9).where("NOT trusted").count() == texts
