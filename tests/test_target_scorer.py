"""The trained scorer inside the mention stage, and the training report."""

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom import corpus
from riskloom.operators import mentions, train
from riskloom.plans import text_queries as tq
from riskloom.session import cut

SF = "/root/testdata/sf0.001"


def test_scores_in_the_stage_equal_predict(spark):
    """Every window of the stage as a row of its own, scored by the table model."""
    rows = tq.trained_mentions(spark, SF)
    model = tq.target_model(spark, SF)
    docs = mentions.with_text(tq.feed(spark, SF)).select("doc_id", "text")
    others = rows.alias("a").join(rows.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.entity_id") != F.col("b.entity_id"))).groupBy("a.doc_id", "a.entity_id").agg(
        F.flatten(F.collect_list("b.spans")).alias("others"))
    one = rows.select("doc_id", "entity_id", "windows", "spans", "probs").join(docs, "doc_id").join(others, ["doc_id", "entity_id"], "left")
    one = one.withColumn("others", F.coalesce("others", F.expr("slice(spans, 1, 0)")))
    items = one.withColumn("i", F.explode(mentions.window_items(F.col("text"), F.col("windows"), F.col("spans"), F.col("others"))))
    flat = cut(items.select("doc_id", "entity_id", "probs", F.monotonically_increasing_id().cast("string").alias("row_id"), "i.text", "i.target", "i.others"))
    got = train.predict(train.with_features(flat, tq.DIMS), model).groupBy("doc_id", "entity_id").agg(
        *[F.max(F.abs(F.lit(0.0))).alias("z")], F.avg("p_negative").alias("n"), F.avg("p_neutral").alias("u"), F.avg("p_positive").alias("p"), F.first("probs").alias("q")).collect()
    assert len(got) == rows.count() > 50
    for r in got:
        assert (r.q.neg, r.q.neu, r.q.pos) == pytest.approx((r.n, r.u, r.p), abs=1e-9)
    assert len({round(r.q.pos, 3) for r in got}) > 10


def test_vectors_come_from_the_jvm_and_equal_the_weights(spark):
    pairs = tq.target_pairs(spark, SF).limit(40)
    rows = train.with_features(pairs, tq.DIMS).cache()
    vocab = train.vocabulary(rows).cache()
    size = vocab.count()
    cells = {}
    for r in train.term_weights(rows, vocab).collect():
        cells.setdefault(r.row_id, []).append((r.idx, r.w))
    made = train.training_vectors(rows, vocab, size)
    assert "Python" not in made._jdf.queryExecution().toString()
    for r in made.collect():
        lex = [(size, r.lex_neg), (size + 1, r.lex_pos), (size + 2, r.lex_bal)]
        assert isinstance(r.x, SparseVector) and r.x == SparseVector(size + 3, sorted(cells.get(r.row_id, [])) + lex)


def test_unknown_and_missing_words(spark):
    w = train.Weights(["up", "down"], train.np.array([1.0, 2.0]), train.np.array([[1.0, -1.0], [-1.0, 1.0]]), train.np.zeros((2, 3)), train.np.zeros(2), ("positive", "negative"))
    import pyarrow as pa

    p = train.probabilities(w, pa.array([["up", "x"], [], ["down", "down", "up"], None], pa.list_(pa.string())), train.np.zeros((4, 3)))
    assert p[:, 1].tolist() == [0.0] * 4 and p[1].tolist() == p[3].tolist() == [0.5, 0.0, 0.5]
    assert p[0, 2] > 0.8 and p[2, 0] > 0.5


def test_report_has_four_systems(spark):
    q = entry.queries()
    pairs = tq.target_pairs(spark, SF)
    r = train.report(pairs.filter("fold <> 0"), pairs.filter("fold = 0"), tq.DIMS, 8.0).collect()
    assert {x.system for x in r} == {"lexicon_whole", "lexicon_window", "trained_unmasked", "trained_masked"} and {x.slice for x in r} == {"all", "multi", "conflicting"}
    sizes = {(x.system, x.slice): x.n for x in r}
    assert len({n for (s, sl), n in sizes.items() if sl == "all"}) == 1 and all(0 <= x.macro_f1 <= 1 for x in r)
    mix = q["m18_slices"](spark, SF).collect()
    assert sum(x.n for x in mix if x.slice == "all") == sizes["trained_masked", "all"]


def test_folds_hold_whole_headlines(spark):
    rows = train.with_features(tq.target_pairs(spark, SF), tq.DIMS)
    scores = train.choose_c(rows, grid=(1.0, 8.0), folds=2)
    assert [c for c, _ in scores] == [1.0, 8.0] and all(0 < f <= 1 for _, f in scores)
    assert rows.groupBy("group").agg(F.count_distinct("fold").alias("k")).where("k > 1").isEmpty()
    assert corpus.ENTITIES
