"""Target-aware text classifier: masking, n-gram weights, training, scoring."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from riskloom.dims.text_rules import TextDims
from riskloom.functions import text as tx
from riskloom.operators.evaluate import classification_scores
from riskloom.session import cut, new_path

NEAR, MIN_DF, MAX_TERMS = 3, 2, 40_000
LABELS = ("negative", "neutral", "positive")
C_GRID = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)


# ------------------------------------------------------------------ masking and tokens
def mask(text: Column, target: Column, others: Column) -> Column:
    """Target spans become TGT, other entities' spans OTH; overlapping later spans are skipped."""
    def tagged(spans: Column, order: int, tag: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(order).alias("o"), F.lit(tag).alias("tag")))

    spans = F.array_sort(F.concat(tagged(others, 0, " OTH "), tagged(target, 1, " TGT ")))
    start = F.struct(F.lit(0).alias("c"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        grown = F.struct(s["e"].alias("c"), F.concat(
            acc["out"], F.substring(text, acc["c"] + 1, s["s"] - acc["c"]), s["tag"]).alias("out"))
        return F.when(s["s"] < acc["c"], acc).otherwise(grown)

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["c"] + 1, F.length(text))))
    return F.trim(F.regexp_replace(done, r"\s+", " "))


def augmented_tokens(masked: Column) -> Column:
    """Tokens, then "near_" copies of the words within three tokens of the target."""
    toks = F.transform(F.regexp_extract_all(masked, F.lit(r"(?U)\b\w\w+\b|[%$]"), F.lit(0)), lambda t: F.lower(t))

    def near(ts: Column) -> Column:
        def around(t: Column, i: Column) -> Column:
            left = F.slice(ts, F.greatest(i - NEAR, F.lit(0)) + 1, F.least(i, F.lit(NEAR)))
            right = F.slice(ts, i + 2, NEAR)
            kept = F.filter(F.concat(left, right), lambda w: ~w.isin("tgt", "oth"))
            return F.when(t == "tgt", F.transform(kept, lambda w: F.concat(F.lit("near_"), w))).otherwise(F.array().cast("array<string>"))

        return F.concat(ts, F.flatten(F.transform(ts, around)))

    return tx.let(toks, near)


def grams(tokens: Column) -> Column:
    """1- and 2-grams."""
    def both(ts: Column) -> Column:
        pairs = F.when(F.size(ts) > 1, F.transform(
            F.sequence(F.lit(1), F.size(ts) - 1), lambda i: F.concat_ws(" ", F.slice(ts, i, 2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(ts, pairs)

    return tx.let(tokens, both)


def unmasked(masked: Column) -> Column:
    """What the lexicon reads: the words around the marks."""
    return F.regexp_replace(F.regexp_replace(masked, "TGT", " "), "OTH", " ")


def with_features(pairs: DataFrame, dims: TextDims, masked: bool = True) -> DataFrame:
    """(text, target, others) -> ``masked``, ``grams`` and the lexicon's three numbers."""
    m = mask(F.col("text"), F.col("target"), F.col("others")) if masked else F.col("text")
    out = pairs.withColumn("masked", m).withColumn("_p", tx.lexicon_probs(unmasked(F.col("masked")), dims))
    return out.withColumn("grams", grams(augmented_tokens(F.col("masked")))).withColumn("lex_neg", F.col("_p.neg")).withColumn(
        "lex_pos", F.col("_p.pos")).withColumn("lex_bal", F.col("_p.pos") - F.col("_p.neg")).drop("_p")


# ------------------------------------------------------------------ n-gram weights
def vocabulary(rows: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Terms in at least two rows with smoothed idf; the most frequent ``max_terms`` are the model's size."""
    n = rows.agg(F.count("*").alias("n_rows"))
    terms = rows.select("row_id", F.explode("grams").alias("gram"))
    counted = terms.groupBy("gram").agg(F.count_distinct("row_id").alias("df"), F.count("*").alias("tf_all")).filter(F.col("df") >= MIN_DF)
    kept = counted.orderBy(F.desc("tf_all"), "gram").limit(max_terms)
    from pyspark.sql import Window

    numbered = kept.withColumn("idx", F.row_number().over(Window.orderBy("gram")) - 1)
    return numbered.join(F.broadcast(n)).select("gram", "idx", (F.ln((1.0 + F.col("n_rows")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def term_weights(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row_id, idx, w): sublinear tf x idf, L2-normalised per row."""
    tf = rows.select("row_id", F.explode("grams").alias("gram")).groupBy("row_id", "gram").agg(F.count("*").alias("c"))
    w = tf.join(vocab, "gram").select("row_id", "idx", ((1.0 + F.ln("c")) * F.col("idf")).alias("v"))
    norm = w.groupBy("row_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return w.join(norm, "row_id").select("row_id", "idx", (F.col("v") / F.col("norm")).alias("w"))


def training_vectors(rows: DataFrame, vocab: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``x``: n-gram weights and the lexicon's three numbers as one sparse vector.

    The vector is put together from sorted arrays in the fields of Spark's vector type, written, and read back as such.
    """
    cells = term_weights(rows, vocab).groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("cells"))   # a row's own n-grams
    part = lambda name, kind: F.coalesce(F.transform("cells", lambda c: c[name].cast(kind)), F.array().cast(f"array<{kind}>"))
    x = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size + 3).alias("size"), F.concat(part("idx", "int"), F.array(*[F.lit(size + k) for k in range(3)])).alias("indices"),
                 F.concat(part("w", "double"), F.array("lex_neg", "lex_pos", "lex_bal")).alias("values"))
    done = rows.join(cells, "row_id", "left").withColumn("x", x).drop("cells")
    path = new_path(rows.sparkSession, "vectors")
    done.write.parquet(path)
    schema = StructType([StructField("x", VectorUDT()) if f.name == "x" else f for f in done.schema])
    return rows.sparkSession.read.schema(schema).parquet(path)


@dataclass
class TargetModel:
    """Linear softmax over sparse n-grams as tables."""

    terms: DataFrame            # gram, idf, coef array<double> (one value per class)
    dense: list[list[float]]    # per class: lex_neg, lex_pos, lex_bal
    intercept: list[float]
    classes: tuple[str, ...]


@dataclass
class Prepared:
    """Training rows as vectors over their own vocabulary; one preparation serves every C."""

    data: DataFrame             # label, x, y, wt
    vocab: DataFrame
    size: int
    classes: tuple[str, ...]
    n: int


def prepare(rows: DataFrame, classes: Sequence[str] = LABELS) -> Prepared:
    rows = cut(rows)
    vocab = cut(vocabulary(rows))
    size = vocab.count()
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}   # one row a label
    present = tuple(x for x in classes if x in counts)
    n = sum(counts.values())
    code = F.create_map(*[F.lit(x) for i, k in enumerate(present) for x in (k, float(i))])
    weight = F.create_map(*[F.lit(x) for k in present for x in (k, n / (len(present) * counts[k]))])
    labelled = rows.withColumn("y", F.element_at(code, F.col("label"))).withColumn("wt", F.element_at(weight, F.col("label")))
    return Prepared(training_vectors(labelled, vocab, size), vocab, size, present, n)


def regress(p: Prepared, c: float) -> LogisticRegressionModel:
    """Balanced multinomial logistic regression (L2 strength 1/C per row)."""
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="wt", family="multinomial", regParam=1.0 / (c * p.n), elasticNetParam=0.0,
                              standardization=False, maxIter=100, tol=1e-6).fit(p.data.select("x", "y", "wt"))


def fit(rows: DataFrame, c: float = 8.0, classes: Sequence[str] = LABELS) -> TargetModel:
    """The model of all ``rows`` at one C."""
    p = prepare(rows, classes)
    lr = regress(p, c)
    m = lr.coefficientMatrix.toArray()
    coef = rows.sparkSession.createDataFrame(((int(j), [float(v) for v in m[:, j]]) for j in range(p.size)), "idx int, coef array<double>")
    return TargetModel(cut(p.vocab.join(coef, "idx").select("gram", "idf", "coef")), [[float(v) for v in row[p.size:]] for row in m],
                       [float(v) for v in lr.interceptVector], p.classes)


def predict(rows: DataFrame, model: TargetModel) -> DataFrame:
    """row_id -> class probabilities and label: explode n-grams, join weights, sum, softmax."""
    k = len(model.classes)
    tf = rows.select("row_id", F.explode("grams").alias("gram")).groupBy("row_id", "gram").agg(F.count("*").alias("c"))
    hit = tf.join(model.terms, "gram").withColumn("v", (1.0 + F.ln("c")) * F.col("idf"))
    sums = hit.groupBy("row_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), *[
        F.sum(F.col("v") * F.get("coef", F.lit(i))).alias(f"s{i}") for i in range(k)])
    j = rows.join(sums, "row_id", "left")
    z = [F.coalesce(F.col(f"s{i}") / F.col("norm"), F.lit(0.0)) + model.intercept[i] + model.dense[i][0] * F.col("lex_neg")
         + model.dense[i][1] * F.col("lex_pos") + model.dense[i][2] * F.col("lex_bal") for i in range(k)]
    j = j.withColumn("z", F.array(*z)).withColumn("top", F.array_max("z"))
    j = j.withColumn("ex", F.transform("z", lambda v: F.exp(v - F.col("top"))))
    total = F.aggregate("ex", F.lit(0.0), lambda a, v: a + v)
    p = {c: F.get("ex", F.lit(i)) / total for i, c in enumerate(model.classes)}
    label = F.element_at(F.array(*[F.lit(c) for c in model.classes]), F.array_position(F.col("z"), F.col("top")).cast("int"))
    return j.withColumn("_t", total).select(
        *rows.columns, *[p.get(c, F.lit(0.0)).alias(f"p_{c}") for c in LABELS], label.alias("predicted"))


def fold_of(group: Column, folds: int = 5) -> Column:
    """Group fold by content hash: every row of a headline lands in the same fold."""
    return (F.conv(F.substring(F.md5(group.cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int")


def choose_c(rows: DataFrame, grid: Sequence[float] = C_GRID, folds: int = 5) -> list[tuple[float, float]]:
    """Grouped cross-validation: (C, mean macro-F1) per candidate. A fold's vectors serve the whole grid."""
    rows = cut(rows.withColumn("_cv", fold_of(F.concat_ws(":", F.lit("cv"), F.col("group").cast("string")), folds)))

    def prepared(f: int):
        p = prepare(rows.filter(F.col("_cv") != f))
        held = training_vectors(rows.filter(F.col("_cv") == f), p.vocab, p.size)
        return p, held

    def score(job) -> tuple[float, float | None]:
        (p, held), c = job
        names = F.array(*[F.lit(k) for k in p.classes])
        got = regress(p, c).transform(held).withColumn("predicted", F.get(names, F.col("prediction").cast("int")))
        r = classification_scores(got, [], "label", "predicted").first()
        return c, r["macro_f1"] if r is not None else None

    sides = [prepared(f) for f in range(folds)]
    with ThreadPool(4) as pool:                       # small independent jobs, as Spark's own cross-validator runs them
        found = pool.map(score, [(s, c) for s in sides if s[0].n and len(s[0].classes) > 1 for c in grid])
    by_c = {c: [f for k, f in found if k == c and f is not None] for c in grid}
    return [(c, sum(v) / len(v) if v else 0.0) for c, v in by_c.items()]


def best_c(scores: list[tuple[float, float]]) -> float:
    """The first C of the highest score."""
    return max(scores, key=lambda s: s[1])[0]


# ------------------------------------------------------------------ the four systems
def lexicon_label(p: Column, eps: float = 0.1) -> Column:
    s = p["pos"] - p["neg"]
    return F.when(F.abs(s) < eps, "neutral").when(s > 0, "positive").otherwise("negative")


def lexicon_systems(pairs: DataFrame, dims: TextDims) -> DataFrame:
    """``whole`` and ``window``: labels by the lexicon over the text, and over the target's own sentences or clauses."""
    from riskloom.operators.mentions import mean_probs, windows_of

    cutout = F.transform(windows_of(F.col("text"), F.col("target"), F.col("others")), lambda w: F.substring(F.col("text"), w["s"] + 1, w["e"] - w["s"]))
    rows = pairs.withColumn("_w", cutout).withColumn("_ps", F.transform("_w", lambda t: tx.lexicon_probs(t, dims)))
    return rows.withColumn("whole", lexicon_label(tx.lexicon_probs(F.col("text"), dims))).withColumn(
        "window", lexicon_label(mean_probs(F.col("_ps")))).drop("_w", "_ps")


def slices(rows: DataFrame) -> DataFrame:
    """Each row once per slice that it belongs to."""
    names = F.array(F.lit("all"), F.when(F.col("n_entities") > 1, "multi"), F.when(F.col("conflict"), "conflicting"))
    return rows.withColumn("slice", F.explode(F.filter(names, lambda s: s.isNotNull())))


def report(train: DataFrame, test: DataFrame, dims: TextDims, c: float) -> DataFrame:
    """system, slice, accuracy, macro_f1, n over held-out pairs: lexicon over the whole text and over windows, trained
    without and with target masking. ``train``, ``test``: row_id, group, text, target, others, label, n_entities, conflict."""
    parts = []
    for name, masked in (("trained_unmasked", False), ("trained_masked", True)):
        model = fit(with_features(train, dims, masked), c)
        parts.append(predict(with_features(test, dims, masked), model).select("label", "n_entities", "conflict", "predicted", F.lit(name).alias("system")))
    lex = lexicon_systems(test, dims)
    parts += [lex.select("label", "n_entities", "conflict", F.col(col).alias("predicted"), F.lit(name).alias("system")) for name, col in (("lexicon_whole", "whole"), ("lexicon_window", "window"))]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return classification_scores(slices(rows), ["system", "slice"], "label", "predicted")


# ------------------------------------------------------------------ scoring inside a narrow stage
@dataclass
class Weights:
    """A model as arrays. At most ``MAX_TERMS`` n-grams, so it travels with a task."""

    grams: list[str]
    idf: np.ndarray
    coef: np.ndarray            # n-gram, class
    dense: np.ndarray           # class, lexicon number
    intercept: np.ndarray
    classes: tuple[str, ...]


def weights(model: TargetModel) -> Weights:
    rows = model.terms.select("gram", "idf", "coef").collect()   # MAX_TERMS at most
    k = len(model.classes)
    return Weights([r["gram"] for r in rows], np.array([r["idf"] for r in rows], float), np.array([r["coef"] for r in rows], float).reshape(-1, k),
                   np.array(model.dense, float).reshape(k, 3), np.array(model.intercept, float), model.classes)


def probabilities(w: Weights, grams_: pa.Array, dense: np.ndarray) -> np.ndarray:
    """negative, neutral, positive of each list of n-grams, a batch at a time. ``dense``: the lexicon's three numbers."""
    import pyarrow.compute as pc

    n, size = len(grams_), max(1, len(w.grams))
    term = pc.index_in(grams_.flatten(), value_set=pa.array(w.grams, pa.string()))
    row = np.repeat(np.arange(n), grams_.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    known = term.is_valid().to_numpy(zero_copy_only=False)
    cell, count = np.unique(row[known] * size + term.drop_null().to_numpy(), return_counts=True)
    at, idx = cell // size, cell % size
    v = (1.0 + np.log(count)) * w.idf[idx]
    norm = np.sqrt(np.bincount(at, v * v, n))
    z = np.stack([np.bincount(at, v * w.coef[idx, k], n) for k in range(len(w.classes))], axis=1) / np.where(norm > 0, norm, 1.0)[:, None]
    z = z + w.intercept + dense @ w.dense.T
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    return np.stack([p[:, w.classes.index(c)] if c in w.classes else np.zeros(n) for c in LABELS], axis=1)


class TargetScorer:
    """The trained model in place of the lexicon in ``score_mentions``: it reads whole sentences with the entities masked.

    Masking, n-grams and lexicon numbers are column expressions; the weights are looked up in one Arrow batch function, so
    the mention stage stays narrow.
    """

    targeted = True

    def __init__(self, model: Weights, dims: TextDims):
        self.model, self.dims = model, dims

    def scored(self, rows: DataFrame, items: Column, name: str) -> DataFrame:
        """``rows`` with ``name``: array<struct<neg, neu, pos>> of ``items``, array<struct<text, target, others>>."""
        w = self.model

        @F.arrow_udf("array<struct<neg:double,neu:double,pos:double>>")
        def look_up(found: pa.Array, lexicon: pa.Array, n: pa.Array) -> pa.Array:
            texts = found.flatten()
            dense = lexicon.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
            p = probabilities(w, texts, dense) if len(texts) else np.zeros((0, 3))
            each = pa.StructArray.from_arrays([pa.array(p[:, k]) for k in range(3)], names=["neg", "neu", "pos"])
            ends = np.append(0, np.cumsum(n.to_numpy(zero_copy_only=False))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), each)

        numbers = lambda p: F.array(p["neg"], p["pos"], p["pos"] - p["neg"])
        rows = rows.withColumn("_masked", F.transform(items, lambda i: mask(i["text"], i["target"], i["others"])))
        rows = rows.withColumn("_grams", F.transform("_masked", lambda m: grams(augmented_tokens(m)))).withColumn(
            "_lex", F.transform("_masked", lambda m: tx.let(tx.lexicon_probs(unmasked(m), self.dims), numbers)))
        # read twice, the arguments stay columns of their own: the optimiser does not take such expressions into a Python call
        call = look_up.asNondeterministic()(F.col("_grams"), F.col("_lex"), F.greatest(F.size("_grams"), F.size("_lex")))
        return rows.withColumn(name, call).drop("_masked", "_grams", "_lex")
