"""Language identification in two steps: the family first, then linear support vector machines inside the family.

A text's features are the frequencies (square roots) of its hashed byte trigrams, lower case, over the whole text. A
softmax regression names the family; in a family of several languages every two have a linear support vector machine,
and the language that wins most of them is predicted. Models are fitted by Spark on a sample of labelled rows: at most
about ``SAMPLE`` rows a language (the documented bound), picked by a hash of doc_id. Prediction reads text alone.

Defined cases: a null text, or one without letters, is ``und`` with score 0; without any labelled row every text is
``und``; a family with one language needs no vector machine; languages in no listed family are families of their own;
rows that repeat a doc_id are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import identified, released, written

DIMENSIONS = 2048
SAMPLE = 400
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
FAMILIES = {
    "germanic": "en de nl af fy lb da sv no nb nn is fo".split(),
    "romance": "fr es pt it ca gl oc ro".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
LETTER = r"\p{L}"   # numbers such as ² or Ⅷ are none


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def features(text: str) -> np.ndarray:
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    counts = np.bincount(code >> np.uint32(32 - DIMENSIONS.bit_length() + 1), minlength=DIMENSIONS)
    return np.sqrt(counts / max(1, len(code)))


@dataclass
class LanguageModel:
    families: list[str] = field(default_factory=list)
    members: dict[str, list[str]] = field(default_factory=dict)
    family_weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIMENSIONS)))
    family_bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pairs: dict[tuple[str, str], tuple[np.ndarray, float]] = field(default_factory=dict)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or not text or not regex.search(LETTER, text):
            return UNKNOWN, 0.0
        x = features(text)
        z = self.family_weights @ x + self.family_bias
        p = np.exp(z - z.max())
        p /= p.sum()
        family = self.families[int(np.argmax(p))]
        langs = self.members[family]
        wins, margins = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0)
        for a, b in combinations(langs, 2):
            w, c = self.pairs[a, b]
            m = float(w @ x) + c   # above 0: b
            won = b if m > 0 else a
            wins[won] += 1
            margins[b] += m
            margins[a] -= m
        best = max(langs, key=lambda k: (wins[k], margins[k], k))
        sure = 1.0 if len(langs) == 1 else 1 / (1 + np.exp(-2 * margins[best] / (len(langs) - 1)))
        return best, float(p.max() * sure)


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """lang, features of about ``per_language`` training rows a language at most."""
    rows = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(~held_out(F.col("doc_id")))
    rows = rows.where(F.col("text").rlike(LETTER))
    parts = rows.groupBy("lang").agg((F.lit(per_language) / F.count("*")).alias("part")).withColumnRenamed("lang", "of")
    # parts has one row per language
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 33) / F.lit(float(1 << 31))
    picked = rows.join(F.broadcast(parts), F.col("lang") == F.col("of")).where(chance < F.col("part")).select("lang", "text")

    def run(batches):
        import pyarrow as pa

        for t in released(batches):
            x = [features(s).tolist() for s in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(x, pa.list_(pa.float64()))], names=["lang", "features"])

    return picked.mapInArrow(run, "lang string, features array<double>")


def fit(docs: DataFrame, per_language: int = SAMPLE) -> LanguageModel:
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sample = written(labelled_sample(docs, per_language), "languages")
    langs = sorted(r["lang"] for r in sample.select("lang").distinct().collect())   # one row per language
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families = sorted(members)
    if not families:
        return LanguageModel()
    number = {lang: float(k) for k, f in enumerate(families) for lang in members[f]}
    label = F.element_at(F.create_map(*[F.lit(v) for kv in number.items() for v in kv]), F.col("lang"))
    # the sample is bounded: a few thousand rows, which a few tasks hold
    data = sample.select("lang", label.alias("label"), array_to_vector("features").alias("features")).coalesce(4).cache()
    weights, bias = np.zeros((len(families), DIMENSIONS)), np.zeros(len(families))
    if len(families) > 1:
        m = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, standardization=False).fit(data)
        weights, bias = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    pairs = {}
    for group in members.values():
        for a, b in combinations(group, 2):
            two = data.where(F.col("lang").isin(a, b)).withColumn("label", (F.col("lang") == b).cast("double"))
            m = LinearSVC(regParam=1e-4, maxIter=40, standardization=False).fit(two)
            pairs[a, b] = (m.coefficients.toArray(), float(m.intercept))
    data.unpersist()
    return LanguageModel(families, members, weights, bias, pairs)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; the model (a few weights a language) travels with the task."""

    def run(batches):
        import pyarrow as pa

        for t in released(batches):
            said = [model.predict(x) for x in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return identified(docs).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
