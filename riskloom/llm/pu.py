"""A quality classifier from trusted positives and unlabelled text: non-negative positive-unlabelled learning.

The learner sees positives (rows marked 1) and unlabelled web text, no negatives. With the class prior p it minimises
p * R+ of positives + max(0, R- of unlabelled - p * R- of positives): the last part estimates the risk on negatives,
which cannot be below zero; where a batch takes it there, the step goes the other way (Kiryo et al., 2017). The loss is
the sigmoid loss, the model one hidden layer. The prior is estimated from the same two samples: a first model tells
positives from unlabelled rows on one half, and on the other half the smallest ratio of the shares above a score, with a
confidence term, bounds the part of positives in the unlabelled rows (best bin estimation). The learner starts from that
first model, its zero moved to where the prior's part of the unlabelled rows lies above; a start that calls all rows
positive has flat slopes and would stay there.

The samples are bounded (``POSITIVES``, ``UNLABELLED`` rows, documented bounds, picked by a hash) and fitted in one
task; every whole text is scored. Features: shares of character kinds over the text and in its worst stretch of
``STRETCH`` bytes, repeated words over the text and in the worst stretch of ``RUN`` words, word and line shapes, and
hashed byte trigrams.

Defined cases: a null or empty text has its own feature and is scored like any other; a label row without doc_id or
quality is ignored; a document that is marked 1 and 0 is no trusted positive; without positives or unlabelled rows every
score is the prior's default of 0.5; rows that repeat a doc_id are scored each; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import identified, written

POSITIVES, UNLABELLED = 4000, 12_000
FOLDS, HELD_OUT = 3, 1
STRETCH, RUN = 256, 48
TRIGRAMS = 256
HIDDEN, EPOCHS, BATCHES, RATE, DECAY = 24, 40, 12, 3e-3, 1e-4
DELTA = 0.1              # of the prior's confidence term
SEED = 20_240_229

KINDS = ("upper", "lower", "digit", "blank", "line", "stop", "shout", "symbol", "quote", "wide")


def _kind_table() -> np.ndarray:
    kinds = np.full(256, KINDS.index("symbol"), np.uint8)
    for name, chars in {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": b" \t", "line": b"\n\r\x0b\x0c", "stop": b".,;:", "shout": b"!?", "quote": b"'\"()-", "wide": range(128, 256)}.items():
        kinds[list(chars)] = KINDS.index(name)
    return kinds


KIND_OF = _kind_table()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def features(text: str | None) -> np.ndarray:
    """Bounded numbers of one whole text; no statistics of a corpus go in."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    k = len(KINDS)
    kinds = KIND_OF[b]
    whole = np.bincount(kinds, minlength=k) / max(1, len(b))
    stretches = max(1, len(b) // STRETCH)
    place = np.minimum(np.arange(len(b)) // STRETCH, stretches - 1)
    each = np.bincount(place * k + kinds, minlength=stretches * k).reshape(stretches, k)
    each = each / np.maximum(1, each.sum(axis=1, keepdims=True))
    words = raw.split()
    n = len(words)
    h = np.fromiter(map(hash, words), np.int64, n)
    again = float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0
    runs = np.sort(h[: n // RUN * RUN].reshape(-1, RUN), axis=1) if n >= RUN else np.sort(h)[None, :]
    fresh = (1 + (runs[:, 1:] != runs[:, :-1]).sum(axis=1)) / runs.shape[1] if n else np.ones(1)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = raw.split(b"\n")
    distinct = len(set(lines)) / len(lines)
    shape = [again, float(fresh.min()), float(fresh.mean()), len(set(words)) / max(1, n), float(sizes.mean()) / 16 if n else 0.0, float((sizes > 20).mean()) if n else 0.0, distinct, min(1.0, n / len(lines) / 64),
             np.log1p(n) / 10, float(n == 0), float(sum(w.isupper() for w in words) / max(1, n)), float(sum(w.isalnum() for w in words) / max(1, n))]
    code = b.astype(np.uint32)
    code = (code[:-2] << np.uint32(16) | code[1:-1] << np.uint32(8) | code[2:]) * np.uint32(0x9E3779B1) if len(b) > 2 else np.zeros(0, np.uint32)
    grams = np.sqrt(np.bincount(code >> np.uint32(33 - TRIGRAMS.bit_length()), minlength=TRIGRAMS) / max(1, len(code)))
    return np.concatenate([np.sqrt(whole), np.sqrt(each.max(axis=0)), np.sqrt(each.min(axis=0)), shape, grams]).astype(np.float32)


WIDTH = 3 * len(KINDS) + 12 + TRIGRAMS


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Scorer:
    """One hidden layer; ``prior`` is the estimated part of positives in unlabelled text."""

    w: np.ndarray
    c: np.ndarray
    v: np.ndarray
    d: float
    prior: float

    @staticmethod
    def new(rng: np.random.Generator) -> Scorer:
        return Scorer(rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0, 0.5)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(0, x @ self.w + self.c) @ self.v + self.d

    def gradient(self, x: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        """Of a loss whose slope by each row's margin is ``out``."""
        hidden = np.maximum(0, x @ self.w + self.c)
        back = out[:, None] * self.v * (hidden > 0)
        return [x.T @ back, back.sum(axis=0), hidden.T @ out, np.array(out.sum())]

    def pack(self) -> list[float]:
        return [*self.w.ravel().tolist(), *self.c.tolist(), *self.v.tolist(), float(self.d), float(self.prior)]

    @staticmethod
    def unpack(values: list[float]) -> Scorer:
        flat = np.array(values)
        return Scorer(flat[: WIDTH * HIDDEN].reshape(WIDTH, HIDDEN), flat[WIDTH * HIDDEN: -HIDDEN - 2], flat[-HIDDEN - 2: -2], float(flat[-2]), float(flat[-1]))


def _train(p: np.ndarray, u: np.ndarray, slopes, m: Scorer) -> Scorer:
    """Adam over batches from ``m``; ``slopes(zp, zu)`` gives the loss's slope by the margins of both parts."""
    rng = np.random.default_rng(SEED)
    first, second = [np.zeros(np.shape(t)) for t in (m.w, m.c, m.v, m.d)], [np.zeros(np.shape(t)) for t in (m.w, m.c, m.v, m.d)]
    step = 0
    for _ in range(EPOCHS):
        deal_p, deal_u = rng.permutation(len(p)), rng.permutation(len(u))
        for k in range(BATCHES):
            xp, xu = p[deal_p[k::BATCHES]], u[deal_u[k::BATCHES]]
            if not len(xp) or not len(xu):
                continue
            x = np.concatenate([xp, xu])
            z = m.margin(x)
            grads = m.gradient(x, np.concatenate(slopes(z[: len(xp)], z[len(xp):])))
            step += 1
            for t, (name, g) in enumerate(zip(("w", "c", "v", "d"), grads, strict=True)):
                value = getattr(m, name)
                g = g + DECAY * np.asarray(value)
                first[t] = 0.9 * first[t] + 0.1 * g
                second[t] = 0.999 * second[t] + 0.001 * g * g
                change = RATE * (first[t] / (1 - 0.9**step)) / (np.sqrt(second[t] / (1 - 0.999**step)) + 1e-8)
                setattr(m, name, value - change)
    return m


def non_negative_slopes(prior: float):
    """Slopes of the non-negative risk under the sigmoid loss l(z) = 1 / (1 + e^z)."""

    def slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sp, su = _sigmoid(zp), _sigmoid(zu)                    # the loss of calling a row negative
        dp, du = sp * (1 - sp) / len(zp), su * (1 - su) / len(zu)
        if su.mean() - prior * sp.mean() < 0:                  # beyond what negatives can cost: step back from there
            return prior * dp, -du
        return -2 * prior * dp, du

    return slopes


def apart_slopes(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the logistic loss that tells positives from unlabelled rows, both samples alike in weight."""
    return (_sigmoid(zp) - 1) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2


def estimated_prior(p: np.ndarray, u: np.ndarray, apart: Scorer) -> float:
    """Part of positives in the unlabelled rows, by rows that ``apart`` has not seen."""
    zp, zu = np.sort(apart.margin(p)), np.sort(apart.margin(u))
    if not len(zp) or not len(zu):
        return 0.5
    above_p = 1 - np.searchsorted(zp, zp, side="left") / len(zp)
    above_u = 1 - np.searchsorted(zu, zp, side="left") / len(zu)
    doubt = np.sqrt(np.log(4 / DELTA) / 2 / len(zu)) + np.sqrt(np.log(4 / DELTA) / 2 / len(zp))
    best = int(np.argmin((above_u + doubt) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit_arrays(p: np.ndarray, u: np.ndarray, prior: float | None = None) -> Scorer:
    m = _train(p[::2], u[::2], apart_slopes, Scorer.new(np.random.default_rng(SEED)))
    prior = estimated_prior(p[1::2], u[1::2], m) if prior is None else prior
    m.d -= float(np.quantile(m.margin(u), 1 - prior))
    m = _train(p, u, non_negative_slopes(prior), m)
    m.prior = prior
    return m


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows at most, by a hash of doc_id."""
    n = rows.count()
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(13)), 33) / F.lit(float(1 << 31))
    return rows.where(chance < F.lit(most / max(1, n)))


def samples(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """trusted, key (a hash for the order), features of both samples, from rows that are not held out."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q")).where(F.col("doc_id").isNotNull() & F.col("q").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = sampled(written(marks.groupBy("doc_id").agg(F.min("q").alias("q")).where("q = 1").select("doc_id"), "trusted"), positives)
    rows = identified(docs).where(~held_out(F.col("doc_id")))
    # the trusted ids are a sample of bounded size
    chosen = rows.join(F.broadcast(trusted), "doc_id", "left_semi").withColumn("trusted", F.lit(True)).unionByName(sampled(rows, unlabelled).withColumn("trusted", F.lit(False)))

    def run(batches):
        import pyarrow as pa

        for t in batches:
            x = [features(s) for s in t.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(2), pa.array([v.tolist() for v in x], pa.list_(pa.float32()))], names=["trusted", "key", "x"])

    return chosen.select("trusted", "text", F.xxhash64("doc_id", F.lit(17)).alias("key")).mapInArrow(run, "trusted boolean, key bigint, x array<float>")


def fit(docs: DataFrame, labels: DataFrame, prior: float | None = None) -> Scorer | None:
    """The model, or None where a sample is empty. One task fits: its rows are bounded by the sample sizes."""
    sample = written(samples(docs, labels), "pu-sample")

    def run(batches):
        import pyarrow as pa

        parts = [(t.column(0).to_numpy(zero_copy_only=False), t.column(1).to_numpy(), np.array(t.column(2).to_pylist(), np.float32)) for t in batches if t.num_rows]
        if parts:
            mark, key, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((*x.T[:3], key))
            mark, x = mark[order].astype(bool), x[order]
            if mark.any() and not mark.all():
                yield pa.RecordBatch.from_arrays([pa.array([fit_arrays(x[mark], x[~mark], prior).pack()], pa.list_(pa.float64()))], names=["values"])

    found = written(sample.coalesce(1).mapInArrow(run, "values array<double>"), "pu-model").collect()   # one row
    return Scorer.unpack(found[0]["values"]) if found else None


def score(docs: DataFrame, model: Scorer | None) -> DataFrame:
    """doc_id, score of every whole text; the model (a few thousand weights) travels with the task."""

    def run(batches):
        import pyarrow as pa

        for t in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            said = _sigmoid(model.margin(np.stack([features(s) for s in t.column(1).to_pylist()]))) if model else np.full(t.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([t.column(0), pa.array(said.astype(np.float64))], names=["doc_id", "score"])

    return identified(docs).mapInArrow(run, "doc_id bigint, score double")
