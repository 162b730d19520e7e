"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Trained with follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties) on a bounded
sample of labelled rows; a temperature fitted to a part of the sample that training doesn't see turns scores
into probabilities. Document frequencies come from all training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_text_rule, mix, on_texts, released, squeezed

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The most languages whose bounds are broadcast.
BROADCAST = 100_000


def features(texts: pa.Array, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS):
    """For each text the buckets of its character n-grams and how often each occurs, as (buckets, counts).

    Capitals of all scripts are lowered and white space is one character; n-grams run within the text, over code points."""
    for t in texts.to_pylist():
        if not t:
            yield np.empty(0, np.int64), np.empty(0, np.int64)
            continue
        c = np.frombuffer(" ".join(t.lower().split()).encode("utf-32-le"), "<u4").astype(U64)
        total = np.zeros(buckets, np.int64)
        name = c
        for n in range(1, max(orders) + 1):
            if n > len(c):
                break
            if n > 1:
                name = name[:-1] * U64(0x9E3779B97F4A7C15) + c[n - 1 :]
            if n in orders:
                total += np.bincount((mix(name + U64(n << 40)) >> U64(64 - buckets.bit_length() + 1)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield at, total[at]


@dataclass
class Model:
    languages: list[str]
    weight: np.ndarray  # buckets x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = np.log1p(count) * self.idf[at]
        return v / (np.linalg.norm(v) or 1.0)

    def scores(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weight[at] + self.bias

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        e = np.exp((scores - scores.max(axis=-1, keepdims=True)) / self.temperature)
        return e / e.sum(axis=-1, keepdims=True)


def packed(at: np.ndarray, count: np.ndarray) -> tuple[bytes, bytes]:
    return squeezed(np.diff(at, prepend=0).astype(np.uint16)), squeezed(count.astype(np.uint32))


def unpacked(row: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(released(row[0], np.uint16), dtype=np.int64), released(row[1], np.uint32)


def follow_leader(model: Model, rows: list, classes: np.ndarray, epochs: int = 6, alpha: float = 0.5, l1: float = 0.02, l2: float = 0.02, seed: int = 7) -> None:
    """Weights by follow-the-regularised-leader over packed rows: z and n are the leader's sums of gradients and of their squares."""
    k = len(model.languages)
    z, n = np.zeros((len(model.weight) + 1, k), np.float32), np.zeros((len(model.weight) + 1, k), np.float32)

    def leader(at):
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((1 + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, c = unpacked(rows[i])
            at, v = np.append(at, len(model.weight)), np.append(model.vector(at, c), 1.0).astype(np.float32)  # the last coordinate is the bias
            w = leader(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[classes[i]] -= 1
            g = v[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    w = leader(np.arange(len(z)))
    model.weight, model.bias = w[:-1], w[-1]


def temperature(model: Model, scores: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden sections of its logarithm."""

    def loss(log_t: float) -> float:
        model.temperature = float(np.exp(log_t))
        return -float(np.log(model.probabilities(scores)[np.arange(len(classes)), classes] + 1e-300).mean())

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, sample: int = 3000, least: int = 20) -> Model | None:
    """A model of docs(doc_id, text, lang), null without a labelled text.

    `sample` bounds the rows that weights are fitted to: as many of each language, by the smallest hashes, `least` even if
    that exceeds `sample`; equal rows count once. Document frequencies count every labelled row, and every label is learnt; the weights' memory is BUCKETS
    times their number."""
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    order = F.xxhash64("doc_id", "text")
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).collect()  # one for each language
    rows = {r["lang"]: r["n"] for r in counted}
    languages = sorted(rows, key=lambda x: (-rows[x], x))
    if not languages:
        return None

    def documents_of(batches):
        total, seen = np.zeros(BUCKETS + 1, np.int64), 0
        for b in batches:
            for at, _ in features(b.column("text")):
                total[at] += 1
                seen += 1
        total[BUCKETS] = seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "texts"])

    frequency = np.zeros(BUCKETS + 1)
    for r in known.select("text").mapInArrow(documents_of, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).collect():  # at most BUCKETS + 1 rows
        frequency[r["bucket"]] = r["texts"]
    idf = np.log((1 + frequency[BUCKETS]) / (1 + frequency[:BUCKETS])) + 1
    model = Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)), idf)
    each = max(least, sample // len(languages))
    # one scan: hashes up to a bound of each language, with some to spare; then so many rows of each
    share = {x: min(1.0, (each + 4 * each**0.5 + 4) / n) for x, n in rows.items()}
    edges = spark.createDataFrame([(r["lang"], max(r["first"], min((1 << 63) - 1, int((share[r["lang"]] - 0.5) * (1 << 64))))) for r in counted], "lang string, edge long")
    edges = F.broadcast(edges) if len(rows) <= BROADCAST else edges
    spare = int(sum(min(n, each + 8 * each**0.5 + 8) for n in rows.values()))

    def described(b):
        f = [packed(*x) for x in features(b.column("text"))]
        return pa.RecordBatch.from_arrays([b.column("lang"), pa.array([at for at, _ in f], pa.binary()), pa.array([c for _, c in f], pa.binary())], names=["lang", "at", "times"])

    picked = known.select("text", "lang", order.alias("h")).join(edges, "lang").where("h <= edge").groupBy("lang", "h").agg(F.first("text").alias("text")).orderBy("h", "lang").limit(spare)
    picked = on_texts(picked, described, "lang string, at binary, times binary").toArrow()
    taken: dict[str, int] = dict.fromkeys(languages, 0)
    number = {x: k for k, x in enumerate(languages)}
    chosen = []
    for x, at, c in zip(*(picked.column(c) for c in ("lang", "at", "times")), strict=True):
        x = x.as_py()
        if taken[x] < each:
            taken[x] += 1
            chosen.append((at.as_py(), c.as_py(), number[x]))
    apart = [i for i in range(len(chosen)) if i % 5 == 4]
    fit = [i for i in range(len(chosen)) if i % 5 != 4]
    classes = np.array([c for _, _, c in chosen])
    follow_leader(model, [chosen[i][:2] for i in fit], classes[fit])
    if apart and len(languages) > 1:
        model.temperature = temperature(model, np.array([model.scores(*unpacked(chosen[i][:2])) for i in apart]), classes[apart])
    return model


def judged(m: Model | None, texts: pa.Array) -> list[tuple[str, float]]:
    """Language and probability of each text."""
    out = []
    for t, (at, count) in zip(texts.to_pylist(), features(texts), strict=True):
        if m is None or not t or not any(map(str.isalpha, t)):
            out.append(("und", 0.0))
        else:
            p = m.probabilities(m.scores(at, count))
            out.append((m.languages[int(p.argmax())], float(p.max())))
    return out


def recognised(docs: DataFrame, model: Model | None, sure: float) -> DataFrame:
    """The rows of docs, all columns, whose language is told with a probability of `sure` at least; each row by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b):
        return b.filter(pa.array([lang != "und" and p >= sure for lang, p in judged(shared.value, b.column("text"))], pa.bool_()))

    return on_texts(docs, run, docs.schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs(doc_id, text); other columns aren't read.

    `und` with score 0 for a null text, one without a letter, or without a model. score is the calibrated
    probability of lang_pred; equal texts have equal results."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b):
        found = judged(shared.value, b.column("text"))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return on_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learning from rows whose crc32(doc_id) mod `folds` isn't `held`.

    A null doc_id is in no fold: it isn't learnt from, and held_out is null."""
    out = predict(docs, train(docs.where(by_text_rule(folds) != held)))
    return out.select("doc_id", (by_text_rule(folds) == held).alias("held_out"), "lang_pred", "score")
