"""Quality by supervised subword embeddings: a text is the mean of hashed vectors, read by a softmax.

A word's vector is the mean of its own and of its character n-grams' vectors; a pair of neighbouring words has a vector of
its own, by the difference of their names, so that all words that follow themselves share one. All are learnt with the
softmax by stochastic gradient descent in numpy, on a bounded sample of labelled rows. The softmax reads
a mean, so each word has a fixed share in the two classes' scores; scoring keeps the shares of words already met.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, by_text_rule, mix, released, slices, squeezed

BUCKETS, SIZE = 1 << 16, 16
SHORTEST, LONGEST = 2, 4
#: Bytes of text that are scored at once.
SCORE_BYTES = 2_000_000


def bucket_of(names: np.ndarray, salt: int) -> np.ndarray:
    return (mix(names + U64(salt << 40)) >> U64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def units(names: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its n-grams of characters, with marks at its ends, and the word of each bucket."""
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), "<u4").astype(U64)
    own = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    bucket, word = [bucket_of(names, 0)], [np.arange(len(words))]
    name = data
    for n in range(2, LONGEST + 1):
        name = name[:-1] * U64(0x9E3779B97F4A7C15) + data[n - 1 :]
        if n >= SHORTEST:
            at = np.flatnonzero(own[: len(name)] == own[n - 1 :])
            bucket.append(bucket_of(name[at], n))
            word.append(own[at])
    return np.concatenate(bucket), np.concatenate(word)


def pairs(names: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words, by how far their names differ."""
    return bucket_of(names[1:] - names[:-1], 99)


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the buckets that it has and their shares in its mean: one for all words, one for all pairs."""
    out, last = [], 0
    for n in w.count.tolist():
        at = slice(last, last + n)
        last += n
        names, first, times = np.unique(w.names[at], return_index=True, return_counts=True)
        bucket, word = units(names, spelled(w, first + at.start))
        each = (times / max(1, n) / np.maximum(1, np.bincount(word, minlength=len(names))))[word]
        two = pairs(w.names[at])
        bucket, each = np.append(bucket, two), np.append(each, np.full(len(two), 1 / max(1, len(two))))
        there, inverse = np.unique(bucket, return_inverse=True)
        out.append((there, np.bincount(inverse, each, len(there))))
    return out


def spelled(w: Words, at: np.ndarray) -> list[str]:
    return [w.data[a:b].tobytes().decode() for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x SIZE
    weight: np.ndarray  # SIZE x 2
    bias: np.ndarray

    @property
    def lean(self) -> np.ndarray:
        """What each bucket adds to the difference of the classes' scores, before the mean."""
        return self.vectors @ (self.weight[:, 1] - self.weight[:, 0])


def step(m: Model, at: np.ndarray, how: np.ndarray, label: int, rate: float) -> None:
    """One descent of the log-loss of one text. A bucket's vector has a longer step, by the root of how many share the mean."""
    x = how @ m.vectors[at]
    s = x @ m.weight + m.bias
    p = np.exp(s - s.max())
    p /= p.sum()
    p[label] -= 1
    g = p * rate
    back = m.weight @ g
    m.weight -= np.outer(x, g)
    m.bias -= g
    m.vectors[at] -= np.outer(how * len(at) ** 0.5, back)


def fit(rows: list[tuple[bytes, bytes]], classes: np.ndarray, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over texts' buckets and shares, kept packed; both classes weigh alike."""
    rng = np.random.default_rng(seed)
    m = Model((rng.random((BUCKETS, SIZE)) - 0.5) / SIZE, np.zeros((SIZE, 2)), np.zeros(2))
    balance = len(classes) / (2 * np.maximum(1, np.bincount(classes, minlength=2)))
    steps, k = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, how = unpacked(rows[i])
            step(m, at, how, classes[i], rate * (1 - k / steps) * balance[classes[i]])
            k += 1
    return m


def packed(row: tuple[np.ndarray, np.ndarray]) -> tuple[bytes, bytes]:
    return squeezed(np.diff(row[0], prepend=0).astype(np.uint16)), squeezed(row[1].astype(np.float32))


def unpacked(row: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(released(row[0], np.uint16), dtype=np.int64), released(row[1], np.float32).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model | None:
    """A model from docs(doc_id, text) and labels(doc_id, quality) joined by doc_id, null without a label.

    `sample` bounds the rows learnt from: those of the smallest hashes of doc_id, half of them of the rarer class if there are as many.
    A doc_id of several labels has the largest. A row comes to the driver as the buckets that it has, at most BUCKETS whatever its length, packed."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    # at most `sample` ids, so this side may be broadcast
    picked = marked.where("quality = 0").orderBy(order, "doc_id").limit(sample // 2).unionByName(marked.where("quality = 1").orderBy(order, "doc_id").limit(sample // 2))
    chosen = picked.toArrow()
    if not chosen.num_rows:
        return None
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(chosen.column("doc_id").to_pylist(), chosen.column("quality").to_pylist(), strict=True)))

    def described(batches):
        for b in batches:
            hit = np.array([i in known.value for i in b.column("doc_id").to_pylist()], bool) & ~np.asarray(b.column("text").is_null())
            for piece in slices([b.filter(pa.array(hit))]):
                rows = [packed(r) for r in features(Words(piece.column("text"), lower=False))]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([a for a, _ in rows], pa.binary()), pa.array([h for _, h in rows], pa.binary())], names=["doc_id", "at", "how"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(described, "doc_id long, at binary, how binary").orderBy("doc_id").limit(sample).toArrow()
    if not got.num_rows:
        return None
    rows = list(zip(got.column("at").to_pylist(), got.column("how").to_pylist(), strict=True))
    return fit(rows, np.array([known.value[i] for i in got.column("doc_id").to_pylist()]))


class Shares:
    """What words add to the difference of the scores, by name; those of words already met are kept, `room` at most."""

    def __init__(self, lean: np.ndarray, room: int):
        self.lean, self.room = lean, room
        self.names, self.values = np.empty(0, U64), np.empty(0)

    def of(self, w: Words) -> np.ndarray:
        """One for each word."""
        names, first, inverse = np.unique(w.names, return_index=True, return_inverse=True)
        if not len(names):
            return np.empty(0)
        k = np.minimum(np.searchsorted(self.names, names), max(0, len(self.names) - 1))
        met = self.names[k] == names if len(self.names) else np.zeros(len(names), bool)
        values = np.zeros(len(names))
        if met.any():
            values[met] = self.values[k[met]]
        new = np.flatnonzero(~met)
        if len(new):
            bucket, word = units(names[new], spelled(w, first[new]))
            values[new] = np.bincount(word, self.lean[bucket], len(new)) / np.bincount(word, minlength=len(new))
            if len(self.names) + len(new) > self.room:
                self.names, self.values = names, values
            else:
                every = np.append(self.names, names[new])
                order = np.argsort(every)
                self.names, self.values = every[order], np.append(self.values, values[new])[order]
        return values[inverse]


def leanings(m: Model, shares: Shares, texts: pa.Array) -> np.ndarray:
    """The difference of the classes' scores of each text."""
    w = Words(texts)
    own = np.repeat(np.arange(len(w.count)), w.count)
    words = np.bincount(own, shares.of(w), len(w.count)) / np.maximum(1, w.count)
    inside = np.flatnonzero(own[1:] == own[:-1])
    two = np.bincount(own[inside], shares.lean[pairs(w.names)[inside]], len(w.count)) / np.maximum(1, w.count - 1)
    return words + two + (m.bias[1] - m.bias[0])


def score(docs: DataFrame, model: Model | None, room: int = 1_000_000) -> DataFrame:
    """doc_id, score, predicted for each row of docs(doc_id, text); other columns aren't read.

    Null and empty texts have the score of the bias alone, and everything has 0.5 without a model. Equal texts have equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model and Model(model.vectors.astype(np.float32), model.weight, model.bias))

    def run(batches):
        m = shared.value
        shares = m and Shares(m.lean, room)
        for b in slices(batches, SCORE_BYTES):
            x = leanings(m, shares, b.column("text")) if m else np.zeros(b.num_rows)
            out = (1 / (1 + np.exp(-np.clip(x, -500, 500)))).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted, learning from labels of rows whose crc32(doc_id) mod `folds` isn't `held`."""
    out = score(docs, train(docs, labels.where(by_text_rule(folds) != held)))
    return out.select("doc_id", (by_text_rule(folds) == held).alias("held_out"), "score", "predicted")
