"""Best-fit packing by length patterns: repeat counts fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices
from .pretokens import Encoder

#: The id that ends each document.
END = b"\0\0\0\0"


def pieces_of(docs: DataFrame, tokenizer: str, room: int) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and `part`, the task that made it."""

    def run(batches):
        from pyspark import TaskContext

        worker, part = Encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in slices(batches):
            at, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = worker.id_bytes(text or "") + END
                n = len(ids) // 4
                first = n % room or room
                for k, start in enumerate([0, *range(first, n, room)]):
                    length = first if k == 0 else room
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            names = ["piece", "start", "length", "ids_crc32", "part", "nth"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def patterns(counts: np.ndarray, room: int, most: int = 20_000) -> list[tuple[int, ...]]:
    """Multisets of one to four lengths that fill a sequence, or nearly, from lengths that occur.

    Their number is bounded by `most`, whatever the number of documents."""
    here = np.flatnonzero(counts)
    found: dict[tuple[int, ...], None] = {}
    weight = counts / max(1, counts.sum())
    alike = np.zeros(room + 1, np.int64)  # the largest length that occurs and isn't longer
    alike[here] = here
    alike = np.maximum.accumulate(alike)

    def add(*lengths):
        if len(found) < most and all(lengths):
            found.setdefault(tuple(sorted(map(int, lengths), reverse=True)))

    for a in here[::-1]:
        if b := alike[room - a]:
            add(a, b)
        else:
            add(a)
    common = here[np.argsort(-weight[here], kind="stable")]
    for b in common[:12]:  # a frequent length as one of three or four
        for a in here[::-1]:
            if (left := room - a - b) > 0 and alike[left]:
                add(a, b, alike[left])
                for c in common[:3]:
                    if left - c > 0 and alike[left - c]:
                        add(a, b, c, alike[left - c])
    return list(found)


def fit(counts: np.ndarray, lists: list[tuple[int, ...]], rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise ||A x - counts||^2, A's columns the patterns' histograms.

    Projected gradient with momentum; A is only ever used through its entries, at most four a column."""
    rows = np.array([l for p in lists for l in p], np.int64)
    cols = np.repeat(np.arange(len(lists)), [len(p) for p in lists])
    x, y, t = np.zeros(len(lists)), np.zeros(len(lists)), 1.0
    along = lambda v: np.bincount(rows, v[cols], len(counts))
    v = np.ones(len(lists))
    for _ in range(20):  # the largest eigenvalue of A'A, for the step
        v = np.bincount(cols, along(v)[rows], len(lists))
        v /= (size := np.linalg.norm(v)) or 1.0
    step = 1 / (size * 1.05 + 1e-9)
    for _ in range(rounds):
        new = np.maximum(0, y - step * np.bincount(cols, (along(y) - counts)[rows], len(lists)))
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (old - 1) / t * (new - x)
        x = new
    return x


def plan(counts: np.ndarray, room: int) -> dict[str, np.ndarray]:
    """Where the n-th piece of each length goes: runs of pieces that stand at the same place of consecutive sequences.

    counts[l] pieces of length l. Patterns are repeated as fitted, rounded, as far as pieces last; what is
    left is packed best-fit, largest first, run by run. Both the time and the size of the plan depend on
    the number of lengths, not of pieces."""
    left = counts.astype(np.int64).copy()
    runs: list[tuple[int, int, int, int, int]] = []  # length, first nth, times, first sequence, offset
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: (first sequence, times)
    used = np.zeros(len(counts), np.int64)
    following = 0

    def put(length, times, sequence):
        nonlocal left
        runs.append((length, int(used[length]), times, sequence[0], sequence[1]))
        used[length] += times
        left[length] -= times

    lists = patterns(counts, room)
    if lists:
        for x, p in sorted(zip(np.rint(fit(counts, lists)).astype(np.int64).tolist(), lists, strict=True), key=lambda z: (room - sum(z[1]), -z[0], z[1])):
            times = min([x, *(int(left[l]) // p.count(l) for l in p)])
            if times > 0:
                offset = 0
                for l in p:
                    put(l, times, (following, offset))
                    offset += l
                if offset < room:
                    gaps[room - offset].append((following, times))
                following += times
    sizes = sorted(gaps)
    for l in np.flatnonzero(left)[::-1].tolist():
        while left[l]:
            k = bisect.bisect_left(sizes, l)
            if k < len(sizes):
                g = sizes[k]
                first, times = gaps[g].pop()
                take = min(times, int(left[l]))
                put(l, take, (first, room - g))
                if times > take:
                    gaps[g].append((first + take, times - take))
                if not gaps[g]:
                    sizes.pop(k)
                rest = g - l
            else:
                per = room // l
                take = max(1, int(left[l]) // per) if left[l] >= per else 1
                n = min(per, int(left[l]))
                for i in range(n):
                    put(l, take, (following, i * l))
                first, rest = following, room - n * l
                following += take
            if rest:
                if rest not in gaps or not gaps[rest]:
                    bisect.insort(sizes, rest)
                gaps[rest].append((first, take))
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {"length": table[:, 0], "nth": table[:, 1], "sequence": table[:, 3], "offset": table[:, 4], "sequences": following}


def pack(docs: DataFrame, tokenizer: str, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text).

    A null text is empty: one piece that holds only the end. Repeated rows are packed each; a null
    doc_id stays null; other columns are ignored; an empty table gives an empty one. A document of more
    than `room` tokens is cut from its end, so its first piece may be shorter."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    made = scratch.keep(pieces_of(docs, tokenizer, room), "pieces")
    # so many pieces of a length in each task; their sums number the pieces without a sort of them
    each = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("times"))
    before = scratch.keep(each.withColumn("before", F.sum("times").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("length", "part", "times", F.coalesce("before", F.lit(0)).alias("before")), "before")
    counts = np.zeros(room + 1, np.int64)
    for r in before.groupBy("length").agg(F.sum("times").alias("times")).collect():  # at most `room` rows
        counts[r["length"]] = r["times"]
    where = spark.sparkContext.broadcast(plan(counts, room))

    def run(batches):
        p = where.value
        key = (p["length"] << 40) + p["nth"]
        for b in batches:
            length, nth = (np.asarray(b.column(c)) for c in ("length", "nth"))
            k = np.searchsorted(key, (length << 40) + nth, side="right") - 1
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(p["sequence"][k] + nth - p["nth"][k], pa.int64()), pa.array(p["offset"][k], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = made.join(before.drop("times"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("nth"))
    return numbered.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
