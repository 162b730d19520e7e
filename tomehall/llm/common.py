"""What the operators of this subpackage share: scratch tables, slices of Arrow batches, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import remove, scratch

#: Bytes of text that one numpy pass works on; longer texts make a slice of their own.
SLICE_BYTES = 400_000

U64 = np.uint64

#: While a scratch table is written: its shuffle files go as soon as it is there, as nothing reads them again; Python workers get smaller batches; and
#: sides of joins whose size Spark only guesses aren't brought to the driver, which has to build what it broadcasts, in a thread of its own for each.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WRITING = {
    CLEANUP: "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_lock, _writers, _before = threading.Lock(), 0, {}


@contextlib.contextmanager
def writing(spark: SparkSession, small: bool):
    """WRITING while any scratch table is written; the last writer puts back what was set before the first. A small table's shuffle files wait for the driver's
    garbage collection, as each that goes at once takes threads of the driver."""
    global _writers
    with _lock:
        if not _writers:
            _before.update({k: spark.conf.get(k, None) for k in WRITING})
        _writers += 1
        for k, v in (WRITING | ({CLEANUP: "false"} if small else {})).items():
            spark.conf.set(k, v)
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            for k, v in _before.items() if not _writers else ():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables written to the folder that driver and executors share, so that later stages outlive a lost executor. What a result reads goes when Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch(spark, label)

    def keep(self, df: DataFrame, name: str, by: str | None = None, small: bool = False) -> DataFrame:
        """Writes the table, in a folder for each value of `by`, and reads it back; frees the shuffle files that it needed, at once unless `small` says that they hold a few numbers a row."""
        path = f"{self.root}/{name}"
        out = df.write.option("compression", "zstd")
        with writing(self.spark, small):
            (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, f"{self.root}/{name}")


def rest() -> None:
    """Gives memory that a worker doesn't use back to the system; workers stay for later tasks, and executors hold several."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a C library that can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `limit` bytes of column `text`; a row is never cut. Ends a task's reading."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64)
        piece = (np.cumsum(size) - size) // limit
        cut = np.flatnonzero(np.diff(piece, prepend=piece[0])).tolist()
        for a, b in zip([0, *cut], [*cut, n], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
    rest()


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of each text."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def on_texts(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """f over slices of the rows."""

    def run(batches):
        for piece in slices(batches):
            out = f(piece)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A name for the ordered pair (a, b)."""
    return mix(a * U64(0x9E3779B97F4A7C15) + (b ^ U64(salt)) * U64(0xD1B54A32D192ED03) + U64(salt))


#: ASCII white space, by byte.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number for each byte; names of words are sums of these times powers, so they follow from the bytes alone.
BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
BASE = 0x2545F4914F6CDD1B
#: Longer words are hashed one by one: sums of powers tell very long strings apart less well.
LONG_WORD = 64
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """1, base, base^2 ... modulo 2^64, n of them at least."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, SLICE_BYTES), base & (1 << 64) - 1, U64)]), dtype=U64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = got
    return got


def inverse(n: int, base: int = BASE) -> np.ndarray:
    return powers(n, pow(base, -1, 1 << 64))


class Words:
    """The words of a column of texts, runs of bytes other than ASCII white space, without a Python object for each.

    names: a 64-bit name of each; start, end: its bytes in data; count: words of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        filled = ~SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.ones(n, bool)
        before[1:] = ~filled[:-1]
        self.start = np.flatnonzero(filled & (before | cut[:n]))
        after = np.ones(n, bool)
        after[:-1] = ~filled[1:]
        self.end = np.flatnonzero(filled & (after | cut[1:])) + 1
        self.count = np.diff(np.searchsorted(self.start, self.offsets))
        total = np.zeros(n + 1, U64)
        np.cumsum((BYTE_LOWER if lower else BYTE)[self.data] * powers(n)[:n], out=total[1:])
        size = self.end - self.start
        self.names = mix((total[self.end] - total[self.start]) * inverse(n)[self.start] + size.astype(U64))
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            word = self.data[self.start[k] : self.end[k]].tobytes()
            self.names[k] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))


def grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each n consecutive entries."""
    if len(h) < n:
        return np.empty(0, U64)
    out, width = None, 0
    power, size, left = h, 1, n
    while left:  # binary powers of the window, joined from the left
        if left & 1:
            if out is None:
                out, width = power, size
            else:
                m = len(power) - width
                out, width = pair(out[:m], power[width:], salt + width), width + size
        left >>= 1
        if left:
            power, size = pair(power[:-size], power[size:], salt + 1000 + size), size * 2
    return out[: len(h) - n + 1]


def squeezed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first bytes first, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def released(blob: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).view(kind).reshape(len(flat) // size)


def by_text_rule(mod: int, column: str = "doc_id"):
    """crc32 of the id's decimal text, modulo `mod`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod)
