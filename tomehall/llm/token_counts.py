"""Token counts without a shuffle of pre-tokens: a broadcast table of frequent ones, worker caches for the rest."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .pretokens import LONGEST, PATTERN, PreTokens, parts


def frequent(docs: DataFrame, tokenizer: str, size: int, summary: int = 8192, room: int = 200_000) -> list[str]:
    """The `size` most frequent pre-tokens, by bounded summaries of all texts.

    Each task counts its pre-tokens in a table of `room` entries, halved by count when full, and gives its
    `summary` largest; only these summaries are exchanged. An entry that a summary misses costs a later
    lookup in a worker's cache, never a result."""

    def run(batches):
        worker = PreTokens(tokenizer)
        pieces: Counter[str] = Counter()
        counts: Counter[str] = Counter()

        def cut():
            for p, n in pieces.items():
                for t in PATTERN.findall(p):
                    counts[t] += n
            pieces.clear()

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if text and worker.told(text):
                    pieces.update(parts(text))
            if len(pieces) > room:
                cut()
            if len(counts) > room:
                counts = Counter(dict(counts.most_common(room // 2)))
        cut()
        top = [(p, c) for p, c in counts.most_common(summary) if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], names=["token", "times"])

    seen = docs.select("text").mapInArrow(run, "token string, times long").groupBy("token").agg(F.sum("times").alias("times"))
    return [r.token for r in seen.orderBy(F.desc("times"), "token").limit(size).collect()]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, size: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text).

    `size` bounds the broadcast table: so many pre-tokens of at most 64 characters. Null texts count as
    empty (0 bytes, 0 tokens); repeated rows give repeated rows; a null doc_id stays null; other columns are ignored;
    an empty table gives an empty one."""
    known = {}
    if found := frequent(docs, tokenizer, size):
        encoder = PreTokens(tokenizer)
        known = {p: encoder.encode(p) for p in found}
    table = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        worker = PreTokens(tokenizer, table.value)
        for piece in slices(batches):
            texts = piece.column("text")
            n = [worker.count(t or "") for t in texts.to_pylist()]
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
