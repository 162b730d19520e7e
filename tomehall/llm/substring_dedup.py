"""Removal of repeated word windows, found by recompression.

Every word gets a 64-bit name. A round of recompression names maximal runs of one symbol, then pairs of
a left and a right symbol (which of the two a symbol is follows from its name). Names are functions of
what they stand for, so all tasks name alike, and equal substrings get equal symbols except near their
ends. Each symbol carries its context: the words on which its existence depends. A window holds a symbol
safely if it holds the context; then every equal window holds the same symbol at the same place.

Each window is stood for by the smallest of its safe symbols. Symbols (with their contexts' words) that
occur in one document alone rule out their windows; the windows of shared symbols, and the windows that
hold no safe symbol, are compared word by word through 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import compress as compress_list

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, grams, inverse, mix, on_texts, pair, powers, raw

NONE = U64(0xFFFFFFFFFFFFFFFF)


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all words, with a wall before the first text and after each; the walls; each text's first place."""
    words = Words(texts)
    n = words.count
    first = np.cumsum(n + 1) - n  # a wall at 0, then one after each text
    total = int(n.sum()) + len(n) + 1
    wall = np.zeros(total, bool)
    wall[0] = True
    wall[first + n] = True
    names = np.zeros(total, U64)
    names[~wall] = words.names
    return names, wall, first


def compress(names, low, high, wall, salt: int):
    """One round: runs, then pairs. low and high bound the words that a symbol depends on."""
    n = len(names)
    new = np.ones(n, bool)
    new[1:] = (names[1:] != names[:-1]) | wall[1:] | wall[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, n))
    names = np.where(times > 1, pair(names[at], times.astype(U64), salt), names[at])
    low, high, wall = low[np.maximum(at - 1, 0)], high[np.minimum(at + times, n - 1)], wall[at]  # a run ends where another symbol stands
    n = len(names)
    left = (mix(names ^ U64(salt)) >> U64(63)).astype(bool)
    joined = np.zeros(n, bool)
    joined[:-1] = left[:-1] & ~left[1:] & ~wall[:-1] & ~wall[1:]
    kept = np.ones(n, bool)
    kept[1:] = ~joined[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    named = np.where(joined, pair(names, names[after], salt + 1), names)
    # a pair depends on both; a left symbol alone on what follows it; a right one on what stands before
    lower, higher = np.where(left, low, low[before]), np.where(left, high[after], high)
    return named[kept], lower[kept], higher[kept], wall[kept]


def anchors(names: np.ndarray, wall: np.ndarray, window: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each window's first place: the name that stands for it (NONE: no safe symbol), and whether a window starts there."""
    n = len(names)
    at = np.arange(n)
    symbols, low, high, walls = names, at, at + 1, wall
    for k in range(rounds):
        symbols, low, high, walls = compress(symbols, low, high, walls, 17 + 10 * k)
    safe = ~walls & (high - low <= window)
    symbols, low, high = symbols[safe], low[safe], high[safe]
    # the words of the context, by sums of powers; then one name with the symbol's
    total = np.zeros(n + 1, U64)
    np.cumsum(names * powers(n)[:n], out=total[1:])
    key = pair((total[high] - total[low]) * inverse(n)[low], symbols + (high - low).astype(U64), 5)
    key = np.minimum(key, NONE - U64(1))
    best = np.full(n, NONE)
    for k in range(window):
        start = high - window + k
        ok = (start <= low) & (start >= 0)
        if not ok.any():
            break
        np.minimum.at(best, start[ok], key[ok])
    walls_up_to = np.concatenate([[0], np.cumsum(wall)])
    starts = np.zeros(n, bool)
    if n >= window:
        starts[: n - window + 1] = walls_up_to[window:] == walls_up_to[:-window]
    return best, starts


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def of_rows(docs: pa.RecordBatch, first: np.ndarray, total: int) -> np.ndarray:
    """For each place the id of its text; rows without an id have been left out."""
    own = np.zeros(total, np.int64)
    if len(first):
        own[first[0] :] = np.repeat(np.asarray(docs.column("doc_id"), np.int64), np.diff(np.append(first, total)))
    return own


def stretches(best: np.ndarray, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where windows start, and which of these begin a stretch of one document's neighbours with one name."""
    at = np.flatnonzero(starts)
    key, doc = best[at], own[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return at, new


def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def once(*keys: np.ndarray) -> np.ndarray:
    """Places of the first of equal rows, the last key varying slowest."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order[new]


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text left) for each row of docs(doc_id, text).

    A word goes if a window of `window` words covers it whose word sequence also starts in a document of a
    smaller doc_id. Words are runs of bytes other than ASCII white space; a null or empty text has none. Rows of one
    doc_id are one document to each other: none of them is the earlier one. A null doc_id is never
    earlier or later than another: its rows keep all words. Other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "repeats")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    real = whole.where("doc_id is not null and text is not null")

    def spans(b: pa.RecordBatch) -> pa.RecordBatch:
        """Each symbol with the smallest and the largest document that it stands in."""
        names, wall, first = laid_out(b.column("text"))
        best, starts = anchors(names, wall, window)
        own = of_rows(b, first, len(names))
        at, new = stretches(best, starts & (best != NONE), own)
        key, own = best[at[new]], own[at[new]]
        order = np.lexsort((own, key))
        key, own = key[order], own[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        return rows(symbol=signed(key[at]), least=own[at], most=own[np.append(at[1:], len(key)) - 1] if len(at) else own)

    spanned = on_texts(real, spans, "symbol long, least long, most long")
    shared = scratch.keep(spanned.groupBy("symbol").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("symbol").union(docs.sparkSession.range(1).select(F.lit(-1).cast("long"))), "shared")  # NONE counts as shared

    def uses(b: pa.RecordBatch) -> pa.RecordBatch:
        """Each document's symbols; NONE if a window of its has none."""
        names, wall, first = laid_out(b.column("text"))
        best, starts = anchors(names, wall, window)
        own = of_rows(b, first, len(names))
        at, new = stretches(best, starts, own)
        key, own = best[at[new]], own[at[new]]
        at = once(key, own)
        key, own = key[at], own[at]
        return rows(symbol=signed(key), doc_id=own)

    used = on_texts(real, uses, "symbol long, doc_id long")
    asked = used.join(shared.hint("shuffle_hash"), "symbol")
    asked = scratch.keep(asked.groupBy("doc_id").agg(F.collect_list("symbol").alias("symbols")), "asked")
    inspected = scratch.keep(real.join(asked.hint("shuffle_hash"), "doc_id"), "inspected")
    scratch.drop("shared", "asked")

    def windows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit hashes and documents of the windows that stay in question."""
        names, wall, first = laid_out(b.column("text"))
        best, starts = anchors(names, wall, window)
        own = of_rows(b, first, len(names))
        lists = b.column("symbols")
        flat, ends = np.asarray(lists.flatten()).view(U64), np.asarray(lists.offsets)
        row = np.zeros(len(names), np.int64)
        row[first[0] :] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(names))))
        at, new = stretches(best, starts, row)
        head = at[new]
        live = best[head] == NONE
        if len(flat) and len(head):  # of each document its own symbols: places of (document's row, symbol)
            theirs = np.sort(pair(flat, np.repeat(np.arange(len(ends) - 1), np.diff(ends)).astype(U64), 9))
            mine = pair(best[head], row[head].astype(U64), 9)
            live |= theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine
        at = at[np.repeat(live, np.diff(np.append(np.flatnonzero(new), len(at))))]
        return grams(names, window, 101)[at], grams(names, window, 202)[at], own[at]

    def earliest(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, own = windows(b)
        order = np.lexsort((own, h2, h1))
        h1, h2, own = h1[order], h2[order], own[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) if len(h1) else np.empty(0, bool)
        at = np.flatnonzero(new)
        return rows(h1=signed(h1[at]), h2=signed(h2[at]), least=own[at], most=own[np.append(at[1:], len(h1)) - 1] if len(at) else own)

    found = on_texts(inspected, earliest, "h1 long, h2 long, least long, most long")
    repeated = scratch.keep(found.groupBy("h1", "h2").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("h1", "h2", "least"), "repeated")

    def again(b: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, own = windows(b)
        at = once(h2, h1, own)
        return rows(h1=signed(h1[at]), h2=signed(h2[at]), doc_id=own[at])

    later = on_texts(inspected, again, "h1 long, h2 long, doc_id long").join(repeated.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id > least")
    gone = scratch.keep(later.groupBy("doc_id").agg(F.collect_list("h1").alias("gone")), "gone")
    scratch.drop("inspected", "repeated")

    def left(b: pa.RecordBatch) -> pa.RecordBatch:
        names, wall, first = laid_out(b.column("text"))
        n = np.diff(np.append(first, len(names))) - 1
        stays = np.ones(len(names), bool)
        lists = b.column("gone")
        flat = np.asarray(lists.flatten()).view(U64)
        if len(flat) and len(names) >= window:
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            theirs = np.sort(pair(flat, np.repeat(np.arange(len(size)), size).astype(U64), 9))
            row = np.repeat(np.arange(len(n)), n + 1)
            at = np.flatnonzero(np.append(np.zeros(first[0], bool), (size > 0)[row])[: len(names) - window + 1])
            mine = pair(grams(names, window, 101)[at], row[at - first[0]].astype(U64), 9)
            hit = at[theirs[np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)] == mine]
            edge = np.bincount(hit, minlength=len(names) + 1) - np.bincount(hit + window, minlength=len(names) + 1)
            stays = np.cumsum(edge)[: len(names)] <= 0
        out = []
        for text, k, m in zip(raw(b), first.tolist(), n.tolist(), strict=True):
            words, own = text.split() if text else [], stays[k : k + m]
            kept = words if own.all() else list(compress_list(words, own.tolist()))
            joined = b" ".join(kept)
            out.append((m, m - len(kept), hashlib.sha256(joined).hexdigest(), joined))
        m, less, sha, kept = zip(*out, strict=True)
        return rows(doc_id=b.column("doc_id"), n_words=pa.array(m, pa.int64()), n_removed=pa.array(less, pa.int64()), kept_sha256=pa.array(sha), kept=pa.array(kept, pa.binary()).cast(pa.string()))

    return on_texts(whole.join(gone.hint("shuffle_hash"), "doc_id", "left"), left, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
