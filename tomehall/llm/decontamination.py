"""Benchmark passages in documents, found by spaced seeds and verified around each hit.

A seed looks at some of `span` consecutive tokens and ignores the others by a fixed mask, so a replaced
token still lets those seeds match that ignore it. Seeds of the benchmark and of the documents meet by
hash; a hit fixes how the two texts lie against each other, a diagonal, and the stretches that agree in most places are then
found along it. A benchmark of one block is broadcast; the seeds of a larger one are joined, and documents are read once all the same.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, grams, mix, slices

#: Places of tokens that a seed reads (1) or ignores (0); the first reads adjacent tokens, the others leave room for a replaced one.
MASKS = ("111111", "11011011", "10101111", "11100111")
#: Items of fewer tokens than seeds can judge are compared as they stand; under VERBATIM, only with whole documents.
SEEDED, VERBATIM = 8, 5
#: Pairs of equal seeds that are laid out at once.
AT_ONCE = 2_000_000


def seeds(names: np.ndarray, masks: tuple[str, ...] = MASKS) -> list[np.ndarray]:
    """For each mask a hash of the tokens it reads from each place on."""
    out = []
    for k, mask in enumerate(masks):
        n = len(names) - len(mask) + 1
        total = np.zeros(max(n, 0), U64)
        if n > 0:
            for i, c in enumerate(mask):
                if c == "1":
                    total += names[i : i + n] * U64((0x9E3779B97F4A7C15 * (2 * i + 1) + k) & 0xFFFFFFFFFFFFFFFF | 1)
            total = mix(total)
        out.append(total)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words, ASCII capitals lowered, and how many each text has."""
    w = Words(texts, lower=True)
    return w.names, w.count


def keyed(names: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """seeds(), told apart by mask."""
    return [s + U64(m) for m, s in enumerate(seeds(names, masks))]


def verbatim(names: np.ndarray, n: int) -> np.ndarray:
    """Names of each n adjacent tokens, apart from all seeds."""
    return mix(grams(names, n, 7_000 + n) + U64(n)) if n > 1 else mix(names + U64(1))


def diagonals(q: np.ndarray, p: np.ndarray, n: int, m: int) -> np.ndarray:
    """Distinct q - p of places in texts of n and m tokens: listed, or by a correlation where the list is longer than that."""
    if len(q) * len(p) <= 16 * (n + m):
        return np.unique(q[:, None] - p[None, :])
    size = 1 << int(n + m).bit_length()
    x, y = np.zeros(size), np.zeros(size)
    x[q], y[p] = 1, 1
    both = np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), size) > 0.5
    at = np.flatnonzero(both)
    return np.sort(np.where(at >= n, at - size, at))


class Index:
    """Seeds of a block of benchmark items, with a bit table in front."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...]):
        self.masks = masks
        self.ids = pa.array([i for i, _ in items], pa.int64())
        self.names, count = tokens(pa.array([t for _, t in items], pa.string()))
        self.first = np.cumsum(count) - count
        self.last = self.first + count
        keys, items_, places = [], [], []
        for k in np.flatnonzero(count >= SEEDED).tolist():
            for s in keyed(self.names[self.first[k] : self.last[k]], masks):
                keys.append(s)
                items_.append(np.full(len(s), k))
                places.append(np.arange(len(s)))
        key = np.concatenate(keys) if keys else np.empty(0, U64)
        order = np.argsort(key, kind="stable")
        self.key, self.item, self.place = key[order], np.concatenate(items_ or [order])[order], np.concatenate(places or [order])[order]
        self.bits = np.zeros(1 << self.BITS, bool)
        self.bits[(self.key >> U64(64 - self.BITS)).astype(np.int64)] = True
        self.short: dict[int, dict[int, list[int]]] = {}  # items under SEEDED tokens by length, then by name
        for k in np.flatnonzero((count > 0) & (count < SEEDED)).tolist():
            n = int(count[k])
            self.short.setdefault(n, {}).setdefault(int(verbatim(self.of(k), n)[0]), []).append(k)

    def of(self, item: int) -> np.ndarray:
        return self.names[self.first[item] : self.last[item]]

    def hits(self, names: np.ndarray, first: np.ndarray, last: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """For each text and item with seeds in common the diagonals that these lie on."""
        found: list[np.ndarray] = []
        heavy: dict[tuple[int, int], list[np.ndarray]] = {}
        for m, s in enumerate(keyed(names, self.masks)):
            at = np.flatnonzero(self.bits[(s >> U64(64 - self.BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            doc = np.searchsorted(last, at, side="right")
            ok = (hi > lo) & (at + len(self.masks[m]) <= last[np.minimum(doc, len(last) - 1)])
            at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
            n = hi - lo
            total = np.bincount(doc, n, len(first))
            many = total[doc] > AT_ONCE
            for d in np.unique(doc[many]).tolist():  # equal seeds at many places: by seed and item
                mine = doc == d
                for a in np.unique(lo[mine]).tolist():
                    here = mine & (lo == a)
                    q = at[here] - first[d]
                    item, place = self.item[a : hi[here][0]], self.place[a : hi[here][0]]
                    for i in np.unique(item).tolist():
                        heavy.setdefault((d, i), []).append(diagonals(q, place[item == i], int(last[d] - first[d]), len(self.of(i))))
            at, lo, n, doc = at[~many], lo[~many], n[~many], doc[~many]
            for x, y in runs(n, AT_ONCE):
                k = np.repeat(lo[x:y], n[x:y]) + np.arange(n[x:y].sum()) - np.repeat(np.cumsum(n[x:y]) - n[x:y], n[x:y])
                found.append(np.unique(np.stack([np.repeat(doc[x:y], n[x:y]), self.item[k], np.repeat((at - first[doc])[x:y], n[x:y]) - self.place[k]], axis=1), axis=0))
        out: dict[tuple[int, int], np.ndarray] = {}
        if found and sum(map(len, found)):
            every = np.unique(np.concatenate(found), axis=0)
            new = np.flatnonzero(np.append(True, np.any(every[1:, :2] != every[:-1, :2], axis=1)))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(every)], strict=True):
                out[int(every[a, 0]), int(every[a, 1])] = every[a:b, 2]
        for pair, shifts in heavy.items():
            out[pair] = np.unique(np.concatenate([*shifts, out.get(pair, shifts[0])]))
        return out

    def whole(self, names: np.ndarray) -> list[tuple[int, int, int]]:
        """item, begin, end of the short items that stand in a text as they are, longest first, none of one item overlapping."""
        out = []
        for n, known in sorted(self.short.items(), reverse=True):
            if n >= VERBATIM and len(names) >= n or n == len(names):
                free: dict[int, int] = {}
                here = verbatim(names, n)
                wanted = np.fromiter(known, U64, len(known))
                for begin in np.flatnonzero(np.isin(here, wanted)).tolist():
                    for i in known[int(here[begin])]:
                        if begin >= free.get(i, 0):
                            free[i] = begin + n
                            out.append((i, begin, begin + n))
        return out


def runs(n: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of consecutive entries whose sums are about `most`."""
    if not len(n):
        return []
    part = (np.cumsum(n) - n) // most
    cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    return list(zip(cut, [*cut[1:], len(n)], strict=True))


def stretches(same: np.ndarray, least: int, share: float) -> list[tuple[int, int]]:
    """Begin and end of the longest stretches of at least `least` places of which `share` agree, none overlapping, longest first within what is left.

    A stretch begins and ends on agreeing places, unless it has just `least`."""
    found, open_ = [], [(0, len(same))]
    while open_:
        lo, hi = open_.pop()
        n = hi - lo
        if n < least:
            continue
        m = same[lo:hi]
        agree = np.concatenate([[0], np.cumsum(m)])
        over = agree - share * np.arange(n + 1) + 1e-9 * np.arange(n + 1)  # a stretch reaches the share where this doesn't fall
        begin, end = 0, 0
        ends = np.flatnonzero(m) + 1
        if len(ends):
            # for each end the first beginning that isn't above it
            low = np.minimum.accumulate(np.where(m, over[:-1], np.inf))
            at = np.minimum(np.searchsorted(-low, -over[ends], "left"), n - 1)
            size = np.where(low[at] <= over[ends], ends - at, 0)
            k = int(np.argmax(size))
            begin, end = int(at[k]), int(ends[k])
        if end - begin < least:
            window = agree[least:] - agree[:-least]
            begin = int(np.argmax(window))
            end = begin + least
            if over[end] < over[begin]:
                continue
        found.append((lo + begin, lo + end))
        open_ += [(lo, lo + begin), (lo + end, hi)]
    return found


def agreed(x: np.ndarray, y: np.ndarray, shifts: np.ndarray, least: int, share: float) -> list[tuple[int, int, int]]:
    """begin, end and agreeing tokens of the passages of y in x along the diagonals, none overlapping in x: the longest first, the others in what it leaves.

    An item of fewer than `least` tokens counts where all of it lies in x, whichever tokens agree."""
    if len(y) < least:
        inside = shifts[(shifts >= 0) & (shifts + len(y) <= len(x))]
        same = [(int(k), int((x[k : k + len(y)] == y).sum())) for k in inside.tolist()]
        out = []
        for k, agree in sorted(same, key=lambda s: (-s[1], s[0])):
            if agree >= share * len(y) - 1e-9 and all(k + len(y) <= a or k >= b for a, b, _ in out):
                out.append((k, k + len(y), agree))
        return sorted(out)
    free = [(0, len(x))]  # what no passage covers yet
    taken: list[tuple[int, int, int]] = []

    def room(lo: int, hi: int) -> int:
        return max((min(b, hi) - max(a, lo) for a, b in free), default=0)

    # the longest passage that a diagonal may still give, where it may begin, and the passage once it is known
    queue: list = [(-(min(len(x), len(y) + k) - max(0, k)), max(0, k), k, None) for k in shifts.tolist()]
    heapq.heapify(queue)
    while queue:
        size, begin, k, known = heapq.heappop(queue)
        lo, hi = max(0, k), min(len(x), len(y) + k)
        if known and any(a <= known[0] and known[1] <= b for a, b in free):
            taken.append(known)
            free = [c for a, b in free for c in ((a, min(b, known[0])), (max(a, known[1]), b)) if c[1] - c[0] >= least]
            known = None
        left = room(lo, hi)
        if left < least:
            continue
        if left < -size and known is None:
            heapq.heappush(queue, (-left, begin, k, None))
            continue
        best = None
        for a, b in free:
            a, b = max(a, lo), min(b, hi)
            if b - a >= least:
                same = x[a:b] == y[a - k : b - k]
                for c, d in stretches(same, least, share)[:1]:
                    if best is None or d - c > best[1] - best[0]:
                        best = (a + c, a + d, int(same[c:d].sum()))
        if best:
            heapq.heappush(queue, (best[0] - best[1], best[0], k, best))
    return sorted(taken)


FOUND = "item_id long, begin long, end long, tokens long, agreeing long"


def found_rows(column: str, ids: pa.Array, rows: list[tuple[int, int | None, int, int, int]]) -> pa.RecordBatch:
    """rows: place of the id, item, begin, end, agreeing."""
    at, item, begin, end, agree = zip(*rows, strict=True)
    columns = [ids.take(pa.array(at)), *(pa.array(c, pa.int64()) for c in (item, begin, end, [b - a for a, b in zip(begin, end, strict=True)], agree))]
    return pa.RecordBatch.from_arrays(columns, names=[column, "item_id", "begin", "end", "tokens", "agreeing"])


def by_index(docs: DataFrame, index, least: int, share: float) -> DataFrame:
    """Passages of the items of a broadcast index."""

    def run(batches):
        block = index.value
        for b in slices(batches):
            names, count = tokens(b.column("text"))
            last = np.cumsum(count)
            first = last - count
            rows = []
            for (d, i), shifts in block.hits(names, first, last).items():
                rows += [(d, block.ids[i].as_py(), *p) for p in agreed(names[first[d] : last[d]], block.of(i), shifts, least, share)]
            if block.short:
                for d in range(b.num_rows):
                    rows += [(d, block.ids[i].as_py(), x, y, y - x) for i, x, y in block.whole(names[first[d] : last[d]])]
            if rows:
                yield found_rows("doc_id", b.column("doc_id"), sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2])))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {FOUND}")


def by_join(docs: DataFrame, items: DataFrame, masks: tuple[str, ...], least: int, share: float, most_bits: int = 1 << 29) -> DataFrame:
    """Passages of items of any number: documents are read once, with a broadcast bit table of all seeds, and what may be a hit is joined with the items' seeds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontamination")
    items = scratch.keep(items.select(F.monotonically_increasing_id().alias("iid"), "item_id", "text"), "items")

    def seeded(batches):
        for b in slices(batches):
            names, count = tokens(b.column("text"))
            last = np.cumsum(count)
            for iid, f, e in zip(b.column("iid").to_pylist(), (last - count).tolist(), last.tolist(), strict=True):
                x = names[f:e]
                hashes = keyed(x, masks) if len(x) >= SEEDED else [verbatim(x, len(x))] if len(x) else []
                for s in hashes:
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), iid)), pa.array(np.arange(len(s)))], names=["seed", "iid", "place"])

    known = scratch.keep(items.mapInArrow(seeded, "seed long, iid long, place long"), "seeds")
    bits = 1 << 16
    while bits < most_bits and bits < 16 * known.count():
        bits *= 2
    slot = F.pmod("seed", F.lit(bits))
    table = known.groupBy((slot / 64).cast("long").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(seed, {bits}) % 64 as int))")).alias("mask")).toArrow()
    filled = np.zeros(bits // 64, np.int64)
    filled[np.asarray(table.column("word"))] = np.asarray(table.column("mask"))
    shared = spark.sparkContext.broadcast(filled.view(U64))
    lengths = [n for n in range(1, SEEDED)]

    def near(batches):
        words = shared.value

        def there(s):
            k = s % U64(bits)
            return words[(k >> U64(6)).astype(np.int64)] >> (k & U64(63)) & U64(1) == 1

        for b in slices(batches):
            names, count = tokens(b.column("text"))
            last = np.cumsum(count)
            out = []
            for d, (f, e) in enumerate(zip((last - count).tolist(), last.tolist(), strict=True)):
                x = names[f:e]
                every = [*keyed(x, masks), *(verbatim(x, n) for n in lengths if n >= VERBATIM and len(x) >= n or n == len(x))]
                at = [np.flatnonzero(there(s)) for s in every]
                hit = np.concatenate([s[k] for s, k in zip(every, at, strict=True)])
                if len(hit):
                    out.append((d, hit.view(np.int64), np.concatenate(at)))
            if out:
                rows = b.take(pa.array([d for d, *_ in out]))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("text"), pa.array([h for _, h, _ in out], pa.list_(pa.int64())), pa.array([p for *_, p in out], pa.list_(pa.int64()))], names=["doc_id", "text", "seeds", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("text is not null").select("doc_id", "text").mapInArrow(near, f"doc_id {kind}, text string, seeds array<long>, places array<long>")
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "near")
    spots = rows.select("rid", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("rid", F.col("s.seeds").alias("seed"), F.col("s.places").alias("at"))
    hits = spots.join(known, "seed").select("rid", "iid", (F.col("at") - F.col("place")).alias("shift")).groupBy("rid", "iid").agg(F.collect_set("shift").alias("shifts"))
    pairs = hits.join(items.select("iid", "item_id", F.col("text").alias("item")), "iid").join(rows.select("rid", "doc_id", "text"), "rid").select("doc_id", "text", "item_id", "item", "shifts")

    def verify(batches):
        for b in slices(batches):
            out = []
            for d, (one, two, shifts, item) in enumerate(zip(b.column("text"), b.column("item"), b.column("shifts"), b.column("item_id"), strict=True)):
                (x, _), (y, _) = (tokens(pa.array([t.as_py()], pa.string())) for t in (one, two))
                at = np.sort(np.asarray(shifts.values))
                if len(y) >= SEEDED:
                    out += [(d, item.as_py(), *p) for p in agreed(x, y, at, least, share)]
                else:
                    free = 0
                    for k in at.tolist():
                        if k >= free and 0 <= k <= len(x) - len(y) and (x[k : k + len(y)] == y).all() and (len(y) >= VERBATIM or len(x) == len(y)):
                            free = k + len(y)
                            out.append((d, item.as_py(), k, free, len(y)))
            if out:
                yield found_rows("doc_id", b.column("doc_id"), out)

    return pairs.mapInArrow(verify, f"doc_id {kind}, {FOUND}")


def passages(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8, block: int = 400_000, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """doc_id, item_id, begin, end, tokens, agreeing: each document's passages of benchmark items.

    begin and end count the document's tokens (lower-cased words). A passage spans at least `least` tokens of which `share` agree, on a diagonal that a
    seed hits; the longest is given first, then those that lie in what it leaves. An item of 8 to `least` tokens
    counts as a whole, its edges too. Shorter ones must stand word for word: of 5 tokens and more anywhere, of fewer as a whole
    document. Null or empty texts, on either side, have no passages; repeated rows
    give repeated passages; equal rows of one item_id count as one item; a null doc_id or item_id is kept as a null.
    Other columns are ignored.

    A benchmark of at most `block` tokens is broadcast; the seeds of a larger one are joined. Documents are read once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    size = items.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")).cast("long"))).first()[0] or 0
    if size > block:
        return by_join(docs, items, masks, least, share)
    rows = items.orderBy("item_id", "text").collect()  # at most `block` tokens
    return by_index(docs, docs.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], masks)), least, share)


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, passages, tokens, agreeing: a row for each document and item that share a passage; see passages()."""
    return passages(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("passages"), F.max("tokens").alias("tokens"), F.max("agreeing").alias("agreeing"))
