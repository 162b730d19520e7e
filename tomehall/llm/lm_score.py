"""Context-tree weighting over bytes: code lengths from Krichevsky-Trofimov estimates mixed over all context depths.

A byte is eight binary decisions, so a context has a node for each of the 255 beginnings of the next
byte. Contexts are the bytes before, each told apart: none, one, two ... up to the full depth. A node's weighted
probability is half its own estimate plus half the product of its children's, from the deepest up; given the counts,
this fixes how much each depth adds to every prediction.

The tree grows with the corpus and lies in no one place. Texts are read in sheets; a sheet sends each part of the tree the
distinct pairs (context, next byte) that it has, with their counts in training texts. A part holds all contexts that end on the
same CUT bytes, sums the counts, weighs its nodes and answers each sheet with a code length for each pair. What the
parts' contexts need of those of fewer than CUT bytes, at most 2^16 of them, is summed up and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, by_text_rule, mix, released, rest, slices, squeezed

#: Bits that tell the bytes before apart, from the last one on; a context and the next byte fill 64.
BITS = (8,) * 7
DEPTH = len(BITS)
#: Contexts of fewer bytes are broadcast, at most 2^16 of them; longer ones are dealt out.
CUT = 3
#: Bytes of text for each part that contexts are dealt to, the most parts, and pairs that are weighed at once.
PART_BYTES, MOST_PARTS, CHUNK = 8_000_000, 1024, 200_000
#: Bytes of text that are spelled at once, and of a sheet; distinct pairs of so many make a sheet too.
SPELL_BYTES, SHEET_BYTES, SHEET_PAIRS = 2_000_000, 32_000_000, 8_000_000
#: Ends a text; stands nowhere else in a text as it is read here.
END = 10


def spelled(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as the model reads them, and where each begins: words in lower case with a space between, then an end."""
    read = [b" ".join(t.split()).lower() + b"\n" if t else b"\n" for t in texts.cast(pa.binary()).to_pylist()]
    size = np.array([len(t) for t in read], np.int64)
    return np.frombuffer(b"".join(read), np.uint8), np.cumsum(size) - size


def contexts(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each byte its full context; before a text's first byte stand ends."""
    code = np.zeros(len(data), np.int64)
    for k, bits in enumerate(BITS):
        before = np.full(len(data), END, np.uint8)
        before[k + 1 :] = data[: max(0, len(data) - k - 1)]
        for j in range(1, k + 1):
            at = first + j
            before[at[at < len(data)]] = END  # of a shorter text, the next one's first bytes: ends come before them too
        before[first] = END
        code <<= bits
        code |= before
    return code


def full(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(full context, next byte) at each byte."""
    return contexts(data, first).view(U64) << U64(8) | data


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, from eight up by the recurrence."""
    low = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        low = np.where(small, low + np.log(np.where(small, y, 1.0)), low)
        y = np.where(small, y + 1, y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


#: Logarithms of gamma at n + 1/2 and n + 1, for small counts.
HALVES, WHOLES = (log_gamma(np.arange(4096) + s) for s in (0.5, 1.0))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    n = a + b
    m = np.minimum(n, len(WHOLES) - 1)
    out = HALVES[np.minimum(a, m)] + HALVES[np.minimum(b, m)] - WHOLES[m]
    many = np.flatnonzero(n >= len(WHOLES))
    if len(many):
        x, y = a[many].astype(np.float64), b[many].astype(np.float64)
        out[many] = log_gamma(x + 0.5) + log_gamma(y + 0.5) - log_gamma(x + y + 1)
    return out - 2 * HALVES[0]


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their sums."""
    order = np.argsort(keys)
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(times, new) if len(new) else times


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys in order; sorts the array that it is given, which its caller made for that."""
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def shorter(pairs: np.ndarray) -> np.ndarray:
    """The pairs with the oldest byte of their contexts left out."""
    return pairs >> U64(16) << U64(8) | pairs & U64(255)


@dataclass
class Nodes:
    """The nodes of one depth and level (bits of the next byte that are known), in order of their keys."""

    start: np.ndarray  # each one's first pair
    of: np.ndarray  # each pair's node
    one: np.ndarray  # own prediction of a one
    seen: np.ndarray
    weight: np.ndarray  # logarithm of the weighted probability
    share: np.ndarray  # the own estimate's share of it


@dataclass
class Layer:
    """Contexts of one depth: distinct pairs in order, their training counts, and nodes by level."""

    pairs: np.ndarray
    times: np.ndarray
    nodes: list[Nodes] = field(default_factory=list)
    up: np.ndarray | None = None  # each pair's place in the layer of shorter contexts


def weighed(layer: Layer, children: list[np.ndarray] | None) -> None:
    """Fills in the nodes; children: by level, the sums of the weights of each node's children, none at the full depth."""
    for level in range(8):
        key = layer.pairs >> U64(8 - level)
        new = np.append(True, key[1:] != key[:-1])
        start = np.flatnonzero(new)
        ones = np.where(layer.pairs >> U64(7 - level) & U64(1), layer.times, 0)
        n, b = np.add.reduceat(layer.times, start), np.add.reduceat(ones, start)
        own = estimate(n - b, b)
        weight, share = own, np.ones(len(own))
        if children is not None:
            weight = np.logaddexp(own, children[level]) - np.log(2)
            share = np.exp(own - np.log(2) - weight)
        layer.nodes.append(Nodes(start, np.cumsum(new) - 1, (b + 0.5) / (n + 1), n > 0, weight, share))


def grown(pairs: np.ndarray, times: np.ndarray, deep: int, top: int, children: list[np.ndarray] | None = None) -> list[Layer]:
    """Layers of depths `top` to `deep`, of distinct pairs of `deep` bytes in order; children: as for weighed(), of the deepest."""
    stack: list[Layer] = []
    for depth in range(deep, top - 1, -1):
        if depth < deep:
            last = stack[-1]
            wanted = shorter(last.pairs)
            pairs, times = summed(wanted, last.times)
            last.up = np.searchsorted(pairs, wanted)
        layer = Layer(pairs, times)
        if depth < deep:
            children = []
            for level in range(8):
                above = pairs >> U64(8 - level)
                of = np.cumsum(np.append(True, above[1:] != above[:-1])) - 1
                n = last.nodes[level]
                children.append(np.bincount(of[last.up[n.start]], n.weight, of[-1] + 1))
        weighed(layer, children)
        stack.append(layer)
    return stack[::-1]


#: What a node adds to all that lie below it: their predictions are A + B * theirs; and the prediction if none of them was seen.
Above = tuple[np.ndarray, np.ndarray, np.ndarray]


def lowered(layer: Layer, above: list[Above], parents: list[np.ndarray]) -> list[Above]:
    """By level, A, B and prediction of the layer's nodes; parents: each node's place in `above`."""
    out = []
    for n, (a, b, q), up in zip(layer.nodes, above, parents, strict=True):
        a, b, q = a[up], b[up], q[up]
        own = b * n.one
        out.append((a + own * n.share, b * (1 - n.share), np.where(n.seen, a + own, q)))
    return out


def descended(stack: list[Layer], above: list[Above], parents: list[np.ndarray]) -> list[Above]:
    for k, layer in enumerate(stack):
        if k:
            parents = [p.of[layer.up[n.start]] for p, n in zip(stack[k - 1].nodes, layer.nodes, strict=True)]
        above = lowered(layer, above, parents)
    return above


def keys(layer: Layer, level: int) -> np.ndarray:
    return (layer.pairs >> U64(8 - level))[layer.nodes[level].start]


class Shallow:
    """The depths under CUT: what their nodes add to those below. Without texts there are none."""

    def __init__(self, pairs: np.ndarray, times: np.ndarray, children: list[np.ndarray]):
        stack = grown(pairs, times, CUT - 1, 0, children) if len(pairs) else []
        if stack:
            root = [(np.zeros(1), np.ones(1), np.full(1, 0.5))] * 8
            self.above = descended(stack, root, [np.zeros(len(n.start), np.int64) for n in stack[0].nodes])
            self.keys = [keys(stack[-1], level) for level in range(8)]

    def parents(self, layer: Layer) -> list[np.ndarray]:
        """Places of the parents of a layer of CUT bytes."""
        return [np.searchsorted(self.keys[level], (k := keys(layer, level)) >> U64(level + 8) << U64(level) | k & U64((1 << level) - 1)) for level in range(8)]


def lengths(pairs: np.ndarray, times: np.ndarray, shallow: Shallow) -> np.ndarray:
    """Code length in bits of each of the distinct pairs, which hold all of their contexts of CUT bytes."""
    stack = grown(pairs, times, DEPTH, CUT)
    found = descended(stack, shallow.above, shallow.parents(stack[0]))
    p = np.ones(len(pairs))
    for level, (n, (_, _, q)) in enumerate(zip(stack[-1].nodes, found, strict=True)):
        one = q[n.of]
        p *= np.where(pairs >> U64(7 - level) & U64(1), one, 1 - one)
    return -np.log2(p)


def edge(pairs: np.ndarray, times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What contexts under CUT bytes need of the pairs: by level, keys and sums of the weights of their children; last, pairs and counts."""
    layer = grown(pairs, times, DEPTH, CUT)[0]
    out = []
    for level in range(8):
        k = keys(layer, level)
        k, w = summed(k >> U64(level + 8) << U64(level) | k & U64((1 << level) - 1), layer.nodes[level].weight)
        out.append((k, w, np.zeros(len(k), np.int64)))
    k, n = summed(shorter(layer.pairs), layer.times)
    return [*out, (k, np.zeros(len(k)), n)]


def cuts(pairs: np.ndarray) -> list[int]:
    """Bounds of chunks of about CHUNK pairs, none within a context of CUT bytes."""
    context = pairs >> U64(64 - 8 * CUT)
    begin = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    return np.append(begin[np.flatnonzero(np.diff(begin // CHUNK, prepend=-1))], len(pairs)).tolist()


@dataclass
class Model:
    """A whole tree in one place: counted pairs."""

    pairs: np.ndarray
    times: np.ndarray

    def of(self, asked: np.ndarray) -> np.ndarray:
        """Code lengths of pairs, as the parts make them up."""
        pairs, times = summed(np.concatenate([self.pairs, asked]), np.concatenate([self.times, np.zeros(len(asked), np.int64)]))
        bounds = cuts(pairs)
        chunks = [(pairs[a:b], times[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        edges = [edge(*c) for c in chunks]
        sums = [summed(np.concatenate([e[level][0] for e in edges]), np.concatenate([e[level][1 + level // 8] for e in edges])) for level in range(9)]
        shallow = Shallow(*sums[8], [w for _, w in sums[:8]])
        return np.concatenate([lengths(*c, shallow) for c in chunks])[np.searchsorted(pairs, asked)]

    @property
    def cost(self) -> np.ndarray:
        """For each full context that was seen the code lengths of all bytes."""
        every = np.unique(self.pairs >> U64(8))[:, None] << U64(8) | np.arange(256, dtype=U64)
        return self.of(every.ravel()).reshape(every.shape)

    def bits(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.of(full(data, first))


def weigh(code: np.ndarray, byte: np.ndarray, times: np.ndarray) -> Model:
    return Model(*summed(code.astype(U64) << U64(8) | byte.astype(U64), times.astype(np.int64)))


# ---- dealt out


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    """The part of each pair, by its context's last CUT bytes."""
    return (mix((pairs >> U64(64 - 8 * CUT)) + U64(1)) % U64(parts)).astype(np.int64)


def by_part(pairs: np.ndarray, parts: int):
    """part, places of its pairs, for each part that has some; pairs are in order."""
    context = pairs >> U64(64 - 8 * CUT)
    new = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    to = np.repeat(part_of(pairs[new], parts).astype(np.int16 if parts <= 32_000 else np.int64), np.diff(np.append(new, len(pairs))))
    del context, new
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, order[cut[k] : cut[k + 1]]


def squeezed_keys(x: np.ndarray) -> bytes:
    """Increasing keys, by their steps."""
    return squeezed(np.diff(x, prepend=U64(0)))


def released_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(released(blob, U64), dtype=U64)


PACKED = "kind int, sheet long, part long, a binary, b binary"
HEAD, ASKED, LEARNT, TABLE = 0, 1, 2, -1


def packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "sheet", "part", "a", "b"])


class Counted:
    """Distinct pairs and their training counts, gathered piece by piece."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, pairs: np.ndarray, learnt: np.ndarray) -> None:
        """learnt: which pairs are from training texts."""
        some = pairs[learnt]
        some.sort()
        every = distinct(pairs)
        new = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else np.empty(0, np.int64)
        times = np.zeros(len(every), np.int32)  # of one sheet
        times[np.searchsorted(every, some[new])] = np.diff(np.append(new, len(some)))
        self.put(every, times)

    def put(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.held.append((pairs, times))
        self.size += len(pairs)
        if self.size > max(2_000_000, len(self.held[0][0]) * 3 // 2):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) > 1:
            pairs = distinct(np.concatenate([p for p, _ in self.held]))
            times = np.zeros(len(pairs), self.held[0][1].dtype)
            for p, n in self.held:
                times[np.searchsorted(pairs, p)] += n
            self.held, self.size = [(pairs, times)], len(pairs)
        return self.held[0]


def merged(batches):
    """Each part's pairs with their counts, chunk by chunk."""
    part, counted = None, Counted()

    def out():
        pairs, times = counted.merge()
        bounds = cuts(pairs)
        for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            yield packed_rows([(TABLE, k, part, squeezed_keys(pairs[x:y]), squeezed(times[x:y]))])

    for b in batches:
        for r in b.to_pylist():
            if r["part"] != part and counted.held:
                yield from out()
                counted.clear()
            part = r["part"]
            counted.put(released_keys(r["a"]), released(r["b"], np.int32).astype(np.int64))
    if counted.held:
        yield from out()
    rest()


EDGES = "level int, node long, weight double, times long"


def edges(batches):
    for b in batches:
        for r in b.to_pylist():
            for level, (k, w, n) in enumerate(edge(released_keys(r["a"]), released(r["b"], np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), level, np.int32)), pa.array(k.view(np.int64)), pa.array(w), pa.array(n)], names=["level", "node", "weight", "times"])


def shallow_of(table: DataFrame) -> Shallow:
    """The depths under CUT from all parts' chunks; nodes of at most 2^16 contexts come to the driver."""
    sums = table.select("a", "b").mapInArrow(edges, EDGES).groupBy("level", "node").agg(F.sum("weight").alias("weight"), F.sum("times").alias("times")).toArrow()
    level, node, weight, times = (np.asarray(sums.column(c)) for c in ("level", "node", "weight", "times"))
    at = [np.flatnonzero(level == k) for k in range(9)]
    at = [x[np.argsort(node[x])] for x in at]
    return Shallow(node[at[8]].astype(U64), times[at[8]], [weight[x] for x in at[:8]])


def answered(shallow):
    """A function over one part's rows after another's, chunks before sheets: to each sheet its pairs' code lengths, in their order."""

    def run(batches):
        part, pairs, bits = None, [], []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    part, pairs, bits = r["part"], [], []
                p = released_keys(r["a"])
                if r["kind"] == TABLE:
                    pairs.append(p)
                    bits.append(lengths(p, released(r["b"], np.int64), shallow.value).astype(np.float32))
                else:
                    if len(pairs) > 1:
                        pairs, bits = [np.concatenate(pairs)], [np.concatenate(bits)]
                    yield packed_rows([(ASKED, r["sheet"], part, squeezed(bits[0][np.searchsorted(pairs[0], p)]), None)])
        pairs, bits = [], []
        rest()

    return run


def begins(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def gathered(parts: int):
    """A function over one sheet's rows after another's, texts before answers: the sheet's rows with their code lengths."""

    def run(batches):
        number, heads, found, answers = None, [], [], {}

        def out():
            pairs = distinct(np.concatenate(found))
            found.clear()
            bits = np.zeros(len(pairs), np.float32)
            for k, at in by_part(pairs, parts):
                bits[at] = answers.pop(k)
            for blob, data in heads:
                head = pa.ipc.open_stream(blob).read_next_batch()
                whole = np.flatnonzero(np.asarray(head.column("word").is_null()))
                size = np.asarray(head.column("size").drop_null())
                first = begins(size)
                code = full(released(data, np.uint8), first)
                order = np.argsort(code)
                code = code[order]
                new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                each = np.empty(len(code))
                each[order] = np.repeat(bits[np.searchsorted(pairs, code[new])], np.diff(np.append(new, len(code))))
                sums = np.add.reduceat(each, first)  # in the order of the text: equal texts have equal sums
                score, length = np.full(head.num_rows, np.nan), np.full(head.num_rows, np.nan)
                score[whole], length[whole] = -sums * np.log10(2), sums / size
                yield pa.RecordBatch.from_arrays([*head.columns[:-1], *(pa.array(c, mask=np.isnan(c)) for c in (score, length))], names=[*head.schema.names[:-1], "score", "code_length"])

        for b in batches:
            for r in b.to_pylist():
                if r["sheet"] != number:
                    if heads:
                        yield from out()
                        heads, found, answers = [], [], {}
                        rest()
                    number, heads, found, answers = r["sheet"], [], [], {}
                if r["kind"] == HEAD:
                    heads.append((r["a"], r["b"]))
                    size = pa.ipc.open_stream(r["a"]).read_next_batch().column("size")
                    found.append(distinct(full(released(r["b"], np.uint8), begins(np.asarray(size.drop_null())))))
                    if sum(map(len, found)) > max(2_000_000, len(found[0]) * 3 // 2):
                        found[:] = [distinct(np.concatenate(found))]
                else:
                    answers[r["part"]] = released(r["a"], np.float32)
        if heads:
            yield from out()
        heads, found, answers = [], [], {}
        rest()

    return run


def words(docs: DataFrame) -> DataFrame:
    """word, times: each word of all texts by its 64-bit name, ASCII capitals lowered."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def out():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n, pa.int64())], names=["word", "times"])

        for b in slices(batches):
            held.append(Words(b.column("text"), lower=True).names)
            size += len(held[-1])
            if size > 3_000_000:
                yield out()
                size = 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))


def judged(rows: DataFrame, frequent: int = 1 << 19) -> DataFrame:
    """As score(), of rows(doc_id, text, scored, learnt): the scored ones by a model of the learnt ones; further columns are kept."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "lm")
    training = rows.where("learnt")
    known = scratch.keep(words(training), "words")
    ends = training.count()
    kinds, tokens = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("times"), F.lit(0))).first()
    total, vocabulary = tokens + ends, kinds + (1 if ends else 0)
    top = known.orderBy(F.desc("times"), "word").limit(frequent).toArrow()
    order = np.argsort(np.asarray(top.column("word")).view(U64)) if top.num_rows else np.empty(0, np.int64)
    near = spark.sparkContext.broadcast((np.asarray(top.column("word")).view(U64)[order], np.asarray(top.column("times"))[order]))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(MOST_PARTS, max(8, -(-int(size) // PART_BYTES)))
    end_log, end_known, whole = float(np.log10(ends + 1)), int(ends > 0), kinds <= frequent
    kept = [c for c in rows.columns if c not in ("text", "scored", "learnt")]

    def run(batches):
        from pyspark import TaskContext

        names, times = near.value
        row = TaskContext.get().partitionId() << 40
        sheet, read = row, 0
        own_sheet, others = Counted(), Counted()

        def send(kind, number, counted):
            pairs, n = counted.merge()
            for k, at in by_part(pairs, parts):
                yield packed_rows([(kind, number, k, squeezed_keys(pairs[at]), squeezed(n[at]))])
            counted.clear()

        for piece in slices(batches, SPELL_BYTES):
            scored = np.asarray(piece.column("scored").to_numpy(zero_copy_only=False), bool)
            if not scored.all():
                b = piece.filter(pa.array(~scored))
                code = full(*spelled(b.column("text")))
                others.add(code, np.ones(len(code), bool))
                if others.size > SHEET_PAIRS:
                    yield from send(LEARNT, -1, others)
            b = piece.filter(pa.array(scored))
            if not b.num_rows:
                continue
            w = Words(b.column("text"), lower=True)
            own = np.repeat(np.arange(b.num_rows), w.count)
            if len(names):
                k = np.minimum(np.searchsorted(names, w.names), len(names) - 1)
                hit = names[k] == w.names
                found = np.where(hit, times[k], 0)
            else:
                hit, found = np.zeros(len(own), bool), np.zeros(len(own))
            log = np.bincount(own, np.log10(found + 1.0), b.num_rows) + end_log
            n_known = np.bincount(own[hit], minlength=b.num_rows) + end_known
            data, first = spelled(b.column("text"))
            length = np.diff(np.append(first, len(data)))
            rid = row + np.arange(b.num_rows)
            row += b.num_rows
            columns = [*(b.column(c) for c in kept), pa.array(rid), pa.nulls(b.num_rows, pa.int64()), pa.array(w.count + 1, pa.int64()), pa.array(n_known, pa.int64()), pa.array(log), pa.array(length, pa.int64())]
            head = [*kept, "rid", "word", "n", "known", "log", "size"]
            made = [pa.RecordBatch.from_arrays(columns, names=head)]
            if not whole and not hit.all():  # words beyond the table, once a row
                at = np.flatnonzero(~hit)
                at = at[np.lexsort((w.names[at], own[at]))]
                new = np.flatnonzero(np.append(True, (own[at][1:] != own[at][:-1]) | (w.names[at][1:] != w.names[at][:-1])))
                n = np.diff(np.append(new, len(at)))
                at = at[new]
                none = [pa.nulls(len(at), b.column(c).type) for c in kept]
                made.append(pa.RecordBatch.from_arrays([*none, pa.array(rid[own[at]]), pa.array(w.names[at].view(np.int64)), pa.array(n, pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.float64()), pa.nulls(len(at), pa.int64())], names=head))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, made[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(pa.Table.from_batches(made).combine_chunks())
            yield packed_rows([(HEAD, sheet, 0, sink.getvalue().to_pybytes(), squeezed(data))])
            learnt = np.asarray(b.column("learnt").to_numpy(zero_copy_only=False), bool)
            own_sheet.add(full(data, first), np.repeat(learnt, length))
            read += len(data)
            if read > SHEET_BYTES or own_sheet.size > SHEET_PAIRS:
                yield from send(ASKED, sheet, own_sheet)
                sheet, read = sheet + 1, 0
        if own_sheet.held:
            yield from send(ASKED, sheet, own_sheet)
        if others.held:
            yield from send(LEARNT, -1, others)

    sheets = scratch.keep(rows.mapInArrow(run, PACKED), "sheets", by="kind").select("kind", "sheet", "part", "a", "b")
    dealt = sheets.where(F.col("kind") != HEAD)
    table = scratch.keep(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(merged, PACKED), "contexts")
    shallow = spark.sparkContext.broadcast(shallow_of(table))
    sent = table.unionByName(sheets.where(F.col("kind") == ASKED).withColumn("b", F.lit(None).cast("binary")))
    answers = sent.repartition("part").sortWithinPartitions("part", "kind", "sheet").mapInArrow(answered(shallow), PACKED)
    kinds_kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    made = answers.unionByName(sheets.where(F.col("kind") == HEAD)).repartition("sheet").sortWithinPartitions("sheet", "kind")
    made = scratch.keep(made.mapInArrow(gathered(parts), f"{kinds_kept}, rid long, word long, n long, known long, log double, score double, code_length double"), "scored")
    scratch.drop("sheets", "contexts")
    rare = made.where("word is not null").select("rid", "word", "n").join(known, "word")
    rare = rare.groupBy("rid").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("times") + 1.0)).alias("more_log"))
    out = made.where("word is null").join(rare, "rid", "left")
    per = float(np.log10(total + vocabulary + 1))
    return out.select(
        *kept,
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("more_log", F.lit(0.0)) - F.col("n") * F.lit(per)).alias("base_score"),
        "score",
        "code_length",
    )


def score(docs: DataFrame, training: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, code_length for each row of docs(doc_id, text), learning from training(text).

    Tokens are words (bytes other than ASCII white space, capitals A-Z lowered) and one end. score is the model's log10
    probability of the words, single spaces and the end; code_length its bits per byte. A null text is empty: one end. Repeated rows are scored
    each; a null doc_id stays null; other columns aren't read. Without training rows every byte has 8 bits.
    `frequent` bounds the broadcast counts of words; the other words' counts are joined."""
    mark = lambda df, i, scored: df.select(i.alias("doc_id"), "text", F.lit(scored).alias("scored"), F.lit(not scored).alias("learnt"))
    return judged(mark(docs, F.col("doc_id"), True).unionByName(mark(training, F.lit(None).cast(docs.schema["doc_id"].dataType), False)), **options)


def score_folds(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """score() learning from rows whose crc32(doc_id) mod `folds` isn't `held`, with held_out; a null doc_id isn't learnt from. Texts are read once for both."""
    fold = by_text_rule(folds)
    rows = docs.select("doc_id", (fold == held).alias("held_out"), "text", F.lit(True).alias("scored"), F.coalesce(fold != held, F.lit(False)).alias("learnt"))
    return judged(rows, **options)
