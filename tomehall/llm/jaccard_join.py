"""Exact Jaccard join of documents' word shingles in metric space, by pivots of regions.

Jaccard distance between two documents without a common shingle is 1, so free pivots would tell nothing
apart. Regions are therefore anchored: all documents that share a shingle of their prefixes form a cell
(linked documents always share one, early in the smaller of them, in one order of all
shingles, frequent ones last). A cell's pivot is the document of the smallest key, and a document lies in the
regions of all its pivots, boundary documents in several. First every document is compared with its
pivots. What these link becomes one component; a region whose documents are in one component is done.

The others join again, recursively. If pairs are many, the documents of crowded regions alone form new cells, in the exact order of how
rare each shingle is among them. Then each large region gets many pivots and is cut into their Voronoi regions: a document goes to the
nearest pivot, and also to each other that is no farther than a window which the triangle inequality gives; a linked pair meets where one of the two is
at home. Regions that shrink are cut again. Last, documents of a region that stand in different components are compared directly.

Distances are bounded before texts are fetched: a sketch of a set is the parity of its shingles in 1024
places, and Hamming distance of sketches never exceeds the symmetric difference, which is at most a
seventh of the sizes' sum for linked sets. It is a metric too: these are the distances to pivots, and two linked documents
lie in one window of distances to any pivot.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Scratch, Words, grams, mix, on_texts, rest, slices
from .components import forest, labels

SKETCH = 1024
#: Documents of a region that are compared by a join; larger regions are compared in blocks.
SMALL = 64
#: Documents for each pivot of a large region, the most pivots of one, the most times that regions are cut, and how much smaller a region must get for another time.
FOR_EACH, MOST, CUTS, SHRUNK = 256, 64, 3, 0.7
#: Documents of a large region that meet its pivots in one task, and documents of a block.
SALTED, BLOCK = 4096, 2048
#: Bits of a table that tells which rows a join can need: for each wanted row, and at most (8 MB); those of one row of the table.
BITS, MOST_BITS, ROW_BITS = 16, 1 << 26, 1 << 15
#: Shingles that a task packs before it sends them on, the least number of parts that they are dealt to, and shingles of a part, about.
PACKED, PARTS, PART = 1 << 19, 256, 1 << 20


def sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n consecutive words, ASCII capitals lowered; of the whole sequence if it is shorter."""
    words = Words(texts, lower=True)
    whole = grams(words.names, n, 77)  # of all texts in one pass; those that reach into the next text aren't taken
    ends = np.cumsum(words.count)
    out = []
    for begin, end in zip((ends - words.count).tolist(), ends.tolist(), strict=True):
        if end - begin < n:
            h = words.names[begin:end]
            h = mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), len(h))], U64)) if len(h) else h
        else:
            h = np.sort(whole[begin : end - n + 1])
            h = h[np.append(True, h[1:] != h[:-1])]
        out.append(h)
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def sketch(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((mix(s) >> U64(54)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def prefix_length(n, percent: int):
    """Linked sets share one of so many first shingles of the larger."""
    return n - (n * percent + 99) // 100 + 1


def early_length(n, percent: int):
    """... and one of so many first shingles of the smaller."""
    return n - (2 * n * percent + 99 + percent) // (100 + percent) + 1


def places(s: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rank of each shingle that is listed (sorted), 0 of others."""
    if not len(listed):
        return np.zeros(len(s), np.int64)
    k = np.minimum(np.searchsorted(listed, s.view(np.int64)), len(listed) - 1)
    return np.where(listed[k] == s.view(np.int64), rank[k], 0)


def widest(n: str, percent: int):
    """The largest symmetric difference that a set of `n` shingles has from one that it links with."""
    return F.expr(f"({100 - percent} * ({n} + ({n} * 100) div {percent})) div {100 + percent}")


def distance(one, two):
    """Hamming distance of sketches."""
    return F.aggregate(F.zip_with(one, two, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def divided(members: DataFrame, percent: int, level: int) -> DataFrame:
    """members(region, key, n, h, label, sketch, all, home) of large regions, dealt to the Voronoi regions of many pivots each.

    Pivots are chosen by hash, about one for FOR_EACH documents; a region without any stays. A document's distances decide where it goes: the nearest pivot is
    home; others within twice the widest difference of linked sets get it too, so that it meets all that it links with at their homes."""
    chosen = F.least(F.ceil(F.col("all") / FOR_EACH) + 1, F.lit(MOST))
    pivots = members.where(F.pmod(F.xxhash64("key", F.lit(level)), F.col("all")) < chosen).groupBy("region").agg(F.collect_list(F.struct("key", "sketch")).alias("pivots"), F.max("all").alias("a"))
    salts = lambda c: F.ceil(F.col(c) / SALTED).cast("int")
    pivots = pivots.select("region", "pivots", F.explode(F.sequence(F.lit(0), salts("a") - 1)).alias("salt"))  # a hot region's documents don't meet in one task
    met = members.withColumn("salt", F.pmod(F.xxhash64("key"), salts("all")).cast("int")).join(pivots, ["region", "salt"], "left")
    far = F.transform("pivots", lambda p: F.struct(distance(p["sketch"], F.col("sketch")).alias("h"), p["key"].alias("pivot")))
    met = met.withColumn("far", F.coalesce(far, F.array(F.struct(F.col("h").alias("h"), F.col("region").alias("pivot")))))
    met = met.withColumn("near", F.array_min("far"))
    there = F.filter("far", lambda x: x["h"] <= F.col("near")["h"] + 2 * widest("n", percent))
    dealt = met.select("region", "all", "key", "n", "label", "sketch", "near", F.explode(there).alias("to"))
    return dealt.select(F.xxhash64("region", "to.pivot", F.lit(level)).alias("region"), "key", "n", F.col("to.h").alias("h"), "label", "sketch", F.col("all").alias("before"), (F.col("to.pivot") == F.col("near.pivot")).alias("home"))


def still_open(members: DataFrame, percent: int) -> DataFrame:
    """region, all, within, width of the regions with documents of several components, one of them at home: documents, pairs within components, the widest window."""
    parts = members.groupBy("region", "label").agg(F.count(F.lit(1)).alias("size"), F.max("home").alias("home"), F.max("n").alias("n"))
    sums = parts.groupBy("region").agg(F.sum("size").alias("all"), F.sum(F.col("size") * F.col("size")).alias("within"), F.max("home").alias("home"), F.max("n").alias("n"))
    return sums.where("home and all * all > within").select("region", "all", "within", (widest("n", percent) + 1).alias("width"))


def close_pairs(members: DataFrame, percent: int, closest: bool = False, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """key1, key2 of documents of one region in different components whose sizes and sketches allow a link.

    members(region, key, n, h, label, sketch, all, width, home): `all` documents in the region, whose window is `width` at most. Those of up to `small` documents join within windows of distances to
    the pivot; larger ones are cut into stripes as wide as the window, and these into blocks by hash; blocks of one stripe and of neighbours meet, every two in a task of their own,
    which gives only the pairs within bounds; with `closest`, the closest of each document in its block."""
    alike, bound = f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)", F.expr(f"({100 - percent} * (n1 + n2)) div {100 + percent}")
    few = members.where(F.col("all") <= small)
    of = lambda k: few.select("region", *(F.col(c).alias(f"{c}{k}") for c in ("key", "label", "n", "h", "sketch", "home")))
    one, two = of(1), of(2)
    window = (F.col("label1") < F.col("label2")) & F.expr("home1 or home2") & F.expr(alike) & (F.abs(F.col("h1") - F.col("h2")) <= bound) & (distance("sketch1", "sketch2") <= bound)
    near = one.join(two, (one.region == two.region) & window).select("key1", "key2")

    many = members.where(F.col("all") > small)
    many = many.withColumn("stripe", F.expr("cast(h div width as int)"))
    sized = many.groupBy("region", "stripe").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = sized.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("stripe", "blocks"))).alias("sized"))  # a few stripes for each region
    many = many.join(sized, "region")
    for name, shift in (("blocks", 0), ("after", 1), ("below", -1)):
        many = many.withColumn(name, F.coalesce(F.try_element_at("sized", F.col("stripe") + shift), F.lit(0)))
    many = many.withColumn("part", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    # blocks (stripe, part) that a document's own block meets: those of its stripe, the next one's and the last one's; the lower is i
    numbers = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(F.array().cast("array<struct<s:int,i:int,t:int,j:int>>"))
    task = lambda s, i, t, j: F.struct(s.cast("int").alias("s"), i.cast("int").alias("i"), t.cast("int").alias("t"), j.cast("int").alias("j"))
    stripe, part = F.col("stripe"), F.col("part")
    tasks = F.concat(
        numbers("blocks", lambda x: task(stripe, F.least(x, part), stripe, F.greatest(x, part))),
        numbers("after", lambda x: task(stripe, part, stripe + 1, x)),
        numbers("below", lambda x: task(stripe - 1, x, stripe, part)),
    )
    many = many.select("region", "key", "n", "h", "label", "home", "sketch", "stripe", "part", F.explode(tasks).alias("at")).select("region", "at.*", "key", "n", "h", "label", "home", "sketch", "stripe", "part")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        key, size, label, home, h, stripe, part, s, i, u, j = (t.column(c).to_numpy() for c in ("key", "n", "label", "home", "h", "stripe", "part", "s", "i", "t", "j"))
        words = np.asarray(t.column("sketch").combine_chunks().flatten()).view(U64).reshape(len(key), -1).T.copy()
        first = np.flatnonzero((stripe == s) & (part == i))
        second = first if s[0] == u[0] and i[0] == j[0] else np.flatnonzero((stripe == u) & (part == j))
        out1, out2 = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(0, len(first) if len(second) else 0, 64):
            a = first[k : k + 64]
            total = np.zeros((len(a), len(second)), np.uint16)
            for w in words:
                total += np.bitwise_count(w[a][:, None] ^ w[second][None, :])
            bound = (100 - percent) * (size[a][:, None] + size[second][None, :]) // (100 + percent)
            ok = (total <= bound) & (label[a][:, None] != label[second][None, :]) & (home[a][:, None] | home[second][None, :])
            ok &= np.abs(h[a][:, None] - h[second][None, :]) <= bound
            ok &= 100 * np.minimum(size[a][:, None], size[second][None, :]) >= percent * np.maximum(size[a][:, None], size[second][None, :])
            if closest:
                best = np.where(ok, total, 65535).argmin(axis=1)
                x = np.flatnonzero(ok[np.arange(len(a)), best])
                y = best[x]
            else:
                x, y = np.nonzero(ok)
            x, y = key[a[x]], key[second[y]]
            out1.append(np.minimum(x, y))
            out2.append(np.maximum(x, y))
        return pa.table({"key1": np.concatenate(out1), "key2": np.concatenate(out2)})

    return near.select(F.least("key1", "key2").alias("key1"), F.greatest("key1", "key2").alias("key2")).unionByName(many.groupBy("region", "s", "i", "t", "j").applyInArrow(compare, "key1 long, key2 long"))


def among(df: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose `name` wanted(name) has, and few others, told by a broadcast table of bits: what a join doesn't need isn't dealt out for it."""
    bits = max(ROW_BITS, min(MOST_BITS, 1 << (BITS * wanted.count()).bit_length()))
    place, row = F.pmod(F.xxhash64(name), F.lit(bits)), F.floor(F.col("place") / ROW_BITS).alias("row")
    table = wanted.select(place.alias("place")).groupBy(row).agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits"))
    told = F.expr(f"(shiftright(cast(conv(hex(substring(bits, cast((place % {ROW_BITS}) div 8 as int) + 1, 1)), 16, 10) as int), cast(place % 8 as int)) & 1) = 1")
    return df.withColumn("place", place).withColumn("row", row).join(F.broadcast(table), "row").where(told).select(*df.columns)


def runs(cell: np.ndarray, *columns: tuple[np.ndarray, np.ufunc]) -> tuple[np.ndarray, ...]:
    """Each different cell once, in order, with what its entries of each column add up to."""
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
    return cell[at], *(f.reduceat(c[order], at) if len(at) else c for c, f in columns)


def packed(df: DataFrame, found: Callable[[pa.RecordBatch], list[np.ndarray]], adds: list[np.ufunc], parts: int, kept: Callable[..., pa.Table], schema: str) -> DataFrame:
    """kept(cell, *columns) of all cells of texts, added up.

    found gives cells and columns of 64-bit numbers. A task adds up PACKED of them at once and sends each part its cells as one row, by a hash of the cell, so what is
    exchanged is a row for each part and not for each shingle, and a frequent one goes on once; a part, of PART cells about, adds up what all tasks sent."""

    def blobs(entries: list[list[np.ndarray]]) -> pa.RecordBatch:
        cell, *columns = (np.concatenate(c) for c in zip(*entries, strict=True))
        cell, *columns = runs(cell, *zip(columns, adds, strict=True))
        part = (mix(cell.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        there, begins = np.unique(part[order], return_index=True)
        ends = (np.append(begins, len(cell)) * 8).astype(np.int32)
        blob = lambda c: pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(c[order], np.int64))])
        return rows(part=there.astype(np.int32), **{f"c{i}": blob(c) for i, c in enumerate((cell.view(np.int64), *columns))})

    def pack(batches):
        entries, held = [], 0
        for b in slices(batches):
            got = found(b)
            if len(got[0]):
                entries.append(got)
                held += len(got[0])
            if held >= PACKED:
                yield blobs(entries)
                entries, held = [], 0
        if entries:
            yield blobs(entries)

    names = [f"c{i}" for i in range(1 + len(adds))]

    def add(t: pa.Table) -> pa.Table:
        cell, *columns = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int64) for c in names)
        return kept(*runs(cell, *zip(columns, adds, strict=True)))

    sent = df.mapInArrow(pack, ", ".join(["part int", *(f"{c} binary" for c in names)]))
    return sent.groupBy("part").applyInArrow(add, schema)


def told(wanted: DataFrame, name: str, rows: int) -> np.ndarray:
    """A table of bits on the driver (8 MB at most) that has each of wanted(name), for numbers that are hashes; see maybe()."""
    bits = max(ROW_BITS, min(MOST_BITS, 1 << (BITS * rows).bit_length()))
    place = wanted.select((F.col(name).bitwiseAND(F.lit(bits - 1))).alias("place"))
    table = place.groupBy(F.expr(f"place div {ROW_BITS}").alias("row")).agg(F.bitmap_construct_agg(F.col("place") % ROW_BITS).alias("bits")).toArrow()
    out = np.zeros((bits // ROW_BITS, ROW_BITS // 8), np.uint8)
    for row, b in zip(table.column("row").to_pylist(), table.column("bits").to_pylist(), strict=True):
        out[row] = np.frombuffer(b, np.uint8)
    return out.reshape(-1)


def maybe(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x may be one that the table was told: true for all that were, and for few others."""
    place = x & np.int64(len(table) * 8 - 1)
    return table[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def cells(placed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pivot, key of placed(cell, key, early): each document but the pivot with the pivots of its cells; only cells with an early place link anything."""
    shared = placed.groupBy("cell").agg(F.min("key").alias("pivot"), F.max("key").alias("z"), F.max("early").alias("early")).where("pivot < z and early").select("cell", "pivot")
    return met(placed, scratch.keep(shared, f"{name}-shared"), scratch, name)


def met(placed: DataFrame, shared: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """pivot, key of placed(cell, key), for the cells of the scratch table shared(cell, pivot), which goes."""
    near = scratch.keep(placed.join(shared, "cell").where("key <> pivot").select("pivot", "key").distinct(), name)
    scratch.drop(f"{name}-shared")
    return near


def link(docs: DataFrame, n: int = 5, percent: int = 75, frequent: int = 262_144, least_frequent: int = 8, easy: int = 64, small: int = SMALL, whole_region: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text).

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is the
    smallest doc_id that links reach. A null or empty text, or one of white space, has no shingle and links with nothing. Rows of one
    doc_id are one document. A null doc_id links with nothing and has a null component_id. Other columns
    are ignored. The rest changes costs, not results: `frequent` bounds the broadcast list of shingles that come last in prefixes;
    where open pairs are more than `easy` times their documents, those of the regions in which they are so form new cells; regions of more than `whole_region` documents are cut by pivots; those of more than `small` are compared in blocks."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def summary(b: pa.RecordBatch) -> pa.RecordBatch:
        found = sets(b.column("text"), n)
        keys = [fingerprint(s) for s in found]
        return rows(doc_id=b.column("doc_id"), key=pa.array([k for k, _ in keys], pa.int64()), key2=pa.array([k for _, k in keys], pa.int64()), n=pa.array([len(s) for s in found], pa.int64()))

    members = scratch.keep(on_texts(whole, summary, "doc_id long, key long, key2 long, n long"), "members")
    some = whole.where("doc_id is not null and text is not null")

    def times(found: list[np.ndarray]) -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(found), return_counts=True)
        return rows(shingle=values.view(np.int64), times=times)

    def first_ones(b: pa.RecordBatch) -> list[np.ndarray]:
        found = np.concatenate([s[: prefix_length(len(s), percent)] if len(s) else s for s in sets(b.column("text"), n)]).view(np.int64)
        return [found, np.ones(len(found), np.int64)]

    def latest(counted: DataFrame):
        """The `frequent` most frequent shingles of counted(shingle, times), broadcast in order of their hashes with their ranks: the most frequent last."""
        often = counted.orderBy(F.desc("times"), "shingle").limit(frequent).toArrow()
        listed, rank = np.asarray(often.column("shingle"), np.int64), np.arange(often.num_rows, 0, -1)
        by_hash = np.argsort(listed, kind="stable")
        return spark.sparkContext.broadcast((listed[by_hash], rank[by_hash]))

    parts = max(PARTS, -(-(members.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // (100 * PART)))

    def often(shingle: np.ndarray, times: np.ndarray) -> pa.Table:
        some = times >= least_frequent
        return pa.table({"shingle": shingle[some], "times": times[some]})

    counted = scratch.keep(packed(some, first_ones, [np.add], parts, often, "shingle long, times long"), "counted")  # written, so that its shuffle files go before the next ones come
    late = latest(counted)
    scratch.drop("counted")

    def prefixes(b: pa.RecordBatch) -> list[np.ndarray]:
        """Cells, keys, keys again and whether the place is an early one."""
        out = {}
        for s in sets(b.column("text"), n):
            if len(s):
                key = fingerprint(s)[0]
                if key not in out:
                    place = places(s, *late.value)
                    p = s[np.argsort(place, kind="stable")] if place.any() else s
                    p = p[: prefix_length(len(s), percent)].view(np.int64)
                    out[key] = (p, np.arange(len(p)) < early_length(len(s), percent))
        p, early = zip(*out.values(), strict=True) if out else ([np.empty(0, np.int64)], [np.empty(0, bool)])
        key = np.repeat(np.array(list(out), np.int64), list(map(len, p)) if out else 0)
        return [np.concatenate(p), key, key, np.concatenate(early).astype(np.int64)]

    def linking(cell: np.ndarray, pivot: np.ndarray, z: np.ndarray, early: np.ndarray) -> pa.Table:
        some = (pivot < z) & (early > 0)
        return pa.table({"cell": cell[some], "pivot": pivot[some]})

    # a document lies in the region of each pivot that it shares a cell with; linked documents share a region. Cells that link nothing aren't dealt out with their documents
    shared = scratch.keep(packed(some, prefixes, [np.minimum, np.maximum, np.maximum], parts, linking, "cell long, pivot long"), "near-shared")
    table = spark.sparkContext.broadcast(told(shared, "cell", shared.count()))

    def placed(b: pa.RecordBatch) -> pa.RecordBatch:
        cell, key, *_ = prefixes(b)
        some = maybe(table.value, cell)
        return rows(cell=cell[some], key=key[some])

    near = met(on_texts(some, placed, "cell long, key long"), shared, scratch, "near")

    real = members.where("n > 0 and doc_id is not null")
    reps = scratch.keep(real.groupBy("key", "key2", "n").agg(F.min("doc_id").alias("node")), "reps", small=True)
    inside = near.select("key").unionByName(near.select(F.col("pivot").alias("key"))).distinct()
    wanted = scratch.keep(reps.join(inside, "key", "left_semi").select("key", "key2", F.col("node").alias("doc_id")), "wanted", small=True)

    def described(batches):
        """Texts whose set is the one that was asked for; rows come in order of doc_id, and a row given twice is given once."""
        last, seen = None, set()
        for b in slices(batches):
            kept, sketches = [], []
            for i, (s, d, k1, k2) in enumerate(zip(sets(b.column("text"), n), *(b.column(c).to_pylist() for c in ("doc_id", "key", "key2")), strict=True)):
                if d != last:
                    last, seen = d, set()
                if (k1, k2) not in seen and fingerprint(s) == (k1, k2):
                    seen.add((k1, k2))
                    kept.append(i)
                    sketches.append((sketch(s).tolist(), len(s)))
            c = lambda name: b.column(name).take(pa.array(kept, pa.int64()))  # noqa: E731, B023
            yield rows(key=c("key"), node=c("doc_id"), n=pa.array([m for _, m in sketches], pa.int64()), sketch=pa.array([x for x, _ in sketches], pa.list_(pa.int64())), text=c("text"))

    texts = among(some, "doc_id", wanted).hint("merge").join(wanted, "doc_id").mapInArrow(described, "key long, node long, n long, sketch array<long>, text string")
    texts = scratch.keep(texts, "texts")
    scratch.drop("wanted")
    nodes = texts.select("key", "node", "n", "sketch")
    length = texts.agg(F.sum("n")).first()[0] or 1
    alike = f"100 * least(n1, n2) >= {percent} * greatest(n1, n2)"
    seventh = F.expr(f"({100 - percent} * (n1 + n2)) div {100 + percent}")  # the largest symmetric difference of linked sets

    def measured(pairs: DataFrame, name: str) -> DataFrame:
        """pairs(key1, key2) with their nodes, sizes and the distance of their sketches."""
        of = lambda k: nodes.select(F.col("key").alias(f"key{k}"), F.col("node").alias(f"node{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        got = pairs.join(of(1), "key1").join(of(2), "key2").where("node1 <> node2")
        return scratch.keep(got.select("key1", "key2", "node1", "node2", "n1", "n2", distance("s1", "s2").alias("h")), name)

    written: dict[str, list[str]] = {}  # the tables of each linked()

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of measured pairs those that link, as edges (a, b) between nodes. Only texts of close pairs are dealt out, and in several rounds if the pairs' texts are more than all texts once."""
        close = scratch.keep(pairs.where(alike).where(F.col("h") <= seventh).select("node1", "node2", "key1", "key2", "n2"), f"close-{name}", small=True)
        rounds = -(-(close.agg(F.sum("n2")).first()[0] or 0) // length)

        def exact(batches):
            held: dict[int, np.ndarray] = {}
            for whole in batches:
                for i in range(0, whole.num_rows, 64):
                    b = whole.slice(i, 64)
                    yes = []
                    other = b.column("node1").to_pylist()
                    new = {x: k for k, x in enumerate(other) if x not in held}
                    held = {x: held[x] for x in other if x in held}  # rows of one pivot mostly come together
                    held |= dict(zip(new, sets(b.column("text1").take(pa.array(list(new.values()), pa.int64())), n), strict=True)) if new else {}
                    for x, y, s2 in zip(other, b.column("node2").to_pylist(), sets(b.column("text2"), n), strict=True):
                        s1 = held[x]
                        both = len(np.intersect1d(s1, s2, assume_unique=True))
                        if 100 * both >= percent * (len(s1) + len(s2) - both):
                            yes.append((x, y))
                    yield rows(a=pa.array([x for x, _ in yes], pa.int64()), b=pa.array([y for _, y in yes], pa.int64()))
            held.clear()
            rest()

        found = spark.createDataFrame([], "a long, b long")
        for i in range(rounds):
            now = close.where(F.pmod(F.xxhash64("node1", "node2"), F.lit(rounds)) == i)
            text = lambda k: among(texts.select(F.col("node").alias(f"node{k}"), F.col("key").alias(f"key{k}"), F.col("text").alias(f"text{k}")), f"node{k}", now.select(f"node{k}"))  # noqa: E731, B023
            checked = now.select("node1", "node2", "key1", "key2").join(text(2), ["node2", "key2"]).join(text(1), ["node1", "key1"])
            found = found.unionByName(scratch.keep(checked.mapInArrow(exact, "a long, b long"), f"{name}-{i}"))
        written[name] = [f"close-{name}", *(f"{name}-{i}" for i in range(rounds))]
        return found

    # rows of one doc_id with different texts: their classes belong together
    ids = real.groupBy("doc_id").agg(F.min(F.struct("key", "key2", "n")).alias("x"), F.max(F.struct("key", "key2", "n")).alias("y")).where("x <> y").select("doc_id")
    ids = scratch.keep(ids, "several", small=True)
    tree = spark.createDataFrame([], "a long, b long")
    if not ids.isEmpty():
        same = scratch.keep(real.join(ids, "doc_id").join(reps, ["key", "key2", "n"]).select("doc_id", "node"), "same", small=True)
        least = same.groupBy("doc_id").agg(F.min("node").alias("b"))
        tree = scratch.keep(same.join(least, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b"), "tied", small=True)

    def named(tree: DataFrame) -> DataFrame:
        """Each key's component as far as it is known: its node's, or the node itself."""
        return nodes.select("key", "node").join(labels(tree), "node", "left").groupBy("key").agg(F.min(F.coalesce("label", "node")).alias("label"))

    def opened(regions: DataFrame, tree: DataFrame, name: str) -> DataFrame:
        """members(region, key, n, h, label, sketch, all, within, width, home) of regions(region, key, n, h) that the tree leaves open."""
        state = scratch.keep(regions.join(named(tree), "key").withColumn("home", F.lit(True)), f"state-{name}", small=True)
        inner = state.join(scratch.keep(still_open(state, percent), f"wide-{name}", small=True), "region").join(nodes.groupBy("key").agg(F.first("sketch").alias("sketch")), "key")
        return scratch.keep(inner, f"open-{name}")

    def starred(near: DataFrame, tree: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """The tree with what pivots link, and the members of the open regions."""
        pairs = measured(near.select(F.col("pivot").alias("key1"), F.col("key").alias("key2")), f"pairs-{name}")
        tree = forest(tree.unionByName(linked(pairs, f"links-{name}")), scratch, f"tree-{name}", most=2)
        regions = pairs.select(F.col("key1").alias("region"), F.col("key2").alias("key"), F.col("n2").alias("n"), "h").dropDuplicates(["region", "key"])
        return tree, opened(regions, tree, name)

    tree, inner = starred(near, tree, "first")
    left, size = inner.groupBy("region").agg(F.first("all").alias("all"), F.first("within").alias("within")).agg(F.sum((F.col("all") * F.col("all") - F.col("within")) / 2), F.sum("all")).first()
    if left and left > easy * size:

        # only regions with many open pairs: the others' documents meet where they are
        crowded = F.expr(f"(all * all - within) / 2 > {easy} * all")
        crowd = scratch.keep(inner.where(crowded).select("key").distinct(), "crowd", small=True)
        crowds = among(texts, "key", crowd).join(crowd, "key", "left_semi").select("key", "text")
        counted = on_texts(crowds, lambda b: times(sets(b.column("text"), n)), "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
        shared = scratch.keep(counted.where("times > 1"), "shared")
        last = latest(shared)

        def shingles(listed: bool):
            """Of each text, the listed shingles of its prefix, which come last, with their places in the order; or the others, with their number."""

            def found(b: pa.RecordBatch) -> pa.RecordBatch:
                out = []
                for key, s in zip(b.column("key").to_pylist(), sets(b.column("text"), n), strict=True):
                    place = places(s, *last.value)
                    others = np.count_nonzero(place == 0)
                    some = s[np.argsort(place)][others : prefix_length(len(s), percent)] if listed else s[place == 0]
                    out.append((key, len(s), some.view(np.int64), others + np.arange(len(some)) if listed else np.full(len(some), others)))
                keys, sizes, some, at = zip(*out, strict=True)
                many = list(map(len, some))
                return rows(key=np.repeat(np.array(keys, np.int64), many), n=np.repeat(np.array(sizes, np.int64), many), shingle=np.concatenate(some), at=np.concatenate(at))

            return on_texts(crowds, found, "key long, n long, shingle long, at long")

        # rarest first; shingles of one document alone come before all others. Those that many documents share are listed, and aren't dealt out but for prefixes
        placed = shingles(listed=True).select("key", "n", "shingle", F.col("at").alias("pos"))
        if shared.count() > frequent:
            others = shingles(listed=False)
            ordered = among(others, "shingle", shared).join(shared, "shingle").groupBy("key", "n", "at").agg(F.sort_array(F.collect_set(F.struct("times", "shingle"))).alias("order"))
            alone = F.col("at") - F.size("order")
            ordered = ordered.select("key", "n", alone.alias("alone"), F.posexplode("order").alias("pos", "s"))
            placed = placed.unionByName(ordered.select("key", "n", F.col("s.shingle").alias("shingle"), (F.col("pos") + F.col("alone")).alias("pos")))
        longest, early = (F.expr(e) for e in (f"n - (n * {percent} + 99) div 100 + 1", f"n - (2 * n * {percent} + 99 + {percent}) div {100 + percent} + 1"))
        placed = placed.where(F.col("pos") < longest).select(F.col("shingle").alias("cell"), "key", (F.col("pos") < early).alias("early"))
        again = cells(scratch.keep(placed, "placed"), scratch, "again")
        scratch.drop("placed", "shared", "crowd")
        calm = inner.where(~crowded).select("region", "key", "n", "h")
        tree, inner = starred(again, tree, "again")
        inner = inner.unionByName(opened(calm, tree, "calm"))

    for level in range(CUTS):
        large = inner.where(F.col("all") > whole_region)
        if level:
            large = large.where(F.col("all") < SHRUNK * F.col("before"))
        if large.isEmpty():
            break
        aside = inner.where(F.col("all") <= whole_region) if not level else inner.where((F.col("all") <= whole_region) | (F.col("all") >= SHRUNK * F.col("before")))
        cut = scratch.keep(divided(large, percent, level), f"cut-{level}")
        cut = cut.join(scratch.keep(still_open(cut, percent), f"wide-{level}", small=True), "region")
        inner = scratch.keep(cut.unionByName(aside.withColumn("before", F.lit(0).cast("long")).select(*cut.columns)), f"inner-{level}")
    if not inner.isEmpty():
        if not inner.where(F.col("all") > small).isEmpty():
            # large regions first give each document's closest partners alone: what these connect needs no other pair
            some_pairs = measured(close_pairs(inner.where(F.col("all") > small), percent, closest=True, small=small).distinct(), "some")
            tree = forest(tree.unionByName(linked(some_pairs, "links-some")), scratch, "tree-some", most=2)
            inner = inner.drop("label").join(named(tree), "key")
        others = measured(close_pairs(inner, percent, small=small).distinct(), "rest")
        tree = tree.unionByName(linked(others, "links-rest"))

    final = scratch.keep(labels(forest(tree, scratch, "final")), "labels", small=True)  # written, so that a side with many copies can be split
    # all that the result doesn't read any more
    scratch.drop("near", "again", "texts", "several", "same", "tied", *(x for names in written.values() for x in names), *(f"{t}-{i}" for t in ("state", "open", "wide", "pairs") for i in ("first", "again", "calm")), "tree-first-1", "tree-again-1", "tree-some-1", "some", "rest", *(f"{t}-{i}" for t in ("cut", "inner", "wide") for i in range(CUTS)))
    out = members.where("n > 0 and doc_id is not null").join(reps, ["key", "key2", "n"], "left").join(final, "node", "left")
    out = scratch.keep(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "node").alias("component_id")), "out", small=True)
    # rows without shingles or an id meet no others here; other rows of an id still tell its component
    alone = members.where("doc_id is not null and n = 0").select("doc_id", F.col("n").alias("n_shingles"))
    alone = alone.join(out.groupBy("doc_id").agg(F.min("component_id").alias("c")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    nameless = members.where("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(alone).unionByName(nameless)
