"""Media columns: progressive JPEG, written and read in numpy, many images at a time.

Payload bytes are stored as quantised coefficients (steps of one), 64 to a block in zigzag order, so the
file gives them back exactly. Scans carry spectral bands and successive approximations; every block of an AC
scan, and every unit of a DC scan, is a restart interval of its own, so a reader can follow all of them at once, one
symbol each a step. Any baseline-size progressive file with other scans or intervals is read by the same
steps, with fewer lanes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import on_texts, raw, slices

U64 = np.uint64
#: Sampling of luma and both chromas: a unit is four luma blocks and one of each chroma.
SAMPLING = ((2, 2), (1, 1), (1, 1))
#: components, first and last coefficient, bits known before, bits left for later.
SCRIPT = (
    ((0, 1, 2), 0, 0, 0, 1),
    *(((c,), 1, 5, 0, 1) for c in range(3)),
    *(((c,), 6, 63, 0, 0) for c in range(3)),
    ((0, 1, 2), 0, 0, 1, 0),
    *(((c,), 1, 5, 1, 0) for c in range(3)),
)
EOB, ZRL = 0x00, 0xF0


@lru_cache
def zigzag() -> np.ndarray:
    """Place in a block, row by row, of each coefficient in order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


def dc_lengths() -> dict[int, int]:
    return dict.fromkeys(range(12), 4)


def ac_lengths() -> dict[int, int]:
    """Two bits for the sizes of letters and signs, five for other sizes without a run and the end, ten for the rest."""
    out = {r << 4 | s: 10 for r in range(16) for s in range(11)}
    out |= dict.fromkeys((1, 2, 3, 4, 5, 8, EOB), 5)
    return out | {6: 2, 7: 2}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, length), in order of length, then symbol."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol] = (code, n)
        code, last = code + 1, n
    return out


def code_arrays(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    code, size = np.zeros(256, U64), np.zeros(256, np.int64)
    for s, (c, n) in canonical(lengths).items():
        code[s], size[s] = c, n
    return code, size


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """length << 8 | symbol for each 16 bits ahead; length 16 and symbol 0 where no code fits."""
    out = np.full(1 << 16, 16 << 8, np.int64)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def bit_size(v: np.ndarray) -> np.ndarray:
    """Bits of the magnitude."""
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


# ---- layout


def frame(blocks: int) -> tuple[int, int]:
    """Units across and down for so many blocks."""
    units = -(-blocks // 6)
    down = -(-units // max(64, -(-units // 4095)))
    return -(-units // down), down


def component_blocks(across: int, down: int) -> list[tuple[int, int]]:
    """Blocks down and across of each component."""
    return [(down * v, across * h) for h, v in SAMPLING]


def unit_order(across: int, down: int, sampling=SAMPLING) -> np.ndarray:
    """Blocks of all components, numbered one component after the other, in the order of interleaved scans."""
    parts, base = [], 0
    for h, v in sampling:
        grid = np.arange(down * v * across * h).reshape(down, v, across, h) + base
        parts.append(grid.transpose(0, 2, 1, 3).reshape(down * across, v * h))
        base += grid.size
    return np.concatenate(parts, axis=1)


# ---- writing


def packed(code: np.ndarray, size: np.ndarray, segment: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments, each filled up with ones to whole bytes, and the bytes of each. Tokens come in order of segments, at most 57 bits each."""
    bits = np.bincount(segment, size, segments).astype(np.int64)
    length = (bits + 7) // 8
    first = np.cumsum(length) - length
    before = np.cumsum(size) - size
    start = np.cumsum(bits) - bits
    at = first[segment] * 8 + before - start[segment]
    place, shift = at >> 3, at & 7
    value = code << (64 - size - shift).astype(U64)
    total = np.zeros(int(length.sum()))
    for k in range(8):
        on = np.flatnonzero(shift + size > 8 * k)
        if not len(on):
            break
        total += np.bincount(place[on] + k, (value[on] >> U64(56 - 8 * k) & U64(255)).astype(np.float64), len(total))
    out = total.astype(np.uint8)
    some = length > 0
    out[(first + length - 1)[some]] |= ((1 << (8 * length - bits)[some]) - 1).astype(np.uint8)
    return out, length


def scan_bytes(out: np.ndarray, length: np.ndarray, per_image: np.ndarray) -> list[bytes]:
    """Entropy-coded data of one scan for each image of per_image[i] segments, with restart marks between and zeros after 255."""
    first = np.cumsum(length) - length
    head = np.cumsum(per_image) - per_image  # of each image its first segment
    nth = np.arange(len(length)) - np.repeat(head, per_image)
    mark = np.zeros(len(out) + 1, np.int64)
    np.add.at(mark, first[nth > 0], 2)
    full = out == 255
    place = np.arange(len(out)) + np.cumsum(full) - full + np.cumsum(mark[:-1])
    final = np.zeros(len(out) + int(full.sum()) + int(mark.sum()), np.uint8)
    final[place] = out
    m = np.flatnonzero(nth > 0)
    final[place[first[m]] - 2], final[place[first[m]] - 1] = 255, 0xD0 + (nth[m] - 1) % 8
    cuts = [*place[first[head]].tolist(), len(final)]  # every segment has bytes
    blob = final.tobytes()
    return [blob[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


AC_CODE, AC_SIZE = code_arrays(ac_lengths())
DC_CODE, DC_SIZE = code_arrays(dc_lengths())


def value_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v).astype(U64)


def dc_first(v: np.ndarray, order: np.ndarray, unit_of: np.ndarray, component: np.ndarray):
    """Tokens of values in scan order; a component's prediction starts anew in each unit."""
    before = np.zeros(len(v), np.int64)
    before[1:] = np.where((unit_of[1:] == unit_of[:-1]) & (component[1:] == component[:-1]), v[:-1], 0)
    diff = v - before
    size = bit_size(diff)
    return DC_CODE[size] << size.astype(U64) | value_bits(diff, size), DC_SIZE[size] + size


@lru_cache
def tokens() -> np.ndarray:
    """code << 6 | length of each zero run up to 15 with a value from -256 to 255 after it, at run * 512 + value + 256; no bits for value 0."""
    run, v = np.repeat(np.arange(16), 512), np.tile(np.arange(-256, 256), 16)
    size = bit_size(v)
    symbol = run << 4 | size
    code = AC_CODE[symbol] << size.astype(U64) | value_bits(v, size)
    return np.where(v == 0, U64(0), code << U64(6) | (AC_SIZE[symbol] + size).astype(U64))


def ac_first(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows of a band, and of each its number: zero runs with the value after them, and an end where zeros are left.

    All rows move along the band together; each gathers bits and puts out words of 32."""
    n, width = band.shape
    table, columns = tokens(), np.ascontiguousarray(band.T).astype(np.int64) + 256
    words = np.zeros((n, width * 20 // 32 + 2), ">u4")
    put, held, count, run = np.zeros(n, np.int64), np.zeros(n, U64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def flush():
        on = np.flatnonzero(count >= 32)
        if len(on):
            rest = count[on] - 32
            words[on, put[on]] = held[on] >> rest.astype(U64)
            held[on] &= (U64(1) << rest.astype(U64)) - U64(1)
            put[on] += 1
            count[on] = rest

    for v in columns:
        if (run > 15).any():
            some = v != 256
            while len(long := np.flatnonzero(some & (run > 15))):
                held[long] = held[long] << U64(AC_SIZE[ZRL]) | AC_CODE[ZRL]
                count[long] += AC_SIZE[ZRL]
                run[long] -= 16
                flush()
            token = np.where(some, table[np.minimum(run, 15) * 512 + v], U64(0))
        else:
            token = table[run * 512 + v]
        length = token & U64(63)
        held = held << length | token >> U64(6)
        count += length.astype(np.int64)
        run += 1
        run[v != 256] = 0
        flush()
    left = run > 0
    held = np.where(left, held << U64(AC_SIZE[EOB]) | AC_CODE[EOB], held)
    count += np.where(left, AC_SIZE[EOB], 0)
    flush()
    length = put * 4 + (count + 7) // 8
    fill = (-count % 32).astype(U64)
    words[np.arange(n), put] = held << fill | ((U64(1) << fill) - U64(1))
    return words.view(np.uint8).reshape(n, -1)[np.arange(words.shape[1] * 4) < length[:, None]], length


def ac_refine(band: np.ndarray, low: int):
    """One token a row: the bit `low` of a band of at most 15 coefficients whose higher bits are known."""
    n, width = band.shape
    size, code = np.zeros(n, np.int64), np.zeros(n, U64)
    run, held, bits = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, U64)
    magnitude = np.abs(band.astype(np.int64)) >> low

    def emit(on, symbol, extra, extra_size):
        nonlocal code, size
        length = AC_SIZE[symbol] + extra_size + held
        value = (AC_CODE[symbol] << extra_size.astype(U64) | extra) << held.astype(U64) | bits
        code = np.where(on, code << length.astype(U64) | value, code)
        size = np.where(on, size + length, size)
        run[on], held[on], bits[on] = 0, 0, 0

    one = np.ones(n, np.int64)
    for k in range(width):
        m = magnitude[:, k]
        known, new = m > 1, m == 1
        bits = np.where(known, bits << U64(1) | (m & 1).astype(U64), bits)
        held += known
        emit(new, run << 4 | 1, (band[:, k] > 0).astype(U64), one)
        run += ~known & ~new
    emit((run > 0) | (held > 0), np.zeros(n, np.int64), np.zeros(n, U64), 0 * one)
    return code, size


def segment_bytes(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache
def table_bytes() -> bytes:
    out = segment_bytes(0xDB, b"\0" + b"\1" * 64)
    for kind, lengths in ((0x00, dc_lengths()), (0x10, ac_lengths())):
        codes = canonical(lengths)
        counts = bytes(sum(n == k for _, n in codes.values()) for k in range(1, 17))
        out += segment_bytes(0xC4, bytes([kind]) + counts + bytes(codes))
    return out


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG of each payload, whose length is a positive multiple of 64."""
    frames = [frame(len(p) // 64) for p in payloads]
    units = np.array([a * d for a, d in frames], np.int64)
    blocks = 6 * units
    base = np.cumsum(blocks) - blocks
    data = np.zeros((int(blocks.sum()), 64), np.int8)
    flat = data.reshape(-1)
    for p, b in zip(payloads, base.tolist(), strict=True):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.int8)
    order = np.concatenate([unit_order(*f) + b for f, b in zip(frames, base.tolist(), strict=True)])
    unit_of, component = np.repeat(np.arange(len(order)), 6), np.tile(np.array([0, 0, 0, 0, 1, 2]), len(order))
    own = [np.concatenate([np.arange(b + u * (0, 4, 5)[c], b + u * (4, 5, 6)[c]) for b, u in zip(base.tolist(), units.tolist(), strict=True)]) for c in range(3)]
    each = [units * n for n in (4, 1, 1)]
    scans = []
    for components, first, last, high, low in SCRIPT:
        if first == 0:
            dc = data[order.reshape(-1), 0].astype(np.int64)
            if high:
                code, size = (dc >> low & 1).astype(U64), np.ones(len(dc), np.int64)
            else:
                code, size = dc_first(dc >> low, order, unit_of, component)
            scans.append(scan_bytes(*packed(code, size, unit_of, len(order)), units))
        else:
            band = data[own[components[0]], first : last + 1].astype(np.int16)
            if high:
                code, size = ac_refine(band, low)
                scans.append(scan_bytes(*packed(code, size, np.arange(len(band)), len(band)), each[components[0]]))
            else:
                scans.append(scan_bytes(*ac_first(np.sign(band) * (np.abs(band) >> low) if low else band), each[components[0]]))
    heads = []
    for components, first, last, high, low in SCRIPT:
        chosen = b"".join(bytes([c + 1, 0]) for c in components)
        heads.append(segment_bytes(0xDA, bytes([len(components)]) + chosen + bytes([first, last, high << 4 | low])))
    out = []
    for i, (p, (across, down)) in enumerate(zip(payloads, frames, strict=True)):
        sizes = struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
        parts = [b"\xff\xd8", segment_bytes(0xFE, struct.pack(">Q", len(p))), table_bytes(), segment_bytes(0xC2, sizes), segment_bytes(0xDD, b"\0\1")]
        for head, scan in zip(heads, scans, strict=True):
            parts += [head, scan[i]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


# ---- reading


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    dc: tuple[bytes, ...]
    ac: tuple[bytes, ...]
    interval: int
    data: bytes = b""

    def key(self):
        return (self.components, self.first, self.last, self.high, self.low, self.dc, self.ac)


@dataclass
class Image:
    height: int = 0
    width: int = 0
    sampling: tuple = ()
    steps: list = field(default_factory=list)  # each component's quantisation steps, in zigzag order
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @property
    def units(self) -> tuple[int, int]:
        h, v = max(s[0] for s in self.sampling), max(s[1] for s in self.sampling)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


NEXT_MARK = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(blob: bytes) -> Image:
    """The markers of a progressive file; its scans' data as they are."""
    if blob[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, tables, steps, at, interval, names, quant = Image(), {}, {}, 2, 0, [], []
    while True:
        m = NEXT_MARK.search(blob, at)
        if m is None:
            raise ValueError("the file ends early")
        marker, at = blob[m.end() - 1], m.end()
        if marker == 0xD9:
            break
        n = struct.unpack_from(">H", blob, at)[0]
        body, at = blob[at + 2 : at + n], at + n
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + total]
                body = body[17 + total :]
        elif marker == 0xC2:
            if body[0] != 8:
                raise ValueError("only samples of 8 bits")
            out.height, out.width = struct.unpack_from(">HH", body, 1)
            rows = [body[6 + 3 * k : 9 + 3 * k] for k in range(body[5])]
            names, quant = [r[0] for r in rows], [r[2] for r in rows]
            out.sampling = tuple((r[1] >> 4, r[1] & 15) for r in rows)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("not a progressive file coded by Huffman")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            k = body[0]
            pairs = [(names.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(k)]
            first, last, approx = body[1 + 2 * k : 4 + 2 * k]
            end = NEXT_MARK.search(blob, at)
            stop = end.start() if end else len(blob)
            refined_dc = first == 0 and approx >> 4
            out.scans.append(Scan(tuple(c for c, _ in pairs), first, last, approx >> 4, approx & 15, tuple(tables[t >> 4] for _, t in pairs) if first == 0 and not refined_dc else (), tuple(tables[16 | t & 15] for _, t in pairs) if first else (), interval, blob[at:stop]))
            at = stop
    out.steps = [steps[q] for q in quant]
    return out


class Lanes:
    """Bit readers over many segments at once."""

    def __init__(self, datas: list[bytes]):
        """Segments of the scans' data: split at restart marks, without the zeros after 255."""
        size = np.array([len(d) for d in datas], np.int64)
        raw_ = np.frombuffer(b"".join(datas) + b"\0", np.uint8)
        full = raw_[:-1] == 255
        after = raw_[1:]
        start = np.cumsum(size) - size
        stuffed = np.flatnonzero(full & (after == 0)) + 1
        mark = np.flatnonzero(full & (after >= 0xD0) & (after <= 0xD7))
        keep = np.ones(len(raw_) - 1, bool)
        keep[stuffed[stuffed < len(keep)]] = False
        keep[mark], keep[mark + 1] = False, False
        place = np.cumsum(np.append(0, keep))
        self.image = np.concatenate([np.arange(len(datas)), np.searchsorted(start, mark, side="right") - 1])
        begin = np.concatenate([start, mark + 2])
        order = np.lexsort((begin, self.image))
        self.image, begin = self.image[order], begin[order]
        b = np.concatenate([raw_[:-1][keep], np.zeros(80, np.uint8)]).astype(np.uint32)
        self.four = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]  # 32 bits from each byte on
        self.at = place[np.minimum(begin, len(place) - 1)] * 8  # of each segment its next bit
        self.nth = np.arange(len(order)) - np.searchsorted(self.image, self.image)

    def peek(self, lane: np.ndarray) -> np.ndarray:
        """57 bits at least."""
        at = np.minimum(self.at[lane], 8 * len(self.four) - 40)
        byte = at >> 3
        return (self.four[byte].astype(U64) << U64(32) | self.four[byte + 4]) << (at & 7).astype(U64)

    def bits(self, ahead: np.ndarray, skip: np.ndarray, n: np.ndarray) -> np.ndarray:
        """n bits (0 to 16) that follow the first `skip`."""
        return np.where(n > 0, ahead << skip.astype(U64) >> (64 - np.maximum(n, 1)).astype(U64), U64(0)).astype(np.int64)


def extended(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value of `size` bits: a leading 0 means negative."""
    return np.where((size > 0) & (bits < (1 << np.maximum(size - 1, 0))), bits - (1 << size) + 1, bits)


def read_dc(lanes: Lanes, scan: Scan, blocks: list[np.ndarray], which: list[np.ndarray], out: np.ndarray) -> None:
    """blocks[j]: the j-th block of each lane, or -1; which[j]: its component."""
    luts = np.stack([lookup(t[:16], t[16:]) for t in scan.dc]) if scan.dc else None
    last = np.zeros((len(lanes.at), max(scan.components) + 1), np.int64)
    table = np.zeros(max(scan.components) + 1, np.int64)
    table[list(scan.components)] = np.arange(len(scan.components))
    for block, component in zip(blocks, which, strict=True):
        lane = np.flatnonzero(block >= 0)
        here, c = block[lane], component[lane]
        ahead = lanes.peek(lane)
        if scan.high:
            out[here, 0] |= ((ahead >> U64(63)).astype(np.int16) << scan.low).astype(np.int16)
            lanes.at[lane] += 1
            continue
        entry = luts[table[c], (ahead >> U64(48)).astype(np.int64)]
        length, size = entry >> 8, entry & 15
        last[lane, c] += extended(lanes.bits(ahead, length, size), size)
        out[here, 0] = last[lane, c] << scan.low
        lanes.at[lane] += length + size


PLAIN, LONG, END = 0, 1, 2


@lru_cache
def whole_symbols(table: bytes) -> np.ndarray:
    """For each 16 bits ahead a symbol with its value: bits used | run << 8 | kind << 16 | (value + 2^15) << 32.

    LONG where the value reaches beyond the 16 bits; END for ends of one block."""
    entry = lookup(table[:16], table[16:])
    length, run, size = entry >> 8, entry >> 4 & 15, entry & 15
    end = (size == 0) & (run < 15)
    bits = np.arange(1 << 16) >> np.maximum(16 - length - size, 0) & (1 << size) - 1
    kind = np.where(end, np.where(run == 0, END, LONG), np.where(length + size > 16, LONG, PLAIN))
    return length + size | np.where(end, 0, run) << 8 | kind << 16 | np.where(kind == PLAIN, extended(bits, size), 0) + (1 << 15) << 32


def read_ac_first(lanes: Lanes, scan: Scan, blocks: list[np.ndarray], out: np.ndarray) -> None:
    short, lut = whole_symbols(scan.ac[0]), lookup(scan.ac[0][:16], scan.ac[0][16:])
    flat, top = out.reshape(-1), 8 * len(lanes.four) - 40
    ended = np.zeros(len(lanes.at), np.int64)  # blocks that an end still covers
    for block in blocks:
        skip = (block >= 0) & (ended > 0)
        lane = np.flatnonzero((block >= 0) & (ended == 0))
        ended[skip] -= 1
        place, at = block[lane] * 64 + scan.first, lanes.at[lane]
        stop = place + (scan.last - scan.first)
        while len(lane):
            entry = short[lanes.four[at >> 3] << (at & 7).astype(np.uint32) >> 16]
            kind = entry >> 16 & 255
            place += entry >> 8 & 255
            flat[np.minimum(place, stop)] = ((entry >> 32) - (1 << 15)) << scan.low  # ends and runs of sixteen put a zero where one is
            at += entry & 255
            place += 1
            done = (place > stop) | (kind == END)
            if (kind == LONG).any():
                x = np.flatnonzero(kind == LONG)
                place[x] -= 1 + (entry[x] >> 8 & 255)
                at[x] -= entry[x] & 255
                lanes.at[lane[x]] = at[x]
                ahead = lanes.peek(lane[x])
                e = lut[(ahead >> U64(48)).astype(np.int64)]
                length, run, size = e >> 8, e >> 4 & 15, e & 15
                extra = np.where(size == 0, run, size)
                bits = lanes.bits(ahead, length, extra)
                at[x] += length + extra
                place[x] += np.where(size > 0, run, 0)
                on = size > 0
                flat[np.minimum(place[x[on]], stop[x[on]])] = extended(bits[on], size[on]) << scan.low
                ended[lane[x[~on]]] = (1 << run[~on]) + bits[~on] - 1
                place[x] += 1
                done[x] = ~on | (place[x] > stop[x])
            np.minimum(at, top, out=at)
            if done.any():
                lanes.at[lane[done]] = at[done]
                stay = ~done
                lane, place, at, stop = lane[stay], place[stay], at[stay], stop[stay]


def read_ac_refine(lanes: Lanes, scan: Scan, blocks: list[np.ndarray], out: np.ndarray) -> None:
    lut = lookup(scan.ac[0][:16], scan.ac[0][16:])
    ended = np.zeros(len(lanes.at), np.int64)
    bit = 1 << scan.low
    for block in blocks:
        lane = np.flatnonzero(block >= 0)
        here = block[lane]
        n = len(lane)
        k, run, new = np.full(n, scan.first), np.zeros(n, np.int64), np.zeros(n, np.int64)
        over = ended[lane] > 0  # zeros are left as they are up to the block's end
        ended[lane] -= over
        ask = ~over
        live = np.arange(n)
        while len(live):
            a = live[ask[live]]
            if len(a):
                ahead = lanes.peek(lane[a])
                entry = lut[(ahead >> U64(48)).astype(np.int64)]
                length, r, size = entry >> 8, entry >> 4 & 15, entry & 15
                extra = np.where((size == 0) & (r < 15), r, size & 1)
                bits = lanes.bits(ahead, length, extra)
                lanes.at[lane[a]] += length + extra
                end = (size == 0) & (r < 15)
                over[a] = end
                ended[lane[a[end]]] = (1 << r[end]) + bits[end] - 1
                run[a], new[a], ask[a] = r, np.where(size > 0, np.where(bits > 0, bit, -bit), 0), False
            c = out[here[live], k[live]].astype(np.int64)
            old = c != 0
            x = live[old]
            if len(x):
                v = c[old]
                up = (lanes.peek(lane[x]) >> U64(63)).astype(np.int64)
                lanes.at[lane[x]] += 1
                out[here[x], k[x]] = np.where((up > 0) & (np.abs(v) & bit == 0), v + np.sign(v) * bit, v)
            z = live[~old & ~over[live]]
            put = z[run[z] == 0]
            out[here[put], k[put]] = new[put]
            ask[put] = True
            run[z] -= 1
            k[live] += 1
            live = live[k[live] <= scan.last]


@lru_cache(4096)
def layout(sampling, height: int, width: int, components: tuple[int, ...], interval: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of each segment of a scan, numbered one component after the other, and their components; -1 after the last block."""
    hm, vm = max(s[0] for s in sampling), max(s[1] for s in sampling)
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    sizes = [(down * v, across * h) for h, v in sampling]
    offsets = np.cumsum([0] + [a * b for a, b in sizes])
    if len(components) > 1:
        own = [sampling[c] for c in components]
        each = [h * v for h, v in own]
        low = np.cumsum([0] + [sizes[c][0] * sizes[c][1] for c in components])
        units = unit_order(across, down, own) + np.repeat(offsets[list(components)] - low[:-1], each)
        kind = np.broadcast_to(np.repeat(components, each), units.shape)
    else:  # without the blocks that fill up units
        c = components[0]
        h, v = sampling[c]
        rows, columns = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
        units = (np.arange(rows)[:, None] * sizes[c][1] + np.arange(columns)).reshape(-1, 1) + offsets[c]
        kind = np.full(units.shape, c)
    step = interval or len(units)
    parts = -(-len(units) // step)
    grid, what = np.full((parts * step, units.shape[1]), -1), np.zeros((parts * step, units.shape[1]), np.int64)
    grid[: len(units)], what[: len(units)] = units, kind
    return grid.reshape(parts, -1), what.reshape(parts, -1)


def fitted(a: np.ndarray, width: int, fill: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])), constant_values=fill)


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Each image's blocks, one component after the other, with 64 coefficients in zigzag order; all scans accumulated."""
    shapes = [[(im.units[1] * v, im.units[0] * h) for h, v in im.sampling] for im in images]
    count = np.array([sum(a * b for a, b in s) for s in shapes], np.int64)
    base = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), 64), np.int16)
    groups: dict = {}
    for i, im in enumerate(images):
        groups.setdefault((im.sampling, tuple(s.key() for s in im.scans)), []).append(i)
    for members in groups.values():
        for k, scan in enumerate(images[members[0]].scans):
            lanes = Lanes([images[i].scans[k].data for i in members])
            layouts = [layout(images[i].sampling, images[i].height, images[i].width, scan.components, images[i].scans[k].interval) for i in members]
            if [len(g) for g, _ in layouts] != np.bincount(lanes.image, minlength=len(members)).tolist():
                raise ValueError("restart marks don't fit the interval")
            width = max(g.shape[1] for g, _ in layouts)
            block = np.concatenate([fitted(g, width, -1) for g, _ in layouts])
            block += np.where(block < 0, 0, np.repeat(base[members], [len(g) for g, _ in layouts])[:, None])
            if scan.first == 0:
                kind = np.concatenate([fitted(c, width, 0) for _, c in layouts])
                read_dc(lanes, scan, list(block.T), list(kind.T), out)
            elif scan.high:
                read_ac_refine(lanes, scan, list(block.T), out)
            else:
                read_ac_first(lanes, scan, list(block.T), out)
    return np.split(out, base[1:].tolist()) if len(images) else []


@lru_cache
def inverse() -> np.ndarray:
    """64 coefficients in zigzag order to 64 samples."""
    x, u = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)
    return np.kron(one, one).T[zigzag()]


def rgb(image: Image, blocks: np.ndarray) -> np.ndarray:
    """The picture in full resolution, red, green and blue planes of 8 bits; chroma repeated to luma's places."""
    across, down = image.units
    hm, vm = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    planes, at = [], 0
    for (h, v), steps in zip(image.sampling, image.steps, strict=True):
        rows, columns = down * v, across * h
        own = blocks[at : at + rows * columns]
        at += rows * columns
        samples = (own * steps if (steps != 1).any() else own).astype(np.float64) @ inverse()
        plane = samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        if (h, v) != (hm, vm):
            plane = plane.repeat(vm // v, axis=0).repeat(hm // h, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        planes = [planes[0], np.zeros_like(planes[0]), np.zeros_like(planes[0])]
    y, cb, cr = planes
    out = np.empty((3, *y.shape), np.uint8)
    y = y + (128.5 + 1e-6)  # the sliver settles ties alike everywhere
    for k, colour in enumerate((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)):
        out[k] = np.clip(colour, 0, 255, out=colour)  # rounds down
    return out


def payload(image: Image, blocks: np.ndarray) -> bytes:
    return blocks.astype(np.int8).tobytes()[: struct.unpack(">Q", image.comment)[0]]


def feature(picture: np.ndarray) -> str:
    """Height, width, then mean and deviation of red, green and blue in hundredths."""
    _, height, width = picture.shape
    n, mean, deviation = height * width, [], []
    for plane in picture.reshape(3, -1):
        plane = plane.astype(np.float64)
        total, square = int(plane.sum()), int(plane @ plane)  # sums of whole numbers, exact in any order
        mean.append(total * 100 // n)
        deviation.append(int(((square * n - total * total) * 10_000 // (n * n)) ** 0.5))
    return f"{height}x{width};{','.join(map(str, mean))};{','.join(map(str, deviation))}"


def padded(text: bytes | None) -> bytes:
    text = text or b""
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media for each row of docs(doc_id, text): the text's bytes and zeros up to a positive multiple of 64, as a JPEG file.

    A null text is empty; other columns aren't read."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = raw(b)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(write([padded(t) for t in texts]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return on_texts(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, media binary")


def images_of(b: pa.RecordBatch, limit: int):
    """Slices of media with their images and blocks."""
    renamed = b.rename_columns(["text" if n == "media" else n for n in b.schema.names])
    for piece in slices([renamed], limit):
        blobs = raw(piece)
        images = [parse(m) for m in blobs]
        yield piece, blobs, images, coefficients(images)


def tensors(media: DataFrame, limit: int = 400_000) -> DataFrame:
    """doc_id, height, width, rgb for each row of media(doc_id, media): full-resolution tensors, three bytes a place, row by row."""

    def run(batches):
        for b in batches:
            for piece, _, images, blocks in images_of(b, limit):
                pictures = [rgb(i, k) for i, k in zip(images, blocks, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([p.shape[d] for p in pictures], pa.int32()) for d in (1, 2)), pa.array([p.transpose(1, 2, 0).tobytes() for p in pictures], pa.binary())], names=["doc_id", "height", "width", "rgb"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {kind}, height int, width int, rgb binary")


def inspect(media: DataFrame, limit: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: what the stored files give back."""

    def run(batches):
        for b in batches:
            for piece, blobs, images, blocks in images_of(b, limit):
                got = [payload(i, k) for i, k in zip(images, blocks, strict=True)]
                columns = [
                    pa.array([len(p) for p in got], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in got]),
                    pa.array([zlib.crc32(p[-64:]) for p in got], pa.int64()),
                    pa.array([len(m) for m in blobs], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in blobs]),
                    pa.array([feature(rgb(i, k)) for i, k in zip(images, blocks, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
