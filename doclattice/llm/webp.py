"""Media columns: lossless WebP (VP8L) written and read without an image library.

The reader decodes prefix codes, backward references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette (colour
indexing) transforms, as the public format description has them, and returns
pixel arrays (height x width x 4: red, green, blue, alpha).

Speed: with one group of prefix codes, the lengths of the codes at *every* bit
are looked up at once with numpy, which gives for each bit the one at which a
pixel that started there would end; following these ends from the first one
finds the pixels, and their symbols are then gathered at once. A colour cache is
resolved by sorting: an entry is the last pixel before it with that hash. Images
with several groups of codes are read pixel by pixel.

The writer stores a payload as pixels of four bytes. It uses a palette if there
are few distinct pixels, backward references if runs of pixels recur, and a
colour cache for longer payloads; its options turn on the other transforms.
Width is 16 pixels up to 16384 rows, and wider beyond; a last row is filled up
with zeros, which payload_of() cuts. Payloads have up to 2**30 bytes.

Columns: a null text counts as empty; empty texts have a payload of 64 zero
bytes. Equal texts give equal bytes. Extra columns pass through; columns of the
new names are replaced. Empty tables give no rows. A stored form that is not a
lossless WebP reads as null.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from doclattice.llm.bpe import map_column

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: The format's order of code length codes.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: Short distances stand for places near by: those up to 7 rows above, by distance, then by columns away, the right one first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
CACHE_HASH = 0x1E35A7BD
LONGEST_CODE = 12


class BadImage(ValueError):
    """Not a lossless WebP."""


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, limit: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a prefix code for these counts; a single symbol has length 1."""
    used = np.nonzero(counts)[0]
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    weights = counts[used].tolist()
    while True:
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent, n = [0] * (2 * len(weights)), len(weights)
        while len(heap) > 1:
            a = heapq.heappop(heap)
            b = heap[0]
            parent[a[1]] = parent[b[1]] = n
            heapq.heapreplace(heap, (a[0] + b[0], n))
            n += 1
        depth = [0] * n
        for i in range(n - 2, -1, -1):
            depth[i] = depth[parent[i]] + 1
        lengths = depth[: len(weights)]
        if max(lengths) <= limit:
            out[used] = lengths
            return out
        weights = [(w >> 1) | 1 for w in weights]


REVERSED = np.zeros(1 << 15, np.int32)
for _b in range(15):
    REVERSED |= ((np.arange(1 << 15) >> _b) & 1).astype(np.int32) << (14 - _b)


#: The numbers of so many bits, reversed.
TURNED = [(REVERSED[: 1 << _n] >> (15 - _n)).astype(np.int64) for _n in range(16)]


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol, its first bit lowest. One symbol alone needs no bits."""
    used = np.nonzero(lengths)[0]
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    # In units of 2**-15 a code of n bits is 2**(15-n) wide.
    width = np.int64(1) << (15 - size)
    start = np.cumsum(width) - width
    if len(order) > 1 and start[-1] + width[-1] != 1 << 15:
        raise BadImage("prefix code")
    codes = np.zeros(len(lengths), np.int32)
    codes[order] = REVERSED[start]
    return codes


def table_of(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Entries symbol << 4 | length by the next bits, and how many bits these are."""
    used = np.nonzero(lengths)[0]
    if not len(used):
        raise BadImage("empty prefix code")
    if len(used) == 1:
        return np.array([int(used[0]) << 4], np.int32), 0
    most = int(lengths.max())
    if int((1 << (15 - lengths[used].astype(np.int64))).sum()) != 1 << 15:
        raise BadImage("prefix code")
    # In the order of the first-bit-highest codes each symbol fills one stretch.
    order = used[np.argsort(lengths[used], kind="stable")]
    high = np.repeat((order << 4 | lengths[order]).astype(np.int32), 1 << (most - lengths[order].astype(np.int64)))
    return high[TURNED[most]], most


# ---------------------------------------------------------------- reading


class Bits:
    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        at = self.at
        if at + n > 8 * len(self.data):
            raise BadImage("ends early")
        word = int.from_bytes(self.data[at >> 3 : (at >> 3) + 6], "little") >> (at & 7)
        self.at = at + n
        return word & ((1 << n) - 1)

    def same(self, start: int, n: int) -> bool:
        """Whether the next n bits are those at start: a code that is written again needn't be read again."""
        if self.at + n > 8 * len(self.data):
            return False
        a, b = (int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) for p in (start, self.at))
        return not (a ^ b) & ((1 << n) - 1)

    def symbol(self, table: tuple[np.ndarray, int]) -> int:
        entries, most = table
        word = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 4], "little") >> (self.at & 7)
        e = int(entries[word & ((1 << most) - 1)])
        self.at += e & 15
        if self.at > 8 * len(self.data):
            raise BadImage("ends early")
        return e >> 4


def read_lengths(bits: Bits, size: int) -> np.ndarray:
    out = np.zeros(size, np.uint8)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= size:
            raise BadImage("symbol")
        out[symbols] = 1
        return out
    lengths = np.zeros(19, np.uint8)
    for i in range(4 + bits.read(4)):
        lengths[LENGTH_ORDER[i]] = bits.read(3)
    entries, most = table_of(lengths)
    entries, mask = entries.tolist(), (1 << most) - 1
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    data, at, i, before, values = bits.data, bits.at, 0, 8, []
    while i < size and left:
        left -= 1
        word = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        e = entries[word & mask]
        at += e & 15
        s = e >> 4
        if s < 16:
            values.append(s)
            i += 1
            before = s or before
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            n = least + ((word >> (e & 15)) & ((1 << extra) - 1))
            at += extra
            values += [before if s == 16 else 0] * n
            i += n
    if i > size or at > 8 * len(data):
        raise BadImage("code lengths")
    bits.at = at
    out[:i] = values
    return out


def extended(s: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if s < 4:
        return s + 1
    extra = (s - 2) >> 1
    return ((2 + (s & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def scan(bits: Bits, group: list, n: int, width: int, cache_bits: int, referring: bool) -> np.ndarray:
    """n pixels read with one group of codes: lengths at every bit, then the chain of those at which pixels start."""
    if not cache_bits and not referring and group[0][1] and all(t[0] is group[0][0] for t in group[1:4]):
        return scan_plain(bits, group[0], n)
    raw = np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3)
    base = (bits.at >> 3) << 3
    padded = np.zeros(len(raw) + 12, np.int64)
    padded[: len(raw)] = raw
    words = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    window = (words[:, None] >> np.arange(8)).ravel()
    end = len(window)
    here = np.arange(end)
    looked: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def look(table):
        """Entries at every bit, and where what starts there ends; none at the very end, so that no place leads beyond it."""
        if id(table[0]) not in looked:
            e = table[0].take(window & ((1 << table[1]) - 1))
            size = e & 15
            size[-16:] = 0
            looked[id(table[0])] = e, here + size
        return looked[id(table[0])]

    e, first = look(group[0])
    after = [first]
    parts = [look(t)[0] for t in group[1:4]]
    for t in group[1:4]:
        at = after[-1]
        after.append(look(t)[1].take(at) if t[1] else at)
    nxt = after[3]
    run = None
    special = np.nonzero(e >= 256 << 4)[0] if cache_bits or referring else np.empty(0, np.int64)
    far = None
    if len(special):
        nxt = nxt.copy()
        kind = e[special] >> 4
        cached = special[kind >= 280]
        nxt[cached] = after[0][cached]
        refs = special[kind < 280]
        if len(refs) and referring:
            run, far = np.ones(end, np.int64), np.zeros(end, np.int64)

            def extra(s, at):
                k = np.where(s < 4, 0, (s - 2) >> 1)
                got = (window[at] | padded[np.minimum((at >> 3) + 4, len(padded) - 1)] << (32 - (at & 7))) & ((1 << k) - 1)
                return np.where(s < 4, s + 1, ((2 + (s & 1)) << k) + got + 1), np.minimum(at + k, end - 1)

            length, at = extra((e[refs] >> 4) - 256, after[0][refs].astype(np.int64))
            d, behind = look(group[4])
            dist, at = extra(d[at] >> 4, np.minimum(behind[at], end - 1))
            nxt[refs], run[refs], far[refs] = at, np.minimum(length, n), dist
    chain = memoryview(nxt)
    starts, p = [], bits.at - base
    limit = 8 * len(bits.data) - base
    if run is None and not any(t[1] for t in group[:4]):  # one symbol for each channel: pixels take no bits
        starts = np.full(n, p)
    elif run is None:
        if n > limit - p:
            raise BadImage("ends early")
        for _ in range(n):
            starts.append(p)
            p = chain[p]
    else:
        runs, done = memoryview(run), 0
        while done < n:
            if p >= limit:
                raise BadImage("ends early")
            starts.append(p)
            done += runs[p]
            p = chain[p]
    if base + p > 8 * len(bits.data):
        raise BadImage("ends early")
    bits.at = base + p
    at = np.array(starts, np.int64)
    g = e[at] >> 4
    value = lambda k: (parts[k][after[k][at]] >> 4).astype(np.uint32)
    argb = value(2) << 24 | value(0) << 16 | (g & 255).astype(np.uint32) << 8 | value(1)
    if run is not None and (run[at] > 1).any() or (run is not None and (far[at] > 0).any()):
        return resolve(argb.tolist(), g.tolist(), run[at].tolist(), far[at].tolist(), n, width, cache_bits)
    hits = g >= 280
    if hits.any():
        # The entry of a hash is the last pixel with it before; what is read from the cache only repeats one.
        index = np.where(hits, g - 280, hash_of(argb, cache_bits)).astype(np.int64)
        order = np.argsort(index, kind="stable")
        source = np.where(hits[order], -1, np.arange(n))
        begins = np.ones(n, bool)
        begins[1:] = index[order][1:] != index[order][:-1]
        floor = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        last = np.maximum.accumulate(source)
        filled = np.where(last >= floor, argb[order][np.maximum(last, 0)], 0)
        argb[order] = np.where(hits[order], filled, argb[order])
    return argb


def scan_plain(bits: Bits, table: tuple[np.ndarray, int], n: int) -> np.ndarray:
    """n pixels whose four channels have one code: only the code's lengths are looked up at every bit, all else where channels start."""
    entries, most = table
    base = (bits.at >> 3) << 3
    raw = bits.data[bits.at >> 3 :] + bytes(8)
    words = np.ndarray(len(raw) - 4, "<u4", raw, strides=(1,)).astype(np.int64)
    window = ((words[:, None] >> np.arange(8)) & ((1 << most) - 1)).ravel()
    one = (entries & 15).astype(np.int64).take(window)
    one[-16:] = 0  # so that no place leads beyond the end
    one += np.arange(len(one))
    two = one.take(one)
    four = two.take(two)
    starts, p, limit = [], bits.at - base, 8 * len(bits.data) - base
    if n > limit - p:
        raise BadImage("ends early")
    chain, eight = memoryview(four), memoryview(four.take(four))
    for _ in range(n >> 1):
        starts.append(p)
        p = eight[p]
    if n & 1:
        starts.append(p)
    at = np.empty(n, np.int64)
    at[::2] = starts
    at[1::2] = four.take(at[: n - 1 : 2])
    p = chain[int(at[-1])]
    if base + p > 8 * len(bits.data):
        raise BadImage("ends early")
    bits.at = base + p
    symbols = (entries >> 4).astype(np.uint32)
    out = symbols.take(window.take(at)) << 8
    for shift in (16, 0, 24):
        at = one.take(at)
        out |= symbols.take(window.take(at)) << shift
    return out


def hash_of(argb: np.ndarray, bits: int) -> np.ndarray:
    return (argb.astype(np.uint32) * np.uint32(CACHE_HASH)) >> np.uint32(32 - bits)


def resolve(argb: list, symbols: list, runs: list, far: list, n: int, width: int, cache_bits: int) -> np.ndarray:
    """Pixels in order, with backward references and the colour cache."""
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    for value, s, run, d in zip(argb, symbols, runs, far):
        if s < 256:
            new = [value]
        elif s >= 280:
            new = [cache[s - 280]]
        else:
            d = distance_of(d, width)
            if d > len(out):
                raise BadImage("distance")
            run = min(run, n - len(out))
            new = out[len(out) - d : len(out) - d + run] if run <= d else (out[-d:] * (run // d + 1))[:run]
        out += new
        if cache_bits:
            for v in new:
                cache[(v * CACHE_HASH & 0xFFFFFFFF) >> shift] = v
    return np.array(out[:n], np.uint32)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("colour cache")
    groups_at, block, n_groups = None, 0, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        w, h = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
        groups_at = ((read_pixels(bits, w, h, False) >> 8) & 0xFFFF).reshape(h, w)
        n_groups = int(groups_at.max()) + 1
    sizes = [256 + 24 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40]
    groups, referring, seen = [], False, {}
    for _ in range(n_groups):
        group = []
        before = (0, 0, None)
        for k, size in enumerate(sizes):
            start, n_bits, lengths = before
            if k and k < 4 and n_bits and not lengths[256:].any() and bits.same(start, n_bits):
                lengths = lengths[:256]
                bits.at += n_bits
            else:
                start = bits.at
                lengths = read_lengths(bits, size)
            before = (start, bits.at - start if bits.at - start > 40 else 0, lengths) if start != before[0] else before
            referring |= k == 0 and bool(lengths[256:280].any())
            key = lengths[:256].tobytes() if not lengths[256:].any() else lengths.tobytes()
            if key not in seen:
                seen[key] = table_of(lengths) if k < 4 or lengths.any() else (np.zeros(1, np.int32), 0)
            group.append(seen[key])
        groups.append(group)
    n = width * height
    if n_groups == 1:
        return scan(bits, groups[0], n, width, cache_bits, referring)
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    while len(out) < n:
        y, x = divmod(len(out), width)
        group = groups[int(groups_at[y >> block, x >> block])]
        s = bits.symbol(group[0])
        if s < 256:
            r, b, a = (bits.symbol(t) for t in group[1:4])
            new = [a << 24 | r << 16 | s << 8 | b]
        elif s >= 280:
            new = [cache[s - 280]]
        else:
            run = extended(s - 256, bits)
            d = distance_of(extended(bits.symbol(group[4]), bits), width)
            if d > len(out):
                raise BadImage("distance")
            run = min(run, n - len(out))
            new = (out[-d:] * (run // d + 1))[:run]
        out += new
        if cache_bits:
            for v in new:
                cache[(v * CACHE_HASH & 0xFFFFFFFF) >> shift] = v
    return np.array(out, np.uint32)


# ---------------------------------------------------------------- transforms


def add(a: int, b: int) -> int:
    """Sum by channel."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def mean(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def channels(v: int) -> tuple[int, int, int, int]:
    return v >> 24, v >> 16 & 255, v >> 8 & 255, v & 255


def select(left: int, top: int, corner: int) -> int:
    """Of left and top the one nearer to left + top - corner."""
    to_left = to_top = 0
    for a, b, c in zip(channels(left), channels(top), channels(corner)):
        to_left += abs(b - c)
        to_top += abs(a - c)
    return left if to_left < to_top else top


def clamped(a: int, b: int, c: int, half: bool) -> int:
    out = 0
    for x, y, z in zip(channels(a), channels(b), channels(c)):
        v = x + int((x - y) / 2) if half else x + y - z
        out = out << 8 | max(0, min(255, v))
    return out


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The predicted pixel from those to the left, above, above to the right and above to the left."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode < 10:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        return select(left, top, corner)
    if mode == 12:
        return clamped(left, top, corner, False)
    return clamped(mean(left, top), corner, 0, True)


def predicted(known, x: int, y: int, width: int, modes, block: int) -> int:
    """The prediction for a place, from pixels known up to it. known: a flat list."""
    at = y * width + x
    if y == 0:
        return known[at - 1] if x else 0xFF000000
    if x == 0:
        return known[at - width]
    right = known[at - width + 1]  # beyond the last column this is the row's first pixel
    return predict(modes[y >> block][x >> block], known[at - 1], known[at - width], right, known[at - width - 1])


def undo_predictor(argb: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    rest, rows, out = argb.tolist(), (modes >> 8 & 15).tolist(), []
    for y in range(height):
        for x in range(width):
            out.append(0)
            out[-1] = add(rest[y * width + x], predicted(out, x, y, width, rows, block))
    return np.array(out, np.uint32)


def cross(argb: np.ndarray, width: int, height: int, block: int, elements: np.ndarray, sign: int) -> np.ndarray:
    """Adds (1) or takes away (-1) the cross-colour deltas."""
    y, x = np.divmod(np.arange(width * height), width)
    e = elements[y >> block, x >> block]
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    green, red, blue = argb >> 8, (argb >> 16 & 255).astype(np.int32), (argb & 255).astype(np.int32)
    new_red = red + sign * delta(e, green) & 255
    source = new_red if sign > 0 else red
    new_blue = blue + sign * (delta(e >> 8, green) + delta(e >> 16, source)) & 255
    return argb & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)


def shift_green(argb: np.ndarray, sign: int) -> np.ndarray:
    green = (argb >> 8 & 255).astype(np.int64)
    red, blue = ((argb >> 16 & 255) + sign * green) & 255, ((argb & 255) + sign * green) & 255
    return argb & np.uint32(0xFF00FF00) | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def by_channel_sum(argb: np.ndarray) -> np.ndarray:
    parts = argb.view(np.uint8).reshape(-1, 4)
    return np.ascontiguousarray(np.cumsum(parts, 0, dtype=np.uint8)).view(np.uint32).ravel()


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---------------------------------------------------------------- writing


class Writer:
    """Bits, the first lowest: single values, and arrays of codes."""

    def __init__(self) -> None:
        self.value, self.size, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def settle(self) -> None:
        if self.size:
            raw = np.frombuffer(self.value.to_bytes((self.size + 7) // 8, "little"), np.uint8)
            self.parts.append(np.unpackbits(raw, bitorder="little")[: self.size])
            self.value = self.size = 0

    def put_all(self, codes: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of four codes, up to 64 bits a row."""
        if not len(codes):
            return
        sizes = sizes.astype(np.uint64)
        row, width = codes[:, 0].astype(np.uint64), sizes[:, 0].copy()
        for k in (1, 2, 3):
            row |= codes[:, k].astype(np.uint64) << width
            width += sizes[:, k]
        ends = np.cumsum(width)
        starts = ends - width
        total = int(ends[-1])
        if not total:
            return
        self.settle()
        # Rows are at most as long as a word of 64 bits, so one starts in each but perhaps the last, which its last row may run over.
        word, shift = starts >> np.uint64(6), starts & np.uint64(63)
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        out = np.zeros((total + 63) // 64 + 1, np.uint64)
        out[word[first].astype(np.int64)] = np.add.reduceat(row << shift, first)
        last = np.concatenate([first[1:] - 1, [len(row) - 1]])
        over = last[shift[last] > 0]
        out[word[over].astype(np.int64) + 1] |= row[over] >> (np.uint64(64) - shift[over])
        self.parts.append(np.unpackbits(out.view(np.uint8), bitorder="little")[:total])

    def bytes(self) -> bytes:
        self.settle()
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def put_lengths(w: Writer, lengths: np.ndarray) -> None:
    used = np.nonzero(lengths)[0]
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.put(1, 1)
        w.put(0, 1)
        w.put(int(s > 1), 1)
        w.put(s, 8 if s > 1 else 1)
        return
    values = lengths[: used[-1] + 1].tolist()
    tokens, i, n = [], 0, len(values)
    while i < n:
        v = values[i]
        if v:
            tokens.append((v, 0, 0))
            i += 1
            continue
        z = i
        while values[z] == 0:
            z += 1
        run = z - i
        i = z
        while run >= 11:
            k = min(run, 138)
            tokens.append((18, k - 11, 7))
            run -= k
        if run >= 3:
            tokens.append((17, run - 3, 3))
        else:
            tokens += [(0, 0, 0)] * run
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    sizes = code_lengths(counts, 7)
    codes = codes_of(sizes).tolist() if np.count_nonzero(sizes) > 1 else [0] * 19
    bits = sizes.tolist() if np.count_nonzero(sizes) > 1 else [0] * 19
    order = sizes[LENGTH_ORDER].tolist()
    last = max(4, max(i for i in range(19) if order[i]) + 1)
    value, size = 0, 0
    for v, k in ((0, 1), (last - 4, 4), *((x, 3) for x in order[:last])):
        value |= v << size
        size += k
    left = len(tokens)
    if left < 2:
        tokens, left = [*tokens, (0, 0, 0)], 2
    n_bits = max(2, ((left - 2).bit_length() + 1) // 2 * 2)
    for v, k in ((1, 1), ((n_bits - 2) // 2, 3), (left - 2, n_bits)):
        value |= v << size
        size += k
    for t, extra, k in tokens:
        value |= (codes[t] | extra << bits[t]) << size
        size += bits[t] + k
    w.put(value, size)


def prefix_symbol(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number for lengths or distances from 1."""
    v = np.asarray(v, np.int64) - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    k = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + ((v >> np.maximum(top - 1, 0)) & 1)), np.where(v < 4, 0, v & ((1 << k) - 1)), k


def recurring(argb: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, distance) of stretches that repeat earlier pixels, none inside of another."""
    n = len(argb)
    if n < 2 * least:
        return []
    h = argb.astype(np.uint64)
    window = h[:-3] * np.uint64(0x9E3779B97F4A7C15) + h[1:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:-1] * np.uint64(0x165667B19E3779F9) + h[3:] * np.uint64(0x27D4EB2F165667C5)
    ordered = np.sort(window)
    if not (ordered[1:] == ordered[:-1]).any():
        return []
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    before = np.full(n, -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    out, i, values, prev = [], 0, argb.tolist(), before.tolist()
    candidates = np.nonzero(before >= 0)[0].tolist()
    for c in candidates:
        if c < i:
            continue
        p, k = prev[c], 0
        while c + k < n and k < 4096 and values[p + k] == values[c + k]:
            k += 1
        if k >= least:
            out.append((c, k, c - p))
            i = c + k
    return out


def put_plain(w: Writer, channels: np.ndarray) -> None:
    """Pixels (rows of green, red, blue, alpha) with one code for all four channels, written four times."""
    shared = code_lengths(np.bincount(channels.ravel(), minlength=256))
    one = Writer()
    put_lengths(one, shared)
    for _ in range(4):
        w.put(one.value, one.size)
    put_lengths(w, np.zeros(40, np.uint8))
    w.put_all(codes_of(shared)[channels], shared[channels])


def put_pixels(w: Writer, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, refer: bool = False, groups: tuple[int, np.ndarray] | None = None) -> None:
    n = len(argb)
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(groups is not None), 1)
    refs = recurring(argb) if refer else []
    if groups is None and not cache_bits and not refs and n >= 16:
        parts = np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(n, 4)
        if (parts != parts[0]).any(0)[[0, 2, 3]].all():
            put_plain(w, parts[:, [1, 2, 0, 3]])
            return
    of_group = np.zeros(n, np.int64)
    if groups is not None:
        block, at = groups
        w.put(block - 2, 3)
        put_pixels(w, (at.astype(np.uint32) << 8).ravel(), at.shape[1], False)
        y, x = np.divmod(np.arange(n), width)
        of_group = at[y >> block, x >> block].astype(np.int64)
    symbol = (argb >> 8 & 255).astype(np.int64)
    keep = np.ones(n, bool)
    if cache_bits:
        index = hash_of(argb, cache_bits).astype(np.int64)
        order = np.argsort(index, kind="stable")
        hit = np.zeros(n, bool)
        hit[order[1:]] = (index[order][1:] == index[order][:-1]) & (argb[order][1:] == argb[order][:-1])
        symbol[hit] = 280 + index[hit]
    far = np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)
    for start, length, d in refs:
        keep[start : start + length] = False
        keep[start], run[start], far[start] = True, length, d + len(NEAR)
    at = np.nonzero(keep)[0]
    symbol, run, far, value, of_group = symbol[at], run[at], far[at], argb[at], of_group[at]
    is_ref = run > 0
    length_symbol, length_extra, length_bits = prefix_symbol(run[is_ref])
    far_symbol, far_extra, far_bits = prefix_symbol(far[is_ref])
    symbol[is_ref] = 256 + length_symbol
    literal = symbol < 256
    red, blue, alpha = (value >> 16 & 255).astype(np.int64), (value & 255).astype(np.int64), (value >> 24).astype(np.int64)
    size = 280 + ((1 << cache_bits) if cache_bits else 0)
    # Four codes for each pixel in a row: green (or what stands for it), then the others or the extra bits and the distance.
    codes, sizes = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)

    def lookup(lengths, symbols):
        if np.count_nonzero(lengths) <= 1:
            return 0, 0
        return codes_of(lengths)[symbols], lengths[symbols]

    far_code, far_size = np.zeros(len(far_symbol), np.int64), np.zeros(len(far_symbol), np.int64)
    for g in range(int(of_group.max()) + 1 if groups is not None else 1):
        mine = of_group == g if groups is not None else slice(None)
        lit = literal & mine if groups is not None else literal
        counts = np.bincount(symbol[mine], minlength=size)
        r, b, a = red[lit], blue[lit], alpha[lit]
        green = code_lengths(counts)
        put_lengths(w, green)
        codes[mine, 0], sizes[mine, 0] = lookup(green, symbol[mine])
        counts = [np.bincount(v, minlength=256) for v in (r, b, a)]
        if len(r) and all((c > 0).sum() > 1 for c in counts):  # one code for the three
            counts = [sum(counts)] * 3
            shared = code_lengths(counts[0])
            lengths = [shared] * 3
            mark = w.size
            put_lengths(w, shared)
            same, n_bits = w.value >> mark, w.size - mark
            w.put(same, n_bits)
            w.put(same, n_bits)
            code = codes_of(shared)
            for k, v in ((1, r), (2, b), (3, a)):
                codes[lit, k], sizes[lit, k] = code[v], shared[v]
        else:
            for k, v, c in zip((1, 2, 3), (r, b, a), counts):
                lengths = code_lengths(c)
                put_lengths(w, lengths)
                codes[lit, k], sizes[lit, k] = lookup(lengths, v)
        mine_refs = (of_group[is_ref] == g) if groups is not None else np.ones(len(far_symbol), bool)
        dist = code_lengths(np.bincount(far_symbol[mine_refs], minlength=40))
        put_lengths(w, dist)
        far_code[mine_refs], far_size[mine_refs] = lookup(dist, far_symbol[mine_refs])
    if len(far_symbol):
        codes[is_ref, 1], sizes[is_ref, 1] = length_extra, length_bits
        codes[is_ref, 2], sizes[is_ref, 2] = far_code, far_size
        codes[is_ref, 3], sizes[is_ref, 3] = far_extra, far_bits
    w.put_all(codes, sizes)


def encode(argb: np.ndarray, width: int, height: int, transforms: tuple = (), cache_bits: int = 0, refer: bool = True, groups=None, block: int = 3, modes=None, elements=None) -> bytes:
    """A WebP file of the pixels (flat, alpha highest). transforms: in the order in which the reader must undo the last first."""
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    now = argb.astype(np.uint32)
    wide = width
    for t in transforms:
        w.put(1, 1)
        w.put(t, 2)
        cells = ((height + (1 << block) - 1) >> block, (wide + (1 << block) - 1) >> block)
        if t == PREDICTOR:
            at = np.asarray(modes if modes is not None else np.full(cells, 11)).reshape(cells)
            known, rows = now.tolist(), at.tolist()
            rest = [add(known[y * wide + x], negative(predicted(known, x, y, wide, rows, block))) for y in range(height) for x in range(wide)]
            w.put(block - 2, 3)
            put_pixels(w, (at.astype(np.uint32) << 8).ravel(), cells[1], False)
            now = np.array(rest, np.uint32)
        elif t == CROSS_COLOUR:
            at = np.asarray(elements if elements is not None else np.full(cells, 0x102030), np.uint32).reshape(cells)
            w.put(block - 2, 3)
            put_pixels(w, at.ravel() | np.uint32(0xFF000000), cells[1], False)
            now = cross(now, wide, height, block, at, -1)
        elif t == SUBTRACT_GREEN:
            now = shift_green(now, -1)
        else:
            colours, index = np.unique(now, return_inverse=True)
            w.put(len(colours) - 1, 8)
            steps = np.array([add(int(c), negative(int(p))) for c, p in zip(colours, [0, *colours[:-1]])], np.uint32)
            put_pixels(w, steps, len(colours), False)
            k = bundle_bits(len(colours))
            per, size = 1 << k, 8 >> k
            new = (wide + per - 1) // per
            cells_of = np.zeros((height, new * per), np.uint32)
            cells_of[:, :wide] = index.reshape(height, wide)
            packed = (cells_of.reshape(height, new, per) << (np.arange(per, dtype=np.uint32) * size)).sum(2, dtype=np.uint32)
            now, wide = packed.ravel() << np.uint32(8) | np.uint32(0xFF000000), new
    w.put(0, 1)
    put_pixels(w, now, wide, True, cache_bits, refer, groups)
    data = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def negative(v: int) -> int:
    """Each channel's complement to 256."""
    return ((0x100 - (v >> 24)) & 255) << 24 | ((0x100 - (v >> 16 & 255)) & 255) << 16 | ((0x100 - (v >> 8 & 255)) & 255) << 8 | ((0x100 - (v & 255)) & 255)


def decode(file: bytes) -> np.ndarray:
    """height x width x 4 samples (red, green, blue, alpha) of a lossless WebP file."""
    try:
        return decode_file(file)
    except (IndexError, struct.error) as e:
        raise BadImage(str(e)) from e


def decode_file(file: bytes) -> np.ndarray:
    if file[:4] != b"RIFF" or file[8:12] != b"WEBP":
        raise BadImage("no WebP file")
    at = 12
    while file[at : at + 4] != b"VP8L":
        if at + 8 > len(file):
            raise BadImage("no lossless image")
        size = struct.unpack_from("<I", file, at + 4)[0]
        at += 8 + size + (size & 1)
    size = struct.unpack_from("<I", file, at + 4)[0]
    bits = Bits(file[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise BadImage("signature")
    width, height, has_alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise BadImage("version")
    undo, wide = [], width
    while bits.read(1):
        t = bits.read(2)
        if t in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            w, h = (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            undo.append((t, wide, block, read_pixels(bits, w, h, False).reshape(h, w)))
        elif t == SUBTRACT_GREEN:
            undo.append((t, wide, 0, None))
        else:
            colours = bits.read(8) + 1
            undo.append((t, wide, bundle_bits(colours), by_channel_sum(read_pixels(bits, colours, 1, False))))
            wide = (wide + (1 << undo[-1][2]) - 1) >> undo[-1][2]
    argb = read_pixels(bits, wide, height, True)
    for t, before, k, data in reversed(undo):
        if t == PREDICTOR:
            argb = undo_predictor(argb, before, height, k, data)
        elif t == CROSS_COLOUR:
            argb = cross(argb, before, height, k, data, 1)
        elif t == SUBTRACT_GREEN:
            argb = shift_green(argb, 1)
        else:
            index = (argb >> 8 & 255).reshape(height, -1)
            if k:
                size = 8 >> k
                index = (index[:, :, None] >> (np.arange(1 << k, dtype=np.uint32) * size)) & ((1 << size) - 1)
                index = index.reshape(height, -1)[:, :before]
            colours = np.concatenate([data, np.zeros(256, np.uint32)])
            argb = colours[index.ravel()]
    out = np.empty((height, width, 4), np.uint8)
    for k, shift in enumerate((16, 8, 0, 24)):
        out[:, :, k] = (argb >> np.uint32(shift) & np.uint32(255)).reshape(height, width)
    if not has_alpha:
        out[:, :, 3] = 255
    return out


# ---------------------------------------------------------------- payloads and columns


def payload_size(n_bytes: int) -> int:
    return max(64, -(-n_bytes // 64) * 64)


def shape_of(size: int) -> tuple[int, int]:
    """Width and height in pixels for a payload."""
    rows = size // 64
    k = -(-rows // 16384)
    return 16 * k, -(-rows // k)


def store(data: bytes) -> bytes:
    """A WebP file of the bytes, filled up with zeros to a positive multiple of 64."""
    size = payload_size(len(data))
    width, height = shape_of(size)
    raw = np.zeros(4 * width * height, np.uint8)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    argb = np.ascontiguousarray(raw.reshape(-1, 4)[:, [2, 1, 0, 3]]).view("<u4").ravel()
    n = len(argb)
    most = min(256, n // 8)  # colours of a palette; those of the first pixels mostly are too many
    if n <= 16 or (len(np.unique(argb[: most + 64])) <= most and len(np.unique(argb)) <= most):
        return encode(argb, width, height, (PALETTE,))
    return encode(argb, width, height, cache_bits=8 if n >= 4096 else 0)


def payload_of(pixels: np.ndarray, n_bytes: int | None = None) -> bytes:
    """The payload that an image stores; without its size, all samples."""
    raw = pixels.tobytes()
    return raw if n_bytes is None else raw[: payload_size(n_bytes)]


def feature_of(pixels: np.ndarray) -> str:
    """Size and the mean of each channel in 1/1000."""
    h, w, _ = pixels.shape
    means = (pixels.reshape(-1, 4).sum(0, dtype=np.int64) * 1000) // (h * w)
    return f"{w}x{h}:" + ",".join(map(str, means.tolist()))


def store_column(df: DataFrame, text: str = "text", media: str = "media", keep: bool = True) -> DataFrame:
    """Appends n_bytes and the stored form of each text's UTF-8 bytes."""

    def make():
        def run(texts):
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            return [[len(d) for d in data], [store(d) for d in data]]

        return run

    return map_column(df, text, [("n_bytes", "long", pa.int64()), (media, "binary", pa.binary())], make, keep)


def read_column(df: DataFrame, media: str = "media") -> DataFrame:
    """Appends width, height, pixels (rows of red, green, blue, alpha samples) and feature; null where the media isn't a lossless WebP."""

    def make():
        def run(files):
            out = []
            for f in files:
                try:
                    p = decode(f) if f is not None else None
                except BadImage:
                    p = None
                out.append((None,) * 4 if p is None else (p.shape[1], p.shape[0], p.tobytes(), feature_of(p)))
            return [list(c) for c in zip(*out)] if out else [[], [], [], []]

        return run

    new = [("width", "int", pa.int32()), ("height", "int", pa.int32()), ("pixels", "binary", pa.binary()), ("feature", "string", pa.string())]
    return map_column(df, media, new, make)
