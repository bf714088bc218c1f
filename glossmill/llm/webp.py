"""Lossless WebP: a decoder of whole VP8L streams, an encoder, and the store and read operators.

The decoder reads prefix codes (simple, and with coded lengths), groups of codes by an entropy
image, back-references with the two-dimensional distance codes, and the colour cache; it inverts
the predictor, cross-colour, subtract-green and palette transforms. Pictures are encoded some hundred
at a time, with arrays over all their pixels, and read side by side, a symbol of each at a time; those of
few colours or of flat parts are tried with the transforms one by one, and the largest are read alone at
the end. Inverse transforms work on whole arrays wherever a pixel does not depend on its left neighbour.

Defined cases: null and empty texts are stored as one row of 64 pixels of spaces; a payload that is
too high for one picture becomes several, one after another; rows may repeat; other columns are
ignored; an empty table gives an empty result; a damaged stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WIDTH, ROW_BYTES, MOST_ROWS = 64, 192, 16384
#: The order in which the lengths of code length codes are stored.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
#: The offsets (x, y) that the first 120 distance codes stand for.
NEAR = [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7)]
REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
#: The same of 15 bits.
REVERSED15 = (REVERSED[np.arange(1 << 15) & 255].astype(np.int64) << 8 | REVERSED[np.arange(1 << 15) >> 8]) >> 1
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)


class Bits:
    """Reads least significant bits first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self._words: list[int] | None = None

    def words(self) -> list[int]:
        """The 64 bits from each byte on."""
        if self._words is None:
            self._words = np.ndarray((len(self.data) + 8,), "<u8", self.data + bytes(16), strides=(1,)).tolist()
        return self._words

    def peek(self, n: int) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end + 64:
            raise ValueError("the stream ends too early")
        return v


class Code:
    """A canonical prefix code: symbols by their lengths."""

    def __init__(self, lengths: dict[int, int]) -> None:
        used = sorted((n, s) for s, n in lengths.items() if n)
        self.single = used[0][1] if len(used) == 1 else None
        self.lengths = lengths
        if not used or self.single is None and sum(1 << (15 - n) for n, _ in used) != 1 << 15:
            raise ValueError("not a complete prefix code")
        #: By the next bits: symbol and length of its code.
        self.look, self.mask = [used[0][1] << 4], 0
        if self.single is None:
            most = used[-1][0]
            self.mask = (1 << most) - 1
            wide = np.repeat([s << 4 | n for n, s in used], [1 << (most - n) for n, _ in used])
            self.look = wide[REVERSED15[: 1 << most] >> (15 - most)].tolist()

    def read(self, bits: Bits) -> int:
        e = self.look[bits.peek(15) & self.mask]
        bits.read(e & 15)
        return e >> 4


def read_code(bits: Bits, alphabet: int) -> Code:
    """A code."""
    if bits.read(1):
        two = bits.read(1)
        lengths = {bits.read(8 if bits.read(1) else 1): 1}
        if two:
            lengths[bits.read(8)] = 1
    else:
        order = LENGTH_ORDER[: 4 + bits.read(4)]
        inner = Code({s: n for s in order if (n := bits.read(3))})
        tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
        lengths, s, last = {}, 0, 8
        while s < alphabet and tokens:
            tokens -= 1
            t = inner.read(bits)
            if t < 16:
                if t:
                    lengths[s] = last = t
                s += 1
            elif t == 16:
                for _ in range(3 + bits.read(2)):
                    lengths[s] = last
                    s += 1
            else:
                s += 3 + bits.read(3) if t == 17 else 11 + bits.read(7)
        if s > alphabet:
            raise ValueError("more code lengths than symbols")
    return Code(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image as (height, width, 4) of red, green, blue, alpha."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    cache_size = 1 << cache_bits if cache_bits else 0
    groups, group_of, tile = 1, None, 0
    if top and bits.read(1):
        tile = bits.read(3) + 2
        meta = read_pixels(bits, -(-width // (1 << tile)), -(-height // (1 << tile)), False)
        group_of = meta[..., 0].astype(int) << 8 | meta[..., 1]
        groups = int(group_of.max()) + 1
    codes = [[read_code(bits, 280 + cache_size), *(read_code(bits, 256) for _ in range(3)), read_code(bits, 40)] for _ in range(groups)]
    n = width * height
    pixels, cache = [0] * n, [0] * cache_size
    _read_symbols(bits, codes, group_of, tile, width, pixels, 0, cache, cache_bits)
    v = np.array(pixels, np.uint32)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], axis=1).astype(np.uint8).reshape(height, width, 4)


def _read_symbols(bits: Bits, codes: list, group_of: np.ndarray | None, tile: int, width: int, pixels: list[int], at: int, cache: list[int], cache_bits: int) -> None:
    """Fills the pixels (alpha, red, green, blue from the top byte) from a place on; the cache holds what stands before it."""
    n, cached = len(pixels), at
    words, p = bits.words(), bits.at
    green, red, blue, alpha, far = codes[0]
    try:
        while at < n:
            if group_of is not None:
                green, red, blue, alpha, far = codes[group_of[at // width >> tile, at % width >> tile]]
            x = words[p >> 3] >> (p & 7)
            e = green.look[x & green.mask]
            s, k = e >> 4, e & 15
            p += k
            if s < 256:
                x >>= k
                r = red.look[x & red.mask]
                x >>= r & 15
                b = blue.look[x & blue.mask]
                p += (r & 15) + (b & 15)
                a = alpha.look[words[p >> 3] >> (p & 7) & alpha.mask] if alpha.mask else alpha.look[0]
                p += a & 15
                pixels[at] = (a >> 4) << 24 | (r >> 4) << 16 | s << 8 | b >> 4
                at += 1
            elif s < 280:
                bits.at = p
                length = _extra(bits, s - 256)
                code = _extra(bits, far.read(bits))
                p = bits.at
                if code > 120:
                    back = code - 120
                else:
                    dx, dy = NEAR[code - 1]
                    back = max(1, dx + dy * width)
                if back > at or at + length > n:
                    raise ValueError("a back-reference leaves the picture")
                for k in range(at, at + length, back):
                    m = min(back, at + length - k)
                    pixels[k : k + m] = pixels[k - back : k - back + m]
                at += length
            else:
                while cached < at:  # the cache is brought up to date when it is asked
                    cache[(pixels[cached] * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[cached]
                    cached += 1
                pixels[at] = cache[s - 280]
                at += 1
    except IndexError:
        raise ValueError("the stream ends too early") from None
    if p > bits.end:
        raise ValueError("the stream ends too early")
    bits.at = p


def undo_predictor(res: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    height, width, _ = res.shape
    out = res.copy()
    out[0, 0, 3] = (int(out[0, 0, 3]) + 255) & 255  # the first pixel is predicted black
    np.cumsum(out[0], axis=0, out=out[0], dtype=np.uint8)
    if (modes == 2).all():
        return np.cumsum(out, axis=0, dtype=np.uint8)
    out[1:, 0] = np.cumsum(out[:, 0], axis=0, dtype=np.uint8)[1:]
    half = lambda a, b: (a + b) >> 1
    for y in range(1, height):
        up = out[y - 1].astype(np.int32)
        for lo in range(0, width, 1 << tile):
            mode = modes[y >> tile, lo >> tile]
            x0, x1 = max(1, lo), min(width, lo + (1 << tile))
            t, tl = up[x0:x1], up[x0 - 1 : x1 - 1]
            tr = np.concatenate([up[x0 + 1 : x1 + 1], out[y, :1].astype(np.int32)]) if x1 == width else up[x0 + 1 : x1 + 1]
            plain = {2: lambda: t, 3: lambda: tr, 4: lambda: tl, 8: lambda: half(tl, t), 9: lambda: half(t, tr)}.get(int(mode))  # noqa: B023
            if mode in (0, 14, 15):
                out[y, x0:x1, 3] += 255
            elif plain:
                out[y, x0:x1] += plain().astype(np.uint8)
            elif mode == 1:
                line = out[y, x0 - 1 : x1]
                out[y, x0 - 1 : x1] = np.cumsum(line, axis=0, dtype=np.uint8)
            else:
                left = out[y, x0 - 1].astype(np.int32)
                for k in range(x1 - x0):
                    T, TL, TR = t[k], tl[k], tr[k]
                    if mode == 5:
                        p = half(half(left, TR), T)
                    elif mode == 6:
                        p = half(left, TL)
                    elif mode == 7:
                        p = half(left, T)
                    elif mode == 10:
                        p = half(half(left, TL), half(T, TR))
                    elif mode == 11:
                        p = left if np.abs(T - TL).sum() < np.abs(left - TL).sum() else T
                    elif mode == 12:
                        p = np.clip(left + T - TL, 0, 255)
                    else:
                        m = half(left, T)
                        d = m - TL
                        p = np.clip(m + np.sign(d) * (np.abs(d) // 2), 0, 255)
                    left = (out[y, x0 + k] + p) & 255
                    out[y, x0 + k] = left
    return out


def _delta(factor: np.ndarray, colour: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int32) * colour.astype(np.int8)) >> 5


def undo_cross(px: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    f = factors.repeat(1 << tile, axis=0)[: px.shape[0]].repeat(1 << tile, axis=1)[:, : px.shape[1]]
    out = px.copy()
    out[..., 0] += _delta(f[..., 2], px[..., 1]).astype(np.uint8)
    out[..., 2] += (_delta(f[..., 1], px[..., 1]) + _delta(f[..., 0], out[..., 0])).astype(np.uint8)
    return out


def undo_palette(px: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    n = len(colours)
    bits = 1 if n <= 2 else 2 if n <= 4 else 4 if n <= 16 else 8
    index = px[..., 1]
    if bits < 8:
        index = (index[..., None] >> np.arange(0, 8, bits, dtype=np.uint8) & ((1 << bits) - 1)).reshape(len(px), -1)[:, :width]
    table = np.zeros((256, 4), np.uint8)
    table[:n] = colours
    return table[index]


def _head(data: bytes) -> tuple[Bits, int, int, int, list]:
    """The reader behind the transforms, width, height, coded width, and the transforms to undo."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless stream")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    stream = data[at + 8 : at + 8 + struct.unpack_from("<I", data, at + 4)[0]]
    if not stream or stream[0] != 0x2F:
        raise ValueError("no lossless signature")
    bits = Bits(stream)
    bits.read(8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            tile = bits.read(3) + 2
            side = read_pixels(bits, -(-now // (1 << tile)), -(-height // (1 << tile)), False)
            undo.append((kind, side, tile, now))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            colours = np.cumsum(read_pixels(bits, n, 1, False)[0], axis=0, dtype=np.uint8)
            undo.append((kind, colours, 0, now))
            now = -(-now // (8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1))
        else:
            undo.append((kind, None, 0, now))
    return bits, width, height, now, undo


def _undo(px: np.ndarray, undo: list) -> np.ndarray:
    for kind, side, tile, w in reversed(undo):
        if kind == PREDICTOR:
            px = undo_predictor(px, side[..., 1] & 15, tile)
        elif kind == CROSS:
            px = undo_cross(px, side, tile)
        elif kind == PALETTE:
            px = undo_palette(px, side, w)
        else:
            px = px.copy()
            px[..., 0] += px[..., 1]
            px[..., 2] += px[..., 1]
    return px


def decode(data: bytes) -> np.ndarray:
    """The pixels of one RIFF WebP file with a VP8L stream: (height, width, 4) of red, green, blue, alpha."""
    bits, _, height, now, undo = _head(data)
    return _undo(read_pixels(bits, now, height, True), undo)


class Writer:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def one(self, symbol: int) -> None:
        """A code of a single symbol, which takes no bits."""
        self.put(0b101, 3)
        self.put(symbol, 8)

    def code(self, lengths: list[int]) -> None:
        """Any complete code, its lengths written one by one with codes of four bits each."""
        if sum(n > 0 for n in lengths) == 1 and lengths.index(max(lengths)) < 256:
            self.one(lengths.index(max(lengths)))
            return
        self.put(0, 1)
        self.put(15, 4)
        for s in LENGTH_ORDER:
            self.put(4 if s < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.put(int(f"{n:04b}"[::-1], 2), 4)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad


def code_lengths(counts: dict[int, int], alphabet: int) -> list[int]:
    """Huffman code lengths; equal counts stand in for the true ones if a code would exceed 15 bits."""
    if not counts:
        counts = {0: 1}
    out = [0] * alphabet
    if len(counts) == 1:
        out[next(iter(counts))] = 1
        return out
    for c in (counts, dict.fromkeys(counts, 1)):
        heap = [(n, i, [s]) for i, (s, n) in enumerate(sorted(c.items()))]
        depth = dict.fromkeys(c, 0)
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(depth.values()) <= 15:
            break
    for s, n in depth.items():
        out[s] = n
    return out


def encode_tokens(argb: np.ndarray, width: int, transforms: Iterable[tuple] = (), cache_bits: int = 0) -> bytes:
    """A file with back-references, a colour cache and fitted codes, for pixels that the given transforms
    (kind, side pixels or None, tile bits, colours) have already changed. argb: (height, coded width, 4), RGBA."""

    def image(w: Writer, px: np.ndarray, cache_bits: int, top: bool) -> None:
        flat = [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in px.reshape(-1, 4)]
        tokens: list[tuple] = []
        seen: dict[tuple, int] = {}
        cache: dict[int, int] = {}
        slot = lambda v: (v * 0x1E35A7BD & 0xFFFFFFFF) >> (32 - cache_bits)
        at = 0
        while at < len(flat):
            back = at - seen.get(tuple(flat[at : at + 3]), at)
            n = 0
            while back and at + n < len(flat) and n < 4096 and flat[at + n] == flat[at + n - back]:
                n += 1
            if n < 3:
                n = 1
                v = flat[at]
                tokens.append(("c", slot(v)) if cache_bits and cache.get(slot(v), 0) == v else ("p", v))
            else:
                tokens.append(("b", n, back + 120))
            for k in range(at, at + n):
                seen[tuple(flat[k : k + 3])] = k
                if cache_bits:
                    cache[slot(flat[k])] = flat[k]
            at += n

        def prefix(v: int) -> tuple[int, int, int]:
            v -= 1
            if v < 4:
                return v, 0, 0
            n = v.bit_length() - 2
            return 2 * n + (v >> n), n, v & ((1 << n) - 1)

        w.put(1 if cache_bits else 0, 1)
        if cache_bits:
            w.put(cache_bits, 4)
        if top:
            w.put(0, 1)
        counts: list[dict[int, int]] = [{} for _ in range(5)]
        coded = []
        for t in tokens:
            if t[0] == "p":
                row = [(0, t[1] >> 8 & 255, 0, 0), (1, t[1] >> 16 & 255, 0, 0), (2, t[1] & 255, 0, 0), (3, t[1] >> 24, 0, 0)]
            elif t[0] == "c":
                row = [(0, 280 + t[1], 0, 0)]
            else:
                (a, n, e), (b, m, f) = prefix(t[1]), prefix(t[2])
                row = [(0, 256 + a, n, e), (4, b, m, f)]
            for c, s, _, _ in row:
                counts[c][s] = counts[c].get(s, 0) + 1
            coded.append(row)
        codes = []
        for c, alphabet in zip(counts, (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40), strict=True):
            lengths = code_lengths(c, alphabet)
            w.code(lengths)
            bits = spell(np.array(lengths))
            codes.append({s: (int(bits[s]), n) for s, n in enumerate(lengths) if n} if sum(n > 0 for n in lengths) > 1 else {lengths.index(max(lengths)): (0, 0)})
        for row in coded:
            for c, s, n, e in row:
                w.put(*codes[c][s])
                w.put(e, n)

    w = Writer()
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(len(argb) - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    for kind, side, tile in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind in (PREDICTOR, CROSS):
            w.put(tile - 2, 3)
            image(w, side, 0, False)
        elif kind == PALETTE:
            w.put(side.shape[1] - 1, 8)
            image(w, np.diff(side, axis=1, prepend=np.zeros((1, 1, 4), np.uint8)).astype(np.uint8), 0, False)
    w.put(0, 1)
    image(w, argb, cache_bits, True)
    return _file(w.value.to_bytes((w.n + 7) // 8, "little"))


def fit(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths by symbol; counts are flattened until no code exceeds the limit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used[0] if len(used) else 0] = 1
        return out
    c = counts[used]
    while True:
        order = np.argsort(c, kind="stable")
        w = c[order].tolist()
        m = len(w)
        parent = [0] * (2 * m - 1)
        i, j = 0, m
        for k in range(m, 2 * m - 1):
            total = 0
            for _ in range(2):
                if i < m and (j >= k or w[i] <= w[j]):
                    a, i = i, i + 1
                else:
                    a, j = j, j + 1
                parent[a] = k
                total += w[a]
            w.append(total)
        depth = [0] * (2 * m - 1)
        for k in range(2 * m - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:m]) <= limit:
            break
        c = (c + 1) >> 1
    out[used[order]] = depth[:m]
    return out


def put_code(w: Writer, lengths: np.ndarray) -> np.ndarray:
    """Writes a fitted code, its lengths run by run behind a fitted inner code; returns the bits of each symbol."""
    used = np.flatnonzero(lengths)
    spelled = np.zeros(len(lengths), np.int64)
    if len(used) == 1 and used[0] < 256:
        w.one(int(used[0]))
        lengths[used] = 0  # a lone symbol takes no bits
        return spelled
    seq = lengths[: used[-1] + 1]
    cut = np.flatnonzero(np.diff(seq, prepend=-1))
    row: list[tuple[int, int, int]] = []
    for n, k in zip(seq[cut].tolist(), np.diff(cut, append=len(seq)).tolist(), strict=True):
        if n:
            row.append((n, 0, 0))
            k -= 1
        while k >= 3:
            step = min(k, 138 if not n and k > 10 else 6 if n else 10)
            row.append((16, step - 3, 2) if n else (18, step - 11, 7) if step > 10 else (17, step - 3, 3))
            k -= step
        row += [(n, 0, 0)] * k
    inner = fit(np.bincount([t for t, _, _ in row], minlength=19), 7)
    count = max(4, max(i for i, s in enumerate(LENGTH_ORDER) if inner[s]) + 1)
    w.put(0, 1)
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(int(inner[s]), 3)
    bits = spell(inner)
    if np.count_nonzero(inner) == 1:
        inner = inner * 0
    if len(row) < 2:
        row += [(0, 0, 0)]
    w.put(1, 1)
    n = max(0, ((len(row) - 2).bit_length() - 1) // 2)
    w.put(n, 3)
    w.put(len(row) - 2, 2 + 2 * n)
    codes, sizes = bits.tolist(), inner.tolist()
    for t, e, n in row:
        w.put(codes[t] | e << sizes[t], sizes[t] + n)
    return spell(lengths)


def spell(lengths: np.ndarray) -> np.ndarray:
    """The bits of the canonical code of each symbol, first bit lowest."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    out = np.zeros(len(lengths), np.int64)
    step = 1 << (15 - lengths[used])
    out[used] = REVERSED15[np.minimum(np.cumsum(step) - step, 32767)]
    return out


def prefixes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, number of extra bits and extra bits of lengths or distance codes."""
    v = v - 1
    n = np.where(v < 4, 0, np.log2(np.maximum(v, 1)).astype(np.int64) - 1)
    return np.where(v < 4, v, 2 * n + (v >> n)), n, np.where(v < 4, 0, v & ((1 << n) - 1))


_NEAREST: dict[int, dict[int, int]] = {}


def matches(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance code of back-references, taken greedily: the latest place with the same three pixels."""
    none = np.zeros(0, np.int64)
    if len(v) < 4:
        return none, none, none
    x = v.astype(np.uint64)
    key = K.mix(x[:-2] + K.mix(x[1:-1] + K.mix(x[2:] + np.uint64(1))))
    order = np.argsort(key, kind="stable")
    back = np.zeros(len(key), np.int64)
    same = key[order[1:]] == key[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(back)
    true = (back[at] <= (1 << 20) - 120) & (v[at] == v[at - back[at]]) & (v[at + 1] == v[at + 1 - back[at]]) & (v[at + 2] == v[at + 2 - back[at]])
    back[at[~true]] = 0
    at = at[true]
    if not len(at):
        return none, none, none
    turn = np.flatnonzero(np.diff(back)) + 1
    end = np.append(turn, len(back))[np.searchsorted(turn, at, "right")]
    length = np.minimum(end - at + 2, 4096)
    picked, to = [], 0
    for k, (i, n) in enumerate(zip(at.tolist(), length.tolist(), strict=True)):
        if i >= to:
            picked.append(k)
            to = i + n
    near = _NEAREST.get(width)
    if near is None:
        near = _NEAREST[width] = {}
        for k, (dx, dy) in enumerate(NEAR):
            near.setdefault(max(1, dx + dy * width), k + 1)
    at = at[picked]
    return at, length[picked], np.array([near.get(b, b + 120) for b in back[at].tolist()], np.int64)


def tokens_of(v: np.ndarray, width: int, caches: Iterable[int]) -> tuple[float, int, list[np.ndarray], np.ndarray, np.ndarray]:
    """Estimated bits, cache bits, counts of the five codes, and the tokens (symbols and extra bits by column) of the cheapest cache."""
    at, length, far = matches(v, width)
    edge = np.zeros(len(v) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + length, 1)
    token = np.cumsum(edge)[:-1] == 0
    token[at] = True
    place = np.flatnonzero(token)
    ref = np.zeros(len(v), bool)
    ref[at] = True
    ref = ref[place]
    p = v[place].astype(np.int64)
    sym = np.full((len(place), 7), -1, np.int64)  # green, extra of length, red, blue, alpha, distance, its extra
    size = np.zeros((len(place), 7), np.int64)
    for col, shift in ((0, 8), (2, 16), (3, 0), (4, 24)):
        sym[:, col] = p >> shift & 255
    sym[ref, 2:5] = -1
    sym[:, 1] = sym[:, 6] = 0
    a, n, e = prefixes(length)
    sym[ref, 0], size[ref, 1], sym[ref, 1] = 256 + a, n, e
    a, n, e = prefixes(far)
    sym[ref, 5], size[ref, 6], sym[ref, 6] = a, n, e
    extra, best = int(size.sum()), None
    for bits in caches:
        s = sym
        if bits:
            slot = (v.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)
            order = np.argsort(slot, kind="stable")
            hit = np.zeros(len(v), bool)
            hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
            hit = hit[place] & ~ref
            if not hit.any():
                continue
            s = sym.copy()
            s[hit, 0] = 280 + slot[place[hit]].astype(np.int64)
            s[hit, 2:5] = -1
        counts = [np.bincount(s[:, c][s[:, c] >= 0], minlength=k) for c, k in ((0, 280 + (1 << bits if bits else 0)), (2, 256), (3, 256), (4, 256), (5, 40))]
        cost = extra + sum(_bits(c) for c in counts)
        if best is None or cost < best[0]:
            best = cost, bits, counts, s, size
    return best


def _bits(c: np.ndarray) -> float:
    """About the bits of symbols of these counts, with their code."""
    c = c[c > 0]
    return float((c * np.log2(c.sum() / c)).sum()) + 4 * len(c) if len(c) > 1 else 11.0


def put_image(w: Writer, plan: tuple, top: bool) -> np.ndarray:
    """Writes what stands before the tokens, and returns the tokens' bits."""
    _, cache, counts, sym, size = plan
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if top:
        w.put(0, 1)
    value, size = sym.copy(), size.copy()
    for col, c in zip((0, 2, 3, 4, 5), counts, strict=True):
        lengths = fit(c)
        bits = put_code(w, lengths)
        on = sym[:, col] >= 0
        value[on, col], size[on, col] = bits[sym[on, col]], lengths[sym[on, col]]
    value, size = value.ravel(), size.ravel()
    on = size > 0
    value, size = value[on], size[on]
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return (np.repeat(value, size) >> step & 1).astype(np.uint8)


def residuals(rgb: np.ndarray) -> np.ndarray:
    """What the 14 predictors leave: (14, height, width, 3)."""
    p = rgb.astype(np.int16)
    out = np.empty((14, *rgb.shape), np.uint8)
    out[:, 0, 0] = rgb[0, 0]
    out[:, 0, 1:] = rgb[0, 1:] - rgb[0, :-1]
    out[:, 1:, 0] = rgb[1:, 0] - rgb[:-1, 0]
    left, t, tl = p[1:, :-1], p[:-1, 1:], p[:-1, :-1]
    tr = np.concatenate([p[:-1, 2:], p[1:, :1]], axis=1)
    m = (left + t) >> 1
    near = np.where((np.abs(t - tl).sum(axis=2) < np.abs(left - tl).sum(axis=2))[..., None], left, t)
    d = m - tl
    for mode, guess in enumerate((0 * t, left, t, tr, tl, (((left + tr) >> 1) + t) >> 1, (left + tl) >> 1, m, (tl + t) >> 1, (t + tr) >> 1, (((left + tl) >> 1) + ((t + tr) >> 1)) >> 1, near, np.clip(left + t - tl, 0, 255), np.clip(m + np.sign(d) * (np.abs(d) >> 1), 0, 255))):
        out[mode, 1:, 1:] = (p[1:, 1:] - guess).astype(np.uint8)
    return out


def crossed(rgb: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The picture without what green tells of red, and green and red of blue; and the cross-colour pixel."""
    r, g, b = (rgb[..., k].astype(np.int8).astype(np.float64) for k in range(3))

    def slope(x: np.ndarray, y: np.ndarray) -> int:
        return int(np.clip(np.rint(32 * (x * y).sum() / max(1.0, (x * x).sum())), -128, 127)) & 255

    out, gr, gb = rgb.copy(), slope(g, r), slope(g, b)
    one = lambda f: np.array(f, np.uint8)
    blue = rgb[..., 2] - _delta(one(gb), rgb[..., 1]).astype(np.uint8)
    rb = slope(r, blue.astype(np.int8).astype(np.float64))
    out[..., 0] -= _delta(one(gr), rgb[..., 1]).astype(np.uint8)
    out[..., 2] = blue - _delta(one(rb), rgb[..., 0]).astype(np.uint8)
    return out, [rb, gb, gr]


def _argb(rgb: np.ndarray, alpha: int) -> np.ndarray:
    x = rgb.reshape(-1, 3).astype(np.uint32)
    return np.uint32(alpha << 24) | x[:, 0] << np.uint32(16) | x[:, 1] << np.uint32(8) | x[:, 2]


def encode(rgb: np.ndarray) -> bytes:
    """(height, width, 3) with fitted codes, back-references, a colour cache, and the transform that leaves least."""
    height, width, _ = rgb.shape
    plain = _argb(rgb, 255)
    caches = (0, 4, 7, 10)
    plans: list[tuple] = [(tokens_of(plain, width, caches), None, None)]
    green = rgb.copy()
    green[..., 0] -= rgb[..., 1]
    green[..., 2] -= rgb[..., 1]
    cross, factors = crossed(rgb)
    trials = np.concatenate([rgb[None], green[None], cross[None], residuals(rgb)])
    n = height * width
    flat = trials.reshape(len(trials), n, 3).transpose(0, 2, 1).reshape(-1, n)
    hist = np.stack([np.bincount(x, minlength=256) for x in flat])
    cost = -(hist * np.log2(np.maximum(hist, 1))).sum(axis=1).reshape(-1, 3).sum(axis=1) + 4 * (hist > 0).sum(axis=1).reshape(-1, 3).sum(axis=1)
    k = int(np.argmin(cost))
    if k:
        kind = SUBTRACT_GREEN if k == 1 else CROSS if k == 2 else PREDICTOR
        side = None if k == 1 else (*factors, 255) if k == 2 else (0, k - 3, 0, 255)
        v = _argb(trials[k], 0 if k > 2 else 255)
        plans.append((tokens_of(v, width, caches), kind, side))
    colours, index = np.unique(plain, return_inverse=True)
    if len(colours) <= 256:
        bits = 1 if len(colours) <= 2 else 2 if len(colours) <= 4 else 4 if len(colours) <= 16 else 8
        per = 8 // bits
        packed = np.zeros((height, -(-width // per) * per), np.int64)
        packed[:, :width] = index.reshape(height, width)
        packed = (packed.reshape(height, -1, per) << (np.arange(per) * bits)).sum(axis=2)
        v = (packed.ravel() << 8 | 255 << 24).astype(np.uint32)
        rgba = colours.view(np.uint8).reshape(-1, 4)
        delta = np.diff(rgba, axis=0, prepend=np.zeros((1, 4), np.uint8)).astype(np.uint8)
        table = tokens_of(np.ascontiguousarray(delta).view(np.uint32).ravel(), len(colours), (0,))
        plan = tokens_of(v, packed.shape[1], caches)
        plans.append(((plan[0] + table[0], *plan[1:]), PALETTE, (len(colours), table)))
    plan, kind, side = min(plans, key=lambda x: x[0][0])
    w, parts = Writer(), []

    def flush() -> None:
        parts.append(np.unpackbits(np.frombuffer(w.value.to_bytes((w.n + 7) // 8, "little"), np.uint8), bitorder="little")[: w.n])
        w.value = w.n = 0

    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)
    if kind is not None:
        w.put(1, 1)
        w.put(kind, 2)
    if kind == PALETTE:
        w.put(side[0] - 1, 8)
        body = put_image(w, side[1], False)
        flush()
        parts.append(body)
    elif side is not None:
        w.put(7, 3)  # tiles of 512
        w.put(0, 1)
        for symbol in (side[1], side[0], side[2], side[3], 0):
            w.one(symbol)
    w.put(0, 1)
    body = put_image(w, plan, True)
    flush()
    return _file(np.packbits(np.concatenate([*parts, body]), bitorder="little").tobytes())


def store(payload: np.ndarray) -> bytes:
    """A payload of whole rows of 192 bytes as one or more files, one after another."""
    px = payload.reshape(-1, WIDTH, 3)
    return b"".join(encode(px[k : k + MOST_ROWS]) for k in range(0, len(px), MOST_ROWS))


# --- many pictures at a time --------------------------------------------------------------------

#: Bytes of payload encoded together, and decoded together; and pictures below which they are decoded one by one.
TOGETHER, READ_TOGETHER, ALONE = 1 << 20, 16 << 20, 96
#: Pictures of few colours, or of many pixels like the one before, may gain by a transform and are encoded one by one.
FEW_COLOURS, MOSTLY_FLAT = 16, 0.4
#: Code lengths of the code length codes of pictures that are encoded together; a complete code.
INNER = np.array([3, 6, 6, 6, 5, 5, 4, 3, 3, 3, 4, 5, 5, 6, 6, 6, 4, 4, 5])
CACHE_BITS = 10


def fit_rows(counts: np.ndarray) -> np.ndarray:
    """Complete prefix code lengths for each row of counts: each symbol's information, rounded up, then shortened from
    the most frequent symbol on while there is room. Rows of one symbol get length 1."""
    total = counts.sum(axis=1, keepdims=True)
    length = np.where(counts > 0, np.clip(np.ceil(np.log2(np.maximum(total, 1) / np.maximum(counts, 1))), 1, 15), 0).astype(np.int64)
    used = (counts > 0).sum(axis=1)
    room = (1 << 15) - np.where(length > 0, 1 << (15 - length), 0).sum(axis=1)
    for k in np.flatnonzero(room < 0):  # too many rare symbols
        length[k] = fit(counts[k])
        room[k] = 0
    room[used < 2] = 0
    open_ = np.flatnonzero(room > 0)
    if len(open_):
        width = int(used[open_].max())
        falling = counts[open_]
        falling = (65535 - falling).astype(np.uint16) if int(falling.max()) < 65536 else -falling  # small numbers are sorted by counting
        order = np.argsort(falling, axis=1, kind="stable")[:, :width]
        mine = np.take_along_axis(length[open_], order, axis=1).T.copy()
        left = room[open_]
        while left.any():
            for k in range(width):
                n = mine[k]
                gain = 1 << (15 - n)
                take = (n > 1) & (gain <= left)
                if take.any():
                    left = left - gain * take
                    mine[k] -= take
                if not left.any():
                    break
        part = length[open_]
        np.put_along_axis(part, order, mine.T, axis=1)
        length[open_] = part
    return length


def spell_rows(length: np.ndarray) -> np.ndarray:
    """The bits of the canonical codes of each row, first bit lowest."""
    order = np.argsort(length.astype(np.uint8) - np.uint8(1), axis=1, kind="stable")[:, : max(1, int(np.count_nonzero(length, axis=1).max(initial=0)))]
    n = np.take_along_axis(length, order, axis=1)
    step = np.where(n > 0, 1 << (15 - n), 0)
    out = np.zeros_like(length)
    np.put_along_axis(out, order, REVERSED15[np.minimum(np.cumsum(step, axis=1) - step, 32767)], axis=1)
    return out


def code_tokens(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, value and size of the bits that write each row's code lengths, in runs, with the code INNER."""
    rows, width = length.shape
    flat = length.ravel()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::width] = True
    start = np.flatnonzero(new)
    run, n = np.diff(np.append(start, len(flat))), flat[start]
    zero = n == 0
    more = run - ~zero  # a length is written once before it is repeated
    most = np.where(zero, 138, 6)
    full, rest = more // most, more % most
    one = rest >= 3
    count = ~zero + full + np.where(one, 1, rest)
    of = np.repeat(np.arange(len(run)), count)
    k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    k -= ~zero[of]
    z, whole = zero[of], (k >= 0) & (k < full[of])
    last = (k == full[of]) & one[of]
    repeat = np.where(whole, most[of], np.where(last, rest[of], 0))
    symbol = np.where(repeat == 0, n[of], np.where(~z, 16, np.where(repeat >= 11, 18, 17)))
    extra = np.where(symbol == 16, repeat - 3, np.where(symbol == 17, repeat - 3, np.where(symbol == 18, repeat - 11, 0)))
    bits = np.where(symbol == 16, 2, np.where(symbol == 17, 3, np.where(symbol == 18, 7, 0)))
    code = spell(INNER)
    return start[of] // width, code[symbol] | extra << INNER[symbol], INNER[symbol] + bits


def stable_order(key: np.ndarray) -> np.ndarray:
    """As np.argsort(key, kind="stable").

    Sorts the keys' upper bits with the places below them, which is faster; should two keys differ in the lower bits only, the keys themselves."""
    key = key.astype(np.uint64)
    n = np.uint64(len(key).bit_length())
    whole = not len(key) or int(key.max()) >> (64 - int(n)) == 0
    if whole:
        key = key << n
    packed = key >> n << n | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << n) - np.uint64(1))).astype(np.int64)
    if not whole:
        packed >>= n
        found = key[order]
        if ((packed[1:] == packed[:-1]) & (found[1:] != found[:-1])).any():
            return np.argsort(key, kind="stable")
    return order


def encode_many(payloads: list[np.ndarray]) -> list[bytes]:
    """Pictures of WIDTH pixels a row with fitted codes, back-references and, where it shortens, a colour cache, all together."""
    count = np.array([len(x) // 3 for x in payloads])
    first = np.cumsum(count) - count
    px = np.concatenate(payloads).reshape(-1, 3).astype(np.uint32)
    v = np.uint32(255 << 24) | px[:, 0] << np.uint32(16) | px[:, 1] << np.uint32(8) | px[:, 2]
    doc = np.repeat(np.arange(len(count)), count)
    n_docs = len(count)
    # back-references: the latest place in the same picture with the same three pixels, taken greedily
    x = v.astype(np.uint64)
    key = K.mix(x[:-2] + K.mix(x[1:-1] + K.mix(x[2:] + K.mix(doc[:-2].astype(np.uint64) + np.uint64(1)))))
    order = stable_order(key)
    back = np.zeros(len(v), np.int64)
    same = key[order[1:]] == key[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    at = np.flatnonzero(back)
    at = at[at + 2 < len(v)]
    b = back[at]
    true = (b <= (1 << 20) - 120) & (doc[at] == doc[at + 2]) & (doc[at] == doc[at - b]) & (v[at] == v[at - b]) & (v[at + 1] == v[at + 1 - b]) & (v[at + 2] == v[at + 2 - b])
    back[:] = 0
    at = at[true]
    back[at] = b[true]
    turn = np.union1d(np.flatnonzero(np.diff(back)) + 1, first)
    end = np.append(turn, len(v))[np.searchsorted(turn, at, "right")]
    length = np.minimum(np.minimum(end - at + 2, (first + count)[doc[at]] - at), 4096)
    picked, to = [], 0
    for k, (i, n) in enumerate(zip(at.tolist(), length.tolist(), strict=True)):
        if i >= to:
            picked.append(k)
            to = i + n
    at, length = at[picked], length[picked]
    near = np.arange(120 + WIDTH * 8 + 8) + 120
    for k, (dx, dy) in reversed(list(enumerate(NEAR))):
        near[max(1, dx + dy * WIDTH)] = k + 1
    far = back[at]
    far = np.where(far < len(near), near[np.minimum(far, len(near) - 1)], far + 120)
    edge = np.zeros(len(v) + 1, np.int64)
    edge[at] += 1
    np.subtract.at(edge, at + length, 1)
    token = np.cumsum(edge)[:-1] == 0
    token[at] = True
    place = np.flatnonzero(token)
    ref = np.zeros(len(v), bool)
    ref[at] = True
    ref = ref[place]
    own = doc[place]
    # the cache: what stands in a slot is the last pixel that fell there
    slot = ((x * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE_BITS)).astype(np.int64)
    order = stable_order(doc * (1 << CACHE_BITS) + slot)
    hit = np.zeros(len(v), bool)
    hit[order[1:]] = (doc[order[1:]] == doc[order[:-1]]) & (slot[order[1:]] == slot[order[:-1]]) & (v[order[1:]] == v[order[:-1]])
    hit = hit[place] & ~ref
    p = v[place].astype(np.int64)
    length_code, far_code = prefixes(length), prefixes(far)
    green, width = p >> 8 & 255, 280 + (1 << CACHE_BITS)
    green[ref] = 256 + length_code[0]

    def tally(symbols: np.ndarray, who: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(who * size + symbols, minlength=n_docs * size).reshape(n_docs, size)

    def cost(*tables: np.ndarray) -> np.ndarray:
        out = np.zeros(n_docs)
        for c in tables:
            t = np.maximum(c.sum(axis=1), 1)
            out += t * np.log2(t) - (c * np.log2(np.maximum(c, 1))).sum(axis=1) + 6 * (c > 0).sum(axis=1)
        return out

    lit, kept = ~ref, ~ref & ~hit
    plain = [tally(green, own, width), tally((p >> 16 & 255)[lit], own[lit], 256), tally((p & 255)[lit], own[lit], 256)]
    with_cache = np.where(hit, 280 + slot[place], green)
    cached = [tally(with_cache, own, width), tally((p >> 16 & 255)[kept], own[kept], 256), tally((p & 255)[kept], own[kept], 256)]
    use = cost(*cached) < cost(*plain)
    green = np.where(hit & use[own], with_cache, green)
    lit &= ~(hit & use[own])
    alpha = np.zeros((n_docs, 256), np.int64)
    alpha[:, 255] = 1
    tables = [np.where(use[:, None], a, c) for a, c in zip(cached, plain, strict=True)] + [alpha, tally(far_code[0], own[ref], 40)]
    for c in tables:
        c[c.sum(axis=1) == 0, 0] = 1  # a code that is never used
    value, size = np.zeros((len(place), 5), np.int64), np.zeros((len(place), 5), np.int64)  # green, extra of length | red, blue, distance, its extra
    parts: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []  # picture, section, value, size
    every = np.arange(n_docs)
    put = lambda section, v, n: parts.append((every, section, np.broadcast_to(np.asarray(v, np.int64), n_docs), np.broadcast_to(np.asarray(n, np.int64), n_docs)))
    put(0, 0x2F | (WIDTH - 1) << 8 | (count // WIDTH - 1) << 22, 36)
    put(0, 0, 4)
    put(0, np.where(use, 2 | CACHE_BITS << 2, 0), np.where(use, 6, 2))  # no transform; the cache
    put(0, 0, 1)  # one group of codes
    inner = sum(int(INNER[t]) << 3 * k for k, t in enumerate(LENGTH_ORDER))
    spelled = []
    for k, c in enumerate(tables):
        n = fit_rows(c)
        lone = ((n > 0).sum(axis=1) == 1) & (n[:, 256:].sum(axis=1) == 0)
        parts.append((every[lone], 1 + k, 0b101 | n[lone].argmax(axis=1) << 3, np.full(int(lone.sum()), 11)))
        rest = np.flatnonzero(~lone)
        for v_, s_ in ((0 | 15 << 1, 5), (inner & (1 << 30) - 1, 30), (inner >> 30, 27), (0, 1)):
            parts.append((rest, 1 + k, np.full(len(rest), v_), np.full(len(rest), s_)))
        groups = [rest] if k else [rest[~use[rest]], rest[use[rest]]]
        for g, w in zip(groups, [n.shape[1]] if k else [280, width], strict=True):
            if len(g):
                row, bits, many = code_tokens(n[g][:, :w])
                parts.append((g[row], 1 + k, bits, many))
        bits = spell_rows(n)
        n[(n > 0).sum(axis=1) == 1] = 0  # a lone symbol takes no bits
        spelled.append((bits, n))
    for col, k, sym, on in ((0, 0, green, None), (1, 1, p >> 16 & 255, lit), (2, 2, p & 255, lit)):
        bits, n = spelled[k]
        got, many = bits[own, sym], n[own, sym]
        value[:, col], size[:, col] = (got, many) if on is None else (np.where(on, got, 0), np.where(on, many, 0))
    value[ref, 1], size[ref, 1] = length_code[2], length_code[1]
    value[ref, 3], size[ref, 3] = spelled[4][0][own[ref], far_code[0]], spelled[4][1][own[ref], far_code[0]]
    value[ref, 4], size[ref, 4] = far_code[2], far_code[1]
    parts.append((np.repeat(own, 5), 9, value.ravel(), size.ravel()))
    who = np.concatenate([q[0] for q in parts])
    section = np.repeat([q[1] for q in parts], [len(q[0]) for q in parts])
    value, size = np.concatenate([q[2] for q in parts]), np.concatenate([q[3] for q in parts])
    total = np.bincount(who, weights=size, minlength=n_docs).astype(np.int64)
    who, section = np.concatenate([who, every]), np.concatenate([section, np.full(n_docs, 10)])
    value, size = np.concatenate([value, np.zeros(n_docs, np.int64)]), np.concatenate([size, -total % 8])
    keep = np.flatnonzero(size > 0)
    order = keep[stable_order(who[keep] * 16 + section[keep])]
    value, size = value[order], size[order]
    # no part has more than 36 bits, so one begins in every word of 64, and at most one reaches into the next
    begin = np.cumsum(size) - size
    word, shift = begin >> 6, (begin & 63).astype(np.uint64)
    part = value.astype(np.uint64)
    data = np.zeros(int(word[-1]) + 2, np.uint64)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    data[word[new]] = np.bitwise_or.reduceat(part << shift, new)
    over = np.flatnonzero((begin & 63) + size > 64)
    data[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
    data = data.tobytes()
    cut = np.concatenate([[0], np.cumsum((total + 7) // 8)]).tolist()
    return [_file(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Rows:
    """Canonical prefix codes, one a row, read side by side: codes of up to SHORT bits by table, longer ones by their length's first code."""

    SHORT, LONGER, BLOCK = 11, 0xFFFF, 256

    def __init__(self, length: np.ndarray) -> None:
        self.length = length = length.astype(np.uint8)
        used = np.count_nonzero(length, axis=1)
        top = max(1, int(used.max()))
        blocks = [slice(lo, lo + self.BLOCK) for lo in range(0, len(length), self.BLOCK)]
        # small numbers are sorted by counting; unused symbols go last
        self.symbols = np.concatenate([np.argsort(length[part] - np.uint8(1), axis=1, kind="stable")[:, :top].astype(np.int16) for part in blocks])
        order = self.symbols.astype(np.int64)
        n = np.take_along_axis(length, order, axis=1).astype(np.int64)
        full = np.where(n > 0, 1 << (15 - n), 0).sum(axis=1) == 1 << 15
        if (~full & (used != 1)).any():
            raise ValueError("not a complete prefix code")
        lone = np.flatnonzero(used == 1)
        most = int(n.max())
        self.bits = bits = min(self.SHORT, 0 if len(lone) == len(length) else most)
        entry, wide = order << 4 | n, np.where((n > 0) & (n <= bits), 1 << np.maximum(bits - n, 0), 0)
        entry[lone, 0], wide[lone] = order[lone, 0] << 4, 0
        wide[lone, 0] = 1 << bits
        total = wide.sum(axis=1)
        #: By row and the next bits, first bit lowest: symbol (below 4095) and length, or LONGER.
        self.table = np.full(len(length) << bits, self.LONGER, np.uint16)
        for part in blocks:
            many = total[part]
            place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            self.table[np.repeat(np.arange(part.start, part.start + len(many)) << bits, many) | REVERSED15[place] >> (15 - bits)] = np.repeat(entry[part].ravel(), wide[part].ravel())
        self.free, self.long = len(lone) == len(length), most > bits and len(lone) < len(length)
        if not self.long:
            return
        count = np.stack([(length == k).sum(axis=1) for k in range(1, 16)], axis=1)
        self.beyond = np.cumsum(count << (14 - np.arange(15)), axis=1)
        self.begin = self.beyond - (count << (14 - np.arange(15)))
        self.place = np.cumsum(count, axis=1) - count

    def read(self, row: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Symbols and, in the lowest four bits, lengths of the codes at the start of some bits."""
        e = self.table.take((row << self.bits) | (bits & ((1 << self.bits) - 1))).astype(np.int64)
        if self.long and len(far := np.flatnonzero(e == self.LONGER)):
            r, c = row[far], REVERSED15[bits[far] & 32767]
            k = np.minimum((self.beyond[r] <= c[:, None]).sum(axis=1), 14)
            e[far] = self.symbols[r, np.minimum(self.place[r, k] + ((c - self.begin[r, k]) >> (14 - k)), self.symbols.shape[1] - 1)].astype(np.int64) << 4 | (k + 1)
        return e

    def code(self, row: int) -> Code:
        at = np.flatnonzero(self.length[row])
        return Code(dict(zip(at.tolist(), self.length[row, at].tolist(), strict=True)))


def decode_many(pictures: list[bytes]) -> list[np.ndarray]:
    """As decode(), for many files; those without an entropy image are read side by side, a symbol of each at a time."""
    if len(pictures) < ALONE:
        return [decode(f) for f in pictures]
    out: list[np.ndarray | None] = [None] * len(pictures)
    heads = []
    for k, f in enumerate(pictures):
        head = _head(f)
        bits, now, height = head[0], head[3], head[2]
        cache = bits.read(4) if bits.read(1) else 0
        if cache > 11:
            raise ValueError("the colour cache is too large")
        if bits.read(1):
            out[k] = decode(f)
        else:
            heads.append((k, head, cache, now * height))
    if len(heads) < ALONE:
        for k, *_ in heads:
            out[k] = decode(pictures[k])
        return out
    streams = [h[1][0].data for h in heads]
    begin = np.cumsum([0] + [len(x) + 16 for x in streams])
    # signed, as only low bits are looked at and what is shifted in from above never gets there
    words = np.ndarray((int(begin[-1]),), "<i8", b"".join(x + bytes(16) for x in streams) + bytes(8), strides=(1,))
    at = np.array([h[1][0].at for h in heads]) + 8 * begin[:-1]
    stop = 8 * (begin[1:] - 16)
    cache = np.array([h[2] for h in heads])
    size = np.array([h[3] for h in heads])
    wide = np.array([h[1][3] for h in heads])
    look = lambda p: words[p >> 3] >> (p & 7)

    def take(on: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v = look(at[on]) & ((np.int64(1) << n) - 1)
        at[on] += n
        return v

    def lengths(alphabet: np.ndarray) -> np.ndarray:
        out = np.zeros((len(heads), int(alphabet.max())), np.uint8)
        every = np.arange(len(heads))
        simple = take(every, 1) == 1
        on = every[simple]
        if len(on):
            two = take(on, 1) == 1
            out[on, take(on, np.where(take(on, 1) == 1, 8, 1))] = 1
            out[on[two], take(on[two], 8)] = 1
        on = every[~simple]
        if not len(on):
            return out
        many = 4 + take(on, 4)
        inner = np.zeros((len(on), 19), np.int64)
        for k, t in enumerate(LENGTH_ORDER):
            some = np.flatnonzero(many > k)
            inner[some, t] = take(on[some], 3)
        code = Rows(inner)
        limit = np.full(len(on), 1 << 30)
        short = np.flatnonzero(take(on, 1) == 1)
        if len(short):
            limit[short] = 2 + take(on[short], 2 + 2 * take(on[short], 3))
        s, last, live = np.zeros(len(on), np.int64), np.full(len(on), 8), np.arange(len(on))
        runs = []
        most = alphabet[on]
        while len(live):
            e = code.read(live, look(at[on[live]]))
            at[on[live]] += e & 15
            symbol = e >> 4
            extra = np.where(symbol < 16, 0, np.where(symbol == 16, 2, np.where(symbol == 17, 3, 7)))
            repeat = np.where(symbol < 16, 1, np.where(symbol == 18, 11, 3) + take(on[live], extra))
            plain = (symbol < 16) & (symbol > 0)
            last[live[plain]] = symbol[plain]
            runs.append((live, s[live], repeat, np.where(symbol == 16, last[live], np.where(symbol < 16, symbol, 0))))
            s[live] += repeat
            limit[live] -= 1
            live = live[(s[live] < most[live]) & (limit[live] > 0)]
        if (s > most).any():
            raise ValueError("more code lengths than symbols")
        row, start, repeat, n = (np.concatenate(x) for x in zip(*runs, strict=True))
        some = np.flatnonzero(n)
        row, start, repeat, n = row[some], start[some], repeat[some], n[some]
        of = np.repeat(np.arange(len(row)), repeat)
        out[on[row[of]], start[of] + np.arange(len(of)) - np.repeat(np.cumsum(repeat) - repeat, repeat)] = n[of]
        return out

    green, red, blue, alpha, far = (Rows(lengths(a)) for a in (280 + np.where(cache > 0, 1 << cache, 0), *[np.full(len(heads), 256)] * 3, np.full(len(heads), 40)))
    offset = np.cumsum(size) - size
    pixels = np.zeros(int(size.sum()), np.uint32)
    most = int(cache.max())
    slots = np.zeros(len(heads) << most, np.uint32)
    shift = 32 - cache
    solid = alpha.symbols[:, 0].astype(np.uint32) << np.uint32(24) if alpha.free else None
    dx, dy = np.array(NEAR).T
    place = offset.copy()  # of the next pixel
    until = offset + size
    live = np.arange(len(heads))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []  # rows that have read the length code of a back-reference
    held = 0

    def remember(row: np.ndarray, v: np.ndarray) -> None:
        slots[(row << most) | ((v.astype(np.int64) * 0x1E35A7BD & 0xFFFFFFFF) >> shift[row])] = v

    def number(row: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        n = np.maximum((prefix - 2) >> 1, 0) * (prefix >= 4)
        return np.where(prefix < 4, prefix, (2 + (prefix & 1)) << n) + take(row, n) + 1

    def refer() -> np.ndarray:
        """The back-references of all rows that wait."""
        row, length = (np.concatenate(x) for x in zip(*waiting, strict=True))
        length = number(row, length)
        e = far.read(row, look(at[row]))
        at[row] += e & 15
        code = number(row, e >> 4)
        close = np.minimum(code, 120) - 1
        back = np.where(code > 120, code - 120, np.maximum(1, dx[close] + dy[close] * wide[row]))
        to = place[row]
        if (back > to - offset[row]).any() or (to + length > until[row]).any():
            raise ValueError("a back-reference leaves the picture")
        of = np.repeat(np.arange(len(row)), length)
        k = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        to = to[of] + k
        v = pixels[to - k - back[of] + k % back[of]]
        pixels[to] = v
        if most:
            remember(row[of], v)
        place[row] += length
        waiting.clear()
        return row[place[row] < until[row]]

    while len(live) + held >= ALONE:
        if len(live):
            bits = look(at[live])
            g = green.read(live, bits)
            at[live] += g & 15
            s = g >> 4
            lit = np.flatnonzero(s < 256)
            row = live[lit]
            g, bits = g[lit], bits[lit]
            bits = bits >> (g & 15)
            r = red.read(row, bits)
            b = blue.read(row, bits >> (r & 15))
            at[row] += (r & 15) + (b & 15)
            if solid is not None:
                a = solid[row]
            else:
                e = alpha.read(row, look(at[row]))
                at[row] += e & 15
                a = (e >> 4 << 24).astype(np.uint32)
            v = a | ((r >> 4 << 16) | (g >> 4 << 8) | (b >> 4)).astype(np.uint32)
            rest = live
            if len(lit) < len(live):
                known = np.flatnonzero(s >= 280)
                if len(known):
                    old = live[known]
                    row, v = np.concatenate([row, old]), np.concatenate([v, slots[(old << most) | (s[known] - 280)]])
                if len(row) < len(live):
                    ref = np.flatnonzero((s >= 256) & (s < 280))
                    waiting.append((live[ref], s[ref].astype(np.int64) - 256))
                    held += len(ref)
                rest = row
            pixels[place[row]] = v
            if most:
                remember(row, v)
            place[row] += 1
            if (at[row] > stop[row]).any():
                raise ValueError("the stream ends too early")
            live = rest[place[rest] < until[rest]]
        if held and held >= len(live):
            live, held = np.concatenate([live, refer()]), 0
    if held:
        live = np.concatenate([live, refer()])
    done = place - offset
    for k in live.tolist():  # the largest ones go on alone
        reader, lo, n = heads[k][1][0], int(offset[k]), int(size[k])
        reader.at = int(at[k] - 8 * begin[k])
        mine = pixels[lo : lo + n].tolist()
        _read_symbols(reader, [[c.code(k) for c in (green, red, blue, alpha, far)]], None, 0, int(wide[k]), mine, int(done[k]), slots[k << most : (k + 1) << most].tolist(), int(cache[k]))
        pixels[lo : lo + n] = mine
    bgra = pixels.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    for (k, head, _, n), lo in zip(heads, offset.tolist(), strict=True):
        out[k] = _undo(bgra[lo : lo + n].take([2, 1, 0, 3], axis=1).reshape(head[2], head[3], 4), head[4])
    return out


def store_many(payloads: list[np.ndarray]) -> list[bytes]:
    """As store(), the usual pictures together."""
    out: list[bytes | None] = [None] * len(payloads)
    usual = []
    for k, payload in enumerate(payloads):
        v = payload.reshape(-1, 3).astype(np.uint32)
        v = v[:, 0] << np.uint32(16) | v[:, 1] << np.uint32(8) | v[:, 2]
        if len(payload) > MOST_ROWS * ROW_BYTES or (v[1:] == v[:-1]).mean() > MOSTLY_FLAT or len(v) <= 4096 and len(set(v[:WIDTH].tolist())) <= FEW_COLOURS and len(np.unique(v)) <= FEW_COLOURS:
            out[k] = store(payload)
        else:
            usual.append(k)
    for k, f in zip(usual, encode_many([payloads[k] for k in usual]) if usual else [], strict=True):
        out[k] = f
    return out


def files(media: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        yield media[at : at + n]
        at += n


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's bytes, padded with spaces to rows of 64 pixels, as lossless WebP."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch, limit=TOGETHER):
                payloads = []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    payload = np.full(max(1, -(-(b - a) // ROW_BYTES)) * ROW_BYTES, 32, np.uint8)
                    payload[: b - a] = data[a:b]
                    payloads.append(payload)
                media = store_many(payloads)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(off)), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])
        K.release()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def read_media(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row, from the stored bytes: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The feature has the picture's size, mean colour and a coarse histogram of all samples."""

    def pictures(n_bytes: pa.Array, column: pa.Array) -> Iterator[tuple[bytes, np.ndarray]]:
        """The media and the pixels of each row, read some MB at a time, of media or of four times as much text."""
        held: list[tuple[bytes, list[bytes]]] = []
        size = 0

        def read() -> Iterator[tuple[bytes, np.ndarray]]:
            px = iter(decode_many([f for _, parts in held for f in parts]))
            for media, parts in held:
                yield media, np.concatenate([next(px)[..., :3] for _ in parts])

        for n, media in zip(n_bytes, column, strict=True):
            media = media.as_py()
            held.append((media, list(files(media))))
            size += max(len(media), (n.as_py() or 0) // 4)
            if size >= READ_TOGETHER // 2:
                yield from read()
                held, size = [], 0
        yield from read()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for media, px in pictures(batch.column(1), batch.column(2)):
                payload = px.tobytes()
                mean = px.reshape(-1, 3).mean(axis=0)
                bins = np.bincount(px.ravel() >> 5, minlength=8)
                feature = f"{px.shape[1]}x{px.shape[0]};" + ",".join(f"{x:.3f}" for x in mean) + ";" + ",".join(map(str, bins.tolist()))
                for col, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = stored.schema[id_col].dataType.simpleString()
    rows = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("id", id_col)
