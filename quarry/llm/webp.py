"""Lossless WebP: a decoder of the published bitstream, and an encoder that makes media columns.

The decoder reads prefix codes, back-references and the colour cache, and inverts the
predictor, cross-colour, subtract-green and palette transforms. The encoder uses the same
tools as asked; it exists so that tables without media can have some, and for round trips.
Pixels are ARGB in 32 bits.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import added, table

PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Pixels that an image may have: 64 MB for each of a few buffers of a task. Larger ones give an error, not pixels.
PIXELS = 1 << 24
_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_HASH = 0x1E35A7BD


def _parts(size: int, bits: int) -> int:
    return (size + (1 << bits) - 1) >> bits


#: Bits of codes in reverse, 15 of them, and the bytes read at once.
_TURNED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << 15)]
_WINDOW = 16


class _Bits:
    def __init__(self, data: bytes):
        self.at, self.end = 0, len(data) * 8
        # Padded, so that a window can be read anywhere.
        self.data = data + bytes(_WINDOW)

    def read(self, n: int) -> int:
        at = self.at
        out = int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7) & ((1 << n) - 1)
        self.at = at + n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return out


def _placed(length: dict[int, int]) -> list[tuple[int, int, int]]:
    """(symbol, bits with the first one lowest, their number) of canonical codes."""
    out, code, before = [], 0, 0
    for n, s in sorted([(n, s) for s, n in length.items()]):
        code <<= n - before
        before = n
        out.append((s, _TURNED[code] >> (15 - n), n))
        code += 1
    return out


class _Prefix:
    """Table from the next bits to 16 * symbol + length; canonical codes of the lengths. A single symbol takes no bits."""

    def __init__(self, length: dict[int, int]):
        if len(length) < 2:
            self.mask, self.table = 0, [next(iter(length), 0) << 4]
            return
        most = max(length.values())
        if sum(1 << (most - n) for n in length.values()) != 1 << most:
            raise ValueError("the prefix code isn't complete")
        size = 1 << most
        self.mask, self.table = size - 1, [0] * size
        for s, start, n in _placed(length):
            if n == most:
                self.table[start] = s << 4 | n
            else:
                self.table[start :: 1 << n] = [s << 4 | n] * (size >> n)


def _read_prefix(bits: _Bits, size: int) -> _Prefix:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        length = {}
        for n in [8 if wide else 1] + [8] * two:
            symbol = bits.read(n)
            if symbol >= size:
                raise ValueError("a symbol beyond the alphabet")
            length[symbol] = 1
        return _Prefix(length)
    first = {}
    for k in range(4 + bits.read(4)):
        n = bits.read(3)
        if n:
            first[_ORDER[k]] = n
    code = _Prefix(first)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if left > size:
        raise ValueError("more code lengths than symbols")
    table, mask, data, place = code.table, code.mask, bits.data, bits.at
    at, before, length = 0, 8, {}
    while at < size and left:
        left -= 1
        window = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7)
        entry = table[window & mask]
        n, used = entry >> 4, entry & 15
        if n < 16:
            place += used
            if n:
                length[at] = before = n
            at += 1
            continue
        window >>= used
        if n == 16:
            run, used = 3 + (window & 3), used + 2
            length.update(dict.fromkeys(range(at, at + run), before))
        elif n == 17:
            run, used = 3 + (window & 7), used + 3
        else:
            run, used = 11 + (window & 127), used + 7
        place += used
        at += run
        if at > size:
            raise ValueError("a run beyond the alphabet")
        if place > bits.end:
            raise ValueError("the image ends early")
    bits.at = place
    if place > bits.end:
        raise ValueError("the image ends early")
    return _Prefix(length)


def _amount(bits: _Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> array:
    """Pixels after prefix codes, back-references and colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    groups, which, precision = 1, None, 0
    if main and bits.read(1):
        precision = bits.read(3) + 2
        which = [(p >> 8) & 0xFFFF for p in _read_image(bits, _parts(width, precision), _parts(height, precision), False)]
        groups = max(which) + 1
    codes = [[(c.table, c.mask) for c in (_read_prefix(bits, n) for n in (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40))] for _ in range(groups)]
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    total, out, row = width * height, array("I"), _parts(width, precision)
    (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = codes[0]
    data, place, end, append, window_of, many = bits.data, bits.at, bits.end, out.append, int.from_bytes, 0
    while many < total:
        if which:
            (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = codes[which[(many // width >> precision) * row + (many % width >> precision)]]
        # Four codes of up to 15 bits fit into what a window holds.
        window = window_of(data[place >> 3 : (place >> 3) + _WINDOW], "little") >> (place & 7)
        entry = green[window & gm]
        n, s = entry & 15, entry >> 4
        if s < 256:
            window >>= n
            x = red[window & rm]
            window >>= x & 15
            y = blue[window & bm]
            window >>= y & 15
            z = alpha[window & am]
            place += n + (x & 15) + (y & 15) + (z & 15)
            pixel = (z >> 4) << 24 | (x >> 4) << 16 | s << 8 | y >> 4
            append(pixel)
            many += 1
            if cache_bits:
                cache[(_HASH * pixel & 0xFFFFFFFF) >> shift] = pixel
        elif s < 280:
            bits.at = place + n
            run = _amount(bits, s - 256)
            window = window_of(data[bits.at >> 3 : (bits.at >> 3) + 8], "little") >> (bits.at & 7)
            entry = far[window & fm]
            bits.at += entry & 15
            d = _amount(bits, entry >> 4)
            place = bits.at
            if d > 120:
                d -= 120
            else:
                x, y = _NEAR[d - 1]
                d = max(1, x + y * width)
            if d > many or run > total - many:
                raise ValueError("a back-reference out of the image")
            # Copied at once, the stretch between repeated as often as the run needs.
            piece = out[many - d : many - d + run] if d >= run else (out[many - d :] * (run // d + 1))[:run]
            out.extend(piece)
            many += run
            if cache_bits:
                for pixel in piece:
                    cache[(_HASH * pixel & 0xFFFFFFFF) >> shift] = pixel
        else:
            place += n
            if s - 280 >= len(cache):
                raise ValueError("beyond the colour cache")
            pixel = cache[s - 280]
            append(pixel)
            many += 1
            cache[(_HASH * pixel & 0xFFFFFFFF) >> shift] = pixel
        if place > end:
            raise ValueError("the image ends early")
    bits.at = place
    return out


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _plus(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0xFF00FF) + (b & 0xFF00FF)) & 0xFF00FF


def _minus(a: int, b: int) -> int:
    return (0x00FF00FF + (a & 0xFF00FF00) - (b & 0xFF00FF00)) & 0xFF00FF00 | (0xFF00FF00 + (a & 0xFF00FF) - (b & 0xFF00FF)) & 0xFF00FF


def _bytes_of(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _select(left: int, top: int, corner: int) -> int:
    a, b, c = _bytes_of(left), _bytes_of(top), _bytes_of(corner)
    return left if sum(abs(y - z) for y, z in zip(b, c, strict=True)) < sum(abs(x - z) for x, z in zip(a, c, strict=True)) else top


def _clamped(parts) -> int:
    out = 0
    for v in parts:
        out = out << 8 | min(255, max(0, v))
    return out


def _full(a: int, b: int, c: int) -> int:
    return _clamped(x + y - z for x, y, z in zip(_bytes_of(a), _bytes_of(b), _bytes_of(c), strict=True))


def _half(a: int, c: int) -> int:
    return _clamped(x + int((x - y) / 2) for x, y in zip(_bytes_of(a), _bytes_of(c), strict=True))


#: Predictions from left, top, top right and top left.
_PREDICTIONS = [
    lambda lf, tp, tr, tl: 0xFF000000,
    lambda lf, tp, tr, tl: lf,
    lambda lf, tp, tr, tl: tp,
    lambda lf, tp, tr, tl: tr,
    lambda lf, tp, tr, tl: tl,
    lambda lf, tp, tr, tl: _average(_average(lf, tr), tp),
    lambda lf, tp, tr, tl: _average(lf, tl),
    lambda lf, tp, tr, tl: _average(lf, tp),
    lambda lf, tp, tr, tl: _average(tl, tp),
    lambda lf, tp, tr, tl: _average(tp, tr),
    lambda lf, tp, tr, tl: _average(_average(lf, tl), _average(tp, tr)),
    lambda lf, tp, tr, tl: _select(lf, tp, tl),
    lambda lf, tp, tr, tl: _full(lf, tp, tl),
    lambda lf, tp, tr, tl: _half(_average(lf, tp), tl),
    lambda lf, tp, tr, tl: 0xFF000000,
    lambda lf, tp, tr, tl: 0xFF000000,
]


def _predicted(pixels: list[int], at: int, width: int, mode) -> int:
    """Prediction at a place from the pixels before it."""
    x, y = at % width, at // width
    if y == 0:
        return pixels[at - 1] if x else 0xFF000000
    if x == 0:
        return pixels[at - width]
    return mode(pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _modes(blocks: list[int], width: int, bits: int):
    row = _parts(width, bits)
    return lambda at: _PREDICTIONS[(blocks[(at // width >> bits) * row + (at % width >> bits)] >> 8) & 15]


def _undo_predictor(pixels: array, width: int, bits: int, blocks: array) -> array:
    out, row = array("I", bytes(4 * len(pixels))), _parts(width, bits)
    size, at = 1 << bits, 0
    left = 0xFF000000
    for at in range(min(width, len(pixels))):
        left = out[at] = _plus(pixels[at], left)
    for y in range(1, len(pixels) // width):
        at = y * width
        left = out[at] = _plus(pixels[at], out[at - width])
        for k in range(row):
            mode = _PREDICTIONS[(blocks[(y >> bits) * row + k] >> 8) & 15]
            for at in range(y * width + max(1, k * size), y * width + min(width, (k + 1) * size)):
                a, b = pixels[at], mode(left, out[at - width], out[at - width + 1], out[at - width - 1])
                left = out[at] = ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00 | ((a & 0xFF00FF) + (b & 0xFF00FF)) & 0xFF00FF
    return out


def _packed(x: np.ndarray) -> array:
    return array("I", np.ascontiguousarray(x, np.uint32).tobytes())


def _spread(blocks: list[int], width: int, height: int, bits: int) -> np.ndarray:
    grid = np.asarray(blocks, np.uint32).reshape(-1, _parts(width, bits))
    return np.repeat(np.repeat(grid, 1 << bits, 0), 1 << bits, 1)[:height, :width].ravel()


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(pixels, width: int, height: int, bits: int, blocks, sign: int) -> array:
    p, m = np.asarray(pixels, np.uint32), _spread(blocks, width, height, bits)
    green, red, blue = _signed(p >> 8), (p >> 16 & 255).astype(np.int32), (p & 255).astype(np.int32)
    new = (red + sign * ((_signed(m) * green) >> 5)) & 255
    true = new if sign > 0 else red  # blue depends on the true red
    blue = (blue + sign * (((_signed(m >> 8) * green) >> 5) + ((_signed(m >> 16) * _signed(true)) >> 5))) & 255
    return _packed(p & 0xFF00FF00 | new.astype(np.uint32) << 16 | blue.astype(np.uint32))


def _greens(pixels, sign: int) -> array:
    p = np.asarray(pixels).astype(np.int64)
    g = p >> 8 & 255
    return _packed(p & 0xFF00FF00 | ((p >> 16) + sign * g & 255) << 16 | (p + sign * g & 255))


def _palette_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(pixels: array, width: int, height: int, palette: array) -> array:
    bits = _palette_bits(len(palette))
    packed = np.asarray(pixels, np.uint32).reshape(height, -1) >> 8 & 255
    depth, many = 8 >> bits, 1 << bits
    index = (packed[:, :, None] >> (np.arange(many) * depth) & ((1 << depth) - 1)).reshape(height, -1)[:, :width]
    colours = np.zeros(256, np.int64)
    colours[: len(palette)] = palette
    return _packed(colours[index].ravel())


def chunk_of(data: bytes) -> bytes:
    """The VP8L chunk of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless image in the file")


def decode(data: bytes, most: int = PIXELS) -> tuple[int, int, list[int]]:
    """Width, height and pixels of a lossless WebP file of at most so many pixels; ValueError for anything else."""
    width, height, pixels = decode_pixels(data, most)
    return width, height, pixels.tolist()


def decode_pixels(data: bytes, most: int = PIXELS) -> tuple[int, int, array]:
    """As ``decode``, with the pixels in an array of unsigned 32-bit numbers."""
    bits = _Bits(chunk_of(data))
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    if width * height > most:
        raise ValueError(f"more than {most} pixels")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            blocks = _read_image(bits, _parts(now, block), _parts(height, block), False)
            undo.append((kind, now, block, blocks))
        elif kind == GREEN:
            undo.append((kind, now, 0, []))
        else:
            count = bits.read(8) + 1
            palette = _read_image(bits, count, 1, False)
            for k in range(1, count):
                palette[k] = _plus(palette[k], palette[k - 1])
            undo.append((kind, now, 0, palette))
            now = _parts(now, _palette_bits(count))
    pixels = _read_image(bits, now, height, True)
    for kind, w, block, more in reversed(undo):
        if kind == PREDICTOR:
            pixels = _undo_predictor(pixels, w, block, more)
        elif kind == CROSS:
            pixels = _cross(pixels, w, height, block, more, 1)
        elif kind == GREEN:
            pixels = _greens(pixels, 1)
        else:
            pixels = _undo_palette(pixels, w, height, more)
    return width, height, pixels


# Encoder.


class _Out:
    def __init__(self):
        self.value, self.n, self.done = 0, 0, []

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n > 512:
            size = self.n >> 3
            self.done.append((self.value & ((1 << size * 8) - 1)).to_bytes(size, "little"))
            self.value >>= size * 8
            self.n &= 7

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.n + 7) >> 3, "little")


def code_lengths(counts: dict[int, int], most: int) -> dict[int, int]:
    """Lengths of a prefix code no longer than ``most``; counts are flattened until it fits."""
    while True:
        symbols = sorted(counts)
        heap = [(counts[s], k) for k, s in enumerate(symbols)]
        heapq.heapify(heap)
        parent, new = [0] * (2 * len(symbols)), len(symbols)
        while len(heap) > 1:
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * (2 * len(symbols))
        for k in range(new - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        length = dict(zip(symbols, depth, strict=False)) if len(symbols) > 1 else dict.fromkeys(symbols, 0)
        if max(length.values(), default=0) <= most:
            return length
        counts = {s: (c + 1) // 2 for s, c in counts.items()}


def _canonical(length: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Bits (first bit lowest) and their number by symbol; none for a single symbol."""
    if len(length) < 2:
        return {s: (0, 0) for s in length}
    return {s: (code, n) for s, code, n in _placed(length)}


def _write_prefix(out: _Out, counts: Counter, size: int) -> dict[int, tuple[int, int]]:
    used = sorted(counts) or [0]
    if len(used) <= 2 and used[-1] < 256:
        wide = used[0] > 1
        for value, n in [(1, 1), (len(used) - 1, 1), (int(wide), 1), (used[0], 8 if wide else 1)] + [(s, 8) for s in used[1:]]:
            out.write(value, n)
        return _canonical(dict.fromkeys(used, 1))
    length = code_lengths(counts, 15)
    if len(length) == 1:
        length = dict.fromkeys(length, 1)
    # Runs of one length, zeros between the symbols used.
    runs, last = [], -1
    for s in sorted(length):
        if s > last + 1:
            runs.append((0, s - last - 1))
        if runs and runs[-1][0] == length[s] and s == last + 1:
            runs[-1] = (length[s], runs[-1][1] + 1)
        else:
            runs.append((length[s], 1))
        last = s
    if last + 1 < size:
        runs.append((0, size - last - 1))
    steps = []
    for n, left in runs:
        while left:
            run = min(left, 7 if n else 138)
            if n == 0 and run >= 3:
                steps.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
            elif n and run >= 4:
                steps += [(n, 0, 0), (16, run - 4, 2)]
            else:
                steps += [(n, 0, 0)] * run
            left -= run
    inner = code_lengths(Counter(s for s, _, _ in steps), 7)
    inner = dict.fromkeys(inner, 1) if len(inner) == 1 else inner
    last = max(k for k, s in enumerate(_ORDER) if s in inner)
    out.write(0, 1)
    out.write(max(0, last + 1 - 4), 4)
    for k in range(max(4, last + 1)):
        out.write(inner.get(_ORDER[k], 0), 3)
    out.write(0, 1)
    codes = _canonical(inner)
    for s, value, n in steps:
        out.write(*codes[s])
        out.write(value, n)
    return _canonical(length)


def _split(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _steps(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """Literals ("p", pixel), copies ("c", run, distance code) and cache hits ("k", index)."""
    near = {max(1, x + y * width): k + 1 for k, (x, y) in reversed(list(enumerate(_NEAR)))}
    out, cache, last, at = [], {}, {}, 0
    slot = lambda p: (_HASH * p & 0xFFFFFFFF) >> (32 - cache_bits)

    def note(k: int) -> None:
        if k + 1 < len(pixels):
            last[pixels[k], pixels[k + 1]] = k
        if cache_bits:
            cache[slot(pixels[k])] = pixels[k]

    while at < len(pixels):
        run = 0
        if references and at + 1 < len(pixels) and (start := last.get((pixels[at], pixels[at + 1]))) is not None:
            while at + run < len(pixels) and run < 4096 and pixels[start + run] == pixels[at + run]:
                run += 1
        if run >= 3:
            out.append(("c", run, near.get(at - start, at - start + 120)))
        elif cache_bits and cache.get(slot(pixels[at]), 0) == pixels[at]:
            out.append(("k", slot(pixels[at])))
            run = 1
        else:
            out.append(("p", pixels[at]))
            run = 1
        for k in range(at, at + run):
            note(k)
        at += run
    return out


def _write_image(out: _Out, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = False, groups: int = 0) -> None:
    out.write(1 if cache_bits else 0, 1)
    if cache_bits:
        out.write(cache_bits, 4)
    which = None
    if main:
        out.write(1 if groups > 1 else 0, 1)
        if groups > 1:
            precision, height = 2, len(pixels) // width
            row = _parts(width, precision)
            which = [k % groups for k in range(row * _parts(height, precision))]
            which[-1] = groups - 1
            out.write(precision - 2, 3)
            _write_image(out, [k << 8 for k in which], row, False)
    steps = _steps(pixels, width, cache_bits, references)
    many = max(1, groups if which else 1)
    counts = [[Counter() for _ in range(5)] for _ in range(many)]
    planned, at = [], 0
    for s in steps:
        g = which[(at // width >> 2) * _parts(width, 2) + (at % width >> 2)] if which else 0
        if s[0] == "p":
            a, r, gr, b = _bytes_of(s[1])
            plan = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)]
        elif s[0] == "k":
            plan = [(0, 280 + s[1], 0, 0)]
        else:
            x, y = _split(s[1]), _split(s[2])
            plan = [(0, 256 + x[0], *x[1:]), (4, *y)]
        for k, symbol, _, _ in plan:
            counts[g][k][symbol] += 1
        planned.append((g, plan))
        at += s[1] if s[0] == "c" else 1
    sizes = (280 + (cache_bits and 1 << cache_bits), 256, 256, 256, 40)
    codes = [[_write_prefix(out, c, n) for c, n in zip(group, sizes, strict=True)] for group in counts]
    for g, plan in planned:
        of = codes[g]
        value = size = 0
        for k, symbol, extra, n in plan:
            code, m = of[k][symbol]
            value |= (code | extra << m) << size
            size += m + n
        out.write(value, size)


def encode(pixels: list[int], width: int, tools: tuple[str, ...] = ("predictor", "references")) -> bytes:
    """A lossless WebP file; tools: palette, predictor, cross, green, references, cache, groups."""
    height, block = len(pixels) // width, 2
    if not 0 < width <= 16384 or not 0 < height <= 16384 or width * height != len(pixels):
        raise ValueError("no image of this size")
    out, now = _Out(), width
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.write(value, n)
    colours = sorted(set(pixels))
    if "palette" in tools and len(colours) <= 256:
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(colours) - 1, 8)
        _write_image(out, [colours[0]] + [_minus(b, a) for a, b in zip(colours, colours[1:], strict=False)], len(colours), False)
        bits, place = _palette_bits(len(colours)), {c: k for k, c in enumerate(colours)}
        packed = []
        for y in range(height):
            for x in range(0, width, 1 << bits):
                value = sum(place[p] << (k * (8 >> bits)) for k, p in enumerate(pixels[y * width + x : min(y * width + x + (1 << bits), (y + 1) * width)]))
                packed.append(0xFF000000 | value << 8)
        pixels, now = packed, _parts(width, bits)
    count = _parts(now, block) * _parts(height, block)
    if "predictor" in tools:
        blocks = [0xFF000000 | (k % 14) << 8 for k in range(count)]
        out.write(1 | PREDICTOR << 1 | block - 2 << 3, 6)
        _write_image(out, blocks, _parts(now, block), False)
        mode = _modes(blocks, now, block)
        pixels = [_minus(p, _predicted(pixels, at, now, mode(at))) for at, p in enumerate(pixels)]
    if "cross" in tools:
        blocks = [0xFF000000 | (k * 37 + 5) % 256 << 16 | (k * 91 + 200) % 256 << 8 | (k * 53 + 30) % 256 for k in range(count)]
        out.write(1 | CROSS << 1 | block - 2 << 3, 6)
        _write_image(out, blocks, _parts(now, block), False)
        pixels = _cross(pixels, now, height, block, blocks, -1)
    if "green" in tools:
        out.write(1 | GREEN << 1, 3)
        pixels = _greens(pixels, -1)
    out.write(0, 1)
    _write_image(out, pixels, now, True, 6 if "cache" in tools else 0, "references" in tools, 3 if "groups" in tools else 0)
    data = out.bytes()
    body = b"WEBPVP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: Tools by turns, so that a column made here needs every part of the decoder.
TURNS = (("predictor", "references"), ("green", "cross", "cache"), ("palette", "references", "cache"), ("predictor", "cross", "green", "groups"), ("references", "cache", "groups"), ())


def images_of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", image_col: str = "image") -> DataFrame:
    """``vectors`` with an image of each vector: a pixel per component, rows of up to 8, scaled to 24 bits.

    Components are cut to -1 to 1; null ones and those that aren't numbers count as -1. Null
    and empty vectors have no image, nor have those that don't fill their last row, but
    for single rows. The tools of the encoder go by the id, or a checksum of one that isn't a number; null ids take the first.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
        out = []
        for ident, vector in zip(ids, batch.column(batch.schema.get_field_index(vector_col)).to_pylist(), strict=True):
            if not vector or (len(vector) > 8 and len(vector) % 8):
                out.append(None)
                continue
            x = np.nan_to_num(np.array([-1.0 if v is None else v for v in vector], np.float64), nan=-1.0, posinf=1.0, neginf=-1.0)
            pixels = (np.floor((np.clip(x, -1, 1) + 1.0) * 8388607.5).astype(np.int64) | 0xFF000000).tolist()
            out.append(encode(pixels, min(8, len(pixels)), TURNS[(ident if isinstance(ident, int) else zlib.crc32(str(ident or "").encode())) % len(TURNS)]))
        return [pa.array(out, pa.binary())]

    return added(vectors, run, [(image_col, "binary")])


def decode_images(df: DataFrame, image_col: str = "image", most: int = PIXELS) -> DataFrame:
    """``df`` with width, height and pixels (ARGB, rows on end) of each lossless WebP image, and an error.

    Null and empty images have nulls in all four; what can't be decoded, or has more
    than ``most`` pixels, has its error and nulls. Repeated images are decoded each. Other columns are kept; those named like the new
    ones are replaced. An empty table stays empty.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for data in batch.column(batch.schema.get_field_index(image_col)).to_pylist():
            try:
                rows.append((*decode_pixels(data, most), None) if data else (None,) * 4)
            except (ValueError, IndexError, TypeError) as e:
                rows.append((None, None, None, str(e) or "broken"))
        width, height, pixels, error = zip(*rows, strict=True) if rows else ((),) * 4
        signed = [None if p is None else np.frombuffer(p, np.int32) for p in pixels]
        return [pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(signed, pa.list_(pa.int32())), pa.array(error, pa.string())]

    return added(df, run, [("width", "int"), ("height", "int"), ("pixels", "array<int>"), ("error", "string")])


def op2_webp(spark, sf_dir):
    """All vectors as lossless images, decoded again into pixels."""
    images = images_of_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return decode_images(images.select("vec_id", "image")).select("vec_id", "width", "height", "pixels", "error")


QUERIES = {"op2_webp": op2_webp}
ORACLE = {
    "op2_webp": """SELECT vec_id, CAST(least(8, len(embedding)) AS INTEGER) AS width, CAST(greatest(1, len(embedding) // 8) AS INTEGER) AS height,
    list_transform(embedding, lambda x: CAST(floor((greatest(-1, least(1, CAST(x AS DOUBLE))) + 1.0) * 8388607.5) AS INTEGER) - 16777216) AS pixels, CAST(NULL AS VARCHAR) AS error
    FROM embeddings"""
}
