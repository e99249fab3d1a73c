"""Lossless WebP (VP8L) in numpy: a decoder of the whole format and an encoder for what media columns store.

Pixels are uint32 ARGB in arrays of (height, width). The decoder reads prefix codes, back-references and the colour cache, meta prefix
groups, and inverts predictor, cross-colour, subtract-green and palette transforms. Files are decoded many at a time: each is parsed up to its next entropy-coded
image, and the images of all files then advance together, a pixel of each at a step, by array operations; the few longest, and images with meta
prefix groups, are read pixel by pixel.

The encoder takes the cheapest of four forms by the entropy of its channels (as it is, green subtracted, predicted from the row above or the pixel before, or a
palette), finds back-references by hashes of three pixels, sends repeated pixels through the colour cache, and gives every channel a prefix code of mixed lengths.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Generator, Sequence

import numpy as np

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
CACHE_FACTOR = 0x1E35A7BD
BLACK = 0xFF000000
PREDICTOR, CROSS, SUBTRACT_GREEN, PALETTE = range(4)


#: Fewer images than this are read pixel by pixel, which then costs less than array operations do.
FEW = 48


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data + bytes(16), 0, 8 * len(data)

    def read(self, n: int) -> int:
        out = int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.seek(self.at + n)
        return out

    def seek(self, bit: int) -> None:
        if bit > self.size:
            raise ValueError("the stream ends early")
        self.at = bit


@functools.cache
def _reversed(n: int) -> np.ndarray:
    """All numbers of n bits, with their bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


class Prefix:
    """A canonical prefix code from its lengths. table: 16 * symbol + length by the next `bits` bits of the stream. Both are made when they are needed, those of many codes at once by `make_tables`."""

    def __init__(self, lengths: Sequence[int]) -> None:
        self.lengths = bytes(lengths)

    def __getattr__(self, name: str) -> object:
        if name not in ("bits", "table"):
            raise AttributeError(name)
        make_tables([self])
        return self.__dict__[name]


def make_tables(codes: Sequence[Prefix]) -> None:
    sizes = np.array([len(c.lengths) for c in codes])
    ends = np.cumsum(sizes)
    lengths = np.frombuffer(b"".join([c.lengths for c in codes]), np.uint8)
    used = np.flatnonzero(lengths)
    code, size = np.searchsorted(ends, used, "right"), lengths[used].astype(np.int64)
    order = np.argsort(code << 4 | size, kind="stable")
    code, size, symbol = code[order], size[order], (used - (ends - sizes)[code])[order]
    number = np.bincount(code, minlength=len(codes))
    last = np.cumsum(number) - 1
    many = number > 1
    most = np.zeros(len(codes), np.int64)
    most[many] = size[last[many]]
    for k in np.flatnonzero(~many).tolist():
        codes[k].bits, codes[k].table = 0, np.array([16 * symbol[last[k]] if number[k] else 0], np.int32)
    mixed = many[code]
    code, entry, each = code[mixed], (16 * symbol + size)[mixed].astype(np.int32), (1 << np.maximum(most[code] - size, 0))[mixed]
    if (np.bincount(code, each, len(codes))[many] != 1 << most[many]).any():
        raise ValueError("the prefix code isn't complete")
    for bits in np.unique(most[many]).tolist():
        own = many & (most == bits)
        pick = own[code]
        rows = np.repeat(entry[pick], each[pick]).reshape(-1, 1 << bits)[:, _reversed(bits)]
        for k, row in zip(np.flatnonzero(own).tolist(), rows, strict=True):
            codes[k].bits, codes[k].table = bits, row


@functools.lru_cache(4096)
def _length_code(packed: int) -> tuple[list[int], int]:
    """Table and mask of the code that lengths are sent by, from its own lengths, three bits each in LENGTH_ORDER."""
    of = [0] * 19
    for at, k in enumerate(LENGTH_ORDER):
        of[k] = packed >> 3 * at & 7
    code = Prefix(of)
    return code.table.tolist(), (1 << code.bits) - 1


def read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = bytearray(size)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    table, mask = _length_code(bits.read(3 * (4 + bits.read(4))))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before, data, place = 0, 8, bits.data, bits.at
    window, held = 0, 0
    while at < size and left > 0:
        left -= 1
        if held < 14:  # a symbol and its extra bits
            window, held = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7), 64 - (place & 7)
        entry = table[window & mask]
        s = entry >> 4
        if s < 16:
            lengths[at] = s
            at += 1
            if s:
                before = s
            n = entry & 15
        else:
            n, (extra, least) = entry & 15, ((2, 3), (3, 3), (7, 11))[s - 16]
            times = least + (window >> n & ((1 << extra) - 1))
            n += extra
            if at + times > size:
                raise ValueError("a run of code lengths is too long")
            if s == 16:
                lengths[at : at + times] = bytes([before]) * times
            at += times
        window >>= n
        held -= n
        place += n
    bits.seek(place)
    return Prefix(lengths)


class Image:
    """An entropy-coded image that waits to be read: where it begins, its codes by group, and what groups there are."""

    def __init__(self, bits: Bits, width: int, total: int, cache_bits: int, codes: list[list[Prefix]], groups: list[int] | None, group_bits: int) -> None:
        self.bits, self.width, self.total, self.cache_bits, self.codes, self.groups, self.group_bits = bits, width, total, cache_bits, codes, groups, group_bits


def parse_image(bits: Bits, width: int, height: int, main: bool) -> Generator[Image, np.ndarray, np.ndarray]:
    """Gives the images to be read, the last of them this one; is sent their pixels, and returns its own, flat."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, group_bits = None, 0
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        numbers = yield from parse_image(bits, (width + (1 << group_bits) - 1) >> group_bits, (height + (1 << group_bits) - 1) >> group_bits, False)
        groups = (numbers >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(1 + max(groups or [0]))]
    return (yield Image(bits, width, width * height, cache_bits, codes, groups, group_bits))


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


class Progress:
    """How far an image is: pixels, the next one's number, bit, what is left to copy from how far back, and the cache."""

    def __init__(self, pixels: list[int], n: int, at: int, left: int, far: int, cache: list[int]) -> None:
        self.pixels, self.n, self.at, self.left, self.far, self.cache = pixels, n, at, left, far, cache


def read_on(image: Image, now: Progress) -> np.ndarray:
    """Reads the rest of an image pixel by pixel."""
    data, at, n, out, cache = image.bits.data, now.at, now.n, now.pixels, now.cache
    total, width, shift = image.total, image.width, 32 - image.cache_bits
    codes = [[(c.table.tolist(), (1 << c.bits) - 1) for c in group] for group in image.codes]
    groups, block = image.groups, image.group_bits
    across = (width + (1 << block) - 1) >> block
    (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (away, away_mask) = codes[0]
    left, far = now.left, now.far
    while n < total:
        if left:
            end = n + left
            for k in range(n, end):
                out[k] = p = out[k - far]
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
            n, left = end, 0
            continue
        if groups is not None:
            (green, green_mask), (red, red_mask), (blue, blue_mask), (alpha, alpha_mask), (away, away_mask) = codes[groups[(n // width >> block) * across + (n % width >> block)]]
        window = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
        e = green[window & green_mask]
        window >>= e & 15
        at += e & 15
        s = e >> 4
        if s < 256:
            e = red[window & red_mask]
            window >>= e & 15
            f = blue[window & blue_mask]
            window >>= f & 15
            g = alpha[window & alpha_mask]
            at += (e & 15) + (f & 15) + (g & 15)
            p = g >> 4 << 24 | e >> 4 << 16 | s << 8 | f >> 4
        elif s < 280:
            s -= 256
            extra = max(0, s - 2 >> 1)
            left = (s if s < 4 else ((2 + (s & 1)) << extra) + (window & ((1 << extra) - 1))) + 1
            at += extra
            window = int.from_bytes(data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)
            e = away[window & away_mask]
            window >>= e & 15
            s = e >> 4
            extra = max(0, s - 2 >> 1)
            far = _distance((s if s < 4 else ((2 + (s & 1)) << extra) + (window & ((1 << extra) - 1))) + 1, width)
            at += (e & 15) + extra
            if far > n or n + left > total:
                raise ValueError("a reference leaves the image")
            continue
        else:
            p = cache[s - 280]
        out[n] = p
        cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
        n += 1
        if at > image.bits.size:
            raise ValueError("the stream ends early")
    image.bits.seek(at)
    return np.array(out, np.uint32)


def _fresh(image: Image) -> Progress:
    return Progress([0] * image.total, 0, image.bits.at, 0, 0, [0] * (1 << image.cache_bits))


def read_together(images: list[Image]) -> list[np.ndarray]:
    """The pixels of many images: one of each at a step, by array operations, as long as there are FEW at least."""
    order = sorted((k for k in range(len(images)) if images[k].groups is None), key=lambda k: -images[k].total)
    out: list = [None] * len(images)
    if len(order) >= FEW:
        for k, pixels in zip(order, _steps([images[k] for k in order]), strict=True):
            out[k] = pixels
    return [read_on(i, _fresh(i)) if p is None else p for i, p in zip(images, out, strict=True)]


def _steps(images: list[Image]) -> list[np.ndarray]:
    """images: the longest first, without groups."""
    parts = [i.bits.data for i in images]
    starts = np.cumsum([0, *(len(x) for x in parts)])
    data = b"".join(parts) + bytes(8)
    words = np.ndarray(len(data) - 7, "<i8", data, strides=(1,)).copy()  # from each byte on; the sign's bits come in above the 57 that are used
    tables = [c for i in images for c in i.codes[0]]
    make_tables(tables)
    ends = np.cumsum([0, *(len(c.table) for c in tables)])
    table = np.concatenate([c.table for c in tables])
    base = ends[:-1].reshape(-1, 5).T.copy()
    mask = np.array([(1 << c.bits) - 1 for c in tables]).reshape(-1, 5).T.copy()
    pos = np.array([i.bits.at for i in images], np.int64) + 8 * starts[:-1]
    last = np.array([i.bits.size for i in images], np.int64) + 8 * starts[:-1]
    totals = [i.total for i in images]
    total, width = np.array(totals), np.array([i.width for i in images])
    offset = np.cumsum([0, *totals])
    pixels = np.zeros(offset[-1], np.int32)  # the bits of uint32
    slots = np.cumsum([0, *(1 << i.cache_bits for i in images)])
    cache, shift = np.zeros(slots[-1], np.int32), np.array([min(31, 32 - i.cache_bits) for i in images], np.uint32)
    cached = np.array([i.cache_bits > 0 for i in images])
    left, far = np.zeros(len(images), np.int64), np.ones(len(images), np.int64)
    near = np.array(NEAR)

    def peek(p: np.ndarray) -> np.ndarray:
        return words[p >> 3] >> (p & 7)

    def value(symbol: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.maximum(0, (symbol - 2) >> 1)
        more = peek(p) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + more) + 1, p + extra

    k, n = len(images), 0
    while k >= FEW:
        p, copying = pos[:k], left[:k] > 0
        w = peek(p)
        e = table[base[0, :k] + (w & mask[0, :k])]
        symbol, size = e >> 4, e & 15
        w >>= size
        r = table[base[1, :k] + (w & mask[1, :k])]
        red = r & 15
        w >>= red
        b = table[base[2, :k] + (w & mask[2, :k])]
        p1 = p + size
        p3 = p1 + (red + (b & 15))
        a = table[base[3, :k] + (peek(np.minimum(p3, last[:k])) & mask[3, :k])]
        plain = symbol < 256
        new = np.where(plain, (a >> 4) << 24 | (r >> 4) << 16 | symbol << 8 | b >> 4, cache[slots[:k] + np.maximum(symbol - 280, 0)])
        pos[:k] = np.where(copying, p, np.where(plain, p3 + (a & 15), p1))
        refs = np.flatnonzero(~copying & ~plain & (symbol < 280))
        if len(refs):
            length, q = value(symbol[refs].astype(np.int64) - 256, pos[refs])
            e = table[base[4, refs] + (peek(q) & mask[4, refs])].astype(np.int64)
            code, q = value(e >> 4, q + (e & 15))
            at = near[np.minimum(code, len(near)) - 1]
            back = np.where(code > len(near), code - len(near), np.maximum(1, at[:, 0] + at[:, 1] * width[refs]))
            if (back > n).any() or (n + length > total[refs]).any():
                raise ValueError("a reference leaves the image")
            pos[refs], left[refs], far[refs] = q, length, back
            copying[refs] = True
        if copying.any():
            new = np.where(copying, pixels[offset[:k] + np.maximum(n - far[:k], 0)], new)
            left[:k] -= copying
        pixels[offset[:k] + n] = new
        cache[slots[:k] + (new.view(np.uint32) * np.uint32(CACHE_FACTOR) >> shift[:k]) * cached[:k]] = new
        if (pos[:k] > last[:k]).any():
            raise ValueError("the stream ends early")
        n += 1
        while k and totals[k - 1] <= n:
            k -= 1
    out = []
    for j, i in enumerate(images):
        i.bits.seek(int(pos[j] - 8 * starts[j]))
        own = pixels[offset[j] : offset[j + 1]].view(np.uint32)
        if i.total > n:
            out.append(read_on(i, Progress(own.tolist(), n, i.bits.at, int(left[j]), int(far[j]), cache[slots[j] : slots[j + 1]].view(np.uint32).tolist())))
        else:
            out.append(own)
    return out


def _octets(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) uint8 of alpha, red, green, blue."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)[..., ::-1]


def _channels(pixels: np.ndarray) -> np.ndarray:
    return _octets(pixels).astype(np.int32)


def _pixels(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, top_right, top_left):
    """The prediction of a mode from the four neighbours, channel by channel."""
    if mode == 0 or mode > 13:
        return (255, 0, 0, 0)
    each = list(zip(left, top, top_right, top_left, strict=True))
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 11:
        nearer_left = sum(abs(t - c) for _, t, _, c in each) < sum(abs(lf - c) for lf, _, _, c in each)
        return left if nearer_left else top
    how = {
        5: lambda lf, t, r, c: ((lf + r >> 1) + t) >> 1, 6: lambda lf, t, r, c: lf + c >> 1, 7: lambda lf, t, r, c: lf + t >> 1, 8: lambda lf, t, r, c: c + t >> 1,
        9: lambda lf, t, r, c: t + r >> 1, 10: lambda lf, t, r, c: ((lf + c >> 1) + (t + r >> 1)) >> 1,
        12: lambda lf, t, r, c: min(255, max(0, lf + t - c)), 13: lambda lf, t, r, c: _half(lf + t >> 1, c),
    }[mode]
    return tuple(how(*x) for x in each)


def _half(average: int, corner: int) -> int:
    d = average - corner
    return min(255, max(0, average + (d // 2 if d >= 0 else -(-d // 2))))


def _predict(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away the predictions."""
    across = (width + (1 << bits) - 1) >> bits
    source = [tuple(p) for p in _channels(pixels).tolist()]
    whole = source if not inverse else [None] * len(source)
    out = [None] * len(source)
    kinds = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    for n, p in enumerate(source):
        y, x = divmod(n, width)
        if n == 0:
            guess = (255, 0, 0, 0)
        elif y == 0:
            guess = whole[n - 1]
        elif x == 0:
            guess = whole[n - width]
        else:
            guess = predicted(kinds[(y >> bits) * across + (x >> bits)], whole[n - 1], whole[n - width], whole[n - width + 1], whole[n - width - 1])
        out[n] = tuple((a + b if inverse else a - b) & 255 for a, b in zip(p, guess, strict=True))
        if inverse:
            whole[n] = out[n]
    return _pixels(np.array(out, np.int32).reshape(-1, 4))


def _cross(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int, inverse: bool) -> np.ndarray:
    c = _channels(pixels)
    across = (width + (1 << bits) - 1) >> bits
    y, x = np.divmod(np.arange(len(pixels)), width)
    e = _channels(elements)[(y >> bits) * across + (x >> bits)].astype(np.int8).astype(np.int32)
    signed = lambda v: (v & 255).astype(np.uint8).astype(np.int8).astype(np.int32)
    delta = lambda t, v: t * signed(v) >> 5
    red_to_blue, green_to_blue, green_to_red = e[:, 1], e[:, 2], e[:, 3]
    sign = 1 if inverse else -1
    old_red = c[:, 1].copy()
    c[:, 1] += sign * delta(green_to_red, c[:, 2])
    c[:, 3] += sign * delta(green_to_blue, c[:, 2]) + sign * delta(red_to_blue, c[:, 1] if inverse else old_red)
    return _pixels(c)


def parse(data: bytes) -> Generator[Image, np.ndarray, np.ndarray]:
    """Gives the images of a lossless WebP file one after the other, is sent their pixels, and returns the file's pixels (height, width)."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or len(data) < 25:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen, coded = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            block = bits.read(3) + 2
            part = yield from parse_image(bits, (coded + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
            undo.append((kind, coded, part, block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            table = _pixels(np.cumsum(_channels((yield from parse_image(bits, n, 1, False))), 0))
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, coded, table, bundle))
            coded = (coded + (1 << bundle) - 1) >> bundle
        else:
            undo.append((kind, coded, None, 0))
    pixels = yield from parse_image(bits, coded, height, True)
    for kind, wide, extra, b in reversed(undo):
        if kind == PREDICTOR:
            pixels = _predict(pixels, wide, height, extra, b, True)
        elif kind == CROSS:
            pixels = _cross(pixels, wide, height, extra, b, True)
        elif kind == SUBTRACT_GREEN:
            c = _channels(pixels)
            c[:, [1, 3]] += c[:, 2:3]
            pixels = _pixels(c)
        else:
            pixels = _unbundle(pixels, wide, height, extra, b)
    return pixels.reshape(height, width)


def decode_many(files: Sequence[bytes]) -> list[np.ndarray]:
    """The pixels (height, width) of lossless WebP files."""
    out: list = [None] * len(files)
    waiting = [(k, g, next(g)) for k, g in enumerate(map(parse, files))]
    while waiting:
        read, still = read_together([image for _, _, image in waiting]), []
        for (k, g, _), pixels in zip(waiting, read, strict=True):
            try:
                still.append((k, g, g.send(pixels)))
            except StopIteration as done:
                out[k] = done.value
        waiting = still
    return out


def decode(data: bytes) -> np.ndarray:
    """The pixels (height, width) of a lossless WebP file."""
    return decode_many([data])[0]


def _unbundle(pixels: np.ndarray, width: int, height: int, table: np.ndarray, bundle: int) -> np.ndarray:
    per, each = 1 << bundle, 8 >> bundle
    green = (pixels >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    index = np.stack([green >> np.uint32(each * k) & np.uint32((1 << each) - 1) for k in range(per)], -1).reshape(height, -1)[:, :width].ravel()
    return np.where(index < len(table), table[np.minimum(index, len(table) - 1)], np.uint32(0))


class Writer:
    """Writes little-endian bit fields."""

    def __init__(self) -> None:
        self.value, self.n, self.parts = 0, 0, []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n
        if self.n >= 1024:
            whole = self.n >> 3
            self.parts.append((self.value & ((1 << 8 * whole) - 1)).to_bytes(whole, "little"))
            self.value >>= 8 * whole
            self.n -= 8 * whole

    def bytes(self) -> bytes:
        return b"".join(self.parts) + self.value.to_bytes((self.n + 7) >> 3, "little")


#: A run of zeros that one symbol spells, or a length.
SPELT = re.compile(rb"\x00{3,138}|[\x00-\x0f]")


def write_lengths(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code: simple where it has one symbol below 256, else its lengths, runs of zeros by 17 and 18, under a code of one length."""
    data = np.asarray(lengths, np.uint8).tobytes()
    if data.count(0) == len(data) - 1 and (used := len(data.rstrip(b"\0")) - 1) < 256:
        w.put(0b101 | used << 3, 11)
        return
    runs = SPELT.findall(data)
    spelling = _spelling(tuple(sorted(set(map(_length_symbol, set(runs))))))
    w.put(spelling.head, 5 + 3 * len(LENGTH_ORDER))
    bits = "".join(map(spelling.__getitem__, reversed(runs))) + "0"
    w.put(int(bits, 2), len(bits))


@functools.lru_cache(1024)
def _length_symbol(run: bytes) -> int:
    return run[0] if len(run) < 3 else 17 if len(run) < 11 else 18


class Spelling(dict):
    """The bits of runs, the first one last, by a code of one length for the symbols (kinds) that lengths are sent by; head announces that code."""

    def __init__(self, kinds: Sequence[int]) -> None:
        size = max(1, (len(kinds) - 1).bit_length())
        full = sorted([*kinds, *[k for k in range(19) if k not in kinds][: (1 << size) - len(kinds)]]) if len(kinds) > 1 else kinds
        self.head = 15 << 1 | sum((size if k in full else 0) << 3 * at for at, k in enumerate(LENGTH_ORDER)) << 5
        self.words = {k: f"{word:0{size}b}" if len(kinds) > 1 else "" for k, word in zip(full, _reversed(size).tolist(), strict=False)}

    def __missing__(self, run: bytes) -> str:
        n = len(run)
        out = self[run] = ("" if n < 3 else f"{n - 3:03b}" if n < 11 else f"{n - 11:07b}") + self.words[_length_symbol(run)]
        return out


_spelling = functools.lru_cache(4096)(Spelling)


def mixed_lengths(counts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lengths of many complete prefix codes, at most 15, whose symbols' counts end at `ends`: the rounded-up information of each symbol, shortened, common symbols first, until the code is full."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    code = np.searchsorted(ends, used, "right")
    number = np.bincount(code, minlength=len(ends))
    out[np.concatenate([[0], ends[:-1]])[number == 0]] = 1
    out[used[number[code] == 1]] = 1
    used = used[number[code] > 1]
    n = number[number > 1]
    if not len(n):
        return out
    begin = np.cumsum(n) - n
    least = -(-np.add.reduceat(counts[used], begin) // (1 << 13))
    c = np.maximum(counts[used], np.repeat(least, n)).astype(np.float64)
    sizes = np.maximum(1, np.ceil(np.log2(np.repeat(np.add.reduceat(c, begin), n) / c))).astype(np.int64)
    most = np.maximum.reduceat(sizes, begin)
    room = (1 << most) - np.add.reduceat(1 << (np.repeat(most, n) - sizes), begin)
    order = np.lexsort((-c, np.repeat(np.arange(len(n)), n)))
    sizes = sizes[order]
    open_codes = np.argsort(-n, kind="stable")
    while len(open_codes := open_codes[room[open_codes] > 0]):  # a symbol of each code at a step, the longest codes first
        at, high, left = begin[open_codes], most[open_codes], room[open_codes]
        ends_at = np.searchsorted(-n[open_codes], -np.arange(n[open_codes[0]]), "left").tolist()
        for j, k in enumerate(ends_at):
            size = sizes[at[:k] + j]
            gain = 1 << (high[:k] - size)
            shorter = (gain <= left[:k]) & (size > 1)
            sizes[at[:k] + j] = size - shorter
            left[:k] -= gain * shorter
        room[open_codes] = left
    out[used[order]] = sizes
    return out


def code_words(lengths: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of many codes the bits of its word, first one lowest, and their number; none where a code has one symbol."""
    words, sizes = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    code = np.searchsorted(ends, used, "right")
    several = np.bincount(code, minlength=len(ends))[code] > 1
    used, code = used[several], code[several]
    size = lengths[used]
    order = np.argsort(code << 4 | size, kind="stable")
    used, code, size = used[order], code[order], size[order]
    each = 1 << (15 - size)  # words begin where the shorter ones of their code end; a complete code takes all 1 << 15
    words[used] = _reversed(15)[np.cumsum(each) - each & (1 << 15) - 1]
    sizes[used] = size
    return words, sizes


def _start(w: Writer, width: int, height: int) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def _file(stream: bytes) -> bytes:
    stream += b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(stream)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and distances as prefix symbols, extra values and their numbers of bits."""
    v = values - 1
    top = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    extra = np.maximum(top - 1, 0)
    second = v >> extra & 1
    small = v < 4
    return np.where(small, v, 2 * top + second), np.where(small, 0, v & ((1 << extra) - 1)), np.where(small, 0, extra)


@functools.cache
def _near_codes(width: int) -> dict[int, int]:
    """The codes of the distances that the neighbourhood names."""
    out: dict[int, int] = {}
    for code in range(1, len(NEAR) + 1):
        out.setdefault(_distance(code, width), code)
    return out


def _before(values: np.ndarray, size: int) -> np.ndarray:
    """For each place the last one before it with the same value, of size bits (the highest count where places leave no room for all), or -1."""
    place = len(values).bit_length()
    keys = np.sort(values.astype(np.uint64) >> np.uint64(max(0, size + place - 64)) << np.uint64(place) | np.arange(len(values), dtype=np.uint64))
    order, same = (keys & np.uint64((1 << place) - 1)).astype(np.int64), np.diff(keys >> np.uint64(place)) == 0
    out = np.full(len(values), -1)
    out[order[1:][same]] = order[:-1][same]
    return out


def _triples(flat: np.ndarray) -> np.ndarray:
    """Hashes of three pixels each, which begin at all places but the last two."""
    p = flat.astype(np.uint64)
    return p[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ p[2:] * np.uint64(0x165667B19E3779F9)


def references(flat: np.ndarray, back: np.ndarray) -> list[tuple[int, int, int]]:
    """Place, length and distance of back-references, from left to right: runs of three pixels and more that stand at the last place where their first three do (back, or -1)."""
    out, at = [], 0
    for n in np.flatnonzero(back >= 0).tolist():
        if n < at:
            continue
        q = int(back[n])
        size, step = 0, 64
        while size < 4096 and n + size < len(flat):
            a, b = flat[n + size : n + size + step], flat[q + size : q + size + step][: len(flat) - n - size]
            differ = np.flatnonzero(a[: len(b)] != b)
            size += int(differ[0]) if len(differ) else len(b)
            if len(differ) or not len(b):
                break
        size = min(size, 4096)
        if size >= 3:
            out.append((n, size, n - q))
            at = n + size
    return out


def _joined(parts: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Fields that follow one another, values and numbers of bits, as one field: 58 or 60 bits at most for a reference or a pixel."""
    value, size = parts[0]
    for v, n in parts[1:]:
        value, size = value | v << size, size + n
    return value, size


class Layout:
    """An entropy-coded image to be written, with references, a colour cache where it helps, and a code of mixed lengths for each channel. `lay_out` finds the cache's bits, the codes' lengths, and the pixels' fields as one."""

    def __init__(self, flat: np.ndarray, width: int, main: bool) -> None:
        self.flat, self.width, self.main = flat, width, main
        self.bits, self.codes, self.fields = 0, [], (0, 0)

    def write(self, w: Writer) -> None:
        w.put(1 if self.bits else 0, 1)
        if self.bits:
            w.put(self.bits, 4)
        if self.main:
            w.put(0, 1)
        for lengths in self.codes:
            write_lengths(w, lengths)
        w.put(*self.fields)


def _packed(values: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Fields of up to 63 bits that follow one another, joined to one up to each end; a field without bits has the value 0."""
    done = np.concatenate([[0], np.cumsum(sizes)])
    total = np.diff(done[np.concatenate([[0], ends])])
    words = (total >> 6) + 2
    first = np.cumsum(words) - words
    at = done[:-1] + np.repeat(64 * first - (done[ends] - total), np.diff(ends, prepend=0))
    word, shift, v = at >> 6, (at & 63).astype(np.uint64), values.astype(np.uint64)
    out = np.zeros(int(words.sum()), "<u8")
    np.add.at(out, word, v << shift)  # no bit is set twice, so sums are unions
    np.add.at(out, word + 1, v >> np.uint64(1) >> (np.uint64(63) - shift))
    return [(int.from_bytes(out[a : a + n].tobytes(), "little"), bits) for a, n, bits in zip(first.tolist(), words.tolist(), total.tolist(), strict=True)]


def lay_out(layouts: Sequence[Layout]) -> None:
    """Fills in what layouts are written with, by array operations over the pixels of all of them."""
    sizes = np.array([len(x.flat) for x in layouts])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    flat = np.concatenate([x.flat for x in layouts])
    of = np.repeat(np.arange(len(layouts)), sizes)
    triple = np.zeros(len(flat), np.uint64)
    triple[:-2] = _triples(flat)
    whole = np.arange(len(flat)) < ends[of] - 2
    triple = np.where(whole, triple + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.arange(len(flat)).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    back = np.where(whole, _before(triple, 64) - begin[of], -1)
    refs = [(a + n, size, far, k) for k, (x, a, b) in enumerate(zip(layouts, begin.tolist(), ends.tolist(), strict=True)) if b - a >= 4 for n, size, far in references(x.flat, back[a:b])]
    at, size, far, owner = np.array(refs, np.int64).reshape(-1, 4).T
    alone = np.cumsum(np.bincount(at, minlength=len(flat) + 1) - np.bincount(at + size, minlength=len(flat) + 1))[:-1] == 0

    bits = np.clip([n.bit_length() - 2 for n in sizes.tolist()], 1, 8)
    slot = (flat * np.uint32(CACHE_FACTOR) >> (32 - bits).astype(np.uint32)[of]).astype(np.int64)
    last = _before(of << 8 | slot, 8 + len(layouts).bit_length())
    hit = (last >= 0) & (flat[last] == flat) & alone
    varied = np.bincount(of, ((flat ^ flat[begin][of]) & np.uint32(0xFFFF00FF)) != 0, len(layouts)) > 0
    bits[~varied | (np.bincount(of[hit], minlength=len(layouts)) < 8)] = 0  # one channel alone costs no more than the cache
    hit &= bits[of] > 0
    plain, cached = np.flatnonzero(alone & ~hit), np.flatnonzero(hit)

    sizes_of = np.stack([280 + np.where(bits > 0, 1 << bits, 0), *np.repeat([[256], [256], [256], [40]], len(layouts), 1)], 1).ravel()
    code_ends = np.cumsum(sizes_of)
    first = (code_ends - sizes_of).reshape(-1, 5)
    near = [_near_codes(x.width) for x in layouts]
    both = np.concatenate([size, np.array([near[k].get(d, d + len(NEAR)) for d, k in zip(far.tolist(), owner.tolist(), strict=True)], np.int64)])
    (size_symbol, far_symbol), (size_extra, far_extra), (size_bits, far_bits) = (x.reshape(2, -1) for x in _split(both))
    own = _octets(flat[plain])
    pixel = [first[of[plain], k] + own[:, c] for k, c in enumerate((2, 1, 3, 0))]
    stored, length, away = first[of[cached], 0] + 280 + slot[cached], first[owner, 0] + 256 + size_symbol, first[owner, 4] + far_symbol
    lengths = mixed_lengths(np.bincount(np.concatenate([*pixel, stored, length, away]), minlength=int(code_ends[-1])), code_ends)
    words, word_bits = code_words(lengths, code_ends)
    spell = lambda symbols: (words[symbols], word_bits[symbols])
    value, count = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
    value[plain], count[plain] = _joined([spell(x) for x in pixel])
    value[cached], count[cached] = spell(stored)
    value[at], count[at] = _joined([spell(length), (size_extra, size_bits), spell(away), (far_extra, far_bits)])
    ends_of = code_ends.reshape(-1, 5).tolist()
    for x, b, a, e, fields in zip(layouts, bits.tolist(), first.tolist(), ends_of, _packed(value, count, ends), strict=True):
        x.bits, x.codes, x.fields = b, [lengths[i:j] for i, j in zip(a, e, strict=True)], fields


def _weighed(counts: np.ndarray) -> np.ndarray:
    return counts * np.log2(np.maximum(counts, 1))


#: _weighed of small counts, which most images have alone.
WEIGHED = _weighed(np.arange(1 << 14))
CHANNEL = np.arange(0, 4096, 256).reshape(4, 1, 4)


def _costs(forms: np.ndarray) -> list[float]:
    """Bits of each form (forms, pixels, 4) by the entropy of its channels."""
    k, n = forms.shape[:2]
    counts = np.bincount((forms + CHANNEL[:k]).ravel(), minlength=1024 * k).reshape(k, 1024)
    inside = WEIGHED[counts] if n < len(WEIGHED) else _weighed(counts)
    return (4 * n * np.log2(n) - inside.sum(1) + 5 * np.count_nonzero(counts, 1)).tolist()


def _subtracted(octets: np.ndarray, width: int, form: int | tuple[int, int]) -> np.ndarray:
    """What a form leaves of pixels (n, 4): green taken away, or the prediction of mode 1 (left) or 2 (above) all over the image."""
    out = octets.copy()
    if form == SUBTRACT_GREEN:
        out[:, 1::2] -= octets[:, 2:3]
        return out
    out[0, 0] = (int(octets[0, 0]) + 1) & 255  # less 255
    if form[1] == 2:
        out[1:width] -= octets[: min(width, len(out)) - 1]
        out[width:] -= octets[: max(0, len(out) - width)]
    else:
        out[1:] -= octets[:-1]
        if len(out) > width:
            out[width::width] = octets[width::width] - octets[:-width:width]
    return out


def encode(pixels: np.ndarray) -> bytes:
    """A lossless WebP file of pixels (height, width)."""
    return encode_many([pixels])[0]


def encode_many(images: Sequence[np.ndarray]) -> list[bytes]:
    """Lossless WebP files; those of one call are made together."""
    plans = [_plan(pixels) for pixels in images]
    lay_out([part for plan in plans for part in plan if isinstance(part, Layout)])
    out = []
    for pixels, plan in zip(images, plans, strict=True):
        w = Writer()
        _start(w, pixels.shape[1], pixels.shape[0])
        for part in plan:
            if isinstance(part, Layout):
                part.write(w)
            else:
                w.put(*part)
        out.append(_file(w.bytes()))
    return out


def _plan(pixels: np.ndarray) -> list[Layout | tuple[int, int]]:
    """What a file holds after its start, bit fields (value, bits) and images, in the form that the entropy of its channels says is the smallest."""
    height, width = pixels.shape
    flat = np.ascontiguousarray(pixels).ravel()
    out: list[Layout | tuple[int, int]] = []
    table = np.sort(flat)
    table = table[np.append(True, table[1:] != table[:-1])]
    octets = _octets(flat)
    kinds = [-1, SUBTRACT_GREEN, (PREDICTOR, 1), (PREDICTOR, 2)]
    shapes = np.stack([octets, *(_subtracted(octets, width, form) for form in kinds[1:])])
    forms = [(bits + more, form, left) for bits, more, form, left in zip(_costs(shapes), (0, 0, 60, 60), kinds, shapes, strict=True)]
    if len(table) <= 256:
        index = np.searchsorted(table, flat)
        steps = _octets(table).copy()
        steps[1:] -= _octets(table)[:-1]
        forms.append((_costs(steps[None])[0] + _costs(_octets(index.astype(np.uint32) << np.uint32(8))[None])[0], PALETTE, steps))
    _, form, left = min(forms, key=lambda x: x[0])
    left = flat if form == -1 else _pixels(left)
    wide = width
    if form == PALETTE:
        out += [(1 | PALETTE << 1, 3), (len(table) - 1, 8), Layout(left, len(table), False)]
        bundle = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
        wide = (width + (1 << bundle) - 1) >> bundle
        cells = np.zeros((height, wide << bundle), np.int64)
        cells[:, :width] = index.reshape(height, width)
        left = ((cells.reshape(height, wide, 1 << bundle) << ((8 >> bundle) * np.arange(1 << bundle))).sum(2).ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(BLACK)
    elif form == SUBTRACT_GREEN:
        out.append((1 | SUBTRACT_GREEN << 1, 3))
    elif form != -1:
        block = 1 << 9
        cells = ((width + block - 1) // block) * ((height + block - 1) // block)
        out += [(1 | PREDICTOR << 1, 3), (7, 3), Layout(np.full(cells, BLACK | form[1] << 8, np.uint32), (width + block - 1) // block, False)]
    return [*out, (0, 1), Layout(left, wide, True)]
