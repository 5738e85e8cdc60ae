"""Lossless WebP (the public VP8L bitstream): a decoder for all of it, and an encoder for what the media column stores.

Fixed values below are those of the published format: code length order, distance map, predictor modes.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np

SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
DISTANCE_MAP = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_MULTIPLIER = 0x1E35A7BD


class Bits:
    """Reads bits, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0

    def read(self, n: int) -> int:
        at = self.pos >> 3
        value = int.from_bytes(self.data[at : at + (n + 14 >> 3)], "little") >> (self.pos & 7)
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the bitstream ends early")
        return value & (1 << n) - 1


    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 4], "little") >> (self.pos & 7) & (1 << n) - 1

    def skip(self, n: int) -> None:
        self.pos += n
        if self.pos > 8 * len(self.data):
            raise ValueError("the bitstream ends early")


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, code: tuple[int, int]) -> None:
        """A prefix code: (bits as they follow in the stream, count)."""
        self.put(*code)

    def bits(self) -> np.ndarray:
        raw = self.value.to_bytes((self.n + 7) // 8, "little")
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.n]


@functools.lru_cache(4096)
def codes_of(lengths: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code with its first bit lowest, length)."""
    return codes_of(tuple(lengths))


@functools.lru_cache(1024)
def lookup(lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of every value of as many bits as the longest code has: the symbol that stands at its low end, and its length."""
    most = max(lengths)
    symbols, sizes = np.zeros(1 << most, np.int32), np.zeros(1 << most, np.int32)
    for s, (code, n) in codes_of(lengths).items():
        symbols[code :: 1 << n], sizes[code :: 1 << n] = s, n
    return symbols, sizes


class Prefix:
    """A prefix code for reading; ``single`` is the symbol of a code that takes no bits; ``even`` is (k, symbols) of one whose 2**k symbols all have k bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None if used else 0
        widths = {lengths[s] for s in used}
        k = 0 if self.single is not None else min(widths)
        self.even = (k, np.array(used or [0], np.uint32)) if len(widths) <= 1 and len(used or [0]) == 1 << k else None
        if self.single is None:
            if sum(2 ** (15 - lengths[s]) for s in used) != 2**15:
                raise ValueError("not a complete prefix code")
        self.lengths = lengths

    @functools.cached_property
    def codes(self) -> dict[tuple[int, int], int]:
        """Made when a code is read bit by bit; even ones seldom are."""
        return {(n, c): s for s, (c, n) in canonical(self.lengths).items()}

    @functools.cached_property
    def short(self) -> tuple[int, list[tuple[int, int]]] | None:
        """Symbol and length by the next bits, of codes of up to eight."""
        most = max(self.lengths)
        if most > 8:
            return None
        symbols, sizes = lookup(tuple(self.lengths))
        return most, list(zip(symbols.tolist(), sizes.tolist(), strict=True))

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self.short is not None:
            most, table = self.short
            s, n = table[bits.peek(most)]
            bits.skip(n)
            return s
        code = 0
        for n in range(1, 16):
            code |= bits.read(1) << n - 1
            if (s := self.codes.get((n, code))) is not None:
                return s
        raise ValueError("no such prefix code")


@functools.lru_cache(4096)
def simple(size: int, *symbols: int) -> Prefix:
    """A code of one or two symbols; most codes are such, and few of them differ."""
    lengths = [0] * size
    for s in symbols:
        lengths[s] = 1
    return Prefix(lengths)


def read_prefix(bits: Bits, size: int) -> Prefix:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return simple(size, first, bits.read(8)) if two else simple(size, first)
    lengths = [0] * size
    order = [0] * 19
    for i in range(bits.read(4) + 4):
        order[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Prefix(order)
    tokens = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, last = 0, 8
    while at < size and tokens:
        tokens -= 1
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
            continue
        n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if at + n > size:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    return Prefix(lengths)


def extended(symbol: int, bits: Bits) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    """How far back a distance code points: the first 120 to near pixels in two dimensions."""
    if code > 120:
        return code - 120
    x, y = DISTANCE_MAP[code - 1]
    return max(1, x + y * width)


WINDOW = 1 << 21


def read_greens(bits: Bits, total: int, width: int, green: Prefix, far: Prefix) -> np.ndarray:
    """Pixels of which only green takes bits: literals and back-references, read many at a time.

    What stands at a bit is looked up for all bits of a window that a code can start at, which also says where the next
    code starts. These steps are doubled (to 2, 4, ... 32 codes) by following them once more, so that one in 32 codes is
    found by walking and the others from it. A back-reference ends a walk; the next one starts behind it.
    """
    if green.single is not None:
        if green.single > 255:
            raise ValueError("a back-reference leaves the image")
        return np.full(total, green.single, np.uint8)
    symbols, lengths = lookup(tuple(green.lengths))
    most = max(green.lengths)
    # codes start at multiples of a common step from the last back-reference on; after many of those, anywhere
    step, odd = math.gcd(*green.lengths), 0
    data = np.frombuffer(bits.data + b"\0" * 4, np.uint8)
    out, at, end = np.empty(total, np.uint8), 0, 8 * len(bits.data)
    while at < total:
        base = bits.pos
        count = -(-min(WINDOW, end - base) // step)
        if count <= 0:
            raise ValueError("the bitstream ends early")
        low, high = base >> 3, base + step * count >> 3
        part = data[low : high + 4].astype(np.uint32)
        word = part[:-3] | part[1:-2] << np.uint32(8) | part[2:-1] << np.uint32(16) if len(part) > 3 else np.zeros(1, np.uint32)
        place = np.arange(base & 7, (base & 7) + step * count, step, dtype=np.int32)
        seen = word[np.minimum(place >> 3, len(word) - 1)] >> (place & 7).astype(np.uint32) & np.uint32((1 << most) - 1)
        symbol, size = symbols[seen], lengths[seen] // step
        halt = symbol >= 256
        one = np.arange(count + 1, dtype=np.int32)
        one[:-1] += np.where(halt, 0, size)
        np.minimum(one, count, out=one)
        jumps = [one]
        for _ in range(5):
            jumps.append(jumps[-1][jumps[-1]])
        here = 0
        while at < total and here < count:
            walk, far_jump, i = [here], jumps[5], here
            while (j := int(far_jump[i])) != i and j < count and 32 * len(walk) < total - at:
                walk.append(j)
                i = j
            places = np.array(walk, np.int32)
            for jump in jumps[4::-1]:
                places = np.stack([places, jump[places]], 1).ravel()
            good = (places < count) & ~halt[np.minimum(places, count - 1)]
            n = min(total - at, len(good) if good.all() else int(good.argmin()))
            out[at : at + n] = symbol[places[:n]]
            at += n
            if n:
                bits.pos = base + step * int(places[n - 1] + size[places[n - 1]])
            here = (bits.pos - base) // step
            if at < total and here < count and halt[here]:
                bits.pos += step * int(size[here])
                length = extended(int(symbol[here]) - 256, bits)
                d = distance(extended(far.read(bits), bits), width)
                if d > at or at + length > total:
                    raise ValueError("a back-reference leaves the image")
                out[at : at + length] = np.resize(out[at - d : at], length) if d < length else out[at - d : at - d + length]
                at += length
                if (bits.pos - base) % step:
                    odd += 1
                    step = step if odd < 8 else 1
                    break
                here = (bits.pos - base) // step
        if bits.pos > end:
            raise ValueError("the bitstream ends early")
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB: literals, back-references and colour cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    tile, which, groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width // (1 << tile))
        which = read_image(bits, across, -(-height // (1 << tile)), False) >> 8 & 0xFFFF
        groups = int(which.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_prefix(bits, n) for n in sizes] for _ in range(groups)]
    total = width * height
    green, red, blue, alpha, far = codes[0]
    evens = [c.even for c in (green, red, blue, alpha)]
    if groups == 1 and not cache_bits and None not in evens and evens[0][1].max() < 256:
        # every pixel has as many bits, so all of them are cut at once
        each = sum(k for k, _ in evens)
        raw = np.frombuffer(bits.data, np.uint8, offset=bits.pos >> 3)
        line = np.unpackbits(raw, count=min(8 * len(raw), (bits.pos & 7) + each * total), bitorder="little")[bits.pos & 7 :]
        if len(line) < each * total:
            raise ValueError("the bitstream ends early")
        bits.pos += each * total
        line, at, pixels = line.reshape(total, each), 0, np.zeros(total, np.uint32)
        for (k, symbols), shift in zip(evens, (8, 16, 0, 24), strict=True):
            if k:
                wide = np.zeros((total, 8), np.uint8)
                wide[:, 8 - k :] = line[:, at : at + k]
                pixels |= symbols[np.packbits(wide, axis=1)[:, 0]] << np.uint32(shift)
            else:
                pixels |= symbols[0] << np.uint32(shift)
            at += k
        return pixels
    if groups == 1 and not cache_bits and None not in (red.single, blue.single, alpha.single):
        return read_greens(bits, total, width, green, far).astype(np.uint32) << np.uint32(8) | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
    out = [0] * total
    cache = [0] * (1 << cache_bits)
    at = cached = 0

    def catch_up(to: int, since: int) -> None:
        for p in out[since:to]:
            cache[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> 32 - cache_bits] = p

    while at < total:
        if which is not None:
            y, x = divmod(at, width)
            green, red, blue, alpha, far = codes[int(which[(y >> tile) * across + (x >> tile)])]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            n = extended(s - 256, bits)
            d = distance(extended(far.read(bits), bits), width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for i in range(at, at + n):
                out[i] = out[i - d]
            at += n
        else:
            if cache_bits:
                catch_up(at, cached)
                cached = at
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def channels(pixels: np.ndarray) -> np.ndarray:
    """ARGB words to an array (..., 4) of int32 in the order A, R, G, B."""
    return np.stack([(pixels >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int32)


def words(parts: np.ndarray) -> np.ndarray:
    a, r, g, b = (parts[..., i].astype(np.uint32) for i in range(4))
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def predicted(mode: int, left, top, top_right, top_left):
    """One pixel's prediction from its four known neighbours, by the mode's rule."""
    mean = lambda a, b: a + b >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0], np.int32)
    if mode == 11:
        return left if np.abs(top - top_left).sum() < np.abs(left - top_left).sum() else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        return np.clip(m + np.trunc((m - top_left) / 2).astype(np.int32), 0, 255)
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top),
        8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right)),
    }[mode]()


def predict(pixels: np.ndarray, width: int, modes: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """Adds (inverse) or takes away (forward) each pixel's prediction; modes by tile of 2**tile pixels."""
    height = len(pixels) // width
    seen = channels(pixels).reshape(height, width, 4)
    made = seen.copy()
    known = seen if forward else made
    across = -(-width // (1 << tile))
    flat = known.reshape(-1, 4)
    black = np.array([255, 0, 0, 0], np.int32)
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if y == 0:
                guess = black if x == 0 else known[0, x - 1]
            elif x == 0:
                guess = known[y - 1, 0]
            else:  # the pixel after the row above's last one is this row's first
                guess = predicted(int(modes[(y >> tile) * across + (x >> tile)]), known[y, x - 1], known[y - 1, x], flat[i - width + 1], known[y - 1, x - 1])
            made[y, x] = (seen[y, x] - guess if forward else seen[y, x] + guess) & 255
    return words(made.reshape(-1, 4))


def cross_color(pixels: np.ndarray, width: int, elements: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """Adds or takes away what red and blue share with green, and blue with red, by each tile's multipliers."""
    height = len(pixels) // width
    parts = channels(pixels).reshape(height, width, 4)
    signed = lambda v: (v & 255 ^ 128) - 128
    grid = channels(elements).reshape(-1, -(-width // (1 << tile)), 4)
    grid = grid.repeat(1 << tile, 0).repeat(1 << tile, 1)[:height, :width]
    red_to_blue, green_to_blue, green_to_red = (signed(grid[..., i]) for i in (1, 2, 3))
    delta = lambda m, c: m * signed(c) >> 5
    sign, red = -1 if forward else 1, parts[..., 1]
    new_red = red + sign * delta(green_to_red, parts[..., 2]) & 255
    known_red = red if forward else new_red
    blue = parts[..., 3] + sign * (delta(green_to_blue, parts[..., 2]) + delta(red_to_blue, known_red))
    return words(np.stack([parts[..., 0], new_red, parts[..., 2], blue & 255], -1).reshape(-1, 4))


def add_green(pixels: np.ndarray) -> np.ndarray:
    parts = channels(pixels)
    parts[..., 1] = parts[..., 1] + parts[..., 2] & 255
    parts[..., 3] = parts[..., 3] + parts[..., 2] & 255
    return words(parts)


def per_word(colors: int) -> int:
    """log2 of the pixels that share a green value in palette images of few colours."""
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def from_palette(pixels: np.ndarray, width: int, palette: np.ndarray) -> np.ndarray:
    shift = per_word(len(palette))
    index = (pixels >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if shift:
        bits = 8 >> shift
        rows = index.reshape(-1, -(-width // (1 << shift)))
        index = np.stack([rows >> bits * i & (1 << bits) - 1 for i in range(1 << shift)], -1).reshape(len(rows), -1)[:, :width].ravel()
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index]


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, uint32 ARGB pixels) of a WebP file with one lossless image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while data[at : at + 4] != b"VP8L":
        if at + 8 > end:
            raise ValueError("no lossless image")
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != SIGNATURE:
        raise ValueError("wrong signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise ValueError("unknown version")
    undo, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.read(3) + 2
            grid = read_image(bits, -(-coded // (1 << tile)), -(-height // (1 << tile)), False)
            undo.append((kind, coded, grid, tile))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            palette = words(np.cumsum(channels(read_image(bits, n, 1, False)), axis=0) & 255)
            undo.append((kind, coded, palette, 0))
            coded = -(-coded // (1 << per_word(n)))
        else:
            undo.append((kind, coded, None, 0))
    pixels = read_image(bits, coded, height, True)
    for kind, w, more, tile in reversed(undo):
        if kind == PREDICTOR:
            pixels = predict(pixels, w, more >> np.uint32(8) & np.uint32(15), tile, False)
        elif kind == CROSS_COLOR:
            pixels = cross_color(pixels, w, more, tile, False)
        elif kind == PALETTE:
            pixels = from_palette(pixels, w, more)
        else:
            pixels = add_green(pixels)
    return width, height, pixels


def put_single(w: Writer, symbol: int) -> None:
    w.put(0b101 if symbol > 1 else 0b001, 3)
    w.put(symbol, 8 if symbol > 1 else 1)


def put_flat(w: Writer, k: int) -> None:
    """A code of which the first 2**k symbols have k bits each; k = 0: symbol 0, no bits."""
    if not k:
        return put_single(w, 0)
    place = CODE_LENGTH_ORDER.index(k)
    w.put(0, 1)
    w.put(max(0, place - 3), 4)
    w.put(1 << 3 * place, 3 * max(4, place + 1))
    w.put(1, 1)  # as many code lengths follow, each without bits, as there are symbols
    n = (1 << k) - 2
    half = max(0, (n.bit_length() - 1) // 2)
    w.put(half, 3)
    w.put(n, 2 + 2 * half)
    return None


def container(bits: np.ndarray) -> bytes:
    body = np.packbits(bits, bitorder="little").tobytes()
    pad = body + b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + pad


def header(w: Writer, width: int, height: int) -> None:
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)


def huffman(counts: dict[int, int], size: int) -> list[int]:
    """Code lengths of a few symbols; a lone one gets a companion, so that the code is complete."""
    heap = [(n, s, [s]) for s, n in counts.items()]
    if len(heap) == 1:
        heap.append((0, -1, [0 if heap[0][1] else 1]))
    heapq.heapify(heap)
    lengths = [0] * size
    while len(heap) > 1:
        n, s, a = heapq.heappop(heap)
        m, _, b = heapq.heappop(heap)
        for x in a + b:
            lengths[x] += 1
        heapq.heappush(heap, (n + m, s, a + b))
    return lengths


def put_lengths(w: Writer, lengths: list[int]) -> None:
    """A prefix code by its lengths, runs of which are told by repeats."""
    out, i, last = [], 0, 8
    size = max(s for s, n in enumerate(lengths) if n) + 1
    while i < size:
        v, run = lengths[i], 1
        while i + run < size and lengths[i + run] == v:
            run += 1
        i += run
        if v and v != last:
            out.append((v, 0, 0))
            run, last = run - 1, v
        while run >= 3:
            top, first, kind, width = (138, 11, 18, 7) if not v and run >= 11 else (10, 3, 17, 3) if not v else (6, 3, 16, 2)
            n = min(run, top)
            out.append((kind, n - first, width))
            run -= n
        out += [(v, 0, 0)] * run
    counts: dict[int, int] = {}
    for s, _, _ in out:
        counts[s] = counts.get(s, 0) + 1
    own = huffman(counts, 19)
    codes, many = canonical(own), max(4, 1 + max(i for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    w.put(0, 1)
    w.put(many - 4, 4)
    for s in CODE_LENGTH_ORDER[:many]:
        w.put(own[s], 3)
    n = max(2, len(out))
    half = max(0, ((n - 2).bit_length() - 1) // 2)
    w.put(1, 1)
    w.put(half, 3)
    w.put(n - 2, 2 + 2 * half)
    for s, extra, width in out + [(0, 0, 0)] * (n - len(out)):
        w.code(codes[s])
        w.put(extra, width)


def parted(value: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance, how many extra bits, and these."""
    if value <= 4:
        return value - 1, 0, 0
    k = (value - 1).bit_length() - 2
    return 2 * k + 2 + (value - 1 >> k & 1), k, value - 1 & (1 << k) - 1


SHORTEST, LONGEST = 24, 4096
#: Distances have 40 prefix symbols: the farthest that they spell, less the 120 that name near places.
FARTHEST = (1 << 20) - 120


def repeats(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of lines that stood before, no farther than the format's distances reach, and of the zeros at the end."""
    out, seen, at = [], {}, 0
    raw = samples.tobytes()
    for line in raw.split(b"\n"):
        if len(line) >= SHORTEST:
            before = seen.get(line)
            if before is not None and at - before <= FARTHEST:
                out += [(at + i, min(LONGEST, len(line) - i), at - before) for i in range(0, len(line), LONGEST)]
            seen[line] = at
        at += len(line) + 1
    zeros = len(raw) - len(raw.rstrip(b"\0"))
    if zeros > 8:
        first = len(raw) - zeros + 1
        out += [(i, min(LONGEST, len(raw) - i), 1) for i in range(first, len(raw), LONGEST)]
    return [x for x in out if x[1] > 3]


def spell(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits of numbers of so many bits each, the lowest first."""
    sizes = sizes.astype(np.int64)
    which = np.repeat(np.arange(len(sizes)), sizes)
    return (values[which] >> (np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) & 1).astype(np.uint8)


def by_frequency(counts: np.ndarray, lengths_used: list[int]) -> list[int]:
    """Code lengths of 280 symbols, of which the first ``len(counts)`` occur, the most frequent first: as many as fit have four bits, all others eight."""
    n = len(counts) + len(lengths_used)
    k = min(len(counts), max(0, (256 - n) // 15))
    lengths = [0] * 280
    for s in [*range(256 - 15 * k - len(lengths_used)), *lengths_used]:
        lengths[s] = 4 if s < k else 8
    return lengths


def encode_samples(samples: np.ndarray, width: int) -> bytes:
    """A file of 8-bit samples (rows of ``width``), each the green value of a pixel, under a palette of those that occur, the most frequent first.

    Up to sixteen values share bytes (two, four or eight pixels each). Of more, frequent ones have codes of four bits and
    the others of eight; lines that stood before and the zeros at the end are back-references. Where this would not be
    shorter, a sample takes as many bits as numbering the palette needs. Other transforms and a colour cache, which the
    reader takes, don't shorten what has one channel and no neighbours alike.
    """
    height = len(samples) // width
    counts = np.bincount(samples, minlength=256)
    colors = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    place = np.zeros(256, np.uint8)
    place[colors] = np.arange(len(colors))
    index = place[samples]
    w = Writer()
    header(w, width, height)
    w.put(1 | PALETTE << 1, 3)
    w.put(len(colors) - 1, 8)
    w.put(0, 1)  # the palette's image: no colour cache; differences of green, alpha 255 at first
    put_flat(w, 8)
    put_single(w, 0)
    put_single(w, 0)
    if len(colors) > 1:
        w.put(0b011, 3)  # two symbols, 0 and 255
        w.put(0, 1)
        w.put(255, 8)
    else:
        put_single(w, 255)
    put_single(w, 0)
    for i, difference in enumerate((np.diff(np.r_[0, colors]) & 255).tolist()):
        w.put(int(f"{difference:08b}"[::-1], 2), 8)
        if len(colors) > 1:
            w.put(int(i == 0), 1)
    shift = per_word(len(colors))
    if shift:
        bits = 8 >> shift
        rows = index.reshape(height, width)
        rows = np.pad(rows, ((0, 0), (0, -width % (1 << shift)))).reshape(height, -1, 1 << shift)
        index = (rows << (bits * np.arange(1 << shift)).astype(np.uint8)).sum(-1, dtype=np.uint8).ravel()
    k = 8 if shift else max(1, int(len(colors) - 1).bit_length())
    w.put(0, 3)  # no more transforms, no colour cache, one group of codes
    if not shift and (coded := prefixed(index, samples, len(colors))) is not None and len(coded[1]) < k * len(index):
        put_lengths(w, coded[0])
        for symbol in (0, 0, 0):
            put_single(w, symbol)
        put_far(w, coded[2])
        return container(np.r_[w.bits(), coded[1]])
    put_flat(w, k)
    for symbol in (0, 0, 0, 0):
        put_single(w, symbol)
    return container(np.r_[w.bits(), np.unpackbits(index[:, None], axis=1)[:, 8 - k :].ravel()])


def far_lengths(used: list[int]) -> list[int]:
    return huffman(dict.fromkeys(used, 1), 40)


def put_far(w: Writer, used: list[int]) -> None:
    if len(used) < 2:
        put_single(w, used[0] if used else 0)
    else:
        put_lengths(w, far_lengths(used))


def prefixed(index: np.ndarray, samples: np.ndarray, colors: int) -> tuple[list[int], np.ndarray, list[int]] | None:
    """Code lengths, the pixels' bits, and the distances' prefix symbols; nothing where there are too many colours for shorter codes."""
    refs = repeats(samples)
    parts = [(parted(n), parted(d + 120 if d > 1 else 2)) for _, n, d in refs]
    used, far = sorted({256 + a[0] for a, _ in parts}), sorted({b[0] for _, b in parts})
    if colors + len(used) > 241:
        return None
    plain = np.ones(len(index), bool)
    for at, n, _ in refs:
        plain[at : at + n] = False
    lengths = by_frequency(np.bincount(index, minlength=colors), used)
    codes = canonical(lengths)
    of = np.array([codes.get(s, (0, 0)) for s in range(280)], np.int64)
    literals = np.flatnonzero(plain)
    values, sizes = of[index[literals]].T
    if refs:
        own = canonical(far_lengths(far)) if len(far) > 1 else {far[0]: (0, 0)}
        fields = [f for (a, b) in parts for f in (tuple(of[256 + a[0]]), (a[2], a[1]), own[b[0]], (b[2], b[1]))]
        where = np.repeat(np.searchsorted(literals, [at for at, _, _ in refs]), 4)
        values, sizes = (np.insert(x, where, [f[i] for f in fields]) for i, x in enumerate((values, sizes)))
    return lengths, spell(values, sizes), far


def decode_samples(data: bytes) -> np.ndarray:
    _, _, pixels = decode(data)
    return (pixels >> np.uint32(8) & np.uint32(255)).astype(np.uint8)
