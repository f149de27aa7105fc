"""Lossless WebP: a whole decoder, and an encoder that keeps byte payloads in its pixels.

Method (decoding): prefix codes, back-references and colour cache give pixels; predictor, cross-colour,
subtract-green and palette transforms are inverted in reverse order; pixel arrays come out.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 16384
#: Fixed value: the order in which the lengths of the code length code are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 short distance codes: neighbours to the left and above, nearest first, then by how far aside, right before left.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
_CACHE_MIX = 0x1E35A7BD


class WebPError(ValueError):
    """The bytes are no lossless WebP image that the format allows."""


# ---------------------------------------------------------------- reading


class _Bits:
    """Bits of a byte string, lowest first, read up to 32 at a time."""

    def __init__(self, data: bytes):
        self.size = 8 * len(data)
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
        n = len(data) + 4
        three = raw[:n] | raw[1 : n + 1] << 8 | raw[2 : n + 2] << 16
        self.window = memoryview(((three[:, None] >> np.arange(8, dtype=np.uint32)) & 0xFFFF).astype(np.uint16).reshape(-1))
        self.at = 0

    def read(self, n: int) -> int:
        value, got = 0, 0
        while got < n:
            step = min(16, n - got)
            value |= (self.window[self.at] & ((1 << step) - 1)) << got
            self.at += step
            got += step
        if self.at > self.size:
            raise WebPError("the stream ends too early")
        return value


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words of the lengths, bits reversed so that the first bit read is the lowest."""
    out, code = np.zeros(len(lengths), np.int64), 0
    for size in range(1, 16):
        code <<= 1
        for symbol in np.flatnonzero(lengths == size).tolist():
            out[symbol] = int(format(code, f"0{size}b")[::-1], 2)
            code += 1
    return out


class PrefixCode:
    """A code as tables over windows of 16 bits: symbol and length, and runs of literals for fast walks."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if not len(used):
            raise WebPError("a code without symbols")
        if self.only is not None:
            return
        if int((1 << (15 - lengths[used].astype(np.int64))).sum()) != 1 << 15:
            raise WebPError("a code that isn't complete")
        symbols, sizes = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int8)
        for symbol, word in zip(used.tolist(), _canonical(lengths)[used].tolist(), strict=True):
            step = 1 << int(lengths[symbol])
            symbols[word::step] = symbol
            sizes[word::step] = lengths[symbol]
        self._symbols, self._sizes = symbols, sizes
        self.symbol, self.size = symbols.tolist(), sizes.tolist()
        self._runs: tuple[list[bytes], list[int]] | None = None

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        w = bits.window[bits.at] if bits.at < len(bits.window) else 0
        bits.at += self.size[w]
        if bits.at > bits.size:
            raise WebPError("the stream ends too early")
        return self.symbol[w]

    def runs(self) -> tuple[list[bytes], list[int]]:
        """For each window the literals below 256 that it holds whole, up to six, and their bits in all."""
        if self._runs is None:
            window = np.arange(1 << 16)
            taken, alive = np.zeros(1 << 16, np.int64), np.ones(1 << 16, bool)
            text, count = np.zeros((1 << 16, 6), np.uint8), np.zeros(1 << 16, np.int64)
            for k in range(6):
                rest = window >> taken
                symbol, size = self._symbols[rest], self._sizes[rest].astype(np.int64)
                alive &= (taken + size <= 16) & (symbol < 256)
                text[alive, k] = symbol[alive]
                taken[alive] += size[alive]
                count[alive] += 1
            flat = text.tobytes()
            self._runs = [flat[6 * i : 6 * i + n] for i, n in enumerate(count.tolist())], taken.tolist()
        return self._runs


@lru_cache(maxsize=64)
def _code(lengths: bytes) -> PrefixCode:
    return PrefixCode(np.frombuffer(lengths, np.uint8))


def _read_code(bits: _Bits, alphabet: int) -> PrefixCode:
    lengths = np.zeros(alphabet, np.uint8)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= alphabet:
            raise WebPError("a symbol beyond its alphabet")
        lengths[symbols] = 1
        return _code(lengths.tobytes())
    first = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        first[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = _code(first.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
            continue
        value, n = (previous, 3 + bits.read(2)) if symbol == 16 else (0, 3 + bits.read(3)) if symbol == 17 else (0, 11 + bits.read(7))
        if at + n > alphabet:
            raise WebPError("code lengths beyond the alphabet")
        lengths[at : at + n] = value
        at += n
    return _code(lengths.tobytes())


def _read_value(bits: _Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_pixels(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image: colour cache, prefix code groups, then literals, back-references and cache hits."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("a colour cache of more than 2^11")
    cache_size = 1 << cache_bits if cache_bits else 0
    groups_of, tile_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        tile_bits = bits.read(3) + 2
        tiles_x = (width + (1 << tile_bits) - 1) >> tile_bits
        tiles_y = (height + (1 << tile_bits) - 1) >> tile_bits
        meta = (_read_pixels(bits, tiles_x, tiles_y, False) >> 8) & 0xFFFF
        n_groups, groups_of = int(meta.max()) + 1, meta.reshape(-1).tolist()
    groups = [[_read_code(bits, n) for n in (280 + cache_size, 256, 256, 256, 40)] for _ in range(n_groups)]
    total = width * height
    flat = groups[0]
    if main and n_groups == 1 and not cache_size and flat[0].only is None and all(c.only is not None for c in flat[1:4]):
        green = _walk_green(bits, flat, width, total)
        constant = flat[3].only << 24 | flat[1].only << 16 | flat[2].only
        return (green.astype(np.uint32) << np.uint32(8) | np.uint32(constant)).reshape(height, width)
    out, cache = [0] * total, [0] * cache_size
    shift, at, cached = 32 - cache_bits, 0, 0

    def remember(until: int) -> None:
        nonlocal cached
        if cache_size:
            for argb in out[cached:until]:
                cache[(_CACHE_MIX * argb & 0xFFFFFFFF) >> shift] = argb
        cached = until

    while at < total:
        group = groups[groups_of[(at // width >> tile_bits) * tiles_x + (at % width >> tile_bits)]] if groups_of else flat
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 280:
            n = _read_value(bits, symbol - 256)
            back = _distance(_read_value(bits, group[4].read(bits)), width)
            if back > at or at + n > total:
                raise WebPError("a back-reference beyond the image")
            for k in range(at, at + n):
                out[k] = out[k - back]
            at += n
        else:
            remember(at)
            out[at] = cache[symbol - 280]
            at += 1
    return np.array(out, np.uint32).reshape(height, width)


def _walk_green(bits: _Bits, group: list[PrefixCode], width: int, total: int) -> np.ndarray:
    """Pixels that differ in green alone: several literals at each step along the windows. Nothing follows them in a file."""
    chunks, taken = group[0].runs()
    window, at, end = bits.window, bits.at, bits.size
    out = bytearray()
    while len(out) < total:
        if at >= end:
            raise WebPError("the stream ends too early")
        w = window[at]
        n = taken[w]
        if n:
            out += chunks[w]
            at += n
            continue
        bits.at = at
        run = _read_value(bits, group[0].read(bits) - 256)
        back = _distance(_read_value(bits, group[4].read(bits)), width)
        at = bits.at
        if back > len(out) or len(out) + run > total:
            raise WebPError("a back-reference beyond the image")
        out += (bytes(out[-back:]) * (run // back + 1))[:run]
    return np.frombuffer(bytes(out[:total]), np.uint8)


# ---------------------------------------------------------------- transforms


def _channels(argb: np.ndarray) -> np.ndarray:
    """(height, width, 4) bytes: blue, green, red, alpha."""
    return np.ascontiguousarray(argb, "<u4").view(np.uint8).reshape(*argb.shape, 4)


def _argb(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").reshape(channels.shape[:2]).astype(np.uint32)


def _mean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _select(left: np.ndarray, top: np.ndarray, corner: np.ndarray) -> np.ndarray:
    to_left, to_top = np.abs(top - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
    return np.where(to_left < to_top, left, top)


def _half(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.clip(a + (np.abs(d) // 2) * np.sign(d), 0, 255)


#: The fourteen predictions from left, top, top right and top left, as ints.
PREDICTIONS = (
    lambda l, t, tr, tl: np.broadcast_to(np.array([0, 0, 0, 255]), l.shape),  # noqa: E741
    lambda l, t, tr, tl: l,  # noqa: E741
    lambda l, t, tr, tl: t,  # noqa: E741
    lambda l, t, tr, tl: tr,  # noqa: E741
    lambda l, t, tr, tl: tl,  # noqa: E741
    lambda l, t, tr, tl: _mean(_mean(l, tr), t),  # noqa: E741
    lambda l, t, tr, tl: _mean(l, tl),  # noqa: E741
    lambda l, t, tr, tl: _mean(l, t),  # noqa: E741
    lambda l, t, tr, tl: _mean(tl, t),  # noqa: E741
    lambda l, t, tr, tl: _mean(t, tr),  # noqa: E741
    lambda l, t, tr, tl: _mean(_mean(l, tl), _mean(t, tr)),  # noqa: E741
    lambda l, t, tr, tl: _select(l, t, tl),  # noqa: E741
    lambda l, t, tr, tl: np.clip(l + t - tl, 0, 255),  # noqa: E741
    lambda l, t, tr, tl: _half(_mean(l, t), tl),  # noqa: E741
)
_NEEDS_LEFT = {1, 5, 6, 7, 10, 11, 12, 13}


def _spread(small: np.ndarray, bits: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(small, 1 << bits, 0), 1 << bits, 1)[:height, :width]


def undo_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from residuals; a row's pixels that don't look left are done at once, others one after the other."""
    x = _channels(argb).astype(np.int64)
    height, width = argb.shape
    mode = _spread((modes >> 8) & 0xF, bits, height, width)
    x[0, 0] = (x[0, 0] + [0, 0, 0, 255]) & 255
    x[0] = np.cumsum(x[0], axis=0) & 255
    for r in range(1, height):
        row, up = x[r], x[r - 1]
        row[0] = (row[0] + up[0]) & 255
        right = np.concatenate([up[1:], row[:1]])
        corner = np.concatenate([up[:1], up[:-1]])
        for m in set(mode[r, 1:].tolist()) - _NEEDS_LEFT:
            at = np.flatnonzero(mode[r] == m)
            at = at[at > 0]
            p = PREDICTIONS[m if m < 14 else 0](row[at], up[at], right[at], corner[at])
            row[at] = (row[at] + p) & 255
        for c in np.flatnonzero(np.isin(mode[r], list(_NEEDS_LEFT))).tolist():
            if c:
                row[c] = (row[c] + PREDICTIONS[mode[r, c]](row[c - 1], up[c], right[c], corner[c])) & 255
    return _argb(x)


def do_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Residuals of pixels: all of it at once, as every neighbour is known."""
    x = _channels(argb).astype(np.int64)
    height, width = argb.shape
    mode = _spread((modes >> 8) & 0xF, bits, height, width)
    left, top = np.roll(x, 1, 1), np.roll(x, 1, 0)
    corner = np.roll(left, 1, 0)
    right = np.roll(top, -1, 1)
    right[1:, -1] = x[1:, 0]
    guess = np.zeros_like(x)
    for m in set(mode.reshape(-1).tolist()):
        guess = np.where((mode == m)[..., None], PREDICTIONS[m if m < 14 else 0](left, top, right, corner), guess)
    guess[:, 0], guess[0] = top[:, 0], left[0]
    guess[0, 0] = [0, 0, 0, 255]
    return _argb((x - guess) & 255)


def _cross(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.int8).astype(np.int64) * c.astype(np.uint8).astype(np.int8).astype(np.int64)) >> 5


def cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Red and blue with what green and red say about them added (undo) or taken off."""
    x = _channels(argb).astype(np.int64)
    e = _channels(_spread(elements, bits, *argb.shape))
    sign = 1 if undo else -1
    before = x[..., 2].copy()
    x[..., 2] = (before + sign * _cross(e[..., 0], x[..., 1])) & 255
    red = x[..., 2] if undo else before
    x[..., 0] = (x[..., 0] + sign * (_cross(e[..., 1], x[..., 1]) + _cross(e[..., 2], red))) & 255
    return _argb(x)


def subtract_green(argb: np.ndarray, undo: bool) -> np.ndarray:
    x = _channels(argb).astype(np.int64)
    x[..., [0, 2]] = (x[..., [0, 2]] + (1 if undo else -1) * x[..., 1:2]) & 255
    return _argb(x)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(argb: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    """Colours from indices bundled into green; indices beyond the table are transparent black."""
    bundle = _bundle_bits(len(table))
    index = (argb >> 8) & 0xFF
    if bundle:
        each = 8 >> bundle
        steps = np.arange(1 << bundle, dtype=np.uint32) * np.uint32(each)
        index = ((index[..., None] >> steps) & ((1 << each) - 1)).reshape(len(argb), -1)[:, :width]
    return np.r_[table, np.zeros(256, np.uint32)][index].astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """A (height, width) array of ARGB pixels as uint32 from a whole lossless WebP file."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise WebPError("no lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = _Bits(data[20 : 20 + size])
    if bits.read(8) != SIGNATURE:
        raise WebPError("no signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("an unknown version")
    undo, seen, wide = [], set(), width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            small = _read_pixels(bits, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False)
            undo.append((lambda a, s=small, t=tile: undo_predictor(a, s, t)) if kind == PREDICTOR else (lambda a, s=small, t=tile: cross_colour(a, s, t, True)))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda a: subtract_green(a, True))
        else:
            steps = _channels(_read_pixels(bits, bits.read(8) + 1, 1, False)).astype(np.int64)
            table = _argb(np.cumsum(steps, axis=1) & 255)[0]
            undo.append(lambda a, t=table, w=width: undo_palette(a, t, w))
            bundle = _bundle_bits(len(table))
            width = (width + (1 << bundle) - 1) >> bundle
    argb = _read_pixels(bits, width, height, True)
    for step in reversed(undo):
        argb = step(argb)
    assert argb.shape == (height, wide)
    return argb


# ---------------------------------------------------------------- writing


class _Writer:
    """Values with their numbers of bits, packed lowest bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def put(self, value: int, bits: int) -> None:
        self.values.append(np.array([value], np.uint64))
        self.sizes.append(np.array([bits], np.int64))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def bytes(self) -> bytes:
        return pack_bits(np.concatenate(self.values), np.concatenate(self.sizes))


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """Values of up to 33 bits each, one after the other."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1] + 7) >> 3 if len(ends) else 0
    at, moved = starts >> 3, values << (starts & 7).astype(np.uint64)
    out = np.zeros(n + 8)
    for k in range(5):
        some = sizes + (starts & 7) > 8 * k if k > 2 else slice(None)
        part = (moved[some] >> np.uint64(8 * k)) & np.uint64(255)
        if len(part):
            out += np.bincount(at[some] + k, part.astype(float), n + 8)[: n + 8]
    return out[:n].astype(np.uint8).tobytes()


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman lengths of the symbols with a count, none over ``limit``: counts are levelled until it holds."""
    counts = counts.astype(np.int64)
    used = np.flatnonzero(counts).tolist()
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    least = 1
    while True:
        heap = [(max(int(counts[s]), least), i, (s,)) for i, s in enumerate(used)]
        heapq.heapify(heap)
        out[:] = 0
        tie = len(used)
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            both = x + y
            out[list(both)] += 1
            heapq.heappush(heap, (a + b, tie, both))
            tie += 1
        if out.max() <= limit:
            return out
        least = max(2 * least, int(counts.sum()) >> 14)


def _put_code(w: _Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths).tolist()
    if len(used) <= 2 and max(used, default=0) < 256:
        symbols = used or [0]
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        wide = symbols[0] > 1
        w.put(int(wide), 1)
        w.put(symbols[0], 8 if wide else 1)
        if len(symbols) == 2:
            w.put(symbols[1], 8)
        return
    tokens, at, values = [], 0, lengths.tolist()
    while at < len(values):
        run = 1
        while at + run < len(values) and values[at + run] == values[at]:
            run += 1
        if values[at] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run < 11 else (18, run - 11, 7))
        elif values[at] and run >= 4:
            run = min(run, 7)
            tokens.append((values[at], 0, 0))
            tokens.append((16, run - 4, 2))
        else:
            run = 1
            tokens.append((values[at], 0, 0))
        at += run
    first = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    words = _canonical(first)
    w.put(0, 1)
    n = max(4, 1 + max(k for k, s in enumerate(CODE_LENGTH_ORDER) if first[s]))
    w.put(n - 4, 4)
    for k in range(n):
        w.put(int(first[CODE_LENGTH_ORDER[k]]), 3)
    w.put(0, 1)
    single = np.count_nonzero(first) == 1
    for symbol, extra, bits in tokens:
        if not single:
            w.put(int(words[symbol]), int(first[symbol]))
        if bits:
            w.put(extra, bits)


def _as_prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = (v >> (high - 1)) & 1
    return 2 * high + second, v & ((1 << (high - 1)) - 1), high - 1


def _tokens(flat: list[int], width: int, cache_bits: int) -> list[tuple]:
    """Literals, runs copied from the pixel before or the row above, and colour cache hits."""
    out, at, n = [], 0, len(flat)
    cache, shift = [0] * (1 << cache_bits if cache_bits else 0), 32 - cache_bits

    def seen(argb: int) -> None:
        if cache_bits:
            cache[(_CACHE_MIX * argb & 0xFFFFFFFF) >> shift] = argb

    while at < n:
        best, back = 0, 0
        for d in (1, width):
            if d <= at:
                run = 0
                while at + run < n and run < 4096 and flat[at + run] == flat[at + run - d]:
                    run += 1
                if run > best:
                    best, back = run, d
        if best >= 4:
            code = 1 + NEAR.index((1, 0)) if back == 1 else 1 + NEAR.index((0, 1))
            out.append(("copy", at, best, code))
            for argb in flat[at : at + best]:
                seen(argb)
            at += best
            continue
        slot = (_CACHE_MIX * flat[at] & 0xFFFFFFFF) >> shift if cache_bits else 0
        out.append(("hit", at, slot) if cache_bits and cache[slot] == flat[at] and flat[at] else ("pixel", at, flat[at]))
        seen(flat[at])
        at += 1
    return out


def _put_pixels(w: _Writer, argb: np.ndarray, main: bool, cache_bits: int = 0, tile_bits: int = 0) -> None:
    """An entropy-coded image with Huffman codes of its own; ``tile_bits`` gives two groups of codes by tiles."""
    height, width = argb.shape
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    group_of = lambda at: 0
    groups = 1
    if main:
        w.put(int(tile_bits > 0), 1)
        if tile_bits:
            w.put(tile_bits - 2, 3)
            tx, ty = (width + (1 << tile_bits) - 1) >> tile_bits, (height + (1 << tile_bits) - 1) >> tile_bits
            meta = (np.add.outer(np.arange(ty), np.arange(tx)) % 2).astype(np.uint32)
            groups = int(meta.max()) + 1
            _put_pixels(w, meta << np.uint32(8), False)
            group_of = lambda at: int(meta[at // width >> tile_bits, at % width >> tile_bits])
    tokens = _tokens(argb.reshape(-1).tolist(), width, cache_bits)
    parts: list[tuple[int, list[tuple[int, int, int, int]]]] = []
    for token in tokens:
        g = group_of(token[1])
        if token[0] == "pixel":
            v = token[2]
            parts.append((g, [(0, v >> 8 & 255, 0, 0), (1, v >> 16 & 255, 0, 0), (2, v & 255, 0, 0), (3, v >> 24, 0, 0)]))
        elif token[0] == "copy":
            size, far = _as_prefix(token[2]), _as_prefix(token[3])
            parts.append((g, [(0, 256 + size[0], *size[1:]), (4, far[0], *far[1:])]))
        else:
            parts.append((g, [(0, 280 + token[2], 0, 0)]))
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[np.zeros(n, np.int64) for n in sizes] for _ in range(groups)]
    for g, items in parts:
        for k, symbol, _, _ in items:
            counts[g][k][symbol] += 1
    lengths = [[code_lengths(c) for c in group] for group in counts]
    words = [[_canonical(x) for x in group] for group in lengths]
    for group in lengths:
        for x in group:
            _put_code(w, x)
    for g, items in parts:
        for k, symbol, extra, bits in items:
            if np.count_nonzero(lengths[g][k]) > 1:
                w.put(int(words[g][k][symbol]), int(lengths[g][k][symbol]))
            if bits:
                w.put(extra, bits)


def _file(stream: bytes) -> bytes:
    padded = stream + b"\0" * (len(stream) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(stream)) + padded


def _head(w: _Writer, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise WebPError(f"sides must be 1 to {MAX_SIDE}")
    w.put(SIGNATURE, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(argb: np.ndarray, transforms: tuple = (), cache_bits: int = 0, tile_bits: int = 0) -> bytes:
    """A lossless WebP file of ARGB pixels.

    ``transforms`` has, in order, ("predictor", modes, bits), ("cross", elements, bits), ("green",) and
    ("palette",), as the format allows them; a palette needs at most 256 colours.
    """
    w = _Writer()
    _head(w, argb.shape[1], argb.shape[0])
    for name, *args in transforms:
        w.put(1, 1)
        w.put({"predictor": PREDICTOR, "cross": CROSS_COLOUR, "green": SUBTRACT_GREEN, "palette": PALETTE}[name], 2)
        if name in ("predictor", "cross"):
            w.put(args[1] - 2, 3)
            _put_pixels(w, args[0], False)
            argb = do_predictor(argb, *args) if name == "predictor" else cross_colour(argb, *args, undo=False)
        elif name == "green":
            argb = subtract_green(argb, False)
        else:
            table, index = np.unique(argb, return_inverse=True)
            if len(table) > 256:
                raise WebPError("more than 256 colours")
            w.put(len(table) - 1, 8)
            steps = _channels(table[None, :].astype(np.uint32)).astype(np.int64)
            steps[:, 1:] = (steps[:, 1:] - steps[:, :-1]) & 255
            _put_pixels(w, _argb(steps & 255), False)
            bundle = _bundle_bits(len(table))
            index = index.reshape(argb.shape)
            index = np.pad(index, ((0, 0), (0, -index.shape[1] % (1 << bundle))))
            shifts = np.arange(1 << bundle) * (8 >> bundle)
            packed = (index.reshape(len(index), -1, 1 << bundle) << shifts).sum(axis=2)
            argb = (packed.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    w.put(0, 1)
    _put_pixels(w, argb, True, cache_bits, tile_bits)
    return _file(w.bytes())


# ---------------------------------------------------------------- payloads


@lru_cache(maxsize=1)
def _text_profile() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(values, sizes) of the start of a stream for text, and its green words and lengths.

    The code is Huffman's over a plain rule of how frequent bytes are in texts; it is stored in every image.
    """
    weight = np.ones(280)
    weight[32:127] = 60
    weight[ord("A") : ord("Z") + 1] = 150
    weight[ord("a") : ord("z") + 1] = 1500
    for k, c in enumerate("zqxjkvbpygfwmucldrhsinoate"):
        weight[ord(c)] = 300 * 1.14**k * 2
    weight[32], weight[10], weight[ord(".")], weight[ord(",")] = 24_000, 700, 1300, 1000
    weight[0x80:0xC0], weight[0xC2:0xF5], weight[0xC3] = 60, 20, 1800
    weight[256:280] = 20
    lengths = code_lengths(weight.astype(np.int64))
    w = _Writer()
    w.put(0, 1)  # no transform
    w.put(0, 1)  # no colour cache
    w.put(0, 1)  # one group of codes
    _put_code(w, lengths)
    for symbol, n in ((0, 256), (0, 256), (255, 256), (NEAR.index((1, 0)), 40)):
        one = np.zeros(n, np.uint8)
        one[symbol] = 1
        _put_code(w, one)
    return np.concatenate(w.values), np.concatenate(w.sizes), _canonical(lengths).astype(np.uint64), lengths.astype(np.int64)


def _runs_of(raw: np.ndarray, least: int = 6) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of one byte, after its first, that are worth a copy; at most 4096 long each."""
    cuts = np.r_[0, np.flatnonzero(raw[1:] != raw[:-1]) + 1, len(raw)]
    size = np.diff(cuts)
    for k in np.flatnonzero(size > least).tolist():
        start, n = int(cuts[k]) + 1, int(size[k]) - 1
        while n > 0:
            yield start, min(n, 4096)
            start, n = start + 4096, n - 4096


def encode_payload(payload: bytes) -> bytes:
    """A file whose green samples, row by row, are the payload and then bytes 0xFF, which UTF-8 never has.

    Rows have 64 samples; payloads over 64 * 16384 bytes get wider rows. Payloads of up to 4,096 bytes with up to 16
    different ones use the palette transform, which bundles samples; all others the text code and copies of runs.
    """
    width = 64 * max(1, -(-len(payload) // (64 * MAX_SIDE)))
    if width > MAX_SIDE:
        raise WebPError("a payload over 256 MiB")
    raw = np.frombuffer(payload + b"\xff" * (-len(payload) % width), np.uint8)
    height = len(raw) // width
    if len(raw) <= 4096 and len(np.unique(raw)) <= 16:
        return encode((raw.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)).reshape(height, width), (("palette",),))
    head = _Writer()
    _head(head, width, height)
    values, sizes, words, lengths = _text_profile()
    code, bits = words[raw], lengths[raw]
    runs = list(_runs_of(raw))
    if runs:
        keep = np.ones(len(raw), bool)
        for start, n in runs:
            symbol, extra, more = _as_prefix(n)
            code[start] = int(words[256 + symbol]) | extra << int(lengths[256 + symbol])
            bits[start] = lengths[256 + symbol] + more
            keep[start + 1 : start + n] = False
        code, bits = code[keep], bits[keep]
    head.put_all(values, sizes)
    head.put_all(code, bits)
    return _file(head.bytes())


def decode_payload(media: bytes) -> tuple[bytes, np.ndarray]:
    """(payload, ARGB pixels) of a file made by ``encode_payload``."""
    argb = decode(media)
    return ((argb >> 8) & 0xFF).astype(np.uint8).tobytes().rstrip(b"\xff"), argb
