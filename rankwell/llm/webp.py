"""Lossless WebP: a decoder for the whole format, and encoders for 8-bit grey samples and for small colour images.

Follows the public specification of the WebP lossless bitstream.  Pixels are
ARGB in unsigned 32-bit arrays, in scan-line order.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache
from itertools import groupby

import numpy as np

#: Largest width and height that the header can hold.
MAX_SIDE = 1 << 14
# Fixed values of the format: order of the code-length code lengths.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The neighbours behind distance codes 1 to 120: (left, up), nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
LENGTH_CODES, DISTANCE_CODES = 24, 40
#: The farthest back-reference: its code, 120 more, fits the last distance symbol.
FARTHEST = (1 << 20) - 120
BLACK = 0xFF000000
#: The encoder's shortest match, and of its anchors, about one in so many positions.
WINDOW, ANCHORS = 24, 16


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the stream ends too early")
        return v


# ---------------------------------------------------------------- prefix codes


def _reversal(n: int) -> np.ndarray:
    """Every number of ``n`` bits with its bits in reverse order."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate((2 * out, 2 * out + 1))
    return out


REVERSED = [_reversal(n) for n in range(16)]


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols in canonical order, their lengths, and the ends of their shares of 2**15 code values."""
    used = lengths.nonzero()[0]
    used = used[lengths[used].argsort(kind="stable")]
    n = lengths[used]
    return used, n, (1 << (15 - n)).cumsum()


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Each symbol's code with its first bit lowest, as the stream holds it."""
    used, n, end = _in_order(lengths)
    codes = np.zeros(len(lengths), np.uint32)
    codes[used] = REVERSED[15][(end - (1 << (15 - n))) & 0x7FFF]
    return codes


class Prefix:
    """A prefix code as a table over ``bits`` bits of the stream: symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used, n, end = _in_order(lengths)
        self.only, self.rows = None, None
        if not len(used):
            raise ValueError("a prefix code has no symbols")
        if len(used) == 1:
            self.only, self.bits, self.table = int(used[0]), 0, used[:1].astype(np.uint32) << 4
            return
        if end[-1] != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self.bits = int(n[-1])
        self.table = (used << 4 | n).astype(np.uint32).repeat(1 << (self.bits - n))[REVERSED[self.bits]]

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        e = self.rows[bits.peek(self.bits)] if self.rows else int(self.table[bits.peek(self.bits)])
        bits.at += e & 15
        return e >> 4

    def many(self) -> Prefix:
        """For many single reads."""
        self.rows = self.table.tolist()
        return self


def _single(symbol: int) -> Prefix:
    lengths = np.zeros(symbol + 1, np.int64)
    lengths[symbol] = 1
    return Prefix(lengths)


SINGLE = [_single(s) for s in range(256)]


def read_prefix(bits: Bits, alphabet: int) -> Prefix:
    lengths = np.zeros(alphabet, np.int64)
    if bits.read(1):  # one or two symbols
        two = bits.read(1)
        symbol = bits.read(8 if bits.read(1) else 1)
        if not two:
            return SINGLE[symbol]
        lengths[[symbol, bits.read(8)]] = 1
        return Prefix(lengths)
    code = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        code[LENGTH_ORDER[i]] = bits.read(3)
    by = Prefix(code).many()
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    i, last = 0, 8
    while i < alphabet and left:
        left -= 1
        s = by.read(bits)
        if s < 16:
            lengths[i] = s
            i, last = i + 1, s or last
            continue
        n, v = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if i + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[i : i + n] = v
        i += n
    return Prefix(lengths)


def prefixed(bits: Bits, symbol: int) -> int:
    """The length or distance behind a prefix symbol and its extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


# ------------------------------------------------------------ entropy-coded images


def _read_pixels(bits: Bits, width: int, height: int, groups: list[list[Prefix]], which: np.ndarray | None, which_bits: int, cache_bits: int) -> np.ndarray:
    """Pixels one by one: any number of code groups, any codes, with colour cache."""
    n = width * height
    out = [0] * n
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift, cached = 32 - cache_bits, 0  # cached: pixels already in the cache
    across = -(-width // (1 << which_bits)) if which is not None else 0
    groups = [[c.many() for c in g] for g in groups]
    picks = which.tolist() if which is not None else None
    i, group = 0, groups[0]

    def update(upto: int) -> None:
        nonlocal cached
        for p in out[cached:upto]:
            cache[(0x1E35A7BD * p & 0xFFFFFFFF) >> shift] = p
        cached = upto

    while i < n:
        if picks is not None:
            y, x = divmod(i, width)
            group = groups[picks[(y >> which_bits) * across + (x >> which_bits)]]
        s = group[0].read(bits)
        if s < 256:
            r, b, a = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out[i] = a << 24 | r << 16 | s << 8 | b
            i += 1
        elif s < 256 + LENGTH_CODES:
            length = prefixed(bits, s - 256)
            d = distance(prefixed(bits, group[4].read(bits)), width)
            if d > i or i + length > n:
                raise ValueError("a back-reference leaves the image")
            if d >= length:
                out[i : i + length] = out[i - d : i - d + length]
            else:
                seen = out[i - d : i]
                out[i : i + length] = (seen * (length // d + 1))[:length]
            i += length
        else:
            update(i)
            out[i] = cache[s - 256 - LENGTH_CODES]
            i += 1
    return np.array(out, np.uint32)


def _read_greens(bits: Bits, n: int, width: int, group: list[Prefix]) -> np.ndarray:
    """Green values of an image in which only these and distances take bits.

    The code table is looked up at every bit position at once.  Summing code
    lengths along the chain gives jumps of eight symbols, so Python follows one
    position in eight; back-references stop a chain and are copied in turn.
    """
    green, data = group[0], bits.data
    out, have = np.empty(n, np.uint8), 0
    step, slack = 1 << 17, 64
    while have < n:
        first = bits.at >> 3
        raw = np.frombuffer(data[first : first + step + slack] + bytes(8), np.uint8).astype(np.uint32)
        words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
        e = green.table[(words[:, None] >> np.arange(8, dtype=np.uint32) & ((1 << green.bits) - 1)).ravel()]
        length = ((e & 15) * (e < 256 << 4)).astype(np.int32)
        here = np.arange(len(length), dtype=np.int32)
        one = np.minimum(here + length, len(length) - 1)
        jump = one
        for _ in range(3):
            jump = jump[jump]
        steps = (jump - here).astype(np.uint8).tobytes()
        p, end = bits.at - 8 * first, min(8 * step, len(length) - 8 * slack if len(raw) > step + slack else len(length) - 1)
        if p >= end and len(raw) <= step + slack:
            raise ValueError("the stream ends too early")
        while have < n and p < end:
            starts = []
            while p < end:
                s = steps[p]
                if not s:
                    break
                starts.append(p)
                p += s
            if starts:
                at = np.empty((len(starts), 8), np.int32)
                at[:, 0] = starts
                for k in range(1, 8):
                    at[:, k] = one[at[:, k - 1]]
                at = at.ravel()
                got = at[length[at] > 0]
                if len(got) > 1:
                    got = got[np.concatenate(([True], got[1:] != got[:-1]))]
                got = got[: n - have]
                out[have : have + len(got)] = e[got] >> 4
                have += len(got)
                if have == n:  # jumps may lead past the image
                    p = int(got[-1] + length[got[-1]])
            if have < n and p < end:  # a back-reference
                bits.at = 8 * first + p
                s = green.read(bits)
                size = prefixed(bits, s - 256)
                d = distance(prefixed(bits, group[4].read(bits)), width)
                if s < 256 or s >= 256 + LENGTH_CODES or d > have or have + size > n:
                    raise ValueError("a back-reference leaves the image")
                if d >= size:
                    out[have : have + size] = out[have - d : have - d + size]
                else:
                    out[have : have + size] = np.resize(out[have - d : have], size)
                have += size
                p = bits.at - 8 * first
        bits.at = 8 * first + p
    return out


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image (``main``: with meta prefix codes)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    which, which_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        which_bits = bits.read(3) + 2
        w, h = -(-width // (1 << which_bits)), -(-height // (1 << which_bits))
        which = read_image(bits, w, h, False) >> 8 & 0xFFFF
        n_groups = int(which.max()) + 1
    sizes = (256 + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_CODES)
    groups = [[read_prefix(bits, n) for n in sizes] for _ in range(n_groups)]
    g = groups[0]
    if which is None and not cache_bits and g[0].only is None and all(c.only is not None for c in g[1:4]) and g[0].bits:
        rest = np.uint32(g[3].only << 24 | g[1].only << 16 | g[2].only)
        return _read_greens(bits, width * height, width, g).astype(np.uint32) << 8 | rest
    if which is None and not cache_bits and all(c.only is not None for c in g[:4]) and g[0].only < 256:
        return np.full(width * height, g[3].only << 24 | g[1].only << 16 | g[0].only << 8 | g[2].only, np.uint32)
    return _read_pixels(bits, width, height, groups, which, which_bits, cache_bits)


# ------------------------------------------------------------------- transforms


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of pixels, each channel by itself."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a, b):
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _select(left: int, top: int, corner: int) -> int:
    a, t, c = _channels(left), _channels(top), _channels(corner)
    to_left = sum(abs(y - z) for y, z in zip(t, c))
    to_top = sum(abs(x - z) for x, z in zip(a, c))
    return left if to_left < to_top else top


def predict(mode: int, left: int, top: int, right: int, corner: int) -> int:
    """The prediction from the neighbours left, above, above right and above left."""
    if mode == 5:
        return _mean(_mean(left, right), top)
    if mode == 6:
        return _mean(left, corner)
    if mode == 7:
        return _mean(left, top)
    if mode == 10:
        return _mean(_mean(left, corner), _mean(top, right))
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return _join([_clamp(x + y - z) for x, y, z in zip(_channels(left), _channels(top), _channels(corner))])
    if mode == 13:
        both = _channels(_mean(left, top))
        # half of the difference, towards zero
        return _join([_clamp(m + (abs(m - z) // 2 if m >= z else -(abs(m - z) // 2))) for m, z in zip(both, _channels(corner))])
    return (BLACK, left, top, right, corner)[mode] if mode < 5 else _mean(corner, top) if mode == 8 else _mean(top, right) if mode == 9 else BLACK


def undo_predictor(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, bits: int) -> np.ndarray:
    """Adds predictions row by row; runs whose mode needs no left neighbour, or only it, go at once."""
    img = pixels.reshape(height, width).astype(np.uint32)
    across = -(-width // (1 << bits))
    modes = (modes >> 8 & 15).reshape(-1, across)
    shifts = np.array([24, 16, 8, 0], np.uint32)

    def running(start: int, row: np.ndarray) -> np.ndarray:  # prefix sums by channel
        parts = (row[:, None] >> shifts & 255).astype(np.int64)
        parts[0] += np.array(_channels(start))
        parts = (np.cumsum(parts, axis=0) & 255).astype(np.uint32)
        return (parts << shifts).sum(axis=1, dtype=np.uint32)

    if height:
        img[0] = running(BLACK, img[0])
    for y in range(1, height):
        above, row = img[y - 1], img[y]
        row[:1] = _add(row[:1], above[:1])
        after = np.append(above[1:], row[0])  # the last pixel's upper right is its own row's first
        for t in range(across):
            x0, x1 = max(1, t << bits), min(width, (t + 1) << bits)
            if x0 >= x1:
                continue
            mode = int(modes[y >> bits, t])
            if mode == 1:
                row[x0:x1] = running(int(row[x0 - 1]), row[x0:x1])
            elif mode in (0, 2, 3, 4, 8, 9, 14, 15):
                top, right, corner = above[x0:x1], after[x0:x1], above[x0 - 1 : x1 - 1]
                p = {2: top, 3: right, 4: corner}.get(mode)
                p = _mean(corner, top) if mode == 8 else _mean(top, right) if mode == 9 else np.full(x1 - x0, BLACK, np.uint32) if p is None else p
                row[x0:x1] = _add(row[x0:x1], p)
            else:
                left, tops, rights = int(row[x0 - 1]), above[x0 - 1 : x1].tolist(), after[x0:x1].tolist()
                for k, d in enumerate(row[x0:x1].tolist()):
                    p = predict(mode, left, tops[k + 1], rights[k], tops[k])
                    left = (d & 0xFF00FF00) + (p & 0xFF00FF00) & 0xFF00FF00 | (d & 0xFF00FF) + (p & 0xFF00FF) & 0xFF00FF
                    row[x0 + k] = left
    return img.ravel()


def undo_cross_colour(pixels: np.ndarray, width: int, height: int, elements: np.ndarray, bits: int) -> np.ndarray:
    across = -(-width // (1 << bits))
    e = elements.reshape(-1, across)[np.arange(height) >> bits][:, np.arange(width) >> bits].ravel()
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    delta = lambda t, c: (t * c) >> 5
    green = signed(pixels >> 8)
    red = (pixels >> 16 & 255).astype(np.int32) + delta(signed(e), green) & 255
    blue = (pixels & 255).astype(np.int32) + delta(signed(e >> 8), green) + delta(signed(e >> 16), signed(red)) & 255
    return pixels & 0xFF00FF00 | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def undo_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray, pack: int) -> np.ndarray:
    """Looks up colours; ``pack``: binary logarithm of the indices in each pixel's green."""
    index = pixels >> 8 & 255
    if pack:
        each, per = 8 >> pack, 1 << pack
        index = (index[:, None] >> np.arange(0, 8, each, dtype=np.uint32) & ((1 << each) - 1)).astype(np.uint32)
        index = index.reshape(height, -(-width // per) * per)[:, :width].ravel()
    return np.append(palette, np.zeros(256, np.uint32))[index].astype(np.uint32)


def undo_green(pixels: np.ndarray) -> np.ndarray:
    green = pixels >> 8 & 255
    return _add(pixels, green << 16 | green)


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, ARGB pixels) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or len(data) < 25 or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    bits = Bits(data[21 : 20 + struct.unpack_from("<I", data, 16)[0]])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, w = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise ValueError("a transform occurs twice")
        if kind < 2:
            size = bits.read(3) + 2
            undo.append((kind, w, read_image(bits, -(-w // (1 << size)), -(-height // (1 << size)), False), size))
        elif kind == 3:
            colours = bits.read(8) + 1
            steps = read_image(bits, colours, 1, False)
            parts = np.cumsum(steps[:, None] >> np.array([24, 16, 8, 0], np.uint32) & 255, axis=0).astype(np.uint32) & 255
            palette = parts[:, 0] << 24 | parts[:, 1] << 16 | parts[:, 2] << 8 | parts[:, 3]
            pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
            undo.append((kind, w, palette, pack))
            w = -(-w // (1 << pack))
        else:
            undo.append((kind, w, None, 0))
    pixels = read_image(bits, w, height, True)
    for kind, w, what, size in reversed(undo):
        if kind == 0:
            pixels = undo_predictor(pixels, w, height, what, size)
        elif kind == 1:
            pixels = undo_cross_colour(pixels, w, height, what, size)
        elif kind == 2:
            pixels = undo_green(pixels)
        else:
            pixels = undo_palette(pixels, w, height, what, size)
    return width, height, pixels


# ---------------------------------------------------------------------- encoder


def code_lengths(counts: np.ndarray, longest: int) -> np.ndarray:
    """Lengths of a prefix code for these counts, none over ``longest``."""
    lengths = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0].tolist()
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    weight = counts.astype(np.int64)
    while used:
        heap = [(int(weight[s]), s) for s in used]
        heapq.heapify(heap)
        above, new = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[1]] = above[b[1]] = new
            heapq.heappush(heap, (a[0] + b[0], new))
            new += 1
        depth = {new - 1: 0}
        for node in sorted(above, reverse=True):  # a parent has a higher number
            depth[node] = depth[above[node]] + 1
        lengths[used] = [depth[s] for s in used]
        if lengths.max() <= longest:
            break
        weight = np.where(weight > 0, weight // 2 + 1, 0)
    return lengths


class Writer:
    """Gathers (value, number of bits) and packs them at once."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.pending: list[tuple[int, int]] = []

    def put(self, value: int, n: int) -> None:
        self.pending.append((value, n))

    def put_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.settle()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(sizes.astype(np.int64))

    def settle(self) -> None:
        if self.pending:
            v, n = zip(*self.pending)
            self.values.append(np.array(v, np.uint64))
            self.sizes.append(np.array(n, np.int64))
            self.pending = []

    def bytes(self) -> bytes:
        self.settle()
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        if len(v) % 2:
            v, n = np.append(v, np.uint64(0)), np.append(n, 0)
        v, n = v[::2] | v[1::2] << n[::2].astype(np.uint64), n[::2] + n[1::2]  # 33 bits at most
        end = np.cumsum(n)
        at = end - n
        word, v = at >> 5, v << (at & 31).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out = np.zeros(int(word[-1]) + 3, np.uint64)
        out[word[first]] = np.bitwise_or.reduceat(v & np.uint64(0xFFFFFFFF), first)
        out[word[first] + 1] |= np.bitwise_or.reduceat(v >> np.uint64(32), first)
        return out.astype("<u4").tobytes()[: (int(end[-1]) + 7) // 8]


def _put_single(w: Writer, symbol: int) -> None:
    wide = symbol > 1
    w.put(1 | wide << 2 | symbol << 3, 3 + (8 if wide else 1))


def put_prefix(w: Writer, lengths: np.ndarray) -> None:
    """Writes a code; one of a single symbol takes no bits later."""
    used = lengths.nonzero()[0]
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        _put_single(w, int(used[0]) if len(used) else 0)
        return
    if len(used) == 2 and used[1] < 256:
        wide = used[0] > 1
        w.put(3 | int(wide) << 2, 3)
        w.put(int(used[0]), 8 if wide else 1)
        w.put(int(used[1]), 8)
        return
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of it
    last = 8
    for v, run in groupby(lengths[: int(used[-1]) + 1].tolist()):
        n = len(list(run))
        if v == 0:
            while n >= 11:
                k = min(n, 138)
                tokens.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
            tokens += [(0, 0, 0)] * n
        else:
            if v != last:
                tokens.append((v, 0, 0))
                last, n = v, n - 1
            while n >= 3:
                k = min(n, 6)
                tokens.append((16, k - 3, 2))
                n -= k
            tokens += [(v, 0, 0)] * n
    counts = np.bincount([t[0] for t in tokens], minlength=19)
    code = code_lengths(counts, 7)
    codes = canonical(code)
    single = np.count_nonzero(code) == 1
    shown = max(4, 1 + max(i for i, s in enumerate(LENGTH_ORDER) if code[s]))
    w.put(0, 1)
    w.put(shown - 4, 4)
    for s in LENGTH_ORDER[:shown]:
        w.put(int(code[s]), 3)
    size = max(2, (len(tokens) - 2).bit_length() + (len(tokens) - 2).bit_length() % 2)
    w.put(1 | (size - 2) // 2 << 1, 4)
    w.put(len(tokens) - 2, size)
    for s, extra, n in tokens:
        w.put(int(codes[s]), 0 if single else int(code[s]))
        w.put(extra, n)


def _split(value: int) -> tuple[int, int, int]:
    """A length or distance as (prefix symbol, extra, bits of it)."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = (value - 1) >> (top - 1) & 1
    return 2 * top + second, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def find_matches(a: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of repeats of WINDOW values or more, FARTHEST back at most, left to right.

    Windows whose hash falls in one of ANCHORS classes are sorted; equal
    neighbours are extended both ways.
    """
    n = len(a)
    if n <= WINDOW:
        return []
    raw = np.concatenate((a, np.zeros(8, np.uint8)))
    eight = np.ndarray((n,), "<u8", raw.tobytes(), 0, (1,))
    m = n - WINDOW + 1
    key = eight[:m] * np.uint64(0x9E3779B97F4A7C15) + eight[8 : m + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + eight[16 : m + 16] * np.uint64(0x165667B19E3779F9)
    at = np.flatnonzero(key >> np.uint64(58) < 64 // ANCHORS)
    if len(at) < 2:
        return []
    key = key[at]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return []
    pairs = sorted(zip(at[order[1:][same]].tolist(), at[order[:-1][same]].tolist()))
    out, done = [], 0
    for p, q in pairs:
        d = p - q
        if p < done or d > FARTHEST:
            continue
        back = min(q, p - done, 256)
        if back:
            differs = np.flatnonzero(a[p - back : p] != a[q - back : q])
            back = back - 1 - int(differs[-1]) if len(differs) else back
        p -= back
        most = min(4096, n - p)
        differs = a[p : p + most] != a[p - d : p - d + most]
        length = int(differs.argmax()) if differs.any() else most
        if length >= WINDOW:
            out.append((p, length, d))
            done = p + length
    return out


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """Distances that have a short code."""
    return {max(1, x + y * width): c for c, (x, y) in reversed(list(enumerate(NEAR, 1)))}


def _put_image(w: Writer, green: np.ndarray, width: int, matches: list[tuple[int, int, int]], rest: tuple[np.ndarray, ...] | None, main: bool) -> None:
    """An entropy-coded image; without ``rest`` (red, blue, alpha) only green takes bits."""
    w.put(0, 2 if main else 1)  # no colour cache, no meta prefix codes
    near = _near_codes(width) if matches else {}
    pairs = [(s, _split(n), _split(near.get(d, d + 120)), n) for s, n, d in matches]
    kept = np.ones(len(green), bool)
    for s, _, _, n in pairs:
        kept[s : s + n] = False
    counts = np.bincount(green[kept], minlength=256 + LENGTH_CODES)
    far = np.zeros(DISTANCE_CODES, np.int64)
    for _, length, dist, _ in pairs:
        counts[256 + length[0]] += 1
        far[dist[0]] += 1
    codes = []
    for c in (counts, *(np.bincount(r[kept], minlength=256) for r in rest or ()), *([] if rest else [None] * 3), far):
        if c is None:
            _put_single(w, 0)
            continue
        lengths = code_lengths(c, 15)
        put_prefix(w, lengths)
        one = np.count_nonzero(lengths) == 1 and lengths.argmax() < 256
        codes.append((canonical(lengths), np.zeros_like(lengths) if one else lengths))
    (gc, gl), (dc, dl) = codes[0], codes[-1]
    at = 0
    for s, length, dist, n in [*pairs, (len(green), None, None, 0)]:
        if s > at:
            part = [(gc[green[at:s]], gl[green[at:s]])] + [(c[r[at:s]], k[r[at:s]]) for (c, k), r in zip(codes[1:4], rest or ())]
            if rest:
                part = [tuple(np.stack(x, axis=1).ravel() for x in zip(*part))]
            w.put_all(*part[0])
        if length:
            w.put(int(gc[256 + length[0]]), int(gl[256 + length[0]]))
            w.put(length[1], length[2])
            w.put(int(dc[dist[0]]), int(dl[dist[0]]))
            w.put(dist[1], dist[2])
        at = s + n


@lru_cache(maxsize=4096)
def _palette(greys: tuple[int, ...], listed: bool) -> tuple[np.ndarray, np.ndarray]:
    """The palette transform's values and sizes; ``greys``: all, or the first and how many."""
    present = np.array(greys) if listed else np.arange(greys[0], greys[0] + greys[1])
    w = Writer()
    w.put(1 | 3 << 1, 3)
    w.put(len(present) - 1, 8)
    steps = np.diff(present, prepend=0)
    alpha = np.zeros(len(present), np.int64)
    alpha[0] = 255
    same = [] if listed else [(2, len(present) - 2, 1)]
    _put_image(w, steps, len(present), same, (steps, steps, alpha), False)
    w.settle()
    return np.concatenate(w.values), np.concatenate(w.sizes)


def encode_grey(samples: np.ndarray, width: int) -> bytes:
    """A file whose pixels are grey with these samples, as a palette image."""
    height = len(samples) // width
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE or width * height != len(samples):
        raise ValueError("the samples do not fill an image")
    present = np.bincount(samples, minlength=256).nonzero()[0]
    if len(present) > 16:  # a range of greys: its palette is a first value and steps of one
        present = np.arange(present[0], present[-1] + 1)
    number = np.zeros(256, np.uint8)
    number[present] = np.arange(len(present))
    index = number[samples]
    pack = 3 if len(present) <= 2 else 2 if len(present) <= 4 else 1 if len(present) <= 16 else 0
    across = width
    if pack:
        each, per = 8 >> pack, 1 << pack
        across = -(-width // per)
        padded = np.zeros((height, across * per), np.uint8)
        padded[:, :width] = index.reshape(height, width)
        index = (padded.reshape(-1, per) << np.arange(0, 8, each, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    w.put_all(*_palette(tuple(present.tolist()) if len(present) <= 16 else (int(present[0]), len(present)), len(present) <= 16))
    w.put(0, 1)  # no more transforms
    matches = find_matches(index)
    end = matches[-1][0] + matches[-1][1] if matches else 0
    tail = len(index) - 1 - int(np.flatnonzero(np.append(True, index[1:] != index[:-1]))[-1])
    if tail >= WINDOW and len(index) - tail >= end:  # what pads the payload is a run
        start = len(index) - tail
        matches += [(s, min(4096, len(index) - s), 1) for s in range(start, len(index), 4096)]
    _put_image(w, index, across, matches, None, True)
    return _file(w)


#: The colour encoder's tiles have 2**TILE pixels a side, its colour cache 2**CACHE places.
TILE, CACHE = 2, 4
#: Multipliers that it tries, in 32nds.
MULTIPLIERS = np.arange(-32, 33, 8)


def predictions(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What each of the 14 modes predicts, from arrays of channels (alpha, red, green, blue in the last axis)."""
    mean = lambda a, b: a + b >> 1
    to_left, to_top = abs(top - corner).sum(-1, keepdims=True), abs(left - corner).sum(-1, keepdims=True)
    both = mean(left, top)
    half = both - corner
    half = np.where(half >= 0, half // 2, -(-half // 2))
    black = np.broadcast_to(np.array([255, 0, 0, 0]), left.shape)
    return np.stack([
        black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), both, mean(corner, top), mean(top, right),
        mean(mean(left, corner), mean(top, right)), np.where(to_left < to_top, left, top), np.clip(left + top - corner, 0, 255), np.clip(both + half, 0, 255),
    ])


def _signed(v: np.ndarray) -> np.ndarray:
    return (v + 128 & 255) - 128


def _tiles(v: np.ndarray, side: int) -> np.ndarray:
    """Sums of the last two axes over tiles."""
    v = np.add.reduceat(v, np.arange(0, v.shape[-2], side), axis=-2)
    return np.add.reduceat(v, np.arange(0, v.shape[-1], side), axis=-1)


def _spread(v: np.ndarray, height: int, width: int, bits: int) -> np.ndarray:
    """A value a tile as a value a pixel."""
    return v[np.arange(height) >> bits][:, np.arange(width) >> bits]


def less_predicted(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, modes): channels (height, width, 4) less each tile's best prediction; ties to the lower mode."""
    height, width = c.shape[:2]
    left, top, corner, right = (np.zeros_like(c) for _ in range(4))
    left[:, 1:], top[1:], corner[1:, 1:] = c[:, :-1], c[:-1], c[:-1, :-1]
    right[1:, :-1], right[1:, -1] = c[:-1, 1:], c[1:, 0]
    rest = c - predictions(left, top, right, corner) & 255
    rest[:, 0], rest[:, :, 0] = c[0] - left[0] & 255, c[:, 0] - top[:, 0] & 255  # the borders have no choice
    rest[:, 0, 0] = c[0, 0] - np.array([255, 0, 0, 0]) & 255
    modes = _tiles(abs(_signed(rest)).sum(-1), 1 << bits).argmin(0)
    return np.take_along_axis(rest, _spread(modes, height, width, bits)[None, ..., None], 0)[0], modes


def less_crossed(c: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(channels, elements): red less a share of green, blue less shares of green and red, by each tile's best multipliers."""
    height, width = c.shape[:2]
    red, green, blue = c[..., 1], _signed(c[..., 2]), c[..., 3]
    order = MULTIPLIERS[np.argsort(abs(MULTIPLIERS), kind="stable")]  # ties to the smallest

    def best(value: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        tried = value - (order[:, None, None] * by >> 5) & 255
        pick = _tiles(abs(_signed(tried)), 1 << bits).argmin(0)
        return np.take_along_axis(tried, _spread(pick, height, width, bits)[None], 0)[0], order[pick] & 255

    new_red, to_red = best(red, green)
    new_blue, to_blue = best(blue, green)
    new_blue, red_to_blue = best(new_blue, _signed(red))
    return np.stack([c[..., 0], new_red, c[..., 2], new_blue], axis=-1), red_to_blue << 16 | to_blue << 8 | to_red


def _put_cached(w: Writer, pixels: np.ndarray, cache_bits: int) -> None:
    """An entropy-coded main image with a colour cache: a pixel that it holds is its place, others are literal."""
    w.put(1 | cache_bits << 1, 5)
    w.put(0, 1)  # no meta prefix codes
    slots = ((pixels.astype(np.uint64) * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)).astype(np.int64)
    cache, green = [0] * (1 << cache_bits), (pixels >> 8 & 255).astype(np.int64)
    held = np.zeros(len(pixels), bool)
    for i, (p, k) in enumerate(zip(pixels.tolist(), slots.tolist())):
        held[i] = cache[k] == p
        cache[k] = p
    green[held] = 256 + LENGTH_CODES + slots[held]
    literal = ~held
    parts = [green] + [(pixels >> s & 255).astype(np.int64) for s in (16, 0, 24)]
    values, sizes = [], []
    for k, v in enumerate(parts):
        counts = np.bincount(v if not k else v[literal], minlength=256 if k else 256 + LENGTH_CODES + (1 << cache_bits))
        lengths = code_lengths(counts, 15) if counts.any() else counts
        put_prefix(w, lengths)
        taken = np.zeros_like(lengths) if np.count_nonzero(lengths) <= 1 else lengths
        values.append(canonical(lengths)[v])
        sizes.append(np.where(literal, taken[v], 0) if k else taken[v])
    _put_single(w, 0)  # no distances
    values = np.where(np.stack(sizes, axis=1) > 0, np.stack(values, axis=1), 0)
    w.put_all(values.ravel(), np.stack(sizes, axis=1).ravel())


def encode_colour(samples: np.ndarray, width: int) -> bytes:
    """A file whose opaque pixels hold three samples each (red, green, blue), by predictor, cross-colour and colour cache.

    For small images: its literals are read back one by one.
    """
    height = len(samples) // (3 * width)
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE or 3 * width * height != len(samples):
        raise ValueError("the samples do not fill an image")
    c = np.full((height, width, 4), 255, np.int64)
    c[..., 1:] = samples.reshape(height, width, 3)
    c, modes = less_predicted(c, TILE)
    c, elements = less_crossed(c, TILE)
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(0, 4)  # no alpha, version 0
    w.put(1 | 0 << 1 | TILE - 2 << 3, 6)
    _put_image(w, modes.ravel(), modes.shape[1], [], None, False)
    w.put(1 | 1 << 1 | TILE - 2 << 3, 6)
    e = elements.ravel()
    _put_image(w, e >> 8 & 255, elements.shape[1], [], (e >> 16 & 255, e & 255, np.full(len(e), 255)), False)
    w.put(0, 1)  # no more transforms
    _put_cached(w, (c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]).astype(np.uint32).ravel(), CACHE)
    return _file(w)


def _file(w: Writer) -> bytes:
    body = b"\x2f" + w.bytes()
    body += bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body
