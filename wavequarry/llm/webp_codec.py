"""Lossless WebP in NumPy: a full decoder, and an encoder that can use each of the format's tools.

Pixels are ``uint32`` arrays of shape (height, width), as 0xAARRGGBB.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 1 << 14
LENGTHS, DISTANCES = 24, 40
_MAX_COPY = 4096
_FARTHEST = (1 << 20) - len(NEAR)


class WebPError(ValueError):
    """The bytes are not a lossless WebP image that can be read."""


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        p = self.at
        self.at = p + n
        if self.at > self.end:
            raise WebPError("truncated")
        return int.from_bytes(self.data[p >> 3:(p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        p = self.at
        return int.from_bytes(self.data[p >> 3:(p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)


class PrefixCode:
    """A canonical prefix code; ``table[next bits]`` is symbol * 16 + length."""

    _cache: dict[bytes, tuple[np.ndarray, int]] = {}

    def __init__(self, lengths: np.ndarray, only: int | None = None):
        self.only = only
        if only is not None:
            self.bits, self.table = 0, np.array([only * 16], np.int32)
            return
        key = lengths.tobytes()
        if key not in self._cache:
            if len(self._cache) > 64:
                self._cache.clear()
            self._cache[key] = _code_table(lengths)
        self.table, self.bits = self._cache[key]

    def next(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.bits)])
        if entry < 0:
            raise WebPError("no such code")
        bits.at += entry & 15
        return entry >> 4


@lru_cache
def _reversal(bits: int) -> np.ndarray:
    """Numbers of so many bits, read the other way round."""
    k, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for b in range(bits):
        out |= (k >> b & 1) << (bits - 1 - b)
    return out


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Used symbols by code length, the share of the code space each takes, in units of the longest code, and that one's bits."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    longest = int(lengths[order[-1]])
    return order, np.left_shift(1, longest - lengths[order].astype(np.int64)), longest


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes as they are written: bit-reversed canonical codes."""
    out = np.zeros(len(lengths), np.int64)
    if lengths.any():
        order, shares, longest = _in_order(lengths)
        out[order] = _reversal(longest)[np.cumsum(shares) - shares]
    return out


def _code_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    if not lengths.any():
        raise WebPError("empty code")
    order, shares, longest = _in_order(lengths)
    if int(shares.sum()) != 1 << longest:
        if len(order) > 1:
            raise WebPError("incomplete code")
        shares = np.array([1 << longest])
    entries = (order * 16 + lengths[order]).astype(np.int32)
    return np.repeat(entries, shares)[_reversal(longest)], longest


# ---- reading ----


def _read_code(bits: Bits, size: int) -> PrefixCode:
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return PrefixCode(None, first)
        lengths = np.zeros(max(size, 256), np.uint8)
        lengths[[first, bits.read(8)]] = 1
        if lengths.sum() < 2:
            return PrefixCode(None, first)
        return PrefixCode(lengths)
    inner = np.zeros(19, np.uint8)
    for k in range(4 + bits.read(4)):
        inner[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = _from_lengths(inner)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # at most fourteen bits a length: they are all taken into one number, whose low bits come next
    ahead = int.from_bytes(bits.data[bits.at >> 3:(bits.at >> 3) + 2 * size + 2], "little") >> (bits.at & 7)
    room, used = 8 * (len(bits.data) - (bits.at >> 3)) - (bits.at & 7), 0
    table, mask = (None, 0) if code.only is not None else (code.table.tolist(), (1 << code.bits) - 1)
    lengths, last = [], 8
    while len(lengths) < size and left:
        left -= 1
        if table is None:
            s = code.only
        else:
            entry = table[ahead & mask]
            if entry < 0:
                raise WebPError("no such code")
            s, n = entry >> 4, entry & 15
            ahead >>= n
            used += n
        if s < 16:
            lengths.append(s)
            last = s or last
            continue
        n, least, value = ((2, 3, last), (3, 3, 0), (7, 11, 0))[s - 16]
        lengths += [value] * (least + (ahead & ((1 << n) - 1)))
        ahead >>= n
        used += n
    if used > room:
        raise WebPError("truncated")
    if len(lengths) > size:
        raise WebPError("code lengths run over")
    bits.at += used
    return _from_lengths(np.array(lengths + [0] * (size - len(lengths)), np.uint8))


def _from_lengths(lengths: np.ndarray) -> PrefixCode:
    used = np.flatnonzero(lengths)
    return PrefixCode(None, int(used[0])) if len(used) == 1 else PrefixCode(lengths)


def _value(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_image(bits: Bits, width: int, height: int, top: bool = False) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("colour cache too large")
    meta, meta_bits, groups = None, 0, 1
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_read_image(bits, -(-width // (1 << meta_bits)), -(-height // (1 << meta_bits))) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    codes = [[_read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.only is not None for c in codes[0][1:4]):
        return _read_one_channel(bits, codes[0], width, height)
    return _read_any(bits, codes, meta, meta_bits, cache_bits, width, height)


def _read_any(bits: Bits, codes, meta, meta_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    """Pixel after pixel: several code groups, colour cache, all channels."""
    n, out, k = width * height, [0] * (width * height), 0
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    while k < n:
        group = codes[int(meta[k // width >> meta_bits, k % width >> meta_bits])] if meta is not None else codes[0]
        s = group[0].next(bits)
        if s < 256:
            r, b, a = group[1].next(bits), group[2].next(bits), group[3].next(bits)
            run = [a << 24 | r << 16 | s << 8 | b]
        elif s < 256 + LENGTHS:
            length = _value(bits, s - 256)
            far = _distance(_value(bits, group[4].next(bits)), width)
            if far > k or k + length > n:
                raise WebPError("copy from outside")
            run = out[k - far:min(k, k - far + length)]
            while len(run) < length:
                run += run[:length - len(run)]
        else:
            run = [cache[s - 256 - LENGTHS]]
        out[k:k + len(run)] = run
        k += len(run)
        if cache_bits:
            for p in run:
                cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
    return np.array(out, np.uint32).reshape(height, width)


def _read_one_channel(bits: Bits, codes, width: int, height: int) -> np.ndarray:
    """Only green varies: all bit positions are looked up at once, then the chain of tokens is followed."""
    n = width * height
    green, rest = codes[0], np.uint32(codes[3].only << 24 | codes[1].only << 16 | codes[2].only)
    if green.only is not None and green.only < 256:
        return np.full((height, width), rest | np.uint32(green.only << 8), np.uint32)
    raw = np.frombuffer(bits.data, np.uint8, offset=bits.at >> 3)
    first, span = bits.at & 7, 8 * len(raw)
    wide = np.zeros(len(raw) + 8, np.uint32)
    wide[:len(raw)] = raw
    words = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24)
    mask = np.uint32((1 << green.bits) - 1)
    entry = green.table.take(((words[:len(raw), None] >> np.arange(8, dtype=np.uint32)) & mask).ravel())
    step = entry & 15
    copies = np.flatnonzero(entry >= 4096)  # symbols from 256 on
    lengths_of = far_of = None
    if len(copies):
        def take(at, count):
            at = np.minimum(at, span - 1)
            return (words[at >> 3] >> (at & 7).astype(np.uint32)).astype(np.int64) & ((1 << count) - 1)

        def value(prefix, at):
            extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
            return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + take(at, extra) + 1), at + extra

        own = entry.take(copies)
        lengths_of, at = value((own >> 4).astype(np.int64) - 256, copies + (own & 15))
        found = codes[4].table[take(at, codes[4].bits)].astype(np.int64)
        at = at + (found & 15)
        far_of, at = value(np.maximum(found >> 4, 0), at)
        step[copies] = at - copies
    if not step.all():
        raise WebPError("a token without bits")
    follow = np.arange(span, dtype=np.int32)
    follow += step
    starts = _chain(np.minimum(follow, span, out=follow), first, span)
    symbols, run = entry.take(starts) >> 4, None
    if lengths_of is not None:
        which = np.flatnonzero(symbols >= 256)
        run = np.ones(len(starts), np.int64)
        run[which] = lengths_of.take(np.searchsorted(copies, starts.take(which)))
    stops = None if run is None else np.cumsum(run)
    total = len(starts) if run is None else int(stops[-1])
    if total < n:
        raise WebPError("truncated")
    starts = starts[: n if run is None else int(np.searchsorted(stops, n)) + 1]
    p = int(starts[-1] + step[starts[-1]])
    if p > span:
        raise WebPError("truncated")
    if (entry[starts] < 0).any():
        raise WebPError("no such code")
    bits.at += p - first
    s = symbols[:len(starts)]
    out = np.empty(n, np.uint8)
    if run is None:
        out[:] = s
    else:
        if stops[len(s) - 1] != n:
            raise WebPError("copy runs over")
        which = which[which < len(s)]
        place = stops[:len(s)] - run[:len(s)]
        out[place] = s  # what a copy puts at its first place is overwritten below
        fars = far_of.take(np.searchsorted(copies, starts.take(which)))
        for at, length, far in zip(place.take(which).tolist(), run.take(which).tolist(), fars.tolist(), strict=True):
            far = _distance(far, width)
            if far > at:
                raise WebPError("copy from outside")
            if far >= length:
                out[at:at + length] = out[at - far:at - far + length]
            else:
                out[at:at + length] = np.resize(out[at - far:at], length)
    return (rest | out.astype(np.uint32) << np.uint32(8)).reshape(height, width)


def _chain(follow: np.ndarray, first: int, span: int) -> np.ndarray:
    """first, follow[first], and so on below ``span``: every sixteenth is walked, the others are filled in together."""
    follow = np.append(follow, np.int32(span))
    far = follow
    for _ in range(4):
        far = far.take(far)
    jump, marks, p = memoryview(far), [], first
    while p < span:
        marks.append(p)
        p = jump[p]
    out = np.empty((len(marks), 16), np.int32)
    out[:, 0] = marks
    for k in range(1, 16):
        out[:, k] = follow.take(out[:, k - 1])
    out = out.ravel()
    return out[out < span].astype(np.int64)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(p).view(np.uint8).reshape(*p.shape, 4)  # B, G, R, A


def _average(a, b):
    return ((a.astype(np.int32) + b) >> 1).astype(np.uint8)


def _predict(mode: int, left, top, right, corner):
    """The prediction from the neighbours' channels (uint8 arrays whose last axis is the channel)."""
    black = np.zeros_like(top)
    black[..., 3] = 255
    if mode in (0, 14, 15):
        return black
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    l, t, c = left.astype(np.int32), top.astype(np.int32), corner.astype(np.int32)
    if mode == 11:
        to_left, to_top = np.abs(t - c).sum(-1, keepdims=True), np.abs(l - c).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(l + t - c, 0, 255).astype(np.uint8)
    mean = (l + t) >> 1
    half = mean - c
    return np.clip(mean + np.where(half < 0, -(-half // 2), half // 2), 0, 255).astype(np.uint8)


def _undo_predictor(p: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = p.shape
    d = _channels(p)
    out = np.zeros((height, width, 4), np.uint8)
    black = np.array([0, 0, 0, 255], np.uint8)
    out[0, 0] = d[0, 0] + black
    first = d[0].copy()
    first[0] = out[0, 0]
    out[0] = np.cumsum(first, axis=0, dtype=np.uint8)
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = d[y, 0] + above[0]
        if width == 1:
            continue
        right = np.concatenate([above[2:], row[:1]])
        own = ((modes[y >> size_bits] >> 8) & 15)[np.arange(1, width) >> size_bits]
        cut = np.flatnonzero(np.diff(own)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), width - 1], strict=True):
            mode = int(own[a])
            a, b = a + 1, b + 1
            if mode in (0, 2, 3, 4, 8, 9, 14, 15):  # the left neighbour isn't needed
                row[a:b] = d[y, a:b] + _predict(mode, above[a:b], above[a:b], right[a - 1:b - 1], above[a - 1:b - 1])
            elif mode == 1:
                run = d[y, a:b].copy()
                run[0] += row[a - 1]
                row[a:b] = np.cumsum(run, axis=0, dtype=np.uint8)
            else:
                for x in range(a, b):
                    row[x] = d[y, x] + _predict(mode, row[x - 1], above[x], right[x - 1], above[x - 1])
    return out.view(np.uint32).reshape(height, width)


def _cross(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (t.astype(np.uint8).view(np.int8).astype(np.int32) * c.astype(np.uint8).view(np.int8)) >> 5


def _spread(blocks: np.ndarray, size_bits: int, height: int, width: int) -> np.ndarray:
    return blocks[np.arange(height)[:, None] >> size_bits, np.arange(width)[None, :] >> size_bits]


def _cross_colour(p: np.ndarray, blocks: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    """Adds (sign 1: undoes the transform) or takes away what green and red say of red and blue."""
    t = _spread(blocks, size_bits, *p.shape)
    g, r, b = p >> 8 & 255, p >> 16 & 255, p & 255
    new_r = (r.astype(np.int32) + sign * _cross(t & 255, g)) & 255
    real_r = new_r if sign > 0 else r
    new_b = (b.astype(np.int32) + sign * (_cross(t >> 8 & 255, g) + _cross(t >> 16 & 255, real_r))) & 255
    return (p & np.uint32(0xFF00FF00)) | new_r.astype(np.uint32) << np.uint32(16) | new_b.astype(np.uint32)


def _subtract_green(p: np.ndarray, sign: int) -> np.ndarray:
    d = _channels(p).copy()
    g = d[..., 1] if sign > 0 else -d[..., 1]
    d[..., 0] += g
    d[..., 2] += g
    return d.view(np.uint32).reshape(p.shape)


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(p: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    bits = _bundle_bits(len(palette))
    index = p >> 8 & 255
    if bits:
        per, each = 1 << bits, 8 >> bits
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * each) & ((1 << each) - 1)).reshape(p.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != 0x2F:
        raise WebPError("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size:
        raise WebPError("truncated")
    bits = Bits(data[21:20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if any(k == kind for k, *_ in undo):
            raise WebPError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size_bits = bits.read(3) + 2
            undo.append((kind, _read_image(bits, -(-now // (1 << size_bits)), -(-height // (1 << size_bits))), size_bits))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, colours, 1))[0], axis=0, dtype=np.uint8).view(np.uint32).ravel()
            undo.append((kind, table, now))
            now = -(-now // (1 << _bundle_bits(colours)))
        else:
            undo.append((kind,))
    p = _read_image(bits, now, height, top=True)
    for kind, *how in reversed(undo):
        if kind == PREDICTOR:
            p = _undo_predictor(p, *how)
        elif kind == CROSS_COLOUR:
            p = _cross_colour(p, *how, 1)
        elif kind == PALETTE:
            p = _undo_palette(p, *how)
        else:
            p = _subtract_green(p, 1)
    return p


# ---- writing ----


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Huffman code lengths of at most ``limit`` bits; counts are flattened until they fit."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        leaves, n = weight[order].tolist(), len(used)
        # two queues: the leaves by weight, and the inner nodes, which are made by rising weight
        inner, parent, leaf, node = [], [0] * (2 * n - 1), 0, 0
        for made in range(n, 2 * n - 1):
            total = 0
            for _ in (0, 1):
                if leaf < n and (node >= len(inner) or leaves[leaf] <= inner[node]):
                    total += leaves[leaf]
                    parent[leaf] = made
                    leaf += 1
                else:
                    total += inner[node]
                    parent[n + node] = made
                    node += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= limit:
            out[used[order]] = depth[:n]
            return out
        weight = (weight + 1) // 2


class Writer:
    """Collects (value, bit count) pairs, least significant bit first."""

    def __init__(self):
        self._values, self._counts = [], []
        self._single: list[tuple[int, int]] = []

    def put(self, value: int, count: int) -> None:
        self._single.append((value, count))

    def _flush(self) -> None:
        if self._single:
            both = np.array(self._single, np.int64)
            self._values.append(both[:, 0])
            self._counts.append(both[:, 1])
            self._single = []

    def put_all(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._flush()
        some = np.flatnonzero(counts)
        self._values.append(values.take(some))
        self._counts.append(counts.take(some))

    def bytes(self) -> bytes:
        self._flush()
        values, counts = np.concatenate(self._values), np.concatenate(self._counts)
        ends = np.cumsum(counts)
        begin = ends - counts
        shifted, word = values << (begin & 31), begin >> 5
        # bits of one word don't overlap, so their sum is exact
        size = (int(ends[-1]) >> 5) + 2
        words = np.bincount(word, shifted & 0xFFFFFFFF, size) + np.bincount(word + 1, shifted >> 32, size)
        return words.astype("<u4").tobytes()[: int(ends[-1] + 7) // 8]


def _put_code(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a code for ``counts``; its codes and lengths (zero where one symbol stands alone)."""
    used = np.flatnonzero(counts)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        s = int(used[0]) if len(used) else 0
        w.put(1, 1), w.put(0, 1), w.put(s > 1, 1), w.put(s, 8 if s > 1 else 1)
        return np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
    if len(used) == 1:  # a lone symbol past 255 needs a companion to be written in the long form
        counts = counts.copy()
        counts[0] = 1
    lengths = code_lengths(counts)
    w.put(0, 1)
    tokens = []
    values = lengths.tolist()
    while values and not values[-1]:
        values.pop()
    for value, group in groupby(values):
        run = sum(1 for _ in group)
        if value:
            tokens.append((value, 0, 0))
            run -= 1
        while run >= 3:
            part = min(run, 6 if value else 138)
            tokens.append((16, part - 3, 2) if value else (17, part - 3, 3) if part <= 10 else (18, part - 11, 7))
            run -= part
        tokens += [(value, 0, 0)] * run
    inner = code_lengths(np.bincount([t[0] for t in tokens], minlength=19), 7)
    codes = canonical(inner)
    alone = np.count_nonzero(inner) == 1
    last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if inner[s])
    w.put(max(0, last + 1 - 4), 4)
    for s in CODE_LENGTH_ORDER[: max(4, last + 1)]:
        w.put(int(inner[s]), 3)
    short = len(tokens) < len(counts)
    w.put(short, 1)
    if short:
        size = max(2, (max(len(tokens) - 2, 1)).bit_length() + 1 & ~1)
        w.put((size - 2) // 2, 3), w.put(len(tokens) - 2 if len(tokens) > 1 else 0, size)
    for s, extra, n in tokens:
        if not alone:
            w.put(int(codes[s]), int(inner[s]))
        if n:
            w.put(extra, n)
    return canonical(lengths), lengths.astype(np.int64)


def _prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their count, of lengths or distance codes from 1 on."""
    v = value.astype(np.int64) - 1
    if not len(v):
        return v, v, v
    high = np.maximum(np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1, 0)
    extra = np.where(v < 4, 0, high - 1)
    second = np.where(v < 4, 0, v >> np.maximum(extra, 0) & 1)
    return np.where(v < 4, v, 2 * high + second), np.where(v < 4, 0, v & ((1 << extra) - 1)), extra


def find_copies(p: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """Non-overlapping ``(at, length, distance)``: runs whose eight-pixel windows have all occurred at one distance before."""
    n = len(p)
    if n < 2 * least:
        return []
    if not ((p ^ p[0]) & np.uint32(0xFFFF00FF)).any():  # green alone varies: eight samples are one number
        g = (p >> np.uint32(8)).astype(np.uint8)
        h = np.ndarray(n - 7, "<u8", g, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    else:
        h = np.zeros(n - 7, np.uint64)
        for k in range(8):
            h = h * np.uint64(0x9E3779B97F4A7C15) + p[k:n - 7 + k].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    low = np.uint64(n.bit_length())  # equal windows stand together, by place
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    same = key[1:] >> low == key[:-1] >> low
    before = np.full(len(h), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    hit = np.flatnonzero(before >= 0)
    if not len(hit):
        return []
    far = hit - before[hit]
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(far) != 0)) + 1
    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]])
    enough = (stops - starts + 7 >= least) & (far[starts] <= _FARTHEST)
    starts, stops = starts[enough], stops[enough]
    out, done = [], 0
    for at, length, d in zip(hit[starts].tolist(), (stops - starts + 7).tolist(), far[starts].tolist(), strict=True):
        if at < done:
            length -= done - at
            at = done
        while length >= least:
            part = min(length, _MAX_COPY)
            if not np.array_equal(p[at:at + part], _source(p, at, part, d)):
                break
            out.append((at, part, d))
            at, length, done = at + part, length - part, at + part
    return out


def _source(p: np.ndarray, at: int, length: int, far: int) -> np.ndarray:
    return p[at - far:at - far + length]


def _put_image(w: Writer, p: np.ndarray, top: bool = False, copies: bool = False, cache_bits: int = 0, meta_bits: int = 0) -> None:
    height, width = p.shape
    flat = np.ascontiguousarray(p).ravel()
    n = len(flat)
    found = find_copies(flat) if copies else []
    kind = np.zeros(n, np.int8)  # 0 literal, 1 copy, 2 inside a copy, 3 cached
    length, code = np.ones(n, np.int64), np.ones(n, np.int64)
    for at, run, far in found:
        kind[at:at + run] = 2
        kind[at], length[at], code[at] = 1, run, far + len(NEAR)
    slot = (flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits) if cache_bits else None
    if cache_bits:
        held: dict[int, int] = {}
        for k, (s, v) in enumerate(zip(slot.tolist(), flat.tolist(), strict=True)):
            if not kind[k] and held.get(s) == v:
                kind[k] = 3
            held[s] = v
    w.put(cache_bits > 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    at = np.flatnonzero(kind != 2)
    group = np.zeros(len(at), np.int64)
    if top:
        w.put(meta_bits > 0, 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            rows, cols = -(-height // (1 << meta_bits)), -(-width // (1 << meta_bits))
            blocks = (np.add.outer(np.arange(rows), np.arange(cols)) % 2).astype(np.uint32)
            _put_image(w, blocks << np.uint32(8))
            group = blocks[(at // width) >> meta_bits, (at % width) >> meta_bits].astype(np.int64)
    k, px = kind[at], flat[at].astype(np.int64)
    literal, copy = k == 0, np.flatnonzero(k == 1)
    green = px >> 8 & 255
    if cache_bits:
        green[k == 3] = 256 + LENGTHS + slot[at[k == 3]].astype(np.int64)
    len_prefix, len_extra, len_bits = _prefix_of(length[at[copy]])
    far_prefix, far_extra, far_bits = _prefix_of(code[at[copy]])
    green[copy] = 256 + len_prefix
    where = np.flatnonzero(literal)
    own = px[where]
    # in the order written: green; red, blue and alpha of a literal; extra bits and distance of a copy
    columns = [(0, np.arange(len(at)), green), (1, where, own >> 16 & 255), (2, where, own & 255), (3, where, own >> 24 & 255), (5, copy, far_prefix)]
    sizes = (256 + LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    values, counts = {}, {}
    for g in range(int(group.max()) + 1 if meta_bits else 1):
        for (col, place, symbol), size in zip(columns, sizes, strict=True):
            if meta_bits:
                mine = group[place] == g
                place, symbol = place[mine], symbol[mine]
            codes, lengths = _put_code(w, np.bincount(symbol, minlength=size))
            if lengths.any():
                if col not in values:
                    values[col], counts[col] = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                values[col][place], counts[col][place] = codes[symbol], lengths[symbol]
    if len(copy):
        for col, extra, bits in ((4, len_extra, len_bits), (6, far_extra, far_bits)):
            values[col], counts[col] = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            values[col][copy], counts[col][copy] = extra, bits
    if values:
        order = sorted(values)
        w.put_all(np.stack([values[c] for c in order], 1).ravel(), np.stack([counts[c] for c in order], 1).ravel())


def _forward_predictor(p: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = p.shape
    d = _channels(p)
    out = d.copy()
    out[0, 0] -= np.array([0, 0, 0, 255], np.uint8)
    out[0, 1:] = d[0, 1:] - d[0, :-1]
    out[1:, 0] = d[1:, 0] - d[:-1, 0]
    if height > 1 and width > 1:
        mode = _spread(modes >> 8 & 15, size_bits, height, width)[1:, 1:]
        left, top, corner = d[1:, :-1], d[:-1, 1:], d[:-1, :-1]
        right = np.concatenate([d[:-1, 2:], d[1:, :1]], axis=1)
        for m in range(14):
            who = mode == m
            if who.any():
                out[1:, 1:][who] = (d[1:, 1:] - _predict(m, left, top, right, corner))[who]
    return out.view(np.uint32).reshape(height, width)


def encode(pixels: np.ndarray, transforms: tuple = (), copies: bool = True, cache_bits: int = 0, meta_bits: int = 0) -> bytes:
    """A lossless WebP file of ``pixels``.

    ``transforms``, in the order written: ``("predictor", modes, size_bits)`` with a
    mode per block, ``("cross", elements, size_bits)``, ``("green",)`` and ``("palette",)``.
    """
    p = np.ascontiguousarray(pixels, np.uint32)
    height, width = p.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise WebPError("a side has 1 to 16384 pixels")
    w = Writer()
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    for kind, *how in transforms:
        w.put(1, 1)
        if kind in ("predictor", "cross"):
            blocks, size_bits = how
            w.put(PREDICTOR if kind == "predictor" else CROSS_COLOUR, 2), w.put(size_bits - 2, 3)
            blocks = np.asarray(blocks, np.uint32)
            if kind == "predictor":
                blocks = blocks << np.uint32(8)
            _put_image(w, blocks)
            p = _forward_predictor(p, blocks, size_bits) if kind == "predictor" else _cross_colour(p, blocks, size_bits, -1)
        elif kind == "palette":
            palette, index = np.unique(p, return_inverse=True)
            if len(palette) > 256:
                raise WebPError("too many colours for a palette")
            w.put(PALETTE, 2), w.put(len(palette) - 1, 8)
            steps = _channels(palette.reshape(1, -1)).copy()
            steps[0, 1:] -= _channels(palette.reshape(1, -1))[0, :-1]
            _put_image(w, steps.view(np.uint32).reshape(1, -1))
            index = index.reshape(height, -1).astype(np.uint32)
            bits = _bundle_bits(len(palette))
            if bits:
                per, each = 1 << bits, 8 >> bits
                padded = np.zeros((height, -(-index.shape[1] // per) * per), np.uint32)
                padded[:, : index.shape[1]] = index
                index = (padded.reshape(height, -1, per) << (np.arange(per, dtype=np.uint32) * each)).sum(-1, dtype=np.uint32)
            p = index << np.uint32(8)
        else:
            w.put(SUBTRACT_GREEN, 2)
            p = _subtract_green(p, -1)
    w.put(0, 1)
    _put_image(w, p, True, copies, cache_bits, meta_bits)
    body = b"\x2f" + w.bytes()
    body = len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 8).to_bytes(4, "little") + b"WEBPVP8L" + body
