"""Lossless WebP as a column type: a decoder of the whole format and an encoder for byte payloads.

The decoder reads prefix codes, back-references, colour caches and entropy images and inverts the
predictor, cross-colour, subtract-green and colour-indexing (palette) transforms, as the published
bitstream specification (RFC 9649) has them; it returns pixel arrays. Where the codes of red, blue and alpha
have one symbol each and there is no cache, it reads several green literals from each window of bits at once
and stops at back-references only.

The encoder writes a payload as the green samples of 24 (or 576) pixel wide pictures. Repeats of LEAST
bytes or more become back-references. Samples of at most 16 values are packed by a palette transform
if that is shorter. Of three fixed prefix codes the shortest one is taken: text-like, flat, or one that
takes samples seen a short while ago from a colour cache. A predictor, cross-colour or subtract-green
transform would only lengthen such pictures, whose neighbours are not alike and which have one channel. Payloads
beyond 576 x 16384 samples become several RIFF files, one after another.

Scale: one Arrow pass, no shuffle; memory is a small multiple of the longest text.

Defined results: null and empty texts give one tile of 255s; equal texts give equal bytes; extra columns
are ignored; damaged streams raise ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftline.llm.arrowio import chunks, map_arrow, raw

TILE = 576
FULL = 576 * 16384

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Short distances: points of the rows above and to the left, nearest first; built by rule.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
HASH = 0x1E35A7BD


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at, self.end = data, at, len(data) * 8

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return out

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 5], "little") >> (self.at & 7) & (1 << n) - 1


class Code:
    """A canonical prefix code, as a table over 15 bits of (length, symbol)."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = lengths
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.single = used[0][1] if len(used) == 1 else None
        if not used:
            raise ValueError("a prefix code has no symbol")
        if self.single is None:
            if sum(1 << 15 - n for n, _ in used) != 1 << 15:
                raise ValueError("a prefix code is not complete")
            self.size, self.symbol = np.empty(1 << 15, "u1"), np.empty(1 << 15, "u2")
            code = last = 0
            for n, s in sorted(used):
                code <<= n - last
                first = int(f"{code:0{n}b}"[::-1], 2)
                self.size[first :: 1 << n] = n
                self.symbol[first :: 1 << n] = s
                code, last = code + 1, n
            self.pairs = None

    def next(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        if self.pairs is None:
            self.pairs = list(zip(self.size.tolist(), self.symbol.tolist()))
        n, s = self.pairs[bits.peek(15)]
        bits.read(n)
        return s


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    order = LENGTH_ORDER[: 4 + bits.read(4)]
    of = [0] * 19
    for k in order:
        of[k] = bits.read(3)
    outer = Code(of)
    left = alphabet
    if bits.read(1):
        n = 2 + 2 * bits.read(3)
        left = 2 + bits.read(n)
        if left > alphabet:
            raise ValueError("too many code lengths")
    k, last = 0, 8
    while k < alphabet and left:
        left -= 1
        s = outer.next(bits)
        if s < 16:
            lengths[k] = s
            last = s or last
            k += 1
            continue
        times, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
        if k + times > alphabet:
            raise ValueError("code lengths run over")
        lengths[k : k + times] = [value] * times
        k += times
    return Code(lengths)


def _extra(symbol: int, bits: Bits) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    n = symbol - 2 >> 1
    return (2 + (symbol & 1) << n) + bits.read(n) + 1


def _distance(d: int, width: int) -> int:
    """How many pixels back a distance code points."""
    if d > 120:
        return d - 120
    dx, dy = NEAR[d - 1]
    return max(1, dx + dy * width)


def _alphabets(cache: int) -> tuple[int, ...]:
    return 280 + (1 << cache if cache else 0), 256, 256, 256, 40


class Group:
    """The five prefix codes of a part of a picture."""

    def __init__(self, codes: list[Code]) -> None:
        self.codes = codes
        #: Red, blue and alpha, if they are the same throughout.
        self.rest = None if any(c.single is None for c in codes[1:4]) else codes[3].single << 24 | codes[1].single << 16 | codes[2].single
        self.green: Green | None = None


#: Code groups read before: the bits that announce them, their number, the cache's size, the group.
_SEEN: list[tuple[int, int, int, Group]] = []


def _group(bits: Bits, cache_bits: int) -> Group:
    start = bits.at
    for head, n, size, group in _SEEN:
        k = start >> 3
        if size == cache_bits and int.from_bytes(bits.data[k : k + (n + 15 >> 3)], "little") >> (start & 7) & (1 << n) - 1 == head:
            bits.at += n
            return group
    group = Group([read_code(bits, n) for n in _alphabets(cache_bits)])
    if len(_SEEN) < 8:
        k, n = start >> 3, bits.at - start
        _SEEN.append((int.from_bytes(bits.data[k : k + (n + 15 >> 3)], "little") >> (start & 7) & (1 << n) - 1, n, cache_bits, group))
    return group


def _pixels(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded picture, as 0xAARRGGBB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift, across = None, 0, 0
    if main and bits.read(1):
        shift = bits.read(3) + 2
        across = -(-width >> shift)
        meta = (_pixels(bits, across, -(-height >> shift), False) >> 8 & 0xFFFF).tolist()
    whole = [_group(bits, cache_bits) for _ in range(max(meta) + 1 if meta else 1)]
    if not meta and not cache_bits and whole[0].rest is not None and whole[0].codes[0].single is None:
        whole[0].green = whole[0].green or Green(whole[0].codes[0], whole[0].codes[4])
        return whole[0].green.read(bits, width, width * height).astype("u4") << np.uint32(8) | np.uint32(whole[0].rest)
    groups = [g.codes for g in whole]
    out: list[int] = []
    cache, drop = [0] * (1 << cache_bits), 32 - cache_bits
    total, group = width * height, groups[0]
    while len(out) < total:
        if meta:
            y, x = divmod(len(out), width)
            group = groups[meta[(y >> shift) * across + (x >> shift)]]
        s = group[0].next(bits)
        if s < 256:
            red = group[1].next(bits)
            blue = group[2].next(bits)
            new = [group[3].next(bits) << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            n = _extra(s - 256, bits)
            d = _distance(_extra(group[4].next(bits), bits), width)
            if d > len(out) or len(out) + n > total:
                raise ValueError("a back-reference leaves the picture")
            for _ in range(n):
                out.append(out[-d])
            new = out[-n:]
            del out[-n:]
        else:
            new = [cache[s - 280]]
        if cache_bits:
            for p in new:
                cache[(p * HASH & 0xFFFFFFFF) >> drop] = p
        out += new
    return np.array(out, "u4")


def _average(a: int, b: int) -> int:
    return (a & b) + ((a ^ b) >> 1 & 0x7F7F7F7F)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _join(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def predict(mode: int, left: int, top: int, top_left: int, top_right: int) -> int:
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    l, t, tl = _channels(left), _channels(top), _channels(top_left)  # noqa: E741
    if mode == 11:
        # The guess left + top - top_left is as far from left as top is from top_left.
        return left if sum(abs(a - c) for a, c in zip(t, tl)) < sum(abs(a - c) for a, c in zip(l, tl)) else top
    if mode == 12:
        return _join(_clamp(a + b - c) for a, b, c in zip(l, t, tl))
    if mode == 13:
        return _join(_clamp(m + int((m - c) / 2)) for m, c in zip(_channels(_average(left, top)), tl))
    return 0xFF000000


def _plus(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _signed(x: int) -> int:
    return x - 256 if x > 127 else x


def _unpredict(pixels: list[int], width: int, shift: int, modes: list[int]) -> list[int]:
    across = -(-width >> shift)
    out: list[int] = []
    for k, rest in enumerate(pixels):
        y, x = divmod(k, width)
        if not y:
            guess = out[-1] if x else 0xFF000000
        elif not x:
            guess = out[-width]
        else:
            mode = modes[(y >> shift) * across + (x >> shift)] >> 8 & 15
            guess = predict(mode, out[-1], out[-width], out[-width - 1], out[-width + 1] if width > 1 else out[-1])
        out.append(_plus(rest, guess))
    return out


def _uncross(pixels: list[int], width: int, shift: int, factors: list[int]) -> list[int]:
    across, out = -(-width >> shift), []
    for k, p in enumerate(pixels):
        y, x = divmod(k, width)
        _, red_blue, green_blue, green_red = map(_signed, _channels(factors[(y >> shift) * across + (x >> shift)]))
        a, r, g, b = _channels(p)
        green = _signed(g)
        r = r + (green_red * green >> 5) & 255
        b = b + (green_blue * green >> 5) + (red_blue * _signed(r) >> 5) & 255
        out.append(_join((a, r, g, b)))
    return out


def _unindex(pixels: np.ndarray, width: int, pack: int, table: list[int]) -> np.ndarray:
    index = (pixels >> 8 & 255).reshape(-1, -(-width >> pack))
    if pack:
        size = 8 >> pack
        x = np.arange(width)
        index = index[:, x >> pack] >> ((x & (1 << pack) - 1) * size).astype("u4") & (1 << size) - 1
    colours = np.zeros(256, "u4")
    colours[: len(table)] = table
    return colours[index.ravel()]


def chunk(media: bytes, at: int = 0) -> tuple[bytes, int]:
    """The lossless picture's data in the RIFF file at ``at``, and where the file ends."""
    if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
        raise ValueError("not a WebP file")
    end = at + 8 + int.from_bytes(media[at + 4 : at + 8], "little")
    k = at + 12
    while k + 8 <= end:
        n = int.from_bytes(media[k + 4 : k + 8], "little")
        if media[k : k + 4] == b"VP8L":
            if k + 8 + n > len(media):
                break
            return media[k + 8 : k + 8 + n], end
        k += 8 + n + (n & 1)
    raise ValueError("no lossless picture")


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and 0xAARRGGBB pixels of a lossless picture's data."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("wrong signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    inner, undo, seen = width, [], set()
    each = lambda f: lambda p, *args: np.array(f(p.tolist(), *args), "u4")
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            shift = bits.read(3) + 2
            data_ = _pixels(bits, -(-inner >> shift), -(-height >> shift), False).tolist()
            undo.append((each(_unpredict if kind == 0 else _uncross), inner, shift, data_))
        elif kind == 2:
            undo.append((each(lambda p, *_: [(q & 0xFF00FF00) | ((q >> 16) + (q >> 8) & 255) << 16 | (q + (q >> 8) & 255) for q in p]), 0, 0, []))
        else:
            size = bits.read(8) + 1
            table = _pixels(bits, size, 1, False).tolist()
            for k in range(1, size):
                table[k] = _plus(table[k], table[k - 1])
            pack = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((_unindex, inner, pack, table))
            inner = -(-inner >> pack)
    pixels = _pixels(bits, inner, height, True)
    for f, *args in reversed(undo):
        pixels = f(pixels, *args)
    return width, height, pixels


def samples(media: bytes) -> np.ndarray:
    """Height x width x 4 array (red, green, blue, alpha) of a WebP file."""
    width, height, pixels = decode(chunk(media)[0])
    p = pixels.reshape(height, width)
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24], -1).astype("u1")


class Green:
    """Reads pictures of one channel: several literals from each window of 16 bits, and back-references."""

    def __init__(self, code: Code, distance: Code) -> None:
        window = np.arange(1 << 16)
        used, self.count = np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i8")
        self.symbols = np.zeros((1 << 16, 8), "u1")
        for k in range(8):
            rest = window >> used & 0x7FFF
            n = code.size[rest].astype("i8")
            fits = (used + n <= 16) & (self.count == k) & (code.symbol[rest] < 256)
            self.symbols[fits, k] = code.symbol[rest[fits]]
            self.count += fits
            used += np.where(fits, n, 0)
        #: Bits of a window's literals; 0 where a back-reference begins.
        self.advance = used.astype("u1").tobytes()
        pairs = lambda c: [(0, c.single)] * (1 << 15) if c.single is not None else list(zip(c.size.tolist(), c.symbol.tolist()))
        self.lengths, self.distances = pairs(code), pairs(distance)

    def read(self, bits: Bits, width: int, total: int) -> np.ndarray:
        data, at, last = bits.data, bits.at, len(bits.data) * 8
        b = np.frombuffer(data + b"\0\0\0\0", "u1").astype("u4")
        advance, lengths, distances, block = self.advance, self.lengths, self.distances, 1 << 16
        out = bytearray()
        while len(out) < total:
            if at >= last:
                raise ValueError("the stream ends too early")
            base = at >> 3
            part = b[base : base + block + 2]
            joined = part[:-2] | part[1:-1] << 8 | part[2:] << 16
            windows = np.empty((len(joined), 8), "u2")
            for k in range(8):
                windows[:, k] = joined >> k
            view, end, start = memoryview(windows.ravel()), len(joined) * 8, base * 8
            p, seen, cuts = at - start, [], []
            note, stop = seen.append, min(end, last - start)
            while p < stop:
                w = view[p]
                n = advance[w]
                if n:
                    note(w)
                    p += n
                    continue
                q = start + p
                v = int.from_bytes(data[q >> 3 : (q >> 3) + 9], "little") >> (q & 7)
                n, s = lengths[v & 0x7FFF]
                s -= 256
                v, p = v >> n, p + n
                n = s - 2 >> 1 if s >= 4 else 0
                length = ((2 + (s & 1) << n) + (v & (1 << n) - 1) if s >= 4 else s) + 1
                v, p = v >> n, p + n
                n, s = distances[v & 0x7FFF]
                v, p = v >> n, p + n
                n = s - 2 >> 1 if s >= 4 else 0
                d = ((2 + (s & 1) << n) + (v & (1 << n) - 1) if s >= 4 else s) + 1
                p += n
                cuts.append((len(seen), length, d))
            seen = np.array(seen, "u2")
            count = self.count[seen]
            literal = self.symbols[seen][np.arange(8) < count[:, None]].tobytes()
            places = np.concatenate(([0], np.cumsum(count)))[[c[0] for c in cuts]].tolist() if cuts else []
            done = 0
            for place, (_, length, d) in zip(places, cuts):
                out += literal[done:place]
                done = place
                if len(out) >= total:
                    break
                d = _distance(d, width)
                if d > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the picture")
                k = len(out) - d
                out += out[k : k + length] if d >= length else (out[k:] * (length // d + 1))[:length]
            out += literal[done:]
            at = start + p
        # What stands for more than the picture was read from the padding.
        bits.at = min(at, last)
        return np.frombuffer(bytes(out[:total]), "u1")


# ---- writing


class Writer:
    def __init__(self) -> None:
        self.value = self.n = 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _prior() -> list[int]:
    """How often bytes are taken to occur in texts: only their order of size matters for the result."""
    w = [3] * 256
    for k, c in enumerate(b" etaonirshldu"):
        w[c] = 4000 - 270 * k
    for c in b"mcfgpwybvkxjqz":
        w[c] = 250
    for c in b".,\n":
        w[c] = 180
    w[0xC3] = 220
    for c in range(0x80, 0xC0):
        w[c] = 12
    for c in range(0x30, 0x5B):
        w[c] = 14
    w[255] = 120
    return w


def _lengths(weights: list[int]) -> list[int]:
    """Code lengths by Huffman's rule; ties by symbol."""
    heap = [(w, k, (k,)) for k, w in enumerate(weights)]
    heapq.heapify(heap)
    out = [0] * len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            out[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def _write_code(w: Writer, lengths: list[int]) -> None:
    """A prefix code's header: one symbol simply, else the lengths in runs under a code of their own."""
    used = [k for k, n in enumerate(lengths) if n]
    if len(used) <= 2 and used[-1] < 256:
        for value, n in ((1, 1), (len(used) - 1, 1), (1, 1), (used[0], 8), *((k, 8) for k in used[1:])):
            w.put(value, n)
        return
    runs, k = [], 0
    while k < len(lengths):
        n = next((j for j in range(k, len(lengths)) if lengths[j] != lengths[k]), len(lengths)) - k
        value = lengths[k]
        if value:
            runs.append((value, 0, 0))
            k, n = k + 1, n - 1
            least, most, symbol, extra = 3, 6, 16, 2
        else:
            least, most, symbol, extra = (11, 138, 18, 7) if n >= 11 else (3, 10, 17, 3)
        while n >= least:
            m = min(n, most)
            runs.append((symbol, m - least, extra))
            k, n = k + m, n - m
        runs += [(value, 0, 0)] * n
        k += n
    seen = [sum(r[0] == s for r in runs) for s in range(19)]
    size = _lengths_of([c for c in seen if c])
    if max(size) > 7:
        size = [5] * len(size) if len(size) > 16 else [4] * len(size)
    kinds = [s for s in range(19) if seen[s]]
    if sum(2.0**-n for n in size) != 1:
        # A flat code over more symbols than are used stays complete.
        flat = max(size)
        kinds = sorted({*kinds, *range(19)}, key=lambda s: (s not in kinds, s))[: 1 << flat]
        size = [flat] * len(kinds)
        if len(kinds) < 1 << flat:
            size[: (1 << flat) - len(kinds)] = [flat - 1] * ((1 << flat) - len(kinds))
    of = dict(zip(kinds, size))
    w.put(0, 1)
    count = max(4, 1 + max(LENGTH_ORDER.index(s) for s in kinds))
    w.put(count - 4, 4)
    for s in LENGTH_ORDER[:count]:
        w.put(of.get(s, 0), 3)
    w.put(0, 1)
    codes = _canonical([of.get(s, 0) for s in range(19)])
    for symbol, value, extra in runs:
        if len(kinds) > 1:
            w.put(*codes[symbol])
        w.put(value, extra)


def _canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """(code, bits) of each symbol, the code with its first bit lowest."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code, last = code + 1, n
    return out


def _lengths_of(weights: list[int]) -> list[int]:
    return _lengths(weights) if len(weights) > 1 else [1]


class Model:
    """A code for green samples, lengths and cache entries, one for distances, and their header."""

    def __init__(self, weights: list[int], cache: int = 0) -> None:
        lengths = _lengths(weights[:256] + [max(1, sum(weights) // 600)] * 24 + weights[256:])
        distance = _lengths([1 if s < 12 else 40 for s in range(40)])
        head = Writer()
        if cache:
            head.put(1, 1)
            head.put(cache, 4)
        else:
            head.put(0, 1)
        self.cache = cache
        head.put(0, 1)  # no entropy image
        for code in (lengths, [1], [1], [0] * 255 + [1], distance):
            _write_code(head, code)
        self.head = head
        green, far = _canonical(lengths), _canonical(distance)
        self.size = np.array([green[s][1] for s in range(len(lengths))], "i8")
        self.bits = np.array([green[s][0] for s in range(len(lengths))], "u8")
        self.far_size = np.array([far[s][1] for s in range(40)], "i8")
        self.far_bits = np.array([far[s][0] for s in range(40)], "u8")


_MODELS: list[Model] = []
CACHE = 6


def _models() -> list[Model]:
    if not _MODELS:
        _MODELS.extend((Model(_prior()), Model([100] * 256), Model([4] * 256 + [400] * (1 << CACHE), CACHE)))
    return _MODELS


#: Bytes that must recur for a back-reference; the most it copies; how far back it may point.
LEAST, MOST, REACH = 10, 4096, (1 << 20) - 120
_KEY = 8


def repeats(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of back-references, not overlapping, in order.

    Each place meets the last one before it with the same 8 bytes; neighbours with one distance are one
    repeat.
    """
    n = len(data) - _KEY + 1
    if n < 2:
        return (np.empty(0, "i8"),) * 3
    key = np.lib.stride_tricks.as_strided(np.frombuffer(data.tobytes(), "u1"), (n, _KEY), (1, 1)).copy().view("u8").ravel()
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    back = np.zeros(n, "i8")
    back[order[same + 1]] = order[same + 1] - order[same]
    back[back > REACH] = 0
    edge = np.flatnonzero(np.concatenate(([True], back[1:] != back[:-1], [True])))
    start, size, far = edge[:-1], np.diff(edge), back[edge[:-1]]
    good = (far > 0) & (size + _KEY - 1 >= LEAST)
    start, end, far = start[good].tolist(), (start + size + _KEY - 1)[good].tolist(), far[good].tolist()
    out, at = [], 0
    for a, b, d in zip(start, end, far):
        a = max(a, at)
        while b - a >= LEAST:
            m = min(b - a, MOST)
            out.append((a, m, d))
            a += m
            at = a
    if not out:
        return (np.empty(0, "i8"),) * 3
    return tuple(np.array(out, "i8").T)


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number of lengths or distances."""
    x = value - 1
    high = np.maximum(np.frexp(np.maximum(x, 1).astype("f8"))[1] - 1, 1)
    n = np.where(x < 4, 0, high - 1)
    return np.where(x < 4, x, 2 * high + (x >> high - 1 & 1)), x & (1 << n) - 1, n


def _recent(data: np.ndarray) -> np.ndarray:
    """The cache entry that holds each sample when its turn comes, or -1."""
    slot = ((np.arange(256, dtype="u8") << np.uint64(8) | np.uint64(0xFF000000)) * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - CACHE)
    own = slot.astype("u1")[data]
    order = np.argsort(own, kind="stable")
    hit = np.zeros(len(data), bool)
    hit[order[1:]] = (own[order[1:]] == own[order[:-1]]) & (data[order[1:]] == data[order[:-1]])
    return np.where(hit, own.astype("i8"), -1)


def _coded(data: np.ndarray) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model with the fewest bits, and the codes and sizes that it writes for the samples."""
    start, length, far = repeats(data)
    keep = np.ones(len(data), bool)
    if len(start):
        inside = np.zeros(len(data) + 1, "i8")
        np.add.at(inside, start, 1)
        np.add.at(inside, start + length, -1)
        keep = np.cumsum(inside[:-1]) == 0
        keep[start] = True
    at = np.flatnonzero(keep)
    j = np.searchsorted(at, start)
    run, far = _prefix(length), _prefix(far + 120)
    literal = np.bincount(data[keep if not len(start) else np.delete(at, j)], minlength=256)
    best = None
    for model in _models():
        copies = int((model.size[256 + run[0]] + run[2] + model.far_size[far[0]] + far[2]).sum()) if len(start) else 0
        entry = None
        if model.cache:
            # Not even if every literal came from the cache.
            if model.head.n + copies + int(literal.sum()) * int(model.size[280:].min()) >= best[0]:
                continue
            entry = _recent(data)[at]
            symbol = np.where(entry >= 0, 280 + entry, data[at])
            total = model.head.n + copies + int(model.size[symbol if not len(start) else np.delete(symbol, j)].sum())
        else:
            total = model.head.n + copies + int(model.size[:256] @ literal)
        if best is None or total < best[0]:
            best = total, model, entry
    _, model, entry = best
    symbol = data[at].astype("i8") if entry is None else np.where(entry >= 0, 280 + entry, data[at])
    code, size = model.bits[symbol], model.size[symbol]
    if len(start):
        s, extra, n = run
        code[j], size[j] = model.bits[256 + s] | extra.astype("u8") << model.size[256 + s].astype("u8"), model.size[256 + s] + n
        s, extra, n = far
        code[j] |= (model.far_bits[s] | extra.astype("u8") << model.far_size[s].astype("u8")) << size[j].astype("u8")
        size[j] += model.far_size[s] + n
    return model, code, size


def _palette(top: Writer, values: np.ndarray) -> None:
    """The colour-indexing transform of samples with these values, coded as their differences."""
    top.put(1, 1)
    top.put(3, 2)
    top.put(len(values) - 1, 8)
    top.put(0, 1)  # no colour cache
    steps = [int(values[0]), *np.diff(values).tolist()]
    kinds = sorted(set(steps))
    lengths = [0] * 280
    for s, n in zip(kinds, _lengths_of([steps.count(s) for s in kinds])):
        lengths[s] = n
    opaque = [1] + [0] * 254 + [1] if len(values) > 1 else [0] * 255 + [1]
    for code in (lengths, [1], [1], opaque, [1]):
        _write_code(top, code)
    codes = _canonical(lengths)
    for k, s in enumerate(steps):
        if len(kinds) > 1:
            top.put(*codes[s])
        if len(values) > 1:
            top.put(0 if k else 1, 1)


def _body(top: Writer, data: np.ndarray) -> bytes:
    """What ``top`` holds and then the samples."""
    model, code, size = _coded(data)
    top.put(0, 1)  # no further transform
    top.put(model.head.value, model.head.n)
    skip, n_bits = top.n, top.n + int(size.sum())
    place = np.cumsum(size) - size + (skip & 63)
    word, off = place >> 6, (place & 63).astype("u8")
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, "u8")
    words[word[first]] = np.add.reduceat(code << off, first)
    over = np.flatnonzero(off + size.astype("u8") > 64)
    words[word[over] + 1] += code[over] >> (np.uint64(64) - off[over])
    whole = top.value >> (skip >> 6 << 6)
    words[0] |= np.uint64(whole)
    body = (top.value & (1 << (skip >> 6 << 6)) - 1).to_bytes(skip >> 6 << 3, "little") + words.astype("<u8").tobytes()
    return body[: n_bits + 7 >> 3]


def _picture(data: np.ndarray) -> bytes:
    """One RIFF file with the samples of ``data``, a multiple of TILE long."""
    width = 24 if len(data) <= 24 * 16384 else 576

    def top() -> Writer:
        w = Writer()
        for value, n in ((0x2F, 8), (width - 1, 14), (len(data) // width - 1, 14), (0, 4)):
            w.put(value, n)
        return w

    body = _body(top(), data)
    values = np.flatnonzero(np.bincount(data, minlength=256))
    if len(values) <= 16:
        per = 8 if len(values) <= 2 else 4 if len(values) <= 4 else 2
        index = np.searchsorted(values, data).reshape(-1, per)
        packed = top()
        _palette(packed, values)
        body = min(body, _body(packed, (index << np.arange(per) * (8 // per)).sum(1).astype("u1")), key=len)
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + (12 + len(body) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + pad


def store(payload: bytes) -> bytes:
    """A payload, a positive multiple of TILE bytes long, as WebP."""
    data = np.frombuffer(payload, "u1")
    return b"".join(_picture(data[k : k + FULL]) for k in range(0, len(data), FULL))


def load(media: bytes) -> np.ndarray:
    """The payload of ``store``: the green samples of its pictures, row by row."""
    out, at = [], 0
    while at < len(media):
        data, at = chunk(media, at)
        out.append((decode(data)[2] >> 8).astype("u1"))
    return np.concatenate(out)


def feature(x: np.ndarray) -> str:
    """Mean, deviation and share of neighbours that are equal, of the samples read back."""
    return f"mean={x.mean():.3f};std={x.std():.3f};flat={np.count_nonzero(x[1:] == x[:-1]) / (len(x) - 1):.4f}"


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % TILE or (TILE if not text else 0))


def media(documents: DataFrame, keep_media: bool = False) -> DataFrame:
    """Digests and features of every text's stored picture, read back; with the picture if wanted."""
    df = documents.select("doc_id", raw().alias("__raw"))
    schema = df.select("doc_id").schema
    for name, kind in (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")):
        schema = schema.add(name, kind)
    if keep_media:
        schema = schema.add("media", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__raw"):
            rows = []
            for text in batch.column("__raw").to_pylist():
                stored = store(payload_of(text))
                pixels = load(stored)
                back = pixels.tobytes()
                row = (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pixels))
                rows.append((*row, stored) if keep_media else row)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], schema.names)

    return map_arrow(df, run, schema)
