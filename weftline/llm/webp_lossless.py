"""Lossless WebP: a decoder of the whole VP8L format and an encoder for its parts.

The decoder reads prefix codes, back-references, the colour cache and groups of
prefix codes, and inverts the predictor, cross-colour, subtract-green and
palette transforms. Images whose red, blue and alpha codes have one symbol each
and that use no cache (grey samples) take a path that looks up, for every bit,
how many bits the next few literals use, walks those jumps and expands all
literals at once. Other images of one group are walked alike, a pixel at a time,
and their cache is resolved by sorting; only those with back-references, several
groups or few pixels are read symbol by symbol.
"""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np

MAX_SIDE = 1 << 14
LITERALS, LENGTHS, DISTANCES = 256, 24, 40

# Fixed values of the format: order of the code length code, and the (x, y) neighbours of short distance codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEIGHBOURS = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1),
    (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3),
    (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4),
    (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6),
    (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5),
    (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Lengths of a prefix code of at most ``limit`` bits; a single symbol gets one bit."""
    while True:
        heap = [(n, s, None) for s, n in counts.items()]
        if len(heap) == 1:
            return {heap[0][1]: 1}
        heapq.heapify(heap)
        mark = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            mark += 1
            heapq.heappush(heap, (a[0] + b[0], mark, (a, b)))
        out, level, depth = {}, [heap[0]], 0
        while level:
            following = []
            for _, s, kids in level:
                if kids is None:
                    out[s] = depth
                else:
                    following.extend(kids)
            level, depth = following, depth + 1
        if depth - 1 <= limit:
            return out
        counts = {s: (n + 1) >> 1 for s, n in counts.items()}  # flatter counts give shorter codes


#: All 15-bit numbers with their bits in reverse.
_REVERSED = sum((np.arange(1 << 15) >> k & 1) << 14 - k for k in range(15)).tolist()


def _reverse(code: int, bits: int) -> int:
    return _REVERSED[code] >> 15 - bits


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code with its first bit lowest, bits)."""
    out, code, before = {}, 0, 0
    for bits, s in sorted((n, s) for s, n in lengths.items()):
        code <<= bits - before
        out[s] = (_reverse(code, bits), bits)
        code, before = code + 1, bits
    return out


def prefix_of(value: int) -> tuple[int, int, int]:
    """A length or distance (from 1) as (prefix symbol, extra bits, their value)."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    extra = top - 1
    return 2 * top + (v >> extra & 1), extra, v & ((1 << extra) - 1)


@cache
def _turned(width: int) -> np.ndarray:
    """All numbers of ``width`` bits, each with its bits in reverse."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(width):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class _Code:
    """A prefix code as read: symbols and their bits by the next ``width`` bits; one symbol takes no bits."""

    def __init__(self, lengths: dict[int, int]):
        self._lists: tuple[list, list] | None = None
        self.single = next(iter(lengths)) if len(lengths) == 1 else None
        if self.single is not None:
            self.width, self.array, self.array_bits = 0, np.array([self.single]), np.array([0])
            return
        if sum(1 << (15 - n) for n in lengths.values()) != 1 << 15:
            raise ValueError("not a complete prefix code")
        self.width = width = max(lengths.values())
        order = np.array(sorted((n, s) for s, n in lengths.items()))
        turned = _turned(width)  # codes ascend by their first bits, which are the lowest ones here
        self.array, self.array_bits = (np.repeat(order[:, k], 1 << width - order[:, 0])[turned] for k in (1, 0))

    def read(self, r: _Reader) -> int:
        if self.single is not None:
            return self.single
        if self._lists is None:
            self._lists = self.array.tolist(), self.array_bits.tolist()
        w = r.peek(self.width)
        r.at += self._lists[1][w]
        return self._lists[0][w]


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + bytes(16), 0

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("image data ends early")
        return out


class _Writer:
    def __init__(self):
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n


def _write_code(w: _Writer, lengths: dict[int, int], alphabet: int) -> None:
    """A prefix code's own description."""
    used = sorted(lengths)
    if len(used) <= 2 and used[-1] < 256:
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        short = used[0] < 2
        w.put(0 if short else 1, 1)
        w.put(used[0], 1 if short else 8)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    items: list[tuple[int, int, int]] = []  # symbol of the code length code, extra bits, their value
    at = 0
    for s in used:
        gap = s - at
        while gap >= 11:
            n = min(gap, 138)
            items.append((18, 7, n - 11))
            gap -= n
        if gap >= 3:
            items.append((17, 3, gap - 3))
            gap = 0
        items.extend([(0, 0, 0)] * gap)
        items.append((lengths[s], 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for k, _, _ in items:
        counts[k] = counts.get(k, 0) + 1
    if len(counts) == 1:
        counts[0 if 0 not in counts else 1] = 1  # one symbol would take no bits
    own = code_lengths(counts, 7)
    codes = canonical(own)
    w.put(0, 1)
    n = max(4, 1 + max(i for i, k in enumerate(LENGTH_ORDER) if k in own))
    w.put(n - 4, 4)
    for k in LENGTH_ORDER[:n]:
        w.put(own.get(k, 0), 3)
    if at == alphabet or len(items) < 2:
        w.put(0, 1)
        if at < alphabet:
            raise AssertionError("code description too short")
    else:
        w.put(1, 1)
        need = max(1, -(-((len(items) - 2).bit_length() - 2) // 2))
        need = max(0, need)
        w.put(need, 3)
        w.put(len(items) - 2, 2 + 2 * need)
    for k, extra, value in items:
        w.put(codes[k][0], codes[k][1])
        w.put(value, extra)


def _read_code(r: _Reader, alphabet: int) -> _Code:
    if r.take(1):
        two = r.take(1)
        first = r.take(8 if r.take(1) else 1)
        return _Code({first: 1, r.take(8): 1} if two else {first: 1})
    own = {}
    for k in LENGTH_ORDER[: 4 + r.take(4)]:
        if n := r.take(3):
            own[k] = n
    if not own:
        raise ValueError("empty code length code")
    code = _Code(own)
    left = 2 + r.take(2 + 2 * r.take(3)) if r.take(1) else alphabet
    lengths: dict[int, int] = {}
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(r)
        if k < 16:
            if k:
                lengths[at] = before = k
            at += 1
        elif k == 16:
            for _ in range(3 + r.take(2)):
                lengths[at] = before
                at += 1
        else:
            at += 3 + r.take(3) if k == 17 else 11 + r.take(7)
    if at > alphabet or not lengths:
        raise ValueError("bad code lengths")
    return _Code(lengths)


# ---------------------------------------------------------------- decoder


def decode(data: bytes) -> np.ndarray:
    """Pixels of one lossless WebP file: (height, width) of 0xAARRGGBB."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or data[12:16] != b"VP8L" or data[20] != 0x2F:
        raise ValueError("not a lossless WebP file")
    r = _Reader(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = 1 + r.take(14), 1 + r.take(14)
    r.take(1)
    if r.take(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while r.take(1):
        kind = r.take(2)
        if any(kind == k for k, *_ in transforms):
            raise ValueError("transform used twice")
        if kind in (0, 1):
            bits = 2 + r.take(3)
            transforms.append((kind, now, bits, _read_image(r, (now + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits, False)))
        elif kind == 2:
            transforms.append((kind, now))
        else:
            n = 1 + r.take(8)
            colours = _read_image(r, n, 1, False).view(np.uint8).reshape(n, 4)
            colours = np.cumsum(colours, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, now, bits, colours))
            now = (now + (1 << bits) - 1) >> bits
    pixels = _read_image(r, now, height, True)
    for kind, w, *rest in reversed(transforms):
        if kind == 0:
            pixels = _unpredict(pixels, w, height, *rest)
        elif kind == 1:
            pixels = _uncross(pixels, w, height, *rest)
        elif kind == 2:
            pixels = _add_green(pixels)
        else:
            pixels = _unpalette(pixels, w, height, *rest)
    return pixels.reshape(height, width)


def _read_image(r: _Reader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as uint32."""
    cache_bits = 0
    if r.take(1):
        cache_bits = r.take(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("bad colour cache")
    groups, tile, which = 1, 0, None
    if main and r.take(1):
        tile = 2 + r.take(3)
        which = (_read_image(r, (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile, False) >> 8 & 0xFFFF).tolist()
        groups = max(which) + 1
    size = LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0)
    codes = [[_read_code(r, n) for n in (size, LITERALS, LITERALS, LITERALS, DISTANCES)] for _ in range(groups)]
    if groups == 1 and not cache_bits and all(c.single is not None for c in codes[0][1:4]):
        return _read_grey(r, width, width * height, codes[0])
    if groups == 1 and width * height >= 64 and (found := _read_pixels(r, width * height, codes[0], cache_bits)) is not None:
        return found
    return _read_general(r, width, width * height, codes, cache_bits, tile, which)


def _distance(code: int, width: int) -> int:
    if code > len(NEIGHBOURS):
        return code - len(NEIGHBOURS)
    x, y = NEIGHBOURS[code - 1]
    return max(1, x + y * width)


def _number(r: _Reader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = prefix - 2 >> 1
    return (2 + (prefix & 1) << extra) + r.take(extra) + 1


def _read_general(r: _Reader, width: int, n: int, codes: list, cache_bits: int, tile: int, which: list | None) -> np.ndarray:
    out: list[int] = []
    cache = [0] * (1 << cache_bits)
    cached = 0  # pixels that the cache has seen
    across = (width + (1 << tile) - 1) >> tile
    while len(out) < n:
        at = len(out)
        green, red, blue, alpha, distance = codes[which[(at // width >> tile) * across + (at % width >> tile)] if which else 0]
        s = green.read(r)
        if s < LITERALS:
            rr = red.read(r)
            bb = blue.read(r)
            out.append(alpha.read(r) << 24 | rr << 16 | s << 8 | bb)
        elif s < LITERALS + LENGTHS:
            length = _number(r, s - LITERALS)
            d = _distance(_number(r, distance.read(r)), width)
            if d > at or at + length > n:
                raise ValueError("back-reference out of bounds")
            for _ in range(length):
                out.append(out[-d])
        else:
            for p in out[cached:]:
                cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits] = p
            cached = at
            out.append(cache[s - LITERALS - LENGTHS])
        if r.at > 8 * len(r.data):
            raise ValueError("image data ends early")
    return np.array(out, dtype=np.uint32)


def _windows(data: np.ndarray, bits: int) -> np.ndarray:
    """The next ``bits`` bits (at most 16) from each bit of all bytes but the last two."""
    wide = data.astype(np.uint32)
    wide = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16
    out = np.empty((wide.size, 8), dtype=np.uint16)
    for k in range(8):
        np.bitwise_and(wide >> k, (1 << bits) - 1, out=out[:, k], casting="unsafe")
    return out.ravel()


def _read_pixels(r: _Reader, n: int, codes: list, cache_bits: int, chunk: int = 1 << 16) -> np.ndarray | None:
    """Images of literals and cache indices alone: the bits that a pixel would take are looked up from every bit of
    ``chunk`` bytes at a time, and these jumps are walked. None, with nothing read, where back-references occur."""
    channels = codes[:4]  # green, red, blue, alpha
    data = np.frombuffer(r.data, dtype=np.uint8)
    at, done, values, keys = r.at, 0, [], []
    while done < n:
        base = at >> 3
        size = min(chunk, len(r.data) - 16 - base)
        if size <= 0:
            raise ValueError("image data ends early")
        peeks = _windows(data[base : base + size + 14], 15)  # four codes take at most 60 bits
        symbols = channels[0].array[peeks & ((1 << channels[0].width) - 1)]
        took = [c.array_bits.astype(np.uint8)[peeks & ((1 << c.width) - 1)] for c in channels]
        ends = np.arange(8 * size, dtype=np.int32) + took[0][: 8 * size]
        only = took[0][: 8 * size].copy()
        for own in took[1:]:
            ends += own[ends]
        literal = symbols[: 8 * size] < LITERALS
        only[literal] = (ends - np.arange(8 * size, dtype=np.int32))[literal]
        only[~literal & (symbols[: 8 * size] < LITERALS + LENGTHS)] = 0
        jump, p, end = only.tobytes(), at - 8 * base, 8 * size
        steps: list[int] = []
        add = steps.append
        while p < end and (j := jump[p]):
            add(p)
            p += j
        if len(steps) > n - done:  # the walk went on behind the image
            p = steps[n - done]
            del steps[n - done :]
        elif len(steps) < n - done and p < end:
            return None
        start = np.array(steps, dtype=np.int64)
        green = symbols[start]
        hit = green >= LITERALS + LENGTHS
        here, value = start[~hit], np.zeros(start.size, dtype=np.uint32)
        own = green[~hit] << 8
        for k, shift in ((1, 16), (2, 0), (3, 24)):
            here = here + took[k - 1][here]
            own |= channels[k].array[peeks[here] & ((1 << channels[k].width) - 1)] << shift
        value[~hit] = own
        values.append(value)
        keys.append(np.where(hit, green - LITERALS - LENGTHS, -1))
        done += start.size
        at = p + 8 * base
    pixels, key = np.concatenate(values), np.concatenate(keys)
    if at > 8 * (len(r.data) - 16) + 7:
        raise ValueError("image data ends early")
    if (key >= 0).any():
        literal = key < 0
        key[literal] = _cache_keys(pixels[literal], cache_bits)
        order = np.argsort(key, kind="stable")
        last = np.maximum.accumulate(np.where(literal[order], np.arange(n), -1))  # the last literal, of any key
        if (last < 0).any() or (key[order][last] != key[order]).any():
            return None  # an index of the cache that no literal has filled
        pixels[order] = pixels[order][last]
    r.at = at
    return pixels


def _cache_keys(pixels: np.ndarray, bits: int) -> np.ndarray:
    return ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)


def _read_grey(r: _Reader, width: int, n: int, codes: list) -> np.ndarray:
    """Images in which only green varies: literals are found by jumps, back-references one by one."""
    green, red, blue, alpha, distance = codes
    rest = alpha.single << 24 | red.single << 16 | blue.single
    if green.single is not None and green.single < LITERALS:
        return np.full(n, rest | green.single << 8, dtype=np.uint32)
    data = np.frombuffer(r.data, dtype=np.uint8)
    begin = r.at >> 3
    width_bits = max(green.width, 8 if n < 512 else 10 if n < 8192 else 12)
    count, bits, symbols = _literal_table(green, width_bits)
    peeks = _windows(data[begin:], width_bits)
    jump = bits[peeks].tobytes()
    p, end = r.at - 8 * begin, 8 * (len(r.data) - 16 - begin)
    out = np.empty(n + 64, dtype=np.uint8)
    done = 0
    while done < n:
        steps: list[int] = []
        add = steps.append
        while p < end and (j := jump[p]):
            add(p)
            p += j
        found = peeks[steps] if steps else peeks[:0]
        have = count[found]
        literals = symbols[found][np.arange(symbols.shape[1]) < have[:, None]][: n - done]
        out[done : done + literals.size] = literals
        done += literals.size
        if done >= n:  # the walk went on to the end of the data: step back to the image's last literal
            before = np.cumsum(have, dtype=np.int64) - have
            last = int(np.searchsorted(before, literals.size, side="left")) - 1
            r.at = steps[last] + 8 * begin
            for _ in range(literals.size - int(before[last])):
                green.read(r)
            break
        if p >= end:
            raise ValueError("image data ends early")
        r.at = p + 8 * begin
        s = green.read(r)
        if s < LITERALS:  # a literal longer than the table's rest: cannot be, as the table is as wide as the code
            raise AssertionError("literal without jump")
        length = _number(r, s - LITERALS)
        d = _distance(_number(r, distance.read(r)), width)
        if d > done or done + length > n:
            raise ValueError("back-reference out of bounds")
        if d >= length:
            out[done : done + length] = out[done - d : done - d + length]
        else:
            out[done : done + length] = np.resize(out[done - d : done], length)
        done += length
        p = r.at - 8 * begin
    return out[:n].astype(np.uint32) << 8 | np.uint32(rest)


def _literal_table(code: _Code, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By the next ``width`` bits: how many whole literals they hold (up to 4), their bits, the literals."""
    now = np.arange(1 << width)
    left = np.full(now.size, width)
    mask = (1 << code.width) - 1
    count, bits = np.zeros(now.size, dtype=np.uint8), np.zeros(now.size, dtype=np.uint8)
    symbols = np.zeros((now.size, 4), dtype=np.uint8)
    good = np.ones(now.size, dtype=bool)
    for k in range(4):
        s, n = code.array[now & mask], code.array_bits[now & mask]
        good &= (n <= left) & (s < LITERALS)
        symbols[:, k] = s & 255
        count += good
        bits += np.where(good, n, 0).astype(np.uint8)
        now, left = now >> n, left - n
    return count, bits, symbols


# ---------------------------------------------------------------- transforms


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4): blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, dtype="<u4").view(np.uint8).reshape(-1, 4)


def _joined(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, dtype=np.uint8).view("<u4").ravel()


def _add_green(pixels: np.ndarray, sign: int = 1) -> np.ndarray:
    c = _channels(pixels).copy()
    green = c[:, 1].copy()
    for k in (0, 2):
        c[:, k] = c[:, k] + green if sign > 0 else c[:, k] - green
    return _joined(c)


def _tiles(width: int, height: int, bits: int, elements: np.ndarray) -> np.ndarray:
    """The element of each pixel's tile."""
    across = (width + (1 << bits) - 1) >> bits
    return elements[((np.arange(height) >> bits)[:, None] * across + (np.arange(width) >> bits)[None, :]).ravel()]


def _uncross(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, sign: int = 1) -> np.ndarray:
    e = _channels(_tiles(width, height, bits, elements)).view(np.int8).astype(np.int32)
    c = _channels(pixels).copy()
    signed = lambda x: x.view(np.int8).astype(np.int32)
    green, red_before = signed(c[:, 1].copy()), signed(c[:, 2].copy())
    c[:, 2] = (c[:, 2] + sign * (e[:, 0] * green >> 5)) & 255
    red = signed(c[:, 2].copy()) if sign > 0 else red_before
    c[:, 0] = (c[:, 0] + sign * ((e[:, 1] * green >> 5) + (e[:, 2] * red >> 5))) & 255
    return _joined(c)


def _unpalette(pixels: np.ndarray, width: int, height: int, bits: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> 8 & 255).astype(np.int64)
    if bits:
        each = 8 >> bits
        index = (index[:, None] >> (each * np.arange(1 << bits)) & ((1 << each) - 1)).reshape(height, -1)[:, :width].ravel()
    table = np.zeros(256, dtype=np.uint32)
    table[: colours.size] = colours
    return table[index]


def _half(a: tuple, b: tuple) -> tuple:
    return tuple((x + y) >> 1 for x, y in zip(a, b, strict=True))


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _guess(mode: int, left: tuple, top: tuple, corner: tuple, right: tuple) -> tuple:
    """The predicted pixel from its left, top, top left and top right neighbours."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return _half(_half(left, right), top)
    if mode == 6:
        return _half(left, corner)
    if mode == 7:
        return _half(left, top)
    if mode == 8:
        return _half(corner, top)
    if mode == 9:
        return _half(top, right)
    if mode == 10:
        return _half(_half(left, corner), _half(top, right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return tuple(_clamp(x + t - c) for x, t, c in zip(left, top, corner, strict=True))
    if mode == 13:
        return tuple(_clamp(m + int((m - c) / 2)) for m, c in zip(_half(left, top), corner, strict=True))
    return (0, 0, 0, 255)


def _predict_all(values: list, width: int, modes: list, inverse: bool) -> list:
    """Adds predictions to residuals, or takes them from pixels. Tuples are (blue, green, red, alpha)."""
    full = [] if inverse else values
    out = []
    for i, v in enumerate(values):
        x = i % width
        if i == 0:
            guess = (0, 0, 0, 255)
        elif i < width:
            guess = full[i - 1]
        elif x == 0:
            guess = full[i - width]
        else:
            guess = _guess(modes[i], full[i - 1], full[i - width], full[i - width - 1], full[i - width + 1])
        sign = 1 if inverse else -1
        made = tuple((a + sign * b) & 255 for a, b in zip(v, guess, strict=True))
        out.append(made)
        if inverse:
            full.append(made)
    return out


def _sum_up(pixels: np.ndarray, width: int, height: int, mode: int) -> np.ndarray:
    """Inverse of one mode everywhere, left (1) or top (2): running sums. The edges lead to the first pixel."""
    c = _channels(pixels).reshape(height, width, 4).copy()
    c[0, 0, 3] = int(c[0, 0, 3]) + 255 & 255
    edge = c[:, 0] if mode == 1 else c[0]
    edge[:] = np.cumsum(edge, axis=0, dtype=np.uint8)
    return _joined(np.cumsum(c, axis=2 - mode, dtype=np.uint8))


def _unpredict(pixels: np.ndarray, width: int, height: int, bits: int, elements: np.ndarray, inverse: bool = True) -> np.ndarray:
    if inverse and elements.size and (elements == elements[0]).all() and (mode := int(elements[0] >> 8 & 15)) in (1, 2):
        return _sum_up(pixels, width, height, mode)
    modes = (_tiles(width, height, bits, elements) >> 8 & 15).tolist()
    values = [tuple(c) for c in _channels(pixels).tolist()]
    return _joined(np.array(_predict_all(values, width, modes, inverse), dtype=np.uint8))


# ---------------------------------------------------------------- encoder


def _riff(w: _Writer, body: bytes = b"") -> bytes:
    """The file around image data; ``body`` continues the writer's last byte."""
    data = b"\x2f" + (w.value.to_bytes((w.at + 7) // 8, "little") if not body else body)
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def _head(w: _Writer, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("image sides must be 1 to 16384")
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)


def encode(pixels: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache_bits: int = 0, references: bool = True, tile_bits: int = 3, groups: int = 1) -> bytes:
    """Any image with the parts of the format asked for; ``cross``: green to red, green to blue, red to blue.
    ``groups``: prefix code groups, dealt to tiles in turn. Meant for small images and tests."""
    height, width = pixels.shape
    w = _Writer()
    _head(w, width, height)
    flat, now = pixels.astype(np.uint32).ravel(), width
    across = lambda n: (n + (1 << tile_bits) - 1) >> tile_bits
    if palette:
        colours = np.unique(flat)
        if colours.size > 256:
            raise ValueError("a palette holds 256 colours")
        w.put(0b111, 3)
        w.put(colours.size - 1, 8)
        steps = np.diff(_channels(colours).astype(np.int16), axis=0, prepend=0)
        _write_image(w, _joined((steps & 255).astype(np.uint8)), colours.size, 0, True, False)
        index = np.searchsorted(colours, flat).reshape(height, width)
        bits = 3 if colours.size <= 2 else 2 if colours.size <= 4 else 1 if colours.size <= 16 else 0
        flat, now = _bundle(index, bits)
    if predictor is not None:
        w.put(0b001, 3)
        w.put(tile_bits - 2, 3)
        modes = np.full(across(now) * across(height), 255 << 24 | predictor << 8, dtype=np.uint32)
        _write_image(w, modes, across(now), 0, True, False)
        flat = _unpredict(flat, now, height, tile_bits, modes, inverse=False)
    if cross is not None:
        w.put(0b011, 3)
        w.put(tile_bits - 2, 3)
        to_red, to_blue, red_blue = (x & 255 for x in cross)
        elements = np.full(across(now) * across(height), 255 << 24 | red_blue << 16 | to_blue << 8 | to_red, dtype=np.uint32)
        _write_image(w, elements, across(now), 0, True, False)
        flat = _uncross(flat, now, height, tile_bits, elements, sign=-1)
    if subtract_green:
        w.put(0b101, 3)
        flat = _add_green(flat, -1)
    w.put(0, 1)
    _write_image(w, flat, now, cache_bits, references, True, groups, tile_bits)
    return _riff(w)


def _bundle(index: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Palette indices as green samples, several in one where the palette is small."""
    height, width = index.shape
    now = (width + (1 << bits) - 1) >> bits
    each = 8 >> bits
    wide = np.zeros((height, now << bits), dtype=np.uint32)
    wide[:, :width] = index
    green = (wide.reshape(-1, 1 << bits) << (each * np.arange(1 << bits, dtype=np.uint32))).sum(axis=1).astype(np.uint32)
    return green << 8 | np.uint32(255 << 24), now


def _tokens(flat: list[int], cache_bits: int, references: bool) -> list[tuple]:
    """("l", pixel), ("c", cache index, pixel) or ("r", length, distance) at positions."""
    out, seen, cache = [], {}, {}
    i, n = 0, len(flat)

    def learn(p: int) -> None:
        if cache_bits:
            cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits] = p

    while i < n:
        length, j = 0, seen.get(tuple(flat[i : i + 3])) if references and i + 3 <= n else None
        if j is not None:
            while i + length < n and length < 4096 and flat[j + length] == flat[i + length]:
                length += 1
        if length >= 3:
            out.append((i, "r", length, i - j))
        else:
            length = 1
            k = (CACHE_FACTOR * flat[i] & 0xFFFFFFFF) >> 32 - cache_bits if cache_bits else 0
            out.append((i, "c", k, 0) if cache_bits and cache.get(k) == flat[i] else (i, "l", flat[i], 0))
        for at in range(i, i + length):
            learn(flat[at])
            seen[tuple(flat[at : at + 3])] = at
        i += length
    return out


def _write_image(w: _Writer, pixels: np.ndarray, width: int, cache_bits: int, references: bool, main: bool, groups: int = 1, tile_bits: int = 3) -> None:
    flat = [int(p) for p in pixels]
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    across = (width + (1 << tile_bits) - 1) >> tile_bits
    which = lambda i: ((i // width >> tile_bits) * across + (i % width >> tile_bits)) % groups
    groups = min(groups, across * ((-(-len(flat) // width) + (1 << tile_bits) - 1) >> tile_bits))
    if main:
        w.put(1 if groups > 1 else 0, 1)
        if groups > 1:
            w.put(tile_bits - 2, 3)
            down = (-(-len(flat) // width) + (1 << tile_bits) - 1) >> tile_bits
            _write_image(w, np.array([255 << 24 | (t % groups) << 8 for t in range(across * down)], dtype=np.uint32), across, 0, True, False)
    tokens = _tokens(flat, cache_bits, references)
    counts: list[list[dict]] = [[{} for _ in range(5)] for _ in range(groups)]

    def parts(kind: str, a: int, b: int):
        """(code, symbol, extra bits, value) of a token."""
        if kind == "l":
            yield from ((0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0))
        elif kind == "c":
            yield (0, LITERALS + LENGTHS + a, 0, 0)
        else:
            p, extra, value = prefix_of(a)
            yield (0, LITERALS + p, extra, value)
            p, extra, value = prefix_of(b + len(NEIGHBOURS))
            yield (4, p, extra, value)

    for i, kind, a, b in tokens:
        for c, s, _, _ in parts(kind, a, b):
            own = counts[which(i)][c]
            own[s] = own.get(s, 0) + 1
    sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = []
    for g in counts:
        codes.append([])
        for own, alphabet in zip(g, sizes, strict=True):
            lengths = code_lengths(own or {0: 1}, 15)
            lengths = _write_lengths(w, lengths, alphabet)
            codes[-1].append({s: (0, 0) for s in lengths} if len(lengths) == 1 else canonical(lengths))
    for i, kind, a, b in tokens:
        for c, s, extra, value in parts(kind, a, b):
            w.put(*codes[which(i)][c][s])
            w.put(value, extra)


def _write_lengths(w: _Writer, lengths: dict[int, int], alphabet: int) -> dict[int, int]:
    """Writes a code; a lone symbol that the short form cannot name gets a companion."""
    if len(lengths) == 1 and next(iter(lengths)) >= 256:
        lengths = {0: 1, next(iter(lengths)): 1}
    _write_code(w, lengths, alphabet)
    return lengths


def encode_grey(samples: bytes, width: int, least_line: int = 24) -> bytes:
    """Samples as the green channel, in rows of ``width``. At most 16 different values go through a palette that packs
    samples; otherwise lines (ended by byte 10) met before become back-references, or the samples are predicted from
    their left or top neighbour, whichever is shortest by its entropy. With one channel and one code a colour cache and
    the transforms across colours could save nothing. All steps work on whole arrays."""
    b = np.frombuffer(samples, dtype=np.uint8)
    height, now = b.size // width, width
    counts = np.bincount(b, minlength=256)
    w = _Writer()
    _head(w, width, height)
    if np.count_nonzero(counts) <= 16:
        colours = np.flatnonzero(counts).astype(np.uint32)
        w.put(0b111, 3)
        w.put(colours.size - 1, 8)
        steps = np.diff(_channels(colours << 8 | np.uint32(255 << 24)).astype(np.int16), axis=0, prepend=0)
        _write_image(w, _joined((steps & 255).astype(np.uint8)), colours.size, 0, False, False)
        bits = 3 if colours.size <= 2 else 2 if colours.size <= 4 else 1
        green, now = _bundle(np.searchsorted(colours, b).reshape(height, width), bits)
        b = (green >> 8 & 255).astype(np.uint8)
        counts = np.bincount(b, minlength=256)
        references = []
    else:
        references = _line_references(samples, least_line)
    alpha = 255
    pieces, at = [], 0
    for start, length, _ in references:
        pieces.append(b[at:start])
        at = start + length
    pieces.append(b[at:])
    literals = np.concatenate(pieces) if references else b
    if references:
        counts = np.bincount(literals, minlength=256)
    if now == width and (best := _paying_predictor(b.reshape(height, width), _cost(counts) + 4 * len(references))):
        mode, b = best
        tile = 9
        w.put(0b001, 3)
        w.put(tile - 2, 3)
        across, down = (n + (1 << tile) - 1 >> tile for n in (width, height))
        _write_image(w, np.full(across * down, 255 << 24 | mode << 8, dtype=np.uint32), across, 0, True, False)
        counts, references, pieces, alpha = np.bincount(b, minlength=256), [], [b], 0
    w.put(0, 3)  # no further transform, no cache, one group
    own = {int(s): int(counts[s]) for s in np.flatnonzero(counts)}
    far: dict[int, int] = {}
    for _, length, d in references:
        p = LITERALS + prefix_of(length)[0]
        own[p] = own.get(p, 0) + 1
        p = prefix_of(d + len(NEIGHBOURS))[0]
        far[p] = far.get(p, 0) + 1
    green = _write_lengths(w, code_lengths(own, 12), LITERALS + LENGTHS)
    for alone in (0, 0, alpha):
        _write_code(w, {alone: 1}, LITERALS)
    distance = _write_lengths(w, code_lengths(far or {0: 1}, 12), DISTANCES)
    if len(green) == 1:
        return _riff(w)
    codes, far_codes = canonical(green), {s: (0, 0) for s in distance} if len(distance) == 1 else canonical(distance)
    code, bits = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
    for s, (c, n) in codes.items():
        if s < 256:
            code[s], bits[s] = c, n
    if references:
        values, sizes = [], []
        for piece, ref in zip(pieces, [*references, None], strict=True):
            values.append(code[piece])
            sizes.append(bits[piece])
            if ref is not None:
                p, extra, value = prefix_of(ref[1])
                c, n = codes[LITERALS + p]
                q, extra2, value2 = prefix_of(ref[2] + len(NEIGHBOURS))
                c2, n2 = far_codes[q]
                values.append(np.array([c | value << n, c2 | value2 << n2], dtype=np.uint64))
                sizes.append(np.array([n + extra, n2 + extra2]))
        value, size = np.concatenate(values), np.concatenate(sizes)
    else:
        value, size = code[b], bits[b]
    return _riff(w, _pack_bits(w, value, size))


def encode_cached(samples: bytes, width: int, most: float = float("inf"), cache_bits: int = 10) -> bytes | None:
    """Samples, four to a pixel (blue, green, red, alpha), in rows of ``width`` pixels: literals, and indices of a colour
    cache wherever it holds the pixel. None if that would take ``most`` bytes or more by its entropy."""
    pixels = np.frombuffer(samples, dtype="<u4")
    key = _cache_keys(pixels, cache_bits)
    order = np.argsort(key.astype(np.uint16), kind="stable")  # of so few bits a radix sort
    hit = np.zeros(pixels.size, dtype=bool)
    hit[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    blue, green, red, alpha = _channels(pixels).T
    green = np.where(hit, LITERALS + LENGTHS + key, green)
    sizes = (LITERALS + LENGTHS + (1 << cache_bits), LITERALS, LITERALS, LITERALS)
    streams = (green, red, blue, alpha)
    counts = [np.bincount(x if k == 0 else x[~hit], minlength=n) for k, (x, n) in enumerate(zip(streams, sizes, strict=True))]
    if sum(_cost(c) for c in counts) + 30 >= most:
        return None
    w = _Writer()
    _head(w, width, pixels.size // width)
    w.put(0, 1)  # no transform
    w.put(1, 1)
    w.put(cache_bits, 4)
    w.put(0, 1)  # one group
    value, size = [], []
    for x, c, n in zip(streams, counts, sizes, strict=True):
        lengths = _write_lengths(w, code_lengths({int(s): int(c[s]) for s in np.flatnonzero(c)}, 15), n)
        code, bits = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
        for s, (v, k) in ({} if len(lengths) == 1 else canonical(lengths)).items():
            code[s], bits[s] = v, k
        value.append(code[x])
        size.append(bits[x])
    _write_code(w, {0: 1}, DISTANCES)
    for k in (1, 2, 3):
        value[k][hit], size[k][hit] = 0, 0
    # two codes of at most 15 bits each are written as one value
    pairs = [value[a] | value[a + 1] << size[a].astype(np.uint64) for a in (0, 2)]
    total = np.column_stack([size[0] + size[1], size[2] + size[3]]).ravel()
    return _riff(w, _pack_bits(w, np.column_stack(pairs).ravel(), total)) if total.any() else _riff(w)


def _cost(counts: np.ndarray) -> float:
    """Bytes of so many symbols by their entropy, and about what their code's description takes."""
    n = counts[counts > 0]
    return float((n * np.log2(n.sum() / n)).sum()) / 8 + 0.6 * n.size


def _paying_predictor(rows: np.ndarray, cost: float) -> tuple[int, np.ndarray] | None:
    """The mode (left or top) and residuals that take less than ``cost`` with its own overhead, if there is one."""
    best, out = cost - 16, None
    left = np.diff(rows, axis=1, prepend=np.uint8(0))
    left[:, 0] = np.diff(rows[:, 0], prepend=np.uint8(0))
    top = np.diff(rows, axis=0, prepend=np.uint8(0))
    top[0] = np.diff(rows[0], prepend=np.uint8(0))
    for mode, residual in ((1, left.ravel()), (2, top.ravel())):
        if (need := _cost(np.bincount(residual, minlength=256))) < best:
            best, out = need, (mode, residual)
    return out


def _pack_bits(w: _Writer, value: np.ndarray, size: np.ndarray) -> bytes:
    """The writer's bits, then each value in its size (at most 32 bits)."""
    ends = np.cumsum(size)
    begin = w.at & 31
    at = ends - size + begin
    word, shift = at >> 5, (at & 31).astype(np.uint64)
    shifted = value << shift
    n = int(ends[-1] + begin + 31 >> 5) + 1
    words = np.bincount(word, weights=(shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    words[1:] += np.bincount(word, weights=(shifted >> np.uint64(32)).astype(np.float64), minlength=n)[: n - 1]
    body = words.astype(np.uint64).astype("<u4")
    kept = w.at >> 5 << 2
    head = w.value.to_bytes((w.at >> 3) + 8, "little")
    body[0] |= np.uint32(int.from_bytes(head[kept : kept + 4], "little"))
    return head[:kept] + body.tobytes()[: -(-(int(ends[-1]) + begin) // 8)]


def _line_references(samples: bytes, least: int) -> list[tuple[int, int, int]]:
    """(start, length, distance) of lines met before, in pieces of at most 4096."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    for line in samples.split(b"\n"):
        n = len(line)
        if n >= least:
            before = seen.get(line)
            if before is not None:
                out.extend((at + k, min(4096, n - k), at - before) for k in range(0, n, 4096))
            seen[line] = at
        at += n + 1
    return out
