"""A slow decoder of lossless WebP, written from the format's specification alone: one bit and one pixel at a time."""

ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]


class Bits:
    def __init__(self, data):
        self.bits = [byte >> k & 1 for byte in data for k in range(8)]
        self.at = 0

    def __call__(self, n):
        out = 0
        for k in range(n):
            out |= self.bits[self.at] << k
            self.at += 1
        return out


class Prefix:
    """A dictionary from bit strings to symbols."""

    def __init__(self, lengths):
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        self.codes, code = {}, 0
        for n in range(1, 16):
            for s in used:
                if lengths[s] == n:
                    self.codes[f"{code:0{n}b}"] = s
                    code += 1
            code *= 2

    def read(self, bits):
        if self.only is not None:
            return self.only
        seen = ""
        while seen not in self.codes:
            seen += str(bits(1))
            assert len(seen) < 16
        return self.codes[seen]


def read_prefix(bits, size):
    lengths = [0] * size
    if bits(1):
        two = bits(1)
        lengths[bits(8) if bits(1) else bits(1)] = 1
        if two:
            lengths[bits(8)] = 1
        return Prefix(lengths)
    first = [0] * 19
    for k in range(4 + bits(4)):
        first[ORDER[k]] = bits(3)
    code = Prefix(first)
    left = 2 + bits(2 + 2 * bits(3)) if bits(1) else size
    s, last = 0, 8
    while s < size and left > 0:
        left -= 1
        c = code.read(bits)
        if c < 16:
            lengths[s], last, s = c, c or last, s + 1
        elif c == 16:
            for _ in range(3 + bits(2)):
                lengths[s], s = last, s + 1
        else:
            s += 3 + bits(3) if c == 17 else 11 + bits(7)
    return Prefix(lengths)


def value(bits, prefix):
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits(extra) + 1


def image(bits, width, height, main, neighbours):
    cache_bits = bits(4) if bits(1) else 0
    tile, table = 0, None
    if main and bits(1):
        tile = bits(3) + 2
        across = -(-width // 2**tile)
        table = [p >> 8 & 0xFFFF for p in image(bits, across, -(-height // 2**tile), False, neighbours)]
    groups = []
    for _ in range(max(table) + 1 if table else 1):
        groups.append([read_prefix(bits, n) for n in (256 + 24 + (2**cache_bits if cache_bits else 0), 256, 256, 256, 40)])
    out, cache = [], {}

    def put(p):
        out.append(p)
        if cache_bits:
            cache[(0x1E35A7BD * p % 2**32) >> (32 - cache_bits)] = p

    while len(out) < width * height:
        x, y = len(out) % width, len(out) // width
        g = groups[table[(y >> tile) * across + (x >> tile)] if table else 0]
        s = g[0].read(bits)
        if s < 256:
            red, blue, alpha = (g[k].read(bits) for k in (1, 2, 3))
            put(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < 280:
            n = value(bits, s - 256)
            d = value(bits, g[4].read(bits))
            if d > 120:
                d -= 120
            else:
                dx, dy = neighbours[d - 1]
                d = max(1, dx + dy * width)
            for _ in range(n):
                put(out[len(out) - d])
        else:
            put(cache.get(s - 280, 0))
    return out


def channels(p):
    return [p >> k & 255 for k in (24, 16, 8, 0)]


def pixel(c):
    return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]


def each(f, *pixels):
    return pixel([f(*c) for c in zip(*map(channels, pixels), strict=True)])


def average(a, b):
    return each(lambda x, y: (x + y) // 2, a, b)


def clamp(x):
    return min(255, max(0, x))


def half_up(a, b):
    """Division truncates towards zero."""
    d = a - b
    return clamp(a + (d // 2 if d >= 0 else -(-d // 2)))


def predicted(mode, L, T, TR, TL):
    if mode == 11:
        p = [a + b - c for a, b, c in zip(channels(L), channels(T), channels(TL), strict=True)]
        far = [sum(abs(a - b) for a, b in zip(p, channels(q), strict=True)) for q in (L, T)]
        return L if far[0] < far[1] else T
    return {
        0: lambda: 0xFF000000, 1: lambda: L, 2: lambda: T, 3: lambda: TR, 4: lambda: TL, 5: lambda: average(average(L, TR), T), 6: lambda: average(L, TL), 7: lambda: average(L, T),
        8: lambda: average(TL, T), 9: lambda: average(T, TR), 10: lambda: average(average(L, TL), average(T, TR)),
        12: lambda: each(lambda a, b, c: clamp(a + b - c), L, T, TL), 13: lambda: each(half_up, average(L, T), TL),
    }.get(mode, lambda: 0xFF000000)()


def signed(x):
    return x - 256 if x > 127 else x


def decode(data, neighbours):
    """Rows of 0xAARRGGBB. ``neighbours``: the format's table of short distances."""
    assert data[:4] == b"RIFF" and data[8:16] == b"WEBPVP8L" and data[20] == 0x2F
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")] + bytes(8))
    width, height = bits(14) + 1, bits(14) + 1
    bits(1)
    assert bits(3) == 0
    steps, w = [], width
    while bits(1):
        kind = bits(2)
        if kind < 2:
            tile = bits(3) + 2
            steps.append((kind, w, tile, image(bits, -(-w // 2**tile), -(-height // 2**tile), False, neighbours)))
        elif kind == 2:
            steps.append((kind, w))
        else:
            n = bits(8) + 1
            table = image(bits, n, 1, False, neighbours)
            for i in range(1, n):
                table[i] = each(lambda a, b: (a + b) % 256, table[i - 1], table[i])
            pack = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
            steps.append((kind, w, pack, table))
            w = -(-w // pack)
    px = image(bits, w, height, True, neighbours)
    for kind, w, *more in reversed(steps):
        new = []
        for i in range(w * height):
            x, y = i % w, i // w
            if kind < 2:
                tile, table = more
                e = table[(y >> tile) * -(-w // 2**tile) + (x >> tile)]
            if kind == 0:
                if i == 0:
                    p = 0xFF000000
                elif y == 0:
                    p = new[i - 1]
                elif x == 0:
                    p = new[i - w]
                else:
                    p = predicted(e >> 8 & 255, new[i - 1], new[i - w], new[i - w + 1], new[i - w - 1])
                new.append(each(lambda a, b: (a + b) % 256, px[i], p))
            elif kind == 1:
                a, r, g, b = channels(px[i])
                _, red_blue, green_blue, green_red = channels(e)
                r = (r + (signed(green_red) * signed(g) >> 5)) % 256
                b = (b + (signed(green_blue) * signed(g) >> 5) + (signed(red_blue) * signed(r) >> 5)) % 256
                new.append(pixel([a, r, g, b]))
            elif kind == 2:
                a, r, g, b = channels(px[i])
                new.append(pixel([a, (r + g) % 256, g, (b + g) % 256]))
            else:
                pack, table = more
                v = px[y * -(-w // pack) + x // pack] >> 8 & 255
                k = v >> (8 // pack * (x % pack)) & ((1 << 8 // pack) - 1)
                new.append(table[k] if k < len(table) else 0)
        px = new
    return [px[y * width : (y + 1) * width] for y in range(height)]
