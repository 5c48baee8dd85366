"""Lossless WebP (VP8L): a decoder that takes many images in step, and an encoder."""

from __future__ import annotations

import numpy as np

#: The order of code length codes, and the neighbourhood of short distance codes (x, y).
_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
_NEAR_X, _NEAR_Y = np.array(_NEAR, np.int64).T
_HASH = np.uint32(0x1E35A7BD)
_REV15 = sum(((np.arange(1 << 15) >> i) & 1) << (14 - i) for i in range(15)).astype(np.int32)
U = np.uint64


class _Codes:
    """Canonical prefix codes of a kind, a row each: limits of left-aligned 15-bit values by length, and symbols in code order."""

    def __init__(self, lengths: np.ndarray):
        n, size = lengths.shape
        used = np.count_nonzero(lengths, axis=1)
        count = np.zeros((n, 16), np.int64)
        np.add.at(count, (np.repeat(np.arange(n), size), lengths.ravel()), 1)
        count[:, 0] = 0
        weight = (count * (1 << (15 - np.arange(16)))).sum(axis=1)
        if ((weight != 1 << 15) & (used > 1)).any() or (used == 0).any():
            raise ValueError("incomplete prefix code")
        # shorter codes first, then by symbol; unused symbols last
        key = np.where(lengths == 0, 99, lengths)
        self.symbols = np.argsort(key, axis=1, kind="stable").astype(np.int32)
        self.limit = np.cumsum(count << (15 - np.arange(16)), axis=1).astype(np.int32)
        self.first = (self.limit - (count << (15 - np.arange(16)))).astype(np.int32)
        self.offset = (np.cumsum(count, axis=1) - count).astype(np.int32)
        one = used == 1
        self.limit[one] = 1 << 15
        self.first[one] = 0
        self.offset[one] = 0
        self.width = size
        self.flat = self.symbols.ravel()
        # a code's length is the number of limits that its value reaches; all reach the first, none the last ones
        self.lo = int((self.limit > 0).any(axis=0).argmax())
        self.steps = [np.ascontiguousarray(self.limit[:, k].astype(np.uint16)) for k in range(self.lo, 16) if (self.limit[:, k] < 1 << 15).any()]


class _Streams:
    def __init__(self, blobs: list[bytes]):
        sizes = np.array([len(b) for b in blobs], np.int64)
        start = np.append(0, np.cumsum(sizes + 8))
        raw = np.zeros(int(start[-1]) + 8, np.uint8)
        for b, s in zip(blobs, start, strict=False):
            raw[s : s + len(b)] = np.frombuffer(b, np.uint8)
        wide = np.zeros(len(raw) - 7, U)
        for k in range(8):
            wide |= raw[k : len(raw) - 7 + k].astype(U) << U(8 * k)
        self.wide, self.pos, self.end = wide, start[:-1] * 8, (start[:-1] + sizes) * 8

    def peek(self, lanes) -> np.ndarray:
        p = self.pos[lanes]
        return self.wide[np.minimum(p >> 3, len(self.wide) - 1)] >> (p & 7).astype(U)

    def read(self, lanes: np.ndarray, n) -> np.ndarray:
        v = (self.peek(lanes) & ((U(1) << np.asarray(n, U)) - U(1))).astype(np.int64)
        self.pos[lanes] += n
        return v

    def symbol(self, lanes: np.ndarray, codes: _Codes, row: np.ndarray) -> np.ndarray:
        v = _REV15[(self.peek(lanes) & U(0x7FFF)).astype(np.int64)]
        small, length = v.astype(np.uint16), np.full(len(v), codes.lo, np.int64)
        for step in codes.steps:
            length += small >= step[row]
        at = codes.offset[row, length] + ((v - codes.first[row, length]) >> (15 - length))
        self.pos[lanes] += length
        return codes.flat[row * codes.width + at]

    def lengths(self, lanes: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Code lengths of one prefix code per lane; size: its alphabet there."""
        out = np.zeros((len(lanes), int(size.max())), np.int64)
        simple = self.read(lanes, 1) == 1
        s = np.flatnonzero(simple)
        if len(s):
            two = self.read(lanes[s], 1)
            eight = self.read(lanes[s], 1)
            out[s, self.read(lanes[s], np.where(eight, 8, 1))] = 1
            t = s[two == 1]
            if len(t):
                out[t, self.read(lanes[t], 8)] = 1
        s = np.flatnonzero(~simple)
        if not len(s):
            return out
        some, count = lanes[s], 4 + self.read(lanes[s], 4)
        own = np.zeros((len(s), 19), np.int64)
        for k in range(19):
            have = np.flatnonzero(count > k)
            own[have, _ORDER[k]] = self.read(some[have], 3)
        codes = _Codes(own)
        left = size[s].copy()
        cap = np.flatnonzero(self.read(some, 1))
        if len(cap):
            left[cap] = 2 + self.read(some[cap], 2 + 2 * self.read(some[cap], 3))
        at, last = np.zeros(len(s), np.int64), np.full(len(s), 8, np.int64)
        live = np.arange(len(s))
        while len(live := live[(at[live] < size[s][live]) & (left[live] > 0)]):
            got = self.symbol(some[live], codes, live)
            left[live] -= 1
            plain = got < 16
            i = live[plain]
            out[s[i], at[i]] = got[plain]
            at[i] += 1
            nz = i[got[plain] > 0]
            last[nz] = out[s[nz], at[nz] - 1]
            for code, bits, base in ((16, 2, 3), (17, 3, 3), (18, 7, 11)):
                i = live[got == code]
                if not len(i):
                    continue
                n = base + self.read(some[i], bits)
                if (at[i] + n > size[s][i]).any():
                    raise ValueError("code lengths run over the alphabet")
                for lane, m in zip(i, n, strict=True):
                    if code == 16:
                        out[s[lane], at[lane] : at[lane] + m] = last[lane]
                    at[lane] += m
        return out

    def image(self, lanes: np.ndarray, w: np.ndarray, h: np.ndarray, main: bool) -> list[np.ndarray]:
        """Pixels (uint32 ARGB) of one entropy-coded image per lane."""
        n = len(lanes)
        cache = np.zeros(n, np.int64)
        c = np.flatnonzero(self.read(lanes, 1))
        if len(c):
            cache[c] = self.read(lanes[c], 4)
            if ((cache[c] < 1) | (cache[c] > 11)).any():
                raise ValueError("colour cache size")
        groups, maps, shift = np.ones(n, np.int64), None, np.zeros(n, np.int64)
        if main and len(g := np.flatnonzero(self.read(lanes, 1))):
            shift[g] = 2 + self.read(lanes[g], 3)
            sub = self.image(lanes[g], -(-w[g] >> shift[g]), -(-h[g] >> shift[g]), False)
            each = {int(i): ((x >> np.uint32(8)) & np.uint32(0xFFFF)).astype(np.int64) for i, x in zip(g, sub, strict=True)}
            for i, x in each.items():
                groups[i] = x.max() + 1
            at = np.cumsum([len(each[i]) if i in each else 1 for i in range(n)])
            maps = (np.concatenate([each.get(i, np.zeros(1, np.int64)) for i in range(n)]), np.append(0, at[:-1]))
        base = np.append(0, np.cumsum(groups))[:-1]
        rows = [[] for _ in range(5)]
        where = []
        for k in range(int(groups.max())):
            some = np.flatnonzero(groups > k)
            where.append(base[some] + k)
            for kind, size in enumerate((280 + np.where(cache[some] > 0, 1 << cache[some], 0), 256, 256, 256, 40)):
                rows[kind].append(self.lengths(lanes[some], np.broadcast_to(size, len(some))))
        codes, place = [], np.argsort(np.concatenate(where))
        for kind in range(5):
            wide = max(r.shape[1] for r in rows[kind])
            codes.append(_Codes(np.concatenate([np.pad(r, ((0, 0), (0, wide - r.shape[1]))) for r in rows[kind]])[place]))
        green, red, blue, alpha, dist = codes
        still = [(x.limit[:, 0] > 0).all() for x in codes]  # codes of one symbol take no bits
        total = w * h
        start = np.append(0, np.cumsum(total))
        out = np.zeros(int(start[-1]), np.uint32)
        slots = np.zeros((n, 1 << int(cache.max())) if cache.any() else (0, 0), np.uint32)
        at, copy, back = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)
        live, copying, cached = np.flatnonzero(total > 0), False, bool(cache.any())

        def amount(some: np.ndarray, code: np.ndarray) -> np.ndarray:
            extra = np.maximum(0, (code - 2) >> 1)
            more = self.read(lanes[some], extra)
            return np.where(code < 4, code + 1, ((2 + (code & 1)) << extra) + more + 1)

        while len(live):
            if copying:
                busy = copy[live] > 0
                fresh, moving = live[~busy], live[busy]
                copying = bool(len(moving))
            else:
                fresh, moving = live, live[:0]
            done = []
            if len(fresh):
                if maps is None:
                    row = base[fresh]
                else:
                    x, y = at[fresh] % w[fresh], at[fresh] // w[fresh]
                    cell = np.where(groups[fresh] > 1, (y >> shift[fresh]) * (-(-w[fresh] >> shift[fresh])) + (x >> shift[fresh]), 0)
                    row = base[fresh] + maps[0][maps[1][fresh] + cell]
                s = self.symbol(lanes[fresh], green, row)
                plain = s < 256
                if plain.all():
                    lit, lr, ls = fresh, row, s
                else:
                    lit, lr, ls = fresh[plain], row[plain], s[plain]
                    jump = np.flatnonzero((s >= 256) & (s < 280))
                    if len(jump):
                        some = fresh[jump]
                        copy[some] = amount(some, s[jump] - 256)
                        d = amount(some, self.symbol(lanes[some], dist, row[jump]).astype(np.int64))
                        near = np.minimum(d, 120) - 1
                        back[some] = np.where(d > 120, d - 120, np.maximum(1, _NEAR_X[near] + _NEAR_Y[near] * w[some]))
                        if (back[some] > at[some]).any() or (copy[some] > total[some] - at[some]).any():
                            raise ValueError("back-reference out of the image")
                        copying = True
                    hit = np.flatnonzero(s >= 280)
                    if len(hit):
                        some = fresh[hit]
                        out[start[some] + at[some]] = slots[some, s[hit] - 280]
                        done.append(some)
                if len(lit):
                    r = self.symbol(lanes[lit], red, lr)
                    b = self.symbol(lanes[lit], blue, lr)
                    a = alpha.flat[lr * alpha.width] if still[3] else self.symbol(lanes[lit], alpha, lr)
                    out[start[lit] + at[lit]] = (a.astype(np.uint32) << np.uint32(24)) | (r.astype(np.uint32) << np.uint32(16)) | (ls.astype(np.uint32) << np.uint32(8)) | b.astype(np.uint32)
                    done.append(lit)
            if len(moving):
                p = start[moving] + at[moving]
                out[p] = out[p - back[moving]]
                copy[moving] -= 1
                done.append(moving)
            for some in done:
                if cached and len(k := some[cache[some] > 0]):
                    v = out[start[k] + at[k]]
                    slots[k, (v * _HASH) >> (32 - cache[k]).astype(np.uint32)] = v
                at[some] += 1
            if (at[live] >= total[live]).any():
                live = live[at[live] < total[live]]
                if (self.pos[lanes] > self.end[lanes]).any():
                    raise ValueError("the data end early")
        if (self.pos[lanes] > self.end[lanes]).any():
            raise ValueError("the data end early")
        return [out[a:b] for a, b in zip(start, start[1:], strict=False)]


def _channels(px: np.ndarray) -> np.ndarray:
    return np.stack([(px >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _pixels(ch: np.ndarray) -> np.ndarray:
    c = (ch & 255).astype(np.uint32)
    return (c[..., 0] << np.uint32(24)) | (c[..., 1] << np.uint32(16)) | (c[..., 2] << np.uint32(8)) | c[..., 3]


def _predictions(left, top, right, corner) -> np.ndarray:
    """All 14 predictions (modes first) from the neighbours' channels."""
    half = lambda a, b: (a + b) >> 1
    p = left + top - corner
    pl, pt = np.abs(p - left).sum(axis=-1, keepdims=True), np.abs(p - top).sum(axis=-1, keepdims=True)
    mean = half(left, top)
    black = np.zeros_like(left)
    black[..., 0] = 255
    toward = np.clip(mean + np.trunc((mean - corner) / 2).astype(np.int64), 0, 255)
    return np.stack([
        black, left, top, right, corner, half(half(left, right), top), half(left, corner), mean, half(corner, top), half(top, right),
        half(half(left, corner), half(top, right)), np.where(pl < pt, left, top), np.clip(left + top - corner, 0, 255), toward])


def _walk_predictor(px: list[np.ndarray], w: np.ndarray, h: np.ndarray, bits: np.ndarray, modes: list[np.ndarray], inverse: bool) -> list[np.ndarray]:
    """Add (or take off) predictions for many images, pixel by pixel in step."""
    n, most = len(px), int((w * h).max())
    src = np.zeros((n, most, 4), np.int64)
    for i, x in enumerate(px):
        src[i, : len(x)] = _channels(x)
    out = np.zeros_like(src)
    known = out if inverse else src
    lane = np.arange(n)
    for t in range(most):
        live = lane[t < w * h]
        x, y = t % w[live], t // w[live]
        mode = np.array([(int(modes[i][(yy >> bits[i]) * -(-int(w[i]) >> int(bits[i])) + (xx >> bits[i])]) >> 8) & 15 for i, xx, yy in zip(live, x, y, strict=True)])
        mode = np.where(y == 0, np.where(x == 0, 0, 1), np.where(x == 0, 2, np.where(mode > 13, 0, mode)))
        near = [known[live, np.maximum(t - back, 0)] for back in (1, w[live], w[live] - 1, w[live] + 1)]
        guess = _predictions(*near)[mode, np.arange(len(live))]
        out[live, t] = (src[live, t] + (guess if inverse else -guess)) & 255
    return [_pixels(out[i, : len(x)]) for i, x in enumerate(px)]


def _spread(cells: np.ndarray, w: int, h: int, bits: int) -> np.ndarray:
    grid = cells.reshape(-(-h >> bits), -(-w >> bits))
    return np.repeat(np.repeat(grid, 1 << bits, axis=0)[:h], 1 << bits, axis=1)[:, :w].ravel()


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def _cross(px: np.ndarray, cells: np.ndarray, w: int, h: int, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1) or take off (-1) what red owes to green, and blue to green and red."""
    c, m = _channels(px), _channels(_spread(cells, w, h, bits))
    before = c[:, 1].copy()
    c[:, 1] += sign * ((_signed(m[:, 3]) * _signed(c[:, 2])) >> 5)
    c[:, 3] += sign * ((_signed(m[:, 2]) * _signed(c[:, 2])) >> 5)
    c[:, 3] += sign * ((_signed(m[:, 1]) * _signed(c[:, 1] if sign > 0 else before)) >> 5)
    return _pixels(c)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _riff(body: bytes) -> bytes:
    body += b"\0" * (len(body) & 1)
    size = len(body)
    return b"RIFF" + (size + 12).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + body


def split_files(data: bytes) -> list[bytes]:
    """The WebP files that follow each other in data, by their RIFF sizes."""
    out, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 12] != b"WEBP" or at + 8 + size > len(data):
            raise ValueError("not a RIFF WebP file")
        out.append(data[at : at + 8 + size])
        at += 8 + size
    return out


def decode_images(files: list[bytes]) -> list[np.ndarray]:
    """The pixels (height x width, uint32 ARGB) of lossless WebP files. Broken files are a ValueError."""
    blobs = []
    for f in files:
        if f[:4] != b"RIFF" or f[8:16] != b"WEBPVP8L" or len(f) < 25:
            raise ValueError("not a lossless WebP file")
        blobs.append(f[20 : 20 + int.from_bytes(f[16:20], "little")])
    if not blobs:
        return []
    s, lanes = _Streams(blobs), np.arange(len(blobs))
    if (s.read(lanes, 8) != 0x2F).any():
        raise ValueError("not a lossless WebP stream")
    w, h = 1 + s.read(lanes, 14), 1 + s.read(lanes, 14)
    s.read(lanes, 1)
    if s.read(lanes, 3).any():
        raise ValueError("unknown version")
    width, steps = w.copy(), [[] for _ in blobs]
    live = lanes
    while len(live := live[s.read(live, 1) == 1]):
        kind = s.read(live, 2)
        for k in range(4):
            some = live[kind == k]
            if not len(some):
                continue
            if any(x[0] == k for i in some for x in steps[i]):
                raise ValueError("a transform comes twice")
            if k == 2:
                for i in some:
                    steps[i].append((k, 0, 0, None))
            elif k == 3:
                size = 1 + s.read(some, 8)
                for i, n, table in zip(some, size, s.image(some, size, np.ones(len(some), np.int64), False), strict=True):
                    colours = _pixels(np.cumsum(_channels(table), axis=0))
                    steps[i].append((k, _packing(int(n)), int(width[i]), colours))
                    width[i] = -(-int(width[i]) >> _packing(int(n)))
            else:
                bits = 2 + s.read(some, 3)
                for i, b, cells in zip(some, bits, s.image(some, -(-width[some] >> bits), -(-h[some] >> bits), False), strict=True):
                    steps[i].append((k, int(b), int(width[i]), cells))
    px = s.image(lanes, width, h, True)
    while any(steps):
        guessed = [i for i in lanes if steps[i] and steps[i][-1][0] == 0]
        if guessed:
            last = [steps[i].pop() for i in guessed]
            for i, x in zip(guessed, _walk_predictor([px[i] for i in guessed], np.array([x[2] for x in last]), h[guessed], np.array([x[1] for x in last]), [x[3] for x in last], True), strict=True):
                px[i] = x
        for i in lanes:
            while steps[i] and steps[i][-1][0]:
                k, bits, wide, extra = steps[i].pop()
                if k == 1:
                    px[i] = _cross(px[i], extra, wide, int(h[i]), bits, 1)
                elif k == 2:
                    c = _channels(px[i])
                    c[:, 1] += c[:, 2]
                    c[:, 3] += c[:, 2]
                    px[i] = _pixels(c)
                else:
                    index = ((px[i] >> np.uint32(8)) & np.uint32(255)).reshape(int(h[i]), -1).astype(np.int64)
                    if bits:
                        each = 8 >> bits
                        index = ((index[:, :, None] >> (each * np.arange(1 << bits))) & ((1 << each) - 1)).reshape(len(index), -1)[:, :wide]
                    table = np.append(extra, np.zeros(256, np.uint32))
                    px[i] = table[index].ravel()
    return [x.reshape(int(b), int(a)) for x, a, b in zip(px, w, h, strict=True)]


def code_lengths(count: np.ndarray) -> np.ndarray:
    """Complete prefix codes of at most 15 bits for each row of counts: Shannon's lengths, then shortened where most is won until no code space is left. Rows with fewer than two symbols get a second one."""
    count = count.copy()
    row = np.arange(len(count))
    for _ in range(2):
        few = np.flatnonzero(np.count_nonzero(count, axis=1) < 2)
        count[few, count[few].argmin(axis=1)] = 1
    total = count.sum(axis=1, keepdims=True)
    used = count > 0
    length = np.where(used, np.clip(np.ceil(np.log2(total / np.maximum(count, 1)) - 1e-9), 1, 15).astype(np.int64), 0)
    while True:
        slack = (1 << 15) - np.where(used, 1 << (15 - length), 0).sum(axis=1)
        if (slack < 0).any():
            # lengths cut to 15 took too much: lengthen the rarest short codes
            bad = np.flatnonzero(slack < 0)
            pick = np.where(used[bad] & (length[bad] < 15), count[bad] * 16.0 + length[bad] * -1.0, np.inf).argmin(axis=1)
            length[bad, pick] += 1
            continue
        if not slack.any():
            return length
        won = np.where(used & (length > 1), count / (1 << (15 - length)), -1.0)
        order = np.argsort(-won, axis=1, kind="stable")
        for k in range(count.shape[1]):
            i = order[:, k]
            cost = 1 << (15 - length[row, i])
            ok = (won[row, i] >= 0) & (cost <= slack) & (length[row, i] > 1)
            if not ok.any() and k and (won[row, i] < 0).all():
                break
            length[row[ok], i[ok]] -= 1
            slack -= np.where(ok, cost, 0)


def canonical(length: np.ndarray) -> np.ndarray:
    """The codes of each row of lengths, first bit lowest."""
    n, size = length.shape
    key = np.where(length == 0, 99, length)
    order = np.argsort(key, axis=1, kind="stable")
    sorted_ = np.take_along_axis(length, order, axis=1)
    step = np.where(sorted_ > 0, 1 << (15 - sorted_), 0)
    left = np.cumsum(step, axis=1) - step
    code = np.zeros((n, size), np.int64)
    np.put_along_axis(code, order, _REV15[np.minimum(left, (1 << 15) - 1)].astype(np.int64), axis=1)
    return np.where(length > 0, code & ((1 << length) - 1), 0)


def _amount_code(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix code, number of extra bits, extra bits) of lengths and distances."""
    v = value - 1
    top = np.maximum(0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    extra = np.maximum(0, top - 1)
    code = np.where(v < 4, v, 2 * top + ((v >> np.maximum(0, top - 1)) & 1))
    return code, np.where(v < 4, 0, extra), np.where(v < 4, 0, v & ((1 << extra) - 1))


def _pack(value: np.ndarray, bits: np.ndarray, owner: np.ndarray, n: int) -> list[bytes]:
    """Fields (at most 56 bits) in order, lowest bit first, into bytes per owner; owners ascend."""
    many = np.bincount(owner, bits, n).astype(np.int64)
    words = -(-many >> 6) + 1
    base = np.append(0, np.cumsum(words))
    before = np.cumsum(bits) - bits
    at = base[:-1][owner] * 64 + before - np.append(0, np.cumsum(many))[:-1][owner]
    v, w, sh = value.astype(U), at >> 6, (at & 63).astype(U)
    out = np.zeros(int(base[-1]) + 1, U)
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, np.int64)
    if len(w):
        out[w[first]] = np.add.reduceat(v << sh, first)
        over = np.where(sh > 0, v >> ((U(64) - sh) & U(63)), U(0))
        out[w[first] + 1] += np.add.reduceat(over, first)
    raw = out.view(np.uint8)
    return [raw[8 * b : 8 * b + (-(-int(m) >> 3))].tobytes() for b, m in zip(base, many, strict=False)]


def encode_tiles(px: list[np.ndarray], w: int) -> list[bytes]:
    """Files of opaque images of one width without transforms: prefix codes of each image's own counts, and back-references for runs of a pixel."""
    n = len(px)
    if not n:
        return []
    sizes = np.array([x.size for x in px], np.int64)
    flat = np.concatenate([x.ravel() for x in px])
    owner = np.repeat(np.arange(n), sizes)
    begin = np.append(0, np.cumsum(sizes))[:-1]
    place = np.arange(len(flat)) - begin[owner]
    same = np.zeros(len(flat), bool)
    same[1:] = flat[1:] == flat[:-1]
    same &= place % 4096 > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= 4]
    keep = np.ones(len(flat), bool)
    mark = np.zeros(len(flat) + 1, np.int64)
    np.add.at(mark, runs[:, 0], 1)
    np.add.at(mark, runs[:, 1], -1)
    keep[np.cumsum(mark[:-1]) > 0] = False
    g, r, b = ((flat >> np.uint32(s)).astype(np.int64) & 255 for s in (8, 16, 0))
    code, extra, more = _amount_code(runs[:, 1] - runs[:, 0])
    ro = owner[runs[:, 0]]
    hist = [np.bincount(owner[keep] * 280 + g[keep], minlength=n * 280) + np.bincount(ro * 280 + 256 + code, minlength=n * 280), np.bincount(owner[keep] * 256 + r[keep], minlength=n * 256), np.bincount(owner[keep] * 256 + b[keep], minlength=n * 256)]
    fields: list[tuple[np.ndarray, np.ndarray]] = []
    every = np.ones(n, np.int64)

    def put(value, bits) -> None:
        fields.append((np.broadcast_to(value, n), np.broadcast_to(bits, n)))

    put(0x2F, 8), put(w - 1, 14), put(sizes // w - 1, 14), put(0, 4)
    put(0, 3)  # no transform, no cache, one group
    tables = []
    for h, size in zip(hist, (280, 256, 256), strict=True):
        length = code_lengths(h.reshape(n, size))
        tables.append((length.ravel(), canonical(length).ravel(), size))
        put(0, 1), put(15, 4)
        put(sum((0 if s > 15 else 4) << (3 * k) for k, s in enumerate(_ORDER[:18])), 54), put(4, 3)
        last = size - (length[:, ::-1] > 0).argmax(axis=1)
        put(1, 1), put(4, 3), put(last - 2, 10)
        nibble = (_REV15[np.arange(16)] >> 11).astype(np.int64)
        for k in range(0, size, 8):
            much = np.clip(last - k, 0, 8)
            part = np.zeros(n, np.int64)
            for j in range(min(8, size - k)):
                part |= np.where(j < much, nibble[length[:, k + j]] << (4 * j), 0)
            put(part, 4 * much)
    put(0b101 | 255 << 3, 11)  # alpha: 255 alone
    put(0b101 | 1 << 3, 11)  # distance: code 1 alone, the pixel before
    del every
    head = np.concatenate([np.stack([f[i] for f in fields], axis=1)[:, :, None] for i in range(2)], axis=2)
    (gl, gc, _), (rl, rc, _), (bl, bc, _) = tables
    at = np.flatnonzero(keep)
    o = owner[at]
    ig, ir, ib = o * 280 + g[at], o * 256 + r[at], o * 256 + b[at]
    literal = gc[ig] | (rc[ir] << gl[ig]) | (bc[ib] << (gl[ig] + rl[ir]))
    bits = gl[ig] + rl[ir] + bl[ib]
    jg = ro * 280 + 256 + code
    order = np.argsort(np.concatenate([at, runs[:, 0]]), kind="stable")
    body_v, body_b, body_o = np.concatenate([literal, gc[jg] | (more << gl[jg])])[order], np.concatenate([bits, gl[jg] + extra])[order], np.concatenate([o, ro])[order]
    k = head.shape[1]
    many = np.bincount(body_o, minlength=n)
    shift = np.append(0, np.cumsum(many + k))[:-1]
    v, nb, ow = np.zeros(len(body_v) + n * k, np.int64), np.zeros(len(body_v) + n * k, np.int64), np.zeros(len(body_v) + n * k, np.int64)
    spot = (shift[:, None] + np.arange(k)).ravel()
    v[spot], nb[spot], ow[spot] = head[:, :, 0].ravel(), head[:, :, 1].ravel(), np.repeat(np.arange(n), k)
    spot = np.arange(len(body_o)) + (np.arange(1, n + 1) * k)[body_o]
    v[spot], nb[spot], ow[spot] = body_v, body_b, body_o
    return [_riff(x) for x in _pack(v, nb, ow, n)]


class _Writer:
    def __init__(self):
        self.v: list[int] = []
        self.n: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.v.append(int(value))
        self.n.append(int(bits))

    def code(self, length: np.ndarray) -> None:
        """A prefix code's lengths, those over 15 of a run of zeros by run codes."""
        used = np.flatnonzero(length)
        if len(used) == 1 and used[0] < 256:
            self.put(0b101, 3), self.put(used[0], 8)
            return
        self.put(0, 1), self.put(15, 4)
        for s in _ORDER:
            self.put(0 if s in (16, 17) else 5 if s in (0, 18) else 4, 3)
        own = np.array([[0 if s in (16, 17) else 5 if s in (0, 18) else 4 for s in range(19)]])
        codes = canonical(own)[0]
        self.put(0, 1)
        k = 0
        while k < len(length):
            zeros = next((j for j in range(k, min(len(length), k + 138)) if length[j]), min(len(length), k + 138)) - k
            if zeros >= 11:
                self.put(codes[18], 5), self.put(zeros - 11, 7)
                k += zeros
            else:
                self.put(codes[length[k]], own[0, length[k]])
                k += 1

    def image(self, px: np.ndarray, w: int, main: bool, cache: int = 0, matches: bool = False) -> None:
        """Greedy: the longest match with the last place of the same three pixels, else a cache hit, else the pixel."""
        items, slots, seen, i = [], {}, {}, 0
        values = px.tolist()
        slot = lambda v: ((v * int(_HASH)) & 0xFFFFFFFF) >> (32 - cache)
        while i < len(values):
            run = 0
            j = seen.get(tuple(values[i : i + 3])) if matches else None
            if j is not None:
                while i + run < len(values) and run < 4096 and values[j + run] == values[i + run]:
                    run += 1
            v = values[i]
            if run >= 3:
                items.append(("copy", run, i - j))
            elif cache and slots.get(slot(v)) == v:
                items.append(("cache", slot(v), 0))
            else:
                items.append(("pixel", v, 0))
            for k in range(i, i + max(1, run if run >= 3 else 1)):
                if cache:
                    slots[slot(values[k])] = values[k]
                seen[tuple(values[k : k + 3])] = k
            i += run if run >= 3 else 1
        size = 280 + ((1 << cache) if cache else 0)
        hist = [np.zeros((1, s), np.int64) for s in (size, 256, 256, 256, 40)]
        near = {x + y * w: k + 1 for k, (x, y) in reversed(list(enumerate(_NEAR))) if x + y * w > 0}
        todo = []
        for kind, a, b in items:
            if kind == "copy":
                (lc, le, lm), (dc, de, dm) = ([int(x) for x in _amount_code(np.array(q))] for q in (a, near.get(b, b + 120)))
                hist[0][0, 256 + lc] += 1
                hist[4][0, dc] += 1
                todo.append((256 + lc, le, lm, dc, de, dm))
            elif kind == "cache":
                hist[0][0, 280 + a] += 1
                todo.append((280 + a,))
            else:
                todo.append(((a >> 8) & 255, (a >> 16) & 255, a & 255, a >> 24))
                for h, s in zip(hist, todo[-1], strict=False):
                    h[0, s] += 1
        self.put(1 if cache else 0, 1)
        if cache:
            self.put(cache, 4)
        if main:
            self.put(0, 1)
        length = [code_lengths(h)[0] for h in hist]
        codes = [canonical(x[None])[0] for x in length]
        for x in length:
            self.code(x)
        for t in todo:
            if len(t) == 4:
                for k, s in enumerate(t):
                    self.put(codes[k][s], length[k][s])
            else:
                self.put(codes[0][t[0]], length[0][t[0]])
                if len(t) == 6:
                    self.put(t[2], t[1]), self.put(codes[4][t[3]], length[4][t[3]]), self.put(t[5], t[4])


def encode_image(image: np.ndarray, predictor: int | None = None, cross: tuple[int, int, int] | None = None, subtract_green: bool = False, palette: bool = False, cache: int = 0, matches: bool = True, bits: int = 3) -> bytes:
    """A lossless WebP file of one image (height x width, uint32 ARGB) with the transforms asked for; predictor 14 deals modes 0 to 13 over the cells; cross: (green to red, green to blue, red to blue), signed."""
    h, w = image.shape
    px, out, wide = image.ravel().astype(np.uint32), _Writer(), w
    out.put(0x2F, 8), out.put(w - 1, 14), out.put(h - 1, 14), out.put(int((px >> np.uint32(24) != 255).any()), 1), out.put(0, 3)
    if palette:
        table, index = np.unique(px, return_inverse=True)
        if len(table) > 256:
            raise ValueError("over 256 colours")
        out.put(1, 1), out.put(3, 2), out.put(len(table) - 1, 8)
        out.image(_pixels(np.diff(_channels(table), axis=0, prepend=0)), len(table), False)
        pack = _packing(len(table))
        grid = index.reshape(h, w)
        if pack:
            each, wide = 8 >> pack, -(-w >> pack)
            grid = np.pad(grid, ((0, 0), (0, (wide << pack) - w))).reshape(h, wide, 1 << pack)
            grid = (grid << (each * np.arange(1 << pack))).sum(axis=2)
        px = (np.uint32(0xFF) << np.uint32(24)) | (grid.ravel().astype(np.uint32) << np.uint32(8))
    cells = (-(-wide >> bits)) * (-(-h >> bits))
    if predictor is not None:
        modes = (np.arange(cells) % 14 if predictor == 14 else np.full(cells, predictor)).astype(np.uint32) << np.uint32(8)
        out.put(1, 1), out.put(0, 2), out.put(bits - 2, 3)
        out.image(modes, -(-wide >> bits), False)
        px = _walk_predictor([px], np.array([wide]), np.array([h]), np.array([bits]), [modes], False)[0]
    if cross is not None:
        red, blue, both = (x & 255 for x in cross)
        mult = np.full(cells, 255 << 24 | both << 16 | blue << 8 | red, np.uint32)
        out.put(1, 1), out.put(1, 2), out.put(bits - 2, 3)
        out.image(mult, -(-wide >> bits), False)
        px = _cross(px, mult, wide, h, bits, -1)
    if subtract_green:
        out.put(1, 1), out.put(2, 2)
        c = _channels(px)
        c[:, 1] -= c[:, 2]
        c[:, 3] -= c[:, 2]
        px = _pixels(c)
    out.put(0, 1)
    out.image(px, wide, True, cache, matches)
    return _riff(_pack(np.array(out.v, np.int64), np.array(out.n, np.int64), np.zeros(len(out.v), np.int64), 1)[0])
