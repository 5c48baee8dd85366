"""Adaptive range coder for token ids, predictions of order 0 to 2 mixed, many blocks in step."""

from __future__ import annotations

import zlib

import numpy as np

#: Ids of a block. Every block starts from the same state and has its own checksums.
BLOCK = 4096
_SLOTS = 10
_CLASSES = 18
MAX_ID = (1 << _CLASSES) - 2
#: At these places of a block its statistics are brought up to date, and at those of _REBUILD order 0 as well.
_UPDATE = (32, 64, 128, 256, 384, 512, 768, *range(1024, BLOCK, 512))
_REBUILD = (32, 64, 128, 256, 512, 1024, 2048, 3072)
_HISTORY = 2048
_STATES, _PASTS = 32, 4
_FULL, _WORD, _LEAST = 65536, 65536.0, float(1 << 32)
_NOVEL, _FINE = 8 * _CLASSES, 1 << 14
_HASH = 0x9E3779B1

# logistic tables in fixed point: stretch of a 12-bit probability, squash of -2047..2047
_P = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.rint(np.clip(256 * np.log(_P / (1 - _P)), -2047, 2047)).astype(np.int32)
_SQUASH = np.clip(np.rint(4096 / (1 + np.exp(-np.arange(-2047, 2048) / 256))), 8, 4064).astype(np.int32)
_WIDTH = np.zeros(1 << _CLASSES, np.uint8)
for _k in range(_CLASSES):
    _WIDTH[1 << _k : 2 << _k] = _k
#: Of a new id's symbol (magnitude and next three bits): the plain bits after it, 14 less those, its first id, its weight at a block's start.
_PLAIN = np.maximum(np.arange(_NOVEL) // 8 - 3, 0)
_UNIT = (14 - _PLAIN).astype(np.int32)
_FIRST = np.array([(1 << k) + (j << max(k - 3, 0)) - 1 for k in range(_CLASSES) for j in range(8)], np.int32)
_WEIGHT = np.array([4 if 8 <= k < 16 else 1 for k in range(_CLASSES) for _ in range(8)], np.int64)


class _Statistics:
    """The shared state of coder and decoder for as many blocks as there are lanes, fixed between two places of _UPDATE.

    Order 2 and order 1 each predict the id that followed last, with a
    confidence of 0 to 3. Whether order 2 is right is estimated by two
    adaptive tables (one by confidences and agreement, one by the last two
    outcomes) that a logistic mixer with weights of its own per lane
    combines; whether order 1 is, by one table. What they leave goes to
    order 0, in which an id has the share it had in the block's last
    _HISTORY ids, and to ids that are not among those.
    """

    def __init__(self, n: int):
        # of 2^16, lanes last: order 2 by state and by the last outcomes, order 1 by state
        by = np.arange(_STATES)
        self.n = n
        self.a = np.repeat((np.array([200, 1600, 2600, 3400], np.int32) << 4)[by >> 3], n).reshape(_STATES, 1, n)
        self.b = np.repeat(np.array([12, 15, 15, 20], np.int32) << 10, n).reshape(1, _PASTS, n)
        self.c = np.repeat((np.array([200, 1000, 1800, 2600], np.int32) << 4)[by >> 1 & 3], n).reshape(_STATES, 1, n)
        self.w = np.repeat(np.array([3 << 14, 1 << 14], np.int32), n).reshape(2, n)
        self.novel = np.full(n, _FULL - 8192, np.int32)
        self.seen = np.zeros((n, _NOVEL), np.int64)
        self.cuts = np.zeros((_STATES, _PASTS, n), np.int32)
        self.mix(n)

    def mix(self, m: int) -> None:
        """cuts[state, past, lane]: of 2^16, where order 2 ends, times 2^16, plus where order 1 ends; the least 2048 before new ids are left to order 0."""
        self.sa, self.sb = _STRETCH.take(self.a[..., :m] >> 4), _STRETCH.take(self.b[..., :m] >> 4)
        mixed = (self.w[0, :m] * self.sa + self.w[1, :m] * self.sb) >> 16
        self.p = _SQUASH.take(np.clip(mixed, -2047, 2047) + 2047)
        room = _FULL - 2048 - self.novel[:m]
        two = np.minimum(self.p << 4, room - 256)
        one = np.maximum(1, ((_FULL - two) >> 4) * (self.c[..., :m] >> 4) >> 8)
        np.minimum(one, room - two, out=one)
        one[1::2] = 0
        one += two
        two <<= 16
        np.bitwise_or(two, one, out=self.cuts[..., :m])
        self.flat = self.cuts.reshape(-1)
        self.end = _FULL - self.novel

    def update(self, m: int, key: np.ndarray, hit: np.ndarray, new: np.ndarray) -> None:
        """key: place in cuts of each id since the last update; hit: 2, 1 or 0 by the order that was right; new: whether it was a new id. A row for each id."""

        def count(keys: np.ndarray) -> np.ndarray:
            return np.bincount(keys, minlength=self.cuts.size).reshape(self.cuts.shape)[..., :m].astype(np.int32)

        key, hit = key[:, :m].ravel(), hit[:, :m].ravel()
        counts, right, first = count(key), count(key[hit == 2]), count(key[hit == 1])
        err = ((right << 12) - counts * self.p[..., :m]) >> 6
        for w, s in zip(self.w, (self.sa, self.sb), strict=True):
            slope = (err * s[..., :m]).sum((0, 1), dtype=np.int32) >> 6
            w[:m] = np.clip(w[:m] + slope, -(1 << 17), 1 << 17)
        tries, good = counts.sum(1, keepdims=True, dtype=np.int32), right.sum(1, keepdims=True, dtype=np.int32)
        for x, hits, among, rate in (
            (self.a, good, tries, 12), (self.c, first.sum(1, keepdims=True, dtype=np.int32), tries - good, 12),
            (self.b, right.sum(0, keepdims=True, dtype=np.int32), counts.sum(0, keepdims=True, dtype=np.int32), 24)):
            x[..., :m] = np.minimum((x[..., :m] * rate + (hits << 16)) // (rate + among), 65535)
        self.novel[:m] = np.clip((self.novel[:m] * 24 + new[:, :m].sum(0, dtype=np.int32) * _FULL) // (24 + len(new)), 512, _FULL - 8192)

    def symbols(self, m: int) -> np.ndarray:
        """Cumulative frequencies, of 1024, of the symbols of new ids: a row a lane."""
        weight = self.seen[:m] * 8 + _WEIGHT
        share = 1 + (1024 - _NOVEL) * weight // weight.sum(1, keepdims=True)
        share[:, _NOVEL - 64] += 1024 - share.sum(1)
        out = np.zeros((m, _NOVEL + 1), np.int64)
        np.cumsum(share, axis=1, out=out[:, 1:])
        return out

    def meet(self, lanes: np.ndarray, symbol: np.ndarray) -> None:
        self.seen += np.bincount(lanes * _NOVEL + symbol, minlength=self.seen.size).reshape(self.seen.shape)


class _Contexts:
    """What followed the last id, and the last two, by hashed slots of each lane: id * 4 + confidence."""

    def __init__(self, n: int):
        self.t1, self.t2 = np.zeros(n << _SLOTS, np.int32), np.zeros(n << _SLOTS, np.int32)
        self.base = np.arange(n, dtype=np.int64) << _SLOTS
        self.q, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.past = np.zeros(n, np.int32)
        self.n, self.lane = n, np.arange(n, dtype=np.int32)
        self.m = -1

    def lanes(self, m: int) -> None:
        """Work on the first m lanes from now on."""
        if m == self.m:
            return
        self.m = m
        self.q, self.last, self.past, self.base, self.lane = (x[:m] for x in (self.q, self.last, self.past, self.base, self.lane))
        self.i1, self.i2 = np.empty(m, np.int64), np.empty(m, np.int64)
        self.v1, self.v2, self.c1, self.c2, self.f1, self.f2, self.x = (np.empty(m, np.int32) for _ in range(7))
        self.same, self.hit1, self.hit2 = np.empty(m, bool), np.empty(m, bool), np.empty(m, bool)

    def predict(self, key: np.ndarray) -> None:
        """The candidates c2 and c1; into key, the place in the table of cuts."""
        i1, i2, x = self.i1, self.i2, self.x
        np.right_shift(self.q, 22, out=i1)
        i1 &= (1 << _SLOTS) - 1
        i1 += self.base
        np.right_shift(self.last, 7, out=i2)
        i2 += self.q
        i2 >>= 19
        i2 &= (1 << _SLOTS) - 1
        i2 += self.base
        self.t1.take(i1, out=self.v1, mode="clip")
        self.t2.take(i2, out=self.v2, mode="clip")
        np.right_shift(self.v1, 2, out=self.c1)
        np.right_shift(self.v2, 2, out=self.c2)
        np.bitwise_and(self.v1, 3, out=self.f1)
        np.bitwise_and(self.v2, 3, out=self.f2)
        np.equal(self.c1, self.c2, out=self.same)
        np.left_shift(self.f2, 2, out=x)
        x += self.f1
        x <<= 1
        x += self.same
        x <<= 2
        x += self.past
        x *= self.n
        np.add(x, self.lane, out=key)

    def learn(self, s: np.ndarray) -> None:
        x, four = self.x, s << 2
        self.past &= 1
        self.past <<= 1
        for f, c, y, table, i in ((self.f2, self.c2, self.hit2, self.t2, self.i2), (self.f1, self.c1, self.hit1, self.t1, self.i1)):
            np.equal(c, s, out=y)
            np.add(f, 1, out=x)
            np.minimum(x, 3, out=x)
            x *= y
            x += four
            table[i] = x
        self.past += self.hit2
        self.q, self.last = self.last, self.q
        np.multiply(s, _HASH, out=self.q, dtype=np.int64)


def _spans(sizes: np.ndarray):
    """(start, stop, [(start, stop, lanes)...]) between places of _UPDATE, cut where lanes end; sizes descend."""
    width = int(sizes[0]) if len(sizes) else 0
    places = [0, *(p for p in _UPDATE if p < width), width] if width else []
    ends = np.unique(sizes)
    for x, y in zip(places, places[1:], strict=False):
        cuts = [x, *(int(e) for e in ends if x < e < y), y]
        yield x, y, [(i, j, int(np.searchsorted(-sizes, -i, "left"))) for i, j in zip(cuts, cuts[1:], strict=False) if j > i]


def _alive(sizes: np.ndarray, t: int) -> int:
    """Lanes with an id at place t."""
    return int(np.searchsorted(-sizes, -t, "left"))


def _symbol(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol of a new id and its plain bits."""
    e = ids.astype(np.int64) + 1
    k = _WIDTH[e].astype(np.int64)
    left = e - (1 << k)
    plain = np.maximum(k - 3, 0)
    return k * 8 + (left >> plain), left & ((1 << plain) - 1)


def _scatter(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """values of each row put at the places at of it."""
    out = np.empty(values.size, values.dtype)
    out[(at + np.arange(len(at))[:, None] * at.shape[1]).ravel()] = values.ravel()
    return out.reshape(values.shape)


def _ranks(rows: np.ndarray) -> np.ndarray:
    """Of each id of each row (a block), the number of lesser ones among the row's distinct ids; transposed."""
    n, width = rows.shape
    out = np.empty((width, n), np.int16)
    for i in range(0, n if width else 0, 256):
        keys = (rows[i : i + 256].astype(np.uint32) << np.uint32(12)) | np.arange(width, dtype=np.uint32)
        keys.sort(axis=1)
        at = (keys & np.uint32(4095)).astype(np.int64)
        keys >>= np.uint32(12)
        rank = np.zeros(keys.shape, np.int16)
        np.cumsum(keys[:, 1:] != keys[:, :-1], axis=1, out=rank[:, 1:])
        out[:, i : i + 256] = _scatter(at, rank).T
    return out


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids as bytes: number of ids, crc32 of the ids and of the code (all little-endian 32-bit), code."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order], np.int64)
    n = len(blocks)
    width = int(sizes[0]) if n else 0
    rows = np.zeros((n, width), np.int32)
    for col, i in enumerate(order):
        if len(blocks[i]) and int(blocks[i].max()) > MAX_ID:
            raise ValueError(f"id over {MAX_ID}")
        rows[col, : len(blocks[i])] = blocks[i]
    ranks = _ranks(rows)
    grid = np.ascontiguousarray(rows.T)
    stats, contexts = _Statistics(n), _Contexts(n)
    span, at, room = np.full(n, float(1 << 48)), np.zeros(n, np.int64), 2 * width + 8
    # sums of what is to stand in each 16-bit word; carries are settled at the end
    out = np.zeros((n, room), np.int32)
    # the history's counts of ids below each rank
    counts, below = np.zeros((n, width), np.int32), np.zeros((n, width + 1), np.int32)
    counted, shift, cumulative = 0, 0, stats.symbols(n)

    for x, y, parts in _spans(sizes):
        m = parts[0][2]
        if x in _REBUILD:
            count, lanes = counts.reshape(-1), np.arange(m, dtype=np.int64) * width
            for t in range(counted, x):
                count[ranks[t, :m] + lanes] += 1
            for t in range(max(0, counted - _HISTORY), x - _HISTORY):
                count[ranks[t, :m] + lanes] -= 1
            counted = x
            np.cumsum(counts[:m], axis=1, out=below[:m, 1:])
            shift, cumulative = min(x, _HISTORY).bit_length() - 1, stats.symbols(m)
        ids = grid[x:y, :m]
        key, hit = np.zeros((y - x, m), np.int32), np.zeros((y - x, m), np.int8)
        for i, j, alive in parts:
            contexts.lanes(alive)
            for t in range(i, j):
                s = grid[t, :alive]
                contexts.predict(key[t - x, :alive])
                contexts.learn(s)
                np.add(contexts.hit2, contexts.hit2, out=hit[t - x, :alive], dtype=np.int8)
                np.maximum(hit[t - x, :alive], contexts.hit1, out=hit[t - x, :alive])
        cut = stats.flat.take(key)
        two, one = cut >> 16 & 0xFFFF, cut & 0xFFFF
        if x < _REBUILD[0]:
            lo, hi = np.zeros(ids.shape, np.int32), (ids == 0).astype(np.int32)
        else:
            place = ranks[x:y, :m] + np.arange(m, dtype=np.int64) * (width + 1)
            lo, hi = below.reshape(-1)[place], below.reshape(-1)[place + 1]
        new = (lo == hi) & (hit == 0)
        share = stats.end[:m] - one
        start = one + (share * lo >> shift)
        stop = one + (share * hi >> shift)
        start[new], stop[new] = np.broadcast_to(stats.end[:m], new.shape)[new], _FULL
        np.copyto(start, 0, where=hit == 2)
        np.copyto(stop, two, where=hit == 2)
        np.copyto(start, two, where=hit == 1)
        np.copyto(stop, one, where=hit == 1)
        first, size = start.astype(np.float64), (stop - start).astype(np.float64)
        lines, lanes = np.nonzero(new)
        symbol, bits = _symbol(ids[lines, lanes])
        bounds = np.searchsorted(lines, np.arange(y - x + 1))
        base = cumulative[lanes, symbol]
        part = (cumulative[lanes, symbol + 1] - base) << (14 - _PLAIN[symbol])
        base, part = (base * _FINE + bits * part).astype(np.float64), part.astype(np.float64)
        # the code is the sum of value * 2^-16^word: a value for each id, and one more for each new id
        value, word = np.zeros((y - x, m)), np.zeros((y - x, m), np.int64)
        more, there = np.empty(len(lanes)), np.empty(len(lanes), np.int64)
        origin, grow, short = at[:m].copy(), np.empty(m), np.empty(m, bool)
        for i, j, alive in parts:
            sp, w, grow, short = span[:alive], at[:alive], grow[:alive], short[:alive]
            for t in range(i - x, j - x):
                r = value[t, :alive]
                np.multiply(sp, 1 / _WORD, out=r)
                np.floor(r, out=r)
                np.multiply(r, size[t, :alive], out=sp)
                word[t, :alive] = w
                np.less(sp, _LEAST, out=short)
                w += short
                np.multiply(short, _WORD - 1, out=grow)
                grow += 1
                sp *= grow
                k, stop_k = bounds[t], bounds[t + 1]
                stop_k = k + np.searchsorted(lanes[k:stop_k], alive) if alive < m else stop_k
                if k < stop_k:
                    who = lanes[k:stop_k]
                    s = np.floor(sp.take(who) * (1 / 1024 / _FINE))
                    v = w.take(who)
                    more[k:stop_k], there[k:stop_k] = s, v
                    s *= part[k:stop_k]
                    while (less := s < _LEAST).any():
                        v += less
                        s *= less * (_WORD - 1) + 1
                    sp[who], w[who] = s, v
        value *= first
        word -= origin
        used = int((at[:m] - origin).max()) + 1
        word += np.arange(m) * used
        real = np.arange(x, y)[:, None] < sizes[:m]
        late = real[lines, lanes]
        sums = np.bincount(word[real], value[real], m * used) + np.bincount((there - origin[lanes] + lanes * used)[late], (more * base)[late], m * used)
        sums = sums.astype(np.int64).reshape(m, used)
        thirds = np.zeros((m, used + 2), np.int32)
        thirds[:, :-2] = sums >> 32
        thirds[:, 1:-1] += (sums >> 16 & 0xFFFF).astype(np.int32)
        thirds[:, 2:] += (sums & 0xFFFF).astype(np.int32)
        out.reshape(-1)[(origin + np.arange(m) * room)[:, None] + np.arange(used + 2)] += thirds
        m = _alive(sizes, y)
        if m:
            stats.meet(lanes, symbol)
            stats.update(m, key, hit, new)
            stats.mix(m)
    at += 3
    out = out[:, : int(at.max()) if n else 0].copy()
    while (carry := out >> 16).any():
        out &= 0xFFFF
        out[:, :-1] += carry[:, 1:]
    result: list[bytes] = [b""] * n
    for col, i in enumerate(order):
        code = out[col, : at[col]].astype("<u2").tobytes()
        ids = np.ascontiguousarray(blocks[i], "<u4").tobytes()
        result[i] = np.array([len(blocks[i]), zlib.crc32(ids), zlib.crc32(code)], "<u4").tobytes() + code
    return result


def _history(grid: np.ndarray, shift: int) -> np.ndarray:
    """Each lane's sorted ids: id * 2^26 + the place of its first * 2^13 + the place after its last, a flat row of 2^shift a lane."""
    size = 1 << shift
    ids = grid.T.copy()
    ids.sort(axis=1)
    edge = np.ones(ids.shape, bool)
    np.not_equal(ids[:, 1:], ids[:, :-1], out=edge[:, 1:])
    runs = np.flatnonzero(edge)
    length = np.diff(runs, append=ids.size)
    first = runs & (size - 1)
    return np.repeat((ids.ravel()[runs].astype(np.int64) << 26) | (first << 13) | (first + length), length)


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each coded block; a block whose code or ids fail their checksum is a ValueError naming it."""
    n = len(blocks)
    heads = [np.frombuffer(b, "<u4", 3) for b in blocks]
    for i, (b, h) in enumerate(zip(blocks, heads, strict=True)):
        if zlib.crc32(b[12:]) != int(h[2]):
            raise ValueError(f"block {i}: code checksum")
    order = sorted(range(n), key=lambda i: -int(heads[i][0]))
    sizes = np.array([int(heads[i][0]) for i in order], np.int64)
    width = int(sizes[0]) if n else 0
    grid = np.zeros((width, n), np.int32)
    words = [(len(blocks[i]) - 12) // 2 for i in order]
    base = np.append(0, np.cumsum(np.array(words, np.int64) + 4))
    feed = np.zeros(int(base[-1]) + 1)
    for col, i in enumerate(order):
        feed[base[col] : base[col] + words[col]] = np.frombuffer(blocks[i], "<u2", offset=12)
    at, span = base[:-1] + 3, np.full(n, float(1 << 48))
    code = (feed[base[:-1]] * _WORD + feed[base[:-1] + 1]) * _WORD + feed[base[:-1] + 2]
    stats, contexts = _Statistics(n), _Contexts(n)
    shift, past = 0, (np.int64(1) | np.zeros(n, np.int64))

    def table() -> np.ndarray:
        """For each of 1024 values of each lane: the symbol, where it begins times 2^8, and its frequency times 2^18."""
        cumulative = stats.symbols(m)
        often = np.diff(cumulative, axis=1)
        packed = np.arange(_NOVEL) | (cumulative[:, :-1] << 8) | (often << 18)
        return np.repeat(packed.astype(np.int32).ravel(), often.ravel())

    m = n
    named = table()
    for x, y, parts in _spans(sizes):
        m = parts[0][2]
        if x in _REBUILD:
            shift = min(x, _HISTORY).bit_length() - 1
            past = _history(grid[x - (1 << shift) : x, :m], shift)
            named = table()
        key, hit, new = np.zeros((y - x, m), np.int32), np.zeros((y - x, m), np.int8), np.zeros((y - x, m), bool)
        met: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j, alive in parts:
            contexts.lanes(alive)
            co, sp, w, end = code[:alive], span[:alive], at[:alive], stats.end[:alive]
            row, last = np.arange(alive, dtype=np.int64) << shift, (1 << shift) - 1
            r, q, word = np.empty(alive), np.empty(alive), np.empty(alive)
            cut, two, one, v, share = (np.empty(alive, np.int32) for _ in range(5))
            place, found, z = np.empty(alive, np.int64), np.empty(alive, np.int64), np.empty(alive, np.int64)
            full = np.full(alive, _FULL, np.int32)
            is2, is1, short = np.empty(alive, bool), np.empty(alive, bool), np.empty(alive, bool)
            for t in range(i, j):
                kt, s, fresh = key[t - x, :alive], grid[t, :alive], new[t - x, :alive]
                contexts.predict(kt)
                stats.flat.take(kt, out=cut, mode="clip")
                np.right_shift(cut, 16, out=two)
                two &= 0xFFFF
                np.bitwise_and(cut, 0xFFFF, out=one)
                np.multiply(sp, 1 / _WORD, out=r)
                np.floor(r, out=r)
                np.divide(co, r, out=q)
                np.copyto(v, q, casting="unsafe")
                np.less(v, two, out=is2)
                np.less(v, one, out=is1)
                np.greater_equal(v, end, out=fresh)
                # the place in the history
                np.subtract(end, one, out=share)
                v -= one
                v += 1
                v <<= shift
                v -= 1
                np.divide(v, share, out=q)
                np.maximum(q, 0, out=q)
                np.minimum(q, last, out=q)
                np.copyto(place, q, casting="unsafe")
                place += row
                past.take(place, out=found, mode="clip")
                np.right_shift(found, 26, out=z)
                np.copyto(s, z, casting="unsafe")
                found &= (1 << 26) - 1
                hi = found.astype(np.int32)
                lo = hi >> 13
                hi &= 8191
                lo *= share
                lo >>= shift
                lo += one
                hi *= share
                hi >>= shift
                hi += one
                lo, hi = np.where(is1, two, lo), np.where(is1, one, hi)
                lo, hi = np.where(fresh, end, lo), np.where(fresh, full, hi)
                lo *= ~is2
                hi = np.where(is2, two, hi)
                s[:] = np.where(is2, contexts.c2, np.where(is1, contexts.c1, s))
                hi -= lo
                np.multiply(r, lo, out=q)
                co -= q
                np.multiply(r, hi, out=sp)
                np.less(sp, _LEAST, out=short)
                feed.take(w, out=word, mode="clip")
                w += short
                word *= short
                np.multiply(short, _WORD - 1, out=q)
                q += 1
                sp *= q
                co *= q
                co += word
                who = np.flatnonzero(fresh)
                if len(who):
                    c, b, k = co.take(who), sp.take(who), w.take(who)
                    rr = np.floor(b * (1 / 1024 / _FINE))
                    u = (c / rr).astype(np.int32)
                    symbol = named.take((who << 10) + (u >> 14))
                    edge = (symbol >> 8 & 1023) << 14
                    often = symbol >> 18
                    symbol &= 255
                    part = often << _UNIT.take(symbol)
                    bits = ((u - edge) / part).astype(np.int32)
                    s[who] = _FIRST.take(symbol) + bits
                    c -= rr * (edge + bits * part)
                    b = rr * part
                    while (less := b < _LEAST).any():
                        grow = less * (_WORD - 1) + 1
                        c = c * grow + feed.take(k) * less
                        b *= grow
                        k += less
                    co[who], sp[who], w[who] = c, b, k
                    met.append((who, symbol))
                contexts.learn(s)
                hit[t - x, :alive] = np.where(is2, 2, is1)
        m = _alive(sizes, y)
        if m:
            if met:
                stats.meet(np.concatenate([a for a, _ in met]), np.concatenate([b for _, b in met]))
            stats.update(m, key, hit, new)
            stats.mix(m)
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    rows = np.ascontiguousarray(grid.T).astype("<u4")
    for col, i in enumerate(order):
        out[i] = rows[col, : sizes[col]]
        if zlib.crc32(out[i].tobytes()) != int(heads[i][1]):
            raise ValueError(f"block {i}: ids checksum")
    return out
