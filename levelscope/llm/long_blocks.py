"""Context mixing and range coding of one long block, in lanes that learn together.

The block is cut into runs of ids, a lane each, and step t handles the t-th id of every lane,
so that numpy works on thousands of ids at once. Unlike the short blocks of ``range_coder``,
lanes share one model, which after each step learns what all of them had: it knows more
sooner, is small enough to stay in a processor's cache, and what depends on the model's state
alone is worked out once a step, not once an id.

Predictions and their mix are those of ``range_coder``: the id that followed the two ids
before (order 2) and the id before (order 1), and how probable the guess is under order 0.
A logistic mix of what each of them was worth so far, with weights learned for each degree of
order 2's certainty, is the probability that the guess is right. An id that it isn't is spelt
in bytes by adaptive order-0 frequencies, the low byte given the one above; their tables are
renewed after steps 1, 2, 4 and so on, then after every ``_RENEWED``.

Bounds of a lane: 48 bits and a carry, which is added to the units before it when the block is
done. Every value that the coder uses is an integer, or a quotient below 2^16 of integers below
2^48 in double precision, whose whole part is exact; so every machine decodes alike.

Layout, little-endian: uint16 number of units of each lane, then their 16-bit units.
"""

from __future__ import annotations

import math

import numpy as np

#: Logistic function and its inverse over 12-bit probabilities, in steps of 1/256.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-(i - 2048) / 256))))) for i in range(4096)], np.int32)
STRETCH = np.array([min(2047, max(-2047, round(256 * math.log(p / (4096 - p))))) if 0 < p < 4096 else -2047 for p in range(4096)], np.int32)

#: Ids of a lane, more or less, and lanes of a block at most and at least.
_RUN, _MOST, _LEAST = 256, 8192, 16
_RENEWED = 64
#: Steps after which the mix is renewed, but for the first ones.
_MIXED = 8
#: Bits of the totals of order-0 frequencies, and what an id adds to its counts.
_BITS, _GAIN = 12, 16
_TOTAL, _PART, _ONE = 1 << _BITS, _BITS + 1, (1 << _BITS + 1) - 1
_LOG = np.array([n.bit_length() for n in range(_TOTAL + 1)])
#: Slots of order 2.
_SLOTS = 17
_LAST = (1 << _SLOTS) - 1
_WIDE, _NARROW, _LOW = 48, 1 << 32, 0xFFFFFFFF


class _Bytes:
    """Adaptive frequencies of a byte, given one of ``rows`` contexts."""

    def __init__(self, rows: int):
        self.rows = rows
        self.counts = np.ones((rows, 256), np.int64)
        self.symbols = np.tile(np.arange(256, dtype=np.uint8), rows)
        self.renew()

    def renew(self) -> None:
        own = self.counts * (_TOTAL - 256)
        own //= self.counts.sum(axis=1, keepdims=True)
        own += 1
        own[np.arange(self.rows), self.counts.argmax(axis=1)] += _TOTAL - own.sum(axis=1)
        self.freq = own.reshape(-1)
        # the frequencies below in the high bits, a byte's own in the low ones, so that one look finds both
        self.parts = ((np.cumsum(own, axis=1) - own << _PART) + own).reshape(-1).astype(np.int32)
        self.symbol = np.repeat(self.symbols, self.freq)


class _Model:
    """What all lanes of a block have learned; ``wide`` ids have 32 bits, others 16."""

    def __init__(self, wide: bool):
        self.wide = wide
        # what followed one id, then two: id + 1, a set bit, confidence 0..3; nothing known yet is 0
        self.kind = np.int64 if wide else np.int32
        self.after1, self.after2 = np.zeros((1 << 16) + 1, self.kind), np.zeros(1 << _SLOTS, self.kind)
        # bytes from the highest down; the last is given the one above
        self.levels = [_Bytes(1) for _ in range(3 if wide else 1)] + [_Bytes(256)]
        self.spelt: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        # how often a guess was right, by orders 2, 1 and 0 of (16, 8, 8) kinds of evidence
        self.tried, self.right = [np.zeros(k, np.int64) for k in (8, 8, 16)], [np.zeros(k, np.int64) for k in (8, 8, 16)]
        self.weights = np.full((3, 8), 22_000, np.int64)  # of 65536
        self.renew()
        self.mix()

    def renew(self) -> None:
        """Order-0 frequencies from all that was spelt."""
        if self.spelt:
            ids = np.concatenate(self.spelt)
            self.spelt = []
            for k, level in enumerate(reversed(self.levels[:-1]), 1):
                level.counts[0] += _GAIN * np.bincount(ids >> 8 * k & 255, minlength=256)
            self.levels[-1].counts += _GAIN * np.bincount(ids & 0xFFFF, minlength=1 << 16).reshape(256, 256)
            for level in self.levels:
                level.renew()
        upper, lower = self.levels[-2:]
        bits = 2 * _BITS + 2 - np.repeat(_LOG[upper.freq], 256) - _LOG[lower.freq]
        # by id + 1; 0 is no guess at all
        self.rare = (np.concatenate([[15], np.minimum(bits, 15)]) << 6).astype(np.int16)

    def mix(self) -> None:
        """The probability, of 65536, that a guess is right, for every kind of evidence."""
        s = [STRETCH[np.minimum((right * 8192 + 4096) // (2 * tried + 2), 4095)].astype(np.int64) for right, tried in zip(self.right, self.tried, strict=True)]
        self.stretched = (s[0][None, :, None], s[1][None, None, :], s[2][:, None, None])
        w = self.weights[:, None, :, None]
        dot = sum(w[k] * x for k, x in enumerate(self.stretched)) >> 16
        self.chance = SQUASH[np.minimum(np.maximum(dot, -2047), 2047) + 2048].astype(np.int64) << 4
        self.flat = self.chance.reshape(-1)

    def learn_mix(self) -> None:
        """Weights and worths from the kinds of evidence since the last time, 1 024 higher where the guess was right."""
        wrong, good = np.bincount(np.concatenate(self.kinds), minlength=2048).reshape(2, 16, 8, 8)
        every = wrong + good
        self.kinds = []
        error = (good << 16) - every * self.chance
        of2 = every.sum(axis=(0, 2))
        for k, x in enumerate(self.stretched):
            self.weights[k] += (error * x).sum(axis=(0, 2)) // (64 * of2 + 64)
        np.minimum(self.weights, 200_000, out=self.weights)
        np.maximum(self.weights, -200_000, out=self.weights)
        for k, axes in enumerate(((0, 2), (0, 1), (1, 2))):
            tried, hits = self.tried[k], self.right[k]
            tried += every.sum(axis=axes)
            hits += good.sum(axis=axes)
            old = tried > 1 << 20
            tried[old] >>= 1
            hits[old] >>= 1
        self.mix()


class _Encoder:
    def __init__(self, lanes: int):
        self.every = np.arange(lanes)
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << _WIDE, np.int64)
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def right(self, mid: np.ndarray, guess: np.ndarray, new: np.ndarray) -> np.ndarray:
        return guess == new

    def settle(self, rows: np.ndarray, low: np.ndarray, own: np.ndarray) -> None:
        """Shift out the upper units of narrow ranges until they are wide enough for a decision."""
        which = (own < _NARROW).nonzero()[0]
        while len(which):
            part = low.take(which)
            self.out.append((rows.take(which).astype(np.uint16), part >> 32))
            low[which] = (part & _LOW) << 16
            part = own.take(which) << 16
            own[which] = part
            which = which[part < _NARROW]

    def above(self, rows: np.ndarray, mid: np.ndarray) -> np.ndarray:
        """The lower bounds of lanes whose guess was wrong."""
        return self.low.take(rows) + mid

    def spell(self, model: _Model, rows: np.ndarray, low: np.ndarray, own: np.ndarray, new: np.ndarray) -> np.ndarray:
        at, last = 0, len(model.levels) - 1
        ids = new.take(rows).astype(np.int64)
        ids -= 1
        for k, level in enumerate(model.levels):
            place = (at << 8 if k == last else 0) + (ids >> 8 * (last - k) & 255)
            at = place
            if k:
                self.settle(rows, low, own)
            own >>= _BITS
            parts = level.parts.take(place, mode="clip")
            low += own * (parts >> _PART)
            own *= parts & _ONE
        return ids

    def end(self, rows: np.ndarray, low: np.ndarray, m: int) -> None:
        self.low[rows] = low
        self.settle(self.every, self.low[:m], self.range[:m])

    def payload(self) -> bytes:
        lanes = len(self.low)
        rows = np.concatenate([*(x for x, _ in self.out), np.arange(lanes, dtype=np.uint16)])
        units = np.concatenate([*(x for _, x in self.out), (self.low + _LOW) >> 32])
        units = units[np.argsort(rows, kind="stable")]
        while True:  # a lane's first unit has no carry
            over = np.flatnonzero(units >> 16)
            if not len(over):
                break
            carry = units[over] >> 16
            units[over] &= 0xFFFF
            units[over - 1] += carry
        return np.bincount(rows, minlength=lanes).astype("<u2").tobytes() + units.astype("<u2").tobytes()


class _Decoder:
    def __init__(self, lanes: int, payload: bytes):
        self.every = np.arange(lanes)
        counts = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
        given = np.frombuffer(payload, "<u2", offset=2 * lanes).astype(np.int64)
        if int(counts.sum()) != len(given):
            raise ValueError("units of lanes don't add up")
        # zeros behind each lane's units, as many as are read ahead
        self.units = np.zeros(len(given) + 3 * lanes, np.int64)
        self.units[np.arange(len(given)) + np.repeat(3 * self.every, counts)] = given
        self.at = np.cumsum(counts) - counts + 3 * self.every
        self.low = self.units[self.at] << 32 | self.units[self.at + 1] << 16 | self.units[self.at + 2]  # what is coded, less the bound
        self.at += 3
        self.range = np.full(lanes, 1 << _WIDE, np.int64)

    def right(self, mid: np.ndarray, guess: np.ndarray, new: np.ndarray) -> np.ndarray:
        return self.low[: len(mid)] < mid

    def settle(self, rows: np.ndarray, low: np.ndarray, own: np.ndarray) -> None:
        which = (own < _NARROW).nonzero()[0]
        while len(which):
            lanes = rows.take(which)
            at = self.at.take(lanes)
            low[which] = low.take(which) << 16 | self.units.take(at, mode="clip")
            at += 1
            self.at[lanes] = at
            part = own.take(which) << 16
            own[which] = part
            which = which[part < _NARROW]

    def above(self, rows: np.ndarray, mid: np.ndarray) -> np.ndarray:
        return self.low.take(rows) - mid

    def spell(self, model: _Model, rows: np.ndarray, low: np.ndarray, own: np.ndarray, new: np.ndarray) -> np.ndarray:
        at, last, found = 0, len(model.levels) - 1, 0
        for k, level in enumerate(model.levels):
            if k:
                self.settle(rows, low, own)
            own >>= _BITS
            target = low // own
            np.minimum(target, _TOTAL - 1, out=target)
            if k == last:
                target += at << _BITS
            symbol = level.symbol.take(target, mode="clip").astype(np.int64)
            parts = level.parts.take(symbol + (at << 8) if k == last else symbol, mode="clip")
            at = symbol
            low -= own * (parts >> _PART)
            own *= parts & _ONE
            found = (found << 8) + symbol
        return found

    def end(self, rows: np.ndarray, low: np.ndarray, m: int) -> None:
        self.low[rows] = low
        self.settle(self.every, self.low[:m], self.range[:m])


def _shape(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes have an id at the last step."""
    lanes = min(_MOST, max(_LEAST, n // _RUN))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _run(n: int, wide: bool, coder, table: np.ndarray | None) -> np.ndarray:
    """Code all lanes: a ``table`` of ids + 1 (step by lane), or with None what they decode to."""
    lanes, steps, last = _shape(n)
    model, known = _Model(wide), table is not None
    if not known:
        table = np.zeros((steps, lanes), model.kind)
    before, before2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t in range(steps):
        m = lanes if t < steps - 1 else last
        p1, own, new = before[:m], coder.range[:m], table[t, :m]
        slot1 = (p1 ^ p1 >> 16) & 0xFFFF if wide else p1
        slot2 = before2[:m] * 0x3779
        slot2 += p1
        if wide:
            slot2 ^= slot2 >> 16
        slot2 &= _LAST
        e1, e2 = model.after1.take(slot1, mode="clip"), model.after2.take(slot2, mode="clip")
        g1, g2 = e1 >> 3, e2 >> 3
        guess = np.where(g2 > 0, g2, g1)
        kind = model.rare.take((guess - 1 & 0xFFFF) + (guess > 0) if wide else guess, mode="clip")
        # order 2's confidence, 4 higher where it knows anything; order 1's, 4 higher where it agrees
        e2 &= 7
        kind += e2 << 3
        kind += e1 & 3
        kind += (g1 == guess) * np.int32(4)
        mid = own >> 16
        mid *= model.flat.take(kind, mode="clip")
        right = coder.right(mid, guess, new)
        rows = (~right).nonzero()[0]
        part = mid.take(rows)
        low, rest = coder.above(rows, part), own.take(rows)
        rest -= part
        spelt = coder.spell(model, rows, low, rest, new)
        own[:] = mid
        own[rows] = rest
        coder.end(rows, low, m)
        if not known:
            new[:] = guess
            new[rows] = spelt + 1
        model.spelt.append(spelt)
        kind += right * np.int32(1024)
        model.kinds.append(kind)
        if t < 2 * _MIXED or not t % _MIXED:
            model.learn_mix()
        # an id that is there already is more certain, up to 3
        entry = (new << 3) + 4
        e1 &= 7
        for table_, slot, e, g in ((model.after1, slot1, e1, g1), (model.after2, slot2, e2, g2)):
            e -= 3
            np.minimum(e, 3, out=e)
            e *= g == new
            e += entry
            table_[slot] = e
        before2[:m] = p1
        before[:m] = new
        if not t + 1 & t or not (t + 1) % _RENEWED:
            model.renew()
    return table


def encode(ids: np.ndarray, wide: bool) -> bytes:
    lanes, steps, last = _shape(len(ids))
    table = np.zeros((steps, lanes), np.int64 if wide else np.int32)
    table[:, :last] = ids[: last * steps].reshape(last, steps).T
    table[:-1, last:] = ids[last * steps :].reshape(lanes - last, steps - 1).T
    table += 1
    coder = _Encoder(lanes)
    _run(len(ids), wide, coder, table)
    return coder.payload()


def decode(payload: bytes, n: int, wide: bool) -> np.ndarray:
    lanes, steps, last = _shape(n)
    table = _run(n, wide, _Decoder(lanes, payload), None)
    table -= 1
    out = np.empty(n, np.uint32)
    out[: last * steps].reshape(last, steps)[:] = table[:, :last].T
    out[last * steps :].reshape(lanes - last, steps - 1)[:] = table[:-1, last:].T
    return out
