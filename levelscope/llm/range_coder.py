"""Adaptive context-mixing range coder for blocks of token ids.

Each block is coded on its own from the same starting state: nothing carries over, so any
block can be decoded alone. For every id the block's history gives three predictions:

* order 2: the id that last followed the two ids before,
* order 1: the id that last followed the id before,
* order 0: adaptive frequencies of the id's hexadecimal digits, each given those before.

A first decision says whether the id is the one predicted by the longest known context. Its
probability is a logistic mix of three adaptive ones, with weights learned as the block goes:
by how sure order 2 is, by how sure order 1 is and whether it agrees, and by how many bits the
predicted id has under order 0. If it isn't that id, order-0 choices spell it, four digits, or
eight in blocks with ids over 65 535. A carryless range coder with 64-bit bounds codes all of
them. Every value that the coder uses is an integer below 2^24 or exact, so every machine
decodes alike.

Blocks of up to ``SHORT`` ids are coded many at a time, one numpy lane per block: step t handles
id t of all. A longer one is coded by ``long_blocks``, in many lanes of its own that learn
together; it has magic ``CMR3``. Every reader takes both.

Layout of a coded block, little-endian: magic ``CMR2``, uint32 16-bit halves of an id (1 or 2),
uint32 number of ids, uint32 crc32 of the ids as uint32, uint32 crc32 of all of that and the
payload, then the payload of 16-bit units.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import long_blocks
from .long_blocks import SQUASH as _SQUASH
from .long_blocks import STRETCH as _STRETCH

MAGIC, LONG_MAGIC = b"CMR2", b"CMR3"
FACTS, HEAD = struct.Struct("<4sIII"), struct.Struct("<4sIIII")
#: Ids of a block, at most: what a decoder makes room for.
MOST_IDS = 1 << 24
#: Ids of a block that is coded in one lane, at most.
SHORT = 4096
#: Entries of the tables of contexts, a power of two.
SLOTS = 4096

#: Rows of digit frequencies: one for the first digit, 16 for the second and so on.
_FIRST = (0, 1, 17, 273)
_ROWS = 4369
#: What a digit's frequency grows by, and the total from which a row's are halved.
_GAIN, _FULL = (12, 16, 24, 24), 16_000
_BITS = np.array([n.bit_length() for n in range(1 << 16)], np.uint8)
#: Where a digit lies in a half of an id, and the digits before it.
_DIGIT, _ABOVE = np.array([[12], [8], [4], [0]]), np.array([[16], [12], [8], [4]])
#: What a digit adds to the running sums of its row, by level and digit; a row of them as one item.
_STEPS = np.array([np.triu(np.full((16, 16), g)) for g in _GAIN], np.uint16)
_ROW = np.dtype("V32")
_ONES, _TOP_BYTE = np.uint64(0x0101010101010101), np.uint64(56)

_U = np.uint64
_TOP, _LOW48, _SMALL, _ALL = _U(48), _U(0xFFFFFFFFFFFF), _U(1 << 40), _U(0xFFFFFFFFFFFFFFFF)
_S16, _APART = _U(16), _U(1 << 48)
_UNIT = _U(0xFFFF)


class CorruptBlock(ValueError):
    """A block's bytes don't have the checksum or the form that its head states."""


class _Lanes:
    """Models and coder bounds of ``n`` blocks of ids of so many 16-bit ``halves``; the longest block first.

    Tables are flat and read by ``take``, rows as single items: many times as fast as indexing them.
    """

    def __init__(self, n: int, halves: int):
        self.halves = halves
        # what followed one id, then two: id + 1 in the high bits, confidence 0..3 below
        self.after = np.zeros(2 * n * SLOTS, _U if halves > 1 else np.uint32)
        # running sums of a digit's frequencies given the digits before; the low halves' tables, then the high halves'
        self.sums = np.empty((halves * n * _ROWS, 16), np.uint16)
        self.sums[:] = np.arange(1, 17, dtype=np.uint16)
        self.flat, self.rows = self.sums.reshape(-1), self.sums.view(_ROW).reshape(-1)
        self.hit = np.full(3 * n * 16, 1 << 11, np.int32)  # 12 bits, by order and evidence
        self.weight = np.full((3, n), 22_000, np.int32)  # of 65536
        self.prev1 = np.zeros(n, self.after.dtype)
        self.prev2 = np.zeros(n, self.after.dtype)
        self.row = np.arange(n)
        self.slot = np.stack([self.row * SLOTS, (n + self.row) * SLOTS])
        self.seen = np.stack([(k * n + self.row) * 16 for k in (0, 1, 2)])
        self.begin = np.stack([(self.row * _ROWS + first) * 16 for first in _FIRST])

    def order0_bits(self, ids: np.ndarray) -> np.ndarray:
        """How many bits, roughly, the low half of each id has under its lane's digit frequencies."""
        ids = ids.astype(np.int64) & 0xFFFF
        at = self.begin[:, : len(ids)] + (ids >> _ABOVE << 4)
        digit = ids >> _DIGIT & 15
        place = at + digit
        own = self.flat.take(place, mode="clip")
        place -= 1
        own -= self.flat.take(place, mode="clip") * (digit > 0)
        at += 15
        bits = _BITS.take(self.flat.take(at, mode="clip"), mode="clip")
        bits -= _BITS.take(own, mode="clip")
        return bits[0] + bits[1] + bits[2] + bits[3]

    def evidence(self, m: int):
        """Slots, the predicted id + 1 and the hit probability for the first ``m`` lanes."""
        kind = self.after.dtype.type
        p1, p2 = (self._folded(x[:m]) for x in (self.prev1, self.prev2))
        slot = self.slot[:, :m].copy()
        slot[0] += (p1 * np.uint32(0x9E3779B1)) >> np.uint32(20)
        s2 = (p2 * np.uint32(0x85EBCA6B)) ^ (p1 * np.uint32(0xC2B2AE35))
        slot[1] += (s2 ^ (s2 >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(20)
        e = self.after.take(slot, mode="clip")
        g, sure = e >> kind(2), (e & kind(3)).astype(np.int64)
        known2 = g[1] > 0
        guess = np.where(known2, g[1], g[0])
        any0 = guess > 0
        at = self.seen[:, :m].copy()
        at[0] += (sure[1] + 1) * known2
        at[1] += ((g[0] == guess) * 4 + sure[0]) * (g[0] > 0)
        at[2] += np.minimum(self.order0_bits(guess - any0.astype(guess.dtype)), 15)
        q = self.hit.take(at, mode="clip")
        s = _STRETCH.take(q, mode="clip")
        each = self.weight[:, :m] * s
        dot = (each[0] + each[1] + each[2]) >> 16
        mixed = _SQUASH.take(dot + 2048, mode="clip")
        return slot, e, guess, at, q, s, np.where(any0, mixed, np.int32(1))

    @staticmethod
    def _folded(x: np.ndarray) -> np.ndarray:
        return x if x.dtype == np.uint32 else (x ^ x >> _U(32)).astype(np.uint32)

    def learn(self, m: int, ids: np.ndarray, ev, hit: np.ndarray) -> None:
        slot, e, guess, at, q, s, mixed = ev
        goal = hit.astype(np.int32) * np.int32(4095)
        s *= (goal - mixed) * np.int32(6)
        s >>= 12
        s += self.weight[:, :m]
        np.minimum(s, 200_000, out=s)
        np.maximum(s, -200_000, out=self.weight[:, :m])
        self.hit[at] = q + ((goal - q) >> 4)
        kind = self.after.dtype.type
        new = ids.astype(self.after.dtype) + kind(1)
        right = (e >> kind(2)) == new
        self.after[slot] = (new << kind(2)) | np.minimum((e & kind(3)) + kind(1), kind(3)) * right
        self.prev2[:m] = self.prev1[:m]
        self.prev1[:m] = new


class _Coder:
    """Bounds of each lane's interval; ``begin`` picks the lanes that the next decisions are for."""

    def __init__(self, n: int):
        self.x1, self.x2 = np.zeros(n, _U), np.full(n, _ALL, _U)

    def begin(self, rows: np.ndarray) -> None:
        self.rows, self.a, self.b = rows, self.x1.take(rows), self.x2.take(rows)

    def decide(self, p16: np.ndarray, bit: np.ndarray | None) -> np.ndarray:
        """One binary decision a lane; ``p16`` / 65536 is the probability of a set bit."""
        mid = self.a + ((self.b - self.a) >> _S16) * p16.astype(_U)
        bit = self.choose(mid, bit)
        self.a, self.b = np.where(bit, self.a, mid + _U(1)), np.where(bit, mid, self.b)
        return bit

    def pick(self, sums: np.ndarray, every: np.ndarray, digit: np.ndarray | None) -> np.ndarray:
        """One choice a lane among 16 with the running ``sums`` of their frequencies."""
        flat = sums.reshape(-1)
        total = sums[:, 15].astype(_U)
        unit = (self.b - self.a) // total
        digit = self.digit(sums, unit, digit)
        place = every + digit
        high = flat.take(place, mode="clip")
        low = flat.take(place - 1, mode="clip") * (digit > 0)
        self.b = self.a + unit * high - _U(1)
        self.a = self.a + unit * low
        return digit

    def settle(self) -> None:
        """Shift out what is decided until every range is wide enough for two decisions."""
        a, b = self.a, self.b
        while True:
            apart = (a ^ b) >= _APART
            tight = (apart & (b - a < _SMALL)).nonzero()[0]
            if len(tight):  # a carry hangs in the balance: give up the part above it
                b[tight] = a.take(tight) | _LOW48
                apart[tight] = False
            shift = (~apart).nonzero()[0]
            if not len(shift):
                return
            self.shift(shift)
            a[shift] = a.take(shift) << _S16
            b[shift] = b.take(shift) << _S16 | _UNIT

    def end(self) -> None:
        self.x1[self.rows], self.x2[self.rows] = self.a, self.b


class _Encoder(_Coder):
    def __init__(self, n: int, longest: int):
        super().__init__(n)
        self.units = np.zeros((n, longest + longest // 2 + 64), np.uint16)
        self.at = np.zeros(n, np.int64)

    def choose(self, mid, bit):
        return bit

    def digit(self, sums, unit, digit):
        return digit

    def shift(self, which) -> None:
        rows = self.rows.take(which)
        at = self.at.take(rows)
        if at.max() >= self.units.shape[1]:
            self.units = np.concatenate([self.units, np.zeros_like(self.units)], axis=1)
        self.units.reshape(-1)[rows * self.units.shape[1] + at] = self.a.take(which) >> _TOP
        self.at[rows] = at + 1

    def payload(self, lane: int) -> bytes:
        tail = [int(self.x2[lane]) >> s & 0xFFFF for s in (48, 32, 16, 0)]
        return np.append(self.units[lane, : self.at[lane]], np.array(tail, np.uint16)).astype("<u2").tobytes()


class _Decoder(_Coder):
    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads))
        self.units = np.zeros((len(payloads), max(map(len, payloads)) // 2 + 4), np.uint16)
        for lane, x in enumerate(payloads):
            self.units[lane, : len(x) // 2] = np.frombuffer(x, "<u2")
        first = self.units[:, :4].astype(_U)
        self.x = first[:, 0] << _U(48) | first[:, 1] << _U(32) | first[:, 2] << _S16 | first[:, 3]
        self.at = np.full(len(payloads), 4, np.int64)

    def choose(self, mid, bit):
        return self.x.take(self.rows) <= mid

    def digit(self, sums, unit, digit):
        target = np.minimum((self.x.take(self.rows) - self.a) // unit, sums[:, 15] - np.uint16(1)).astype(np.uint16)
        below = (sums <= target[:, None]).view(_U)  # a byte a digit
        return ((below[:, 0] + below[:, 1]) * _ONES >> _TOP_BYTE).astype(np.int64)

    def shift(self, which) -> None:
        rows, width = self.rows.take(which), self.units.shape[1]
        at = self.at.take(rows)
        own = self.units.reshape(-1).take(rows * width + np.minimum(at, width - 1))
        self.x[rows] = self.x.take(rows) << _S16 | own
        self.at[rows] = at + 1


def _spell(lanes: _Lanes, coder: _Coder, rows: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Order-0 choices of a digit each, four for every half of an id, the high half first."""
    out = np.zeros(len(rows), np.uint32)
    for half in reversed(range(lanes.halves)):
        own = None if ids is None else ids >> np.uint32(16 * half) & np.uint32(0xFFFF)
        begin = (rows + half * len(lanes.row)) * _ROWS
        out |= _spell_half(lanes, coder, begin, own) << np.uint32(16 * half)
    return out


def _spell_half(lanes: _Lanes, coder: _Coder, begin: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    prefix, every = np.zeros(len(begin), np.int64), np.arange(len(begin)) * 16
    want = None if ids is None else ids.astype(np.int64)
    for k in range(4):
        at = begin + _FIRST[k] + prefix
        sums = lanes.rows.take(at, mode="clip").view(np.uint16).reshape(-1, 16)
        digit = coder.pick(sums, every, None if want is None else want >> 12 - 4 * k & 15)
        full = (sums[:, 15] > _FULL).nonzero()[0]
        sums += _STEPS[k].take(digit, axis=0, mode="clip")
        if len(full):
            own = np.diff(sums[full], axis=1, prepend=np.uint16(0))
            sums[full] = np.cumsum((own + np.uint16(1)) >> np.uint16(1), axis=1, dtype=np.uint16)
        lanes.rows[at] = sums.view(_ROW).reshape(-1)
        prefix = prefix * 16 + digit
        if k % 2:
            coder.settle()
    return prefix.astype(np.uint32)


def _run(sizes: np.ndarray, halves: int, coder: _Coder, ids: np.ndarray | None) -> np.ndarray:
    """Code all lanes, the longest first: ``ids`` (time by lane), or with None what they decode to."""
    n, longest = len(sizes), int(sizes[0])
    lanes, result = _Lanes(n, halves), ids if ids is not None else np.zeros((longest, n), np.uint32)
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for t in range(longest):
        m = int(active[t])
        ev = lanes.evidence(m)
        guess = ev[2]
        coder.begin(lanes.row[:m])
        expected = (guess - guess.dtype.type(1)).astype(np.uint32)
        hit = coder.decide(ev[6] << 4, None if ids is None else (ids[t, :m] == expected) & (guess > 0))
        coder.settle()
        coder.end()
        rows = np.flatnonzero(~hit)
        now = result[t, :m] if ids is not None else expected
        if len(rows):
            coder.begin(rows)
            spelt = _spell(lanes, coder, rows, None if ids is None else now[rows])
            coder.end()
            if ids is None:
                now[rows] = spelt
        result[t, :m] = now
        lanes.learn(m, now, ev, hit)
    return result


def _order(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    return order, np.asarray(lengths, np.int64)[order]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of 32-bit ids as a coded block, in the order given."""
    result: list[bytes] = [b""] * len(blocks)
    wide = [bool(len(b)) and int(np.max(b)) > 0xFFFF for b in blocks]
    for halves in (1, 2):
        own = [k for k, w in enumerate(wide) if w == (halves == 2) and len(blocks[k]) <= SHORT]
        for k, x in zip(own, _encoded([blocks[k] for k in own], halves), strict=True):
            result[k] = x
    for k, block in enumerate(blocks):
        if len(block) > SHORT:
            _allowed(block)
            result[k] = _headed(LONG_MAGIC, 1 + wide[k], block, long_blocks.encode(block, wide[k]))
    return result


def _allowed(block: np.ndarray) -> None:
    if len(block) > MOST_IDS:
        raise ValueError(f"a block of more than {MOST_IDS} ids")


def _headed(magic: bytes, halves: int, block: np.ndarray, payload: bytes) -> bytes:
    facts = FACTS.pack(magic, halves, len(block), zlib.crc32(np.asarray(block).astype("<u4").tobytes()))
    return facts + zlib.crc32(payload, zlib.crc32(facts)).to_bytes(4, "little") + payload


def _encoded(blocks: list[np.ndarray], halves: int) -> list[bytes]:
    if not blocks:
        return []
    order, sizes = _order([len(b) for b in blocks])
    ids = np.zeros((int(sizes[0]), len(blocks)), np.uint32)
    for lane, k in enumerate(order):
        ids[: len(blocks[k]), lane] = blocks[k]
    coder = _Encoder(len(blocks), int(sizes[0]) * halves)
    _run(sizes, halves, coder, ids)
    result: list[bytes] = [b""] * len(blocks)
    for lane, k in enumerate(order):
        result[k] = _headed(MAGIC, halves, blocks[k], coder.payload(lane))
    return result


def decode_blocks(coded: list[bytes]) -> list[np.ndarray]:
    """The ids of coded blocks, in the order given; raises CorruptBlock where a checksum or the head fails."""
    heads, payloads = [], []
    for x in coded:
        if len(x) < HEAD.size or x[:4] not in (MAGIC, LONG_MAGIC):
            raise CorruptBlock("not a coded block")
        _, halves, n, check, whole = HEAD.unpack_from(x)
        payload = x[HEAD.size :]
        if zlib.crc32(payload, zlib.crc32(x[: FACTS.size])) != whole:
            raise CorruptBlock("checksum of head and payload differs")
        long = x[:4] == LONG_MAGIC
        if halves not in (1, 2) or n > MOST_IDS or long and n <= SHORT:
            raise CorruptBlock("a head that no block has")
        heads.append((halves, n, check, long))
        payloads.append(payload)
    result: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(coded)
    for halves in (1, 2):
        own = [k for k, h in enumerate(heads) if h[0] == halves and not h[3]]
        if not own:
            continue
        order, sizes = _order([heads[k][1] for k in own])
        ids = _run(sizes, halves, _Decoder([payloads[own[k]] for k in order]), None)
        for lane, at in enumerate(order):
            k = own[at]
            result[k] = np.ascontiguousarray(ids[: heads[k][1], lane])
    for k, (halves, n, _, long) in enumerate(heads):
        if long:
            try:
                result[k] = long_blocks.decode(payloads[k], n, halves == 2)
            except ValueError as e:
                raise CorruptBlock(str(e)) from e
    if any(zlib.crc32(ids.astype("<u4").tobytes()) != h[2] for ids, h in zip(result, heads, strict=True)):
        raise CorruptBlock("id checksum differs")
    return result
