"""Adaptive context-mixing range coder for token ids.

Ids are coded in groups of blocks. A group's header holds the order-0 distribution of its
ids: up to 2 ** 14 - 1 symbols, which are the most frequent ids and an escape for all others,
with frequencies that add up to 2 ** 16. Each block starts from this distribution and with
empty order-1 and order-2 tables, so blocks decode independently; the blocks of a group are
coded in lockstep, one NumPy lane each.

For each symbol an order-2 table (hash of the last two symbols) and an order-1 table (hash of
the last one) propose one symbol each, and know whether it is their first or was right the
last time. The symbol's probability is the mixture of both proposals and the order-0
distribution. The mixture's weights are learnt in the block, apart for each state of the two
tables and for agreeing and differing proposals. One range step takes the component, a second
one the symbol of order 0. The range has 36 to 52 bits and is renewed by units of 16; carries
run back through the units. Ids behind escapes follow a block's units as plain bits: their
places in the header's list.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

TOTAL_BITS = 16
TOTAL = 1 << TOTAL_BITS
LOW_BITS, HIGH_BITS, UNIT = 36, 52, 16
_LOW = 1 << LOW_BITS
_MASK = (1 << HIGH_BITS) - 1
SYMBOL_BITS = 14
SLOT_BITS = 8
U2, U4 = np.uint16, np.uint32
_SYMBOL = U2((1 << SYMBOL_BITS) - 1)
_NEW, _STATE, _RIGHT = U2(1 << SYMBOL_BITS), U2(SYMBOL_BITS), U2(15)
#: Weights of the proposals: order 2 in the low half of 32 bits, order 1 in the high half.
_START = (6_000, 3_000)
_RATE = U4(5)
_DECAY = U4(0x07FF07FF)
_GAIN2, _GAIN1 = U4(60_000 >> 5), U4((60_000 >> 5) << 16)
_HASH1, _HASH2 = U2(0x9E35), U2(0x85EB)


@dataclass
class Order0:
    """A group's symbols: ids, their frequencies, that of the escape behind them, and the ids that share it."""

    ids: np.ndarray
    freq: np.ndarray
    rare: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, vocab: int) -> Order0:
        counts = np.bincount(ids, minlength=vocab).astype(np.int64)
        n = int(counts.sum())
        own = counts * TOTAL >= n
        if int(own.sum()) > _SYMBOL - 1:
            own[:] = False
            own[np.argsort(-counts, kind="stable")[: _SYMBOL - 1]] = True
        own &= counts > 0
        symbols, rare = np.flatnonzero(own), np.flatnonzero((counts > 0) & ~own)
        count = np.append(counts[symbols], counts[rare].sum())
        freq = count * TOTAL // max(1, n)
        freq[-1] = max(freq[-1], len(rare) > 0)
        spare = TOTAL - int(freq.sum())
        if spare > 0:
            more = np.argsort(-(count * TOTAL % n), kind="stable")[: min(spare, len(symbols))]
            freq[more] += freq[more] > 0
        freq[np.argmax(freq)] += TOTAL - int(freq.sum())
        return Order0(symbols, freq, rare)

    def pack(self) -> bytes:
        """Distances of ids, and frequencies, each as four planes of bytes."""
        numbers = np.concatenate([[len(self.ids)], np.diff(self.ids, prepend=0), np.diff(self.rare, prepend=0), self.freq])
        return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 6)

    @staticmethod
    def unpack(data: bytes) -> Order0:
        try:
            data = zlib.decompress(data)
        except zlib.error as fault:
            raise ValueError("a group's distribution is broken") from fault
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)
        n = int(x[0])
        ids, rare, freq = np.cumsum(x[1 : n + 1]), np.cumsum(x[n + 1 : len(x) - n - 1]), x[len(x) - n - 1 :]
        if int(freq.sum()) != TOTAL or n >= _SYMBOL:
            raise ValueError("a group's distribution doesn't add up")
        return Order0(ids, freq, rare)

    @property
    def escape(self) -> int:
        return len(self.ids)

    @property
    def rare_bits(self) -> int:
        return max(0, len(self.rare) - 1).bit_length()

    def ranges(self) -> np.ndarray:
        """For each symbol: start | frequency << 20."""
        return np.cumsum(self.freq) - self.freq | self.freq << 20

    def symbols(self, ids: np.ndarray, vocab: int) -> np.ndarray:
        table = np.full(vocab, self.escape, U2)
        table[self.ids] = np.arange(len(self.ids))
        return table.take(ids)


class _Lanes:
    """What the blocks of a group know of their symbols so far."""

    def __init__(self, lanes: int):
        self.table = np.zeros(lanes * 2 << SLOT_BITS, U2)
        weights = np.full((lanes, 16, 2), _START[0] | _START[1] << 16, U4)
        weights[:, :, 1] = _START[0]  # where both propose the same symbol, order 2 has the proposals' weight
        self.weights = weights.reshape(-1)
        lane = np.arange(lanes, dtype=np.int64)
        self.base1, self.base2, self.base_w = lane * 2 << SLOT_BITS, (lane * 2 + 1) << SLOT_BITS, lane * 32
        self.h1, self.h2 = np.zeros(lanes, U2), np.zeros(lanes, U2)

    def shrink(self, n: int) -> None:
        self.base1, self.base2, self.base_w, self.h1, self.h2 = self.base1[:n], self.base2[:n], self.base_w[:n], self.h1[:n], self.h2[:n]

    def propose(self, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Proposals of order 2 and 1; ends of their ranges from 0; a unit of the range for order 0 behind them."""
        self.s1 = self.base1 + (self.h1 >> U2(16 - SLOT_BITS))
        self.s2 = self.base2 + ((self.h1 ^ self.h2) >> U2(16 - SLOT_BITS))
        e1, e2 = self.table.take(self.s1), self.table.take(self.s2)
        self.p1, self.p2 = e1 & _SYMBOL, e2 & _SYMBOL
        e1 >>= _STATE
        e2 >>= _STATE
        e2 <<= U2(2)
        e2 |= e1
        e2 <<= U2(1)
        e2 |= self.p1 == self.p2
        self.at = self.base_w + e2
        self.w = self.weights.take(self.at)
        w = self.w.astype(np.int64)
        w2 = w & 0xFFFF
        w >>= 16
        w += w2
        r = rng >> TOTAL_BITS
        w2 *= r
        unit = TOTAL - w
        unit *= r
        unit >>= TOTAL_BITS
        w *= r
        return self.p2, self.p1, w2, w, unit

    def learn(self, symbols: np.ndarray, hit: np.ndarray, second: np.ndarray) -> None:
        """Which lanes' proposals were right, and whether by order 2."""
        w = self.w >> _RATE
        w &= _DECAY
        np.subtract(self.w, w, out=w)
        w[hit] += np.where(second, _GAIN2, _GAIN1)
        self.weights[self.at] = w
        new = symbols | _NEW
        for slot, p in ((self.s2, self.p2), (self.s1, self.p1)):
            right = (p == symbols).astype(U2)
            right <<= _RIGHT
            right |= new
            self.table[slot] = right
        self.h2 = self.h1 * _HASH2
        self.h1 = symbols * _HASH1
        self.h1 += _HASH1


def encode(ids: np.ndarray, block: int, order0: Order0, vocab: int) -> list[bytes]:
    """Payloads of the blocks of a group: block ids each, fewer in the last."""
    lanes = -(-len(ids) // block)
    if not lanes:
        return []
    last = len(ids) - (lanes - 1) * block
    padded = np.zeros(lanes * block, U2)
    padded[: len(ids)] = order0.symbols(ids, vocab)
    symbols = np.ascontiguousarray(padded.reshape(lanes, block).T)
    ranges = order0.ranges()
    width = block * 3 + 8
    units = np.zeros(lanes * width, U2)
    first = np.arange(lanes, dtype=np.int64) * width
    at = first.copy()
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)
    m = _Lanes(lanes)
    done = None
    for t in range(block):
        if t == last:
            done = (low[-1:], at[-1:])
            m.shrink(lanes - 1)
            low, rng, at = low[:-1], rng[:-1], at[:-1]
        n = len(low)
        now = symbols[t, :n]
        p2, p1, b2, b1, unit = m.propose(rng)
        q = ranges.take(now)
        second = now == p2
        hit = (second | (now == p1)).nonzero()[0]
        second = second[hit]
        start = q & 0xFFFFF
        start *= unit
        start += b1
        q >>= 20
        q *= unit
        rng = q
        x2, x1 = b2[hit], b1[hit]
        start[hit] = np.where(second, 0, x2)
        rng[hit] = np.where(second, x2, x1 - x2)
        low = low + start
        over = (low > _MASK).nonzero()[0]
        if len(over):
            low[over] &= _MASK
            back = at[over] - 1
            while len(back):
                units[back] += U2(1)
                back = back[units[back] == 0] - 1
        units[at] = low >> LOW_BITS
        need = rng < _LOW
        shift = need.astype(np.int64)
        at = at + shift
        shift <<= 4
        low <<= shift
        low &= _MASK
        rng <<= shift
        some = (rng < _LOW).nonzero()[0]
        while len(some):
            units[at[some]] = low[some] >> LOW_BITS
            low[some] = (low[some] << UNIT) & _MASK
            rng[some] <<= UNIT
            at[some] += 1
            some = some[rng[some] < _LOW]
        m.learn(now, hit, second)
    if done is not None:
        low, at = np.append(low, done[0]), np.append(at, done[1])
    # two units close a payload, rounded up so that whatever follows them leaves the code in the range
    low = (low + (1 << 20) - 1 >> 20) << 20
    over = (low > _MASK).nonzero()[0]
    back = at[over] - 1
    while len(back):
        units[back] += U2(1)
        back = back[units[back] == 0] - 1
    units[at], units[at + 1] = low >> LOW_BITS & 0xFFFF, low >> LOW_BITS - UNIT & 0xFFFF
    raw = units.astype("<u2", copy=False)
    out = [raw[a:b].tobytes() for a, b in zip(first.tolist(), (at + 2).tolist(), strict=True)]
    if order0.rare_bits:
        place = np.flatnonzero(padded[: len(ids)] == order0.escape)
        bits = (np.searchsorted(order0.rare, ids[place])[:, None] >> np.arange(order0.rare_bits)).astype(np.uint8) & 1
        edges = np.searchsorted(place, np.arange(lanes + 1) * block).tolist()
        for k in range(lanes):
            if edges[k] < edges[k + 1]:
                out[k] += np.packbits(bits[edges[k] : edges[k + 1]].reshape(-1)).tobytes()
    return out


def decode(payloads: list[bytes], size: int, block: int, order0: Order0) -> np.ndarray:
    """The size ids of a group's blocks."""
    lanes = len(payloads)
    if lanes != -(-size // block):
        raise ValueError("a group's blocks don't fit its number of ids")
    if not lanes:
        return np.zeros(0, U4)
    last = size - (lanes - 1) * block
    sizes = np.array([len(p) + 1 >> 1 for p in payloads])
    units = np.frombuffer(b"".join([p + b"\0" if len(p) & 1 else p for p in payloads] + [bytes(8)]), "<u2").astype(np.int64)
    at = np.cumsum(sizes) - sizes
    # the code has 52 bits, three units and 4 bits more; units after them are cut 4 bits later
    code = units.take(at) << 36 | units.take(at + 1) << 20 | units.take(at + 2) << 4 | units.take(at + 3) >> 12
    units[:-1] = units[:-1] << 4 & 0xFFFF | units[1:] >> 12
    at = at + 3
    rng = np.full(lanes, _MASK, np.int64)
    symbols = np.zeros((block, lanes), U2)
    ranges, values = order0.ranges(), np.repeat(np.arange(len(order0.freq), dtype=U2), order0.freq)
    m = _Lanes(lanes)
    for t in range(block):
        if t == last:
            m.shrink(lanes - 1)
            code, rng, at = code[:-1], rng[:-1], at[:-1]
        p2, p1, b2, b1, unit = m.propose(rng)
        hit = (code < b1).nonzero()[0]
        # exact: less than 2 ** 52 over at most 2 ** 36
        now = values.take(((code - b1) / unit).astype(np.int64), mode="clip")
        q = ranges.take(now)
        start = q & 0xFFFFF
        start *= unit
        start += b1
        q >>= 20
        q *= unit
        rng = q
        x2, x1 = b2[hit], b1[hit]
        second = code[hit] < x2
        start[hit] = np.where(second, 0, x2)
        rng[hit] = np.where(second, x2, x1 - x2)
        now[hit] = np.where(second, p2[hit], p1[hit])
        code = code - start
        need = rng < _LOW
        more = units.take(at, mode="clip")
        shift = need.astype(np.int64)
        at = at + shift
        more &= -shift
        shift <<= 4
        code <<= shift
        code |= more
        rng <<= shift
        some = (rng < _LOW).nonzero()[0]
        while len(some):
            code[some] = code[some] << UNIT | units.take(at[some], mode="clip")
            rng[some] <<= UNIT
            at[some] += 1
            some = some[rng[some] < _LOW]
        symbols[t, : len(now)] = now
        m.learn(now, hit, second)
    flat = np.ascontiguousarray(symbols.T).reshape(-1)[:size]
    ids = np.append(order0.ids, 0).astype(U4).take(flat)
    rare_bits = order0.rare_bits
    if len(order0.rare):
        place = np.flatnonzero(flat == order0.escape)
        edges = np.searchsorted(place, np.arange(lanes + 1) * block)
        index = np.zeros(len(place), np.int64)
        if rare_bits:
            for k in np.flatnonzero(np.diff(edges)).tolist():
                n = int(edges[k + 1] - edges[k]) * rare_bits
                raw = np.unpackbits(np.frombuffer(payloads[k][-(-(-n // 8)) :], np.uint8), count=n)
                index[edges[k] : edges[k + 1]] = raw.reshape(-1, rare_bits) @ (1 << np.arange(rare_bits))
        ids[place] = order0.rare.take(index, mode="clip")
    return ids
