"""An adaptive context-mixing range coder for blocks of ids, hundreds of blocks at a time.

An id's probability is a sum of three predictions with shares that add up to one:

- order 2: the id that last followed the two ids before;
- order 1: the id that last followed the one before;
- order 0: frequencies. A group of blocks carries CLASSES tables of frequencies, and the
  class of the id before (found by clustering ids with alike followers) picks the table, so
  that order 0 knows what kind of text it is in. Only what occurs has a frequency.

The shares are those that predictions of the same standing deserve: hits in a row of either
(0 to 3), and whether they agree. A block starts with START's counts, empty predictions and
the group's tables, and recounts its shares every REFRESH ids with the older half as heavy.
The interval of an id s is that of the mixed distribution: it begins at the sum of what all
smaller ids have of each prediction, so an id that several predict has all their shares.

Ranges have 48 bits and shed 16 at a time. Blocks are independent, so numpy takes an id of
each at a step; the encoder knows all ids beforehand, finds the intervals of whole blocks in
one go and steps only to narrow the ranges, the decoder has to step. A block has less than
1 << 24 ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CLASSES = 16
#: Bits of the sum of a table's frequencies, and of all shares.
FINE, BITS = 16, 26
REFRESH = 256
#: Slots of the order-1 and order-2 predictions of a block.
SLOTS_BITS = 10
#: Pairs of neighbours, evenly spread over the ids, on which the classes are found, and rounds.
PAIRS, ROUNDS = 1 << 17, 6

#: Blocks whose intervals the encoder finds at once.
BESIDE = 32

_SLOTS = 1 << SLOTS_BITS
#: Starting odds that order 2 and order 1 are right, by hits in a row.
START_2, START_1 = (0.0, 0.3, 0.7, 0.95), (0.0, 0.1, 0.3, 0.6)


def _start_counts() -> np.ndarray:
    """By standing (order 2's hits, order 1's hits, agreement): counts of order 2, of order 1 and of neither being right."""
    out = np.zeros((4, 4, 2, 3))
    for h2 in range(4):
        for h1 in range(4):
            for agree in range(2):
                two = max(START_2[h2], START_1[h1] if agree and h1 else 0)
                one = 0 if agree and h2 else (1 - two) * START_1[h1] / 2 if h2 else START_1[h1]
                out[h2, h1, agree] = two, one, 1 - two - one
    return 16 * out.reshape(32, 3)


_H2, _H1, _AGREE = (x.ravel() for x in np.meshgrid(range(4), range(4), range(2), indexing="ij"))
#: Which of order 2 and order 1 have a share of their own, by standing.
_HAS_2, _HAS_1 = _H2 > 0, (_H1 > 0) & ((_AGREE == 0) | (_H2 == 0))


def _shares(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shares of orders 0 (in units of 1 << FINE), 1 and 2 for counts of (blocks, 32 standings, 3); they add up to 1 << BITS."""
    two, one = (counts[..., 0] + 0.02) * _HAS_2, (counts[..., 1] + 0.02) * _HAS_1
    rest = counts[..., 2] + 0.5
    most = 1 << (BITS - FINE)
    zero = np.clip((rest / (two + one + rest) * most).astype(np.int64), 1, most)
    zero[..., ~(_HAS_2 | _HAS_1)] = most
    left = (most - zero) << FINE
    share2 = np.where(_HAS_2, np.where(_HAS_1, left * (two / np.maximum(two + one, 1e-9)), left), 0).astype(np.int64)
    return tuple(x.astype(np.int32).ravel() for x in (zero, left - share2, share2))


class Tables:
    """What a group of blocks shares: its ids, their classes, and frequencies by class and id."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, freq: np.ndarray):
        self.ids, self.classes, self.freq = ids, classes, freq

    @classmethod
    def of(cls, blocks: list[np.ndarray]) -> Tables:
        flat = np.concatenate([np.empty(0, np.int64), *blocks])
        ids = np.flatnonzero(np.bincount(flat)) if len(flat) else np.zeros(1, np.int64)
        number = np.zeros(int(ids[-1]) + 1, np.int64)
        number[ids] = np.arange(len(ids))
        symbol = number[flat]
        before = np.zeros(len(flat), np.int64)
        before[1:] = symbol[:-1]
        at = np.cumsum([len(b) for b in blocks], dtype=np.int64)[:-1]
        before[at[at < len(flat)]] = 0
        classes = _clustered(before, symbol, len(ids))
        counts = np.bincount(classes[before] * len(ids) + symbol, minlength=CLASSES * len(ids)).reshape(CLASSES, len(ids))
        return cls(ids, classes.astype(np.uint8), np.array([_scaled(c) for c in counts]))

    def to_bytes(self) -> bytes:
        held = np.flatnonzero(self.freq.ravel())
        raw = b"".join([np.diff(self.ids, prepend=0).astype("<u4").tobytes(), self.classes.tobytes(), np.packbits(self.freq.ravel() > 0).tobytes(), (self.freq.ravel()[held] - 1).astype("<u2").tobytes()])
        return np.array([len(self.ids), len(raw)], "<u4").tobytes() + pa.Codec("zstd", 9).compress(raw, asbytes=True)

    @classmethod
    def from_bytes(cls, data: bytes) -> Tables:
        n, size = np.frombuffer(data, "<u4", 2).tolist()
        raw = pa.Codec("zstd").decompress(data[8:], size, asbytes=True)
        held = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, -(-CLASSES * n // 8), 5 * n), count=CLASSES * n))
        freq = np.zeros(CLASSES * n, np.int64)
        freq[held] = np.frombuffer(raw, "<u2", len(held), 5 * n + -(-CLASSES * n // 8)).astype(np.int64) + 1
        return cls(np.cumsum(np.frombuffer(raw, "<u4", n)).astype(np.int64), np.frombuffer(raw, np.uint8, n, 4 * n), freq.reshape(CLASSES, n))


def _clustered(before: np.ndarray, symbol: np.ndarray, n: int) -> np.ndarray:
    """A class for each of n ids, such that ids of one class have alike followers."""
    step = max(1, len(symbol) // PAIRS)
    pair, times = np.unique(before[::step] * n + symbol[::step], return_counts=True)
    a, b = pair // n, pair % n
    rank = np.empty(n, np.int64)
    rank[np.argsort(-np.bincount(a, weights=times, minlength=n), kind="stable")] = np.arange(n)
    classes = rank % CLASSES
    share = np.bincount(b, weights=times, minlength=n) + 0.01
    share /= share.sum()
    for _ in range(ROUNDS):
        p = np.bincount(classes[a] * n + b, weights=times, minlength=CLASSES * n).reshape(CLASSES, n) + share
        log = np.log(p / p.sum(axis=1, keepdims=True))
        classes = np.array([np.bincount(a, weights=times * x[b], minlength=n) for x in log]).argmax(axis=0)
    return classes


def _scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 1 << FINE (or are all zero), at least 1 for what occurs."""
    total, kinds = int(counts.sum()), int((counts > 0).sum())
    if not total:
        return counts
    out = np.where(counts > 0, 1 + counts * ((1 << FINE) - kinds) // total, 0)
    out[np.argmax(counts)] += (1 << FINE) - out.sum()
    return out


class _Lanes:
    """Blocks side by side, longest first: lookups of the groups' tables, and what the decoder keeps of each block."""

    def __init__(self, tables: list[Tables], group: np.ndarray, decoding: bool):
        lanes = len(group)
        self.wide = wide = max(len(t.ids) for t in tables)
        self.ids = np.zeros((len(tables), wide), np.uint32)
        #: A group's table for the id before: its number among all.
        self.kinds = np.zeros((len(tables), wide), np.int64)
        self.sums = np.zeros((len(tables), CLASSES, wide + 1), np.int32)
        for i, t in enumerate(tables):
            self.ids[i, : len(t.ids)], self.kinds[i, : len(t.ids)] = t.ids, t.classes
            self.sums[i, :, 1:] = 1 << FINE
            self.sums[i, :, 1 : len(t.ids) + 1] = np.cumsum(t.freq, axis=1)
        self.kinds += np.arange(len(tables))[:, None] * CLASSES
        self.id_at = group * wide  # begins of a lane's lookups; as 64-bit numbers, which numpy looks up without a copy
        if not decoding:
            return
        self.find = np.zeros((len(tables), CLASSES, 1 << FINE), np.uint16)
        for i, t in enumerate(tables):
            for k in range(CLASSES):
                if t.freq[k].any():
                    self.find[i, k] = np.repeat(np.arange(len(t.ids), dtype=np.uint16), t.freq[k])
        self.slots_at, self.standing_at = np.arange(lanes) * _SLOTS, np.arange(lanes) * 32
        #: Entries of order 1, then those of order 2: check, id (16 bits), hits in a row (2 bits).
        self.after = np.zeros(2 * lanes * _SLOTS, np.int32)
        self.counts = np.tile(_start_counts(), (lanes, 1, 1))
        self.shares = np.stack(_shares(self.counts))
        self.standing, self.hits = np.zeros((REFRESH, lanes), np.int32), np.zeros((REFRESH, 2, lanes), bool)
        self.steps = 0

    def tell(self, standing: np.ndarray, hits: np.ndarray) -> None:
        """Note the lanes' standings, and hits of the predictions that were right; recount the shares when it is time."""
        row, live = self.steps % REFRESH, len(standing)
        self.standing[row, :live] = standing
        np.greater(hits, 0, out=self.hits[row, :, :live])
        self.steps += 1
        if row == REFRESH - 1:
            n = live * 32
            seen, hits = self.standing[:, :live], self.hits[:, :, :live]
            self.counts[:live] = self.counts[:live] / 2 + _outcomes(seen, hits[:, 0], hits[:, 1], live)
            self.shares[:, :n] = _shares(self.counts[:live])


def _order2(before: np.ndarray, before2: np.ndarray) -> np.ndarray:
    """Hash of two ids: the slot in the low bits, the check above."""
    h = before2.astype(np.uint32) * np.uint32(0x9E3779B1) + before.astype(np.uint32) * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(32 - SLOTS_BITS - 13)).astype(np.int32)


def _outcomes(standing: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, n: int) -> np.ndarray:
    """(n, 32, 3): by counter and standing, how often order 2 was right, else order 1, else neither. standing: counter * 32 + standing."""
    key = standing * 3
    key += 2
    key -= hit1
    key -= hit2 * (2 - hit1.astype(np.int32))
    return np.bincount(key.ravel(), minlength=n * 96).reshape(n, 32, 3)


_LOW = np.uint64((1 << 32) - 1)
_LEAST, _SHIFT, _UNIT, _HALF = np.uint64(1 << 32), np.uint64(16), np.uint64(BITS), np.uint64(32)
#: The decoder's, in exact floating-point numbers.
_LEAST_F, _PER_UNIT, _LAST = float(1 << 32), 1 / (1 << BITS), float((1 << BITS) - 1)


def _by_length(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """Order of the blocks, their sizes in it, and runs (from step, to step, blocks that reach them)."""
    order = np.argsort(-sizes, kind="stable")
    n = sizes[order]
    ends = np.unique(n[n > 0])
    return order, n, [(int(a), int(z), int((n >= z).sum())) for a, z in zip(np.concatenate(([0], ends)), ends)]


def _predicted(context: np.ndarray, now: np.ndarray) -> np.ndarray:
    """What the slots of a block (a row) predict at each step: the id, shifted by 2, plus its hits in a row.

    That is what the step before with the same slot left there, so that sorting the steps by
    slot puts next to each other what the decoder writes and finds.
    """
    lanes, steps = now.shape
    shift = steps.bit_length() + 29  # slot, step, check (13 bits), id (16 bits)
    key = (context & (_SLOTS - 1)).astype(np.int64) << (shift - 29)
    key += np.arange(steps)
    key <<= 13
    key += context >> SLOTS_BITS
    key <<= 16
    key += now
    key.sort(axis=1)
    change = np.empty(lanes * steps, np.int64)
    key = key.ravel()
    np.bitwise_xor(key[1:], key[:-1], out=change[1:])
    change &= ~(((1 << shift) - 1) ^ ((1 << 29) - 1))  # whatever the steps
    change[::steps] = 1 << shift
    hit = change == 0
    twice = hit.copy()
    twice[1:] &= hit[:-1]
    left = ((key & 0xFFFF) << 2).astype(np.int32)
    left += 1
    left += hit
    left += twice
    found = np.zeros(lanes * steps, np.int32)
    found[1:] = left[:-1]
    found &= np.where(change < 1 << 16, -1, np.where(change < 1 << shift, ~3, 0)).astype(np.int32)
    key >>= 29
    key &= (1 << (shift - 29)) - 1
    key.reshape(lanes, steps)[:] += np.arange(lanes)[:, None] * steps
    out = np.empty(lanes * steps, np.int32)
    out[key] = found
    return out.reshape(lanes, steps)


def _intervals(symbol: np.ndarray, id_at: np.ndarray, m: _Lanes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of the interval of each id of some blocks (rows, two numbers before the first id), of 1 << BITS."""
    now, b1, b2 = np.ascontiguousarray(symbol[:, 2:]), np.ascontiguousarray(symbol[:, 1:-1]), symbol[:, :-2]
    lanes, steps = now.shape
    place = m.kinds.take(b1 + id_at[:, None])
    place *= m.wide + 1
    place += now
    start = m.sums.take(place)
    place += 1
    freq = m.sums.take(place)
    freq -= start
    x1, x2 = _predicted(b1, now), _predicted(_order2(b1, b2), now)
    p1, p2 = x1 >> 2, x2 >> 2
    x1 &= 3
    x2 &= 3
    is1, is2 = p1 == now, p2 == now
    standing = (x2 << 3) + (x1 << 1)
    standing += p1 == p2
    full = steps // REFRESH
    standing += (np.arange(lanes)[:, None] * (full + 1) + np.arange(steps) // REFRESH).astype(np.int32) * 32
    got = _outcomes(standing, is1 & (x1 > 0), is2 & (x2 > 0), lanes * (full + 1)).reshape(lanes, full + 1, 32, 3)
    counts = np.empty((lanes, full + 1, 32, 3))
    counts[:, 0] = _start_counts()
    for i in range(full):
        counts[:, i + 1] = counts[:, i] / 2 + got[:, i]
    zero, one, two = (x.take(standing) for x in _shares(counts))
    start *= zero
    start += one * (p1 < now)
    start += two * (p2 < now)
    freq *= zero
    freq += one * is1
    freq += two * is2
    return start, freq


def encode(blocks: list[np.ndarray], group: np.ndarray, tables: list[Tables]) -> list[np.ndarray]:
    """16-bit words of each block of ids; group: which tables each uses."""
    if not blocks:
        return []
    order, n, runs = _by_length(np.array([len(b) for b in blocks]))
    lanes, steps = len(n), int(n[0])
    if steps >> 24:
        raise ValueError("a block is too long")
    group = np.asarray(group, np.int64)[order]
    m = _Lanes(tables, group, False)
    begins, sizes = np.empty((steps, lanes), np.int32), np.empty((steps, lanes), np.int32)
    number: dict[int, np.ndarray] = {}
    for first in range(0, lanes, BESIDE):
        own = order[first : first + BESIDE].tolist()
        symbol = np.zeros((len(own), int(n[first]) + 2), np.int32)  # two before the first
        for row, k in enumerate(own):
            g = int(group[first + row])
            if g not in number:
                number = {g: np.zeros(int(tables[g].ids[-1]) + 1, np.int32)}
                number[g][tables[g].ids] = np.arange(len(tables[g].ids))
            symbol[row, 2 : 2 + len(blocks[k])] = number[g].take(blocks[k])
        if n[first]:
            at = slice(first, first + len(own))
            lo, size = _intervals(symbol, m.id_at[at], m)
            begins[: n[first], at], sizes[: n[first], at] = lo.T, size.T
    words = np.zeros(lanes * (2 * steps + 4), np.uint32)  # with a carry above 16 bits
    at = np.arange(lanes) * (2 * steps + 4)
    begin = at.copy()
    low, wide = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
    for first, last, live in runs:
        low_, wide_ = low[:live], wide[:live]
        for t in range(first, last):
            unit = wide_ >> _UNIT
            low_ += begins[t, :live].astype(np.uint64) * unit
            np.multiply(sizes[t, :live].astype(np.uint64), unit, out=wide_)
            short = np.flatnonzero(wide_ < _LEAST)
            while len(short):
                x, to = low[short], at[short]
                words[to] = x >> _HALF
                at[short] = to + 1
                low[short] = (x & _LOW) << _SHIFT
                w = wide[short] << _SHIFT
                wide[short] = w
                short = short[w < _LEAST]
    for _ in range(3):
        words[at] = low >> _HALF
        at += 1
        low = (low & _LOW) << _SHIFT
    out: list = [None] * lanes
    for row, k in enumerate(order.tolist()):
        own = words[begin[row] : at[row]]
        over = np.flatnonzero(own >> 16)
        while len(over):  # carries run towards the front
            own[over] &= 0xFFFF
            own[over - 1] += 1
            over = over[own[over - 1] >> 16 > 0] - 1
        out[k] = own.astype("<u2")
    return out


def decode(words: list[np.ndarray], sizes: np.ndarray, group: np.ndarray, tables: list[Tables]) -> list[np.ndarray]:
    """The ids of the blocks."""
    if not words:
        return []
    order, n, runs = _by_length(np.asarray(sizes))
    lanes, steps = len(n), int(n[0])
    group = np.asarray(group, np.int64)[order]
    m = _Lanes(tables, group, True)
    parts = [words[k] for k in order.tolist()]
    length = np.array([len(p) for p in parts])
    flat = np.concatenate([*parts, np.zeros(8, np.uint16)])
    at = np.cumsum(length) - length
    code = np.zeros(lanes, np.uint64)
    for _ in range(3):
        code = (code << _SHIFT) | flat.take(at, mode="clip")
        at = at + 1
    code, wide = code.astype(np.float64), np.full(lanes, float((1 << 48) - 1))  # below 1 << 48, so exact
    out = np.zeros((steps + 2, lanes), np.int32)
    weight, most = np.array([[2], [8]]), np.array([2])
    for first, last, live in runs:
        id_at, standing_at, kinds = m.id_at[:live], m.standing_at[:live], m.kinds
        slots_at = np.stack((m.slots_at[:live], m.slots_at[:live] + lanes * _SLOTS))
        share_at = np.arange(3)[:, None] * (lanes * 32)
        # a row for order 1 and one for order 2
        context, place, before = np.empty((2, live), np.int64), np.empty((2, live), np.int64), np.empty((2, live), bool)
        s, b2 = out[first + 1, :live].astype(np.int64), out[first, :live].astype(np.int64)
        code_, wide_, at_ = code[:live], wide[:live], at[:live]
        for t in range(first, last):
            b1 = context[0] = s
            b2 *= 0x9E3779B1
            b2 += b1 * 0x85EBCA6B
            b2 &= 0xFFFFFFFF
            np.right_shift(b2, 32 - SLOTS_BITS - 13, out=context[1])
            b2 = b1
            kind = kinds.take(b1 + id_at)
            base = kind * (m.wide + 1)
            slot = context & (_SLOTS - 1)
            slot += slots_at
            context -= context & (_SLOTS - 1)
            context <<= 18 - SLOTS_BITS  # the check, as entries have it
            p = m.after.take(slot).astype(np.int64)
            hits = p & 3
            hits *= (p ^ context) < 1 << 18
            p >>= 2
            p &= 0xFFFF
            p1, p2 = p
            standing = hits * weight
            standing = standing[0] + standing[1]
            standing += p1 == p2
            standing += standing_at
            shares = m.shares.take(standing + share_at)
            zero, own = shares[0], shares[1:]
            unit = np.floor(wide_ * _PER_UNIT)
            # exact: the quotient has 26 bits, and is 2 ** -22 from the next integer at least
            value = np.minimum(code_ / unit, _LAST).astype(np.int32)
            # order 1 has its share at the begin of its id, order 2 after that where they agree
            to = m.sums.take(p + base, mode="clip")
            to *= zero
            np.less(p2, p1, out=before[0])
            np.logical_not(before[0], out=before[1])
            to += own[::-1] * before
            reached = value >= to
            to += own
            past = value >= to
            passed = own * past
            value -= passed[0]
            value -= passed[1]
            kind <<= FINE
            kind += (value / zero.astype(np.float64)).astype(np.int64)
            s = m.find.take(kind, mode="clip").astype(np.int64)
            reached ^= past  # within the share of a prediction, where the id is the predicted one
            passed = p - s
            passed *= reached
            s += passed[0]
            s += passed[1]
            np.add(base, s, out=place[0])
            np.add(place[0], 1, out=place[1])
            start, size = m.sums.take(place)
            size -= start
            size *= zero
            start *= zero
            right = p == s
            part = own * right
            size += part[0]
            size += part[1]
            part = own * (p < s)
            start += part[0]
            start += part[1]
            code_ -= start * unit
            np.multiply(size, unit, out=wide_)
            short = np.flatnonzero(wide_ < _LEAST_F)
            while len(short):
                to = at_[short]
                at_[short] = to + 1
                code_[short] = code_[short] * 65536.0 + flat.take(to, mode="clip")
                w = wide_[short] * 65536.0
                wide_[short] = w
                short = short[w < _LEAST_F]
            out[t + 2, :live] = s
            hits *= right
            context += s << 2
            context += np.minimum(hits, most)
            context += 1
            m.after[slot] = context.astype(np.int32)
            m.tell(standing, hits)
    back: list = [None] * lanes
    ids = np.ascontiguousarray(out[2:].T)
    for row, k in enumerate(order.tolist()):
        back[k] = m.ids[group[row]].take(ids[row, : n[row]])
    return back
