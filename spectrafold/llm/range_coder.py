"""Adaptive context-mixing range coder for token ids.

A segment of ids is coded in phases, and a phase in lanes that go side by side, one
id per lane and step, so every numpy call serves all lanes.  All lanes share one
model of three predictions: the id last seen after the two ids before it (order 2,
learned after every step), the counts of ids seen after the one before it (order 1,
learned after every phase), and adaptive frequencies of the ids that neither
foresaw (order 0).  The mixing weights are learned for each cell of the order-2
prediction's confidence, its present run of hits, and the weight of the order-1
counts.  A lane knows no ids before its own in a phase, so its first id has no
context.  All arithmetic is on integers and IEEE products, hence encoder and decoder
agree everywhere.  A segment starts from a fresh model and carries the crc32 of its
ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SEGMENT = 1 << 21
LANES = 4096
PHASE = 64
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"CMR2"
_U = np.uint64
_TOP, _BOT = _U(1 << 48), _U(1 << 40)
_HASH_BITS = 20
_MIX = 12
_FREQ = 24
_STEP = 6  # vocabulary + _STEP * SEGMENT stays below 2**_FREQ, so every id keeps a share
_CELLS = 4 * 8 * 8
_PLACE = 18  # bits of a place in a phase, of LANES * PHASE ids at most


class _Model:
    """Shared predictions of all lanes; ``vocabulary`` ids, and the id ``vocabulary`` where nothing is known."""

    def __init__(self, vocabulary: int):
        if vocabulary + _STEP * SEGMENT >= 1 << _FREQ:
            raise ValueError("the vocabulary is too large for the frequency scale")
        self.vocabulary = vocabulary
        self.count = np.ones(vocabulary, np.int64)
        self.cum = np.empty(vocabulary + 1, np.uint64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.uint64)
        self.base, self.total = np.zeros(vocabulary + 1, np.uint64), np.zeros(vocabulary + 1, np.uint64)
        self.weight = np.zeros(vocabulary + 1, np.int64)
        self.guess = np.full(1 << _HASH_BITS, -4, np.int32)  # 4 * id + confidence
        self.seen = np.ones((_CELLS, 3), np.int64)
        self.step = 0
        self.fresh, self.cells = [], []
        self._weigh()
        self._rank()

    def _weigh(self) -> None:
        """Mixing weights from how often each prediction was right, by cell."""
        if self.cells:
            self.seen += 2 * np.bincount(np.concatenate(self.cells), minlength=4 * _CELLS).reshape(_CELLS, 4)[:, :3]
            self.cells = []
        if self.seen.max() > 1 << 20:
            self.seen = (self.seen >> 1) + 1
        room = (1 << _MIX) - 3
        total = self.seen.sum(axis=1)
        two, one = 1 + room * self.seen[:, 0] // total, 1 + room * self.seen[:, 1] // total
        bounds = np.stack([np.zeros(_CELLS, np.int64), two, two + one, np.full(_CELLS, 1 << _MIX)], 1)
        self.bounds = bounds.ravel().astype(np.uint64)

    def _rank(self) -> None:
        """Cumulative order-0 frequencies, scaled to 2**_FREQ; every id keeps a share."""
        if self.fresh:
            self.count += _STEP * np.bincount(np.concatenate(self.fresh), minlength=len(self.count))
            self.fresh = []
        sums = np.cumsum(self.count)
        self.cum[0] = 0
        self.cum[1:] = (sums * (float(1 << _FREQ) / float(sums[-1]))).astype(np.uint64)
        self.cum[-1] = 1 << _FREQ

    def follow(self, pairs: np.ndarray) -> None:
        """Add a phase's sorted pairs (one id and the next, as one number) to the order-1 counts."""
        first = _starts(pairs)
        known = np.concatenate([self.pairs, pairs[first]])
        times = np.concatenate([self.times, np.diff(first, append=len(pairs))])
        order = np.argsort(known, kind="stable")  # two sorted runs, which this merges
        known = known[order]
        first = _starts(known)
        self.pairs, self.times = known[first], np.add.reduceat(times[order], first)
        self.sums = np.concatenate([[0], np.cumsum(self.times)]).astype(np.uint64)
        ends = np.searchsorted(self.pairs, np.arange(self.vocabulary + 2) * self.vocabulary)
        self.base, self.total = self.sums[ends[:-1]], np.diff(self.sums[ends])
        self.weight = np.minimum(np.frexp(self.total.astype(np.float64))[1], 14) // 2 * np.int64(128)

    def predict(self, slot: np.ndarray, weight: np.ndarray, run: np.ndarray) -> tuple:
        """Slot and its content, the id that order 2 foresees, its confidence, and the mixing cell (times 4)."""
        held = self.guess[slot]
        sure = held & np.int32(3)
        return slot, held, held >> np.int32(2), sure, weight + run + (sure << np.int32(2))

    def learn(self, x: np.ndarray, hit: np.ndarray, made: tuple, symbol: np.ndarray, missed: np.ndarray) -> None:
        slot, held, _, sure, cell = made
        self.guess[slot] = np.where(hit, held + (sure < 3), np.where(sure > 0, held - np.int32(1), x << np.int32(2)))
        self.cells.append(cell + symbol)
        self.fresh.append(missed)
        self.step += 1
        if self.step <= 8 or self.step % 8 == 0:
            self._weigh()
        if self.step <= 8 or self.step % 32 == 0:
            self._rank()


def _renorm(low: np.ndarray, rng: np.ndarray, emit) -> None:
    """Shift out settled 16-bit words; emit(lanes) is called before the shift of those lanes."""
    settled, short = (low ^ (low + rng)) < _TOP, rng < _BOT
    go = np.flatnonzero(settled | short)
    settled, short = settled[go], short[go]
    while len(go):
        cut = go[short & ~settled]
        if len(cut):
            rng[cut] = (~low[cut] + _U(1)) & (_BOT - _U(1))
        emit(go)
        lo, ra = low[go] << _U(16), rng[go] << _U(16)
        low[go], rng[go] = lo, ra
        settled, short = (lo ^ (lo + ra)) < _TOP, ra < _BOT
        more = settled | short
        go, settled, short = go[more], settled[more], short[more]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _slot(prev: np.ndarray, older: np.ndarray) -> np.ndarray:
    return (older.astype(np.int64) * 40503 + prev * 769) & ((1 << _HASH_BITS) - 1)


def _lanes(n: int) -> int:
    return max(1, min(LANES, n // 640))


def _phases(n: int, lanes: int):
    """First id, number of ids and steps of each phase; phases grow to PHASE steps."""
    at = done = 0
    while at < n:
        steps = min(max(4, done), PHASE, -(-(n - at) // lanes))
        size = min(steps * lanes, n - at)
        yield at, size, steps
        at, done = at + size, done + steps


def encode_segment(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    lanes = _lanes(n)
    model = _Model(vocabulary)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    who, words = [], []

    def emit(go):
        who.append(go)
        words.append((low[go] >> _U(48)).astype(np.uint16))

    for begin, size, steps in _phases(n, lanes):
        grid = np.zeros((lanes, steps), np.int32)
        grid.reshape(-1)[:size] = ids[begin : begin + size]
        before = np.full((lanes, steps), vocabulary, np.int32)
        before[:, 1:] = grid[:, :-1]
        pairs = (before.astype(np.int64) * vocabulary + grid).ravel()[:size]
        keyed = np.sort(pairs << _PLACE | np.arange(size))  # faster than argsort
        order, pairs = keyed & ((1 << _PLACE) - 1), keyed >> _PLACE
        start1, size1 = np.zeros(lanes * steps, np.uint64), np.zeros(lanes * steps, np.uint64)
        if len(model.pairs):
            first = _starts(pairs)
            each = pairs[first]
            found = np.minimum(np.searchsorted(model.pairs, each), len(model.pairs) - 1)
            times = np.where(model.pairs[found] == each, model.times[found], 0)
            often = np.diff(first, append=size)
            start1[order] = np.repeat(model.sums[found] - model.base[each // vocabulary], often)
            size1[order] = np.repeat(times.astype(np.uint64), often)
        grid, before, start1, size1 = (np.ascontiguousarray(y.reshape(lanes, steps).T) for y in (grid, before, start1, size1))
        older = np.full((steps, lanes), vocabulary, np.int32)
        older[1:] = before[:-1]
        slot, weight, other = _slot(before, older), model.weight[before], np.where(size1 > 0, np.int64(1), np.int64(2))
        run = np.zeros(lanes, np.int64)
        for t in range(steps):
            k = -(-(size - t) // steps)  # lanes that still have an id
            x = grid[t, :k]
            made = model.predict(slot[t, :k], weight[t, :k], run[:k])
            hit = made[2] == x
            symbol = other[t, :k] * ~hit
            at = made[4] + symbol
            start = model.bounds[at]
            lo, ra = low[:k], rng[:k]
            r = ra >> _U(_MIX)
            lo += r * start
            ra[:] = r * (model.bounds[at + 1] - start)
            seen = np.flatnonzero(symbol == 1)
            r = ra[seen] // model.total[before[t, seen]]
            lo[seen] += r * start1[t, seen]
            ra[seen] = r * size1[t, seen]
            miss = np.flatnonzero(symbol == 2)
            at = x[miss]
            r = ra[miss] >> _U(_FREQ)
            c = model.cum[at]
            lo[miss] += r * c
            ra[miss] = r * (model.cum[at + 1] - c)
            _renorm(lo, ra, emit)
            model.learn(x, hit, made, symbol, at)
            run[:k] = np.minimum(run[:k] + 16, 112) * hit
        model.follow(pairs)
    lanes_of = np.concatenate(who) if who else np.zeros(0, np.int64)
    value = (low + (_BOT - _U(1))) & ~(_BOT - _U(1))  # its 24 leading bits lie in the last interval
    lanes_of = np.concatenate([lanes_of, np.arange(lanes), np.arange(lanes)])
    out = np.concatenate([*words, (value >> _U(48)).astype(np.uint16), (value >> _U(32)).astype(np.uint16)])
    out = out[np.argsort(lanes_of, kind="stable")]
    lengths = np.bincount(lanes_of, minlength=lanes).astype("<u2")  # an id takes four words at most, a lane has fewer than 1280 ids
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return _HEAD.pack(_MAGIC, n, vocabulary, lanes, crc) + lengths.tobytes() + out.astype("<u2").tobytes()


def decode_segment(data: memoryview) -> tuple[np.ndarray, int]:
    """The ids, and the bytes used."""
    magic, n, vocabulary, lanes, crc = _HEAD.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("no segment of token ids starts here")
    if n > SEGMENT or lanes != _lanes(n):
        raise ValueError("a segment of token ids is damaged")
    lengths = np.frombuffer(data, "<u2", lanes, _HEAD.size).astype(np.int64)
    begin = _HEAD.size + 2 * lanes
    total = int(lengths.sum())
    words = np.concatenate([np.frombuffer(data, "<u2", total, begin).astype(np.uint64), np.zeros(4, np.uint64)])
    end = np.cumsum(lengths)
    at = end - lengths
    model = _Model(vocabulary)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):  # beyond a lane's end come zeros
        code = (code << _U(16)) | words[np.where(at < end, at, total)]
        at = at + 1
    ids = np.zeros(n, "<u4")

    def take(go):
        spot = at[go]
        code[go] = (code[go] << _U(16)) | words[np.where(spot < end[go], spot, total)]
        at[go] = spot + 1

    for first, size, steps in _phases(n, lanes):
        grid, before = np.zeros((steps, lanes), np.int32), np.full((steps, lanes), vocabulary, np.int32)
        older, run = np.full(lanes, vocabulary, np.int32), np.zeros(lanes, np.int64)
        for t in range(steps):
            k = -(-(size - t) // steps)
            p = before[t, :k]
            made = model.predict(_slot(p, older[:k]), model.weight[p], run[:k])
            cell = made[4]
            lo, ra = low[:k], rng[:k]
            r = ra >> _U(_MIX)
            v = (code[:k] - lo) // r
            symbol = (v >= model.bounds[cell + 1]).view(np.int8) + (v >= model.bounds[cell + 2]).view(np.int8)
            bound = cell + symbol
            start = model.bounds[bound]
            lo += r * start
            ra[:] = r * (model.bounds[bound + 1] - start)
            x = made[2].copy()
            seen = np.flatnonzero(symbol == 1)
            c = p[seen]
            if len(c) and not model.total[c].all():
                raise ValueError("a segment of token ids is damaged")
            r = ra[seen] // model.total[c]
            v = model.base[c] + np.minimum((code[seen] - lo[seen]) // r, model.total[c] - _U(1))
            got = _find(model.sums, v)
            x[seen] = model.pairs[got] % vocabulary
            lo[seen] += r * (model.sums[got] - model.base[c])
            ra[seen] = r * (model.sums[got + 1] - model.sums[got])
            miss = np.flatnonzero(symbol == 2)
            r = ra[miss] >> _U(_FREQ)
            got = _find(model.cum, np.minimum((code[miss] - lo[miss]) // r, _U((1 << _FREQ) - 1)))
            x[miss] = got
            c = model.cum[got]
            lo[miss] += r * c
            ra[miss] = r * (model.cum[got + 1] - c)
            _renorm(lo, ra, take)
            hit = symbol == 0
            model.learn(x, hit, made, symbol, got)
            run[:k] = np.minimum(run[:k] + 16, 112) * hit
            older = p
            grid[t, :k] = x
            if t + 1 < steps:
                before[t + 1, :k] = x
        part = grid.T.reshape(-1)[:size]
        ids[first : first + size] = part
        model.follow(np.sort(before.T.reshape(-1)[:size].astype(np.int64) * vocabulary + part))
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a segment of token ids fails its checksum")
    return ids, begin + 2 * total


def _find(sums: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The interval of each value; sorted needles find their place much faster."""
    order = np.argsort(v)
    got = np.empty(len(v), np.int64)
    got[order] = np.searchsorted(sums, v[order], side="right") - 1
    return got


def encode_ids(ids: np.ndarray, vocabulary: int) -> bytes:
    """Segments of at most SEGMENT ids, one after another."""
    return b"".join(encode_segment(ids[k : k + SEGMENT], vocabulary) for k in range(0, len(ids), SEGMENT))


def decode_ids(data: bytes) -> np.ndarray:
    view, out = memoryview(data), [np.zeros(0, "<u4")]
    while len(view):
        ids, used = decode_segment(view)
        out.append(ids)
        view = view[used:]
    return np.concatenate(out)
