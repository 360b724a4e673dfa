"""Ids of whole batches of text through a word table.

For tokenizers that lower-case, split words by kinds of characters and merge within
words only: the batch is cut into words with numpy, every word is looked up by a
64-bit hash in an open table, and the library is asked for new words only.  The
table is bounded and starts anew when it is full.
"""

from __future__ import annotations

import re

import numpy as np

_SPACE, _LETTER, _DIGIT, _PUNCT, _ODD, _WHOLE = range(6)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _PUNCT
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _ODD  # an apostrophe may start a contraction
#: Characters that lower-case one to one and are composed (NFC), or punctuation; others go to the library.
_SIMPLE = re.compile("[\x00-įı-ɏ‐-‿]*")
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BITS = 22
_FULL = 1_500_000
BATCH_BYTES = 1 << 18
_U = np.uint64


class WordTable:
    """``whole(texts)`` gives ids by the library; ``merge(word)`` those of one word of letters."""

    def __init__(self, whole, merge):
        self.whole, self.merge = whole, merge
        self._clear()
        self._grow(BATCH_BYTES * 2)

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _BITS, np.uint64)
        self.values = np.zeros(1 << _BITS, np.int32)
        self.offset, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.words = self.used = 0

    def _grow(self, n: int) -> None:
        """Powers of the hash base and of its inverse."""
        power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        self.power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and their numbers."""
        out, counts = [], np.zeros(len(texts), np.int64)
        group, owners, size = [], [], 0
        for k, text in enumerate(texts):
            plain = "<|" not in text and (text.isascii() or _SIMPLE.fullmatch(text))
            if not plain or len(text) > BATCH_BYTES:
                if group:
                    out.append(self._group(group, owners, counts))
                    group, owners, size = [], [], 0
                for piece in _cut(text) if plain else [None]:
                    if piece is None:
                        ids = np.array(self.whole([text])[0], np.uint16)
                        counts[k] += len(ids)
                        out.append(ids)
                    else:
                        out.append(self._group([piece], [k], counts))
                continue
            raw = text.lower().encode()
            if group and size + len(raw) > BATCH_BYTES:
                out.append(self._group(group, owners, counts))
                group, owners, size = [], [], 0
            group.append(raw)
            owners.append(k)
            size += len(raw) + 1
        if group:
            out.append(self._group(group, owners, counts))
        return (np.concatenate(out) if out else np.zeros(0, np.uint16)), counts

    def _group(self, raws: list[bytes], owners: list[int], counts: np.ndarray) -> np.ndarray:
        data = b" ".join(raws)
        a = np.frombuffer(data, np.uint8)
        if not len(a):
            return np.zeros(0, np.uint16)
        kind = _CLASS[a]
        lead = np.flatnonzero(a[:-1] == 0xC3)
        if len(lead):  # letters from U+00DF on, but for the division sign
            then = a[lead + 1]
            lead = lead[(then >= 0x9F) & (then != 0xB7)]
            kind[lead] = kind[lead + 1] = _LETTER
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):  # a chunk with such a character is one unit
            inside = kind != _SPACE
            chunk = np.cumsum(inside & ~np.r_[False, inside[:-1]])
            bad = np.zeros(chunk[-1] + 1, bool)
            bad[chunk[odd]] = True
            kind[bad[chunk] & inside] = _WHOLE
        change = kind[1:] != kind[:-1]
        single = kind == _DIGIT
        word = kind != _SPACE
        first = np.flatnonzero((np.r_[True, change] | single) & word)
        last = np.flatnonzero((np.r_[change, True] | single) & word) + 1
        if not len(first):
            return np.zeros(0, np.uint16)
        if len(a) > len(self.power):
            self._grow(len(a))
        sums = np.empty(len(a) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(a * self.power[: len(a)], out=sums[1:])
        h = (sums[last] - sums[first]) * self.inverse[first]
        h ^= (last - first).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
        h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        h[h == 0] = 1
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            if self.words + len(new) > _FULL:
                self._clear()
                new = np.arange(len(h))
            keys, at = np.unique(h[new], return_index=True)
            at = new[at]
            self._add(keys, [data[s:e] for s, e in zip(first[at].tolist(), last[at].tolist())], kind[first[at]] == _LETTER)
            entry[new] = self._find(h[new])
        n = self.length[entry]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.offset[entry] - (ends - n), n) + np.arange(ends[-1])]
        bounds = np.cumsum([len(r) + 1 for r in raws])
        upto = np.r_[0, ends][np.searchsorted(first, bounds)]
        np.add.at(counts, owners, np.diff(upto, prepend=0))
        return ids

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 for none."""
        slot = (h >> _U(64 - _BITS)).astype(np.int64)
        found = self.keys[slot]
        out = np.where(found == h, self.values[slot], -1).astype(np.int64)
        todo = np.flatnonzero((found != h) & (found != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _BITS) - 1)
            found = self.keys[slot[todo]]
            hit = found == h[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (found != 0)]
        return out

    def _add(self, keys: np.ndarray, words: list[bytes], letters: np.ndarray) -> None:
        ids: list = [None] * len(words)
        rest = []
        for k, (w, plain) in enumerate(zip(words, letters.tolist())):
            if plain:
                ids[k] = self.merge(w.decode())
            else:
                rest.append(k)
        for k, got in zip(rest, self.whole([words[k].decode() for k in rest]) if rest else ()):
            ids[k] = got
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros_like(self.pool)]
        while self.words + len(n) > len(self.length):
            self.length, self.offset = np.r_[self.length, np.zeros_like(self.length)], np.r_[self.offset, np.zeros_like(self.offset)]
        self.pool[self.used : self.used + len(flat)] = flat
        entry = np.arange(self.words, self.words + len(n))
        self.length[entry], self.offset[entry] = n, self.used + np.cumsum(n) - n
        self.used, self.words = self.used + len(flat), self.words + len(n)
        slot, todo = (keys >> _U(64 - _BITS)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]
            won = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[won]]] = entry[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & ((1 << _BITS) - 1)


def _cut(text: str):
    """Lower-cased pieces of a long text, cut at blanks; None alone where it has too few."""
    pieces, at = [], 0
    while len(text) - at > BATCH_BYTES:
        cut = text.rfind(" ", at, at + BATCH_BYTES)
        if cut <= at:
            return [None]
        pieces.append(text[at:cut].lower().encode())
        at = cut
    return [*pieces, text[at:].lower().encode()]
