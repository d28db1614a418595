"""Token ids of many texts by way of their words: a table of fixed size in numpy, without a Python object per word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from tenura.llm.common import mixed, slices

#: Odd multipliers of two independent hashes; powers of their inverses modulo 2 ** 64 shift a hash along the buffer.
STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SLOTS = 1 << 21
IDS = 1 << 24
SLICE = 500_000
#: Longer words are not looked up; they are worked out each time, one at a time.
LONG = 4096

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE + 1), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each span of a byte buffer; equal bytes have equal hashes wherever they stand."""
    data = buffer.astype(np.uint64) + np.uint64(1)
    out = []
    for step in STEPS:
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(data * _power(step, len(buffer)), dtype=np.uint64, out=sums[1:])
        raw = (sums[ends] - sums[starts]) * _power(pow(step, -1, 1 << 64), len(buffer) + 1)[starts]
        out.append(mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(step)))
    return out


class WordTable:
    """Ids of words, kept in a table of `slots` places and at most `room` ids; the memory is the same for every corpus.

    `encode` takes distinct words as bytes and returns all their ids in a row, and how many each has; a negative number marks
    a word that must not be looked at alone. A word has one place, given by its hash; a new word takes it from the
    old one. When the ids fill up, the table starts anew. Words are compared by 128 bits of hash.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind, slots: int = SLOTS, room: int = IDS):
        self.encode, self.room = encode, room
        self.shift = np.uint64(64 - (slots.bit_length() - 1))
        self.marks = [np.zeros(slots, np.uint64) for _ in STEPS]
        self.at, self.n = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.ids = np.zeros(room, kind)
        self.used = 0

    def find(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ascending spans in a row, and how many each span has. What is held beside the result is bounded."""
        parts = []
        at, long = 0, np.append(np.flatnonzero(ends - starts > LONG), len(starts))
        while at < len(starts):
            barrier = int(long[np.searchsorted(long, at)])
            if barrier == at:
                parts.append(self.encode([buffer[starts[at] : ends[at]].tobytes()]))
                at += 1
                continue
            stop = min(barrier, max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, side="right"))))
            base = starts[at]
            parts.append(self._window(buffer[base : ends[stop - 1]], starts[at:stop] - base, ends[at:stop] - base))
            at = stop
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return self.ids[:0], np.zeros(0, np.int64)
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([n for _, n in parts])

    def _window(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = hashes(buffer, starts, ends)
        slot = (one >> self.shift).astype(np.int64)
        hit = (self.marks[0][slot] == one) & (self.marks[1][slot] == two)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        store = self.ids
        missed = np.flatnonzero(~hit)
        if len(missed):
            kinds, first, place = np.unique(one[missed], return_index=True, return_inverse=True)
            rows = missed[first]
            data = buffer.tobytes()
            words = [data[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist())]
            ids, counts = self.encode(words)
            fresh = np.concatenate([[0], np.cumsum(np.maximum(counts, 0))])
            if self.used + len(ids) > self.room:  # start anew; the hits of this call point into the old ids
                store, self.used = self.ids[: self.used].copy(), 0
                for marks in self.marks:
                    marks[:] = 0
            base = self.used
            if len(ids) <= self.room:
                self.ids[base : base + len(ids)] = ids
                self.used += len(ids)
                plain = np.flatnonzero(counts >= 0)
                own = slot[rows[plain]]
                self.marks[0][own], self.marks[1][own] = kinds[plain], two[rows[plain]]
                self.at[own], self.n[own] = base + fresh[:-1][plain], counts[plain]
            if store is not self.ids or len(ids) > self.room:
                base, store = len(store), np.concatenate([store, ids])
            at[missed], n[missed] = base + fresh[:-1][place], counts[place]
        sizes = np.maximum(n, 0)
        ends_ = np.cumsum(sizes)
        total = int(ends_[-1]) if len(ends_) else 0
        return store[np.repeat(at - ends_ + sizes, sizes) + np.arange(total)], n


def unit_slices(texts: list[str], lead: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (first, last, buffer, starts, ends, bounds) of a batch: units are cut before every space and line feed.

    Every text starts with `lead`, one space or line feed. Its units are those from bounds[i] to bounds[i + 1].
    """
    for first, last in slices(texts, SLICE):
        parts = [lead + t.encode() for t in texts[first:last]]
        buffer = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.flatnonzero((buffer == 32) | (buffer == 10))
        ends = np.concatenate([starts[1:], [len(buffer)]])
        text_starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        yield first, last, buffer, starts, ends, np.searchsorted(starts, text_starts)
