"""External induced suffix sorting.

The suffixes of a string of symbols are sorted by recursive induction: the leftmost S-type (LMS) substrings are sorted
by inducing from their first symbols, named, and the string of their names is sorted in the
same way; from the sorted LMS suffixes all L-type and then all S-type ones are induced.

Induction is a priority queue of (symbol, turn, place) tuples.  Here the queue is cut into ranges of symbols
and popped a range at a time: what earlier ranges have pushed is already in order of turn, and what a
range pushes into itself is settled by repeated stable sorts of that range alone.
Ranges that wait are held in memory up to a limit and appended to files beyond it, so
memory follows the largest range and the string itself, not the queue.

Order is only needed to ``depth`` symbols; suffixes that agree so far may come in any order.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from .shingles import mix

RANGES, HELD_BYTES = 96, 4 << 20


class RangeQueue:
    """Places pushed into ranges and popped once, in the order of their coming; spills to files."""

    def __init__(self, ranges: int, folder: str, name: str, limit: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(ranges)]
        self.path, self.limit, self.held, self.spilled = f"{folder}/{name}", limit, 0, set()

    def push(self, places: np.ndarray, ranges: np.ndarray) -> None:
        order = np.argsort(ranges, kind="stable")
        places, ranges = places[order], ranges[order]
        first = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
        for a, b in zip(first, np.append(first[1:], len(ranges)) if len(ranges) else []):
            self.parts[ranges[a]].append(places[a:b])
        self.held += places.nbytes
        if self.held > self.limit:
            for r, own in enumerate(self.parts):
                if own:
                    with open(f"{self.path}-{r}", "ab") as out:
                        np.concatenate(own).tofile(out)
                    self.spilled.add(r)
                    self.parts[r] = []
            self.held = 0

    def pop(self, r: int) -> np.ndarray:
        own, self.parts[r] = self.parts[r], []
        if r in self.spilled:
            self.spilled.remove(r)
            own.insert(0, np.fromfile(f"{self.path}-{r}", np.int64))
            os.remove(f"{self.path}-{r}")
        self.held -= sum(x.nbytes for x in own)
        return np.concatenate(own) if own else np.zeros(0, np.int64)


class _Sorter:
    def __init__(self, text: np.ndarray, folder: str, limit: int, level: int):
        self.text, self.folder, self.limit, self.level = text, folder, limit, level
        n = len(text)
        step = np.sign(np.diff(text.astype(np.int64)))
        turn = np.flatnonzero(step)
        rises = np.zeros(n, bool)  # S-type: smaller than the suffix after it
        if len(turn):
            rises[: turn[-1] + 1] = np.repeat(step[turn] > 0, np.diff(turn, prepend=-1))
        self.rises = rises
        self.lms = np.flatnonzero(rises[1:] & ~rises[:-1]) + 1
        symbols, counts = np.unique(text, return_counts=True)
        whose = np.cumsum(counts) // max(1, n // RANGES)
        new = np.concatenate([[True], whose[1:] != whose[:-1]])
        self.lows = symbols[new]  # first symbol of each range

    def range_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, self.text[places], side="right") - 1

    def _settle(self, r: int, places: np.ndarray, keys: np.ndarray, ahead: int, up: bool) -> np.ndarray:
        """The range's places in popping order, with those that the range pushes into itself."""
        text, low = self.text, self.lows[r]
        high = self.lows[r + 1] if r + 1 < len(self.lows) else np.iinfo(np.int64).max
        own, own_keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            everything = np.concatenate([places, own])
            order = np.argsort(np.concatenate([keys, own_keys]), kind="stable")
            popped = everything[order]
            before = popped - 1
            fits = (popped > 0) & (self.rises[before] != up)
            fits &= (text[before] < high) if up else (text[before] >= low)
            turn = np.flatnonzero(fits)
            pushed = before[turn]
            if np.array_equal(pushed, own):
                return popped
            symbol = text[pushed].astype(np.int64) - low if up else high - 1 - text[pushed].astype(np.int64) if high != np.iinfo(np.int64).max else self.top - text[pushed].astype(np.int64)
            own, own_keys = pushed, (symbol << 34) + ahead + turn

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """All suffixes, from LMS places in their order."""
        text, rises, n = self.text, self.rises, len(self.text)
        self.top = int(text.max())
        count = len(self.lows)
        home = self.range_of(seeds)
        order = np.argsort(home, kind="stable")
        seeds, cut = seeds[order], np.searchsorted(home[order], np.arange(count + 1))
        falling: list[np.ndarray] = []
        queue = RangeQueue(count, self.folder, f"up-{self.level}", self.limit)
        queue.push(np.array([n - 1]), self.range_of(np.array([n - 1])))  # induced by the end
        for r in range(count):
            came, own = queue.pop(r), seeds[cut[r] : cut[r + 1]]
            low = int(self.lows[r])
            keys = np.concatenate([((text[came].astype(np.int64) - low) << 34) + np.arange(len(came)), ((text[own].astype(np.int64) - low) << 34) + (1 << 33) + np.arange(len(own))])
            popped = self._settle(r, np.concatenate([came, own]), keys, len(came), True)
            falling.append(popped[~rises[popped]])
            before = popped[popped > 0] - 1
            before = before[~rises[before]]
            if r + 1 < count:
                before = before[text[before] >= self.lows[r + 1]]
                queue.push(before, self.range_of(before))
        queue = RangeQueue(count, self.folder, f"down-{self.level}", self.limit)
        out: list[np.ndarray] = [None] * count
        for r in range(count - 1, -1, -1):
            came, own = queue.pop(r), falling[r][::-1]
            high = int(self.lows[r + 1]) - 1 if r + 1 < count else self.top
            keys = np.concatenate([((high - text[came].astype(np.int64)) << 34) + np.arange(len(came)), ((high - text[own].astype(np.int64)) << 34) + (1 << 33) + np.arange(len(own))])
            popped = self._settle(r, np.concatenate([came, own]), keys, len(came), False)
            out[r] = popped[::-1]
            before = popped[popped > 0] - 1
            before = before[rises[before]]
            before = before[text[before] < self.lows[r]]
            queue.push(before, self.range_of(before))
        return np.concatenate(out)


def _names(sorter: _Sorter, lms: np.ndarray) -> np.ndarray:
    """A number for each LMS substring, in the order ``lms`` has them; equal substrings have one."""
    text = sorter.text
    starts = sorter.lms
    ends = np.append(starts[1:] + 1, len(text))  # up to the first symbol of the next one
    n = len(text)
    base = 0x9E3779B97F4A7C15 | 1
    power = np.full(n + 1, base, np.uint64)
    inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(text.astype(np.uint64) + np.uint64(0xABCD)) * power[:n], out=sums[1:])
    whole = (sums[ends] - sums[starts]) * inverse[starts] + mix((ends - starts).astype(np.uint64))
    which = np.searchsorted(starts, lms)
    h = whole[which]
    return which, np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))


def suffix_order(text: np.ndarray, depth: int, folder: str | None = None, limit: int = HELD_BYTES, level: int = 0) -> np.ndarray:
    """Places of all suffixes of ``text`` (non-negative integers), ordered by their first ``depth`` symbols."""
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="quarry-induced-") as own:  # this task's scratch, gone when it ends
            return suffix_order(text, depth, own, limit, level)
    if len(text) < 2 or depth <= 1:
        return np.argsort(text, kind="stable")
    sorter = _Sorter(text, folder, limit, level)
    if len(sorter.lms) == 0:
        return sorter.induce(sorter.lms)
    if len(sorter.lms) == 1:
        return sorter.induce(sorter.lms)
    first = sorter.induce(sorter.lms)
    mark = np.zeros(len(text), bool)
    mark[sorter.lms] = True
    found = first[mark[first]]
    del first
    which, names = _names(sorter, found)
    if names[-1] + 1 < len(found):
        reduced = np.empty(len(found), np.int64)
        reduced[which] = names
        found = sorter.lms[suffix_order(reduced, depth // 2 + 2, folder, limit, level + 1)]
    return sorter.induce(found)


def repeated_starts(pieces: list[tuple[bytes, int, bytes]], counts: list[int], width: int, limit: int = HELD_BYTES) -> list[np.ndarray]:
    """Of each piece (left bytes, number of its middle, right bytes) which of its first ``counts`` starts repeat.

    A piece is read as left symbols, one symbol for the middle, right symbols; a start repeats if
    the ``width`` symbols from it also start anywhere else.
    """
    numbers = {m: k for k, m in enumerate(sorted({m for _, m, _ in pieces}))}
    lengths = np.array([len(a) + len(b) + 2 for a, _, b in pieces], np.int64)
    begin = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join([a + b"\0" + b + b"\0" for a, _, b in pieces]), np.uint8).astype(np.int64) + 1
    text[begin + [len(a) for a, _, _ in pieces]] = [257 + numbers[m] for _, m, _ in pieces]
    text[begin + lengths - 1] = 0
    n = np.array(counts, np.int64)
    starts = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    order = suffix_order(text, width, limit=limit)
    order = order[valid[order]]  # whole strings only: a shorter suffix meets its end before ``width``
    again = np.zeros(len(text), bool)
    for at in range(0, len(order) - 1, 1 << 16):
        a, b = order[at : at + (1 << 16)], order[at + 1 : at + 1 + (1 << 16)]
        a = a[: len(b)]
        same = np.ones(len(a), bool)
        for k in range(width):  # what is still equal, symbol by symbol
            live = np.flatnonzero(same)
            if not len(live):
                break
            same[live] = text[a[live] + k] == text[b[live] + k]
        again[a[same]] = True
        again[b[same]] = True
    return [again[s : s + k] for s, k in zip(begin.tolist(), counts)]
