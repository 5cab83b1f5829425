"""Local moving and merging of communities over neighbours in a file: a task holds a few numbers a symbol, not the edges."""

from __future__ import annotations

import os
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np

#: So many neighbours are held at once, and so many at once while symbols move.
HELD, STRETCH = 1 << 18, 1 << 14
#: So often a stretch of symbols is decided side by side before the rest of it is decided one after the other.
TRIES = 24


class Neighbours:
    """The neighbours of each symbol, by place in the sorted ``ids``, in a file of the task's scratch folder that has no name."""

    def __init__(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]], held: int = HELD, stretch: int = STRETCH):
        """``pairs`` has arrays (symbol, neighbour) with symbols in ascending order; every neighbour is a symbol too."""
        self.held, self.stretch = held, stretch
        with tempfile.TemporaryFile(prefix="quarry-moving-") as raw:
            ids, counts, last = [], [], None
            for node, near in pairs:
                if not len(node):
                    continue
                own, n = np.unique(node, return_counts=True)
                if last is not None and own[0] == last:
                    counts[-1][-1] += n[0]
                    own, n = own[1:], n[1:]
                ids.append(own)
                counts.append(n)
                if len(own):
                    last = own[-1]
                else:
                    ids.pop(), counts.pop()
                raw.write(np.ascontiguousarray(near, dtype=np.int64))
            self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            self.degree = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            del ids, counts
            self.at = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.degree)))
            self.file = tempfile.TemporaryFile(prefix="quarry-moving-")
            raw.seek(0)
            while len(piece := np.frombuffer(raw.read(8 * held), np.int64)):
                self.file.write(np.searchsorted(self.ids, piece).astype(np.int32))
            self.file.flush()

    def __len__(self) -> int:
        return len(self.ids)

    def read(self, a: int, b: int) -> np.ndarray:
        """The neighbours from place ``a`` of the file to ``b``."""
        return np.frombuffer(os.pread(self.file.fileno(), 4 * int(b - a), 4 * int(a)), np.int32)

    def pieces(self, node: int) -> Iterator[np.ndarray]:
        for a in range(self.at[node], self.at[node + 1], self.held):
            yield self.read(a, min(a + self.held, self.at[node + 1]))

    def stretches(self) -> Iterator[tuple[int, int]]:
        """Symbols (first, end) with at most ``stretch`` neighbours together, or one symbol."""
        lo = 0
        while lo < len(self):
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + self.stretch, "right")) - 1)
            yield lo, hi
            lo = hi


def _decided(rows, near, degree, total, m, start):
    """Community of each row: the one of greatest positive gain, the least of equals, else its own.  ``total`` gives the degrees of (row, community) at the row's turn."""
    wide = int(near.max()) + 1 if len(near) else 1
    key = np.sort(rows * wide + near)
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    ties = np.diff(first, append=len(key))
    row, to = np.divmod(key[first], wide)
    other = to != start[row]
    row, to, ties = row[other], to[other], ties[other]
    gain = ties / (2 * m) - total(row, to) * degree[row] / (4 * m * m)
    out = start.copy()
    if len(row):
        begin = np.flatnonzero(np.concatenate((np.ones(1, bool), row[1:] != row[:-1])))
        most = np.maximum.reduceat(gain, begin)
        best = np.flatnonzero((gain == np.repeat(most, np.diff(begin, append=len(row)))) & (gain > 0))
        out[row[best[::-1]]] = to[best[::-1]]  # of equals the first is written last
    return out


def _one(node, pieces, own, total, k, m):
    """Community of one symbol after the others."""
    ties: Counter = Counter()
    for near in pieces:
        ties.update(own[near].tolist())
    best, gain, here = int(own[node]), 0.0, int(own[node])
    for c in sorted(ties):
        if c != here:
            g = ties[c] / (2 * m) - float(total[c]) * k / (4 * m * m)
            if g > gain:
                best, gain = c, g
    return best


def _stretch(nb: Neighbours, lo: int, hi: int, own, total, mark, m: float, tries: int) -> bool:
    """Moves the symbols of a stretch one after the other; whether one moved.

    All are decided side by side, from what those before them were last seen to decide, until none decides otherwise: the first is right at once, the next
    as soon as those before it are, so what stands at the end is what one after the other gives.  Only symbols that may decide otherwise are asked again.
    """
    rows, near = np.repeat(np.arange(hi - lo), nb.degree[lo:hi]), nb.read(nb.at[lo], nb.at[hi])
    degree, start = nb.degree[lo:hi].astype(np.float64), own[lo:hi].astype(np.int64)
    seen = own[near].astype(np.int64)
    before = np.flatnonzero((near >= lo) & (near < lo + rows))
    before_row, before_near = rows[before], near[before] - lo
    now, asked = start.copy(), np.ones(hi - lo, bool)
    span = hi - lo + 1
    for _ in range(tries):
        moved = np.flatnonzero(now != start)
        # what the moves add to a community, in order of its moves
        key = np.concatenate((start[moved], now[moved])) * span + np.concatenate((moved, moved))
        order = np.argsort(key)
        key, added = key[order], np.concatenate((-degree[moved], degree[moved]))[order]
        upto = np.concatenate((np.zeros(1), np.cumsum(added)))

        mark[start[moved]] = mark[now[moved]] = True

        def then(row, to, key=key, upto=upto):
            out, some = total[to], np.flatnonzero(mark[to])
            at = to[some] * span
            out[some] += upto[np.searchsorted(key, at + row[some])] - upto[np.searchsorted(key, at)]
            return out

        part = asked[rows]
        got = _decided(rows[part], seen[part], degree, then, m, start)
        mark[start[moved]] = mark[now[moved]] = False
        new = np.where(asked, got, now)
        changed = new != now
        if not changed.any():
            break
        touched = np.concatenate((now[changed], new[changed], start[changed]))
        now = new
        seen[before] = now[before_near]
        mark[touched] = True
        asked = np.zeros(hi - lo, bool)
        asked[before_row[changed[before_near]]] = True
        asked[rows[mark[seen]]] = True
        mark[touched] = False
        asked[: int(np.argmax(changed)) + 1] = False
    else:
        # those before the first that may decide otherwise are settled
        settled = int(np.argmax(asked)) if asked.any() else hi - lo
        now[settled:] = start[settled:]
        _settle(total, own, lo, start, now, degree)
        any_ = bool((now != start).any())
        for node in range(lo + settled, hi):
            any_ |= _move(nb, node, own, total, m)
        return any_
    _settle(total, own, lo, start, now, degree)
    return bool((now != start).any())


def _settle(total, own, lo, start, now, degree) -> None:
    moved = np.flatnonzero(now != start)
    np.subtract.at(total, start[moved], degree[moved])
    np.add.at(total, now[moved], degree[moved])
    own[lo + moved] = now[moved]


def _move(nb: Neighbours, node: int, own, total, m: float) -> bool:
    k = float(nb.degree[node])
    best = _one(node, nb.pieces(node), own, total, k, m)
    if best == own[node]:
        return False
    total[own[node]] -= k
    total[best] += k
    own[node] = best
    return True


def moved(nb: Neighbours, m: float, sweeps: int, tries: int = TRIES) -> np.ndarray:
    """Community of each symbol by local moving, as the place of a symbol; ``m`` is the number of edges of the whole graph.

    Symbols move in order of id to the neighbouring community of greatest positive gain, the lesser id on ties.
    """
    own, total, mark = np.arange(len(nb), dtype=np.int32), nb.degree.astype(np.float64), np.zeros(len(nb), bool)
    for _ in range(sweeps):
        any_ = False
        for lo, hi in nb.stretches():
            if hi - lo == 1:
                any_ |= _move(nb, lo, own, total, m)
            else:
                any_ |= _stretch(nb, lo, hi, own, total, mark, m, tries)
        if not any_:
            break
    return own


def _targets(nb: Neighbours, group: np.ndarray, small: np.ndarray) -> np.ndarray:
    """For each small group the group with most edges to it, the first of equals; -1 where there is none.  ``group`` is that of each symbol."""
    n = len(small)
    to = np.full(n, -1, dtype=np.int64)
    nodes = np.flatnonzero(small[group])
    nodes = nodes[np.argsort(group[nodes], kind="stable")]
    ends = np.cumsum(nb.degree[nodes])
    key, ties, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while lo < len(nodes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + nb.held, "right")))
        for rows, near in _rows(nb, nodes[lo:hi]):
            a, b = group[rows].astype(np.int64), group[near].astype(np.int64)
            pair, count = np.unique((a * n + b)[a != b], return_counts=True)
            key, back = np.unique(np.concatenate((key, pair)), return_inverse=True)
            ties = np.bincount(back, weights=np.concatenate((ties, count)), minlength=len(key)).astype(np.int64)
        lo = hi
        # all but the last group, which may go on, are whole
        whole = len(key) if lo == len(nodes) else int(np.searchsorted(key, group[nodes[lo]].astype(np.int64) * n))
        a, b = np.divmod(key[:whole], n)
        order = np.lexsort((b, -ties[:whole], a))
        mover, first = np.unique(a[order], return_index=True)
        to[mover] = b[order][first]
        key, ties = key[whole:], ties[whole:]
    return to


def _rows(nb: Neighbours, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays (symbol, neighbour) of some symbols, at most ``held`` at once."""
    if len(nodes) == 1:
        for near in nb.pieces(int(nodes[0])):
            yield np.full(len(near), nodes[0]), near
        return
    near = [nb.read(a, b) for a, b in zip(nb.at[nodes].tolist(), nb.at[nodes + 1].tolist())]
    yield np.repeat(nodes, nb.degree[nodes]), np.concatenate(near)


def passes(nb: Neighbours, own: np.ndarray, end: int) -> Iterator[tuple[tuple[int, int, int], int, np.ndarray, np.ndarray]]:
    """The passes of :func:`.communities.merge` over the communities ``own`` of some components: yields (stage, threshold, again), by how many the groups fell,
    and the communities whose group is another now, and which.

    Stages 0 to 2 are the first three passes; in stage 3 the threshold is the size of the smallest group, and ``again`` counts the passes with the same one.
    No pass joins components, so those of the whole graph with one threshold are these side by side.  None has a threshold above ``end``, the size of the
    smallest component: a group without ties that is the smallest ends the merging.  Communities and groups are known by their least symbol at first.
    """
    label, first, place, size = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    names = nb.ids[first]  # symbols are in order, so the first is the least
    del label, first
    order = np.lexsort((names, -size, names == 0))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    of, place = rank.copy(), rank[place].astype(np.int32)  # the group of each community, of each symbol
    size, least, named = size[order], names[order], names[order]
    stage, before, again = 0, None, 0
    while len(size):
        threshold = (3, 5, 10)[stage] if stage < 3 else int(size[-1])
        if stage == 3 and threshold > end:
            return
        again = again + 1 if stage == 3 and threshold == before else 0
        before = threshold if stage == 3 else None
        to = _targets(nb, place, size <= threshold)
        # groups move one after the other, with what has come to their place before
        final = np.arange(len(size))
        for k in np.flatnonzero(to >= 0)[::-1].tolist():
            t = to[k]
            final[k] = final[t] if to[t] >= 0 and t > k else t
        goes = final != np.arange(len(size))
        gone = np.flatnonzero(goes[of])
        kept, back = np.unique(final, return_inverse=True)
        yield (stage, threshold, again), len(size) - len(kept), names[gone], named[final[of[gone]]]
        if stage == 3 and len(kept) == len(size):
            return
        total, low = np.zeros(len(kept), dtype=np.int64), np.full(len(kept), np.iinfo(np.int64).max)
        np.add.at(total, back, size)
        np.minimum.at(low, back, least)
        order = np.lexsort((low, -total))
        rank = np.empty(len(kept), dtype=np.int64)
        rank[order] = np.arange(len(kept))
        size, least, named, new = total[order], low[order], named[kept][order], rank[back]
        of, place = new[of], new.astype(np.int32)[place]
        stage = min(stage + 1, 3)
