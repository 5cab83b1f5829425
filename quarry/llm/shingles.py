"""Word-shingle sets as sorted 64-bit hashes, computed a batch at a time on the bytes of all its texts."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_WORD = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
_BASE = _RANDOM.integers(1, 1 << 63, dtype=np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of the base."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 64), _BASE, np.uint64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers


def joined(texts) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string array and where each text begins (and the last ends); nulls are empty."""
    import pyarrow as pa

    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(texts) else np.zeros(1, np.int64)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, parted by ASCII white space) and each text's first place among them."""
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < at[1:]]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    length = np.add.reduceat(inside, starts, dtype=np.int64)
    place = np.arange(starts[0], len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), np.diff(np.append(starts, len(raw))))
    np.minimum(place, int(length.max()), out=place)
    value = _BYTE[raw[starts[0] :]] * powers(int(length.max()) + 1)[place]
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0]) + length.astype(np.uint64) * _WORD[15]), np.searchsorted(starts, at)


def shingle_sets(texts, size: int = 5) -> list[np.ndarray]:
    """Of each text the distinct shingles of ``size`` words, sorted; of fewer words the whole sequence is one; of none, none."""
    h, at = word_hashes(*joined(texts))
    whole = np.full(max(0, len(h) - size + 1), size * int(_WORD[14]) % (1 << 64), np.uint64)
    for k in range(size):
        whole += h[k : k + len(whole)] * _WORD[k]
    whole = mix(whole)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            s = np.sort(whole[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(_short(h[a:b]))
    return out


def _short(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return np.zeros(0, np.uint64)
    return mix((h * _WORD[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.full(1, len(h), np.uint64) * _WORD[14])


def linked(a: np.ndarray, b: np.ndarray, part: int = 75) -> bool:
    """Whether 100 x shared >= part x all, for sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= part * (len(a) + len(b) - both)
