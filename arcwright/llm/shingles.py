"""Word n-grams of whole texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at a time.
BLOCK = 1 << 18
_table = np.random.RandomState(7).randint(1, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a multiply-xorshift finalizer)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, BLOCK), base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each run of bytes that aren't ASCII white space."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        raw = np.frombuffer(data, np.uint8, end - at, at)
        if end < len(data) and not _white[raw[-1]]:
            gaps = np.flatnonzero(_white[raw])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # a word longer than a block
                while end < len(data) and not _white[data[end]]:
                    end += 1
            raw = np.frombuffer(data, np.uint8, end - at, at)
        up, down = _power(len(raw))
        word = np.concatenate([[False], ~_white[raw], [False]])
        turns = np.flatnonzero(word[1:] != word[:-1])
        s, e = turns[::2], turns[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_table[raw] * up, dtype=np.uint64)])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its lower-cased word n-grams.

    A text of one to n - 1 words has one n-gram, all its words; one without words none.
    """
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    hashes, starts = word_hashes(b" ".join(raw))
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    first = np.searchsorted(starts, begins)
    odd = [np.uint64(pow(_BASE, 2 * j + 3, 1 << 64)) for j in range(n)]
    grams = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for j in range(n):
        grams += hashes[j : j + len(grams)] * odd[j]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            total = np.uint64((b - a) * 0x51ED27)
            for j in range(b - a):
                total = total + hashes[a + j : a + j + 1] * odd[j]
            out.append(mix(np.atleast_1d(total)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
