"""Vectorised word and shingle hashing over batches of texts.

Words are maximal runs of anything but ``[\\x20\\x09-\\x0D]``; a shingle is five
consecutive words of one text (the whole word list when it has fewer than five).
Everything below works on one concatenated byte array per batch, so the cost is
a few numpy passes over the bytes rather than a Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

SHINGLE_WORDS = 5
#: Bytes hashed at once; bounds the temporary arrays, not the length of a text.
CHUNK_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads every bit."""
    h = h ^ (h >> _SHIFT)
    h = h * _M1
    h ^= h >> _SHIFT
    h = h * _M2
    return h ^ (h >> _SHIFT)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if n > len(_powers.get("up", ())):
        m = max(n, CHUNK_BYTES + (1 << 17))
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and where each text's words begin (one more at the end)."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    white = _WHITE[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = not white[0]
    np.logical_and(~white[1:], white[:-1], out=edge[1:])
    starts = np.flatnonzero(edge)
    np.logical_and(white[1:], ~white[:-1], out=edge[1:])
    edge[0] = False
    ends = np.flatnonzero(edge)
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(texts: Sequence[bytes], size: int = SHINGLE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, word hashes) of each text, in order; both empty for a text without words."""
    at = 0
    while at < len(texts):
        to, room = at, 0
        while to < len(texts) and (to == at or room + len(texts[to]) < CHUNK_BYTES):
            room += len(texts[to]) + 1
            to += 1
        words, begin = word_hashes(texts[at:to])
        n = len(words) - size + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(size):
            grams += words[j : j + len(grams)] * _PLACE[j]
        grams = mix(grams)
        for k in range(to - at):
            a, b = begin[k], begin[k + 1]
            own = words[a:b]
            if b - a >= size:
                g = np.sort(grams[a : b - size + 1])
                yield g[np.concatenate(([True], g[1:] != g[:-1]))], own
            elif b > a:
                yield mix(np.sum(own * _PLACE[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a)), own
            else:
                yield own, own
        at = to


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same / (len(both) - same)
