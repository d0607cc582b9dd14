"""Vectorised hashing of byte ranges of a text buffer: words, shingles, pre-tokens.

A range is cut into blocks of eight bytes, and the blocks are mixed pairwise in a tree by a function that is neither
linear nor symmetric, down to one; its length goes in at the end.  A sum or polynomial modulo 2**64 would do with less
work, but has collisions that anyone can write down (words in the order of Thue and Morse).  Buffers are worked through
in pieces of bounded size, cut between ranges, so memory does not follow the longest text.
"""

from __future__ import annotations

import numpy as np

#: Bytes worked through at a time; a single longer range stands alone.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_LEFT, _RIGHT, _LENGTH = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)
#: Whitespace that parts words: space and tab to carriage return.
SPACES = b" \t\n\v\f\r"


def scramble(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, in this order."""
    return scramble(scramble(left + _LEFT) * _RIGHT + right)


def runs(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash for each run of ``hashes``, ``counts`` (at least one each) long, which lie one after another."""
    total = counts
    while len(hashes) > len(counts):
        starts = np.cumsum(counts) - counts
        place = np.arange(len(hashes)) - np.repeat(starts, counts)
        left = np.flatnonzero(place & 1 == 0)
        paired = left + 1 < len(hashes)
        paired[paired] = place[left[paired] + 1] == place[left[paired]] + 1
        made = hashes[left]
        made[paired] = mix(made[paired], hashes[left[paired] + 1])
        hashes, counts = made, (counts + 1) >> 1
    return scramble(hashes + total.astype(np.uint64) * _LENGTH)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, seed: int = 0) -> np.ndarray:
    """Hashes of ``data[starts[i]:ends[i]]``; ranges ascend and do not overlap.  ``fold``: A-Z count as a-z."""
    n = len(starts)
    out = np.empty(n, np.uint64)
    key = scramble(np.array([seed * _BASE + 1 & (1 << 64) - 1], np.uint64))
    at = 0
    while at < n:
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        size = int(ends[to - 1]) - base
        padded = np.zeros(size + 8, np.uint8)
        padded[:size] = _LOWER[data[base : base + size]] if fold else data[base : base + size]
        eights = np.ndarray(size + 1, "<u8", padded.data, strides=(1,))
        s, length = starts[at:to] - base, ends[at:to] - starts[at:to]
        head = scramble((eights[s] & _KEEP[np.minimum(length, 8)]) ^ key)
        long = np.flatnonzero(length > 8)
        if len(long):
            blocks = (length[long] + 7) >> 3
            inside = 8 * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            block = eights[np.repeat(s[long], blocks) + inside] & _KEEP[np.minimum(np.repeat(length[long], blocks) - inside, 8)]
            head[long] = runs(scramble(block ^ key), blocks)
        out[at:to] = scramble(head + length.astype(np.uint64) * _LENGTH)
        at = to
    return out


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def words(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray = ~_IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words (runs of ``chars``) of texts that lie at ``offsets`` in ``data``."""
    inside = chars[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(word_hashes: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all runs of ``size`` words inside one text."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes[:n].copy()
    for i in range(1, size):
        h *= np.uint64(_BASE)
        h += word_hashes[i : i + n]
    at = np.flatnonzero(texts[:n] == texts[size - 1 :])
    return scramble(h[at]), at


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]
