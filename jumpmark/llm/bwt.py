"""Threshold-bounded interval expansion on a Burrows-Wheeler transform, in numpy.

A text is a byte array in which SEP stands between strings (and first). Suffixes are sorted by their first 64 bytes, which
is all that common prefixes below the threshold need. Boundaries between neighbours in that order are found by increasing
length of their common prefix: packed 8-grams give those below 8; then, breadth first, every interval whose right end is
new is extended backwards by each byte of its part of the transform, and the right end of the interval reached is a
boundary of the next length. Extension stops at the threshold: what is left between boundaries shares that many bytes.
"""

from __future__ import annotations

import numpy as np

SEP = 255  # in no UTF-8 text


def packed(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, big-endian, zeros behind the end."""
    x = np.zeros(len(text) + 8, np.uint64)
    x[: len(text)] = text
    for width in (1, 2, 4):
        x = (x[:-width] << np.uint64(8 * width)) | x[width:]
        x = np.concatenate([x, np.zeros(width, np.uint64)])
    return x[: len(text)]


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first 64 bytes, and the packed 8-grams."""
    grams = packed(text)
    n = len(text)
    order = np.argsort(grams)
    key = grams
    for step in (8, 16, 32):
        fresh = np.empty(n, bool)
        fresh[0] = True
        k = key[order]
        np.not_equal(k[1:], k[:-1], out=fresh[1:])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh)
        if fresh.all():
            break
        key = rank << np.uint64(32)
        key[: n - step] |= rank[step:]
        order = np.argsort(key)
    return order.astype(np.int32), grams


def ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... size[0] of them, then lo[1], ..."""
    total = int(size.sum())
    out = np.ones(total, np.int64)
    starts = np.cumsum(size) - size
    out[starts] = lo
    out[starts[1:]] -= lo[:-1] + size[:-1] - 1
    return np.cumsum(out)


def classes(text: np.ndarray, threshold: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """For each place its rank in suffix order, and for each rank the number of its class of equal first `threshold` bytes.

    Right for places whose first `threshold` bytes hold no SEP. threshold: from 9 to 64.
    """
    n = len(text)
    sa, grams = suffix_order(text)
    isa = np.empty(n, np.int32)
    isa[sa] = np.arange(n, dtype=np.int32)
    bound = np.zeros(n + 1, bool)
    bound[0] = bound[n] = True
    g = grams[sa]
    change = g[1:] ^ g[:-1]
    bound[1:n] = change != 0
    # intervals of 8-grams whose right neighbour shares exactly 7 bytes
    starts = np.flatnonzero(bound[:n])
    ends = np.append(starts[1:], n)
    last = np.zeros(n + 1, bool)
    last[1:n] = (change != 0) & (change < 256)
    pick = last[ends]
    lo, size = starts[pick], ends[pick] - starts[pick]
    for _ in range(8, threshold):
        if not len(lo):
            break
        rows = ranges(lo, size)
        owner = np.repeat(np.arange(len(lo)), size)
        before = sa[rows] - 1
        byte = text[before]  # of the transform; the first place is a SEP and never extended
        use = (byte != SEP) & (before >= 0)
        before, byte, owner = before[use], byte[use], owner[use]
        if not len(before):
            break
        key = owner * 256 + byte
        order = np.argsort(key, kind="stable")
        key, reached = key[order], isa[before[order]]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(reached, first), np.maximum.reduceat(reached, first)
        right = high.astype(np.int64) + 1
        fresh = ~bound[right]
        bound[right[fresh]] = True
        lo, size = low[fresh].astype(np.int64), right[fresh] - low[fresh]
    return isa, np.cumsum(bound[:n]) - 1
