"""Content-chosen anchors of a byte string: any stretch of WINDOW bytes holds one, chosen by its content alone.

Of the GRAM-byte strings that start in a stretch, the one with the least hash is its anchor (all of them, if equal).
Equal stretches thus have equal anchors at equal places, wherever they stand. An anchor's context is what the
stretches that it is the anchor of cover; contexts are named by a hash of their bytes and of the anchor's place in
them. Strings known to be common come after all others, so that a line that stands everywhere is no anchor of
stretches that hold anything else.
"""

from __future__ import annotations

import numpy as np

WINDOW = 50
GRAM = 20
REACH = WINDOW - GRAM  # bytes before an anchor, and behind its gram, that a stretch can reach
CONTEXT = WINDOW + REACH

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand up to a chunk's length."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()
_CHUNK = 1 << 20


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every run of ``width`` values."""
    size, out = 1, x
    while 2 * size <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)

    def words(at: int) -> np.ndarray:
        return np.ndarray((n,), "<u8", raw.data, at, (1,)).astype(np.uint64)

    x = words(0) * np.uint64(_BASE) ^ (words(8) >> np.uint64(3))
    x = (x ^ (x >> np.uint64(32))) * _MIX_1 + words(8)
    return mix(x + words(GRAM - 8) * _MIX_2)


class CommonGrams:
    """A set of gram hashes that is fast to rule out: a bit table first, then a search."""

    BITS = 20

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes.astype(np.uint64))
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[(self.hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = self.table[(hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
        at = np.flatnonzero(found)
        near = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        found[at] = self.hashes[near] == hashes[at]
        return found


NONE = CommonGrams(np.zeros(0, np.uint64))


def anchors(data: np.ndarray, common: CommonGrams = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a byte string: anchors' places, gram hashes, context hashes, context starts and ends, all in order of place."""
    if len(data) < WINDOW:
        none, places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return places, none, none, places, places
    if len(data) > 2 * _CHUNK:  # chunks overlap so far that what decides about an anchor lies whole in its own
        parts = []
        for at in range(0, len(data), _CHUNK):
            low, high = max(0, at - 2 * CONTEXT), min(len(data), at + _CHUNK + 2 * CONTEXT)
            place, gram, context, start, end = anchors(data[low:high], common)
            inside = (place + low >= at) & (place + low < at + _CHUNK)
            parts.append((place[inside] + low, gram[inside], context[inside], start[inside] + low, end[inside] + low))
        return tuple(np.concatenate(p) for p in zip(*parts))
    grams = gram_hashes(data)
    order = grams
    if len(common.hashes):
        order = (grams >> np.uint64(1)) | (common.has(grams).astype(np.uint64) << np.uint64(63))
    span = WINDOW - GRAM + 1
    least = _sliding(order, span, np.minimum)
    # A gram is an anchor if it is the least of some stretch around it.
    bordered = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    place = np.flatnonzero(_sliding(bordered, span, np.maximum) == order)
    # Stretches with one and the same least value follow each other, and so do the anchors of that value.
    first = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
    last = np.r_[first[1:], len(least)] - 1
    value = order[place]
    run = np.cumsum(np.r_[False, value[1:] != value[:-1]])
    start = np.maximum(first[run], place - span + 1)
    end = np.minimum(last[run], place) + WINDOW
    up, down = _POWERS.of(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)])
    context = (sums[end] - sums[start]) * down[start]
    context = mix(context + (place - start).astype(np.uint64) * _MIX_1 + (end - start).astype(np.uint64) * _MIX_2)
    return place, grams[place], context, start, end
