"""Suffix arrays by induced sorting, with numpy doing each bucket's work at once.

Suffixes are S-type if smaller than their right neighbour, else L-type; a leftmost S-type suffix (LMS) starts a
substring that reaches to the next one. Sorting the LMS substrings by one round of induction names them; if names repeat, the string of
names is sorted recursively. From the sorted LMS suffixes, L-type suffixes are induced left to right and
S-type ones right to left. Within a bucket, all suffixes known so far move at once, so the work stays linear.

The recursion goes on by induction while names fit ``INDUCE_NAMES`` buckets. A string of more names is
short and nearly all its names are unique; it is sorted by doubling of prefixes.
"""

from __future__ import annotations

import numpy as np

INDUCE_NAMES = 1024


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type; the last one is, as a unique smallest symbol must end the text."""
    n = len(text)
    kind = np.zeros(n, bool)
    kind[-1] = True
    rising, falling = text[:-1] < text[1:], text[:-1] > text[1:]
    kind[:-1] = rising
    level = np.flatnonzero(~(rising | falling))
    if len(level):  # equal neighbours take the type of what follows their run
        run_end = level[np.r_[np.flatnonzero(np.diff(level) != 1), len(level) - 1]]
        lengths = np.diff(np.r_[-1, np.flatnonzero(np.diff(level) != 1), len(level) - 1])
        kind[level] = np.repeat(kind[run_end + 1], lengths)
    return kind


class _Inducer:
    """One text's buckets; ``run`` sorts all suffixes from LMS suffixes given in order."""

    def __init__(self, text: np.ndarray, kind: np.ndarray):
        self.text, self.kind = text, kind
        self.names = int(text.max()) + 1
        sizes = np.bincount(text, minlength=self.names)
        self.ends = sizes.cumsum()
        self.starts = self.ends - sizes
        self.previous_kind = np.r_[False, kind[:-1]]  # type of the suffix one to the left
        self.previous = np.r_[text[:1] * 0, text[:-1]]
        self.buckets = np.flatnonzero(sizes)

    def _append(self, array: np.ndarray, at: np.ndarray, fill: np.ndarray, step: int) -> None:
        """Puts suffixes ``at`` into their buckets, keeping their order, from ``fill`` on in direction ``step``."""
        keys = self.text[at]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        first = np.r_[0, change]
        counts = np.diff(np.r_[first, len(keys)])
        heads = keys[first]
        place = fill[heads] - step * first
        array[np.repeat(place, counts) + step * np.arange(len(keys))] = at
        fill[heads] += step * counts

    def run(self, lms: np.ndarray) -> np.ndarray:
        """``lms``: LMS suffixes, in order within each bucket."""
        text, n = self.text, len(self.text)
        array = np.full(n, -1, np.int32)
        keys = text[lms]
        by_bucket = lms[np.argsort(keys, kind="stable")]
        lms_ends = np.bincount(keys, minlength=self.names).cumsum()
        head = self.starts.copy()
        for c in self.buckets.tolist():
            done = int(self.starts[c])
            while done < head[c]:
                at = array[done : head[c]]
                done = int(head[c])
                left = at[(at > 0) & ~self.previous_kind[at]] - 1
                if len(left):
                    self._append(array, left, head, 1)
            at = by_bucket[lms_ends[c - 1] if c else 0 : lms_ends[c]]
            if len(at):
                left = at[at > 0] - 1  # left of an LMS suffix is an L-type one
                if len(left):
                    self._append(array, left, head, 1)
        tail = self.ends - 1
        array[0] = n - 1
        for c in self.buckets[::-1].tolist():
            done = int(self.ends[c]) - 1
            if c == int(text[-1]):
                break
            while done > tail[c]:
                at = array[tail[c] + 1 : done + 1][::-1]
                done = int(tail[c])
                left = at[(at > 0) & self.previous_kind[at]] - 1
                if len(left):
                    self._append(array, left, tail, -1)
            at = array[self.starts[c] : head[c]][::-1]
            left = at[(at > 0) & self.previous_kind[at]] - 1
            if len(left):
                self._append(array, left, tail, -1)
        return array


def _name(text: np.ndarray, ordered: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Names of LMS substrings given in order; equal ones share a name. ``lengths`` is by position."""
    a, b = ordered[:-1], ordered[1:]
    same = lengths[a] == lengths[b]
    open_ = np.flatnonzero(same)
    k = 0
    while len(open_):
        equal = text[a[open_] + k] == text[b[open_] + k]
        same[open_[~equal]] = False
        k += 1
        open_ = open_[equal]
        open_ = open_[lengths[a[open_]] > k]
    return np.r_[0, np.cumsum(~same)]


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string by doubling the compared prefix until all ranks differ.

    A rank is the place in the array where a group of suffixes, equal so far, begins; only groups of several are sorted on.
    """
    n = len(names)
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    step = 1
    while len(tied):
        behind = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        pair = rank[tied] * (n + 1) + behind
        order = np.argsort(pair, kind="stable")
        tied, pair = tied[order], pair[order]
        group = rank[tied]
        index = np.arange(len(tied))
        new_pair = np.r_[True, pair[1:] != pair[:-1]]
        new_group = np.r_[True, group[1:] != group[:-1]]
        pair_start = np.maximum.accumulate(np.where(new_pair, index, 0))
        group_start = np.maximum.accumulate(np.where(new_group, index, 0))
        rank[tied] = group + (pair_start - group_start)
        alone = new_pair & np.r_[new_pair[1:], True]
        tied = tied[~alone]
        step *= 2
    array = np.empty(n, np.int32)
    array[rank] = np.arange(n, dtype=np.int32)
    return array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of a string of small non-negative integers that ends in a unique smallest one."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    kind = _types(text)
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]).astype(np.int32) + 1
    inducer = _Inducer(text, kind)
    array = inducer.run(lms)
    if len(lms) == 1:
        return array
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = array[is_lms[array]]
    lengths = np.zeros(n, np.int32)
    lengths[lms] = np.r_[np.diff(lms) + 1, 1]
    names = np.empty(n, np.int32)
    found = _name(text, ordered, lengths)
    if found[-1] + 1 < len(lms):
        names[ordered] = found
        reduced = names[lms]
        inner = suffix_array(reduced) if found[-1] < INDUCE_NAMES else _by_doubling(reduced)
        ordered = lms[inner]
    return inducer.run(ordered)


def permuted_lcp(text: np.ndarray, array: np.ndarray, bases: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes, up to ``most``, with the suffix before in the array, by text position.

    Only the ``counts[i]`` positions from ``bases[i]`` on are computed, for all i side by side: a value is at least
    that of the position to its left, less one, so each step only extends it. Others are 0.
    """
    before = np.full(len(text), -1, np.int32)
    before[array[1:]] = array[:-1]
    lcp = np.zeros(len(text), np.int16)
    height = np.zeros(len(bases), np.int64)
    for t in range(int(counts.max(initial=0))):
        active = np.flatnonzero(counts > t)
        at = bases[active] + t
        other = before[at]
        h = np.maximum(height[active] - 1, 0)
        growing = np.flatnonzero((other >= 0) & (h < most))
        h[other < 0] = 0
        while len(growing):
            x, y = at[growing] + h[growing], other[growing] + h[growing]
            inside = (x < len(text)) & (y < len(text))
            equal = np.zeros(len(growing), bool)
            equal[inside] = text[x[inside]] == text[y[inside]]
            growing = growing[equal]
            h[growing] += 1
            growing = growing[h[growing] < most]
        height[active] = h
        lcp[at] = h
    return lcp
