"""Suffix arrays by induced sorting, and permuted common prefixes. Plain arrays, no Spark.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller substrings by inducing, names them, sorts
the string of names by recursion, and induces the whole array from that order, in array operations over blocks of buckets.
"""

from __future__ import annotations

import numpy as np


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``data`` (bytes)."""
    if not len(data):
        return np.zeros(0, np.int64)
    t = np.empty(len(data) + 1, np.int64)
    t[:-1] = data
    t[:-1] += 1
    t[-1] = 0                                   # ends before everything else
    return _sorted_suffixes(t, int(t.max()) + 1)[1:]


def _sorted_suffixes(t: np.ndarray, sigma: int) -> np.ndarray:
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(np.diff(t))
    # A suffix is smaller than its right neighbour (S) as its next change of character goes up.
    at = np.where(step != 0, np.arange(n - 1), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = step[np.minimum(following, n - 2)] > 0
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    inducer = _Inducer(t, small, sigma)
    first = inducer.induce(lms)
    if len(lms) == 0:
        return first
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = first[is_lms[first]]
    names_of_ranked = np.concatenate([[0], np.cumsum(~_equal_neighbours(t, lms, ranked))])
    name = np.empty(n, np.int64)
    name[ranked] = names_of_ranked
    names = name[lms]
    count = int(names_of_ranked[-1]) + 1
    if count == len(lms):
        order = np.empty(count, np.int64)
        order[names] = np.arange(count)
    else:
        order = _sorted_suffixes(names, count)
    return inducer.induce(lms[order])


def _equal_neighbours(t: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """For each two neighbours in ``ranked``: are their leftmost-smaller substrings equal?"""
    length = np.empty(len(t), np.int64)
    length[lms] = np.diff(np.append(lms, len(t) - 1)) + 1
    a, b = ranked[:-1], ranked[1:]
    size = length[a]
    equal = size == length[b]
    active = np.flatnonzero(equal)
    for k in range(64):
        active = active[size[active] > k]
        if not len(active):
            return equal
        same = t[a[active] + k] == t[b[active] + k]
        equal[active[~same]] = False
        active = active[same]
    for i in active[size[active] > 64]:         # long runs of one character
        equal[i] = np.array_equal(t[a[i]:a[i] + size[i]], t[b[i]:b[i] + size[i]])
    return equal


class _Inducer:
    """Induces all suffixes of a string from an order of its leftmost-smaller ones.

    Buckets are gone through in order. Neighbouring buckets are taken together as long as nothing that they induce falls
    into one of them; a bucket that induces into itself (runs of one character) is taken in waves. So the
    steps are few for small and large alphabets.
    """

    def __init__(self, t: np.ndarray, small: np.ndarray, sigma: int):
        self.t, self.n = t, len(t)
        counts = np.bincount(t, minlength=sigma)
        self.count = np.arange(self.n)
        self.ends = np.cumsum(counts)
        self.heads = self.ends - counts
        self.sort_as = t.astype(np.uint16) if sigma <= 1 << 16 else t     # 16 bits sort in linear time
        self.large_before = np.zeros(self.n, bool)                        # is the suffix before this one larger (L)?
        self.large_before[1:] = ~small[:-1]
        self.small_before = np.zeros(self.n, bool)
        self.small_before[1:] = small[:-1]
        # The nearest bucket that each bucket induces into, upwards and downwards.
        up, down = np.full(sigma, sigma), np.full(sigma, -1)
        i = np.flatnonzero(self.large_before)
        np.minimum.at(up, t[i], t[i - 1])
        i = np.flatnonzero(self.small_before)
        np.maximum.at(down, t[i], t[i - 1])
        self.upwards = self._blocks(up.tolist())
        mirrored = self._blocks([sigma - 1 - x for x in reversed(down.tolist())])
        self.downwards = [(sigma - 1 - b, sigma - 1 - a) for a, b in mirrored]

    @staticmethod
    def _blocks(nearest: list[int]) -> list[tuple[int, int]]:
        """First and last bucket of each block."""
        out, first, bound = [], 0, len(nearest)
        for c, x in enumerate(nearest):
            if c > first and min(bound, x) <= c or c > first and nearest[first] == first:
                out.append((first, c - 1))
                first, bound = c, len(nearest)
            bound = min(bound, x)
        out.append((first, len(nearest) - 1))
        return out

    def _place(self, sa: np.ndarray, filled: np.ndarray, found: np.ndarray, step: int) -> None:
        """Put suffixes into their buckets, in order, where these are filled to."""
        found = found[self.sort_as[found].argsort(kind="stable")]
        chars, n = self.t[found], len(found)
        first = np.empty(n, bool)
        first[0] = True
        np.not_equal(chars[1:], chars[:-1], out=first[1:])
        change = first.nonzero()[0]
        sizes = np.empty(len(change), np.int64)
        np.subtract(change[1:], change[:-1], out=sizes[:-1])
        sizes[-1] = n - change[-1]
        heads = chars[change]
        if step > 0:
            sa[(filled[heads] - change).repeat(sizes) + self.count[:n]] = found
            filled[heads] += sizes
        else:
            sa[(filled[heads] - 1 + change).repeat(sizes) - self.count[:n]] = found
            filled[heads] -= sizes

    def induce(self, lms: np.ndarray) -> np.ndarray:
        t, heads, ends = self.t, self.heads, self.ends
        sa = np.full(self.n, -1, np.int64)
        order = lms[np.argsort(self.sort_as[lms], kind="stable")]
        of_lms = np.bincount(t[lms], minlength=len(heads))
        chars = t[order]
        tails = ends[chars] - of_lms[chars] + _place_in_run(chars)
        sa[tails] = order

        filled = heads.copy()
        for a, b in self.upwards:
            if a == b:
                done = heads[a]
                while done < filled[a]:         # waves, while the bucket induces into itself
                    wave, done = sa[done:filled[a]], filled[a]
                    wave = wave[self.large_before[wave]]
                    if len(wave):
                        self._place(sa, filled, wave - 1, 1)
                wave = sa[ends[a] - of_lms[a]:ends[a]]
            else:
                wave = sa[heads[a]:ends[b]]
                wave = wave[wave >= 0]
            wave = wave[self.large_before[wave]]
            if len(wave):
                self._place(sa, filled, wave - 1, 1)
        large_end = filled                      # the larger suffixes of a bucket end here
        sa[tails] = -1

        filled = ends.copy()                    # from here on filled from the right
        for a, b in self.downwards:
            if a == b:
                done = ends[a]
                while done > filled[a]:
                    wave, done = sa[filled[a]:done][::-1], filled[a]
                    wave = wave[self.small_before[wave]]
                    if len(wave):
                        self._place(sa, filled, wave - 1, -1)
                wave = sa[heads[a]:large_end[a]][::-1]
            else:
                wave = sa[heads[a]:ends[b]][::-1]
                wave = wave[wave >= 0]
            wave = wave[self.small_before[wave]]
            if len(wave):
                self._place(sa, filled, wave - 1, -1)
        sa[0] = self.n - 1
        return sa


def _place_in_run(chars: np.ndarray) -> np.ndarray:
    """Number of each element within its run of equal values."""
    n = len(chars)
    start = np.zeros(n, np.int64)
    change = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    start[change] = change
    return np.arange(n) - np.maximum.accumulate(start)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each position in text order: its common prefix with the suffix before it in ``sa``, and that suffix.

    The first suffix has -1 before it. Where the bytes to the left are equal too, the prefix is that of the
    position to the left less one, so only the others are compared, 8 bytes at a time.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)                 # the length follows from the position to the left
    follows[1:] = (before[1:] > 0) & (before[:-1] >= 0) & (data[:-1] == data[np.maximum(before[1:], 1) - 1])
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = data
    words = np.zeros(n, np.uint64)              # 8 bytes from each position
    for k in range(8):
        words |= padded[k:n + k].astype(np.uint64) << np.uint64(8 * k)
    length = np.zeros(n, np.int64)
    active, far = np.flatnonzero(~follows & (before >= 0)), 0
    while len(active):
        a, b = active + far, before[active] + far
        inside = np.maximum(a, b) < n
        active, a, b = active[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        lowest = np.maximum(differ & (~differ + np.uint64(1)), 1)
        equal = np.where(differ == 0, 8, np.log2(lowest.astype(np.float64)).astype(np.int64) // 8)
        equal = np.minimum(equal, n - np.maximum(a, b))
        length[active] = far + equal
        active = active[equal == 8]
        far += 8
    place = np.arange(n)
    last = np.maximum.accumulate(np.where(follows, 0, place))
    return np.where(follows, length[last] - (place - last), length), before
