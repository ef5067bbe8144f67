"""Subsets of whole numbers by their sums, by halves: all sums of either half are tabled, and a subset is a pair of entries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np

#: Up to so many numbers, subsets are tried one by one; that takes less than making tables.
FEW = 10
#: Of more numbers, only the sums of so many at the end are tabled (2^20 for either half); the sets of those before them are gone through.
WIDE = 40


def every_sum(values: list[int]) -> list[int]:
    """The sum of every subset, at its mask (the first number is the lowest bit)."""
    sums = [0]
    for x in values:
        sums += [s + x for s in sums]
    return sums


@cache
def chosen_of(n: int, least: int) -> list[tuple[int, tuple[int, ...]]]:
    """Masks and places of the subsets of n <= FEW numbers, at least `least` of them: by size, then in the order of combinations."""
    return [(sum(1 << k for k in chosen), chosen) for size in range(least, n + 1) for chosen in combinations(range(n), size)]


@cache
def chosen_without(n: int, i: int) -> list[tuple[int, tuple[int, ...]]]:
    """chosen_of() of any size, without those that have place i."""
    return [(mask, chosen) for mask, chosen in chosen_of(n, 0) if not mask >> i & 1]


def _table(values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every subset its sum, its mask (the first number is the highest bit) and its size; masks ascending."""
    sums, sizes = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for x in reversed(values):
        sums, sizes = np.r_[sums, sums + x], np.r_[sizes, sizes + 1]
    return sums, np.arange(len(sums), dtype=np.int64), sizes


def _heads(values: list[int], at: int = 0) -> Iterator[tuple[tuple[int, ...], int]]:
    """Every subset, as places and sum, in the order of descending masks."""
    if not values:
        yield (), 0
        return
    for chosen, s in _heads(values[1:], at + 1):
        yield (at, *chosen), s + values[0]
    yield from _heads(values[1:], at + 1)


def _places(mask: int, n: int, first: int) -> list[int]:
    return [first + k for k in range(n) if mask >> (n - 1 - k) & 1]


def summing_to(values: list[int], lo: int, hi: int, least: int, tried: Callable[[int], None]) -> Iterator[tuple[int, ...]]:
    """The places of all subsets of at least `least` numbers whose sum is from lo to hi: by size, equal sizes in the order of combinations.

    tried() is told how much is looked at: each subset that is tried on its own, or each entry of a table.
    """
    n = len(values)
    if n <= FEW:
        sums, since = every_sum(values), 0
        for mask, chosen in chosen_of(n, least):
            since += 1
            if lo <= sums[mask] <= hi:
                tried(since)
                since = 0
                yield chosen
        tried(since)
        return
    skip = max(0, n - WIDE)
    head, tail = values[:skip], values[skip:]
    m = n - skip
    h = m // 2
    tried(2**h + 2 ** (m - h))
    left, right = _table(tail[:h]), _table(tail[h:])
    every = np.sort(right[0])
    if not head and not (np.searchsorted(every, hi - left[0], side="right") > np.searchsorted(every, lo - left[0], side="left")).any():
        return
    # descending masks of one size are the order of combinations
    by_size = lambda t, order: [tuple(a[at][order(t, at)] for a in t[:2]) for s in range(int(t[2].max()) + 1) if (at := np.flatnonzero(t[2] == s)) is not None]
    lefts = by_size(left, lambda t, at: slice(None))
    rights = by_size(right, lambda t, at: np.argsort(t[0][at], kind="stable"))
    ascending = sorted(tail)
    least_of, most_of = [sum(ascending[:k]) for k in range(m + 1)], [sum(ascending[m - k :]) for k in range(m + 1)]
    for size in range(least, n + 1):
        for before, s in _heads(head):
            rest = size - len(before)
            if not 0 <= rest <= m or most_of[rest] < lo - s or least_of[rest] > hi - s:
                continue
            tried(2**h)
            pairs: list[tuple[int, int, int, int]] = []
            for p in range(max(0, rest - (m - h)), min(h, rest) + 1):
                (sums, masks), (other, _) = lefts[p], rights[rest - p]
                a, b = np.searchsorted(other, lo - s - sums, side="left"), np.searchsorted(other, hi - s - sums, side="right")
                hit = np.flatnonzero(a < b)
                pairs += zip(masks[hit].tolist(), a[hit].tolist(), b[hit].tolist(), [rest - p] * len(hit))
            for mask, a, b, q in sorted(pairs, reverse=True):
                first = _places(mask, h, skip)
                for last in np.sort(rights[q][1][a:b])[::-1].tolist():
                    tried(1)
                    yield (*before, *first, *_places(last, m - h, skip + h))


def count_summing(values: list[int], ranges: list[tuple[int, int]], tried: Callable[[int], None]) -> list[int]:
    """How many subsets (the empty one too) have a sum in each of these ranges, both ends included."""
    n = len(values)
    if n <= FEW // 2:
        sums = every_sum(values)
        tried(len(sums))
        return [sum(lo <= s <= hi for s in sums) for lo, hi in ranges]
    skip = max(0, n - WIDE)
    h = (n - skip) // 2
    left, right = values[skip : skip + h], values[skip + h :]
    tried(2 ** len(left) + 2 ** len(right))
    left, right = _table(left)[0], np.sort(_table(right)[0])
    counts = [0] * len(ranges)
    for _, s in _heads(values[:skip]):
        for k, (lo, hi) in enumerate(ranges):
            if lo <= hi:
                counts[k] += int((np.searchsorted(right, hi - s - left, side="right") - np.searchsorted(right, lo - s - left, side="left")).sum())
    return counts
