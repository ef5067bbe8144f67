"""Hashes of words and of runs of words, as whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash

from ledgerloom.llm.common import ascii_words

BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, in order, and the number of words of each text."""
    words = [ascii_words(t) for t in texts]
    counts = np.array([len(w) for w in words], dtype=np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum())), counts


def wide_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a 128-bit hash of each word."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), dtype=">u8").astype(np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def word_hashes(text: str | None) -> np.ndarray:
    return word_hashes_of([text])[0]


def in_portions(texts: Iterable[str | None], size: int = 1_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts of about `size` characters together, for work that is done at once for many short texts."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t) if t else 0
        if n >= size:
            yield out
            out, n = [], 0
    if out:
        yield out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of x over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of `size` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * BASE + words[i : i + n]
        return mixed(out)


def spans(words: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of size[i] words from start[i]; equal runs have equal hashes wherever they stand."""
    with np.errstate(over="ignore"):
        power = np.cumprod(np.r_[np.uint64(1), np.full(len(words), BASE)])
        inverse = np.cumprod(np.r_[np.uint64(1), np.full(len(words), np.uint64(pow(int(BASE), -1, 2**64)))])
        total = np.r_[np.uint64(0), np.cumsum(words * power[1:])]
        return mixed((total[start + size] - total[start]) * inverse[start] + size.astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
