"""An FM-index over integer symbols, for many short patterns at once.

The suffix array is sorted by prefix doubling that only sorts what still
ties. The Burrows-Wheeler transform lies in a wavelet tree, stored level by
level as a matrix; its ranks drive the backward search and the walk from a
row to the next sampled suffix position.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order; its last symbol must be smaller than all others."""
    n = len(text)
    bits = max(1, int(text.max()).bit_length()) if n else 1
    width = max(1, 62 // bits)
    width = 1 << (width.bit_length() - 1)
    width = min(width, 4)
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= text[k:]
    order = np.argsort(key)
    fresh = np.empty(n, bool)
    fresh[:1] = True
    sorted_key = key[order]
    np.not_equal(sorted_key[1:], sorted_key[:-1], out=fresh[1:])
    # the rank of a suffix is the first row of its group of ties
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    tied = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    while len(tied):
        rows = order[tied]
        after = rows + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.argsort((first[tied] << 32) | (second + 1))
        rows, second, base = rows[by], second[by], first[tied][by]
        order[tied] = rows
        fresh = np.concatenate(([True], (base[1:] != base[:-1]) | (second[1:] != second[:-1])))
        # tied is ascending and each group of ties fills its rows, so a place in tied is a row
        first[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[rows] = first[tied]
        tied = tied[~(fresh & np.concatenate((fresh[1:], [True])))]
        width *= 2
    return order


class FMIndex:
    """The index of ``text`` (symbols from 1); finds the positions of patterns."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 16):
        text = np.concatenate((text.astype(np.int64), [0]))
        order = suffix_array(text)
        self.n, self.levels = len(text), max(1, int(sigma).bit_length())
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))
        bwt = text[order - 1].astype(np.int32)
        self.ranks: list[np.ndarray] = []  # of each level: zeros before each place
        self.zeros: list[int] = []
        for d in range(self.levels - 1, -1, -1):
            bit = (bwt >> d) & 1
            zeros = np.empty(self.n + 1, np.int32)
            zeros[0] = 0
            np.cumsum(1 - bit, out=zeros[1:])
            self.ranks.append(zeros)
            self.zeros.append(int(zeros[-1]))
            one = bit.view(np.int32).astype(bool)
            bwt = np.concatenate((bwt[~one], bwt[one]))
        sampled = order % every == 0
        self.sampled = sampled
        self.sample_at = np.concatenate(([0], np.cumsum(sampled, dtype=np.int32)))
        self.samples = order[sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each row."""
        start = np.zeros(len(row), np.int64)
        end = row.astype(np.int64)
        for k, d in enumerate(range(self.levels - 1, -1, -1)):
            zeros, one = self.ranks[k], ((symbol >> d) & 1).astype(bool)
            zs, ze = zeros[start], zeros[end]
            start = np.where(one, self.zeros[k] + start - zs, zs)
            end = np.where(one, self.zeros[k] + end - ze, ze)
        return end - start

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one symbol longer than that of each row."""
        at, start, symbol = row.astype(np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for k in range(self.levels):
            zeros = self.ranks[k]
            here = zeros[at]
            one = zeros[at + 1] == here
            zs = zeros[start]
            symbol = (symbol << 1) | one
            start = np.where(one, self.zeros[k] + start - zs, zs)
            at = np.where(one, self.zeros[k] + at - here, here)
        return self.before[symbol] + at - start

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows ``[low, high)`` of the suffixes that begin with each pattern; ``patterns`` are right-aligned rows."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64)
        alive = np.arange(len(lengths))
        for k in range(patterns.shape[1]):
            alive = alive[(lengths[alive] > k) & (high[alive] > low[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, -1 - k]
            m = len(alive)
            both = self.rank(np.concatenate((symbol, symbol)), np.concatenate((low[alive], high[alive])))
            low[alive] = self.before[symbol] + both[:m]
            high[alive] = self.before[symbol] + both[m:]
        return low, np.maximum(low, high)

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(which, position)`` of all rows of the ranges, by walking to sampled positions."""
        count = high - low
        which = np.repeat(np.arange(len(count)), count)
        row = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(which))
        found = np.full(len(row), -1, np.int64)
        left, steps = np.arange(len(row)), 0
        while len(left):
            done = self.sampled[row]
            found[left[done]] = self.samples[self.sample_at[row[done]]] + steps
            left, row = left[~done], self.step(row[~done])
            steps += 1
        return which, found
