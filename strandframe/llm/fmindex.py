"""An FM-index over a sequence of small integers: wavelet-matrix ranks and sampled suffix positions.

All operations take arrays, so that many patterns and rows advance together.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text in order, by prefix doubling from runs of two or three symbols on; only suffixes that still tie
    are sorted again. Symbols are not negative, the last occurs nowhere else, and so no two suffixes are equal."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, min(3, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key <<= bits
        key[: n - k] |= text[k:]
    order = np.argsort(key)
    key = key[order]
    first = np.empty(n, bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    # a suffix's rank is the place where its group begins
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in order whose group has others
    while len(tied):
        at = order[tied]
        # groups keep their places: tied ascends and the key goes by group first
        key = (rank[at] << 32) + rank[np.minimum(at + width, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.empty(len(tied), bool)
        fresh[0] = True
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
        tied = tied[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """rank(symbol, position) over a sequence, a bit of the symbols a level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(levels - 1, -1, -1):
            bits = ((values >> shift) & 1).astype(np.uint8)
            ones = bits.astype(bool)
            self.levels.append((shift, Bits(bits), int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its position."""
        start, end = np.zeros_like(at), at
        for shift, bits, zeros in self.levels:
            one = ((symbols >> shift) & 1).astype(bool)
            low, high = bits.rank1(start), bits.rank1(end)
            start = np.where(one, zeros + low, start - low)
            end = np.where(one, zeros + high, end - high)
        return end - start

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and its rank there."""
        symbol, start, end = np.zeros_like(at), np.zeros_like(at), at
        for _, bits, zeros in self.levels:
            one = bits.get(end).astype(bool)
            low, high = bits.rank1(start), bits.rank1(end)
            start = np.where(one, zeros + low, start - low)
            end = np.where(one, zeros + high, end - high)
            symbol = symbol * 2 + one
        return symbol, end - start


class FMIndex:
    """Over sequences of symbols 1..n_symbols - 1, laid end to end with 0 after each."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        """text: 0 ends every sequence, the last one too."""
        self.n = len(text)
        # each 0 sorts as a symbol of its own, by place, so that no two suffixes tie past the end of a sequence
        ends = np.flatnonzero(text == 0)
        unique = text.astype(np.int64) + len(ends)
        unique[ends] = np.arange(len(ends))
        order = suffix_array(unique)
        before = text[order - 1]  # of the first suffix the last symbol, an end
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.ranks = WaveletMatrix(before.astype(np.int32), max(1, int(n_symbols - 1).bit_length()))
        # sampled: every sample-th position and each that follows an end, which no walk can leave
        kept = (order % sample == 0) | (before == 0)
        self.sampled = Bits(kept.astype(np.uint8))
        self.samples = order[kept].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) of each pattern by backward search; patterns is (count, length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            symbols = patterns[live, column]
            low[live] = self.first[symbols] + self.ranks.rank(symbols, low[live])
            high[live] = self.first[symbols] + self.ranks.rank(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        steps = np.zeros(len(rows), np.int64)
        at = rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            done = self.sampled.get(at[todo]).astype(bool)
            ready = todo[done]
            out[ready] = self.samples[self.sampled.rank1(at[ready])] + steps[ready]
            todo = todo[~done]
            symbols, rank = self.ranks.access(at[todo])
            at[todo] = self.first[symbols] + rank
            steps[todo] += 1
        return out
