"""Longest matches against a text by its suffix array, many positions at once.

Letters are numbers of few bits, and as many of them as fit are packed into a word. A position's first word is looked up
among the sorted first words of the suffixes, which tells its match if that is shorter than a word. Longer matches narrow
an interval of suffixes by a word a round.
"""

from __future__ import annotations

import numpy as np

WORD_BITS = 62


def encode(text: str) -> np.ndarray:
    """Code points; 0 is left for separators."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def packed(letters: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The word that begins at each place; beyond the end stands 0."""
    out = np.zeros(len(letters), np.int64)
    for k in range(width):
        out <<= bits
        out[: max(0, len(letters) - k)] |= letters[k:]
    return out


def suffix_array(words: np.ndarray, width: int) -> np.ndarray:
    """Places in the order of their suffixes, by prefix doubling from words of so many letters on; only suffixes that tie
    are sorted again."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(words)
    values = words[order]
    fresh = np.append(True, values[1:] != values[:-1])
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    open_places = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(open_places):
        at = order[open_places]
        keys = (rank[at] << 32) + rank[np.minimum(at + width, n)] + 1
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        order[open_places] = at
        fresh = np.append(True, keys[1:] != keys[:-1])
        rank[at] = np.maximum.accumulate(np.where(fresh, open_places, 0))
        open_places = open_places[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return order


def bit_lengths(values: np.ndarray) -> np.ndarray:
    high = values >> 31
    return np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp((values & (1 << 31) - 1).astype(np.float64))[1])


class Shard:
    """A piece of the reference that can be searched: its alphabet, letters and suffix array, and words of letters.

    The letter 0 stands beyond the end; 1 is the first of the alphabet, the separator; what the alphabet lacks is one
    above its last.
    """

    def __init__(self, sequences: list[str]):
        parts: list[np.ndarray] = []
        for s in sequences:
            parts += [encode(s), np.zeros(1, np.int64)]
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.alphabet = np.unique(codes)
        self._open((np.searchsorted(self.alphabet, codes) + 1).astype(np.int32))
        self.order = suffix_array(self.words, self.width).astype(np.int32)
        self.first = self.words[self.order]

    def _open(self, letters: np.ndarray) -> None:
        self.letters = letters
        self.bits = int(len(self.alphabet) + 1).bit_length()
        self.width = WORD_BITS // self.bits
        self.words = packed(letters, self.bits, self.width)

    def saved(self) -> tuple[bytes, bytes, bytes]:
        return self.alphabet.astype("<i8").tobytes(), self.letters.astype("<i4").tobytes(), self.order.astype("<i4").tobytes()

    @classmethod
    def loaded(cls, alphabet: bytes, letters: bytes, order: bytes) -> Shard:
        out = cls.__new__(cls)
        out.alphabet = np.frombuffer(alphabet, "<i8")
        out._open(np.frombuffer(letters, "<i4"))
        out.order = np.frombuffer(order, "<i4")
        out.first = out.words[out.order]
        return out

    def longest_matches(self, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For every position of text, the length of the longest substring from there, not beyond its end, that the
        shard holds."""
        n, size = len(text), len(self.letters)
        if not size or not n:
            return np.zeros(n, np.int64)
        k = np.minimum(np.searchsorted(self.alphabet, text), len(self.alphabet) - 1)
        words = packed(np.where((self.alphabet[k] == text) & (text != 0), k + 1, len(self.alphabet) + 1), self.bits, self.width)
        # the neighbours of a word among the suffixes share more with it than any other does
        low = np.searchsorted(self.first, words)
        out = np.maximum(self._shared(words, self.first[np.maximum(low - 1, 0)]), self._shared(words, self.first[np.minimum(low, size - 1)]))
        room = ends - np.arange(n)
        live = np.flatnonzero((out == self.width) & (room > self.width))
        low, high = low[live], np.searchsorted(self.first, words[live], "right")
        depth = self.width
        while len(live):
            wanted = words[live + depth]
            below = self._bound(low, high, wanted, depth)
            # as before: the neighbours within the interval, if there are such
            before = np.where(below > low, self._shared(wanted, self._word(np.maximum(below - 1, low), depth)), 0)
            after = np.where(below < high, self._shared(wanted, self._word(np.minimum(below, high - 1), depth)), 0)
            more = np.maximum(before, after)
            out[live] = depth + more
            depth += self.width
            goes_on = (after == self.width) & (room[live] > depth)
            live, low, high, wanted = live[goes_on], below[goes_on], high[goes_on], wanted[goes_on]
            high = self._bound(low, high, wanted + 1, depth - self.width)
        return np.minimum(out, room)

    def _shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Letters that two words have in common from their first on."""
        return self.width - (bit_lengths(a ^ b) + self.bits - 1) // self.bits

    def _word(self, row: np.ndarray, depth: int) -> np.ndarray:
        at = self.order[row].astype(np.int64) + depth
        return np.where(at < len(self.words), self.words[np.minimum(at, len(self.words) - 1)], 0)

    def _bound(self, low: np.ndarray, high: np.ndarray, value: np.ndarray, depth: int) -> np.ndarray:
        """The first suffix of each interval whose word at depth is not less than value."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self._word(middle, depth) < value[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        return low
