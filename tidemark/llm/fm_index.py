"""Compressed full-text index over integer symbols: Burrows-Wheeler transform in a wavelet matrix."""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with counts of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)

    def ones(self, places: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = places >> 6
        low = self.words[word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Counts of a symbol before a place, in one step per bit of the largest symbol."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, Bits, int]] = []
        starts = np.zeros(size, np.int64)
        every = np.arange(size)
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = ((symbols >> shift) & 1).astype(np.uint8)
            packed, zeros = Bits(bit), int(len(bit) - bit.sum())
            self.levels.append((shift, packed, zeros))
            ones = packed.ones(starts)
            starts = np.where((every >> shift) & 1 == 1, zeros + ones, starts - ones)
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.starts = starts

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        at = places
        for shift, packed, zeros in self.levels:
            ones = packed.ones(at)
            at = np.where((symbols >> shift) & 1 == 1, zeros + ones, at - ones)
        return at - self.starts[symbols]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` symbols or more, by doubling the compared length."""
    n = len(text)
    rank = text.astype(np.int64)
    length = 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(n - length, 0)] = rank[length:] + 1
        key = rank * (n + 2) + following
        order = np.argsort(key, kind="stable")
        length *= 2
        if length >= depth:
            return order
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])


class FMIndex:
    """Index of a text of symbols 1 and up; 0 separates segments and is never searched for.

    Suffixes are ordered by ``depth`` symbols, which is exact for searches of at most that length.
    """

    def __init__(self, text: np.ndarray, size: int, depth: int):
        self.order = suffix_order(text, depth)
        self.wavelet = WaveletMatrix(text[self.order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])

    def statistics(self, text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the symbols before each end, cut off at ``depth``.

        Backward search extends every match to the left until it is ``depth`` long or is found only once.
        Gives the length reached and the interval of suffixes that begin with the match.
        """
        symbol = text[ends - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        length = np.ones(len(ends), np.int64)
        active = np.flatnonzero(high - low > 1)
        for step in range(2, depth + 1):
            if not len(active):
                break
            symbol = text[ends[active] - step]
            base = self.first[symbol]
            places = np.concatenate([low[active], high[active]])
            counts = self.wavelet.rank(np.concatenate([symbol, symbol]), places)
            low[active], high[active] = base + counts[: len(active)], base + counts[len(active) :]
            length[active] = step
            active = active[high[active] - low[active] > 1]
        return length, low, high
