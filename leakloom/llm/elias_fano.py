"""Ascending integers in few bits, with successor search over many queries at once.

Each number is cut in two: the low bits are stored packed, the high parts as runs of ones parted by zeros. The word of
every 64th one and zero is kept, so that a search begins near its end.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_ONES, _TOPS = _U(0x0101010101010101), _U(0x8080808080808080)
#: The place of the k-th one (from 0) in each byte, at 8 * byte + k.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for byte in range(256) for k in range(8)], np.uint8)


def _place(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The bit of the k-th one (from 0) of each word."""
    s = words - ((words >> _U(1)) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + ((s >> _U(2)) & _U(0x3333333333333333))
    s = ((s + (s >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # ones up to and with each byte
    k = k.astype(_U)
    byte = np.bitwise_count((((k * _ONES) | _TOPS) - s) & _TOPS).astype(_U) << _U(3)
    k -= (s << _U(8)) >> byte & _U(0xFF)
    return (byte + _IN_BYTE[((((words >> byte) & _U(0xFF)) << _U(3)) + k).astype(np.int64)]).astype(np.int64)


def _sampled(before: np.ndarray) -> np.ndarray:
    """The word that holds every 64th of what `before` counts."""
    return np.maximum(np.searchsorted(before, np.arange(0, int(before[-1]) + 1, 64), "right") - 1, 0).astype(np.int32)


def _word_of(before: np.ndarray, sample: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The word that holds the k-th of what `before` counts."""
    word = sample[k >> 6].astype(np.int64)
    todo = np.flatnonzero(before[word + 1] <= k)
    for _ in range(12):
        if not len(todo):
            return word
        word[todo] += 1
        todo = todo[before[word[todo] + 1] <= k[todo]]
    word[todo] = np.searchsorted(before, k[todo], "right") - 1
    return word


class EliasFano:
    """Arrays may be views of a memory map. n: how many numbers; low_bits: stored as they are; ones, zeros: set and clear bits before each word and in all."""

    def __init__(self, facts: np.ndarray, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray, zeros: np.ndarray, one_at: np.ndarray, zero_at: np.ndarray):
        self.n, self.low_bits = int(facts[0]), int(facts[1])
        self.lows, self.highs, self.ones, self.zeros, self.one_at, self.zero_at = lows, highs, ones, zeros, one_at, zero_at

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, _U)
        n = len(values)
        low_bits = max(0, int(values[-1] // _U(max(1, n))).bit_length() - 1) if n else 0
        lows = np.zeros(n * low_bits // 64 + 2, _U)
        if low_bits and n:
            low = values & _U((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.int64) * low_bits
            word, shift = bit >> 6, (bit & 63).astype(_U)
            np.bitwise_or.at(lows, word, low << shift)
            over = shift > _U(64 - low_bits)
            np.bitwise_or.at(lows, word[over] + 1, low[over] >> (_U(64) - shift[over]))
        high = (values >> _U(low_bits)).astype(np.int64)
        at = high + np.arange(n)
        highs = np.zeros((int(at[-1]) if n else 0) // 64 + 2, _U)
        np.bitwise_or.at(highs, at >> 6, _U(1) << (at & 63).astype(_U))
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)))
        zeros = np.arange(len(highs) + 1, dtype=np.int64) * 64 - ones
        return cls(np.array([n, low_bits]), lows, highs, ones, zeros, _sampled(ones), _sampled(zeros))

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(_U)
        # Shifted in two steps, as a shift by 64 is not defined.
        both = (self.lows[word] >> shift) | (self.lows[word + 1] << (_U(63) - shift) << _U(1))
        return both & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the places i."""
        word = _word_of(self.ones, self.one_at, i)
        at = word * 64 + _place(self.highs[word], i - self.ones[word])
        return ((at - i).astype(_U) << _U(self.low_bits)) | self.low(i)

    def search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first number that isn't less than each value (n if none is), and whether it is equal."""
        values = np.asarray(values, _U)
        high = (values >> _U(self.low_bits)).astype(np.int64)
        at, equal = np.full(len(high), self.n, np.int64), np.zeros(len(high), bool)
        inside = np.flatnonzero(high <= min(int(self.zeros[-1]), len(self.highs) * 64 - self.n))
        if not self.n or not len(inside):
            return at, equal
        h, low = high[inside], values[inside] & _U((1 << self.low_bits) - 1)
        k = np.maximum(h - 1, 0)
        word = _word_of(self.zeros, self.zero_at, k)
        place = np.where(h > 0, word * 64 + _place(~self.highs[word], k - self.zeros[word]) - k, 0)
        todo = np.flatnonzero(place < self.n)
        while len(todo):
            bit = place[todo] + h[todo]
            same = (self.highs[bit >> 6] >> (bit & 63).astype(_U)) & _U(1) > 0  # the number there has this high part
            todo = todo[same]
            own = self.low(place[todo])
            equal[inside[todo[own == low[todo]]]] = True
            todo = todo[own < low[todo]]
            place[todo] += 1
            todo = todo[place[todo] < self.n]
        at[inside] = place
        return at, equal

    def successor(self, values: np.ndarray) -> np.ndarray:
        return self.search(values)[0]

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), *(np.asarray(x) for x in (self.lows, self.highs, self.ones, self.zeros, self.one_at, self.zero_at))]


#: Arrays of one number list.
PARTS = 7
