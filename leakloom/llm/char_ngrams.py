"""Hashed character n-grams of whole texts, for the two classifiers."""

from __future__ import annotations

import numpy as np

#: Odd multipliers, one for each place within an n-gram.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def code_points(text: str) -> np.ndarray:
    """Lower-cased, with a space at either end."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_buckets(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The bucket of every n-gram of the given sizes, repeats included, in no particular order."""
    points, out = code_points(text), []
    for n in sizes:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n * 0x51ED270B & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h += points[i : i + m] * _FACTORS[i]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(16)
        out.append(h >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
