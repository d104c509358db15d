"""Hashed character n-grams of whole texts, as arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def lower_letters(text: str) -> np.ndarray:
    """Lower-cased code points; whatever is no letter is 0, at both ends too."""
    cp = code_points(text.lower())
    out = np.zeros(len(cp) + 2, np.uint32)
    out[1:-1] = np.where(letters()[cp], cp, 0)
    return out


def hashed(cp: np.ndarray, sizes: range, bits: int) -> list[np.ndarray]:
    """For each size the hash (``bits`` bits) of the n-gram that starts at each place."""
    out, h = [], np.zeros(len(cp), np.uint64)
    for n in range(1, sizes.stop):
        if len(cp) < n:
            break
        h = (h[: len(cp) - n + 1] + cp[n - 1:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in sizes:
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64))
    return out
