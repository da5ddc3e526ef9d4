"""Hyperplanes of random signs, the same for everyone who names a family."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def splitmix64(x: np.ndarray | int) -> np.ndarray:
    """The SplitMix64 step, modulo 2**64."""
    with np.errstate(over="ignore"):
        z = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@lru_cache(maxsize=32)
def hyperplanes(family: int, bits: int, dims: int) -> np.ndarray:
    """(bits, dims) of +1.0 and -1.0: the lowest bit of the hash of family, bit and dimension."""
    seeds = (np.uint64(family) << np.uint64(48)) ^ (np.arange(bits, dtype=np.uint64)[:, None] << np.uint64(24)) ^ np.arange(dims, dtype=np.uint64)
    return np.where(splitmix64(seeds) & np.uint64(1), 1.0, -1.0)
