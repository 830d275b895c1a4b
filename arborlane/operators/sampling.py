"""Sampling by hashes of stable keys: exactly a share of units, those of least hash, or each key by a level of its hash."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable
from fractions import Fraction

import numpy as np

GRID = 1 << 30


def choose_columns(cols: int, rate: float, seed: int) -> list[int]:
    """Exactly ceil(rate * cols) columns, at least one."""
    k = min(cols, max(1, math.ceil(cols * min(rate, 1.0) - 1e-9)))
    return sorted(random.Random(seed).sample(range(cols), k)) if k < cols else list(range(cols))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed(seed: int, key: np.ndarray) -> np.ndarray:
    salt = _mix(np.array([seed & 0xFFFFFFFFFFFFFFFF], np.uint64))
    return _mix(key.astype(np.int64).view(np.uint64) ^ salt[0])


def keep_array(rate: float, seed: int, key: np.ndarray) -> np.ndarray:
    """Keeps about ``rate`` of the distinct keys, the same ones wherever they lie."""
    if rate >= 1:
        return np.ones(len(key), bool)
    return (hashed(seed, key) & np.uint64(GRID - 1)) < np.uint64(math.ceil(rate * GRID))


def share(n: int, rate: float) -> int:
    """ceil(rate * n) of the rate as it is written, however large n is."""
    return min(n, max(0, math.ceil(Fraction(repr(float(rate))) * n - Fraction(1, 10**9))))


def choose_units(units: np.ndarray, rate: float, seed: int) -> np.ndarray:
    """Exactly ceil(rate * n) of the distinct units, those of least hash, sorted."""
    return np.sort(units[np.argsort(hashed(seed, units), kind="stable")[: share(len(units), rate)]])


def tallied(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, counts), the values ascending and each once."""
    values, counts = (np.concatenate(x) for x in zip((np.zeros(0, np.uint64), np.zeros(0, np.int64)), *parts, strict=True))
    values, at = np.unique(values, return_inverse=True)
    total = np.zeros(len(values), np.int64)
    np.add.at(total, at, counts)
    return values, total


#: Of so many keys at most the last step of a selection sees the values themselves.
FEW_KEYS = 1 << 16


def kth_least(scan: Callable[[Callable[[int, np.ndarray], np.ndarray], list[int]], dict[int, tuple[np.ndarray, np.ndarray]]], places: list[int]) -> list[int]:
    """The exact ``places[i]``-th least (from 1) of the 64-bit keys of each i, however many there are.

    ``scan(pick, of)`` tallies ``pick(i, keys)`` over all keys of each i in ``of``. A scan tallies 16 bits more of the keys
    that agree with those found so far, at most 65,536 values, or what few keys are left.
    """
    found: dict[int, int] = {}
    state = {i: (0, 0, False, k) for i, k in enumerate(places)}  # leading bits, their number, whether few are left, place
    while state:
        now = dict(state)

        def pick(i: int, keys: np.ndarray) -> np.ndarray:
            lead, bits, few, _ = now[i]
            mine = keys[keys >> np.uint64(64 - bits) == np.uint64(lead)] if bits else keys
            return mine if few else mine >> np.uint64(48 - bits)

        tallies = scan(pick, list(now))
        for i, (_, bits, few, place) in now.items():
            values, counts = tallies[i]
            upto = np.cumsum(counts)
            j = int(np.searchsorted(upto, place))
            if few or bits == 48:
                found[i] = int(values[j])
                del state[i]
            else:
                state[i] = (int(values[j]), bits + 16, int(counts[j]) <= FEW_KEYS, place - int(upto[j] - counts[j]))
    return [found[i] for i in range(len(places))]
