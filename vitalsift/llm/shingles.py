"""Word shingles of texts as 64-bit hashes, and SetSketch registers of such sets, in numpy.

Words are runs of bytes other than blank and 9 to 13, with A-Z lower-cased. All words of a slice
are hashed together: a running sum of byte codes times powers of an odd base gives every
word's polynomial hash from its two ends. A set holds the distinct hashes of five consecutive words, or of
the whole sequence where there are fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
REGISTERS = 256
#: Ratio of neighbouring register values: the spacing of the exponential scale.
SPACING = 1.02
#: Scale of the exponential variables, so that a set of one element has registers above 0.
RATE = 20.0
TOP = 65_535
SLICE_BYTES = 1 << 19

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (finaliser of a linear generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` repeatable 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class ShingleHasher:
    """Hashes the words of byte slices; tables of powers grow with the longest text."""

    def __init__(self, seed: int = 7):
        lower = np.arange(256)
        lower[ord("A") : ord("Z") + 1] += 32
        self.codes = constants(256, seed)[lower]
        self.space = np.zeros(256, bool)
        self.space[[0x20, *range(0x09, 0x0E)]] = True
        self.base = int(constants(1, seed + 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.weights = constants(WORDS, seed + 2) | _U(1)
        self._grow(SLICE_BYTES)

    def _grow(self, n: int) -> None:
        self.powers, self.inverses = (self._table(b, n) for b in (self.base, self.inverse))

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, _U)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """The sorted distinct shingle hashes of each text in a slice."""
        if len(data) > len(self.powers):
            self._grow(2 * len(data))
        space = self.space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        inside = ~space
        before = np.concatenate([[True], space[:-1]]) | edge[:-1]
        after = np.concatenate([space[1:], [True]]) | edge[1:]
        starts = np.flatnonzero(inside & before[: len(data)])
        ends = np.flatnonzero(inside & after[: len(data)]) + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(self.codes[data] * self.powers[: len(data)])])
            words = mix((sums[ends] - sums[starts]) * self.inverses[starts] if len(starts) else np.zeros(0, _U))
            n = len(words) - WORDS + 1
            shingles = np.zeros(max(n, 0), _U)
            for k in range(WORDS if n > 0 else 0):
                shingles += words[k : k + n] * self.weights[k]
            shingles = mix(shingles)
            first = np.searchsorted(starts, offsets)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= WORDS:
                    yield np.unique(shingles[a : b - WORDS + 1])
                elif b > a:
                    whole = (words[a:b] * self.weights[: b - a]).sum(dtype=_U) + _U(b - a)
                    yield mix(np.array([whole], _U))
                else:
                    yield np.zeros(0, _U)


class SetSketch:
    """Registers of sets: truncated minima of exponential variables on an exponential scale.

    Register i is floor(1 - log(E / RATE, SPACING)), where E is the exponential variable of
    the smallest of a set's hashes under the i-th hash function, cut to 0..65535. The registers of
    a union are the greater ones of both sets, and equal registers become likelier with similarity.
    """

    def __init__(self, registers: int = REGISTERS, seed: int = 11):
        self.factors = ((constants(registers, seed) >> _U(32)).astype(np.uint32) | np.uint32(1))[:, None]
        self.shifts = (constants(registers, seed + 1) >> _U(32)).astype(np.uint32)[:, None]

    def registers(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(len(self.factors), np.uint16)
        short = (hashes >> _U(32)).astype(np.uint32)
        low = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), 512):
            part = self.factors * short[at : at + 512]
            part += self.shifts
            np.minimum(low, part.min(axis=1), out=low)
        uniform = (low.astype(np.float64) + 0.5) / 2.0**32
        variable = -np.log1p(-uniform) / RATE
        return np.clip(np.floor(1 - np.log(variable) / np.log(SPACING)), 0, TOP).astype(np.uint16)


def register_odds(x: np.ndarray) -> np.ndarray:
    """Chance that one register exceeds the other, for the share ``x`` of the union that only one set has."""
    return -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)


def joint_likelihood(similarity, above, below, equal, n_a, n_b):
    """Log-likelihood of a Jaccard similarity, given the numbers of registers above, below and equal."""
    total = n_a + n_b
    a, b = n_a / total, n_b / total
    p = np.maximum(register_odds(a - b * similarity), 1e-12)
    q = np.maximum(register_odds(b - a * similarity), 1e-12)
    return above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))


def estimate(above, below, equal, n_a, n_b, steps: int = 28) -> np.ndarray:
    """The similarity of greatest likelihood, by thirds; the likelihood has a single peak."""
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    low = np.zeros(np.broadcast(above, n_a).shape)
    high = low + np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    for _ in range(steps):
        left, right = low + (high - low) / 3, high - (high - low) / 3
        up = joint_likelihood(left, above, below, equal, n_a, n_b) < joint_likelihood(right, above, below, equal, n_a, n_b)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


def reaches(similarity: float, above, below, equal, n_a, n_b) -> np.ndarray:
    """Whether the estimate is at least ``similarity``, without finding it.

    The likelihood has a single peak, which lies no lower than where it still rises.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    counts = (above, below, equal, n_a, n_b)
    return joint_likelihood(similarity + 1e-4, *counts) >= joint_likelihood(similarity - 1e-4, *counts)
