"""Words, shingles and their hashes in numpy, alike on every machine and in every process."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << max(16, int(n).bit_length())
        inverse = pow(int(_BASE), -1, 1 << 64)
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE, np.uint64)
            steps[0] = 1
            _POWERS = np.multiply.accumulate(steps)
            steps = np.full(size, np.uint64(inverse), np.uint64)
            steps[0] = 1
            _INVERSE = np.multiply.accumulate(steps)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_list(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash per word of ``word_list(text)``: polynomial over its bytes, then mixed."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8) if text else np.empty(0, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    _grow(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)])))
        return mixed((sums[ends] - sums[starts]) * _INVERSE[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; fewer words make one shingle, none make none."""
    if not len(words):
        return np.empty(0, np.uint64)
    take = min(size, len(words))
    count = len(words) - take + 1
    with np.errstate(over="ignore"):
        out = np.full(count, np.uint64(take))
        for k in range(take):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + count])
    return np.unique(out)


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for exact comparison."""
    words = word_list(text)
    if not words:
        return set()
    take = min(size, len(words))
    return set(zip(*(words[k:] for k in range(take))))


def set_digest(shingles: np.ndarray) -> bytes:
    """128-bit name of a shingle set; empty for the empty set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else b""


def parameters(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` universal hash permutations of the 64-bit numbers."""
    draw = np.random.Generator(np.random.PCG64(seed))
    a = draw.integers(0, 1 << 64, count, np.uint64) | np.uint64(1)
    return a, draw.integers(0, 1 << 64, count, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 128) -> np.ndarray:
    """For each permutation the least value over the set; the largest number for the empty set."""
    least = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), block):
            values = shingles[at : at + block, None] * a
            values += b
            np.minimum(least, values.min(0), out=least)
    return least
