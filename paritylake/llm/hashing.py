"""Prefix polynomial hashes of byte strings, modulo 2**64.

Bytes are first replaced by fixed random 64-bit values, so texts of few letters do not
fall into the weak low bits of such hashes. `span_hash` gives the hash of any substring
from two prefix hashes; equal substrings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_KEPT = 1 << 22  # powers that a worker keeps during a task: 64 MB, enough for every portion of a sort
_FEW = 1 << 16  # and between tasks: 1 MB
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    while len(have) < n:  # doubling: base**(i + k) = base**i * base**k
        step = have[-1] * base
        have = np.concatenate([have, have * step])
    _powers[kind] = have[:_KEPT]
    return have[:n]


def drop_powers() -> None:
    """Keep only the powers that most texts need; the others are quickly made again."""
    for kind, have in _powers.items():
        _powers[kind] = have[:_FEW].copy()


def prefixes(data: np.ndarray) -> np.ndarray:
    """len(data) + 1 prefix hashes of an array of bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE[data] * _power("up", _BASE, len(data)), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], not mixed."""
    with np.errstate(over="ignore"):
        return (prefix[end] - prefix[start]) * _power("down", _INVERSE, len(prefix))[start]


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of one size, not mixed."""
    with np.errstate(over="ignore"):
        return (prefix[size:] - prefix[:-size]) * _power("down", _INVERSE, len(prefix))[: len(prefix) - size]
