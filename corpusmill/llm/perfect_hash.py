"""Minimal perfect hashing of 64-bit keys by levels of bit arrays.

At each level the keys that are left are hashed into twice as many bits; a key alone on its bit
is placed there, the others go on to the next level. The number of a key is the rank of its bit,
so n keys are numbered 0 to n - 1 with about 3.7 bits each, and a lookup takes a constant number of
probes on average. A key that was never placed may get any number: stored fingerprints tell.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed (the finalizer of splitmix64)."""
    z = keys.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 20) >> _U(32)).astype(np.uint32)


def build(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Tables for distinct keys."""
    left, sizes, bits = np.asarray(keys).astype(_U), [], []
    while left.size:
        m = max(64, -(-2 * left.size // 64) * 64)
        at = (mix(left, len(sizes)) % _U(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        left = left[~alone[at]]
        if len(sizes) > 200:
            raise ValueError("keys must be distinct")
    flat = np.concatenate(bits) if bits else np.zeros(0, bool)
    ones = flat.reshape(-1, 64).sum(1) if flat.size else np.zeros(0, np.int64)
    return {"sizes": np.array(sizes, np.int64), "bits": np.packbits(flat, bitorder="little"), "ranks": np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)}


def lookup(tables: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The number of each key, -1 where no level has it."""
    keys = np.asarray(keys).astype(_U)
    out, open_, base = np.full(keys.size, -1, np.int64), np.arange(keys.size), 0
    words = tables["bits"].view("<u8")
    for level, m in enumerate(tables["sizes"]):
        if not open_.size:
            break
        at = base + (mix(keys[open_], level) % _U(m)).astype(np.int64)
        word, bit = words[at >> 6], (at & 63).astype(_U)
        hit = (word >> bit) & _U(1) == 1
        below = word[hit] & ((_U(1) << bit[hit]) - _U(1))
        out[open_[hit]] = tables["ranks"][at[hit] >> 6] + np.bitwise_count(below)
        open_, base = open_[~hit], base + int(m)
    return out
