"""A minimal perfect hash over 64-bit keys in numpy: levels of bit arrays.

At every level a key hashes to one bit; keys alone on theirs are placed, the others go on to a
smaller level.  A key's index is the number of set bits before its own.
"""

from __future__ import annotations

import numpy as np

LEVELS, ROOM = 40, 1.5


def spread(keys: np.ndarray, salt: int) -> np.ndarray:
    """A salted bijection of 64-bit values."""
    x = keys ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def build(keys: np.ndarray) -> dict:
    """Tables for distinct uint64 ``keys``; a few that no level takes are listed."""
    sizes, words, rest = [], [], keys
    for level in range(LEVELS):
        if not len(rest):
            break
        size = max(64, int(len(rest) * ROOM) + 63 & ~63)
        at = (spread(rest, level + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        rest = rest[~alone[at]]
    bits = np.concatenate([*words, np.zeros(0, np.uint64)])
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.uint32)[:-1]]).astype(np.uint32)
    return {"sizes": sizes, "bits": bits, "ranks": ranks, "placed": len(keys) - len(rest), "rest": np.sort(rest)}


def lookup(tables: dict, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 for some that are not in the set (others get any index)."""
    out = np.full(len(keys), -1, np.int64)
    left, first = np.arange(len(keys)), 0
    for level, size in enumerate(tables["sizes"]):
        at = (spread(keys[left], level + 1) % np.uint64(size)).astype(np.int64)
        word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
        value = tables["bits"][word]
        hit = (value >> bit & np.uint64(1)).astype(bool)
        below = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
        out[left[hit]] = tables["ranks"][word[hit]].astype(np.int64) + below[hit]
        left, first = left[~hit], first + size // 64
    if len(left) and len(tables["rest"]):
        at = np.minimum(np.searchsorted(tables["rest"], keys[left]), len(tables["rest"]) - 1)
        found = tables["rest"][at] == keys[left]
        out[left[found]] = tables["placed"] + at[found]
    return out
