"""Minimal perfect hash of 64-bit keys, by cascaded bit arrays (Limasset and others 2017).

Each level hashes the keys still left to a bit array; a key alone on its bit
stays there, the others go on to the next level. A key's slot is the number
of set bits before its own, so n keys take the slots 0 to n - 1. Whoever stores a
fingerprint in the slot can tell keys from strangers.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from pipewatch.llm import text as tx

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits of a level per key left: about 3.7 bits a key in all.
GAMMA = 2.0
STRANGER = -1


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((level + 1) * int(tx.M1) & (1 << 64) - 1)
    return (tx.mix(keys + step) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray, gamma: float = GAMMA) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of levels in bits, packed bits of all levels) for distinct uint64 keys."""
    sizes, levels = [], []
    while len(keys):
        size = max(64, int(gamma * len(keys)))
        at = _bit(keys, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        keys = keys[~alone[at]]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    return np.array(sizes, np.int64), np.packbits(bits)


class Slots:
    """A built hash, ready to be probed."""

    def __init__(self, sizes: np.ndarray, packed: np.ndarray):
        self.sizes = sizes
        self.bits = np.unpackbits(packed, count=int(sizes.sum())).view(bool)
        self.rank = np.cumsum(self.bits, dtype=np.int32) - 1

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; a stranger's is any slot or STRANGER."""
        out = np.full(len(keys), STRANGER, dtype=np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = _bit(keys[left], level, size) + start
            here = self.bits[at]
            out[left[here]] = self.rank[at[here]]
            left, start = left[~here], start + size
        return out
