"""Minimal perfect hashing of sets of 64-bit keys, in numpy.

Keys are set level by level: at each level a key hashes to a slot of a bit
array of ``GAMMA`` slots a key; keys alone in their slot set its bit, the
others go to the next level with another hash. The number of a key is the rank
of its bit, so n keys get 0 .. n-1. The keys stand in that order beside the
bits; a lookup compares them, so that a strange key is found out.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2
_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of 64-bit numbers (public finaliser constants)."""
    x = x.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & (2 ** 64 - 1))
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level sizes, bits of all levels packed little-endian, keys by number) of
    distinct int64 keys."""
    left, sizes, bits, placed, level = keys, [], [], [], 0
    while len(left):
        m = -(-GAMMA * len(left) // 64) * 64
        at = (mix(left, level) % _U(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        mine = alone[at]
        sizes.append(m)
        bits.append(alone)
        placed.append(left[mine][np.argsort(at[mine])])
        left, level = left[~mine], level + 1
    packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
    return np.array(sizes, dtype=np.int64), packed, np.concatenate(placed) if placed else keys


class Table:
    """Lookup in several shards set one after another: ``parts`` are (level
    sizes, packed bits, keys by number); keys of ``shard`` s are in part s."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        depth = max((len(p[0]) for p in parts), default=0)
        self.sizes = np.zeros((depth, max(1, len(parts))), dtype=np.int64)
        for s, (sizes, _, _) in enumerate(parts):
            self.sizes[:len(sizes), s] = sizes
        ends = np.cumsum(self.sizes.T.ravel()).reshape(self.sizes.T.shape).T
        self.starts = ends - self.sizes
        self.words = np.concatenate([p[1] for p in parts]).view("<u8") if parts else np.zeros(0, "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([p[2] for p in parts]) if parts else np.zeros(0, np.int64)

    def number(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 for a key that is not in the table."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level in range(len(self.sizes)):
            m = self.sizes[level, shard[todo]]
            todo, m = todo[m > 0], m[m > 0]
            if not len(todo):
                break
            at = self.starts[level, shard[todo]] + (mix(keys[todo], level) % m.astype(_U)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(_U)
            here = (word >> bit) & _U(1) == 1
            rank = self.before[at >> 6] + np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[todo[here]] = rank[here]
            todo = todo[~here]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out
