"""Static binary fuse filters (3-wise, 8-bit fingerprints) over 64-bit keys, in numpy.

A filter is built once for an immutable key set and answers "maybe" for every key of the
set and "no" for about 255 of 256 others, at about 9 bits a key. Peeling and assignment
work on whole rounds of keys: keys peeled in one round own slots that no other key of
that round touches, so a round is one vectorised step.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from .textkernel import U, mix

_HEAD = struct.Struct("<4sQQIII")
_MAGIC = b"BFF8"


class FuseFilter:
    """``FuseFilter.build(keys)``, ``filter.contains(keys)``, ``to_bytes`` / ``from_bytes``."""

    def __init__(self, seed: int, n: int, seg: int, segments: int, table: np.ndarray):
        self.seed, self.n, self.seg, self.segments, self.table = seed, n, seg, segments, table

    @staticmethod
    def _slots(h: np.ndarray, seg: int, segments: int) -> tuple[np.ndarray, ...]:
        a = ((h >> U(32)) * U(seg * segments)) >> U(32)
        m = U(seg - 1)
        b = (a + U(seg)) ^ ((h >> U(18)) & m)
        c = (a + U(2 * seg)) ^ (h & m)
        return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> U(32))) & U(255)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """Repeated keys count once; no key at all gives a filter that denies everything."""
        keys = np.unique(np.asarray(keys, np.uint64))
        n = len(keys)
        if n == 0:
            return cls(0, 0, 1, 1, np.zeros(3, np.uint8))
        seg = 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))) if n > 1 else 4
        seg = min(seg, 1 << 18)
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
        for seed in range(1, 200):
            segments = max(1, -(-int(n * factor) // seg) - 2)
            h = mix(keys ^ mix(np.array([seed], np.uint64)))
            table = cls._fill(h, seg, segments)
            if table is not None:
                return cls(seed, n, seg, segments, table)
            factor *= 1.02
        raise RuntimeError("no filter found; the keys' hashes collide")

    @classmethod
    def _fill(cls, h: np.ndarray, seg: int, segments: int) -> np.ndarray | None:
        slots = np.stack(cls._slots(h, seg, segments))
        size = (segments + 2) * seg
        count = np.bincount(slots.ravel(), minlength=size)
        xor = np.zeros(size, np.int64)
        for s in slots:
            np.bitwise_xor.at(xor, s, np.arange(len(h)))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left, ready = len(h), np.flatnonzero(count == 1)
        while len(ready):
            own, at = np.unique(xor[ready], return_index=True)
            ready = ready[at]
            rounds.append((own, ready))
            left -= len(own)
            gone = slots[:, own].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(xor, gone, np.tile(own, 3))
            gone = np.unique(gone)
            ready = gone[count[gone] == 1]
        if left:
            return None
        table = np.zeros(size, np.uint8)
        prints = cls._print(h)
        for own, at in reversed(rounds):
            a, b, c = slots[:, own]
            table[at] = 0
            table[at] = prints[own] ^ table[a] ^ table[b] ^ table[c]
        return table

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if self.n == 0:
            return np.zeros(len(keys), bool)
        h = mix(np.asarray(keys, np.uint64) ^ mix(np.array([self.seed], np.uint64)))
        a, b, c = self._slots(h, self.seg, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._print(h)

    def to_bytes(self) -> bytes:
        return _HEAD.pack(_MAGIC, self.seed, self.n, self.seg, self.segments, len(self.table)) + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> FuseFilter:
        magic, seed, n, seg, segments, size = _HEAD.unpack_from(data)
        if magic != _MAGIC or len(data) != _HEAD.size + size:
            raise ValueError("not a filter file")
        return cls(seed, n, seg, segments, np.frombuffer(data, np.uint8, size, _HEAD.size))
