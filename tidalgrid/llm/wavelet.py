"""A wavelet matrix over token ids: bit planes with rank directories in one compressed byte string.

Plane 0 holds every id's highest bit in text order; each further plane holds the next bit after a
stable partition by the bit before (zeros first).  A token, the count of an id before a position and
the place of its k-th occurrence each take one rank or select per plane.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"TGWM\x01"
#: Bits between two entries of the rank directory.
BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Ids partitioned at once: their places fit a core's cache.
_STRETCH = 1 << 15


def _kind(bits: int) -> type:
    """The narrowest unsigned type of ``bits`` bits."""
    return np.uint8 if bits <= 8 else np.uint16 if bits <= 16 else np.uint32


def _halves(ones: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice]]:
    """The stable partition by ``ones`` (bool, ``zeros`` of them False), stretch by stretch and half by half:
    (the stretch, places inside it, where these lie after the partition)."""
    to = [0, zeros]
    for i in range(0, len(ones), _STRETCH):
        part = ones[i : i + _STRETCH]
        for half, bit in enumerate((~part, part)):
            at = np.flatnonzero(bit)
            yield slice(i, i + len(part)), at, slice(to[half], to[half] + len(at))
            to[half] += len(at)


def _directory(packed: np.ndarray) -> np.ndarray:
    """Ones before each block of ``BLOCK`` bits."""
    step = BLOCK // 8
    padded = np.zeros(-(-len(packed) // step) * step, np.uint8)
    padded[: len(packed)] = packed
    per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(per)])


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], directories: list[np.ndarray], zeros: list[int]) -> None:
        self.n, self.planes, self.directories, self.zeros = n, planes, directories, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int | None = None) -> "WaveletMatrix":
        """From unsigned 32-bit ids; ``bits`` planes, or as many as the largest id needs (one at least)."""
        n = len(ids)
        bits = bits or max(1, int(ids.max()).bit_length() if n else 1)
        a = np.ascontiguousarray(ids, _kind(bits))
        planes, directories, zeros = [], [], []
        for b in range(bits - 1, -1, -1):
            a = a.astype(_kind(b + 1), copy=False)  # the bits above lie in planes already
            ones = (a & a.dtype.type(1 << b)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            directories.append(_directory(planes[-1]))
            zeros.append(n - int(directories[-1][-1]))
            if b:
                out = np.empty_like(a)
                for part, at, to in _halves(ones, zeros[-1]):
                    np.take(a[part], at, out=out[to], mode="clip")
                a = out
        return cls(n, planes, directories, zeros)

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane ``k`` before each position ``i``."""
        i = np.asarray(i, np.int64)
        block = i // BLOCK
        count = self.directories[k][block].copy()
        for j in np.flatnonzero(i % BLOCK):
            first, last = int(block.flat[j]) * BLOCK // 8, int(i.flat[j]) // 8
            count.flat[j] += int(_ONES[self.planes[k][first:last]].sum(dtype=np.int64))
            if left := int(i.flat[j]) % 8:
                count.flat[j] += int(_ONES[self.planes[k][last] & ((1 << left) - 1)])
        return count

    def access(self, i: int) -> int:
        """The id at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, plane in enumerate(self.planes):
            bit = int(plane[i >> 3]) >> (i & 7) & 1
            ones = int(self._rank1(k, np.array([i]))[0])
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the ids ``value`` among the first ``i`` lie after the last plane: [first, past)."""
        at = np.array([0, i])
        for k in range(len(self.planes)):
            ones = self._rank1(k, at)
            at = self.zeros[k] + ones if value >> (len(self.planes) - 1 - k) & 1 else at - ones
        return int(at[0]), int(at[1])

    def rank(self, value: int, i: int | None = None) -> int:
        """How many of the first ``i`` ids (all if None) are ``value``."""
        if value < 0 or value >> len(self.planes):
            return 0
        first, past = self._range(value, self.n if i is None else i)
        return past - first

    def select(self, value: int, k: int) -> int:
        """The position of the ``k``-th (from 0) occurrence of ``value``."""
        if value < 0 or value >> len(self.planes):
            raise IndexError(value)
        first, past = self._range(value, self.n)
        if not 0 <= k < past - first:
            raise IndexError(k)
        at = first + k
        for p in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - p) & 1
            at = self._select_bit(p, bit, at - self.zeros[p] if bit else at)
        return at

    def _select_bit(self, k: int, bit: int, j: int) -> int:
        """Position of the ``j``-th (from 0) bit equal to ``bit`` in plane ``k``."""
        ones = self.directories[k]
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        bits = np.unpackbits(self.planes[k][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == bit)[j - int(before[block])])

    def locate(self, value: int) -> list[int]:
        """All positions of ``value``, ascending."""
        return [self.select(value, k) for k in range(self.rank(value))]

    def to_array(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane to the first."""
        bits = len(self.planes)
        a = np.zeros(self.n, np.uint8)
        for k in range(bits - 1, -1, -1):
            b = bits - 1 - k
            ones = np.unpackbits(self.planes[k], count=self.n, bitorder="little")
            if not b:
                a = ones
                continue
            a = a.astype(_kind(b + 1), copy=False)
            a[self.zeros[k] :] |= a.dtype.type(1 << b)
            out = np.empty_like(a)
            for part, at, to in _halves(ones.view(bool), self.zeros[k]):
                out[part][at] = a[to]
            a = out
        return a.astype(np.uint32)

    def to_bytes(self, **columns: np.ndarray) -> bytes:
        """One self-describing compressed byte string; ``columns`` are int64 arrays kept beside the planes."""
        c = zstandard.ZstdCompressor(level=1)
        parts = [c.compress(p.tobytes()) for p in self.planes] + [c.compress(np.diff(d).astype("<u2").tobytes()) for d in self.directories]
        parts += [c.compress(np.ascontiguousarray(v, "<i8").tobytes()) for v in columns.values()]
        head = json.dumps({"n": self.n, "bits": len(self.planes), "columns": {k: len(v) for k, v in columns.items()}, "sizes": [len(p) for p in parts]}).encode()
        return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["WaveletMatrix", dict[str, np.ndarray]]:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", data[len(MAGIC) : at])[0]
        head = json.loads(data[at : at + size])
        at += size
        d, parts = zstandard.ZstdDecompressor(), []
        for s in head["sizes"]:
            parts.append(d.decompress(data[at : at + s]))
            at += s
        bits, n = head["bits"], head["n"]
        planes = [np.frombuffer(p, np.uint8) for p in parts[:bits]]
        directories = [np.concatenate([[0], np.cumsum(np.frombuffer(p, "<u2").astype(np.int64))]).astype(np.int64) for p in parts[bits : 2 * bits]]
        columns = {k: np.frombuffer(p, "<i8") for k, p in zip(head["columns"], parts[2 * bits :], strict=True)}
        return cls(n, planes, directories, [n - int(x[-1]) for x in directories]), columns
