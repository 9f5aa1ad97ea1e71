"""A wavelet matrix over token ids: compressed bit-planes with rank and select.

Plane by plane, from the highest bit, the ids are dealt stably into those with a 0 and those with a 1.
A plane is kept in blocks of 2**16 bits, each compressed by itself, with the number of ones of each
block beside them: one access, count or lookup opens a few blocks of each plane, never the whole.

File: magic, version, planes, 2 spare bytes, length (8 bytes); then per plane the number of zeros (8),
and for each block its ones and its stored bytes (4 each); then all blocks. Numbers are little-endian.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC, VERSION = b"WMX1", 1
HEAD = struct.Struct("<4sBBHQ")
BITS = 16  # a block has 2**BITS bits
BLOCK = 1 << (BITS - 3)  # its bytes


def build(ids: np.ndarray) -> bytes:
    """The file of ``ids`` (unsigned integers). Working memory: a few copies of the ids."""
    planes = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32 if planes <= 32 else np.uint64, copy=False)
    press = zstandard.ZstdCompressor(level=1)
    heads, blobs = [HEAD.pack(MAGIC, VERSION, planes, 0, len(ids))], []
    for plane in range(planes - 1, -1, -1):
        ones = (ids >> ids.dtype.type(plane)) & ids.dtype.type(1) != 0
        packed = np.packbits(ones)
        cuts = range(0, len(packed), BLOCK)
        counts = np.add.reduceat(np.bitwise_count(packed).astype(np.uint32), cuts) if len(packed) else np.empty(0, np.uint32)
        raw = packed.tobytes()
        pieces = [raw[i : i + BLOCK] for i in cuts]
        small = [press.compress(p) for p in pieces]
        small = [s if len(s) < len(p) else p for s, p in zip(small, pieces)]  # a block that doesn't shrink stays as it is
        heads.append(struct.pack("<Q", len(ids) - int(counts.sum())))
        heads.append(counts.astype("<u4").tobytes())
        heads.append(np.array([len(s) for s in small], "<u4").tobytes())
        blobs += small
        if plane:
            ids = np.concatenate([ids[~ones], ids[ones]])
    return b"".join(heads + blobs)


class _Plane:
    def __init__(self, n: int, zeros: int, ones: np.ndarray, sizes: np.ndarray, data: memoryview):
        self.n, self.zeros, self.data = n, zeros, data
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        self.at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.open: dict[int, np.ndarray] = {}

    def _raw(self, block: int) -> bytes:
        piece = self.data[self.at[block] : self.at[block + 1]]
        size = min(BLOCK, (self.n + 7) // 8 - block * BLOCK)
        return bytes(piece) if len(piece) == size else zstandard.ZstdDecompressor().decompress(piece, max_output_size=size)

    def bits(self, block: int) -> np.ndarray:
        if block not in self.open:
            if len(self.open) >= 64:
                self.open.clear()
            whole = np.unpackbits(np.frombuffer(self._raw(block), np.uint8))
            self.open[block] = whole[: min(1 << BITS, self.n - (block << BITS))].astype(bool)
        return self.open[block]

    def all(self) -> np.ndarray:
        raw = b"".join(self._raw(b) for b in range(len(self.at) - 1))
        return np.unpackbits(np.frombuffer(raw, np.uint8))[: self.n].astype(bool)

    def rank1(self, i: int) -> int:
        """Ones before place ``i``."""
        block, rest = divmod(i, 1 << BITS)
        return int(self.before[block]) + (int(np.count_nonzero(self.bits(block)[:rest])) if rest else 0)

    def select(self, bit: int, ranks: np.ndarray) -> np.ndarray:
        """Places of the given zeros or ones, counted from 0; ``ranks`` ascend."""
        starts = np.arange(len(self.before)) << BITS
        before = self.before if bit else np.minimum(starts, self.n) - self.before
        blocks = np.searchsorted(before, ranks, side="right") - 1
        out = np.empty(len(ranks), np.int64)
        for block in np.unique(blocks):
            mine = blocks == block
            places = np.flatnonzero(self.bits(int(block)) == bool(bit))
            out[mine] = places[ranks[mine] - before[block]] + (int(block) << BITS)
        return out


class WaveletMatrix:
    """Reads a file of ``build``."""

    def __init__(self, data: bytes):
        magic, version, self.planes, _, self.n = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a wavelet matrix of this version")
        blocks, at, parts = -(-self.n // (1 << BITS)), HEAD.size, []
        for _ in range(self.planes):
            zeros = struct.unpack_from("<Q", data, at)[0]
            ones, sizes = np.frombuffer(data, "<u4", 2 * blocks, at + 8).reshape(2, blocks)
            parts.append((zeros, ones, sizes))
            at += 8 + 8 * blocks
        view, self.levels = memoryview(data), []
        for zeros, ones, sizes in parts:
            stop = at + int(sizes.sum(dtype=np.int64))
            self.levels.append(_Plane(self.n, zeros, ones, sizes, view[at:stop]))
            at = stop

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in self.levels:
            bit = int(level.bits(i >> BITS)[i & ((1 << BITS) - 1)])
            ones = level.rank1(i)
            value, i = value << 1 | bit, (level.zeros + ones if bit else i - ones)
        return value

    def _range(self, token: int, start: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` among places start to stop lie below the last plane."""
        if token >> self.planes:
            return 0, 0
        for k, level in enumerate(self.levels):
            a, b = level.rank1(start), level.rank1(stop)
            bit = token >> (self.planes - 1 - k) & 1
            start, stop = (level.zeros + a, level.zeros + b) if bit else (start - a, stop - b)
        return start, stop

    def count(self, token: int, start: int = 0, stop: int | None = None) -> int:
        """How often ``token`` stands in places start (included) to stop (not included)."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        return b - a

    def places(self, token: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """All places of ``token`` from start to stop, ascending."""
        a, b = self._range(token, start, self.n if stop is None else stop)
        at = np.arange(a, b, dtype=np.int64)
        for k in range(self.planes - 1, -1, -1):
            level, bit = self.levels[k], token >> (self.planes - 1 - k) & 1
            at = level.select(bit, at - level.zeros if bit else at)
        return at

    def tokens(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest, without random access."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32 if self.planes <= 32 else np.uint64)
        for k in range(self.planes - 1, -1, -1):
            level = self.levels[k]
            ones = level.all()
            up = np.empty_like(values)
            up[~ones] = values[: level.zeros]
            up[ones] = values[level.zeros :] | values.dtype.type(1 << (self.planes - 1 - k))
            values = up
        return values
