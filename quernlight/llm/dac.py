"""Directly addressable codes: ids cut into chunk levels, with continuation bitmaps and rank directories.

Level 0 holds the low `width` bits of every id. A bitmap over the level says which ids go on; their next chunks
make up level 1, and so on. A directory with the number of set bits before each block of 512 gives rank() in
constant time, so any id is read through one look-up a level, without decoding what stands before it.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
BLOCK = 512
_HEAD = struct.Struct("<4sBBHQ")
_LEVEL = struct.Struct("<Q")


def pack(ids: np.ndarray, width: int = 8) -> bytes:
    """ids: unsigned 32-bit integers. width: 8 or 16 bits a chunk."""
    kind, mask = (np.uint8, 0xFF) if width == 8 else (np.uint16, 0xFFFF)
    rest, levels = ids.astype(np.uint32, copy=False), []
    while True:
        chunk, more = (rest & mask).astype(kind), rest > mask
        bits = np.packbits(more, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        per_block = np.bitwise_count(bits.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
        rank = np.concatenate([[0], np.cumsum(per_block)]).astype("<u4")
        levels.append(_LEVEL.pack(len(chunk)) + chunk.tobytes() + bits.tobytes() + rank.tobytes())
        if not more.any():
            return _HEAD.pack(MAGIC, width, len(levels), 0, len(ids)) + b"".join(levels)
        rest = rest[more] >> width


class Reader:
    """Random access to a packed container."""

    def __init__(self, blob: bytes):
        magic, self.width, n, _, self.n = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a DAC container")
        at, kind, self.levels = _HEAD.size, np.uint8 if self.width == 8 else np.uint16, []
        for _ in range(n):
            (size,) = _LEVEL.unpack_from(blob, at)
            at += _LEVEL.size
            chunk = np.frombuffer(blob, kind, size, at)
            at += chunk.nbytes
            blocks = -(-size // BLOCK)
            bits = np.frombuffer(blob, np.uint8, blocks * BLOCK // 8, at)
            at += bits.nbytes
            rank = np.frombuffer(blob, "<u4", blocks + 1, at)
            at += rank.nbytes
            self.levels.append((chunk, bits, rank))

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        _, bits, rank = self.levels[level]
        block = i // BLOCK
        first, last = block * BLOCK // 8, i // 8
        count = int(np.bitwise_count(bits[first:last]).sum()) if last > first else 0
        return int(rank[block]) + count + (int(bits[last]) & ((1 << i % 8) - 1)).bit_count() if i % 8 else int(rank[block]) + count

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunk, bits, _ = self.levels[level]
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift, level = self._rank(level, i), shift + self.width, level + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], reading only that range of each level."""
        spans = [(start, stop)]
        for level in range(len(self.levels) - 1):
            a, b = spans[-1]
            spans.append((self._rank(level, a) if a < len(self.levels[level][0]) else int(self.levels[level][2][-1]), self._rank(level, b) if b < len(self.levels[level][0]) else int(self.levels[level][2][-1])))
        upper = np.zeros(0, np.uint32)
        for (chunk, bits, _), (a, b) in zip(reversed(self.levels), reversed(spans)):
            out = chunk[a:b].astype(np.uint32)
            if len(upper):
                more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].view(bool)
                out[more] |= upper << np.uint32(self.width)
            upper = out
        return upper
