"""Fixed-width packing of ids, and the image of one shard file.

Image, all little-endian: magic ``MRTB``, u8 version, u8 bits per id, u16 zero, u32 ids
per block, u64 ids, u64 blocks; then u64 byte offset of every block and of the end
(blocks + 1 numbers, from the start of the image); then the blocks. Each block holds its
ids bit after bit, lowest bit first, padded to a whole byte, so any block (and with it any
id) is found and unpacked alone.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sBBHIQQ")
MAGIC, VERSION = b"MRTB", 1
BLOCK_IDS = 4096


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    if vocabulary < 1:
        raise ValueError("a vocabulary has at least one id")
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each (at most 32), lowest bit first."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    single = np.unpackbits(as_bytes, axis=1, bitorder="little")[:, :bits]
    return np.packbits(single.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    single = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little")
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = single.reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def image(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The file image of these ids."""
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    head = _HEAD.pack(MAGIC, VERSION, bits, 0, block_ids, len(ids), len(blocks))
    offsets = np.cumsum([_HEAD.size + 8 * (len(blocks) + 1), *map(len, blocks)]).astype("<u8")
    return b"".join([head, offsets.tobytes(), *blocks])


class Image:
    """Random access to the ids of an image."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, self.block_ids, self.n_ids, n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("no token image")
        self.data = data
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, _HEAD.size)

    def block(self, k: int) -> np.ndarray:
        count = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], self.bits, count)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start .. stop``, from the blocks that hold them."""
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        ids = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return ids[start - first * self.block_ids : stop - first * self.block_ids]
