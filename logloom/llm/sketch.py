"""Hash counts in packed blocks, and sliced Bloom filters built from them.

Counting n-grams over a corpus moves one 64-bit hash for each distinct n-gram
of a task.  Sent as sorted, delta-coded, byte-transposed and compressed blocks
they take 5 to 6 bytes each.  A block belongs to a bucket, the hash's top
bits; the bucket count follows the input's bytes, so a bucket stays small at
any size, and what a task has seen of one hash is one entry, however frequent
it is.  A Bloom filter is cut into one slice for each bucket, so the task that
merges a bucket builds its slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import GOLD

#: bytes of text for one bucket, and the fewest buckets
BUCKET_BYTES = 16 << 20
LEAST_BITS = 4
#: entries that a task gathers before it sends them on
FLUSH = 4_000_000


def bucket_bits(docs: DataFrame, *, bytes_each: int = BUCKET_BYTES) -> int:
    """Bits of the bucket number: by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BITS, (max(1, size // bytes_each) - 1).bit_length())


def pack(values: np.ndarray, *, ordered: bool = False) -> bytes:
    """Unsigned numbers as a compressed block; ``ordered``: as differences."""
    x = values.astype(np.uint64, copy=False)
    if ordered and len(x):
        x = np.concatenate([x[:1], x[1:] - x[:-1]])
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(block: bytes, *, ordered: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ordered else x


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted ``keys`` that share their top ``bits``."""
    if len(keys):
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        cut = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
        for b in np.flatnonzero(np.diff(cut)).tolist():
            yield b, slice(int(cut[b]), int(cut[b + 1]))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class SlicedBloom:
    """A Bloom filter of ``1 << bits`` slices of ``width`` bits each; ``data``
    may be a run of consecutive slices from number ``low`` on."""

    def __init__(self, data: bytes | bytearray, bits: int, width: int, probes: int, low: int = 0) -> None:
        self.raw, self.bits, self.width, self.probes, self.low = np.frombuffer(data, np.uint8), bits, width, probes, low

    @staticmethod
    def places(event: np.ndarray, width: int, probes: int) -> Iterator[np.ndarray]:
        """Bit numbers of an event (a well mixed hash) inside its slice, one
        array for each probe."""
        x = event * GOLD
        a, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        for k in range(probes):
            yield ((a + np.uint64(k) * step & np.uint64(0xFFFFFFFF)) * np.uint64(width)) >> np.uint64(32)

    @classmethod
    def slice_of(cls, events: np.ndarray, width: int, probes: int) -> bytes:
        bits = np.zeros(width, bool)
        for at in cls.places(events, width, probes):
            bits[at] = True
        return np.packbits(bits, bitorder="little").tobytes()

    def holds(self, keys: np.ndarray, events: np.ndarray) -> np.ndarray:
        """Whether each event is in (its slice is by ``keys``); repeated
        probes, each only where all earlier ones hit."""
        out = np.zeros(len(keys), bool)
        left = np.arange(len(keys))
        base = ((keys >> np.uint64(64 - self.bits)) - np.uint64(self.low)) * np.uint64(self.width)
        x = events * GOLD
        a, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
        for k in range(self.probes):
            at = base[left] + (((a[left] + np.uint64(k) * step[left] & np.uint64(0xFFFFFFFF)) * np.uint64(self.width)) >> np.uint64(32))
            left = left[(self.raw[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[left] = True
        return out


def collected(slices: DataFrame, number: int, width: int) -> bytearray:
    """A filter from its slices (bucket, data): ``number * width`` bits, a size
    that the caller bounds."""
    out = bytearray(number * width // 8)
    for r in slices.collect():
        at = r["bucket"] * width // 8
        out[at:at + width // 8] = r["data"]
    return out
