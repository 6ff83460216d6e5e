"""A Bloom filter over 64-bit hashes: a bitmap of bounded size that tasks can ask first.

It answers "maybe" or "surely not". What it lets through is joined exactly afterwards,
so that its size only matters for how many rows reach that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 4
MOST_BITS = 1 << 27  # 16 MB, whatever the number of hashes


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * step) & np.uint64(bits - 1)


def maybe(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes may have been put in."""
    bits = len(bitmap) * 8
    found = np.arange(len(hashes))
    for i in range(PROBES):
        part = hashes[found]
        place = (part + np.uint64(i) * ((part >> np.uint64(32)) | np.uint64(1))) & np.uint64(bits - 1)
        found = found[(bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(len(hashes), bool)
    out[found] = True
    return out


def bloom_filter(frame: DataFrame, column: str) -> np.ndarray:
    """Bitmap over a bigint column: 16 bits a hash, MOST_BITS at most.

    Tasks build bitmaps of that size; the driver joins them one by one.
    """
    count = frame.count()
    bits = min(MOST_BITS, 1 << max(16, (16 * count).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for place in _places(hashes, bits):
                np.bitwise_or.at(bitmap, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        yield pa.record_batch([pa.array([bitmap.tobytes()], pa.binary())], ["bitmap"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in frame.select(column).coalesce(16).mapInArrow(build, "bitmap binary").toLocalIterator():
        whole |= np.frombuffer(row.bitmap, np.uint8)
    return whole
