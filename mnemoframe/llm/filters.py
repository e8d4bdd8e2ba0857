"""A broadcast bitmap of bounded size over 64-bit hashes: no false negatives, and few false positives while it isn't full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HashBitmap:
    def __init__(self, hashes: DataFrame, bits_per_hash: int = 8, max_bits: int = 27) -> None:
        """hashes: distinct values in column h. log2 of the bits: so many for each, so many at most (27: 16 MB)."""
        self.count = hashes.count()
        self.bits = min(max_bits, max(12, (self.count << bits_per_hash).bit_length()))
        place = F.explode(F.array(*[F.expr(f"shiftrightunsigned(h, {s}) & {(1 << self.bits) - 1}L") for s in (0, 64 - self.bits)]))
        words = hashes.select(place.alias("p")).groupBy(F.expr("p div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
        bitmap = np.zeros(1 << (self.bits - 6), np.int64)
        got = words.toPandas()  # at most 2 ** (max_bits - 6) rows
        bitmap[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
        self.bitmap = hashes.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Indices of hashes (uint64) that may be among those given."""
        byte, mask = self.bitmap.value, np.uint64((1 << self.bits) - 1)
        at = np.arange(len(h))
        for s in (0, 64 - self.bits):
            p = (h[at] >> np.uint64(s)) & mask
            at = at[(byte[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return at


class PackedBitmap(HashBitmap):
    """The same bitmap, whose parts of 8 kB are filled by tasks: the driver gets at most 2,048 rows of bytes, and puts them side by side."""

    PART = 16  #: log2 of a part's bits

    def __init__(self, hashes: DataFrame, bits_per_hash: int = 8, max_bits: int = 27) -> None:
        self.count = hashes.count()
        self.bits = min(max_bits, max(self.PART, (self.count << bits_per_hash).bit_length()))
        place = F.explode(F.array(*[F.expr(f"shiftrightunsigned(h, {s}) & {(1 << self.bits) - 1}L") for s in (0, 64 - self.bits)]))
        rows = hashes.select(place.alias("p")).select(F.expr(f"cast(p div {1 << self.PART} as int)").alias("part"), F.expr(f"cast(p & {(1 << self.PART) - 1} as int)").alias("at"))
        size = 1 << self.PART

        def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, np.ndarray] = {}
            for b in it:
                part, at = (np.asarray(c) for c in b.columns)
                for k in np.unique(part).tolist():
                    parts.setdefault(k, np.zeros(size, bool))[at[part == k]] = True
            for k, v in parts.items():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(v, bitorder="little").tobytes()], pa.binary())], names=["part", "bits"])

        bitmap = np.zeros(1 << (self.bits - 3), np.uint8)
        for b in rows.repartition("part").mapInArrow(fill, "part int, bits binary").toArrow().to_batches():
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                bitmap[k << (self.PART - 3) : (k + 1) << (self.PART - 3)] = np.frombuffer(v.as_buffer(), np.uint8)
        self.bitmap = hashes.sparkSession.sparkContext.broadcast(bitmap)
