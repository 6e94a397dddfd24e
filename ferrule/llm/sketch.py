"""Which hashes of a corpus occur more than once, and which very often: a summary of bounded size that covers every row.

The hash space is cut into slices, a power of two of them.  Workers pack the 32 bits that follow a slice's own of their hashes as
sorted, delta-coded, compressed blocks with local counts, so that a shuffle carries one to three bytes a hash.  Each slice is then
merged by itself.  What reaches the driver is bounded whatever the corpus: a bitmap, in which a bit is set if some value of its slot
occurs twice, and the `hottest` most frequent values.  A hash that really repeats always has its bit set; others may.  So whoever
drops what has no bit loses nothing, and an order by frequency that knows only the hottest values is still one order.

The bitmap has about a bit for every word of the corpus, 2 ** MOST_BITS at most.  Beyond a corpus of so many words it fills up, and
in the end every hash may repeat: nothing is dropped any more, which costs time but no result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, slices

#: Hashes that a worker gathers before it packs them; sorting takes some 50 bytes for each.
GATHER = 1 << 20
#: Logarithms of the bitmap's least and greatest size in bits; bytes of text that count as a word.
LEAST_BITS, MOST_BITS = 20, 30
WORD_BYTES = 6


def pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct 32-bit values with their counts."""
    step = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate([step.view(np.uint8).reshape(-1, 4).T.ravel(), np.minimum(counts, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), dtype=np.uint8)
    step, counts = (np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel() for x in np.split(planes, 2))
    return np.cumsum(step, dtype=np.uint64).astype(np.uint32), counts


class Repeated:
    def __init__(self, bitmap: np.ndarray, bits: int, slice_bits: int, hot: np.ndarray, hot_counts: np.ndarray):
        self.bitmap, self.bits, self.slice_bits, self.hot, self.hot_counts = bitmap, bits, slice_bits, hot, hot_counts

    def may_repeat(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """0, or for one of the hottest values the binary logarithm of its count."""
        if not len(self.hot):
            return np.zeros(len(hashes), dtype=np.uint8)
        value = hashes >> np.uint64(32 - self.slice_bits)
        at = np.minimum(np.searchsorted(self.hot, value), len(self.hot) - 1)
        return np.where(self.hot[at] == value, self.hot_counts[at], 0).astype(np.uint8)


def gather(batches: Iterable[pa.RecordBatch], hashes_of: Callable[[pa.RecordBatch], np.ndarray], slice_bits: int) -> Iterator[pa.RecordBatch]:
    """(slice, block) rows for all hashes of a partition."""

    def blocks(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        edges = [0, *np.searchsorted(values, np.arange(1, 1 << slice_bits, dtype=np.uint64) << np.uint64(32)).tolist(), len(values)]
        values = values.astype(np.uint32)
        rows = [(i, pack(values[a:b], counts[a:b])) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pa.RecordBatch.from_pydict({"slice": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.binary())})

    parts, held = [], 0
    for batch in batches:
        h = hashes_of(batch)
        parts.append(h >> np.uint64(32 - slice_bits))
        held += len(h)
        if held >= GATHER:
            yield blocks(parts)
            parts, held = [], 0
    if held:
        yield blocks(parts)


def repeated(docs: DataFrame, text_col: str, hashes_of: Callable[[pa.RecordBatch], np.ndarray], hottest: int = 1 << 20, hot_from: int = 32) -> Repeated:
    """The summary of all hashes that hashes_of finds in the batches of docs."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(size / WORD_BYTES + 1))))
    slice_bits = min(bits - 6, 16, max(6, math.ceil(math.log2(2 * partitions(spark)))))
    quota = max(1, hottest >> slice_bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gather(slices(batches, text_col), hashes_of, slice_bits)

    def merge(group: pa.Table) -> pa.Table:
        kind = pa.schema([("slice", pa.int32()), ("bitmap", pa.binary()), ("hot", pa.binary()), ("counts", pa.binary())])
        which = group.column("slice")[0].as_py()
        values, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            nonlocal values, counts
            every = np.concatenate([values, *(x[0] for x in held)])
            number = np.concatenate([counts, *(x[1].astype(np.int64) for x in held)])
            order = np.argsort(every, kind="stable")
            every, number = every[order], number[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            values, counts = every[first], np.add.reduceat(number, first)
            held.clear()

        for block in group.column("block"):
            held.append(unpack(block.as_py()))
            if sum(len(x[0]) for x in held) > max(GATHER, len(values)):
                fold()
        fold()
        twice = counts >= 2
        values, counts = values[twice], counts[twice]
        mask = np.zeros(1 << (bits - slice_bits), dtype=np.uint8)
        mask[values >> np.uint32(32 - bits + slice_bits)] = 1
        hot = np.flatnonzero(counts >= hot_from)
        hot = np.sort(hot[np.argsort(-counts[hot], kind="stable")[:quota]])
        return pa.table({"slice": [which], "bitmap": [np.packbits(mask, bitorder="little").tobytes()], "hot": [((np.uint64(which) << np.uint64(32)) + values[hot]).astype("<u8").tobytes()], "counts": [np.log2(counts[hot]).astype(np.uint8).tobytes()]}, schema=kind)

    found = docs.mapInArrow(scan, "slice int, block binary").groupBy("slice").applyInArrow(merge, "slice int, bitmap binary, hot binary, counts binary")
    bitmap = np.zeros(1 << (bits - 3), dtype=np.uint8)
    width = len(bitmap) >> slice_bits
    hot, counts = [], []
    # bounded: the bitmap has 2 ** MOST_BITS bits at most, and there are at most `hottest` values
    for row in found.orderBy("slice").toLocalIterator():
        bitmap[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["bitmap"], dtype=np.uint8)
        hot.append(np.frombuffer(row["hot"], dtype="<u8"))
        counts.append(np.frombuffer(row["counts"], dtype=np.uint8))
    return Repeated(bitmap, bits, slice_bits, np.concatenate(hot or [np.zeros(0, np.uint64)]), np.concatenate(counts or [np.zeros(0, np.uint8)]))


def row_key(id_col: str, text_col: str):
    """Columns that tell rows apart: the id and a hash of the text (equal ids with equal texts are one document)."""
    return F.col(id_col).cast("bigint").alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"), F.col(text_col).cast("string").alias("_text")
