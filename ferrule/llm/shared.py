"""Helpers that several operators of this package use: table access, the shared folder, Arrow plumbing and text hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that an Arrow function works on at a time.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def plainly_named(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: Spark's Arrow functions can't take names with dots or back-ticks."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, set here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        else:
            base = spark.conf.get("spark.sql.warehouse.dir", "file:/tmp/spark-warehouse").rstrip("/") + "/_shared"
    return f"{base.rstrip('/')}/ferrule-{uuid.uuid4().hex}"


def settle(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cuts the lineage: written to the shared folder as Parquet and read again, so that a lost executor costs no recomputation."""
    spark = spark or df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path, compression="zstd")
    back = spark.read.schema(df.schema).parquet(path)
    back._settled = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes what settle() wrote; nothing that is still to be computed may read these tables."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._settled)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: its cleaner acts once the driver's collectors have found the tables unused."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that the texts (or bytes) of the column take about SLICE_BYTES; a longer single value stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.binary_length(values).to_numpy(zero_copy_only=False)
        total = np.cumsum(np.nan_to_num(sizes, nan=0.0))
        start = 0
        while start < batch.num_rows:
            done = total[start - 1] if start else 0
            end = int(np.searchsorted(total, done + SLICE_BYTES, side="right"))
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(function, schema)


# ---------------------------------------------------------------------------
# 64-bit hashes of words, for whole batches of texts at once.

_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose output bits all depend on all input bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25
_UNBASE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _CHUNK + 1), _powers(_UNBASE, _CHUNK + 1)


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    high = at // _CHUNK
    if not len(at) or not high.max():
        return table[at]
    steps = _powers(pow(base, _CHUNK, 1 << 64), int(high.max()) + 1)
    return table[at % _CHUNK] * steps[high]


def run_sums(values: np.ndarray) -> np.ndarray:
    """Running sums from which run_hash() takes the hash of any run of values."""
    at = np.arange(len(values), dtype=np.int64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _power(_UP, _BASE, at), out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of runs [first, end), which depend on the values, their order and their number."""
    own = (sums[end] - sums[first]) * _power(_DOWN, _UNBASE, first)
    return mix(own ^ ((end - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


#: Bytes that separate words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a batch of texts: byte ranges in one buffer, the text each belongs to, and 64-bit hashes.

    A word is a longest run of bytes outside SPACE.  lower: A-Z count as a-z.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        if texts.null_count:
            texts = pc.fill_null(texts, b"")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.bounds = (offsets - offsets[0]).astype(np.int64) if n else np.zeros(1, np.int64)
        self.n = n
        self.bytes = _LOWER[raw] if lower else raw
        inside = ~SPACE[self.bytes]
        before = np.empty_like(inside)
        if len(inside):
            before[0] = False
            before[1:] = inside[:-1]
            cut = self.bounds[:-1][self.bounds[:-1] < len(inside)]
            before[cut] = False
            first = inside & ~before
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            last_cut = self.bounds[1:] - 1
            after[last_cut[(last_cut >= 0)]] = False
            self.start = np.flatnonzero(first)
            self.end = np.flatnonzero(inside & ~after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.count = np.diff(np.searchsorted(self.start, self.bounds))
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)
        self.text = np.repeat(np.arange(n), self.count)

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        return run_hash(run_sums(_BYTE[self.bytes]), self.start, self.end)

    def shingles(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of k words; a text with fewer words, but one at least, has its whole sequence as one."""
        w = self.hashes() if hashes is None else hashes
        if not len(w):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        factors = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        parts_t, parts_h = [], []
        if len(w) >= k:
            total = np.zeros(len(w) - k + 1, dtype=np.uint64)
            for j in range(k):
                total += w[j : len(w) - k + 1 + j] * factors[j]
            whole = self.text[: len(w) - k + 1] == self.text[k - 1 :]
            parts_t.append(self.text[: len(w) - k + 1][whole])
            parts_h.append(mix(total[whole]))
        for t in short:
            own = w[self.first[t] : self.first[t + 1]]
            h = np.uint64((int((own * factors[: len(own)]).sum(dtype=np.uint64)) + 0x632BE59BD9B4E019 * len(own)) & _MASK)
            parts_t.append(np.array([t]))
            parts_h.append(mix(np.array([h], dtype=np.uint64)))
        t, h = np.concatenate(parts_t), np.concatenate(parts_h)
        if len(short):
            order = np.argsort(t, kind="stable")
            t, h = t[order], h[order]
        return t, h


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())
