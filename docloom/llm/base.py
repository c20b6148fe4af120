"""What the operators share: tables in the shared folder, text as byte arrays, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import work_path

PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there.

    Cuts the lineage: what follows can be retried without computing ``df`` again.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block remove their shuffle files when they are done. For frames that are
    run once: another run of them would shuffle again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Free memory of this process goes back to the machine, where its C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` that leaves no free memory behind: workers are kept for the tasks that follow,
    of other steps too, and what they have not given back counts on top of theirs."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def id_remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values end to end, and the n + 1 offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = values.buffers()
    bounds = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    if data is None:
        return np.empty(0, np.uint8), np.zeros(len(values) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes come to about ``size``; a longer row stands alone."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of an odd number modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def _coded(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data] if data.dtype == np.uint8 else mixed(data)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes, or 64-bit values, wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_coded(data) * _UP.upto(len(data)), out=sums[1:])
    spans = (sums[ends] - sums[starts]) * _DOWN.upto(len(data) + 1)[starts]
    return mixed(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def rolling_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of every run of ``width`` bytes or 64-bit values."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_coded(data) * _UP.upto(len(data)), out=sums[1:])
    spans = (sums[width:] - sums[:-width]) * _DOWN.upto(len(data) + 1)[: len(sums) - width]
    return mixed(spans + np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the words of each row."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, counts


def row_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of consecutive runs of ``values``; an empty run gives 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    edges = np.concatenate([[0], np.cumsum(counts)])
    return total[edges[1:]] - total[edges[:-1]]
