"""Importance resampling towards a target: bags of hashed word n-grams and Gumbel top-k.

Words are runs of ``[a-z0-9]`` and non-ASCII bytes of the text with A-Z lowered. A feature is
a run of one to three consecutive words, joined by one space; its bucket is the CRC-32 of its
bytes modulo 10,000. Each bucket's gain compares its share in the target with its share in
the documents, a document's weight sums the gains of its features, and the drawn documents
are those whose weight plus Gumbel noise, a function of the id, is highest.

CRC-32 is linear over XOR: a byte contributes a value that depends on itself and on its
distance from the end of the message only, and the length adds a constant. The words of many
texts are laid end to end with one space between, so every feature is a span of that array;
the table's entries for all bytes of all spans are gathered and ``bitwise_xor.reduceat``
folds them, span by span. Spans longer than the table go block by block: the value so far
moves on by a block's length, and the block's own contributions are added.

Every document gets a row. Texts that are null, empty or without words have no feature and
weight 0. Null ids draw the noise of the empty text and come first among ties. Documents of
fewer than ``least_words`` words are never drawn and have no rank. Ties go to the smaller id,
repeated rows in the order in which their scores were stored. An empty table gives no rows,
an empty target only gains against it. Other columns of the frame are neither read nor kept.

Only the 10,000 bucket counts and one row count per sorted partition reach the driver; ranks
come from a range-partitioned sort, so no task sees more than its own range.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.base import as_bytes, lowered, pieces, stored

BUCKETS = 10_000
MOST_WORDS = 3
# Distances from the end that the table holds; longer spans are folded in such blocks.
BLOCK = 256
# Words whose spans are gathered at once.
STEP = 1 << 15

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


# --- checksums of spans -----------------------------------------------------------------


class SpanCrc:
    """CRC-32 of any spans of a byte array."""

    def __init__(self) -> None:
        zero = zlib.crc32(b"\0")
        # crc(b) ^ crc(0) is what a single byte adds, at distance 0.
        first = np.array([zlib.crc32(bytes([b])) ^ zero for b in range(256)], np.uint32)
        self.step = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        self.step ^= np.uint32(zero)
        table = np.empty((BLOCK, 256), np.uint32)
        table[0] = first
        for distance in range(1, BLOCK):
            table[distance] = self._moved(table[distance - 1])
        self.table = table.ravel()
        self.lengths = np.array([zlib.crc32(bytes(n)) for n in range(BLOCK + 1)], np.uint32)
        # What each byte of a 32-bit value becomes after a whole block of zero bytes.
        self.jump = np.empty((4, 256), np.uint32)
        for place in range(4):
            values = np.arange(256, dtype=np.uint32) << np.uint32(8 * place)
            for _ in range(BLOCK):
                values = self._moved(values)
            self.jump[place] = values

    def _moved(self, values: np.ndarray) -> np.ndarray:
        """Linear parts after one more zero byte."""
        return (values >> np.uint32(8)) ^ self.step[values & np.uint32(0xFF)]

    def _jumped(self, values: np.ndarray) -> np.ndarray:
        """Linear parts after BLOCK more zero bytes."""
        out = self.jump[0][values & np.uint32(0xFF)]
        for place in range(1, 4):
            out = out ^ self.jump[place][(values >> np.uint32(8 * place)) & np.uint32(0xFF)]
        return out

    def short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Linear parts of spans of 1 to BLOCK bytes: one gather, one reduction."""
        sizes = ends - starts
        edges = np.cumsum(sizes)
        at = np.arange(edges[-1]) + np.repeat(starts - (edges - sizes), sizes)
        index = (np.repeat(ends - 1, sizes) - at) << 8
        index |= data[at]
        return np.bitwise_xor.reduceat(self.table[index], edges - sizes)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unsigned CRC-32 of data[start:end] for every span; no span is empty."""
        sizes = ends - starts
        out = np.empty(len(starts), np.uint32)
        long = sizes > BLOCK
        if not long.any():
            if len(starts):
                out[:] = self.short(data, starts, ends) ^ self.lengths[sizes]
            return out
        rest = np.flatnonzero(~long)
        if len(rest):
            out[rest] = self.short(data, starts[rest], ends[rest]) ^ self.lengths[sizes[rest]]
        for span in np.flatnonzero(long):
            out[span] = self._long(data[starts[span] : ends[span]])
        return out

    def _long(self, span: np.ndarray) -> int:
        """The blocks of one long span, folded from its front; the first may be short.

        Blocks are reduced together, so only the fold itself goes one by one.
        """
        head = len(span) % BLOCK or BLOCK
        starts = np.concatenate([[0], np.arange(head, len(span), BLOCK)])
        ends = np.append(starts[1:], len(span))
        blocks = self.short(span, starts, ends)
        # The length's constant enters as the constant of the first block and moves along.
        value = blocks[:1] ^ self.lengths[head : head + 1]
        zeros = self.lengths[BLOCK : BLOCK + 1]
        for block in range(1, len(blocks)):
            value = self._jumped(value) ^ blocks[block : block + 1] ^ zeros
        return int(value[0])


@lru_cache(maxsize=1)
def span_crc() -> SpanCrc:
    return SpanCrc()


# --- features ---------------------------------------------------------------------------


def _joined(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all rows end to end, one space after each: the bytes, starts and ends of the
    words, and the number of words in each row."""
    low = lowered(data)
    inside = _INSIDE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[bounds] = True
    before, after = np.zeros(len(low), bool), np.zeros(len(low), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    new_starts = new_ends - sizes
    text = np.full(int(new_ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    kept = np.flatnonzero(inside)
    text[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = low[kept]
    return text, new_starts, new_ends, counts


def feature_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the row of each, and the words of each row."""
    text, starts, ends, counts = _joined(data, bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    buckets, rows, crc = [], [], span_crc()
    for lo in range(0, len(starts), STEP):
        own = np.arange(lo, min(lo + STEP, len(starts)))
        for n in range(MOST_WORDS):
            first = own[own + n < len(starts)]
            first = first[row[first] == row[first + n]]
            buckets.append(crc.of(text, starts[first], ends[first + n]) % np.uint32(BUCKETS))
            rows.append(row[first])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64), counts
    return np.concatenate(buckets).astype(np.int64), np.concatenate(rows), counts


def bucket_counts(rows: DataFrame, text: str = "text") -> np.ndarray:
    """Features in each bucket over all rows. Every task adds up its own share first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, bounds = as_bytes(batch.column(0))
            for a, b in pieces(bounds):
                own = data[bounds[a] : bounds[b]]
                found, _, _ = feature_buckets(own, bounds[a : b + 1] - bounds[a])
                total += np.bincount(found, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = rows.select(text).mapInArrow(task, "bucket long, n long")
    # At most BUCKETS rows.
    summed = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, in doubles."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weighted(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_gain = shared.value
        for batch in batches:
            data, bounds = as_bytes(batch.column(1))
            for a, b in pieces(bounds):
                own = data[bounds[a] : bounds[b]]
                found, row, words = feature_buckets(own, bounds[a : b + 1] - bounds[a])
                weight, count = np.zeros(b - a, np.int64), np.bincount(row, minlength=b - a)
                np.add.at(weight, row, own_gain[found])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), *map(pa.array, (words, count, weight))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text)
    return rows.mapInArrow(task, "doc_id long, n_words long, n_features long, weight long")


# --- the draw ---------------------------------------------------------------------------


def gumbel(doc_id: Column, seed: str = "42") -> Column:
    """floor(-1000 ln(-ln u)) of an id, u from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rank`` 1, 2, 3... of the highest ``percent`` of the long documents by (score, id).

    ``scored`` is a stored table with a ``_row`` number. Rows are dealt by ranges of their
    order and sorted inside; a range's first rank follows from the sizes of those before it.
    """
    long = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = stored(
        scored.where(long)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "resampling-order",
    ).withColumn("_range", F.shiftright("_place", 33))
    # One row for each range.
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.select(
        "_range",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy()).alias("_all"),
    )
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    drawn = F.floor(F.col("_all") * percent / 100)
    placed = dealt.join(F.broadcast(ranges), "_range").withColumn(
        "rank", F.when(rank <= drawn, rank)
    )
    short = scored.where(~long).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*short.columns).unionByName(short).drop("_row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20,
             seed: str = "42") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weighted(docs, gain).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"), seed)
    )
    kept = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "resampling-scores")
    return ranked(kept, percent, least_words)
