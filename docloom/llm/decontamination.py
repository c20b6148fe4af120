"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are compared in a plain form: letters lower-cased, every run of
other ASCII characters one blank. An item of m bytes may differ from a passage by
e = floor(``rate`` * m) edits; a passage within e edits shares at least m + 1 - q - q * e of
the item's q-grams, all on diagonals (text minus item position) at most e apart. Shared
q-grams are counted in diagonal bands that overlap by e, so that one band holds all of a
passage's diagonals; bands that reach the bound are verified by an alignment limited to the
band. Where q * e leaves no q-gram, e is lowered to the largest number that leaves one. Items
of fewer than q bytes have no q-gram and no edits: they are found where they stand word for
word.

The benchmark is the query set: it goes through the documents in blocks of ``BLOCK_BYTES``
of text, each block's index small enough to send to every task. The driver holds one block at
a time; the finds of several are written block by block. Documents are scanned in place,
without a shuffle, whole.

Null texts, and items without a letter or digit, match nothing; an item of null id is left
out. Repeated rows are each judged; of several best passages of an item the first by its end
counts. A document's other columns stay in ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import as_bytes, pieces, stored, tidy
from docloom.llm.components import only
from docloom.session import work_path

Q = 8
RATE = 0.1
BLOCK_BYTES = 4 << 20
_FILTER_BITS = 20

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
for _c in (*range(48, 58), *range(97, 123)):
    _PLAIN[_c] = _c
_PLAIN[65:91] = _PLAIN[97:123]
# Small texts at a time keep the arrays in the processor's cache.
SCAN_BYTES = 1 << 17


def plain_form(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain bytes of all rows, their offsets, and which bytes of ``data`` they are.

    Capital letters of ASCII and of the first Latin supplement become small.
    """
    small = _PLAIN[data]
    lead = data[:-1] == 0xC3
    after = data[1:]
    lead &= (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    small[1:] += lead.view(np.uint8) * np.uint8(0x20)
    blank = small == 32
    keep = np.ones(len(data), bool)
    np.logical_and(blank[1:], blank[:-1], out=keep[1:])
    np.logical_not(keep[1:], out=keep[1:])
    keep[bounds[:-1][bounds[:-1] < len(data)]] = True
    places = np.zeros(len(data) + 1, np.int32)
    np.cumsum(keep, out=places[1:], dtype=np.int32)
    return small[keep], places[bounds].astype(np.int64), keep


def codes(plain: np.ndarray) -> np.ndarray:
    """Every run of eight bytes as one number."""
    if len(plain) < Q:
        return np.empty(0, np.uint64)
    out = np.empty(len(plain) - Q + 1, np.uint64)
    raw = plain.tobytes()
    for shift in range(min(Q, len(out))):
        every = np.frombuffer(raw, "<u8", (len(raw) - shift) // Q, shift)
        out[shift::Q] = every[: len(out[shift::Q])]
    return out


def _slot(code: np.ndarray) -> np.ndarray:
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)


class ItemIndex:
    """The q-grams of a block of items and where they stand."""

    def __init__(self, ids: list[int], texts: list[str], rate: float = RATE) -> None:
        data, bounds = as_bytes(pa.array(texts, pa.string()))
        plain, edges, _ = plain_form(data, bounds)
        # Blanks at either end say nothing.
        self.items = [bytes(plain[a:b]).strip() for a, b in zip(edges[:-1], edges[1:])]
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(i) for i in self.items], np.int64)
        self.budget = np.minimum((rate * self.sizes).astype(np.int64), np.maximum(self.sizes - Q, 0) // Q)
        self.least = self.sizes + 1 - Q - Q * self.budget
        self.step = 2 * (self.budget + 1)
        # Short items by length: their bytes as numbers, in order, and which items they are.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, Q):
            own = np.flatnonzero(self.sizes == size)
            if len(own):
                numbers = np.array([int.from_bytes(self.items[i], "little") for i in own], np.uint64)
                order = np.argsort(numbers, kind="stable")
                self.short[size] = numbers[order], own[order]
        grams = [codes(np.frombuffer(i, np.uint8)) for i in self.items]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(g)) for g in grams)])
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order], place[order]
        self.grams, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[_slot(self.grams)] = True

    def candidates(self, plain: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """(row, item, band) whose shared q-grams reach the bound."""
        none = np.empty((0, 3), np.int64)
        code = codes(plain)
        at = np.flatnonzero(self.filter[_slot(code)]) if len(self.grams) else none
        if not len(at):
            return none
        known = np.minimum(np.searchsorted(self.grams, code[at]), len(self.grams) - 1)
        right = self.grams[known] == code[at]
        at, known = at[right], known[right]
        row = np.searchsorted(edges, at, "right") - 1
        inside = at + Q <= edges[row + 1]
        at, known, row = at[inside], known[inside], row[inside]
        times = self.times[known]
        entry = np.repeat(self.first[known] - np.cumsum(times) + times, times) + np.arange(times.sum())
        row, at = np.repeat(row, times), np.repeat(at, times)
        item = self.item[entry]
        # Shifted by the item's size, so that diagonals are never negative.
        diagonal = at - edges[row] - self.place[entry] + self.sizes[item]
        band = diagonal // self.step[item]
        lower = (diagonal - band * self.step[item] < self.budget[item]) & (band > 0)
        place = self.place[entry]
        row, item, band, at, place = (
            np.concatenate([both, both[lower] - less])
            for both, less in ((row, 0), (item, 0), (band, 1), (at, 0), (place, 0))
        )
        # Row and item are small next to 2^63; so is a band, which is below a text's length.
        key = (row * len(self.items) + item) * (int(band.max(initial=0)) + 1) + band
        _, first, group, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        enough = count >= self.least[item[first]]
        # A q-gram of the item, or of the text, counts once however often it recurs.
        for positions in (place, at):
            some = np.flatnonzero(enough[group])
            pairs = np.unique(group[some] * (int(positions.max(initial=0)) + 1) + positions[some])
            own = np.bincount(pairs // (int(positions.max(initial=0)) + 1), minlength=len(first))
            enough &= own >= self.least[item[first]]
        first = first[enough]
        return np.stack([row[first], item[first], band[first]], axis=1)

    def matches(self, plain: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, start, end) of the best passage of each (row, item)."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, band in self.candidates(plain, edges).tolist():
            if best.get((row, item), (1,))[0] == 0:
                continue
            m, e, step = int(self.sizes[item]), int(self.budget[item]), int(self.step[item])
            first = band * step - m
            low = int(edges[row]) + max(0, first - e)
            high = min(int(edges[row + 1]), int(edges[row]) + first + step + 2 * e + m)
            found = aligned(self.items[item], plain[low:high].tobytes(), e)
            if found and found[0] < best.get((row, item), (e + 1,))[0]:
                best[row, item] = (found[0], low + found[1], low + found[2])
        if self.short:
            best |= self.short_matches(plain, edges)
        return [(row, item, *rest) for (row, item), rest in sorted(best.items())]


    def short_matches(self, plain: np.ndarray, edges: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """Where items of fewer than q bytes first stand word for word."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        padded = np.concatenate([plain, np.full(Q, 32, np.uint8)])
        opens = np.ones(len(plain), bool)
        opens[1:] = plain[:-1] == 32
        opens[edges[:-1][edges[:-1] < len(plain)]] = True
        at = np.flatnonzero(opens & (plain != 32))
        row = np.searchsorted(edges, at, "right") - 1
        number = codes(padded)[at]
        for size, (numbers, items) in self.short.items():
            end = at + size
            whole = (end == edges[row + 1]) | ((end < edges[row + 1]) & (padded[end] == 32))
            own = number[whole] & np.uint64((1 << 8 * size) - 1)
            first, last = (np.searchsorted(numbers, own, side) for side in ("left", "right"))
            hit = np.flatnonzero(last > first)
            for k, start in zip(hit.tolist(), at[whole][hit].tolist()):
                for item in items[first[k] : last[k]].tolist():
                    out.setdefault((int(row[whole][k]), item), (0, start, start + size))
        return out


def aligned(item: bytes, text: bytes, budget: int) -> tuple[int, int, int] | None:
    """Least edits between ``item`` and any part of ``text``, with the part's bounds."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    ends = _least_edits(item, text, budget)
    end = int(ends.argmin())
    if ends[end] > budget:
        return None
    back = _least_edits(item[::-1], text[:end][::-1], budget)
    size = int(np.flatnonzero(back == ends[end])[0])
    return int(ends[end]), end - size, end


def _least_edits(item: bytes, text: bytes, budget: int) -> np.ndarray:
    """For every end in ``text``, the least edits of ``item`` against a part that ends there,
    right wherever that is within ``budget``.

    Cells are kept by diagonal (text minus item position). An alignment within the budget
    stays at diagonals from -budget to len(text) - len(item) + budget; others are not filled.
    """
    m, n = len(item), len(text)
    far = m + n + 1
    ends = np.full(n + 1, far, np.int64)
    diagonal = np.arange(-budget, n - m + budget + 1)
    if not len(diagonal):
        return ends
    # No text has this byte, so nothing matches beyond its bounds.
    around = np.full(budget, 255, np.uint8)
    letters = np.concatenate([around, np.frombuffer(text, np.uint8), around])
    along = np.arange(len(diagonal))
    row = np.where((diagonal >= 0) & (diagonal <= n), 0, far)
    for at, letter in enumerate(item):
        step = row + (letters[at : at + len(diagonal)] != letter)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        step[: max(0, budget - at - 1)] = far
        row = np.minimum.accumulate(step - along) + along
    end = diagonal + m
    inside = (end >= 0) & (end <= n)
    ends[end[inside]] = row[inside]
    return ends


def item_blocks(benchmark: DataFrame, rate: float = RATE) -> Iterator[ItemIndex]:
    """Indexes over runs of items of bounded size."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    for r in rows.where("item_id is not null and text is not null").distinct().toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size >= BLOCK_BYTES:
            yield ItemIndex(ids, texts, rate)
            ids, texts, size = [], [], 0
    if ids:
        yield ItemIndex(ids, texts, rate)


_FOUND = "doc_id long, item_id long, edits long, start_byte long, end_byte long"


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, start_byte, end_byte) for every item found in a document.

    The bounds are those of the best passage, in the bytes of the original text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def scan(index: ItemIndex) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, bounds = as_bytes(batch.column("text"))
                ids, out = batch.column("doc_id"), []
                for first, last in pieces(bounds, SCAN_BYTES):
                    cut = bounds[first : last + 1]
                    plain, edges, keep = plain_form(data[cut[0] : cut[-1]], cut - cut[0])
                    hits = index.matches(plain, edges)
                    at = np.flatnonzero(keep) if hits else None
                    for row, item, edits, start, end in hits:
                        base = cut[row] - cut[0]
                        out.append(
                            (
                                ids[first + row].as_py(), int(index.ids[item]), edits,
                                int(at[start] - base), int(at[end - 1] + 1 - base) if end > start else int(at[start] - base),
                            )
                        )
                names = ["doc_id", "item_id", "edits", "start_byte", "end_byte"]
                columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(tidy(task), _FOUND)

    spark, blocks = docs.sparkSession, item_blocks(benchmark, rate)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], _FOUND)
    if following is None:
        return scan(block)
    path = work_path(spark, "leaks")
    while block is not None:
        scan(block).write.mode("append").parquet(path)
        block, following = following, next(blocks, None)
    return spark.read.schema(_FOUND).parquet(path)


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents in which an item is found; null ids stay."""
    found = leaks(docs, benchmark, rate).select("doc_id").distinct()
    return only(docs, stored(found.where("doc_id is not null"), "leaks"), "left_anti")
