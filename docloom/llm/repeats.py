"""Removal of repeated passages: bytes covered by a string of ``length`` bytes that also
starts anywhere else, in the same document or another.

1. Every window of ``length`` bytes is led by one anchor: the position in it whose 32-byte
   hash is least (the leftmost of equals). Equal windows have equal anchors at equal
   offsets, so equal windows can only meet among anchors of one hash. A run of windows with
   one anchor is a neighbourhood, a string of ``length`` bytes and more.
2. Equal neighbourhoods are counted before anything is moved: two of them repeat all their
   windows. Only one of each is looked at further, and only where an anchor's hash has
   different neighbourhoods.
3. These are grouped by anchor, large groups as pairs of blocks of bounded size. Each
   neighbourhood is cut to what its longest common left and right contexts allow. A string
   that lies whole in another one, at the same place about the anchor, is repeated there and
   needs no sorting; the suffixes of the others are sorted by Lyndon-prefix groups, and
   neighbours in the suffix array that agree for ``length`` bytes are repeated windows.
4. The windows' bytes are united per document and removed. The few neighbourhoods with very
   many occurrences, at most ``MOST_HOT`` by their share of all, are known to every task, so
   no join sees them; all others meet their occurrences in a join of small keys.

A document is one row and its text is handled whole. A null text is empty; texts shorter
than ``length`` keep everything. Rows are told apart by id and text, so repeated rows are
copies of each other; rows with a null id are judged and cut like all others. Bytes are compared by 64-bit hashes.
Columns with the names in ``TAKEN`` are in the way: ``remove`` refuses them, ``removed`` reads
id and text only.

The same job runs over words: ``length`` is then a number of words, a text is the array of
its words' 64-bit hashes, and runs found are mapped to the bytes from the first word's start
to the last one's end, whatever white space is between. ``remove`` can cut both kinds,
``removed`` cuts the first and reports the second beside it. What is left of a text may end
within a character; ``remove`` cuts at characters instead and says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import (
    as_bytes,
    pieces,
    rolling_hashes,
    shuffles_removed,
    span_hashes,
    stored,
    tidy,
    words,
)
from docloom.llm.components import only
from docloom.llm.near_copies import in_block_pairs
from docloom.llm.suffixes import suffix_array
from docloom.session import delete_path, work_path

LENGTH = 400
BLOCK = 1024
# Neighbourhoods that occur more often than this, and in more than one of MOST_HOT rows.
HOT = 1000
MOST_HOT = 1000
# More places than a text can have bytes.
_PLACE_BITS = 32
# Small texts at a time keep the arrays in the processor's cache.
SCAN_BYTES = 1 << 16
# A null id is 0 with a flag: keys are never null, so that they join.
KEYS = ["_id", "_no_id", "_text_hash"]
TAKEN = {*KEYS, "spans", "word_spans"}


class Unit(NamedTuple):
    """What windows are made of: its number type, and the units of an anchor."""

    kind: type
    anchor: int

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The units of all rows, and the n + 1 offsets."""
        if self.kind is np.uint8:
            return data, bounds
        starts, ends, counts = words(data, bounds)
        return span_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(counts)])


BYTES = Unit(np.uint8, 32)
WORDS = Unit(np.uint64, 6)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def neighbourhoods(data: np.ndarray, bounds: np.ndarray, length: int, anchor: int) -> list[np.ndarray]:
    """Of all rows: row, first window, windows, offset of the anchor in the first window,
    anchor hash, hash of the whole string."""
    none = [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    total = len(data)
    if total < length:
        return none
    hashes = rolling_hashes(data, anchor)
    place = np.uint64((1 << _PLACE_BITS) - 1)
    ordered = hashes & ~place
    ordered |= np.arange(len(hashes), dtype=np.uint64)
    leaders = (_least(ordered, length - anchor + 1) & place).astype(np.int64)
    sizes = np.diff(bounds)
    inside = np.zeros(len(leaders), bool)
    for row in np.flatnonzero(sizes >= length).tolist():
        inside[bounds[row] : bounds[row + 1] - length + 1] = True
    starts = np.flatnonzero(inside)
    row, leaders = np.repeat(np.arange(len(sizes)), sizes)[starts], leaders[starts]
    if not len(starts):
        return none
    new = np.flatnonzero(np.concatenate([[True], (leaders[1:] != leaders[:-1]) | (row[1:] != row[:-1])]))
    first, last = starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]
    whole = span_hashes(data, first, last + length)
    return [
        row[new], first - bounds[row[new]], last - first + 1, leaders[new] - first,
        hashes[leaders[new]], whole,
    ]


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    own = F.col("doc_id").cast("long")
    return docs.withColumns(
        {"_id": F.coalesce(own, F.lit(0).cast("long")), "_no_id": own.isNull(), "_text_hash": F.xxhash64(text)}
    )


def anchor_table(keyed: DataFrame, length: int, unit: Unit) -> DataFrame:
    """One row per neighbourhood: anchor, whole, row keys, first window, windows, offset."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = as_bytes(batch.column("text"))
            ids = [batch.column(k) for k in KEYS]
            for first, last in pieces(bounds, SCAN_BYTES):
                cut = bounds[first : last + 1]
                own, edges = unit.of(data[cut[0] : cut[-1]], cut - cut[0])
                row, start, runs, offset, anchor, whole = neighbourhoods(own, edges, length, unit.anchor)
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)),
                        *(k.take(at) for k in ids), pa.array(start.astype(np.int32)),
                        pa.array(runs.astype(np.int32)), pa.array(offset.astype(np.int32)),
                    ],
                    names=["anchor", "whole", *KEYS, "start", "runs", "offset"],
                )

    schema = "anchor long, whole long, _id long, _no_id boolean, _text_hash long, start int, runs int, offset int"
    return keyed.select(*KEYS, "text").mapInArrow(tidy(task), schema)


def cut_strings(wanted: DataFrame, length: int, unit: Unit) -> DataFrame:
    """The neighbourhoods' units as bytes: (anchor, whole, offset, string)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, asked in zip(batch.column("text"), batch.column("asked")):
                raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                own, _ = unit.of(raw, np.array([0, len(raw)]))
                for a in asked.as_py():
                    string = own[a["start"] : a["start"] + a["runs"] + length - 1].tobytes()
                    out.append((a["anchor"], a["whole"], a["offset"], string))
                if len(out) > 2000:
                    yield made(out)
                    out = []
            if out:
                yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "id", "offset", "string"])

    return wanted.select("text", "asked").mapInArrow(tidy(task), "anchor long, id long, offset int, string binary")


def _longest_shared(strings: list[bytes]) -> np.ndarray:
    """For each string, the longest prefix it shares with any other."""
    sizes = np.array([len(s) for s in strings])
    order = sorted(range(len(strings)), key=strings.__getitem__)
    width = int(sizes.max(initial=0)) + 1
    padded = np.zeros((len(strings), width), np.uint8)
    for i, at in enumerate(order):
        padded[i, : sizes[at]] = np.frombuffer(strings[at], np.uint8)
    differs = padded[1:] != padded[:-1]
    differs[:, -1] = True
    shared = np.minimum(differs.argmax(axis=1), np.minimum(sizes[order][1:], sizes[order][:-1]))
    best = np.zeros(len(strings), np.int64)
    np.maximum.at(best, np.array(order[1:], int), shared)
    np.maximum.at(best, np.array(order[:-1], int), shared)
    return best


def repeated_windows(strings: list[bytes], offsets: list[int], length: int, unit: Unit) -> list[np.ndarray]:
    """For neighbourhoods of one anchor, all different: a flag per window, repeated or not."""
    wide = unit.width
    flags = [np.zeros(len(s) // wide - length + 1, bool) for s in strings]
    left = _longest_shared([s[: o * wide][::-1] for s, o in zip(strings, offsets)]) // wide
    right = _longest_shared([s[o * wide :] for s, o in zip(strings, offsets)]) // wide
    cuts: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    for i, (s, o) in enumerate(zip(strings, offsets)):
        first, last = o - int(left[i]), o + int(right[i])
        if last - first >= length:
            cuts.setdefault((s[first * wide : last * wide], o - first), []).append((i, first))
    texts = sorted(cuts, key=lambda c: (-len(c[0]), c))
    found = [np.full(len(s) // wide - length + 1, len(cuts[s, o]) > 1) for s, o in texts]
    whole = []
    for k, (s, o) in enumerate(texts):
        for m in whole:
            t, p = texts[m]
            at = (p - o) * wide
            if at >= 0 and t.startswith(s, at):
                found[k][:] = True
                found[m][p - o : p - o + len(found[k])] = True
                break
        else:
            whole.append(k)
    if len(whole) > 1:
        for k, hit in zip(whole, _sorted_hits([np.frombuffer(texts[k][0], unit.kind) for k in whole], length)):
            found[k] |= hit
    for k, text in enumerate(texts):
        for i, first in cuts[text]:
            flags[i][first : first + len(found[k])] |= found[k]
    return flags


def _sorted_hits(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """A flag per window of each text: neighbours in the suffix array that agree in it."""
    base = np.cumsum([0] + [len(s) + 1 for s in texts])
    raw = np.zeros(base[-1], texts[0].dtype)
    for at, s in zip(base, texts):
        raw[at : at + len(s)] = s
    known, joined = np.unique(raw, return_inverse=True)
    joined[base[1:] - 1] = len(known)
    order = np.array(suffix_array(joined.tolist()))
    room = np.concatenate([np.arange(len(s), -1, -1) for s in texts])
    order = order[room[order] >= length]
    windows = span_hashes(raw, order, order + length)
    same = windows[1:] == windows[:-1]
    hit = np.zeros(len(raw), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [hit[at : at + len(s) - length + 1] for at, s in zip(base, texts)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_spans(keyed: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """(KEYS, spans): the repeated ranges of rows that have any, in units, not united. They are
    stored; what the search for them wrote and shuffled is deleted."""
    spark = keyed.sparkSession
    path = work_path(spark, "search")
    with shuffles_removed(spark):
        spans = stored(_searched(keyed, length, unit, path.rpartition("/")[2]), "repeats")
    delete_path(spark, path)
    return spans


def _searched(keyed: DataFrame, length: int, unit: Unit, place: str) -> DataFrame:
    anchors = stored(anchor_table(keyed, length, unit), f"{place}/anchors")
    kinds = anchors.groupBy("anchor", "whole").agg(
        F.count("runs").alias("times"), F.min(F.struct(*KEYS, "start", "runs", "offset")).alias("one")
    )
    kinds = stored(kinds, f"{place}/neighbourhoods")
    several = kinds.groupBy("anchor").agg(F.count("whole").alias("n_members")).where("n_members > 1")
    asked = kinds.join(several.select("anchor"), "anchor", "left_semi").select(
        *(F.col(f"one.{k}").alias(k) for k in KEYS),
        F.struct("anchor", "whole", "one.start", "one.runs", "one.offset").alias("asked"),
    )
    asked = stored(asked.groupBy(*KEYS).agg(F.collect_list("asked").alias("asked")), f"{place}/asked")
    near = only(keyed.select(*KEYS, "text"), asked.select(*KEYS), "left_semi", KEYS)
    strings = cut_strings(near.dropDuplicates(KEYS).join(asked, KEYS), length, unit)
    paired = in_block_pairs(strings, several, "anchor", BLOCK)
    by = ["anchor", "i", "j"]
    # Sorted, the groups of a task follow each other: thousands of small ones go in one batch.
    dealt = paired.select(*by, "id", "offset", "string").repartition(*by).sortWithinPartitions(*by)
    shared = dealt.mapInArrow(
        tidy(lambda batches: _group_runs(batches, length, unit)), "anchor long, whole long, low long, high long"
    )
    shared = shared.groupBy("anchor", "whole").agg(F.collect_set(F.struct("low", "high")).alias("runs_found"))
    full = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("one.runs").cast("long").alias("high")))
    known = kinds.join(shared, ["anchor", "whole"], "left").select(
        "anchor", "whole", "times", F.when(F.col("times") > 1, full).otherwise(F.col("runs_found")).alias("found")
    )
    least = max(HOT, anchors.count() // MOST_HOT)
    # Fewer than MOST_HOT keys can have so large a share.
    hot = [r["whole"] for r in kinds.where(F.col("times") > least).select("whole").collect()]
    often = F.col("whole").isin(hot) if hot else F.lit(False)
    known = known.where(F.col("found").isNotNull() & ~often).drop("times")
    seldom = anchors.where(~often).join(known, ["anchor", "whole"])
    spans = F.transform(
        "found",
        lambda f: F.struct(
            (F.col("start") + f["low"]).alias("low"), (F.col("start") + f["high"] + length - 1).alias("high")
        ),
    )
    whole = F.array(
        F.struct(
            F.col("start").cast("long").alias("low"),
            (F.col("start") + F.col("runs").cast("long") + length - 1).alias("high"),
        )
    )
    hits = seldom.select(*KEYS, spans.alias("spans")).unionByName(
        anchors.where(often).select(*KEYS, whole.alias("spans"))
    )
    return hits.groupBy(*KEYS).agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _group_runs(batches: Iterator[pa.RecordBatch], length: int, unit: Unit) -> Iterator[pa.RecordBatch]:
    """(anchor, whole, low, high) of the repeated runs in sorted groups (anchor, i, j)."""
    held, group, out = [], None, []

    def close() -> None:
        if len(held) > 1:
            names, offsets, strings = zip(*held)
            flags = repeated_windows(list(strings), list(offsets), length, unit)
            for name, own in zip(names, flags):
                out.extend((group[0], name, a, b) for a, b in _runs(own))
        held.clear()

    def made() -> pa.RecordBatch:
        columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(4)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "whole", "low", "high"])

    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("anchor", "i", "j", "id", "offset", "string")))
        for *key, name, offset, string in rows:
            if key != group:
                close()
                group = key
            held.append((name, offset, string))
        if len(out) > 10_000:
            yield made()
    close()
    yield made()


def united(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Overlapping and touching ranges as maximal ones."""
    out: list[list[int]] = []
    for low, high in sorted((s["low"], min(s["high"], size)) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def word_ranges(raw: bytes, spans: list[dict] | None) -> list[dict]:
    """Ranges of words as ranges of bytes."""
    if not spans:
        return []
    starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [{"low": int(starts[a]), "high": int(ends[b - 1])} for a, b in united(spans, len(starts))]


def _with_spans(docs: DataFrame, length: int, n_words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` with keys, ``spans`` and ``word_spans``: rows with repeats, and those without,
    which never leave their place."""
    keyed = _keyed(docs)
    spans = repeated_spans(keyed, length)
    if n_words is None:
        spans = spans.withColumn("word_spans", F.lit(None).cast(spans.schema["spans"].dataType))
    else:
        longer = repeated_spans(keyed, n_words, WORDS)
        spans = spans.join(longer.withColumnRenamed("spans", "word_spans"), KEYS, "full")
        spans = stored(spans, "repeats")
    keys = spans.select(*KEYS)
    touched = only(keyed, keys, "left_semi", KEYS).join(spans, KEYS)
    none = F.lit(None).cast(touched.schema["spans"].dataType)
    rest = only(keyed, keys, "left_anti", KEYS).withColumns({"spans": none, "word_spans": none})
    return touched, rest


def removed(docs: DataFrame, length: int = LENGTH, n_words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, text, word_spans): what is removed, the bytes
    that stay, and these as a text, with U+FFFD where a cut has left part of a character.

    ``word_spans`` are, with ``n_words``, the ranges of bytes of passages of so many words and
    more that stand elsewhere too. Nothing is removed for them; without ``n_words`` there are
    none.
    """
    ranged = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, kept, by_word = [], [], [], [], []
            for text, spans, longer in zip(*(batch.column(c) for c in ("text", "spans", "word_spans"))):
                raw = (text.as_py() or "").encode()
                ranges = united(spans.as_py(), len(raw))
                edges = [0, *(e for r in ranges for e in r), len(raw)]
                sizes.append(len(raw))
                gone.append(sum(b - a for a, b in ranges))
                runs.append([{"low": a, "high": b} for a, b in ranges])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                by_word.append(word_ranges(raw, longer.as_py()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(runs, ranged),
                    pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "replace") for k in kept]),
                    pa.array(by_word, ranged),
                ],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "text", "word_spans"],
            )

    schema = (
        "doc_id long, n_bytes long, n_removed long, spans array<struct<low:long,high:long>>, "
        "kept binary, text string, word_spans array<struct<low:long,high:long>>"
    )
    touched, rest = _with_spans(docs.select("doc_id", "text"), length, n_words)
    own = F.when(~F.col("_no_id"), F.col("_id"))
    cut = touched.select(own.alias("_id"), "text", "spans", "word_spans").mapInArrow(tidy(task), schema)
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast(cut.schema["spans"].dataType)
    whole = rest.select(
        own.alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), none.alias("spans"), text.cast("binary").alias("kept"),
        text.alias("text"), none.alias("word_spans"),
    )
    return cut.unionByName(whole)


def remove(docs: DataFrame, length: int = LENGTH, n_words: int | None = None) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``: those of ``length`` bytes and
    more, and with ``n_words`` also those of so many words and more.

    A character that is only partly covered stays. Columns and other values stay as they are,
    a null text too; ``n_chars``, where there is one, counts the new text.
    """
    columns, schema = docs.columns, docs.schema
    if clash := TAKEN & set(columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, *spans in zip(*(batch.column(c) for c in ("text", "spans", "word_spans"))):
                own, (spans, by_word) = text.as_py(), [s.as_py() for s in spans]
                if own is None or not (spans or by_word):
                    texts.append(own)
                    continue
                raw, parts, at = own.encode(), [], 0
                for low, high in united([*(spans or ()), *word_ranges(raw, by_word)], len(raw)):
                    while low < high and raw[low] & 0xC0 == 0x80:
                        low += 1
                    while high > low and high < len(raw) and raw[high] & 0xC0 == 0x80:
                        high -= 1
                    parts.append(raw[at:low])
                    at = high
                texts.append(b"".join([*parts, raw[at:]]).decode())
            own = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(own, names=columns)

    touched, rest = _with_spans(docs, length, n_words)
    rows = touched.unionByName(rest).select(*columns, "spans", "word_spans")
    left = rows.mapInArrow(tidy(task), schema)
    if "n_chars" in columns:
        left = left.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return left.select(*columns)
