"""Byte-level BPE encoding by a priority queue of merge ranks, and decoding.

A text is cut at added tokens and then into units by the pre-tokeniser's pattern. The bytes
of a unit form a doubly linked list of symbols. A queue holds (rank, position) of every
neighbouring pair that the merge table knows; the smallest is taken, an entry whose pair has
changed since is stale and skipped, and a merge links the right symbol out and queues the two
pairs it has made. Decoding concatenates the vocabulary's byte strings and reads them as
UTF-8, broken sequences as U+FFFD.

Ids equal those of the tokenizers library for the same file (truncation and padding unused,
special tokens recognised in the text). Files with settings this module does not know are
refused, not guessed at. Characters whose class the pattern's engine sees otherwise than the
library does (another Unicode version) take the library's class.

Every distinct unit is merged once per task; a unit costs n log n, so a text that is one
unit of a megabyte stays cheap. Null texts count as empty: no ids, an empty decoded text.
Equal rows stay equal rows, empty tables give none. One document is one row; its other
columns stay, and a frame that already has ``ids`` or ``decoded`` is refused by name.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

OUTPUTS = ("ids", "decoded")
CACHE_UNITS = 400_000
# Longer units are merged each time they occur.
CACHE_CHARS = 64
PART_CHARS = 1 << 20

# The pattern that the files' pre-tokeniser has built in.
_UNITS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# One character of each class, known by which of "a", "1" and "!" it shares a unit with.
_STAND_INS = {(1, 0, 0): "é", (0, 1, 0): "1", (0, 0, 1): "!", (0, 0, 0): "\t"}
# What this module can follow; anything else in these places is refused.
_KNOWN_MODEL = {
    "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
    "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False,
}


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte: printable ones themselves, the others
    numbered from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _supported(spec: dict) -> None:
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    # A setting that is false or missing counts the same as null.
    odd = [k for k, v in _KNOWN_MODEL.items() if (model.get(k) or None) != (v or None)]
    if spec["normalizer"] is not None:
        odd.append("normalizer")
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        odd.append("pre_tokenizer")
    if (spec["decoder"] or {}).get("type") != "ByteLevel":
        odd.append("decoder")
    for token in spec["added_tokens"]:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            odd.append(token["content"])
    if odd:
        raise ValueError(f"settings this tokenizer file needs are not supported: {odd}")


class ByteBpe(dict):
    """Ids of whole texts. The dictionary maps units of text to packed 32-bit ids."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _supported(spec)
        self.classes = Tokenizer.from_file(path).pre_tokenizer
        letters = byte_letters()

        def raw(token: str) -> bytes:
            known = [letters.get(c) for c in token]
            return token.encode() if None in known else bytes(known)

        vocabulary = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: raw(t) for t, i in (vocabulary | added).items()}
        self.byte_ids = [vocabulary.get(c) for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        if None in self.byte_ids:
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(vocabulary[a], vocabulary[b]): n for n, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        longest_first = sorted(added, key=len, reverse=True)
        self.added = added
        self.added_at = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.checked: set[str] = set()
        self.odd: dict[int, str] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one unit."""
        ranks, made, end = self.ranks, self.made, len(raw)
        ids = [self.byte_ids[b] for b in raw]
        left, right = list(range(-1, end - 1)), list(range(1, end + 1))
        queue = []
        for at in range(end - 1):
            rank = ranks.get((ids[at], ids[at + 1]))
            if rank is not None:
                queue.append((rank, at))
        heapq.heapify(queue)
        while queue:
            rank, at = heapq.heappop(queue)
            other = right[at]
            # Stale: a symbol of the pair is gone or has grown since.
            if other >= end or ranks.get((ids[at], ids[other])) != rank:
                continue
            ids[at], ids[other] = made[rank], -1
            right[at] = following = right[other]
            if following < end:
                left[following] = at
                rank = ranks.get((ids[at], ids[following]))
                if rank is not None:
                    heapq.heappush(queue, (rank, at))
            before = left[at]
            if before >= 0:
                rank = ranks.get((ids[before], ids[at]))
                if rank is not None:
                    heapq.heappush(queue, (rank, before))
        return [i for i in ids if i >= 0]

    def __missing__(self, unit: str) -> bytes:
        found = np.array(self.merged(unit.encode()), np.int32).tobytes()
        if len(unit) <= CACHE_CHARS:
            self[unit] = found
        return found

    def _compare(self, characters: Iterable[str]) -> None:
        """Note the characters that the pattern's engine puts into another class."""
        for c in characters:
            shares = tuple(int(len(self.classes.pre_tokenize_str(p + c)) == 1) for p in "a1!")
            ours = tuple(int(len(_UNITS.findall(p + c)) == 1) for p in "a1!")
            if shares != ours:
                self.odd[ord(c)] = _STAND_INS[shares]
            self.checked.add(c)

    def units(self, text: str) -> list[str]:
        if text.isascii():
            return _UNITS.findall(text)
        fresh = set(text).difference(self.checked)
        if fresh:
            self._compare(c for c in fresh if c > "\x7f")
        shape = text.translate(self.odd) if self.odd else text
        if shape == text:
            return _UNITS.findall(text)
        return [text[m.start() : m.end()] for m in _UNITS.finditer(shape)]

    def ids(self, text: str) -> np.ndarray:
        if len(self) > CACHE_UNITS:
            self.clear()
        parts = self.added_at.split(text) if self.added_at else [text]
        packed = []
        for n, part in enumerate(parts):
            if n % 2:
                packed.append(np.int32(self.added[part]).tobytes())
            elif part:
                packed += map(self.__getitem__, self.units(part))
        return np.frombuffer(b"".join(packed), np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBpe:
    """One coder per file and worker."""
    return ByteBpe(path)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))


def encode(docs: DataFrame, path: str, decoded: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and, where asked for, the text decoded from them. Narrow."""
    fresh = OUTPUTS if decoded else OUTPUTS[:1]
    clash = set(fresh) & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = T.StructType(list(docs.schema.fields))
    schema.add("ids", T.ArrayType(T.IntegerType()))
    if decoded:
        schema.add("decoded", T.StringType())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)

        def made(rows: pa.RecordBatch, parts: list[np.ndarray]) -> pa.RecordBatch:
            columns = [*rows.columns, _lists(parts)]
            if decoded:
                columns.append(pa.array([known.decode(p.tolist()) for p in parts], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            done, first, size = [], 0, 0
            for row, value in enumerate(batch.column(text)):
                own = value.as_py() or ""
                done.append(known.ids(own))
                size += len(own)
                if size >= PART_CHARS:
                    yield made(batch.slice(first, row + 1 - first), done)
                    done, first, size = [], row + 1, 0
            if done:
                yield made(batch.slice(first), done)

    return docs.mapInArrow(task, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the text of their ids as ``decoded``; null ids give an empty text."""
    if "decoded" in rows.columns:
        raise ValueError("columns in the way: ['decoded']")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(path)
        for batch in batches:
            texts = [known.decode(v.as_py() or ()) for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=schema.names
            )

    return rows.mapInArrow(task, schema)
