"""Token-id files, entropy-coded with a static range asymmetric numeral system.

Layout of a file set (a folder of Parquet tables, so any store Spark reads will do):

* ``frequencies``: symbol, slots. One shared table for all blocks; slots sum to 2^20.
* ``segments``: runs of whole documents in ascending id order, about ``SEGMENT`` tokens each:
  ``part`` and ``seq`` give the order, ``first`` the tokens of the part before it, ``doc_ids``
  and ``lengths`` the documents, ``payload`` the blocks end to end and ``blocks`` one
  checkpoint each: first token, tokens, byte offset, crc32 of the ids.
* ``parts``: tokens before each part.

A block holds up to ``BLOCK`` tokens of its segment, coded by ``LANES`` interleaved coders:
their 64-bit states first, then one stream of 32-bit words in the order a decoder asks for
them. Blocks depend on nothing but the frequency table, so readers decode any of them, all
of a segment at once as arrays, and check each against its crc32.

Tokenising: the tokenizers library encodes each distinct unit of a task once. Texts are cut
at blanks and line breaks, which no token of a tokenizer spans that drops white space and
lowers case as ``_PLAIN_SPEC`` says; with any other file whole texts go to the library. A null
text is empty. Null ids come first; equal ids stay side by side in no defined order. Only id
and text are read, so other columns may have any names.
"""

from __future__ import annotations

import json
import re
import string
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.base import pieces, stored

SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 64
BLOCK = 1 << 16
SEGMENT = 1 << 20
CACHE_UNITS = 600_000
# Texts that are cut to units at once.
TEXT_BYTES = 16 << 20

_SEGMENTS = (
    "part int, seq long, first long, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "payload binary, blocks array<struct<first:long,tokens:long,offset:long,crc32:long>>"
)


# --- tokenising -------------------------------------------------------------------------


# The pattern of the tokenizers' own pre-tokeniser, for text of ASCII characters only. White
# space is what the library takes for it; Python's would add U+001C to U+001F.
_ASCII_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# The parts of a tokenizer file that make units independent.
_PLAIN_SPEC = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"},
            {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
            {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


# Letters below U+0180 that lower-casing leaves single, and units of them with marks behind.
_LETTERS = string.ascii_letters + "".join(c for c in map(chr, range(128, 0x180)) if c.isalpha() and c != "İ")
_LETTERS_MARKS = f"^[{_LETTERS}]+[!-/:-@\\[-`{{-~]*$"


def _laid(table: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The entries of ``table``, which holds runs of these ``sizes`` end to end, in the order of ``codes``."""
    own = sizes[codes]
    places = np.repeat((np.cumsum(sizes) - sizes)[codes] - (np.cumsum(own) - own), own)
    places += np.arange(len(places))
    return table[places]


class WordTokenizer(dict):
    """Ids of whole texts from a tokenizer that drops blanks and lowers case.

    The dictionary maps units of text to packed ids. ASCII units and runs of Latin letters
    skip the library's normaliser and pattern, which would leave them lower-case words:
    these go straight to the library's merge model. All else is encoded by the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        marked = all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self.by_unit = marked and spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in _PLAIN_SPEC.items())
        self.older: dict[str, bytes] = {}
        # Printable bytes stand for themselves, the others are numbered from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def merged(self, word: str) -> bytes:
        shown = word if word.isalpha() and word.isascii() else "".join(map(self.letters.get, word.encode()))
        return array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()

    @staticmethod
    def latin(word: str) -> bool:
        plain = word.isalpha() and max(word) < "ƀ" and "İ" not in word
        return plain and unicodedata.is_normalized("NFC", word)

    def __missing__(self, unit: str) -> bytes:
        found = self.older.get(unit)
        if found is None:
            found = self.encoded(unit)
        self[unit] = found
        return found

    def encoded(self, unit: str) -> bytes:
        core = unit.rstrip(string.punctuation)
        if "<|" not in unit:
            if core and (core.isalpha() if core.isascii() else self.latin(core)):
                # A run of letters and a run of marks: most units, and no pattern is needed.
                small, tail = core.lower(), unit[len(core) :]
                if small == unit:
                    return self.merged(unit)
                return self[small] + self[tail] if tail else self[small]
            if unit.isascii():
                found = _ASCII_WORDS.findall(unit.lower())
                return self.merged(unit) if found == [unit] else b"".join(map(self.__getitem__, found))
        return np.array(self.library.encode(unit, add_special_tokens=False).ids, np.uint32).tobytes()

    def room(self) -> None:
        if len(self) > CACHE_UNITS:
            # Units in use come back from the older half as they are met.
            self.older = dict(self)
            self.clear()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_unit:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        self.room()
        if text.isascii() and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


    def ids_of_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls), each with ``end`` behind it, and how many each has.

        Texts are cut to units, and equal units found, for all texts at once; only distinct
        units are looked up.
        """
        if not self.by_unit:
            packed = [self.ids(text) + end for text in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), "<u4"), np.array([len(p) // 4 for p in packed], np.int64)
        self.room()
        plain = pc.and_not(pc.string_is_ascii(texts), pc.match_substring(texts, "<|"))
        texts = pc.replace_substring(pc.if_else(plain, pc.ascii_lower(texts), texts), "\n", " ")
        units = pc.split_pattern(texts, " ")
        coded = units.flatten().dictionary_encode()
        distinct = coded.dictionary
        # A run of letters and a run of marks are looked up apart: the words behind them are fewer.
        apart = pc.and_not(pc.match_substring_regex(distinct, _LETTERS_MARKS), pc.match_substring(distinct, "<|"))
        two = distinct.filter(apart)
        cores = pc.utf8_lower(pc.ascii_rtrim(two, characters=string.punctuation)).dictionary_encode()
        tails = pc.utf8_ltrim(two, characters=_LETTERS).dictionary_encode()
        whole = distinct.filter(pc.invert(apart))
        parts = [self[u] for keys in (cores.dictionary, tails.dictionary, whole) for u in keys.to_pylist()]
        n_cores, n_tails = len(cores.dictionary), len(tails.dictionary)
        parts += [b"", end]
        at = apart.to_numpy(zero_copy_only=False)
        of = np.full((len(distinct) + 1, 2), len(parts) - 2)
        of[-1, 0] = len(parts) - 1
        of[:-1][at, 0] = cores.indices.to_numpy(zero_copy_only=False)
        of[:-1][at, 1] = tails.indices.to_numpy(zero_copy_only=False) + n_cores
        of[:-1][~at, 0] = n_cores + n_tails + np.arange(len(whole))
        sizes = np.array([len(p) // 4 for p in parts], np.int64)
        table = _laid(np.frombuffer(b"".join(parts), "<u4"), sizes, of.reshape(-1))
        sizes = sizes[of].sum(axis=1)
        ends = np.cumsum(pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64))
        codes = np.insert(coded.indices.to_numpy(zero_copy_only=False), ends, len(distinct))
        return _laid(table, sizes, codes), np.diff(np.cumsum(sizes[codes])[ends + np.arange(len(ends))], prepend=0)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, end: int | None) -> DataFrame:
    """(doc_id, n_tokens, ids): packed ids of every text, ``end`` appended."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = tokenizer(path), b"" if end is None else np.uint32(end).tobytes()
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            bounds = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)])
            for first, stop in pieces(bounds, TEXT_BYTES):
                ids, counts = known.ids_of_all(texts.slice(first, stop - first), last)
                # Byte planes: the upper bytes of ids say little and pack well.
                planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
                ends = np.cumsum(counts)
                packed = [press.compress(planes[:, e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, stop - first), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_tokens", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids binary")


@lru_cache(maxsize=1)
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _unpacked(value: pa.Scalar, n: int) -> np.ndarray:
    planes = _decompressor().decompress(value.as_py(), max_output_size=max(4 * n, 1))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def token_counts(tokens: DataFrame) -> DataFrame:
    """(symbol, n) over all ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        def add(held: list[np.ndarray]) -> None:
            nonlocal total
            own = np.bincount(np.concatenate(held)) if held else total[:0]
            if len(own) > len(total):
                total = np.pad(total, (0, len(own) - len(total)))
            total[: len(own)] += own
            held.clear()

        for batch in batches:
            # Many texts at a time: a count per text would be as long as the vocabulary.
            held, size = [], 0
            for value, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist()):
                held.append(_unpacked(value, n))
                size += n
                if size > SEGMENT:
                    add(held)
                    size = 0
            add(held)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["symbol", "n"])

    counted = tokens.mapInArrow(task, "symbol long, n long")
    return counted.groupBy("symbol").agg(F.sum("n").alias("n"))


# --- the coder --------------------------------------------------------------------------


class Frequencies:
    """Slots of each symbol out of 2^20; symbols that never occur have none."""

    def __init__(self, symbols: np.ndarray, slots: np.ndarray) -> None:
        size = int(symbols.max()) + 1 if len(symbols) else 0
        self.slots, self.starts = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        order = np.argsort(symbols)
        symbols, slots = symbols[order], slots[order].astype(np.uint64)
        self.slots[symbols] = slots
        self.starts[symbols] = np.cumsum(slots) - slots
        self.symbol_at = np.repeat(symbols, slots.astype(np.int64)).astype(np.uint32)

    @classmethod
    def of_counts(cls, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots in proportion to the counts, one at least."""
        whole = 1 << SCALE
        if len(symbols) > whole:
            raise ValueError(f"more than {whole} symbols")
        slots = np.maximum(1, np.round(counts / max(counts.sum(), 1) * whole)).astype(np.int64)
        order = np.argsort(-slots, kind="stable")
        while len(slots) and (extra := int(slots.sum()) - whole):
            for at in order:
                step = min(extra, int(slots[at]) - 1) if extra > 0 else extra
                slots[at] -= step
                extra -= step
                if not extra:
                    break
        return symbols, slots


def encode_blocks(ids: np.ndarray, table: Frequencies) -> list[bytes]:
    """One coded block for each row of ``ids`` (blocks x steps x lanes)."""
    blocks, steps, lanes = ids.shape
    state = np.full((blocks, lanes), LOW, np.uint64)
    spilled = np.zeros((blocks, steps, lanes), bool)
    words = np.zeros((blocks, steps, lanes), np.uint32)
    for step in range(steps - 1, -1, -1):
        own = ids[:, step]
        slots = table.slots[own]
        full = state >= slots << np.uint64(63 - SCALE)
        spilled[:, step] = full
        words[:, step] = state.astype(np.uint32)
        state = np.where(full, state >> np.uint64(32), state)
        whole = state // slots
        state = (whole << np.uint64(SCALE)) + (state - whole * slots) + table.starts[own]
    return [s.astype("<u8").tobytes() + w[m].astype("<u4").tobytes() for s, w, m in zip(state, words, spilled)]


def decode_blocks(coded: list[bytes], steps: int, table: Frequencies, lanes: int = LANES) -> np.ndarray:
    """The ids (blocks x steps x lanes) of blocks of the same number of steps."""
    state = np.array([np.frombuffer(c, "<u8", lanes) for c in coded], np.uint64)
    words = np.concatenate([np.frombuffer(c, "<u4", offset=8 * lanes) for c in coded] + [np.zeros(1, np.uint32)])
    sizes = [(len(c) - 8 * lanes) // 4 for c in coded]
    read = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    out = np.empty((len(coded), steps, lanes), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for step in range(steps):
        slot = state & mask
        own = out[:, step] = table.symbol_at[slot]
        state = table.slots[own] * (state >> np.uint64(SCALE)) + slot - table.starts[own]
        short = state < LOW
        at = read[:, None] + np.cumsum(short, axis=1) - 1
        word = words[np.minimum(at, len(words) - 1)].astype(np.uint64)
        state = np.where(short, state << np.uint64(32) | word, state)
        read += short.sum(axis=1)
    return out


def encode_segment(ids: np.ndarray, table: Frequencies) -> tuple[bytes, list[dict]]:
    """Payload and checkpoints of one run of ids."""
    whole = len(ids) // BLOCK
    coded = encode_blocks(ids[: whole * BLOCK].reshape(whole, -1, LANES), table) if whole else []
    rest = ids[whole * BLOCK :]
    if len(rest):
        padded = np.concatenate([rest, np.repeat(rest[-1:], -len(rest) % LANES)])
        coded += encode_blocks(padded.reshape(1, -1, LANES), table)
    marks, offset = [], 0
    for i, block in enumerate(coded):
        own = ids[i * BLOCK : (i + 1) * BLOCK]
        crc = zlib.crc32(own.astype("<u4").tobytes())
        marks.append({"first": i * BLOCK, "tokens": len(own), "offset": offset, "crc32": crc})
        offset += len(block)
    return b"".join(coded), marks


def decode_segment(payload: bytes, marks: list[dict], table: Frequencies) -> np.ndarray:
    """All ids of a segment; raises where a block does not match its crc32."""
    ends = [m["offset"] for m in marks[1:]] + [len(payload)]
    coded = [payload[m["offset"] : e] for m, e in zip(marks, ends)]
    full = [i for i, m in enumerate(marks) if m["tokens"] == BLOCK]
    parts = {i: None for i in range(len(marks))}
    if full:
        for i, ids in zip(full, decode_blocks([coded[i] for i in full], BLOCK // LANES, table)):
            parts[i] = ids.reshape(-1)
    for i, m in enumerate(marks):
        if parts[i] is None:
            ids = decode_blocks([coded[i]], -(-m["tokens"] // LANES), table)
            parts[i] = ids.reshape(-1)[: m["tokens"]]
        if zlib.crc32(parts[i].astype("<u4").tobytes()) != m["crc32"]:
            raise ValueError(f"block at token {m['first']} is damaged")
    return np.concatenate([parts[i] for i in range(len(marks))]) if marks else np.empty(0, np.uint32)


# --- files ------------------------------------------------------------------------------


def _shared(table: DataFrame) -> Frequencies:
    """At most one row per symbol of the vocabulary."""
    rows = table.toPandas()
    return Frequencies(rows["symbol"].to_numpy(np.int64), rows["slots"].to_numpy(np.int64))


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int | None) -> None:
    """Tokenise ``docs`` (doc_id, text) and write a file set at ``path``."""
    spark = docs.sparkSession
    tokens = stored(tokenize(docs, tokenizer_path, end), "token-ids", compression="none")
    counts = token_counts(tokens).toPandas()
    symbols, slots = Frequencies.of_counts(
        counts["symbol"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
    )
    spark.createDataFrame(
        list(zip(symbols.tolist(), slots.tolist())), "symbol long, slots long"
    ).write.parquet(f"{path}/frequencies")
    table = Frequencies(symbols, slots)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, docs_, lengths = [], [], []

        def segment() -> pa.RecordBatch:
            nonlocal seq, first, size
            run = np.concatenate(ids)
            payload, marks = encode_segment(run, table)
            row = {
                "part": part, "seq": seq, "first": first, "n_tokens": len(run),
                "doc_ids": list(docs_), "lengths": list(lengths), "payload": payload, "blocks": marks,
            }
            seq, first, size = seq + 1, first + len(run), 0
            for held in (ids, docs_, lengths):
                held.clear()
            return pa.RecordBatch.from_pylist([row], schema=_ARROW_SEGMENTS)

        for batch in batches:
            known = (batch.column(c).to_pylist() for c in ("doc_id", "n_tokens"))
            for doc, n, packed in zip(*known, batch.column("ids")):
                if lengths and size + n > SEGMENT:
                    yield segment()
                ids.append(_unpacked(packed, n))
                docs_.append(doc)
                lengths.append(n)
                size += n
        if lengths:
            yield segment()

    # The second key deals rows of one id, or of none, over several tasks.
    ordered = tokens.withColumn("_tie", F.xxhash64("ids"))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.mapInArrow(task, _SEGMENTS).write.option("compression", "none").parquet(f"{path}/segments")
    parts = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    # One row per part: a few numbers for each task of the writing stage.
    sizes = parts.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes.select("part", F.coalesce(before, F.lit(0)).alias("before")).write.parquet(f"{path}/parts")


_ARROW_SEGMENTS = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()),
        ("blocks", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "tokens", "offset", "crc32")]))),
    ]
)


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Decode a file set: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    table = _shared(spark.read.schema("symbol long, slots long").parquet(f"{path}/frequencies"))
    segments = spark.read.schema(_SEGMENTS).parquet(f"{path}/segments")
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = {c: batch.column(c)[row] for c in batch.schema.names}
                ids = decode_segment(own["payload"].as_py(), own["blocks"].as_py(), table)
                docs_, lengths = own["doc_ids"].values, np.array(own["lengths"].as_py(), np.int64)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                columns = [
                    pa.array(np.full(len(lengths), own["part"].as_py(), np.int32)), docs_,
                    pa.array(own["first"].as_py() + ends - lengths), pa.array(lengths),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    edges = np.concatenate([[0], ends]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int64))))
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    parts = spark.read.schema("part int, before long").parquet(f"{path}/parts")
    found = segments.mapInArrow(task, schema).join(parts, "part")
    return found.withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
