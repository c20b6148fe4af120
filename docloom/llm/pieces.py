"""SentencePiece encoding that keeps the original byte span of every piece, and decoding.

The normaliser walks the model's compiled character map, a double-array trie, and at each
position takes the longest matching prefix; it records for every normalised byte the
original byte it comes from. Piece lengths, summed over a text, then project each piece to
a span of the original UTF-8 bytes. The segmentation itself is the sentencepiece library's.

Where the model shows that no piece can cross from a character into a blank (byte-pair
merges, blanks only at the front of pieces, an identity map), a text is cut before its runs
of blanks and each distinct unit is encoded once per task; the ids are the library's for the
whole text. A literal U+2581 is a blank to the library and here. Any other model encodes a text
as a whole.

Long texts, with blanks or without, go through such a model part by part, cut where no piece
holds the characters on both sides, and are decoded part by part; so are long units, which are
not kept. A task's memory does not grow with what it has seen, and with a text only by its lists.

A null text counts as empty: no ids, no spans, an empty decoded text. One document is one
row; other columns stay as they are, so a frame that already has `ids`, `starts`, `ends`
or `decoded` must rename them first (an error says so).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.base import tidy

MARK = "▁"
CACHE_UNITS = 300_000
CACHE_CHARS = 64
PART_CHARS = 1 << 18
PART_IDS = 1 << 18
OUTPUTS = ("ids", "starts", "ends", "decoded")
_UNITS = re.compile(" +[^ ]*|[^ ]+")


class CharacterMap:
    """A compiled character map: size of the trie, its 32-bit units, then the results."""

    def __init__(self, blob: bytes) -> None:
        self.units, self.results = np.empty(0, np.uint32), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.results = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]

    @staticmethod
    def _jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at ``at``."""
        if not len(self.units):
            return None
        found, node = None, self._jump(int(self.units[0]))
        for here in range(at, len(text)):
            node ^= text[here]
            unit = int(self.units[node])
            if unit & 0x800000FF != text[here]:
                break
            node ^= self._jump(unit)
            if unit >> 8 & 1:
                start = int(self.units[node]) & 0x7FFFFFFF
                found = here + 1 - at, self.results[start : self.results.index(b"\0", start)]
        return found

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them and the end its original offset."""
        if not len(self.units):
            return text, np.arange(len(text) + 1)
        out, origin, at = bytearray(), [], 0
        while at < len(text):
            hit = self.longest(text, at)
            if hit is None:
                lead = text[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, text[at : at + size]
            out += hit[1]
            origin += [at] * len(hit[1])
            at += hit[0]
        return bytes(out), np.array([*origin, len(text)])


class Encoder:
    """A model file's ids and original byte spans, for whole texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        kinds = proto.ModelProto.SentencePiece
        self.byte_kind = kinds.BYTE
        # Bytes of normalised text that a piece stands for, a blank counted as one byte.
        self.lengths = np.array(
            [
                1 if p.type == kinds.BYTE else len(p.piece.replace(MARK, " ").encode())
                for p in model.pieces
            ],
            np.int32,
        )
        self.plain = (
            not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
            and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        )
        self.by_unit = (
            self.plain
            and self.prefix
            and model.trainer_spec.model_type == proto.TrainerSpec.BPE
            and model.trainer_spec.byte_fallback
            and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
            and any(p.piece == MARK for p in model.pieces)
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)
        )
        # The same with every blank as the three bytes of its mark.
        self.marked_lengths = np.array(
            [1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64
        )
        # Neighbours within a piece: between any others a text can be cut.
        shown = [p.piece.replace(MARK, " ") for p in model.pieces]
        self.pairs = {p[n : n + 2] for p in shown for n in range(len(p) - 1)}
        # Runs of characters that pieces may hold behind another one, and what starts them.
        follow = "".join(map(re.escape, sorted({p[1] for p in self.pairs})))
        self.runs = re.compile(f"[{follow}]+|[^{follow}][{follow}]*") if follow else re.compile(".", re.S)
        # Bytes that go on with a character, and a piece that keeps a later part's first blank.
        self.inside = np.array(
            [p.type == kinds.BYTE and 0x80 <= int(p.piece[1:-1], 16) < 0xC0 for p in model.pieces]
        )
        self.mark = self.library.piece_to_id(MARK)
        self.lead = next(
            (n for n, p in enumerate(model.pieces) if p.type == kinds.NORMAL and MARK not in p.piece), None
        )
        self.cache: dict[str, bytes] = {}

    def _cut(self, text: str, at: int) -> int:
        """The first place from ``at`` on where the library's ids of both sides add up."""
        pairs = self.pairs
        while at < len(text):
            here = text[at]
            # What follows is encoded behind a blank: its own, or one that stays a piece alone.
            if text[at - 1 : at + 1] not in pairs and (here == " " or " " + here not in pairs):
                return at
            at += 1
        return len(text)

    def ids(self, text: str) -> np.ndarray:
        if not self.by_unit:
            return np.array(self.library.encode(text), np.int32)
        text = text.replace(MARK, " ")
        if len(text) <= PART_CHARS:
            return self._part(text)
        found, at = [], 0
        while at < len(text):
            end = self._cut(text, at + PART_CHARS)
            part = text[at:end]
            if at == 0:
                found.append(self._part(part))
            elif part == " ":
                found.append(np.array([self.mark], np.int32))
            elif part[0] == " ":
                found.append(self._part(part[1:]))
            else:
                found.append(self._part(part)[1:])
            at = end
        return np.concatenate(found)

    def _part(self, text: str) -> np.ndarray:
        """Ids of a text without marks, unit by unit."""
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            units = _UNITS.findall(text)
            # The library's own leading blank stands for the first blank of a later unit.
            units[1:] = [u[1:] for u in units[1:]]
        else:
            units = text.split(" ") if text else []
        cache = self.cache
        if len(cache) > CACHE_UNITS:
            cache.clear()
        # A lone blank at the end of a text is left without characters to encode.
        fresh = set(units).difference(cache)
        for unit in fresh:
            cache[unit] = self._unit(unit)
        found = np.frombuffer(b"".join(map(cache.__getitem__, units)), np.int32)
        for unit in fresh:
            if len(unit) > CACHE_CHARS:
                del cache[unit]
        return found

    def _unit(self, unit: str) -> bytes:
        """Ids of one unit; a long one goes run by run, each behind a blank that stays alone."""
        runs = self.runs.findall(unit) if len(unit) > CACHE_CHARS else [unit]
        found = []
        for run in runs:
            ids = self.cache.get(run)
            if ids is None:
                ids = np.array(self.library.encode(run) if run else [self.mark], np.int32).tobytes()
                if len(run) <= CACHE_CHARS:
                    self.cache[run] = ids
            found.append(ids[4:] if found else ids)
        return b"".join(found)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every piece in the bytes of ``text``."""
        raw = text.encode()
        if self.plain and MARK not in text:
            ends = np.cumsum(self.lengths[ids], dtype=np.int32)
            ends -= 1 if self.prefix else 0
            if len(ids) == 0 or ends[-1] == len(raw):
                return self._starts(ends), ends
        if self.plain:
            # A literal mark and the mark of a blank look alike in pieces: lengths add up to
            # places in the marked text, and each blank before a place takes two bytes off.
            first = 3 if self.prefix and raw else 0
            blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20)
            blanks += np.arange(first + 3, first + 3 + 2 * len(blanks), 2)
            ends = np.cumsum(self.marked_lengths[ids])
            if len(ids) == 0 or ends[-1] == len(raw) + 2 * len(blanks) + first:
                ends = np.maximum(ends - 2 * np.searchsorted(blanks, ends, "right") - first, 0)
                return self._starts(ends), ends
        return self._aligned(ids, raw)

    @staticmethod
    def _starts(ends: np.ndarray) -> np.ndarray:
        """Starts of pieces that tile a text."""
        starts = np.zeros_like(ends)
        starts[1:] = ends[:-1]
        return starts

    def _aligned(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Spans by walking the pieces' surfaces over the normalised text and its origins."""
        normal, origin = self.map.normalise(raw)
        at, starts, ends = 0, [], []
        for piece in ids.tolist():
            blanks = self.library.id_to_piece(piece).replace(MARK, " ").encode()
            if self.library.is_byte(piece):
                blanks = normal[at : at + 1]
            elif at == 0 and self.prefix and blanks[:1] == b" " and not normal.startswith(blanks):
                blanks = blanks[1:]
            else:
                # Blanks that normalisation takes away belong to no piece.
                while normal[at : at + 1] == b" " and blanks[:1] != b" ":
                    at += 1
                if not normal.startswith(blanks, at) and normal[at:].startswith(blanks.replace(b" ", MARK.encode())):
                    blanks = blanks.replace(b" ", MARK.encode())
            starts.append(origin[min(at, len(normal))])
            at = min(at + len(blanks), len(normal))
            ends.append(origin[at])
        return np.array(starts, np.int64), np.array(ends, np.int64)

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) <= PART_IDS or not self.by_unit or self.lead is None:
            return self.library.decode(ids.tolist()) if len(ids) else ""
        skipped = len(self.library.decode([self.lead]))
        parts, at = [], 0
        while at < len(ids):
            end = at + PART_IDS
            while end < len(ids) and self.inside[ids[end]]:
                end += 1
            own = ids[at:end].tolist()
            # The library drops a first blank, which only the first part may lose.
            parts.append(self.library.decode([self.lead, *own])[skipped:] if at else self.library.decode(own))
            at = end
        return "".join(parts)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per model and worker."""
    return Encoder(path)


def encode(docs: DataFrame, model: str, decoded: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, ``starts``, ``ends`` (original bytes) and the decoded text."""
    fresh = [c for c in OUTPUTS if decoded or c != "decoded"]
    clash = set(fresh) & set(docs.columns)
    if clash:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    schema = T.StructType(list(docs.schema.fields))
    for name in fresh:
        schema.add(name, T.StringType() if name == "decoded" else T.ArrayType(T.IntegerType()))

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        flat = parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0)
        return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32, copy=False)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)

        def made(rows: pa.RecordBatch, parts: list[tuple]) -> pa.RecordBatch:
            columns = [lists([p[i] for p in parts]) for i in range(3)]
            if decoded:
                columns.append(pa.array([p[3] for p in parts], pa.string()))
            return pa.RecordBatch.from_arrays([*rows.columns, *columns], names=schema.names)

        for batch in batches:
            done, first, size = [], 0, 0
            for row, value in enumerate(batch.column(text)):
                own = value.as_py() or ""
                ids = known.ids(own)
                starts, ends = known.spans(own, ids)
                done.append((ids, starts, ends, known.decode(ids) if decoded else None))
                size += len(own)
                if size >= 1 << 20:
                    yield made(batch.slice(first, row + 1 - first), done)
                    done, first, size = [], row + 1, 0
            if done:
                yield made(batch.slice(first), done)

    return docs.mapInArrow(tidy(task), schema)
