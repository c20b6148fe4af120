"""Language identification with error-correcting output codes.

Every learned language has a codeword of bits. For each bit one binary n-gram classifier
tells the languages whose bit is 1 from the others: naive Bayes over hashed byte trigrams,
each side the mean of its languages' distributions, so that frequent languages do not
drown rare ones. A text's mean log odds per trigram are the bits' margins; decoding takes
the codeword with the least loss, bits weighted by how well their classifier separates
its two sides. A narrow lead over the next codeword flags the text as ambiguous.

Counts are taken from every training row: tasks count their trigrams into arrays and Spark
adds these per (language, bucket). The model is languages x buckets numbers whatever the
corpus holds. A null text, or one without a letter, is `und` with score 0. Rows without
text or language teach nothing; with nothing learned every text is `und`. Ties go to the
language that sorts first. Repeated rows are learned from, and named, each. One text is one
row and handled whole, in arrays of its own length. A frame that already has one of
``OUTPUTS`` is refused by name; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.base import as_bytes, mixed, pieces

UNKNOWN = "und"
_MARK = "_lettered"
OUTPUTS = ("lang_pred", "score", "ambiguous", _MARK)
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[128:] = np.arange(128, 256)
for _letter in range(97, 123):
    _PLAIN[_letter] = _PLAIN[_letter - 32] = _letter


def trigram_buckets(data: np.ndarray, bounds: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the byte trigrams of each row, blanks put around it; one per byte.

    Capital A-Z count as small letters, every other ASCII character as a blank.
    """
    lengths = np.diff(bounds)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(len(lengths)), lengths)
    padded = np.full(len(data) + 2 * len(lengths) + 2, 32, np.uint32)
    padded[at + 1] = _PLAIN[data]
    codes = padded[at] << 16 | padded[at + 1] << 8 | padded[at + 2]
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(33 - buckets.bit_length())


def codewords(languages: int, per_bit: int = 15) -> np.ndarray:
    """One row of +1 and -1 per language.

    Up to five languages get the exhaustive code. More get words drawn in a fixed order,
    each the one of 64 candidates that is farthest from those before it.
    """
    if languages <= 5:
        # The first language has 1 everywhere; the all-ones column would tell nothing apart.
        columns = np.arange((1 << (languages - 1)) - 1)
        rest = [np.where(columns >> k & 1, 1, -1) for k in range(languages - 1)]
        return np.array([np.ones_like(columns), *rest], np.int8)
    length = per_bit * int(np.ceil(np.log2(languages)))
    draws = mixed(np.arange(1, languages * 64 * length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    draws = np.where(draws.reshape(languages, 64, length) >> np.uint64(63), 1, -1).astype(np.int8)
    chosen = [draws[0, 0]]
    for candidates in draws[1:]:
        apart = (candidates[:, None, :] != np.array(chosen)[None]).sum(axis=2).min(axis=1)
        chosen.append(candidates[apart.argmax()])
    return np.array(chosen)


@dataclass(frozen=True)
class OutputCodes:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits, +1 and -1
    odds: np.ndarray  # buckets x bits
    trust: np.ndarray  # a weight per bit
    gain: float

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, its share of belief, and its lead in loss over the next."""
        signed = margins[:, None, :] * self.code[None] * self.gain
        loss = (np.logaddexp(0.0, -signed) * self.trust).sum(axis=2)
        best = loss.argmin(axis=1)
        least = loss[np.arange(len(loss)), best]
        belief = 1.0 / np.exp(least[:, None] - loss).sum(axis=1)
        others = np.where(np.arange(loss.shape[1]) == best[:, None], np.inf, loss)
        return best, belief, others.min(axis=1) - least


def count_trigrams(docs: DataFrame, buckets: int) -> DataFrame:
    """(lang, bucket, n) over all rows with text and language."""
    at_once = 64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])],
                    names=["lang", "bucket", "n"],
                )
            counts.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            data, bounds = as_bytes(batch.column("text"))
            for first, last in pieces(bounds):
                edges = bounds[first : last + 1]
                found = trigram_buckets(data[edges[0] : edges[-1]], edges - edges[0], buckets)
                own = np.array(langs[first:last], dtype=object)
                each = np.repeat(np.arange(last - first), np.diff(edges))
                for lang in dict.fromkeys(own):
                    if len(counts) >= at_once and lang not in counts:
                        yield from flush()
                    n = np.bincount(found[(own == lang)[each]], minlength=buckets)
                    counts[lang] = counts.get(lang, 0) + n
        yield from flush()

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    counted = rows.mapInArrow(task, "lang string, bucket int, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, buckets: int = 1 << 15, pseudo: float = 0.5, gain: float = 12.0) -> OutputCodes | None:
    """Learn from all rows of ``docs`` (text, lang); None where there is nothing to learn."""
    counts = count_trigrams(docs, buckets).toPandas()
    if not len(counts):
        return None
    languages = tuple(sorted(counts["lang"].unique()))
    table = np.zeros((len(languages), buckets))
    place = {lang: i for i, lang in enumerate(languages)}
    table[counts["lang"].map(place), counts["bucket"]] = counts["n"]
    table = (table + pseudo) / (table + pseudo).sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    ones, rest = code.T == 1, code.T == -1
    upper = (ones[..., None] * table).sum(axis=1) / ones.sum(axis=1, keepdims=True)
    lower = (rest[..., None] * table).sum(axis=1) / rest.sum(axis=1, keepdims=True)
    odds = np.log(upper) - np.log(lower)
    apart = ((upper - lower) * odds).sum(axis=1)
    trust = apart / apart.mean() if len(apart) else apart
    return OutputCodes(languages, code, np.ascontiguousarray(odds.T, np.float32), trust, gain)


def identify(docs: DataFrame, model: OutputCodes | None, least_lead: float = 0.5) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``, from the text alone."""
    if clash := set(OUTPUTS) & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    if model is None:
        return docs.withColumns(
            {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True)}
        )
    mark = _MARK
    rows = docs.withColumn(mark, F.coalesce(F.regexp_like("text", F.lit("\\p{L}")), F.lit(False)))
    schema = T.StructType(docs.schema.fields).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    buckets = len(model.odds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = as_bytes(batch.column("text"))
            margins = np.zeros((batch.num_rows, model.odds.shape[1]))
            for first, last in pieces(bounds, 1 << 18):
                edges = bounds[first : last + 1]
                lengths = np.diff(edges)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                found = trigram_buckets(data[edges[0] : edges[-1]], edges - edges[0], buckets)
                sums = np.add.reduceat(model.odds[found], (edges[:-1] - edges[0])[some], axis=0, dtype=np.float64)
                margins[first + some] = sums / lengths[some, None]
            best, belief, lead = model.decode(margins)
            known = batch.column(mark).to_numpy(zero_copy_only=False).astype(bool)
            names = np.where(known, np.array(model.languages, object)[best], UNKNOWN)
            out = [batch.column(c) for c in batch.schema.names if c != mark]
            out += [pa.array(names, pa.string()), pa.array(np.where(known, belief, 0.0)), pa.array(~known | (lead < least_lead))]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(task, schema)
