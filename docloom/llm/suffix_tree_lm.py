"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of zero, one or two words. The root has every word's smoothed share of
the training tokens. A longer context s with N occurrences has next-symbol probabilities

    P(w | s) = max(n(s, w) - d(n), 0) / N + g(s) * P(w | s without its first word)

with d(1) = 1 and d(n) = ``DISCOUNT`` from two on; g(s) is the mass the discounts leave. A
context of ``LEAST`` occurrences or more is retained if its divergence from its suffix, the
log-likelihood gain sum n(s, w) log(P(w | s) / P(w | suffix)) over what followed it, reaches
``GAIN``; the gain is bounded from below, so that chance never retains a context. A token is
scored in the longest retained suffix of the words before it.

The corpus is packed once into chunks of whole documents (a dictionary of word hashes and a
code per token). A chunk asks for the corpus counts of its distinct words, then of the word
pairs and triples that can still reach a count of two, each question a sorted array per
hash bucket, sent as the differences of its keys; buckets add up the answers and send every
chunk what it asked for. So a word or context that holds a third of the corpus is one number
per chunk, and the counts grow with the corpus without ever standing in one place. Buckets
also number the words and pairs that later questions are made of: a pair is asked for by the
numbers of its words, a triple by those of a pair and a word, which takes fewer bits than a
hash and mistakes none for another. Answers lie in a table by chunk, as the chunks do.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, and every text has one end token;
contexts do not cross texts. Words are known by hashes of 24 bits more than it takes to number
the corpus's tokens (62 at most): one in 16 million is taken for another; so are pairs and
triples where their numbers would not fit 62 bits. A null text is empty. Rows keep their null or repeated ids; equal texts get equal scores. A text
of any length is one row of one chunk. Without training rows the root is uniform over the one
unknown word, an empty table gives no rows. Only id, text and the held-out column are read.
Scores are stored; the chunks and answers they come from are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import as_bytes, give_back, lowered, mixed, pieces, shuffles_removed, span_hashes, stored, words
from docloom.session import delete_path, work_path

CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 2_000_000
LEAST = 16
GAIN = 4.0
DISCOUNT = 0.75
PSEUDO = 0.1
# Discounts are whole multiples of a PART; a chunk's gains are rounded to a UNIT, so that all
# sums are whole numbers, exact in any order.
PART = 0.25
UNIT = 2.0**-20
# Text for one task of a round, and hash bits beyond those that number the tokens.
TASK_BYTES = 256 << 20
SPARE_BITS = 24
END = np.uint64(0x5851F42D4C957F2D)
_PAIR = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93))

_CHUNKS = (
    "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, words binary, "
    "times binary, codes binary, n_train long"
)


def pack(docs: DataFrame, held_out: str, shift: int = 2) -> DataFrame:
    """``docs`` (doc_id, text, and a boolean column ``held_out``) as chunks of tokens.

    ``shift`` bits of the words' hashes are left out. The code of a word is its place among the
    chunk's words by frequency, so that most codes are small.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, bounds = as_bytes(batch.column("text"))
            held = batch.column(held_out).to_numpy(zero_copy_only=False).astype(bool)
            for first, last in pieces(bounds, CHUNK_BYTES):
                cut = bounds[first : last + 1]
                small = lowered(data[cut[0] : cut[-1]])
                starts, ends, counts = words(small, cut - cut[0])
                sizes = counts + 1
                tokens = np.full(int(sizes.sum()), END)
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(sizes) - 1] = False
                tokens[inner] = span_hashes(small, starts, ends)
                known, codes = np.unique(tokens >> np.uint64(shift), return_inverse=True)
                times = np.bincount(codes, minlength=len(known))
                place = np.empty(len(known), np.int64)
                place[_by_frequency(times)] = np.arange(len(known))
                row = {
                    "chunk": number, "doc_ids": batch.column("doc_id").slice(first, last - first).to_pylist(),
                    "held": held[first:last].tolist(), "sizes": sizes.tolist(),
                    "words": _packed(np.diff(known.astype(np.int64), prepend=0)), "times": _packed(times),
                    "codes": press.compress(_planes(place[codes])),
                    "n_train": int(sizes[~held[first:last]].sum()),
                }
                number += 1
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, "text")
    return rows.mapInArrow(task, _CHUNKS)


_ARROW = pa.schema(
    [
        ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("times", pa.binary()), ("codes", pa.binary()),
        ("n_train", pa.int64()),
    ]
)


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times, kind="stable")


def _planes(codes: np.ndarray) -> bytes:
    """The codes' lower bytes end to end, then the next ones: they pack better apart."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, sign last and bytes of one weight end to end: small ones stay small."""
    numbers = numbers.astype(np.int64)
    folded = ((numbers << 1) ^ (numbers >> 63)).astype("<u8")
    planes = np.ascontiguousarray(folded.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(raw)
    folded = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8")[:, 0]
    return (folded >> np.uint64(1)).astype(np.int64) ^ -(folded & np.uint64(1)).astype(np.int64)


def _shares(numbers: np.ndarray) -> np.ndarray:
    """Shares that travelled as whole numbers: all their PARTs, then what they are shares of."""
    parts, whole = numbers.reshape(2, -1)
    return parts * PART / np.maximum(whole, 1)


def _packed_keys(keys: np.ndarray, buckets: int) -> bytes:
    """Ascending keys of one bucket: the differences of what the bucket leaves open."""
    return _packed(np.diff((keys // np.uint64(buckets)).astype(np.int64), prepend=0))


def _unpacked_keys(raw: bytes, bucket: int, buckets: int) -> np.ndarray:
    return np.cumsum(_unpacked(raw)).astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket)


def _joined(left: np.ndarray, right: np.ndarray, below: tuple[int, int], shift: np.uint64) -> np.ndarray:
    """One key of two numbers, each below its bound (multiples of the number of buckets)."""
    width = below[1] + 1
    if below[0] * width < 1 << 62:
        return left * np.uint64(width) + right
    return mixed(left * _PAIR[0] + right * _PAIR[1]) >> shift


class Chunk:
    """One chunk's tokens with what is known of them: counts are 0 where not asked for.

    Word numbers are below ``below[0]``, numbers of pairs that are contexts below ``below[1]``.
    Only what questions up to ``order`` need is made; 3 makes all.
    """

    def __init__(
        self, row: pd.Series, answers: pd.DataFrame, buckets: int, shift: int = 0, below: tuple[int, int] = (0, 0),
        key_shift: int = 2, order: int = 3,
    ) -> None:
        self.row, self.buckets = row, buckets
        sizes = np.asarray(row["sizes"], np.int64)
        # The upper bits keep their order.
        self.sizes, self.known_words = sizes, np.cumsum(_unpacked(row["words"])).astype(np.uint64) >> np.uint64(shift)
        raw = zstandard.ZstdDecompressor().decompress(row["codes"], max_output_size=max(4 * int(sizes.sum()), 1))
        codes = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
        self.codes = _by_frequency(_unpacked(row["times"]))[codes]
        n = len(self.codes)
        self.train = np.repeat(~np.asarray(row["held"], bool), sizes)
        if order == 1:
            return
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.second, self.third = place >= 1, place >= 2
        del raw, codes, place
        self.said = {order: group.sort_values("bucket") for order, group in answers.groupby("about")}
        # Numbers are negative at the one chunk that speaks for a key.
        counts = np.abs(self.heard(1, self.known_words))
        self.count = counts[self.codes]
        word = self.numbered(1, self.known_words, counts)[self.codes]
        self.before = np.zeros(n, np.int64)
        self.before[1:] = self.count[:-1]
        self.before *= self.second
        self.pair = np.zeros(n, np.uint64)
        self.pair[1:] = _joined(word[:-1], word[1:], (below[0], below[0]), np.uint64(key_shift))
        self.asks_pair = self.second & (self.before >= LEAST) & (self.count >= 2)
        self.pair_count = np.zeros(n, np.int64)
        self.pair_keys, codes = np.unique(self.pair[self.asks_pair], return_inverse=True)
        self.pair_codes = codes.astype(np.int32)
        if order == 2:
            return
        counts = self.heard(2, self.pair_keys)
        self.pair_count[self.asks_pair] = counts[codes]
        self.pair_owned, self.pair_count = self.pair_count < 0, np.abs(self.pair_count)
        number = np.zeros(n, np.uint64)
        number[self.asks_pair] = self.numbered(2, self.pair_keys, np.abs(counts))[codes]
        self.context = np.zeros(n, np.uint64)
        self.context[1:] = number[:-1]
        del number, codes
        self.context_count = np.zeros(n, np.int64)
        self.context_count[1:] = self.pair_count[:-1]
        self.context_count *= self.third
        self.triple = _joined(self.context, word, (below[1], below[0]), np.uint64(key_shift))
        self.asks_triple = (self.context_count >= LEAST) & (self.pair_count >= 2)
        self.triple_count = np.zeros(n, np.int64)
        self.triple_keys, codes = np.unique(self.triple[self.asks_triple], return_inverse=True)
        self.triple_codes = codes.astype(np.int32)
        self.triple_count[self.asks_triple] = self.heard(3, self.triple_keys)[codes]
        self.triple_owned, self.triple_count = self.triple_count < 0, np.abs(self.triple_count)
        # Contexts of one word are numbered after those of two.
        self.single = np.zeros(n, np.uint64)
        self.single[1:] = word[:-1] + np.uint64(below[1])

    def by_bucket(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the keys by bucket, and the buckets in that order."""
        # Short integers are sorted in one pass.
        bucket = (keys % np.uint64(self.buckets)).astype(np.uint16 if self.buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        return order, bucket[order]

    def heard(self, order: int, keys: np.ndarray, kind: type = np.int64) -> np.ndarray:
        """What the buckets said of the keys, in the order in which they were asked."""
        out = np.zeros(len(keys), kind)
        if order in self.said and len(keys):
            said = [_unpacked(n) for n in self.said[order]["numbers"]]
            if kind is np.float64:
                said = [_shares(n) for n in said]
            out[self.by_bucket(keys)[0]] = np.concatenate(said)
        return out

    def numbered(self, order: int, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The numbers that the buckets gave to keys; 0 for keys too rare to get one."""
        out = np.zeros(len(keys), np.uint64)
        if (rows := self.said.get(order + NUMBERS)) is not None and len(keys):
            said = [np.cumsum(_unpacked(n)) * self.buckets + b for b, n in zip(rows["bucket"], rows["numbers"])]
            sort, bucket = self.by_bucket(keys)
            often = counts[sort] >= _least_numbered(order)
            sort, bucket = sort[often], bucket[often]
            out[sort[np.lexsort((-counts[sort], bucket))]] = np.concatenate(said).astype(np.uint64)
        return out

    def questions(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of one order and how often each stands in training rows."""
        if order == 1:
            return self.known_words, np.bincount(self.codes[self.train], minlength=len(self.known_words))
        at = self.asks_pair if order == 2 else self.asks_triple
        keys = self.pair_keys if order == 2 else self.triple_keys
        codes = self.pair_codes if order == 2 else self.triple_codes
        return keys, np.bincount(codes, weights=self.train[at], minlength=len(keys)).astype(np.int64)


# What an answer is about: counts of an order's keys or, this much higher, the keys' numbers.
NUMBERS = 10
_NONE = pd.DataFrame({"bucket": [], "about": [], "numbers": []})


def _cogrouped(chunks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = [work(row, right) for _, row in left.iterrows()]
        give_back()
        return pd.concat(parts, ignore_index=True) if parts else work(None, right)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(task, schema)


def _asked(chunk: Chunk, order: int) -> pd.DataFrame:
    keys, counts = chunk.questions(order)
    sort, bucket = chunk.by_bucket(keys)
    keys, counts = keys[sort], counts[sort]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.empty(0, int)
    ends = np.concatenate([edges[1:], [len(keys)]]).astype(int)
    return pd.DataFrame(
        {
            "bucket": bucket[edges],
            "chunk": np.full(len(edges), int(chunk.row["chunk"])),
            "keys": [_packed_keys(keys[a:b], chunk.buckets) for a, b in zip(edges, ends)],
            "counts": [_packed(counts[a:b]) for a, b in zip(edges, ends)],
        }
    )


def _keys_of(group: pd.DataFrame, buckets: int) -> tuple[np.ndarray, list[int]]:
    """All keys of a bucket's questions, and how many each chunk sent."""
    parts = [_unpacked_keys(k, int(group["bucket"].iloc[0]), buckets) for k in group["keys"]]
    return np.concatenate(parts), [len(k) for k in parts]


def _least_numbered(order: int) -> int:
    """The least count of words and of pairs that get a number."""
    return 2 if order == 1 else LEAST


def _answered(asked: DataFrame, order: int, buckets: int = 1) -> DataFrame:
    """(chunk, bucket, about, numbers): totals over all chunks, in the order of the keys.

    Totals below 2 (words: below 1) are 0. One chunk of those that ask for a key gets the
    number negative: it speaks for the key. Words of two occurrences and pairs of ``LEAST`` are
    numbered: ``buckets`` times their rank by count in the bucket, plus the bucket. Frequent
    keys have small numbers that lie close together, and a chunk's ranks, in the order of its
    keys' counts, travel as small differences. Chunk -1 gets the number of distinct keys and of those numbered.
    """
    least = 1 if order == 1 else 2

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        keys, sizes = _keys_of(group, buckets)
        counts = np.concatenate([_unpacked(c) for c in group["counts"]])
        distinct, first, codes = np.unique(keys, return_index=True, return_inverse=True)
        totals = np.zeros(len(distinct), np.int64)
        np.add.at(totals, codes, counts)
        totals[totals < least] = 0
        numbers = totals[codes]
        numbers[first] *= -1
        known = int((totals >= _least_numbered(order)).sum()) if order < 3 else 0
        ranks = np.empty(len(distinct), np.int64)
        ranks[np.argsort(-totals, kind="stable")] = np.arange(len(distinct))
        bucket, out, at = int(group["bucket"].iloc[0]), [], 0
        for chunk, size in zip(group["chunk"].tolist(), sizes):
            out.append((chunk, bucket, order, _packed(numbers[at : at + size])))
            if order < 3:
                own = np.sort(ranks[codes[at : at + size]])
                own = own[: np.searchsorted(own, known)]
                out.append((chunk, bucket, order + NUMBERS, _packed(np.diff(own, prepend=0))))
            at += size
        out.append((-1, bucket, order, np.array([int((totals > 0).sum()), known]).tobytes()))
        give_back()
        return pd.DataFrame(out, columns=["chunk", "bucket", "about", "numbers"])

    return asked.groupBy("bucket").applyInPandas(task, "chunk long, bucket long, about int, numbers binary")


class Root:
    """The empty context: every word's smoothed share of the training tokens."""

    def __init__(self, tokens: int, distinct: int) -> None:
        self.total = tokens + PSEUDO * (distinct + 1)

    def of(self, counts: np.ndarray) -> np.ndarray:
        return (counts + PSEUDO) / self.total


def _evidence(chunk: Chunk, root: Root) -> pd.DataFrame:
    """(context, n, kinds, events, gain): sums over the followers this chunk speaks for.

    Every one of the ``kinds`` of followers gives up one discount; counts stay exact.
    """
    share = root.of(chunk.count)
    parent = np.maximum(chunk.pair_count - DISCOUNT, 0) / np.maximum(chunk.before, 1) + share
    parts = []
    for owned, count, total, context, below, key in (
        (chunk.pair_owned, chunk.pair_count, chunk.before, chunk.single, share, chunk.pair),
        (chunk.triple_owned, chunk.triple_count, chunk.context_count, chunk.context, parent, chunk.triple),
    ):
        at = np.flatnonzero(owned)
        at = at[np.unique(key[at], return_index=True)[1]]
        n, whole = count[at], total[at]
        gain = n * np.log((n - DISCOUNT) / (whole * np.minimum(below[at], 1.0)))
        keys, codes = np.unique(context[at], return_inverse=True)
        first = np.zeros(len(keys), np.int64)
        first[codes] = whole
        events = np.zeros(len(keys), np.int64)
        np.add.at(events, codes, n)
        parts.append(
            pd.DataFrame(
                {
                    "context": keys.view(np.int64),
                    "n": first,
                    "kinds": np.bincount(codes, minlength=len(keys)),
                    "events": events,
                    "gain": np.bincount(codes, weights=gain, minlength=len(keys)),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


def _contexts(chunk: Chunk) -> np.ndarray:
    """All contexts of the chunk that may be retained."""
    one = chunk.single[chunk.second & (chunk.before >= LEAST)]
    two = chunk.context[chunk.context_count >= LEAST]
    return np.unique(np.concatenate([one, two]))


def _testimony(chunk: Chunk, root: Root) -> pd.DataFrame:
    """All contexts of a chunk by bucket, with what it can say of their divergence."""
    keys = _contexts(chunk)
    said = _evidence(chunk, root)
    at = np.searchsorted(keys, said["context"].to_numpy(np.int64).view(np.uint64))
    sort, bucket = chunk.by_bucket(keys)
    fields = []
    for name, kind in _SAID:
        values = np.zeros(len(keys), kind)
        (np.maximum if name == "n" else np.add).at(values, at, said[name].to_numpy(kind))
        values = np.rint(values / UNIT).astype(np.int64) if kind is np.float64 else values
        fields.append(values[sort])
    keys = keys[sort]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.empty(0, int)
    ends = np.concatenate([edges[1:], [len(keys)]]).astype(int)
    return pd.DataFrame(
        {
            "bucket": bucket[edges],
            "chunk": np.full(len(edges), int(chunk.row["chunk"])),
            "keys": [_packed_keys(keys[a:b], chunk.buckets) for a, b in zip(edges, ends)],
            "counts": [_packed(np.concatenate([f[a:b] for f in fields])) for a, b in zip(edges, ends)],
        }
    )


# What a chunk says of a context: its occurrences, and sums over followers. The gain travels as its UNITs.
_SAID = (("n", np.int64), ("events", np.int64), ("kinds", np.int64), ("gain", np.float64))


def _judged(testimony: DataFrame, buckets: int = 1) -> DataFrame:
    """(chunk, bucket, about, numbers): per context the mass its discounts leave if it is
    retained, else 0, in the order of the keys: as PARTs and occurrences, which are mostly small
    and travel better than their shares.
    """

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        keys, sizes = _keys_of(group, buckets)
        raws = [_unpacked(c).reshape(len(_SAID), -1) for c in group["counts"]]
        whole = {name: np.concatenate([r[i] for r in raws]) for i, (name, _) in enumerate(_SAID)}
        distinct, codes = np.unique(keys, return_inverse=True)
        n, events, kinds, gain = (np.zeros(len(distinct), np.int64) for _ in _SAID)
        np.maximum.at(n, codes, whole["n"])
        np.add.at(events, codes, whole["events"])
        np.add.at(kinds, codes, whole["kinds"])
        np.add.at(gain, codes, whole["gain"])
        # A small difference of large counts: exact before it is divided.
        mass = np.where(n >= LEAST, (n - events) + DISCOUNT * kinds, 0.0)
        gain = gain * UNIT + (n - events) * np.log(np.maximum(mass / np.maximum(n, 1), 1e-300))
        kept = (mass > 0) & (gain >= GAIN)
        parts, of = np.where(kept, mass / PART, 0.0).astype(np.int64)[codes], np.where(kept, n, 0)[codes]
        bucket, out, at = int(group["bucket"].iloc[0]), [], 0
        for chunk, size in zip(group["chunk"].tolist(), sizes):
            said = np.concatenate([parts[at : at + size], of[at : at + size]])
            out.append((chunk, bucket, 0, _packed(said)))
            at += size
        return pd.DataFrame(out, columns=["chunk", "bucket", "about", "numbers"])

    return testimony.groupBy("bucket").applyInPandas(task, "chunk long, bucket long, about int, numbers binary")


def _scored(chunk: Chunk, root: Root) -> pd.DataFrame:
    share = root.of(chunk.count)
    likely = share.copy()
    contexts = _contexts(chunk)
    retained = chunk.heard(0, contexts, np.float64)
    for at, count, total, context in (
        (chunk.second & (chunk.before >= LEAST), chunk.pair_count, chunk.before, chunk.single),
        (chunk.context_count >= LEAST, chunk.triple_count, chunk.context_count, chunk.context),
    ):
        at = np.flatnonzero(at)
        left = retained[np.searchsorted(contexts, context[at])]
        at, left = at[left > 0], left[left > 0]
        seen = np.where(count[at] >= 2, count[at] - DISCOUNT, 0.0) / total[at]
        likely[at] = seen + left * likely[at]
    edges = np.cumsum(chunk.sizes) - chunk.sizes

    def summed(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, edges) if len(edges) else values[:0]

    return pd.DataFrame(
        {
            "doc_id": pd.array(np.asarray(chunk.row["doc_ids"], object), "Int64"),
            "held_out": np.asarray(chunk.row["held"], bool),
            "n_tokens": chunk.sizes,
            "n_known": summed((chunk.count > 0).astype(np.int64)),
            "base_score": summed(np.log10(share)),
            "score": summed(np.log10(likely)),
        }
    )


def _added(rows: DataFrame, path: str, parts: int) -> DataFrame:
    """The table at ``path`` with ``rows`` added. It is bucketed by chunk: joins leave it where it is."""
    spark, name = rows.sparkSession, _name(path)
    writer = rows.write.format("parquet").option("compression", "none").option("path", path)
    with shuffles_removed(spark):
        writer.mode("append").bucketBy(parts, "chunk").saveAsTable(name)
    return spark.table(name)


def _name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def _left_out(tokens: int) -> int:
    """Hash bits not needed to tell the words of a corpus apart."""
    return 64 - min(62, tokens.bit_length() + SPARE_BITS)


def score(docs: DataFrame, held_out: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The tree is learned from the rows whose boolean column ``held_out`` is false.
    """
    spark = docs.sparkSession
    chunk_path, answer_path = work_path(spark, "lm-chunks"), work_path(spark, "lm-answers")
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // TASK_BYTES, 100_000))
    # A text has at most a word for every two bytes, one more and its end.
    packed = _left_out(size // 2 + 2 * rows)
    chunks = _added(pack(docs, held_out, packed), chunk_path, parts)
    sizes = chunks.agg(F.sum("n_train"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()
    tokens = sizes[0] or 0
    every = sizes[1] or 0
    buckets, shift = max(64, every // BUCKET_KEYS), _left_out(every)
    asked_schema = "bucket long, chunk long, keys binary, counts binary"

    def heard(found: DataFrame) -> DataFrame:
        return _added(found.repartition(parts, "chunk"), answer_path, parts)

    def totals(answers: DataFrame, order: int) -> tuple[int, int]:
        """The distinct keys of an order, and the bound of the numbers they got."""
        distinct = most = 0
        for row in answers.where(f"chunk = -1 and about = {order}").select("numbers").toLocalIterator():
            own, numbered = np.frombuffer(row["numbers"], np.int64).tolist()
            distinct, most = distinct + own, max(most, numbered)
        return distinct, most * buckets

    def first_questions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                yield _asked(Chunk(row, _NONE, buckets, shift - packed, order=1), 1)
        give_back()

    answers = heard(_answered(chunks.mapInPandas(first_questions, asked_schema), 1, buckets))
    distinct, words_below = totals(answers, 1)
    root, below = Root(tokens, distinct), (words_below, 0)
    for order in (2, 3):

        def ask(row: pd.Series, right: pd.DataFrame, order: int = order, below: tuple[int, int] = below) -> pd.DataFrame:
            if row is None:
                return pd.DataFrame({"bucket": [], "chunk": [], "keys": [], "counts": []})
            return _asked(Chunk(row, right, buckets, shift - packed, below, shift, order), order)

        known = answers.where("chunk >= 0")
        answers = heard(_answered(_cogrouped(chunks, known, ask, asked_schema), order, buckets))
        if order == 2:
            below = words_below, totals(answers, 2)[1]

    def testify(row: pd.Series, right: pd.DataFrame) -> pd.DataFrame:
        if row is None:
            return pd.DataFrame({"bucket": [], "chunk": [], "keys": [], "counts": []})
        return _testimony(Chunk(row, right, buckets, shift - packed, below, shift), root)

    known = answers.where("chunk >= 0")
    answers = heard(_judged(_cogrouped(chunks, known, testify, asked_schema), buckets))
    out_columns = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def judge(row: pd.Series, right: pd.DataFrame) -> pd.DataFrame:
        if row is None:
            return pd.DataFrame({c: [] for c in out_columns})
        return _scored(Chunk(row, right, buckets, shift - packed, below, shift), root)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    with shuffles_removed(spark):
        scored = stored(_cogrouped(chunks, answers.where("chunk >= 0"), judge, schema), "lm-scores")
    for path in (answer_path, chunk_path):
        spark.sql(f"drop table {_name(path)}")
        delete_path(spark, path)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
