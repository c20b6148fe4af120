"""MinHash-style near-duplicate detection with SetSketch registers.

1. Every document's distinct word shingles give a fingerprint, a size and SetSketch
   registers. Documents with the same fingerprint collapse to the one with the least id.
2. Bands of register values are hashed. Representatives that share a band key are connected
   with the least of them, which gives clusters that hold every candidate pair.
3. Clusters are cut into blocks of bounded size and every pair of blocks is one group: the
   registers' joint likelihood picks the pairs that may reach the threshold, and their full
   shingle sets decide. Pairs already connected are skipped, and a group returns a forest of
   links, never all of its pairs.
4. Components of the links.

A pair at the threshold shares a band but for less than one in ten million pairs, and a cut
of 4.5 standard deviations below the threshold lets its estimate pass.

Null ids, and texts without a word, are linked with nothing. Repeated rows of one id have
the same result; different texts of one id are told apart by their fingerprints, and each
has its own. ``drop_copies`` leaves one row of every component, of repeated rows too. Sets
are compared as 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import setsketch as sk
from docloom.llm.base import as_bytes, pieces, stored, tidy
from docloom.llm.components import components, only

ROWS_PER_BAND = 4
BLOCK = 512


def sketch(docs: DataFrame, width: int = sk.WIDTH) -> DataFrame:
    """(doc_id, text_hash, n_shingles, mark, registers); mark is null for an empty set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = as_bytes(batch.column("text"))
            for first, last in pieces(bounds):
                edges = bounds[first : last + 1]
                sets = sk.shingle_sets(data[edges[0] : edges[-1]], edges - edges[0], width)
                registers = sk.sketches(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, last - first),
                        batch.column("text_hash").slice(first, last - first),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([sk.fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([r.tobytes() for r in registers], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "mark", "registers"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, n_shingles long, mark binary, registers binary"
    return rows.mapInArrow(tidy(task), schema)


def band_keys(sketched: DataFrame) -> DataFrame:
    """(key, id) for every band of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column("registers").to_pylist())
            keys = sk.bands(np.frombuffer(raw, np.uint16).reshape(-1, sk.REGISTERS), ROWS_PER_BAND)
            ids = np.repeat(batch.column("id").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"]
            )

    return sketched.select("id", "registers").mapInArrow(tidy(task), "key long, id long")


def shingle_table(docs: DataFrame, width: int = sk.WIDTH) -> DataFrame:
    """(lead, mark, shingles): fingerprint and sorted distinct hashes of each document, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = as_bytes(batch.column("text"))
            for first, last in pieces(bounds):
                edges = bounds[first : last + 1]
                sets = sk.shingle_sets(data[edges[0] : edges[-1]], edges - edges[0], width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lead").slice(first, last - first),
                        pa.array([sk.fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    names=["lead", "mark", "shingles"],
                )

    return docs.select("lead", "text").mapInArrow(tidy(task), "lead long, mark binary, shingles binary")


def in_block_pairs(members: DataFrame, sizes: DataFrame, by: str | list[str], block: int) -> DataFrame:
    """Every member once for each pair of blocks it belongs to: (by, i, j, own, ...).

    Members of a group fall into blocks by a hash of their id; groups (i, j), i <= j, hold
    two blocks, or one where i = j.
    """
    blocks = F.ceil(F.col("n_members") / block)
    spread = members.join(sizes, by).withColumn("own", F.pmod(F.xxhash64("id"), blocks))
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    paired = spread.withColumn("other", other).withColumns(
        {"i": F.least("own", "other"), "j": F.greatest("own", "other")}
    )
    return paired.drop("n_members", "other")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def linked(group: pd.DataFrame, percent: int, cut: float) -> list[tuple[int, int]]:
    """A forest of the links between members of one group's block or two blocks."""
    ids = group["id"].to_numpy()
    registers = np.frombuffer(b"".join(group["registers"]), np.uint16).reshape(-1, sk.REGISTERS)
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes = np.array([len(s) for s in sets], np.float64)
    own = group["own"].to_numpy()
    both = group["i"].iloc[0] != group["j"].iloc[0]
    forest, links = Forest(len(ids)), []
    for x in range(len(ids)):
        # Sets whose sizes are too far apart cannot reach the threshold.
        near = np.minimum(sizes[x], sizes) * 100 >= percent * np.maximum(sizes[x], sizes)
        near[: x + 1] = False
        if both:
            near &= own != own[x]
        others = np.flatnonzero(near)
        if not len(others):
            continue
        larger = (registers[x] > registers[others]).sum(axis=1)
        smaller = (registers[x] < registers[others]).sum(axis=1)
        # Equal registers are more than a true pair's share minus the same margin.
        some = sk.REGISTERS - larger - smaller >= (cut - 0.05) * sk.REGISTERS
        others, larger, smaller = others[some], larger[some], smaller[some]
        if not len(others):
            continue
        likely = sk.likely_similarity(larger, smaller, np.full(len(others), sizes[x]), sizes[others])
        for y in others[np.argsort(-likely, kind="stable")][: (likely >= cut).sum()].tolist():
            if forest.root(x) == forest.root(y):
                continue
            place = np.searchsorted(sets[y], sets[x])
            place[place == len(sets[y])] = 0
            common = int((sets[y][place] == sets[x]).sum())
            if 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                forest.join(x, y)
                links.append((int(ids[x]), int(ids[y])))
    return links


def _grouped(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, set_group) for every row of ``docs``.

    Sets are numbered, so that an id with different texts does not connect them; set_group is
    the least number in the component, null for rows that are linked with nothing.
    """
    sketched = stored(sketch(docs, width), "sketches")
    some = sketched.where(F.col("mark").isNotNull() & F.col("doc_id").isNotNull())
    distinct = some.groupBy("mark").agg(
        F.min("doc_id").alias("lead"), F.any_value("registers").alias("registers")
    )
    distinct = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct-sets")
    keys = stored(band_keys(distinct), "band-keys")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.count("id").alias("n"))
    pairs = keys.join(shared.where("n > 1").drop("n"), "key").where(F.col("id") != F.col("least"))
    clusters = components(pairs.select(F.col("id").alias("a"), F.col("least").alias("b")).distinct())
    clusters = stored(clusters.withColumnRenamed("component", "cluster"), "clusters")
    members = clusters.join(distinct, "id")
    texts = docs.select(F.col("doc_id").cast("long").alias("lead"), "text")
    sets = shingle_table(only(texts, members.select("lead").distinct(), "left_semi", "lead"), width)
    members = members.join(sets.dropDuplicates(["lead", "mark"]), ["lead", "mark"]).drop("lead", "mark")
    sizes = clusters.groupBy("cluster").agg(F.count("id").alias("n_members"))
    cut = percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / sk.REGISTERS) ** 0.5

    def task(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked(group, percent, cut), columns=["a", "b"], dtype="int64")

    grouped = in_block_pairs(members, sizes, "cluster", BLOCK).groupBy("cluster", "i", "j")
    links = grouped.applyInPandas(task, "a long, b long")
    found = components(links).withColumnRenamed("component", "set_group")
    whole = distinct.select("mark", "lead", "id").join(found, "id", "left")
    whole = whole.select("mark", "lead", F.coalesce("set_group", "id").alias("set_group"))
    names = whole.groupBy("set_group").agg(F.min("lead").alias("component_id"))
    whole = whole.drop("lead").join(names, "set_group")
    out = sketched.drop("registers").join(whole, "mark", "left")
    has_id = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        F.when(has_id, F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(has_id, F.col("set_group")).alias("set_group"),
    )


def near_copies(docs: DataFrame, percent: int = 85, width: int = sk.WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    return _grouped(docs, percent, width).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, percent: int = 85, width: int = sk.WIDTH) -> DataFrame:
    """``docs`` with one row of every component: of its least id, and there of the least hash.

    Rows without an id or a word stay, all of them.
    """
    keys = ["_id", "_text_hash"]
    if clash := set(keys) & set(docs.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    found = _grouped(docs, percent, width).where("set_group is not null")
    kinds = found.groupBy("set_group", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text_hash"))
    kinds = stored(kinds.agg(F.count("n_shingles").alias("times")), "copies")
    least = kinds.groupBy("set_group").agg(F.min(F.struct(*keys)).alias("one"))
    judged = kinds.join(least, "set_group").withColumn("stands", F.struct(*keys) == F.col("one"))
    judged = stored(judged.where("not stands or times > 1").select(*keys, "stands"), "copies")
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text_hash": F.xxhash64("text")})
    left = only(keyed, judged.where("not stands").select(*keys), "left_anti", keys)
    several = judged.where("stands").select(*keys)
    once = only(left, several, "left_anti", keys)
    twice = only(left, several, "left_semi", keys).dropDuplicates(keys)
    return once.unionByName(twice).select(*docs.columns)
