"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations.

A hash rotates a unit vector (three rounds of sign flips and Hadamard transforms) and takes
the largest coordinate and its sign: the nearest corner of a cross-polytope. ``HASHES`` of
them make a cell, ``TABLES`` cells are drawn per vector, and each hash also probes its next
best corner, so a vector stands in 2^HASHES cells of every table. Two vectors meet in a
table if every hash has a corner in common; at a cosine of 0.93 and 64 dimensions that fails
in all twelve tables for about one pair in a million. Pairs that meet are verified by their
cosine in double precision.

Equal vectors of a label collapse before hashing and count as links of each other. Cells are
cut into pairs of blocks of bounded size, so no task gets an unbounded cell; a pair that
meets several times is counted where it meets first, which both sides' corners tell. A task
returns one row per vector, its links counted and one forest edge, never the pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows without label
or id, are linked with nothing. Only vectors of equal label and size are compared. Different
vectors are numbered, so a vec_id that recurs, under another label or with another vector,
connects nothing; each of its rows has the links of its own vector. Other columns are neither
read nor kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import mixed, stored
from docloom.llm.components import components
from docloom.llm.near_copies import in_block_pairs

TABLES = 12
HASHES = 3
BLOCK = 1024
# Cells of so few members are looked at together, pair by pair, so many pairs at a time.
SMALL = 8
PAIRS = 1 << 15


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled first, so that no square overflows."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, whose size is a power of two."""
    n, size = x.shape
    reach = 1
    while reach < size:
        halves = x.reshape(n, -1, 2, reach)
        x = np.concatenate([halves[:, :, :1] + halves[:, :, 1:], halves[:, :, :1] - halves[:, :, 1:]], axis=2)
        x = x.reshape(n, size)
        reach *= 2
    return x


def corners(units: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """The two best corners (vectors x tables x hashes x 2) of each rotation."""
    n, dimension = units.shape
    size = _size(dimension)
    padded = np.zeros((n, size))
    padded[:, :dimension] = units
    out = np.empty((n, tables, hashes, 2), np.int64)
    rows = np.arange(n)
    for k in range(tables * hashes):
        x = padded
        for turn in range(3):
            seeds = np.arange(size, dtype=np.uint64) + np.uint64((3 * k + turn) * 1_000_003 + 1)
            signs = np.where(mixed(seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63), 1.0, -1.0)
            x = _hadamard(x * signs)
        reach = np.abs(x)
        for rank in range(2):
            best = reach.argmax(axis=1)
            out[:, k // hashes, k % hashes, rank] = 2 * best + (x[rows, best] > 0)
            reach[rows, best] = -1
    return out


def _cells(found: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all cells (vectors x cells) that the corners name."""
    n, tables, hashes, _ = found.shape
    cells = np.broadcast_to(np.arange(tables)[None, :, None], (n, tables, 1))
    for k in range(hashes):
        cells = (cells[..., None] * (2 * size) + found[:, :, k][:, :, None, :]).reshape(n, tables, -1)
    return cells.reshape(n, -1)


def prepare(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, mark, size, units): mark is null for vectors that link with nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, units, sizes = [], [], []
            for value in batch.column("embedding"):
                own = value.values if value.is_valid else pa.array([], pa.float64())
                x = own.cast(pa.float64()).to_numpy(zero_copy_only=False) if own.null_count == 0 else np.empty(0)
                good = len(x) > 0 and np.isfinite(x).all() and (x != 0).any()
                marks.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if good else None)
                units.append(unit(x[None])[0].tobytes() if good else None)
                sizes.append(len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), pa.array(marks, pa.binary()),
                    pa.array(sizes, pa.int32()), pa.array(units, pa.binary()),
                ],
                names=["vec_id", "label", "mark", "size", "units"],
            )

    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    return rows.mapInArrow(task, "vec_id long, label string, mark binary, size int, units binary")


def _size(dimension: int) -> int:
    return max(2, 1 << (dimension - 1).bit_length())


def with_corners(distinct: DataFrame) -> DataFrame:
    """``distinct`` with each vector's corners, packed."""
    schema = f"{', '.join(f'{n} {t}' for n, t in distinct.dtypes)}, corners binary"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            units = batch.column("units").to_pylist()
            for dimension in np.unique(sizes):
                at = np.flatnonzero(sizes == dimension)
                for low in range(0, len(at), 4096):
                    own = at[low : low + 4096]
                    x = np.frombuffer(b"".join(units[i] for i in own), np.float64).reshape(len(own), -1)
                    packed = pa.array([c.astype(np.int32).tobytes() for c in corners(x)], pa.binary())
                    rows = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*rows.columns, packed], names=[*batch.schema.names, "corners"])

    return distinct.mapInArrow(task, schema)


def _unpacked(packed: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.int32).reshape(-1, TABLES, HASHES, 2)


def cell_table(distinct: DataFrame) -> DataFrame:
    """(label, size, cell, id) for every cell of every vector."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            packed = batch.column("corners").to_pylist()
            for dimension in np.unique(sizes):
                at = np.flatnonzero(sizes == dimension)
                cells = _cells(_unpacked([packed[i] for i in at]).astype(np.int64), _size(int(dimension)))
                rows = pa.array(np.repeat(at, cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("label").take(rows), batch.column("size").take(rows),
                        pa.array(cells.reshape(-1)), batch.column("id").take(rows),
                    ],
                    names=["label", "size", "cell", "id"],
                )

    return distinct.select("label", "size", "id", "corners").mapInArrow(
        task, "label string, size int, cell long, id long"
    )


def _meet(found: np.ndarray) -> np.ndarray:
    """Which pairs of vectors have a corner in common in every hash of one table.

    ``found`` is vectors x hashes x 2; whole matrices of small integers are compared.
    """
    both = np.ones((len(found), len(found)), bool)
    for k in range(found.shape[1]):
        low, high = found[:, k, 0], found[:, k, 1]
        shared = low[:, None] == low[None]
        shared |= high[:, None] == high[None]
        crossed = low[:, None] == high[None]
        shared |= crossed
        shared |= crossed.T
        both &= shared
    return both


def _named(cells: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The table of each cell and its corner in each hash."""
    codes = []
    for _ in range(HASHES):
        cells, code = np.divmod(cells, 2 * size)
        codes.insert(0, code)
    return cells, np.stack(codes, axis=-1)


def _cell_links(x: np.ndarray, found: np.ndarray, ids: np.ndarray, times: np.ndarray,
                apart: np.ndarray | None, cell: int, least: float) -> tuple[np.ndarray, ...]:
    """(id, links, up) of one cell's block or two blocks, pairs that met before left out.

    ``apart`` has the block of each member where there are two.
    """
    close = x @ x.T >= least
    np.fill_diagonal(close, False)
    if apart is not None:
        close &= apart[:, None] != apart[None]
    if close.any():
        table, named = _named(np.int64(cell), _size(x.shape[1]))
        # All have the cell's corner in each hash. Of a pair that shares its other corner, too,
        # the lesser of both names the cell of its meeting.
        for k in range(HASHES):
            low, high = found[:, table, k, 0], found[:, table, k, 1]
            other = np.where(low == named[k], high, low).astype(np.int64)
            other = np.where(other < named[k], other, -1 - np.arange(len(ids)))
            close &= other[:, None] != other[None]
        for before in range(table):
            left = np.flatnonzero(close.any(axis=1))
            if not len(left):
                break
            # Vectors whose pairs have all met need no further table.
            at = np.ix_(left, left)
            close[at] &= ~_meet(np.ascontiguousarray(found[left, before]))
    links = (close.astype(np.float64) @ times).astype(np.int64)
    some = np.flatnonzero(links)
    roots = some[_least_reachable(close[np.ix_(some, some)], ids[some])]
    return ids[some], links[some], ids[roots]


def _pair_links(x: np.ndarray, found: np.ndarray, ids: np.ndarray, times: np.ndarray, cells: np.ndarray,
                a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """The same for many small cells at once; ``a`` and ``b`` are the pairs of their members."""
    near = np.concatenate(
        [np.einsum("ij,ij->i", x[a[at : at + PAIRS]], x[b[at : at + PAIRS]]) >= least for at in range(0, len(a), PAIRS)]
        or [np.empty(0, bool)]
    )
    a, b = a[near], b[near]
    table, named = _named(cells[a], _size(x.shape[1]))
    first = np.ones(len(a), bool)
    for k in range(HASHES):
        others = []
        for side in (a, b):
            own = found[side, table, k]
            others.append(np.where(own[:, 0] == named[:, k], own[:, 1], own[:, 0]))
        first &= (others[0] != others[1]) | (others[0] > named[:, k])
    a, b, table = a[first], b[first], table[first]
    for before in range(TABLES - 1):
        one, two = found[a, before], found[b, before]
        shared = (one[..., :, None] == two[..., None, :]).any(axis=(2, 3)).all(axis=1)
        keep = ~shared | (table <= before)
        a, b, table = a[keep], b[keep], table[keep]
    low = np.minimum(ids[a], ids[b])
    return np.concatenate([ids[a], ids[b]]), np.concatenate([times[b], times[a]]), np.concatenate([low, low])


def _group_starts(rows: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """First rows of the groups of sorted rows."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in by:
        column = rows.column(c)
        differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _links_of(rows: pa.RecordBatch, starts: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(id, links, up) of whole groups: small ones together, each larger one by itself."""
    edges = np.append(starts, rows.num_rows)
    counts = np.diff(edges)
    ids, times, own, cells, i, j, size = (
        rows.column(c).to_numpy() for c in ("id", "times", "own", "cell", "i", "j", "size")
    )
    units, corners_ = rows.column("units"), rows.column("corners")

    def vectors(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units and corners of rows of one size."""
        x = np.frombuffer(b"".join(units.take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1)
        found = _unpacked(corners_.take(pa.array(at)).to_pylist())
        return x, found.astype(np.int16) if x.shape[1] <= 1 << 13 else found

    for dimension in np.unique(size[starts]):
        small = (counts <= SMALL) & (size[starts] == dimension)
        at = np.flatnonzero(np.repeat(small, counts))
        if len(at):
            place = np.zeros(rows.num_rows, np.int64)
            place[at] = np.arange(len(at))
            pairs = []
            for n in range(2, SMALL + 1):
                first = starts[small & (counts == n)]
                pairs += [(first[:, None] + side).ravel() for side in np.triu_indices(n, 1)]
            a, b = np.concatenate(pairs[::2]), np.concatenate(pairs[1::2])
            whole = (i[a] == j[a]) | (own[a] != own[b])
            x, found = vectors(at)
            yield _pair_links(x, found, ids[at], times[at], cells[at], place[a[whole]], place[b[whole]], least)
    for k in np.flatnonzero(counts > SMALL).tolist():
        at = np.arange(edges[k], edges[k + 1])
        apart = own[at] if i[at[0]] != j[at[0]] else None
        x, found = vectors(at)
        yield _cell_links(x, found, ids[at], times[at], apart, int(cells[at[0]]), least)


def cell_links(members: DataFrame, by: list[str], least: float) -> DataFrame:
    """(id, links, up) for the members of cells, dealt as pairs of blocks (by, i, j).

    Sorted, the groups of a task follow each other, so small ones are looked at by thousands.
    """
    group = [*by, "i", "j"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def made(rows: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for parts in _links_of(rows, starts, least):
                columns = [pa.array(np.asarray(p, np.int64)) for p in parts]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "links", "up"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch
            if held is not None:
                rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            starts = _group_starts(rows, group)
            # The last group may go on in the next batch.
            if starts[-1]:
                yield from made(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1])
        if held is not None:
            yield from made(held, np.zeros(1, np.int64))

    wanted = members.select(*group, "own", "id", "times", "units", "corners")
    dealt = wanted.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInArrow(task, "id long, links long, up long")


def _least_reachable(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of an adjacency matrix, the row of the least id reachable."""
    roots, waiting = np.arange(len(ids)), np.ones(len(ids), bool)
    for start in np.argsort(ids, kind="stable").tolist():
        if not waiting[start]:
            continue
        waiting[start], edge = False, [start]
        while edge:
            fresh = near[edge.pop()] & waiting
            waiting &= ~fresh
            reached = np.flatnonzero(fresh)
            roots[reached] = start
            edge += reached.tolist()
    return roots


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    prepared = stored(prepare(vectors), "vectors")
    able = F.col("mark").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    key = ["label", "mark"]
    distinct = prepared.where(able).groupBy(*key).agg(
        F.min("vec_id").alias("lead"),
        F.count("vec_id").alias("times"),
        F.any_value("size").alias("size"),
        F.any_value("units").alias("units"),
    )
    distinct = with_corners(distinct.withColumn("id", F.monotonically_increasing_id()))
    distinct = stored(distinct, "distinct-vectors")
    cells = stored(cell_table(distinct), "cells")
    by = ["label", "size", "cell"]
    sizes = cells.groupBy(*by).agg(
        F.count("id").alias("n_members"),
        F.min("id").alias("least"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members"),
    )
    # Cells with the same members tell the same: the first of them, where all of their pairs
    # that meet for the first time do so, stands for the others.
    sizes = sizes.where("n_members > 1").groupBy("label", "size", "n_members", "least", "members")
    sizes = sizes.agg(F.min("cell").alias("cell")).select(*by, "n_members")
    wide = distinct.select("id", "times", "units", "corners")
    members = in_block_pairs(cells, sizes, by, BLOCK).join(wide, "id")

    found = cell_links(members, by, least)
    found = stored(found, "vector-links")
    joined = components(found.select(F.col("id").alias("a"), F.col("up").alias("b")))
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = distinct.select(*key, "id", "lead", "times")
    whole = whole.join(counted, "id", "left").join(joined, "id", "left").select(
        *key,
        "lead",
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("group"),
    )
    # A component is named after the least vec_id in it.
    names = whole.groupBy("group").agg(F.min("lead").alias("component_id"))
    whole = whole.drop("lead").join(names, "group").drop("group")
    out = prepared.select("vec_id", *key).join(whole, key, "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.when(able, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
