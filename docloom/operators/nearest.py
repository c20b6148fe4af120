"""Exact top-k cosine search.

Scores of a vector block against the queries of its namespace are one matrix product in
NumPy; each task keeps only its k best per query, and those few rows are ranked by Spark. No
(query, vector) pair is ever a row. A batch of queries that fits into one wave is the common
case: it is sent to the vectors, and no vector is shuffled. More queries meet the vectors in a
grid of blocks, by a shuffle, and never pass the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULTS, Settings
from docloom.operators.skew import top_n
from docloom.session import work_path

# Scores are compared after rounding, so equal vectors tie whatever the order of
# the sums, and ties go to the smaller id.
SCORE_DIGITS = 9
# Doubles of the queries, and of the vectors, that one cell of the grid holds at most.
CELL_BYTES = 32 * 1024 * 1024
# Cells have at least this many queries or vectors where a namespace has them.
LEAST_SIDE = 1024
# Partitions of the grid at most.
MAX_PARTITIONS = 4096


class QueryBlock:
    """Queries as arrays, with the running best hits of one task."""

    def __init__(self, table):
        import numpy as np

        self.ids = table.column("query_id").combine_chunks()
        spaces = table.column("namespace").combine_chunks().dictionary_encode()
        self.spaces = spaces.dictionary
        self.space_of = spaces.indices.to_numpy()
        # The queries of each namespace, in order.
        order = np.argsort(self.space_of, kind="stable")
        edges = np.searchsorted(self.space_of[order], np.arange(len(self.spaces) + 1))
        self.queries = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
        self.top_k = table.column("top_k").to_numpy().astype(int)
        self.floor = table.column("similarity_threshold").to_numpy().astype(float)
        self.matrix = _unit_rows(_matrix(table.column("query_vector").combine_chunks()))
        self.best = None

    def add(self, batch, step: int = 512) -> None:
        """Score a batch of (namespace, id, values) and keep what can still win.

        Every namespace's vectors meet that namespace's queries only.
        """
        import numpy as np
        import pandas as pd
        import pyarrow.compute as pc

        if batch.num_rows == 0 or len(self.top_k) == 0:
            return
        space = pc.index_in(batch.column("namespace"), self.spaces)
        space = pc.fill_null(space, -1).to_numpy()
        ids, values, found = batch.column("id"), batch.column("values"), []
        for own in np.unique(space[space >= 0]):
            rows = np.flatnonzero(space == own)
            # In order of the ids, so that positions break ties.
            rows = rows[pc.sort_indices(ids.take(_index(rows))).to_numpy()]
            vectors = _unit_rows(_matrix(values.take(_index(rows))))
            kept = _few_copies(vectors, int(self.top_k[self.queries[own]].max()))
            rows, vectors = rows[kept], vectors[kept]
            rough = vectors.astype(np.float32)
            for lo in range(0, len(self.queries[own]), step):
                asked = self.queries[own][lo : lo + step]
                q, v, s = self._best_of(asked, vectors, rough)
                found.append((asked[q], rows[v], s))
        q, v, s = (np.concatenate(x) for x in zip(*found)) if found else ((), (), ())
        if not len(q):
            return
        new = pd.DataFrame({"q": q, "id": ids.take(_index(v)).to_pylist(), "score": s})
        self.best = self._trim(new if self.best is None else pd.concat([self.best, new]))

    def _best_of(self, asked, vectors, rough, chunk: int = 4096):
        """Query, vector and score of the best vectors of some queries; ties go to the first.

        Products in single precision tell which pairs can reach a query's floor at all; those
        few are scored in double precision.
        """
        import numpy as np

        matrix, floor, top_k = self.matrix[asked], self.floor[asked], self.top_k[asked]
        single, k = matrix.astype(np.float32), int(top_k.max())
        # More than what the product of two unit rows loses in single precision.
        margin = (matrix.shape[1] + 16) * 2.0**-23 + 10.0**-SCORE_DIGITS
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        lo = 0
        while lo < len(rough):
            # A short first chunk sets the floors.
            hi = min(len(rough), lo + (chunk if lo else max(1024, 4 * k)))
            products = single @ rough[lo:hi].T
            bar = (floor - margin).astype(np.float32)[:, None] - np.float32(1e-6)
            usable = products >= bar
            if hi - lo > k and np.count_nonzero(usable) > 8 * k * len(asked):
                ranked = np.where(usable, products, np.float32(-np.inf))
                cut = np.partition(ranked, hi - lo - k, axis=1)[:, hi - lo - k]
                usable &= products >= (cut - np.float32(2 * margin))[:, None]
            at = np.flatnonzero(usable)
            if len(at):
                q, v = at // (hi - lo), at % (hi - lo) + lo
                scores = _products(matrix, vectors, q, v)
                good = scores >= floor[q]
                best = tuple(np.concatenate(x) for x in zip(best, (q[good], v[good], scores[good])))
                order = np.lexsort((best[1], -best[2], best[0]))
                q, v, scores = (x[order] for x in best)
                place = np.arange(len(q)) - np.searchsorted(q, q)
                best = tuple(x[place < top_k[q]] for x in (q, v, scores))
                last = place == top_k[q] - 1
                floor[q[last]] = np.maximum(floor[q[last]], scores[last])
            lo = hi
        return best

    def _trim(self, rows):
        """The best rows of each query; a query with all it asks for raises its floor."""
        import numpy as np

        rows = rows.sort_values(["q", "score", "id"], ascending=[True, False, True])
        q = rows["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rows[place < self.top_k[q]]
        last = rows[place == self.top_k[q] - 1]
        at = last["q"].to_numpy()
        self.floor[at] = np.maximum(self.floor[at], last["score"].to_numpy())
        return kept

    def hits(self, schema):
        """Best hits so far as one Arrow batch."""
        import pyarrow as pa

        if self.best is None or self.best.empty:
            return pa.RecordBatch.from_pylist([], schema=schema)
        q = self.best["q"].to_numpy()
        columns = [
            self.ids.take(_index(q)),
            self.spaces.take(_index(self.space_of[q])),
            pa.array(self.best["id"].tolist(), pa.string()),
            pa.array(self.best["score"].to_numpy(), pa.float64()),
            pa.array(self.top_k[q], pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def _index(positions):
    import pyarrow as pa

    return pa.array(positions, pa.int64())


def _matrix(lists):
    """List column as a dense double matrix; all rows have the same width."""
    import numpy as np

    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _products(left, right, rows, columns, step: int = 1 << 16):
    """Rounded scores of single pairs, some at a time."""
    import numpy as np

    parts = [
        np.einsum("ij,ij->i", left[rows[lo : lo + step]], right[columns[lo : lo + step]])
        for lo in range(0, len(rows), step)
    ]
    return np.round(np.concatenate(parts), SCORE_DIGITS)


def _few_copies(matrix, k: int):
    """Positions of the rows that have fewer than ``k`` equal rows before them."""
    import numpy as np

    if len(matrix) <= k:
        return np.arange(len(matrix))
    # Equal rows have equal keys; rows of equal keys are compared whole.
    weights = np.random.default_rng(1).standard_normal(matrix.shape[1])
    order = np.argsort((matrix * weights).sum(axis=1), kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = (matrix[order[1:]] != matrix[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(first)
    place = np.arange(len(order)) - starts[np.cumsum(first) - 1]
    return np.sort(order[place < k])


def _unit_rows(matrix):
    """Rows scaled to length one; zero rows stay zero, so their similarity is 0.0."""
    import numpy as np

    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1.0, length)


def _hit_schema(queries: DataFrame) -> T.StructType:
    id_type = queries.schema["query_id"].dataType
    return (
        T.StructType()
        .add("query_id", id_type)
        .add("namespace", "string")
        .add("id", "string")
        .add("score", "double")
        .add("top_k", "integer")
    )


def prepare_queries(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Fill namespace, result count and threshold where a query leaves them out."""
    cols = queries.columns
    ns = F.col("namespace") if "namespace" in cols else F.lit(None)
    k = F.col("top_k") if "top_k" in cols else F.lit(None)
    floor = F.col("similarity_threshold") if "similarity_threshold" in cols else F.lit(None)
    return queries.select(
        "query_id",
        "query_vector",
        F.coalesce(ns.cast("string"), F.lit(settings.namespace)).alias("namespace"),
        F.coalesce(k.cast("int"), F.lit(settings.top_k)).alias("top_k"),
        F.coalesce(floor.cast("double"), F.lit(-2.0)).alias("similarity_threshold"),
    )


def query_rejects(
    queries: DataFrame, dimension: int, settings: Settings = DEFAULTS
) -> DataFrame:
    """The queries that ``nearest`` cannot answer: ``query_id, namespace, top_k, reason``."""
    size = F.coalesce(F.size("query_vector"), F.lit(-1))
    reason = F.when(size != dimension, "vector size").when(F.col("top_k") < 1, "top_k")
    return (
        prepare_queries(queries, settings)
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("query_id", "namespace", "top_k", "reason")
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    dimension: int,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """``query_id, namespace, id, score, rank`` of the k best records per query.

    ``queries`` is a stored or checkpointed table with ``query_id, query_vector`` and
    optional ``namespace, top_k, similarity_threshold``. Up to ``broadcast_query_bytes`` of
    queries are sent to all tasks and the vectors are scanned where they lie; more queries and
    the vectors are dealt into blocks that meet in a shuffle. The candidates of all tasks are
    ranked in two levels. Every query gets as many
    hits as it asks for; ``query_rejects`` lists those that cannot be answered.
    """
    answerable = (F.size("query_vector") == dimension) & (F.col("top_k") >= 1)
    queries = prepare_queries(queries, settings).where(answerable)
    # The threshold is applied to the score before the rank.
    records = vectors.where(F.size("values") == dimension).select("namespace", "id", "values")
    schema = _hit_schema(queries)
    limit = max(1, settings.broadcast_query_bytes // (8 * dimension))
    batch = queries.limit(limit + 1).toArrow()
    if batch.num_rows <= limit:
        wanted = batch.column("top_k").to_pylist()
        hits = _ranked(_wave(records, batch, schema), max(wanted, default=1), settings)
        # A single wave has a known number of hits: joins may broadcast them.
        return hits.hint("broadcast") if sum(wanted) <= settings.broadcast_hits else hits
    return _ranked(_grid(records, queries, dimension, schema, settings), None, settings)


def _ranked(candidates: DataFrame, at_most: int | None, settings: Settings) -> DataFrame:
    order = [F.desc("score"), F.asc("id")]
    best = top_n(
        candidates, ["query_id"], order, F.col("top_k"), ["id"], at_most=at_most, settings=settings
    )
    return best.select("query_id", "namespace", "id", "score", "rank")


def _wave(records: DataFrame, batch, schema: T.StructType) -> DataFrame:
    """Each task's best hits for one wave of queries; a narrow step over the vectors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = records.sparkSession.sparkContext.broadcast(batch)
    out = to_arrow_schema(schema)
    # Namespaces nobody asks for are pruned before they are read.
    spaces = batch.column("namespace").unique().to_pylist()

    def run(batches):
        block = QueryBlock(shared.value)
        for part in batches:
            block.add(part)
        yield block.hits(out)

    return records.where(F.col("namespace").isin(sorted(spaces))).mapInArrow(run, schema)


def _grid(records: DataFrame, queries: DataFrame, dimension: int, schema: T.StructType,
          settings: Settings) -> DataFrame:
    """Candidates of more queries than one wave holds.

    A namespace's queries are dealt into blocks by their ids, and so are its vectors; a cell is
    a block of queries with a block of vectors. Blocks are as large as a task may hold, so both
    sides are repeated as rarely as can be, or smaller where there are tasks to spare. The
    driver sees three numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, cell = records.sparkSession, ["namespace", "_asked", "_held"]
    sizes = (
        queries.groupBy("namespace").agg(F.count(F.lit(1)).alias("_q"))
        .join(records.groupBy("namespace").agg(F.count(F.lit(1)).alias("_v")), "namespace")
    )
    # Counting takes a scan of both sides; it is done once.
    path = work_path(spark, "sizes")
    sizes.write.parquet(path)
    sizes = spark.read.schema(sizes.schema).parquet(path)
    total = sizes.agg(
        F.count(F.lit(1)).alias("spaces"),
        F.coalesce(F.sum(F.col("_q").cast("double") * F.col("_v")), F.lit(0.0)).alias("pairs"),
    ).first()
    spare = (total["pairs"] / (4 * spark.sparkContext.defaultParallelism)) ** 0.5
    side = max(1, CELL_BYTES // (8 * dimension))
    side = min(side, max(LEAST_SIDE, int(spare) + 1))
    sizes = sizes.select("namespace", *[F.ceil(F.col(c) / side).alias(c) for c in ("_q", "_v")])
    cells = sizes.agg(F.sum(F.col("_q") * F.col("_v")).alias("n")).first()["n"]
    parts = max(1, min(MAX_PARTITIONS, cells or 1))
    if total["spaces"] <= settings.broadcast_hits:
        sizes = F.broadcast(sizes)

    def dealt(rows: DataFrame, key: str, own: str, count: str, others: str, times: str):
        block = F.pmod(F.xxhash64(key), F.col(count))
        repeats = F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1))
        placed = rows.join(sizes, "namespace").withColumn(own, block).withColumn(others, repeats)
        return placed.drop("_q", "_v").repartition(parts, *cell).groupBy(*cell)

    out = to_arrow_schema(schema)

    def score(asked, held):
        import pyarrow as pa

        block = QueryBlock(asked)
        for part in held.combine_chunks().to_batches():
            block.add(part)
        return pa.Table.from_batches([block.hits(out)])

    asked = dealt(queries, "query_id", "_asked", "_q", "_held", "_v")
    held = dealt(records, "id", "_held", "_v", "_asked", "_q")
    # Stored, so that a lost executor repeats cells, and no later step the whole grid.
    found = work_path(spark, "candidates")
    asked.cogroup(held).applyInArrow(score, schema).write.parquet(found)
    return spark.read.schema(schema).parquet(found)
