"""The stored vector table: append-only batches, read as a latest-wins view.

Below the table's folder:

* ``changes/seq=N``: one write each, never touched again. ``kind=change`` holds records and
  deletion marks, ``kind=reject`` records that break the contract, ``kind=drop`` names of
  namespaces emptied as a whole.
* ``base/seq=S``: a compaction, which stands for all changes up to S.

A folder counts once Spark has put its ``_SUCCESS`` file there, so a write that breaks leaves
nothing visible and is simply run again. Writing costs what the batch holds: no stored file is
read or replaced. Reading drops the records whose key occurs in a later change; keys of the
changes since the last compaction go to every task while they are few, by measured bytes.
Records are partitioned by namespace and hash bucket of the id, so a namespace of any size is
spread evenly and a lookup by id opens only its bucket. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators import vectors as ops
from docloom.operators.filters import one_of
from docloom.schemas import VECTORS
from docloom.session import complete_numbers, delete_path, numbers, path_exists, work_path

PART = ["namespace", "bucket"]
RECORD = ["namespace", "id", "document_id", "values", "metadata"]
_BASE = f"{VECTORS}, bucket INT"
_MARKS = "deleted BOOLEAN, copies BIGINT, reject_reason STRING, kind STRING, bucket INT"
_CHANGES = f"{VECTORS}, {_MARKS}, seq BIGINT"


def _nulls(*fields: str) -> list[Column]:
    """Null columns from "name TYPE"."""
    return [F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, fields)]


Scope = Callable[[DataFrame], DataFrame]


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, dimension: int, buckets: int = 16,
                 settings: Settings = DEFAULTS):
        """``buckets`` is fixed for the life of the table; choose it so that one bucket
        of the largest namespace stays within a few hundred megabytes."""
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        self.buckets, self.settings = buckets, settings

    # Folders

    def _folder(self, kind: str, seq: int) -> str:
        return f"{self.path}/{kind}/seq={seq}"

    def _next(self) -> int:
        used = [n for kind in ("base", "changes") for n in numbers(self.spark, f"{self.path}/{kind}")]
        return max(used, default=0) + 1

    def batches(self, upto: int | None = None) -> tuple[int | None, list[int]]:
        """The last complete compaction and the complete changes after it, in order; with
        ``upto`` those that made the table what it was after that write."""
        bases = complete_numbers(self.spark, f"{self.path}/base")
        done = complete_numbers(self.spark, f"{self.path}/changes")
        base = max((n for n in bases if upto is None or n <= upto), default=None)
        after = [n for n in sorted(done) if base is None or n > base]
        return base, [n for n in after if upto is None or n <= upto]

    def _bucket(self):
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")

    # Reading

    def _change_rows(self, seqs: list[int]) -> DataFrame:
        read = self.spark.read.schema(_CHANGES).option("basePath", f"{self.path}/changes")
        return read.parquet(*[self._folder("changes", n) for n in seqs])

    def _live(self, scope: Scope = lambda rows: rows, upto: int | None = None) -> DataFrame:
        """The live records with their bucket. ``scope`` narrows stored rows by namespace,
        bucket or id ahead of the merge."""
        base, seqs = self.batches(upto)
        kept = [*RECORD, "bucket"]
        stored = []
        if base is not None:
            read = self.spark.read.schema(_BASE).parquet(self._folder("base", base))
            marks = F.lit(base).cast("long").alias("seq"), F.lit(False).alias("deleted")
            stored.append(scope(read).select(*kept, *marks))
        if seqs:
            changes = self._change_rows(seqs)
            records = scope(changes.where("kind = 'change'")).select(*kept, "seq", "deleted")
            stored.append(records)
        if not stored:
            return self.spark.createDataFrame([], _BASE).select(*kept)
        rows = stored[0] if len(stored) == 1 else stored[0].unionByName(stored[1])
        last = self._drops(seqs)
        if last is not None:
            emptied = (rows["namespace"] == last["_space"]) & (rows["seq"] < last["_drop"])
            rows = rows.join(last, emptied, "left_anti")
        if len(seqs) + (base is not None) > 1:
            newer = records.groupBy(F.col("namespace").alias("_space"), F.col("id").alias("_id")).agg(
                F.max("seq").alias("_last")
            )
            if self._key_bytes(records) <= self.settings.broadcast_key_bytes:
                newer = F.broadcast(newer)
            same = (rows["namespace"] == newer["_space"]) & (rows["id"] == newer["_id"])
            rows = rows.join(newer, same & (newer["_last"] > rows["seq"]), "left_anti")
        return rows.where(~F.col("deleted")).select(*kept)

    def _drops(self, seqs: list[int]) -> DataFrame | None:
        """(_space, _drop): the last of these writes that emptied each namespace, if any did."""
        dropped = [n for n in seqs if path_exists(self.spark, f"{self._folder('changes', n)}/kind=drop")]
        if not dropped:
            return None
        drops = self._change_rows(dropped).where("kind = 'drop'")
        return drops.groupBy(F.col("namespace").alias("_space")).agg(F.max("seq").alias("_drop"))

    @staticmethod
    def _key_bytes(records: DataFrame) -> int:
        """Bytes of the changed keys; reads the id column of the changes only."""
        size = F.octet_length("id") + F.octet_length("namespace") + 24
        return records.agg(F.sum(size).alias("n")).first()["n"] or 0

    def read(self) -> DataFrame:
        return self._live().drop("bucket")

    def rejects(self) -> DataFrame:
        """Records that upserts refused, with the number of the write and the reason."""
        seqs = sorted(complete_numbers(self.spark, f"{self.path}/changes"))
        if not seqs:
            return self.spark.createDataFrame([], _CHANGES).select("seq", *RECORD, "reject_reason")
        refused = self._change_rows(seqs).where("kind = 'reject'")
        return refused.select("seq", *RECORD, "reject_reason")

    def _scope_of(self, keys: list) -> Scope:
        """The rows whose namespace, bucket and id occur in ``keys``, as a filter that
        reaches the partitions and the sorted pages."""
        names = {c: sorted({k[c] for k in keys}) for c in (*PART, "id")}
        return lambda rows: rows.where(
            one_of("namespace", names["namespace"])
            & F.col("bucket").isin(names["bucket"])
            & one_of("id", names["id"])
        )

    def fetch(self, ids: DataFrame, namespace: str | None = None) -> DataFrame:
        """Records with the given ids; up to ``pushed_ids`` of them go into the scan."""
        space = F.lit(namespace or self.settings.namespace).alias("namespace")
        keys = ids.where("id is not null").select(space, "id").distinct()
        keys = keys.withColumn("bucket", self._bucket())
        few = keys.limit(self.settings.pushed_ids + 1).collect()
        if len(few) <= self.settings.pushed_ids:
            return self._live(self._scope_of(few)).drop("bucket")
        return self._live(lambda rows: rows.join(keys, [*PART, "id"], "left_semi")).drop("bucket")

    def lookup(self, hits: DataFrame, *columns: str) -> DataFrame:
        """Search hits with ``columns`` of their records.

        Hits are stored first, so the search runs once. Up to ``pushed_ids`` ids go into the
        scan as a filter: only the buckets and the pages of the sorted files that hold a hit
        are read. More hits meet their buckets' records in a join.
        """
        stage = work_path(self.spark, "hits")
        hits.withColumn("bucket", self._bucket()).write.parquet(stage)
        keyed = self.spark.read.parquet(stage)
        total = keyed.count()
        if total <= self.settings.pushed_ids:
            live = self._live(self._scope_of(keyed.select(*PART, "id").distinct().collect()))
        else:
            live = self._live()
        stored = live.select(*PART, "id", *columns)
        if total <= self.settings.broadcast_hits:
            keyed = F.broadcast(keyed)
        return keyed.join(stored, [*PART, "id"]).drop("bucket")

    # Writing

    def _write(self, rows: DataFrame, folder: str, *parts: str) -> None:
        """Sorted by id: ids begin with their document's id, so filters on either skip row
        groups and pages by their statistics. Large partitions are written by several tasks."""
        (
            rows.hint("rebalance", *PART)
            .sortWithinPartitions(*parts, "id")
            .write.mode("overwrite")
            .partitionBy(*parts)
            .parquet(folder)
        )

    def _append(self, rows: DataFrame, seq: int) -> None:
        self._write(rows, self._folder("changes", seq), "kind", *PART)

    def _taken(self, seq: int) -> bool:
        return seq in complete_numbers(self.spark, f"{self.path}/changes")

    def upsert(self, incoming: DataFrame, namespace: str | None = None, unique: bool = False,
               seq: int | None = None) -> int:
        """Insert or replace by (namespace, id). Returns the number of records taken.

        Records that break the contract are stored as rejects. Where ids are known to be
        ``unique`` the records are written in one pass. Otherwise they are staged first, for
        the last of several by ``ordinal`` has to be found. A ``seq`` that is complete already
        has no second effect.
        """
        seq = self._next() if seq is None else seq
        if not self._taken(seq):
            checked = self._checked(incoming, namespace)
            if unique:
                self._append(checked.drop("ordinal"), seq)
            else:
                self._append_last(checked, seq)
        stored = self._change_rows([seq]).where("kind = 'change'")
        return stored.agg(F.sum("copies").alias("n")).first()["n"] or 0

    def _checked(self, incoming: DataFrame, namespace: str | None) -> DataFrame:
        records = ops.normalize_records(incoming, namespace, self.settings)
        reason = ops.reject_reason(self.dimension)
        return (
            records.withColumn("reject_reason", reason)
            .withColumn("kind", F.when(reason.isNull(), "change").otherwise("reject"))
            .withColumn("deleted", F.lit(False))
            .withColumn("copies", F.lit(1).cast("long"))
            .withColumn("bucket", self._bucket())
        )

    def _append_last(self, checked: DataFrame, seq: int) -> None:
        stage = work_path(self.spark, "upsert")
        checked.write.parquet(stage)
        staged = self.spark.read.schema(checked.schema).parquet(stage)
        good = staged.where("kind = 'change'")
        most = good.groupBy(*PART, "id").count().agg(F.max("count").alias("n")).first()["n"] or 0
        if most > 1:
            order = F.col("ordinal") if "ordinal" in staged.columns else F.lit(0)
            others = [c for c in staged.columns if c not in ("namespace", "id", "copies", "ordinal")]
            # Combined in each task first, so a much repeated id stays small.
            last = good.groupBy("namespace", "id").agg(
                F.max_by(F.struct(*others), order).alias("r"), F.sum("copies").alias("copies")
            )
            refused = staged.where("kind = 'reject'").drop("ordinal")
            staged = last.select("namespace", "id", "r.*", "copies").unionByName(refused)
        self._append(staged.drop("ordinal"), seq)
        delete_path(self.spark, stage)

    def delete_keys(self, keys: DataFrame, seq: int | None = None) -> None:
        """Mark the records named by ``namespace, id`` as deleted; unknown ones do no harm."""
        seq = self._next() if seq is None else seq
        if self._taken(seq):
            return
        marks = keys.select("namespace", "id").where("id is not null").distinct()
        marks = marks.select(
            "namespace", "id", *_nulls("document_id STRING", "values ARRAY<FLOAT>", "metadata VARIANT"),
            F.lit(True).alias("deleted"), F.lit(0).cast("long").alias("copies"),
            *_nulls("reject_reason STRING"), F.lit("change").alias("kind"),
        )
        self._append(marks.withColumn("bucket", self._bucket()), seq)

    def delete(self, ids: DataFrame | None = None, condition: Mapping[str, Any] | None = None,
               namespace: str | None = None, delete_all: bool = False,
               seq: int | None = None) -> bool:
        """Delete inside one namespace; without arguments nothing changes.

        Deleting by ids writes a mark per id and reads nothing; a condition reads what it
        needs of the namespace; ``delete_all`` writes one row.
        """
        space = F.lit(namespace or self.settings.namespace).alias("namespace")
        if delete_all:
            self._drop(namespace or self.settings.namespace, seq)
        elif ids is not None:
            self.delete_keys(ids.select(space, F.col("id").cast("string").alias("id")), seq)
        elif condition:
            def scope(rows: DataFrame) -> DataFrame:
                return ops.in_namespace(rows, namespace, self.settings)

            rows = self._live(scope)
            found = rows.where(F.coalesce(ops.record_filter(condition, rows), F.lit(False)))
            self.delete_keys(found, seq)
        return True

    def delete_by_document(self, document_id: str, namespace: str | None = None,
                           seq: int | None = None) -> bool:
        return self.delete(condition={"document_id": {"$eq": document_id}}, namespace=namespace, seq=seq)

    def _drop(self, namespace: str, seq: int | None) -> None:
        seq = self._next() if seq is None else seq
        if not self._taken(seq):
            row = self.spark.range(1).select(
                F.lit(namespace).alias("namespace"), *_nulls("id STRING", "document_id STRING"),
                *_nulls("values ARRAY<FLOAT>", "metadata VARIANT"), F.lit(True).alias("deleted"),
                F.lit(0).cast("long").alias("copies"), *_nulls("reject_reason STRING"),
                F.lit("drop").alias("kind"), F.lit(0).alias("bucket"),
            )
            self._append(row, seq)

    # Upkeep

    def compact(self) -> int | None:
        """Write the live records as a new base; returns its number, or the present one where
        no change has come since. Readers keep the files they started with."""
        base, seqs = self.batches()
        if not seqs:
            return base
        self._write(self._live(), self._folder("base", seqs[-1]), *PART)
        return seqs[-1]

    def vacuum(self) -> None:
        """Remove what the last compaction stands for, and writes that broke. Rejects stay.
        To be run when no reader uses the older files and no write is under way."""
        base, _ = self.batches()
        done = complete_numbers(self.spark, f"{self.path}/changes")
        for seq in numbers(self.spark, f"{self.path}/changes"):
            folder = self._folder("changes", seq)
            if seq not in done:
                delete_path(self.spark, folder)
            elif base is not None and seq <= base:
                delete_path(self.spark, f"{folder}/kind=change")
                delete_path(self.spark, f"{folder}/kind=drop")
        for seq in numbers(self.spark, f"{self.path}/base"):
            if seq != base:
                delete_path(self.spark, self._folder("base", seq))

    def stats(self) -> DataFrame:
        return ops.index_stats(self.read(), self.dimension)

    def refresh_stats(self, at: Column | None = None) -> int:
        """Add the present statistics to the history; returns the write they belong to.

        Counts go on from the last entry, or from the last compaction, whose counts its files'
        footers tell. Only keys written since are looked at: what became of them, and whether
        they were there before, which reads their buckets' id column. A write is measured once.
        """
        base, changes = self.batches()
        known = complete_numbers(self.spark, f"{self.path}/stats")
        now = max([*changes, base or 0])
        if now in known:
            return now
        start = max((n for n in known if n >= (base or 0)), default=base or 0)
        schema = "namespace STRING, vector_count BIGINT"
        if start in known:
            counts = self.spark.read.parquet(self._folder("stats", start)).where("namespace is not null")
        elif base is not None:
            counts = self.spark.read.schema(_BASE).parquet(self._folder("base", base))
            counts = counts.groupBy("namespace").agg(F.count(F.lit(1)).alias("vector_count"))
        else:
            counts = self.spark.createDataFrame([], schema)
        moved = self._moved(start, [n for n in changes if n > start])
        totals = counts.select("namespace", "vector_count", F.lit(False).alias("emptied")).unionByName(moved)
        # Of a namespace emptied since, only what was written after that counts.
        gone = F.max("emptied").over(Window.partitionBy("namespace"))
        left = totals.withColumn("gone", gone).where(~F.col("gone") | F.col("emptied"))
        spaces = left.groupBy("namespace").agg(F.sum("vector_count").alias("vector_count"))
        # The total is there for an empty table, too.
        total = spaces.agg(F.coalesce(F.sum("vector_count"), F.lit(0)).alias("vector_count"))
        total = total.select(F.lit(None).cast("string").alias("namespace"), "vector_count")
        rows = spaces.where("vector_count > 0").unionByName(total)
        at = F.current_timestamp() if at is None else at
        rows = rows.withColumn("dimension", F.lit(self.dimension)).withColumn("measured_at", at)
        rows.coalesce(1).write.mode("overwrite").parquet(self._folder("stats", now))
        return now

    def _moved(self, start: int, seqs: list[int]) -> DataFrame:
        """(namespace, vector_count, emptied): what the writes ``seqs`` add to the counts."""
        if not seqs:
            return self.spark.createDataFrame([], "namespace STRING, vector_count BIGINT, emptied BOOLEAN")
        written = self._change_rows(seqs).where("kind = 'change'")
        keys = written.groupBy(*PART, "id").agg(
            F.max_by("deleted", "seq").alias("deleted"), F.max("seq").alias("seq")
        )
        drops = self._drops(seqs)
        if drops is None:
            keys = keys.withColumn("_drop", F.lit(None).cast("long"))
        else:
            keys = keys.join(drops, keys["namespace"] == drops["_space"], "left").drop("_space")
        few = keys.select(*PART, "id").limit(self.settings.pushed_ids + 1).collect()
        scope = self._scope_of(few) if len(few) <= self.settings.pushed_ids else lambda rows: rows
        there = self._live(scope, start).select(*PART, "id", F.lit(1).alias("_there"))
        keys = keys.join(there, [*PART, "id"], "left")
        emptied = F.col("_drop").isNotNull()
        after = (~F.col("deleted") & (F.coalesce("_drop", F.lit(0)) < F.col("seq"))).cast("long")
        before = F.when(emptied, 0).otherwise(F.coalesce("_there", F.lit(0)))
        moved = keys.groupBy("namespace", emptied.alias("emptied")).agg(F.sum(after - before).alias("vector_count"))
        if drops is not None:
            moved = moved.unionByName(
                drops.select(F.col("_space").alias("namespace"), F.lit(True).alias("emptied"), F.lit(0).cast("long").alias("vector_count"))
            )
        return moved.select("namespace", "vector_count", "emptied")

    def stats_history(self) -> DataFrame:
        """``seq, namespace, vector_count, dimension, measured_at`` of all entries; the row
        without a namespace is the total."""
        schema = "seq BIGINT, namespace STRING, vector_count BIGINT, dimension INT, measured_at TIMESTAMP"
        done = sorted(complete_numbers(self.spark, f"{self.path}/stats"))
        if not done:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/stats")
        return read.parquet(*[self._folder("stats", n) for n in done])
