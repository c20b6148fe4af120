"""The batch ledger: which batch of which run has had its effect.

A batch is named by its run (a stream's checkpoint, a load job) and its number in it, so two
sources that both count from 0 stay apart. Opening a batch gives it a place in the order of
all batches, ``seq``, which is the same when the batch comes again; tables keep what the
batch writes under that number. Closing it notes that all of its writes are complete: from
then on the batch is refused a second effect. Entries are Parquet folders that count once
Spark has finished them. One writer at a time.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import complete, numbers, path_exists

_OPENED = "run STRING, batch BIGINT, seq BIGINT, at TIMESTAMP"
_CLOSED = "run STRING, batch BIGINT, seq BIGINT, effect BIGINT, at TIMESTAMP"


@dataclass(frozen=True)
class Entry:
    seq: int
    done: bool
    effect: int | None


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, kind: str, run: str, batch: int) -> str:
        name = hashlib.sha256(f"{batch}:{run}".encode()).hexdigest()
        return f"{self.path}/{kind}/name={name}"

    def _row(self, kind: str, run: str, batch: int):
        """The entry of one batch, or None; only its own folder is read."""
        folder = self._folder(kind, run, batch)
        schema = _OPENED if kind == "opened" else _CLOSED
        return self.spark.read.schema(schema).parquet(folder).first() if complete(self.spark, folder) else None

    def _write(self, kind: str, run: str, batch: int, schema: str, *values) -> None:
        fields = map(str.split, schema.split(", "))
        known = [F.lit(v).cast(of).alias(name) for (name, of), v in zip(fields, (run, batch, *values))]
        row = self.spark.range(1).coalesce(1).select(*known, F.current_timestamp().alias("at"))
        row.write.mode("overwrite").parquet(self._folder(kind, run, batch))

    def open(self, run: str, batch: int) -> Entry:
        closed = self._row("closed", run, batch)
        if closed:
            return Entry(closed["seq"], True, closed["effect"])
        opened = self._row("opened", run, batch)
        if opened:
            return Entry(opened["seq"], False, None)
        # The highest number is the name of a folder, so no entry is read to find it.
        seq = max(numbers(self.spark, f"{self.path}/order"), default=0) + 1
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order/seq={seq}")
        self._write("opened", run, batch, _OPENED, seq)
        return Entry(seq, False, None)

    def close(self, run: str, batch: int, seq: int, effect: int) -> None:
        """``effect`` is what a replay of the batch will report."""
        self._write("closed", run, batch, _CLOSED, seq, effect)

    def entries(self) -> DataFrame:
        """``run, batch, seq, effect, at`` of the closed batches."""
        if not path_exists(self.spark, f"{self.path}/closed"):
            return self.spark.createDataFrame([], _CLOSED)
        read = self.spark.read.schema(_CLOSED).option("pathGlobFilter", "*.parquet")
        return read.option("recursiveFileLookup", "true").parquet(f"{self.path}/closed")
