"""Incremental ingest and live views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions import text as tx
from docloom.session import is_folder, path_exists
from docloom.sources.files import admit


_FILES = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def _uploads(spark: SparkSession, folder: str, files_per_batch: int, settings: Settings) -> DataFrame:
    stream = (
        spark.readStream.format("binaryFile")
        .schema(_FILES)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return stream.withColumn("filename", tx.base_name(F.col("path")))


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000,
                settings: Settings = DEFAULTS) -> DataFrame:
    """New admissible files of an upload folder, with their name.

    Size and type are checked in the stream itself, ahead of any handler, so a file that is
    too large is never read. ``reject_stream`` over the same folder has all others.
    """
    uploads = _uploads(spark, folder, files_per_batch, settings)
    named = uploads.where(F.col("length") <= settings.max_upload_bytes)
    admitted = admit(named, settings).where(F.col("reject_reason").isNull())
    return admitted.drop("reject_reason", "file_type")


def reject_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """New files of an upload folder that are not admissible, with the reason. The files are
    listed, not opened."""
    uploads = _uploads(spark, folder, files_per_batch, settings).drop("content")
    return admit(uploads, settings).where(F.col("reject_reason").isNotNull())


def table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1000) -> DataFrame:
    """The table ``table``.parquet of a folder as a stream of rows.

    A table is a Parquet file of that name, or a folder of that name: then every Parquet file
    in it belongs to the table, whatever it is called.
    """
    name = f"{table}.parquet"
    path = f"{folder}/{name}"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], object], checkpoint: str,
                  output_mode: str = "append") -> None:
    """Process what has arrived, batch by batch, and stop.

    The checkpoint fixes the content of each batch id; ``handle`` must give the same
    effect when a batch comes again, which the batch-partitioned tables ensure.
    """
    query = (
        stream.writeStream.foreachBatch(lambda df, batch: handle(df, batch) and None)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def replace_batch(path: str, run: str = "default") -> Callable[[DataFrame, int], None]:
    """A handler that stores each batch in its own partition of ``path``.

    ``run`` names the stream: two streams into one table both count their batches from 0.
    """

    def handle(df: DataFrame, batch: int) -> None:
        (
            df.withColumn("run", F.lit(run))
            .withColumn("batch", F.lit(batch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("run", "batch")
            .parquet(path)
        )

    return handle


class LateSplit:
    """Rows of a stream on time, and those behind the watermark kept beside them.

    A batch's watermark is the latest event time of all batches before it, less ``delay``.
    That time is all the state there is: one row per batch in the shared folder, so a batch
    that comes again sees what it saw first and replaces its own rows. Nothing is dropped:
    a late row is stored with the watermark it missed.
    """

    def __init__(self, spark: SparkSession, path: str, at: str = "ts",
                 delay: str = "10 minutes", run: str = "default"):
        self.spark, self.path, self.at, self.delay, self.run = spark, path, at, delay, run

    def handle(self, df: DataFrame, batch: int) -> None:
        seen, before = f"{self.path}/seen", F.lit(None).cast("timestamp")
        if path_exists(self.spark, seen):
            past = self.spark.read.parquet(seen).where((F.col("run") == self.run) & (F.col("batch") < batch))
            before = F.lit(past.agg(F.max("latest").alias("t")).first()["t"]).cast("timestamp")
        mark = before - F.expr(f"interval {self.delay}")
        late = F.coalesce(F.col(self.at) < F.col("watermark"), F.lit(False))
        marked = df.withColumn("watermark", mark).withColumn("late", late)
        replace_batch(f"{self.path}/rows", self.run)(marked, batch)
        latest = df.agg(F.max(self.at).cast("timestamp").alias("latest"))
        replace_batch(seen, self.run)(latest, batch)

    def on_time(self) -> DataFrame:
        return self._rows().where(~F.col("late")).drop("late", "watermark")

    def late(self) -> DataFrame:
        return self._rows().where("late").drop("late")

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").drop("run", "batch")


def status_counts_per_period(events: DataFrame, period: str = "5 minutes") -> DataFrame:
    """Events per status and period of a stored table."""
    return (
        events.groupBy(F.window("ts", period), "status")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("window.start", "window.end", "status", "events")
    )


def suppress_duplicates(uploads: DataFrame, delay: str, at: str = "created_at",
                        salts: int = 16) -> DataFrame:
    """First upload of each document within the delay; state is dropped after it.

    Done twice: first per document and salt, so that a document uploaded over and over
    is thinned out on many tasks, then per document.
    """
    salt = F.pmod(F.xxhash64(at), F.lit(salts))
    return (
        uploads.withWatermark(at, delay)
        .withColumn("_salt", salt)
        .dropDuplicatesWithinWatermark(["document_id", "_salt"])
        .drop("_salt")
        .dropDuplicatesWithinWatermark(["document_id"])
    )


def live_status_counts(events: DataFrame, period: str = "5 minutes",
                       delay: str = "10 minutes") -> DataFrame:
    """Events per status and period, for update mode."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", period), "status")
        .agg(F.count(F.lit(1)).alias("events"))
        .select("window.start", "window.end", "status", "events")
    )


def latest_counts(stored: DataFrame) -> DataFrame:
    """Current value per period and status from the stored updates."""
    return stored.groupBy("start", "end", "status").agg(F.max_by("events", "batch").alias("events"))
