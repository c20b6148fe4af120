"""Paragraph packing with character overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions import text as tx
from docloom.functions.arrays import fold_closing, let


def chunk_texts(content: Column, size: int | None = None, overlap: int | None = None,
                settings: Settings = DEFAULTS) -> Column:
    """ARRAY<STRING> of the chunks of one text.

    A chunk is closed when the next paragraph would pass ``size``; the next one then
    opens with the last ``overlap`` characters. Paragraphs are never split. A size or
    overlap of 0 means the default.
    """
    size = size or settings.chunk_size
    overlap = overlap or settings.chunk_overlap
    gap = "\n\n"
    paragraphs = F.filter(
        F.transform(F.split(tx.strip(content), gap, -1), tx.strip), lambda p: p != ""
    )
    # The open chunk is kept without its last gap: its parts are stripped, so it needs
    # no stripping again. The gap still counts, for the size and for the overlap.
    def add(acc: Column, para: Column) -> Column:
        opened = acc["open"]
        full = (opened != "") & (F.length(opened) + F.length(para) + 4 > size)
        carried = tx.strip(F.right(opened, F.lit(max(overlap - 2, 0))))
        closing = F.struct(
            F.when(carried != "", F.concat(carried, F.lit(gap), para)).otherwise(para).alias("open"),
            F.array_append(acc["closed"], opened).alias("closed"),
        )
        growing = F.struct(
            F.when(opened != "", F.concat(opened, F.lit(gap), para)).otherwise(para).alias("open"),
            acc["closed"].alias("closed"),
        )
        return F.when(full, closing).otherwise(growing)

    def finish(acc: Column) -> Column:
        last = F.array_append(acc["closed"], acc["open"])
        return F.when(acc["open"] != "", last).otherwise(acc["closed"])

    return let(fold_closing(paragraphs, F.lit(""), "string", add), finish)


def chunk_documents(
    documents: DataFrame,
    content: str = "content",
    size: int | None = None,
    overlap: int | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """One row per chunk. Needs ``document_id`` and ``content``; a ``metadata`` struct,
    where there is one, is copied to each chunk with ``chunk_index`` added."""
    carried = ["metadata"] if "metadata" in documents.columns else []
    exploded = documents.select(
        "document_id",
        *carried,
        F.posexplode(chunk_texts(F.col(content), size, overlap, settings)).alias(
            "chunk_index", "content"
        ),
    )
    meta = (
        F.col("metadata").withField("chunk_index", F.col("chunk_index"))
        if carried
        else F.struct("chunk_index")
    )
    return exploded.select(
        tx.chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "content",
        "chunk_index",
        F.length("content").alias("char_count"),
        tx.word_count(F.col("content")).alias("word_count"),
        meta.alias("metadata"),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
