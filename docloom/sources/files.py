"""Raw files: admission, text extraction, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions import html as hx
from docloom.functions import text as tx
from docloom.schemas import METADATA

FILE_COLUMNS = ["path", "filename", "length", "modificationTime"]
READABLE = ("txt", "md", "html")


def reject_reason(filename: Column, length: Column, settings: Settings = DEFAULTS) -> Column:
    """Why a file is not taken, or null."""
    return F.when(
        ~tx.extension(filename).isin(list(settings.allowed_file_types)), "file type not allowed"
    ).when(length > settings.max_upload_bytes, "file too large")


def admit(raw: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``file_type`` and ``reject_reason``; rejected rows stay, with their reason."""
    return raw.withColumn("file_type", tx.file_type(F.col("filename"))).withColumn(
        "reject_reason", reject_reason(F.col("filename"), F.col("length"), settings)
    )


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Names, sizes and times only; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        "path", tx.base_name(F.col("path")).alias("filename"), "length", "modificationTime"
    )


def scan_files(
    spark: SparkSession, folder: str, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Accepted files with content, and rejects without.

    The size limit is pushed into the file source, so bytes of an oversized file are
    never read, and rejects are listed without the content column.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    named = files.withColumn("filename", tx.base_name(F.col("path")))
    accepted = admit(named.where(F.col("length") <= settings.max_upload_bytes), settings)
    accepted = accepted.where(F.col("reject_reason").isNull()).drop("reject_reason")
    rejected = admit(list_files(spark, folder), settings)
    return (
        accepted.select(*FILE_COLUMNS, "file_type", "content"),
        rejected.where(F.col("reject_reason").isNotNull()),
    )


def _markdown_title(text: Column) -> Column:
    title = F.regexp_extract(text, r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)
    return F.when(title != "", title)


def _count_of(kind: Column, source: Column, html_tag: str, markdown: str) -> Column:
    n = F.when(kind == "html", hx.tag_count(source, html_tag)).when(
        kind == "md", F.regexp_count(source, F.lit(markdown))
    )
    return F.when(n > 0, n)


def document_metadata(filename: Column, kind: Column, source: Column) -> Column:
    """Title, table and image facts of a textual file; counts only where there are any.

    Textual formats have no pages and name no author, so both stay null.
    """
    tables = _count_of(kind, source, "table", r"(?m)^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*$")
    images = _count_of(kind, source, "img", r"!\[[^\]]*\]\(")
    title = F.when(kind == "html", hx.html_title(source)).when(kind == "md", _markdown_title(source))
    return F.struct(
        filename.alias("filename"),
        kind.alias("file_type"),
        F.lit(None).cast("int").alias("page_count"),
        tables.isNotNull().alias("has_tables"),
        images.isNotNull().alias("has_images"),
        title.alias("title"),
        F.lit(None).cast("string").alias("author"),
        tables.alias("table_count"),
        images.alias("image_count"),
    ).cast(f"struct<{METADATA}>")


def extract(raw: DataFrame) -> DataFrame:
    """Files to documents. A file that cannot be read fails alone: its row carries
    status and message, no exception ends the job."""
    kind = tx.file_type(F.col("filename"))
    source = F.col("content").cast("string")
    problem = (
        F.when(F.col("content").isNull(), F.lit("no content"))
        .when(~kind.isin(*READABLE), F.concat(F.lit("unsupported format: "), kind))
        .when(~F.is_valid_utf8(source), F.lit("not valid UTF-8"))
    )
    checked = raw.select(
        tx.document_id(F.col("content"), F.col("filename")).alias("document_id"),
        "filename",
        kind.alias("file_type"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("created_at"),
        problem.alias("error_message"),
        F.when(problem.isNull(), source).alias("_source"),
    )
    kind, source = F.col("file_type"), F.col("_source")
    text = F.when(kind == "html", hx.html_to_text(source)).otherwise(source)
    metadata = document_metadata(F.col("filename"), kind, source)
    return checked.select(
        "document_id",
        "filename",
        "file_type",
        "file_size",
        "created_at",
        text.alias("content"),
        metadata.alias("metadata"),
        F.when(F.col("error_message").isNull(), "completed").otherwise("failed").alias("status"),
        "error_message",
    ).withColumn("word_count", tx.word_count(F.col("content")))


def split_failures(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.col("status") == "completed"
    return documents.where(good), documents.where(~good)
