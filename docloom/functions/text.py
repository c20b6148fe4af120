"""Text measures, identifiers and file types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators U+001C..U+001F.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

# Extension to document type.
FILE_TYPES = {
    "pdf": "pdf",
    "docx": "docx",
    "pptx": "pptx",
    "xlsx": "xlsx",
    "txt": "txt",
    "md": "md",
    "html": "html",
    "htm": "html",
    "png": "image",
    "jpg": "image",
    "jpeg": "image",
    "tiff": "image",
    "webp": "image",
}


def strip(text: Column) -> Column:
    """Remove white space at both ends.

    Only texts whose first or last character is white space meet the expression, which
    tests a character before it looks behind it, so long inner runs stay linear.
    """
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    trimmed = F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}(?<!{SPACE}{SPACE}){SPACE}*+\z", "")
    return F.when(ends.rlike(rf"(?U){SPACE}"), trimmed).otherwise(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){NOT_SPACE}+"))


def base_name(name: Column) -> Column:
    """The part after the last slash, trailing slashes ignored."""
    return F.regexp_extract(name, r"([^/]*)/*\z", 1)


def extension(name: Column) -> Column:
    """Last suffix in lower case without its dot; '' where there is none.

    A leading dot does not start a suffix, a trailing one ends the name without one.
    """
    return F.lower(F.regexp_extract(base_name(name), r"(?s)^.+\.([^.]+)\z", 1))


def file_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain(*FILE_TYPES.items())])
    return F.coalesce(F.element_at(table, extension(name)), F.lit("txt"))


def document_id(content: Column, name: Column) -> Column:
    """First 16 hex digits of SHA-256 over content bytes followed by the name."""
    return F.substring(F.sha2(F.concat(content, F.encode(name, "UTF-8")), 256), 1, 16)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat_ws("_", doc, F.lit("chunk"), index.cast("string"))


def text_key(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))
