"""HTML to paragraph text, as one chain of column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.arrays import let

# Elements whose content is not text of the page.
DROPPED = ("script", "style", "nav", "head", "template", "noscript")
# Of these, the ones that run to the end of the page if never closed.
OPEN_ENDED = ("script", "style", "template", "noscript")
# Elements that end a paragraph.
BLOCKS = (
    "address|article|aside|blockquote|body|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "header|hr|html|li|main|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
# The named characters of HTML 4, and &apos;. A hard blank counts as a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _entities(text: Column) -> Column:
    """Decode &#n;, &#xh; and &name; by cutting at the ampersands and decoding each piece's
    head, once: what a reference stands for is not read as part of another."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    number, name = r"(?i)^#(x[0-9a-f]{1,6}|[0-9]{1,7});", r"^([A-Za-z][A-Za-z0-9]{1,31});"

    def numeric(part: Column) -> Column:
        head = F.regexp_extract(part, number, 1)
        point = F.when(
            F.lower(F.substring(head, 1, 1)) == "x",
            F.conv(F.substring(head, 2, 6), 16, 10),
        ).otherwise(head)
        code = point.cast("int")
        valid = (head != "") & (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, F.concat(char, F.regexp_replace(part, number, "")))

    def named(part: Column) -> Column:
        char = F.try_element_at(known, F.regexp_extract(part, name, 1))
        return F.concat(char, F.regexp_replace(part, name, ""))

    def piece(part: Column) -> Column:
        decoded = F.when(F.startswith(part, F.lit("#")), numeric(part)).otherwise(named(part))
        return F.coalesce(decoded, F.concat(F.lit("&"), part))

    def decode(t: Column) -> Column:
        pieces = F.split(t, "&", -1)
        decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(piece(p)))
        return F.when(F.contains(t, F.lit("&")), F.array_join(decoded, "")).otherwise(t)

    return let(text, decode)


def html_to_text(html: Column) -> Column:
    """Drop invisible parts, turn headings into # lines and blocks into paragraphs."""
    text = F.regexp_replace(html, r"(?s)<!--(?:.*?-->|.*\z)", "")
    for tag in DROPPED:
        end = rf"(?:.*?</{tag}\s*>|.*\z)" if tag in OPEN_ENDED else rf".*?</{tag}\s*>"
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>{end}", "")
    text = F.regexp_replace(text, r"\s+", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{level}(?:\s[^>]*)?>", "\n\n" + "#" * level + " ")
    text = F.regexp_replace(text, r"(?i)</h[1-6]\s*>", "\n\n")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(text, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*)?/?>", "\n\n")
    text = F.regexp_replace(text, r"<[a-zA-Z/!?][^>]*>", "")
    text = _entities(text)
    text = F.regexp_replace(text, r" *\n *", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n](?<![ \n]{2})[ \n]*+\z", "")


def html_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>\s*(.*?)\s*</title\s*>", 1)
    title = _entities(title)
    return F.when(title != "", title)


def tag_count(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<{tag}[\s>/]"))
