"""Section nodes: a document's paragraphs packed under headings, pages and tokens capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.functions import text as tx
from docloom.functions.arrays import fold_closing, let, running

NODE = "struct<first:int,last:int,title:string,start_page:int,end_page:int,token_count:int>"
HEADING = r"(?s)^#{1,6}[ \t]+(\S.*)\z"


def _paragraphs(content: Column) -> Column:
    """Non-empty paragraphs with token count, page and heading. A form feed ends a page."""
    raw = F.split(content, "\n\n", -1)

    def measured(parts: Column) -> Column:
        breaks = F.transform(
            parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\f"), F.lit("")))
        )
        pages = running(breaks, F.lit(0), lambda a, b: a + b)
        rows = F.transform(
            F.arrays_zip(parts.alias("text"), pages.alias("page")),
            lambda p: F.struct(
                tx.strip(p["text"]).alias("text"),
                tx.word_count(p["text"]).alias("tokens"),
                (p["page"] + 1).cast("int").alias("page"),
                F.regexp_extract(tx.strip(p["text"]), HEADING, 1).alias("heading"),
            ),
        )
        return F.filter(rows, lambda p: p["text"] != "")

    return let(raw, measured)


def section_nodes(content: Column, settings: Settings = DEFAULTS) -> Column:
    """ARRAY of nodes with their text.

    A heading opens a node; a node is closed before a paragraph that would take it past
    the token or page limit. Only numbers are carried through the fold; the text of a
    node is joined once at the end.
    """
    def opened(p: Column, i: Column, title: Column) -> Column:
        return F.struct(
            i.cast("int").alias("first"),
            i.cast("int").alias("last"),
            title.alias("title"),
            p["page"].alias("start_page"),
            p["page"].alias("end_page"),
            p["tokens"].alias("token_count"),
        )

    def fold(paras: Column) -> Column:
        numbered = F.transform(paras, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        nothing = F.lit(None).cast(NODE)

        def add(acc: Column, item: Column) -> Column:
            node, p, i = acc["open"], item["p"], item["i"]
            titled = p["heading"] != ""
            close = node.isNotNull() & (
                titled
                | (node["token_count"] + p["tokens"] > settings.node_max_tokens)
                | (p["page"] - node["start_page"] + 1 > settings.node_max_pages)
            )
            title = F.when(titled, p["heading"]).otherwise(node["title"])
            grown = F.struct(
                node["first"].alias("first"),
                i.cast("int").alias("last"),
                node["title"].alias("title"),
                node["start_page"].alias("start_page"),
                p["page"].alias("end_page"),
                (node["token_count"] + p["tokens"]).alias("token_count"),
            )
            return F.struct(
                F.when(close | node.isNull(), opened(p, i, title)).otherwise(grown).alias("open"),
                F.when(close, F.array_append(acc["closed"], node))
                .otherwise(acc["closed"])
                .alias("closed"),
            )

        def finish(acc: Column) -> Column:
            last = F.array_append(acc["closed"], acc["open"])
            return F.when(acc["open"].isNotNull(), last).otherwise(acc["closed"])

        def with_text(nodes: Column) -> Column:
            return F.transform(
                nodes,
                lambda n, i: F.struct(
                    i.cast("int").alias("node_index"),
                    n["title"].alias("title"),
                    n["start_page"].alias("start_page"),
                    n["end_page"].alias("end_page"),
                    n["token_count"].alias("token_count"),
                    F.array_join(
                        F.slice(paras, n["first"] + 1, n["last"] - n["first"] + 1)["text"], "\n\n"
                    ).alias("content"),
                ),
            )

        closed = let(fold_closing(numbered, nothing, NODE, add), finish)
        return let(closed, with_text)

    return let(_paragraphs(content), fold)


def document_nodes(documents: DataFrame, content: str = "content",
                   settings: Settings = DEFAULTS) -> DataFrame:
    return documents.select(
        "document_id", F.explode(section_nodes(F.col(content), settings)).alias("n")
    ).select("document_id", "n.*")
