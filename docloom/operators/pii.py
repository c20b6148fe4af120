"""Personal data: detection, merge, rollup and redaction.

Everything about one text is computed inside its row, so scanning is a single
narrow stage. Positions count code points from 0; ``end`` is exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import (
    DEFAULTS,
    PII_CATEGORIES,
    REDACTION_REQUEST_CATEGORIES,
    Settings,
)
from docloom.functions.arrays import let, running
from docloom.functions.pii_rules import (
    EXTRACTION_CLASSES,
    LEADS,
    LED_VALUE,
    MODEL_CONFIDENCE,
    MODEL_SOURCE,
    REGEX_CONFIDENCE,
    REGEX_SOURCE,
    RULES,
)

HIT_TYPE = (
    "array<struct<start:int,end:int,source_rank:int,category_rank:int,pattern_rank:int,"
    "category:string,text:string,confidence:double,source:string>>"
)
DETECTIONS_TYPE = (
    "array<struct<category:string,text:string,start:int,end:int,confidence:double,source:string>>"
)
TEXT_BLOCK = 1024


def _chosen(categories: Sequence[str] | None) -> list[str]:
    """Requested categories in request order; none requested means all."""
    chosen = list(dict.fromkeys(categories or PII_CATEGORIES))
    unknown = set(chosen) - set(PII_CATEGORIES)
    if unknown:
        raise ValueError(f"unknown categories: {sorted(unknown)}")
    return chosen


def _matches(text: Column, number: int) -> Column:
    return F.struct(
        F.lit(number).alias("rule"),
        F.regexp_extract_all(text, F.lit(RULES[number].regex), F.lit(0)).alias("found"),
    )


def _gaps(text: Column, number: Column, chosen: list[int]) -> Column:
    """Text before each match of the rule. Patterns are constants, so each is compiled
    once per task and not once per row."""
    gaps = F.lit(None).cast("array<string>")
    for i in chosen:
        found = F.regexp_extract_all(text, F.lit(RULES[i].gap_regex), F.lit(1))
        gaps = F.when(number == i, found).otherwise(gaps)
    return gaps


def _spans(text: Column, matched: Column, chosen: list[int], ranks: list[int]) -> Column:
    """Hits of one rule: a running sum over gaps and matches gives the offsets."""
    number = matched["rule"]
    led = [i for i, r in enumerate(RULES) if r.lead]
    narrowed = {i: r.within for i, r in enumerate(RULES) if r.within}

    def with_offsets(parts: Column) -> Column:
        steps = F.transform(parts, lambda p: F.length(p["gap"]) + F.length(p["found"]))
        starts = running(steps, F.lit(0), lambda a, b: a + b)

        def one(p: Column) -> Column:
            whole, at = p["part"]["found"], p["at"] + F.length(p["part"]["gap"])
            skip = F.when(
                number.isin(led), F.length(F.regexp_extract(whole, LEADS, 0))
            ).otherwise(0)
            rest = F.substring(whole, skip + 1, F.length(whole))
            found = F.when(number.isin(led), F.regexp_extract(rest, LED_VALUE, 0))
            for i, within in narrowed.items():
                found = found.when(number == i, F.regexp_extract(whole, within, 0))
            return F.struct((at + skip).alias("start"), found.otherwise(whole).alias("text"))

        pairs = F.arrays_zip(parts.alias("part"), starts.alias("at"))
        kept = F.filter(F.transform(pairs, one), lambda h: h["text"] != "")
        return F.transform(
            kept,
            lambda h: F.struct(
                h["start"].cast("int").alias("start"),
                (h["start"] + F.length(h["text"])).cast("int").alias("end"),
                F.lit(1).alias("source_rank"),
                F.get(F.lit(ranks), number).alias("category_rank"),
                number.alias("pattern_rank"),
                F.get(F.lit([r.category for r in RULES]), number).alias("category"),
                h["text"].alias("text"),
                F.lit(REGEX_CONFIDENCE).alias("confidence"),
                F.lit(REGEX_SOURCE).alias("source"),
            ),
        )

    gaps = _gaps(text, number, chosen)
    return let(F.arrays_zip(gaps.alias("gap"), matched["found"].alias("found")), with_offsets)


def _regex_hits(text: Column, chosen: list[str]) -> Column:
    """Hits of all rules of the chosen categories.

    Gates pick the rules worth running on this text; offsets are worked out only for
    rules that matched.
    """
    by_gates: dict[tuple[str, ...], list[int]] = {}
    for number, rule in enumerate(RULES):
        if rule.category in chosen:
            by_gates.setdefault(rule.gates, []).append(number)
    matched_type = "array<struct<rule:int,found:array<string>>>"
    matched = [
        F.when(
            reduce(and_, [text.rlike(g) for g in gates]),
            F.array(*[_matches(text, n) for n in numbers]),
        ).otherwise(F.array().cast(matched_type))
        for gates, numbers in by_gates.items()
    ]
    ranks = [chosen.index(r.category) if r.category in chosen else -1 for r in RULES]
    wanted = [n for numbers in by_gates.values() for n in numbers]
    some = F.filter(F.concat(*matched), lambda m: F.size(m["found"]) > 0)
    return F.flatten(F.transform(some, lambda m: _spans(text, m, wanted, ranks)))


def _first_per_position(hits: Column) -> Column:
    """Keep, per exact (start, end), the hit that comes first in list order."""

    def keep(items: Column) -> Column:
        def fresh(h: Column, i: Column) -> Column:
            before = F.get(items, i - 1)
            return (i == 0) | (before["start"] != h["start"]) | (before["end"] != h["end"])

        return F.filter(items, fresh)

    return let(F.sort_array(hits), keep)


def _listed(hits: Column) -> Column:
    """Detections in list order: model first, then category, pattern, position."""
    keyed = F.transform(
        hits,
        lambda h: F.struct(
            h["source_rank"], h["category_rank"], h["pattern_rank"], h["start"], h["end"],
            h["category"], h["text"], h["confidence"], h["source"],
        ),
    )
    return F.transform(
        F.sort_array(keyed),
        lambda h: F.struct(
            h["category"], h["text"], h["start"], h["end"], h["confidence"], h["source"]
        ),
    )


def _tag(category: Column) -> Column:
    return F.concat(F.lit("[REDACTED_"), F.upper(category), F.lit("]"))


def _redact_union(text: Column, hits: Column) -> Column:
    """Replace each maximal group of overlapping spans by one tag.

    The tag names the span that starts first, the longest of those. The text is cut
    into blocks once, so a piece costs its own length and not its position.
    """

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / TEXT_BLOCK).cast("int")
        last = F.floor((end - 1) / TEXT_BLOCK).cast("int")
        joined = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(end <= start, F.lit("")).otherwise(
            F.substring(joined, start - first * TEXT_BLOCK + 1, end - start)
        )

    def splice(bound: Column) -> Column:
        spans, blocks = bound["spans"], bound["blocks"]
        ends = F.transform(spans, lambda s: -s["back"])
        reach = running(ends, F.lit(0), lambda a, b: F.greatest(a, b))
        heads = F.filter(
            F.arrays_zip(spans.alias("span"), reach.alias("open")),
            lambda p: p["span"]["start"] >= p["open"],
        )
        pieces = F.transform(
            heads,
            lambda p: F.concat(
                cut(blocks, p["open"], p["span"]["start"]), _tag(p["span"]["category"])
            ),
        )
        return F.concat(
            F.array_join(pieces, ""), cut(blocks, F.array_max(ends), F.length(text))
        )

    spans = F.sort_array(
        F.transform(
            hits,
            lambda h: F.struct(
                h["start"], (-h["end"]).alias("back"), h["source_rank"], h["category_rank"],
                h["pattern_rank"], h["category"],
            ),
        )
    )
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{TEXT_BLOCK}}}"), 0)
    return let(F.struct(spans.alias("spans"), blocks.alias("blocks")), splice)


def _redact_splice(text: Column, hits: Column) -> Column:
    """Replace span after span, latest start first, at offsets of the original text.

    Overlapping spans then damage their neighbourhood; offered for exact parity only.
    """
    order = F.sort_array(
        F.transform(
            hits,
            lambda h: F.struct(
                (-h["start"]).alias("back"), h["source_rank"], h["category_rank"],
                h["pattern_rank"], h["start"], h["end"], h["category"],
            ),
        )
    )
    return F.aggregate(
        order,
        text,
        lambda t, h: F.concat(
            F.substring(t, F.lit(1), h["start"]),
            _tag(h["category"]),
            F.substring(t, h["end"] + 1, F.length(t)),
        ),
    )


def pii_report(
    text: Column,
    categories: Sequence[str] | None = None,
    model_hits: Column | None = None,
    row_categories: Column | None = None,
    redact: bool = True,
    overlap: str = "union",
    include_text: bool = False,
    settings: Settings = DEFAULTS,
) -> Column:
    """STRUCT<has_pii, categories_found, detections, redacted_content> for one text.

    ``model_hits`` is an array in ``HIT_TYPE`` layout from an external extractor.
    ``row_categories`` narrows the categories per row, null or empty meaning all. The
    matched text is personal data itself, so detections carry it only on request.
    """
    if overlap not in ("union", "splice"):
        raise ValueError(f"overlap must be 'union' or 'splice', not {overlap!r}")
    content = text if redact else F.lit(None).cast("string")
    if not settings.pii_enabled:
        return F.struct(
            F.lit(False).alias("has_pii"),
            F.array().cast("array<string>").alias("categories_found"),
            F.array().cast(DETECTIONS_TYPE).alias("detections"),
            content.alias("redacted_content"),
        )
    redactor = _redact_union if overlap == "union" else _redact_splice

    def report(bound: Column) -> Column:
        hits, kept = bound["hits"], bound["kept"]
        listed = _listed(kept)
        if not include_text:
            listed = F.transform(
                listed, lambda d: d.withField("text", F.lit(None).cast("string"))
            )
        redacted = F.when(F.size(kept) == 0, text).otherwise(redactor(text, kept))
        return F.struct(
            (F.size(kept) > 0).alias("has_pii"),
            F.sort_array(F.array_distinct(F.transform(hits, lambda h: h["category"]))).alias(
                "categories_found"
            ),
            listed.alias("detections"),
            (redacted if redact else content).alias("redacted_content"),
        )

    hits = _regex_hits(text, _chosen(categories))
    if model_hits is not None:
        hits = F.concat(F.coalesce(model_hits, F.array().cast(HIT_TYPE)), hits)
    if row_categories is not None:
        hits = _narrowed(hits, row_categories)
    return let(
        hits,
        lambda h: let(
            F.struct(h.alias("hits"), _first_per_position(h).alias("kept")), report
        ),
    )


def _narrowed(hits: Column, allowed: Column) -> Column:
    """Hits of the row's own categories, ranked in the row's order."""
    ranked = F.transform(
        hits,
        lambda h: h.withField(
            "category_rank", F.array_position(allowed, h["category"]).cast("int")
        ),
    )
    own = F.filter(ranked, lambda h: h["category_rank"] > 0)
    return F.when(F.coalesce(F.size(allowed), F.lit(0)) <= 0, hits).otherwise(own)


def redaction_request(df: DataFrame, content: str = "content",
                      categories: Sequence[str] = REDACTION_REQUEST_CATEGORIES,
                      redact: bool = True, **options) -> DataFrame:
    """Requests for redaction: three categories unless others are named; with ``redact``
    off the report only detects."""
    return with_pii(df, content, categories=categories, redact=redact, **options)


def with_pii(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Add the report as column ``pii``."""
    return df.withColumn("pii", pii_report(F.col(text), **options))


def detections(df: DataFrame, key: str, text: str = "text", **options) -> DataFrame:
    """One row per detection: ``key`` plus the detection fields."""
    options.setdefault("include_text", True)
    report = pii_report(F.col(text), redact=False, **options)
    return df.select(key, F.explode(report["detections"]).alias("d")).select(key, "d.*")


def map_extractions(extractions: DataFrame) -> DataFrame:
    """External labels to categories, ignoring case; unknown labels are dropped."""
    table = F.create_map(*[F.lit(x) for pair in EXTRACTION_CLASSES.items() for x in pair])
    category = F.try_element_at(table, F.lower("extraction_class"))
    return extractions.withColumn("category", category).where(F.col("category").isNotNull())


def _first_places(text: Column, strings: Column) -> Column:
    """Start of the first occurrence of each string, -1 where there is none.

    One pass over the text: all strings of a row are found by one automaton.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        for texts, wanted in batches:
            out = []
            for value, own in zip(texts, wanted):
                value, own = value.as_py(), own.as_py()
                if not own:
                    out.append(None if own is None else [])
                    continue
                found = {"": 0} if value is not None else {}
                automaton = ahocorasick.Automaton()
                for string in own:
                    if string:
                        automaton.add_word(string, string)
                left = len(automaton)
                if left and value:
                    automaton.make_automaton()
                    for end, string in automaton.iter(value):
                        if string not in found:
                            found[string] = end + 1 - len(string)
                            left -= 1
                            if not left:
                                break
                out.append([found.get(s, -1) for s in own])
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text, strings)


def _with_model_hits(
    documents: DataFrame,
    extractions: DataFrame,
    categories: Sequence[str] | None,
    key: str,
    text: str,
) -> DataFrame:
    """``documents`` with ``_located``: the extracted strings found in each text, in order.

    Strings are gathered per document first, so the text meets them in its own row and goes
    through one join at most. A document's list is as long as its different extractions.
    """
    chosen = _chosen(categories)
    rank = F.array_position(F.array(*[F.lit(c) for c in chosen]), F.col("category")).cast("int")
    wanted = (
        map_extractions(extractions)
        .where(F.col("category").isin(chosen) & F.col("extraction_text").isNotNull())
        .groupBy(key)
        .agg(
            F.collect_set(
                F.struct(rank.alias("category_rank"), "category", F.col("extraction_text").alias("text"))
            ).alias("_wanted")
        )
    )
    joined = documents.join(wanted, key, "left")
    # Texts without extractions stay in the JVM.
    asked = F.when(F.col("_wanted").isNotNull(), F.col(text))
    placed = joined.withColumn("_places", _first_places(asked, F.col("_wanted.text")))
    hits = F.zip_with(
        "_wanted",
        "_places",
        lambda w, at: F.struct(
            at.alias("start"),
            (at + F.length(w["text"])).cast("int").alias("end"),
            w["category_rank"].alias("category_rank"),
            w["category"].alias("category"),
            w["text"].alias("text"),
        ),
    )
    located = F.array_sort(F.filter(hits, lambda h: h["start"] >= 0))
    return placed.withColumn("_located", located).drop("_wanted", "_places")


def _first_at_each_place(located: Column) -> Column:
    """Sorted hits without those at the position of the one before."""
    return F.filter(
        located,
        lambda h, i: (i == 0)
        | (F.get(located, i - 1)["start"] != h["start"])
        | (F.get(located, i - 1)["end"] != h["end"]),
    )


def locate_extractions(
    documents: DataFrame,
    extractions: DataFrame,
    categories: Sequence[str] | None = None,
    key: str = "document_id",
    text: str = "text",
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Place extracted strings at their first occurrence in the document.

    Strings not in the text and categories not asked for are dropped. One row per (document,
    start, end); ``categories`` has all categories that were found there.
    """
    found = _with_model_hits(documents.select(key, text), extractions, categories, key, text)
    located = F.col("_located")
    return (
        found.select(key, F.explode(_first_at_each_place(located)).alias("h"), located)
        .select(
            key,
            "h.category",
            "h.text",
            "h.start",
            "h.end",
            "h.category_rank",
            F.transform(
                F.filter(
                    "_located",
                    lambda x: (x["start"] == F.col("h.start")) & (x["end"] == F.col("h.end")),
                ),
                lambda x: x["category"],
            ).alias("categories"),
        )
        .withColumn("confidence", F.lit(MODEL_CONFIDENCE))
        .withColumn("source", F.lit(MODEL_SOURCE))
    )


def with_pii_and_extractions(
    documents: DataFrame,
    extractions: DataFrame,
    categories: Sequence[str] | None = None,
    key: str = "document_id",
    text: str = "text",
    settings: Settings = DEFAULTS,
    **options,
) -> DataFrame:
    """The report over regex and model hits together, as column ``pii``.

    Model hits are unique per position, so the array of a document is bounded by its own
    text. ``categories_found`` has the categories of all located hits, also of those that
    share a position. With the master switch off no extraction is looked at.
    """
    if not settings.pii_enabled:
        return documents.withColumn("pii", pii_report(F.col(text), categories, settings=settings, **options))
    found = _with_model_hits(documents, extractions, categories, key, text)
    model_hits = F.transform(
        _first_at_each_place(F.col("_located")),
        lambda h: F.struct(
            h["start"].alias("start"),
            h["end"].alias("end"),
            F.lit(0).alias("source_rank"),
            h["category_rank"].alias("category_rank"),
            F.lit(0).alias("pattern_rank"),
            h["category"].alias("category"),
            h["text"].alias("text"),
            F.lit(MODEL_CONFIDENCE).alias("confidence"),
            F.lit(MODEL_SOURCE).alias("source"),
        ),
    )
    report = pii_report(
        F.col(text),
        categories,
        model_hits=model_hits.cast(HIT_TYPE),
        settings=settings,
        **options,
    )
    more = F.coalesce(F.col("_located.category"), F.array().cast("array<string>"))
    every = F.array_sort(F.array_union(report["categories_found"], more))
    return found.withColumn("pii", report.withField("categories_found", every)).drop("_located")
