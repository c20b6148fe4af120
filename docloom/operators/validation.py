"""Limits on request rows, as columns instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings


def _with_reasons(df: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """``valid`` and the list of broken limits; a null value breaks a limit too."""
    reasons = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in checks])
    )
    return df.withColumn("reject_reasons", reasons).withColumn(
        "valid", F.size("reject_reasons") == 0
    )


def validate_search(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Query text, result count and threshold; absent optional columns take defaults."""
    cols = queries.columns
    k = F.coalesce(F.col("top_k"), F.lit(settings.top_k)) if "top_k" in cols else None
    floor = (
        F.coalesce(F.col("similarity_threshold"), F.lit(settings.similarity_threshold))
        if "similarity_threshold" in cols
        else None
    )
    if k is not None:
        queries = queries.withColumn("top_k", k)
    if floor is not None:
        queries = queries.withColumn("similarity_threshold", floor)
    checks = [(F.length("query").between(1, settings.max_query_chars), "query length")]
    if k is not None:
        checks.append((F.col("top_k").between(1, settings.max_top_k), "top_k"))
    if floor is not None:
        checks.append((F.col("similarity_threshold").between(0, 1), "similarity_threshold"))
    return _with_reasons(queries, checks)


def validate_agent_query(queries: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    ok = F.length("query").between(1, settings.max_agent_query_chars)
    return _with_reasons(queries, [(ok, "query length")])


def validate_redaction(requests: DataFrame) -> DataFrame:
    return _with_reasons(requests, [(F.length("content") >= 1, "content length")])
