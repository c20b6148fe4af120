"""Conversation context and token usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, Settings
from docloom.operators.skew import top_n


def conversation_context(turns: DataFrame, last: int, settings: Settings = DEFAULTS) -> DataFrame:
    """The last turns of every conversation in order, as one array per conversation."""
    recent = top_n(
        turns.select("conv_id", "turn", "role", "text"),
        ["conv_id"],
        [F.desc("turn"), F.asc("role"), F.asc("text")],
        last,
        spread_by=["turn", "role", "text"],
        settings=settings,
    )
    return recent.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )


def token_usage(answers: DataFrame, usage: str = "token_usage") -> DataFrame:
    """Totals per kind of token over all rows."""
    return (
        answers.select(F.explode(usage).alias("kind", "tokens"))
        .groupBy("kind")
        .agg(F.sum("tokens").alias("tokens"))
    )
