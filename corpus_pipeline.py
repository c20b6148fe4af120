"""The corpus pipeline: documents go through five stages, each written and read again.

Every stage works on all that its predecessor kept, takes and returns whole rows, and keeps
rows whose id is null. The first four return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontamination, near_copies, pieces, quality, repeats
from docloom.llm.base import stored, table

PIECES = "piece_bpe_32k.model"
PASSAGE_WORDS = 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    return quality.reject(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard 0.8 of five words) stays."""
    return near_copies.drop_copies(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words, or of 400 bytes and more, that stand elsewhere too are cut
    out of the texts."""
    return repeats.remove(docs, n_words=PASSAGE_WORDS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding them gives the text back."""
    coded = pieces.encode(docs, public_tokenizers.path(PIECES))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select(
        *docs.columns, F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip")
    )


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]
# Stages learn, estimate and tokenise, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
