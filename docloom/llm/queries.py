"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import (
    byte_bpe,
    centroids,
    decontamination,
    language,
    near_copies,
    near_vectors,
    pieces,
    quality,
    repeats,
    resampling,
    sql,
    suffix_tree_lm,
    token_files,
    url_query,
)
from docloom.llm.base import id_remainder, table
from docloom.session import work_path


def op1_suffix_tree_lm(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text; a tenth of the ids is held out from learning."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return suffix_tree_lm.score(docs.withColumn("held_out", id_remainder(10) == 0), "held_out")


def op2_cross_polytope_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors of one label at a cosine of 0.93."""
    return near_vectors.near_vectors(table(spark, folder, "embeddings"), least=0.93)


def op3_output_code_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by output codes; a fifth of the ids is held out."""
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(id_remainder(5) != 0).select("text", "lang"))
    held_out = (id_remainder(5) == 0).alias("held_out")
    found = language.identify(docs.select("doc_id", held_out, "text"), model)
    return found.drop("text")


def op4_rans_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written and read back; 2 ends a document."""
    path = work_path(spark, "token-files")
    docs = table(spark, folder, "documents")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end=2)
    return token_files.read(spark, path, with_ids=False)


def op5_setsketch_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85."""
    return near_copies.near_copies(table(spark, folder, "documents"), percent=85)


def op6_piece_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to pieces with byte spans and decoded again; digests of both."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # An empty or null text has no last piece.
    last = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))
    tiled = last == F.coalesce(F.octet_length("text"), F.lit(0))
    # Cut out of the list's own text, "[1,2]": no string is made for each id of a long text.
    joined = F.substring_index(F.substr(F.to_json("ids"), F.lit(2)), "]", 1)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        tiled.alias("spans_reach_end"),
    )


def op7_qgram_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item found in a document, with edits and original byte span."""
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_rule_ensemble_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by the rule ensemble; a third of the ids is held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, folder, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (id_remainder(3) == 1).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_lyndon_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document covered by a 400-byte string that starts elsewhere too; beside
    them its passages of over 50 words that stand elsewhere too, which are not removed."""
    found = repeats.removed(table(spark, folder, "documents"), length=400, n_words=51)
    sizes = F.transform("word_spans", lambda s: s["high"] - s["low"])
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        "text",
        F.size("word_spans").cast("long").alias("n_passages"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("passage_bytes"),
    )


def op11_position_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Importance weights of all documents towards the benchmark; a twentieth is drawn."""
    drawn = resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_incremental_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds, with exact integer distances."""
    return centroids.centroid_clusters(table(spark, folder, "embeddings")).drop("centroid")


def op13_queue_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every text encoded to byte-level BPE ids and decoded again; digests of both."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_suffix_tree_lm": op1_suffix_tree_lm,
    "op2_cross_polytope_dedup": op2_cross_polytope_dedup,
    "op3_output_code_language": op3_output_code_language,
    "op4_rans_token_files": op4_rans_token_files,
    "op5_setsketch_dedup": op5_setsketch_dedup,
    "op6_piece_offsets": op6_piece_offsets,
    "op7_qgram_decontamination": op7_qgram_decontamination,
    "op8_rule_ensemble_quality": op8_rule_ensemble_quality,
    "op9_lyndon_suffix_dedup": op9_lyndon_suffix_dedup,
    "op10_temporal_url_lists": url_query.op10_temporal_url_lists,
    "op11_position_crc_resampling": op11_position_crc_resampling,
    "op12_incremental_centroids": op12_incremental_centroids,
    "op13_queue_byte_bpe": op13_queue_byte_bpe,
}
SQL = {
    "op10_temporal_url_lists": url_query.SQL,
    "op11_position_crc_resampling": sql.RESAMPLING,
    "op12_incremental_centroids": sql.CENTROIDS,
}
