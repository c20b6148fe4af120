"""One function per registered query: (session, folder of Parquet tables) to DataFrame.

Every query reads its tables whole. Inputs the tables lack (file names, namespaces,
extractor output, times) are derived from their columns by Spark.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.functions import text as tx
from docloom.functions import vectors as fv
from docloom.operators import (
    approximate,
    chunking,
    context,
    embedding,
    inverted,
    nearest,
    pii,
    sections,
)
from docloom.operators import catalog as cat
from docloom.operators import validation as val
from docloom.operators import vectors as vec
from docloom.plans import ingest
from docloom.plans import search as srch
from docloom.session import work_path
from docloom.sources import files
from docloom.sources.cache_table import CacheTable
from docloom.sources.vector_table import VectorTable
from docloom.streaming import ingest as stream

TEXT_DIM = 384
EMBEDDER = embedding.HashedTokenEmbedder(TEXT_DIM)
SMALL_EMBEDDER = embedding.HashedTokenEmbedder(64)
VEC_DIM = 64
SEARCH = replace(DEFAULTS, similarity_threshold=0.3)
# Waves small enough that the test tables need several of them: 400 queries of 64 doubles.
BLOCKS = replace(DEFAULTS, broadcast_query_bytes=400 * 64 * 8)
EVICT = replace(DEFAULTS, cache_max_entries=100, cache_evict_entries=300)
UPLOAD = replace(DEFAULTS, max_upload_bytes=4000)
NODES = replace(DEFAULTS, node_max_tokens=150)
SCAN = replace(DEFAULTS, max_upload_bytes=200_000)
PII_OFF = replace(DEFAULTS, pii_enabled=False)
# The test vectors have no structure, so most lists have to be probed.
LISTS, PROBES = 16, 12


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Even out the partitions of a table before row-heavy work.

    A table of few files has few partitions; one of many is left as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with paragraphs: the tables mark them by single line breaks."""
    return spread(table(spark, folder, "documents")).select(
        "doc_id",
        F.col("doc_id").cast("string").alias("document_id"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
        "text",
        "lang",
        "source",
    )


def created_at(doc_id: str = "doc_id") -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return start + F.make_dt_interval(mins=F.col(doc_id).cast("int"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def filename() -> Column:
    ending = (
        F.when(F.col("lang") == "en", ".MD")
        .when(F.col("lang") == "fr", ".tar.HTM")
        .when(F.col("lang") == "de", "")
        .otherwise(".webp")
    )
    return F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), ending)


def upload_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploaded files: Markdown, plain text, broken encoding, other formats."""
    lang = F.col("lang")
    ending = F.when(lang == "en", ".md").when(lang == "es", ".pdf").otherwise(".txt")
    content = F.when(lang == "fr", F.encode("content", "ISO-8859-1")).otherwise(
        F.encode("content", "UTF-8")
    )
    return documents(spark, folder).select(
        "doc_id",
        F.concat(F.lit("/in/"), F.col("document_id"), ending).alias("path"),
        F.concat(F.lit("d"), F.col("document_id"), ending).alias("filename"),
        F.octet_length("text").cast("long").alias("length"),
        created_at().alias("modificationTime"),
        content.alias("content"),
    )


# Text measures and ids


def document_ids(spark, folder):
    name = filename()
    return table(spark, folder, "documents").select(
        "doc_id",
        tx.file_type(name).alias("file_type"),
        tx.document_id(F.encode("text", "UTF-8"), name).alias("document_id"),
        tx.word_count(F.col("text")).cast("long").alias("word_count"),
        F.length("text").cast("long").alias("char_count"),
        tx.text_key(F.col("text")).alias("text_key"),
    )


def upload_admission(spark, folder):
    docs = table(spark, folder, "documents").select(
        "doc_id", filename().alias("filename"), F.octet_length("text").alias("length")
    )
    return files.admit(docs, UPLOAD).select("doc_id", "file_type", "reject_reason")


def extract_status(spark, folder):
    got = files.extract(upload_files(spark, folder))
    return got.select(
        "document_id",
        "filename",
        "file_type",
        "status",
        "error_message",
        F.col("word_count").cast("long").alias("word_count"),
        F.col("metadata.title").alias("title"),
    )


def html_text(spark, folder):
    raw = spread(table(spark, folder, "pages")).select(
        F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"),
        F.encode("html", "UTF-8").alias("content"),
        F.octet_length("html").cast("long").alias("length"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
    )
    return files.extract(raw).select(
        "filename",
        "content",
        "metadata.title",
        "metadata.has_tables",
        "metadata.has_images",
        F.col("word_count").cast("long").alias("word_count"),
        "status",
    )


def scanned_files(spark, folder):
    """Texts written as files, one per source and language, then scanned and extracted."""
    target = work_path(spark, "uploads")
    docs = table(spark, folder, "documents").select("source", "lang", "text")
    docs.repartition("source", "lang").write.partitionBy("source", "lang").text(target)
    accepted, rejected = files.scan_files(spark, target, SCAN)
    parts = [F.regexp_extract("path", f"{c}=([^/]+)", 1).alias(c) for c in ("source", "lang")]
    words_of = files.extract(accepted).select("filename", "word_count", "file_size")
    size = F.sum("length").cast("long").alias("bytes")
    read = accepted.groupBy(*parts).agg(size).withColumn("reason", F.lit(None).cast("string"))
    refused = rejected.groupBy(*parts, F.col("reject_reason").alias("reason")).agg(size)
    total = words_of.agg(F.sum("word_count").cast("long").alias("n")).scalar()
    return read.select("source", "lang", "bytes", "reason", total.alias("words_read")).unionByName(
        refused.select("source", "lang", "bytes", "reason", total.alias("words_read"))
    )


def media_counts(spark, folder):
    """Tables and images of Markdown files, some added to the texts."""
    table_of = F.lit("\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    image = F.lit("\n\n![x](y.png)")
    doc_id = F.col("doc_id").cast("int")
    made = documents(spark, folder).select(
        F.concat("document_id", F.when(F.col("lang") == "en", ".md").otherwise(".txt")).alias("filename"),
        F.encode(F.concat("text", F.repeat(table_of, doc_id % 2), F.repeat(image, doc_id % 3)), "UTF-8").alias("content"),
        F.octet_length("text").cast("long").alias("length"),
        created_at().alias("modificationTime"),
    )
    counts = [F.col(f"metadata.{c}").cast("long").alias(c) for c in ("table_count", "image_count")]
    return files.extract(made).select("filename", *counts)


# Personal data

# Account notes made from customer columns, with personal data of every category.
CUSTOMER_NOTE = """concat(
  c_name, ' password: "', substr(md5(cast(c_custkey as string)), 1, 12), '" api_key=',
  md5(c_name), ' or sk-', md5(cast(c_custkey as string)), ' ssn ',
  lpad(cast(c_custkey % 1000 as string), 3, '0'), '-', lpad(cast(c_nationkey as string), 2, '0'),
  '-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ' lives at ',
  cast(1 + c_custkey % 99999 as string), ' ', lower(c_mktsegment), ' Street, mail c.',
  cast(c_custkey as string), '@example.com, phone (2', lpad(cast(c_nationkey as string), 2, '0'),
  ') 555-', lpad(cast(c_custkey % 10000 as string), 4, '0'), ', card 4',
  lpad(cast(c_custkey as string), 15, '1'), ' pwd = ', md5(c_mktsegment), ' end')"""


def customer_notes(spark: SparkSession, folder: str) -> DataFrame:
    customers = spread(table(spark, folder, "customer"))
    return customers.select("c_custkey", F.expr(CUSTOMER_NOTE).alias("text"))


def pii_spans(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return pii.detections(docs, "doc_id").select(
        "doc_id", "category", "text", "start", "end", "confidence", "source"
    )


def customer_pii(spark, folder):
    notes = customer_notes(spark, folder)
    return pii.detections(notes, "c_custkey").select(
        "c_custkey", "category", "text", "start", "end"
    )


def customer_redacted(spark, folder):
    notes = customer_notes(spark, folder)
    return pii.with_pii(notes).select(
        "c_custkey",
        F.col("pii.redacted_content").alias("redacted"),
        F.array_join("pii.categories_found", ",").alias("categories_found"),
    )


def pii_summary(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return pii.with_pii(docs, redact=False).select(
        "doc_id", "pii.has_pii", F.array_join("pii.categories_found", ",").alias("categories_found")
    )


def pii_redacted(spark, folder):
    docs = spread(table(spark, folder, "documents"))
    return pii.with_pii(docs).select("doc_id", F.col("pii.redacted_content").alias("redacted"))


def pii_request(spark, folder):
    """The redaction request with its three default categories, over conversations."""
    turns = table(spark, folder, "conversations").withColumnRenamed("text", "content")
    checked = val.validate_redaction(turns).where("valid")
    return pii.redaction_request(checked).select(
        "conv_id", "turn", "pii.has_pii", F.col("pii.redacted_content").alias("redacted")
    )


def _extractions(docs: DataFrame) -> DataFrame:
    """Stand-in for an external extractor: labelled strings found in the texts."""
    def found(label: str, pattern: str) -> Column:
        return F.transform(
            F.regexp_extract_all("text", F.lit(pattern), 0),
            lambda t: F.struct(F.lit(label).alias("extraction_class"), t.alias("extraction_text")),
        )

    every = F.concat(
        found("Email", "[a-z0-9.]+@[a-z0-9.]+[a-z]"),
        found("CARD_NUMBER", "[0-9]{16}"),
        found("access_token", "[0-9a-f]{40}"),
        found("company", "^[A-Z][a-z]+"),
    )
    return docs.select("document_id", F.explode(every).alias("x")).select("document_id", "x.*")


def pii_extractions(spark, folder):
    docs = documents(spark, folder).select("document_id", "text")
    merged = pii.with_pii_and_extractions(docs, _extractions(docs), include_text=True)
    return merged.select("document_id", F.explode("pii.detections").alias("d")).select(
        "document_id", "d.category", "d.text", "d.start", "d.end", "d.confidence", "d.source"
    )


def pii_categories(spark, folder):
    """Categories of a document over both detectors; every string has two labels."""
    docs = documents(spark, folder).select("document_id", "text")
    found = _extractions(docs)
    again = found.withColumn("extraction_class", F.lit("ADDRESS"))
    merged = pii.with_pii_and_extractions(docs, found.unionByName(again))
    return merged.select(
        "document_id",
        F.array_join("pii.categories_found", ",").alias("categories_found"),
        F.size("pii.detections").cast("long").alias("detections"),
    )


def pii_switched_off(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.with_pii(docs, settings=PII_OFF).select(
        "doc_id",
        "pii.has_pii",
        F.size("pii.categories_found").cast("long").alias("categories"),
        F.size("pii.detections").cast("long").alias("detections"),
        (F.col("pii.redacted_content") == F.col("text")).alias("unchanged"),
    )


# Chunks


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "document_id",
        "chunk_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        "content",
        F.col("char_count").cast("long").alias("char_count"),
        F.col("word_count").cast("long").alias("word_count"),
    )


def chunks(spark, folder):
    return _chunk_columns(chunking.chunk_documents(documents(spark, folder)))


def chunk_counts(spark, folder):
    made = chunking.chunk_documents(documents(spark, folder))
    return chunking.chunk_counts(made).select(
        "document_id", F.col("chunk_count").cast("long").alias("chunk_count")
    )


def section_nodes(spark, folder):
    return sections.document_nodes(documents(spark, folder), settings=NODES).select(
        "document_id",
        F.col("node_index").cast("long").alias("node_index"),
        F.col("token_count").cast("long").alias("token_count"),
        "content",
    )


# Embedding and cache


def _nonzero(df: DataFrame, key: str) -> DataFrame:
    entries = F.transform(
        "embedding",
        lambda x, i: F.struct(
            i.cast("long").alias("bucket"), F.round(x.cast("double"), 6).alias("value")
        ),
    )
    kept = F.filter(entries, lambda e: e["value"] != 0)
    return df.select(key, F.explode(kept).alias("e")).select(key, "e.bucket", "e.value")


def embedded(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return _nonzero(embedding.with_embedding(docs, "text", EMBEDDER), "doc_id")


def _good_texts(spark: SparkSession, folder: str) -> DataFrame:
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return documents(spark, folder).join(good, "doc_id", "left_semi")


def cache_split(spark, folder):
    """Which distinct texts a cache of the good documents would serve."""
    cache = embedding.distinct_texts(_good_texts(spark, folder), "text")
    texts = embedding.distinct_texts(documents(spark, folder), "text")
    return embedding.mark_cached(texts, cache).select("text_key", "copies", "cached")


def cache_embed(spark, folder):
    """Two batches through a stored cache; the second only encodes what is new."""
    cache = CacheTable(spark, work_path(spark, "cache"))
    cols = ["doc_id", "text"]
    cache.embed_texts(_good_texts(spark, folder).select(*cols), "text", EMBEDDER, 1, ["doc_id"])
    got = cache.embed_texts(documents(spark, folder).select(*cols), "text", EMBEDDER, 2, ["doc_id"])
    keyed = got.withColumn("text_key", tx.text_key(F.col("text")))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return keyed.join(cache.read().select("text_key", "inserted_seq"), "text_key").select(
        "doc_id", "inserted_seq", F.round(size, 4).alias("magnitude")
    )


def cache_clear(spark, folder):
    """Entries that a cleared cache had held, and what a batch after it finds."""
    cache = CacheTable(spark, work_path(spark, "cache"))
    cache.embed_texts(_good_texts(spark, folder).select("doc_id", "text"), "text", SMALL_EMBEDDER, 1, ["doc_id"])
    cleared = cache.clear()
    docs = table(spark, folder, "documents")
    left = cache.lookup(docs.select(tx.text_key(F.col("text")).alias("text_key")))
    return left.agg(F.lit(cleared).cast("long").alias("cleared"), F.count(F.lit(1)).alias("found"))


def _doc_cache(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select(tx.text_key(F.col("text")).alias("text_key"), "doc_id")
    return docs.groupBy("text_key").agg(F.min("doc_id").alias("inserted_seq"))


def cache_evict(spark, folder):
    return embedding.evict_oldest(_doc_cache(spark, folder), EVICT)


def cache_fresh(spark, folder):
    cache = _doc_cache(spark, folder).withColumn("inserted_at", created_at("inserted_seq"))
    now = F.lit("2024-01-01 09:00:00").cast("timestamp")
    return embedding.fresh_entries(cache, now).select("text_key", "inserted_seq")


# Vectors


def vector_frame(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label")
    return table(spark, folder, "embeddings").select(
        F.when(label < 5, "low").otherwise("high").alias("namespace"),
        F.col("vec_id").cast("string").alias("id"),
        F.concat(F.lit("d"), label.cast("string")).alias("document_id"),
        F.col("embedding").alias("values"),
        F.to_variant_object(
            F.struct("label", F.concat(F.lit("d"), label.cast("string")).alias("document_id"))
        ).alias("metadata"),
        "label",
    )


def label_means(spark: SparkSession, folder: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    parts = table(spark, folder, "embeddings").select(
        "label", F.posexplode("embedding").alias("pos", "x")
    )
    means = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    gathered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return gathered.select(F.col("label").alias("query_id"), F.col("v.x").alias("query_vector"))


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(
        F.col("query_id").cast("long").alias("query_id"),
        "id",
        F.round("score", 6).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


def similarity(spark, folder):
    """Cosine of every vector with the mean of its label."""
    v = vector_frame(spark, folder).select("label", "id", "values")
    means = label_means(spark, folder)
    return v.join(means, v["label"] == means["query_id"]).select(
        "id", F.round(fv.cosine_similarity(F.col("values"), F.col("query_vector")), 6).alias("score")
    )


def normalized(spark, folder):
    scaled = F.transform("values", lambda x: x * F.lit(3).cast("float"))
    unit = fv.l2_normalize(scaled)
    return vector_frame(spark, folder).select(
        "id",
        fv.dimension(unit).cast("long").alias("dimension"),
        F.round(fv.norm(unit), 4).alias("length"),
        F.round(F.element_at(unit, 1).cast("double"), 5).alias("first"),
    )


def topk_single(spark, folder):
    """One query, the mean of all vectors, over one namespace."""
    parts = table(spark, folder, "embeddings").select(F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    query = means.agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).select("v.x")
    hits = srch.search(vector_frame(spark, folder), query.first()["x"], 7, "low")
    return hits.select(
        F.col("rank").cast("long").alias("rank"),
        "document_id",
        "chunk_id",
        F.round("score", 6).alias("score"),
        F.try_variant_get("metadata", "$.label", "bigint").alias("label"),
        "page_number",
        "section_title",
    )


def topk_batch(spark, folder):
    vectors = vector_frame(spark, folder).withColumn("namespace", F.lit("default"))
    return _ranked(nearest.nearest(vectors, label_means(spark, folder), VEC_DIM))


def topk_blocks(spark, folder):
    """Every vector as a query, in several waves."""
    vectors = vector_frame(spark, folder).withColumn("namespace", F.lit("default"))
    queries = vectors.select(
        F.col("id").cast("long").alias("query_id"), F.col("values").alias("query_vector")
    )
    return _ranked(nearest.nearest(vectors, queries, VEC_DIM, BLOCKS))


def filtered_topk(spark, folder):
    """Namespace per query, a metadata filter and a score threshold."""
    condition = {"$or": [{"label": {"$in": [1, 2, 8]}}, {"document_id": "d6"}], "label": {"$ne": 2}}
    vectors = vector_frame(spark, folder)
    kept = vectors.where(vec.record_filter(condition, vectors))
    queries = label_means(spark, folder).withColumn(
        "namespace", F.when(F.col("query_id") < 5, "low").otherwise("high")
    )
    queries = queries.withColumn("top_k", F.lit(8)).withColumn("similarity_threshold", F.lit(0.1))
    return _ranked(nearest.nearest(kept, queries, VEC_DIM))


def _celled(spark: SparkSession, folder: str) -> DataFrame:
    return approximate.by_cell(
        vector_frame(spark, folder).withColumn("namespace", F.lit("default")), 4
    )


def approximate_topk(spark, folder):
    return _ranked(
        approximate.nearest_approximate(
            _celled(spark, folder), label_means(spark, folder), VEC_DIM, 4, 1
        )
    )


def approximate_recall(spark, folder):
    vectors = vector_frame(spark, folder).withColumn("namespace", F.lit("default"))
    queries = label_means(spark, folder)
    exact = nearest.nearest(vectors, queries, VEC_DIM)
    near = approximate.nearest_approximate(_celled(spark, folder), queries, VEC_DIM, 4, 1)
    return approximate.recall(near, exact).select(
        "exact_hits", "found_hits", F.round("recall", 6).alias("recall")
    )


def _lists(spark: SparkSession, folder: str):
    vectors = vector_frame(spark, folder).withColumn("namespace", F.lit("default"))
    quantizer = inverted.fit(vectors, VEC_DIM, LISTS)
    return inverted.by_list(vectors.select("namespace", "id", "values"), quantizer), quantizer


def inverted_topk(spark, folder):
    """Inverted lists with every list probed: the exact hits, out of all lists."""
    listed, quantizer = _lists(spark, folder)
    return _ranked(inverted.nearest_probed(listed, label_means(spark, folder), quantizer, LISTS))


def inverted_recall(spark, folder):
    """Every vector as a query, probing three lists in four: are nine exact hits in ten found?"""
    listed, quantizer = _lists(spark, folder)
    vectors = vector_frame(spark, folder).withColumn("namespace", F.lit("default"))
    queries = vectors.select(
        F.col("id").cast("long").alias("query_id"), F.col("values").alias("query_vector")
    )
    exact = nearest.nearest(vectors, queries, VEC_DIM)
    near = inverted.nearest_probed(listed, queries, quantizer, PROBES)
    return approximate.recall(near, exact).select(
        "exact_hits", (F.col("recall") >= 0.9).alias("reached")
    )


def search_rejects(spark, folder):
    """Queries without a usable vector or count."""
    q = F.col("query_id")
    broken = label_means(spark, folder).select(
        "query_id",
        F.when(q == 3, F.slice("query_vector", 1, 9)).when(q != 7, F.col("query_vector")).alias("query_vector"),
        F.when(q == 5, F.lit(0)).when(q < 2, F.lit(9)).alias("top_k"),
    )
    return nearest.query_rejects(broken, VEC_DIM).select(
        "query_id", "namespace", F.col("top_k").cast("long").alias("top_k"), "reason"
    )


def _stored_vectors(spark: SparkSession, folder: str) -> VectorTable:
    store = VectorTable(spark, work_path(spark, "vectors"), VEC_DIM, buckets=4)
    store.upsert(vector_frame(spark, folder).drop("label"), unique=True)
    return store


def _record_columns(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "namespace",
        "id",
        "document_id",
        F.round(F.element_at("values", 1).cast("double"), 6).alias("first_value"),
        F.try_variant_get("metadata", "$.label", "bigint").alias("label"),
    )


def upsert(spark, folder):
    """Replace some records (the last of two versions wins), add others."""
    store = _stored_vectors(spark, folder)
    base = vector_frame(spark, folder)
    changed = base.where("label >= 3")
    first = changed.withColumn("ordinal", F.lit(1))
    second = changed.withColumn("ordinal", F.lit(2)).withColumn(
        "values", F.transform("values", lambda x: -x)
    )
    added = base.where("label < 3").withColumn("ordinal", F.lit(1)).withColumn(
        "id", F.concat(F.lit("new-"), "id")
    )
    store.upsert(first.unionByName(second).unionByName(added).drop("label"))
    return _record_columns(store.read())


def compacted(spark, folder):
    """Three batches and two deletions, compacted, one more batch, compacted and vacuumed."""
    store = VectorTable(spark, work_path(spark, "vectors"), VEC_DIM, buckets=4)
    base = vector_frame(spark, folder)

    def times(n: int) -> Column:
        return F.transform("values", lambda x: x * F.lit(n).cast("float"))

    store.upsert(base.where("label < 7").drop("label"), unique=True)
    store.upsert(base.where("label >= 3").withColumn("values", times(-1)).drop("label"))
    bad = table(spark, folder, "labels").where("quality = 0")
    store.delete(ids=bad.select(F.col("doc_id").cast("string").alias("id")), namespace="low")
    store.delete(condition={"label": 8}, namespace="high")
    store.compact()
    store.upsert(base.where("label = 0").withColumn("values", times(2)).drop("label"))
    store.compact()
    store.vacuum()
    return _record_columns(store.read())


def upsert_rejects(spark, folder):
    """What an upsert refused, kept with its reason, and what it took."""
    label = F.col("label")
    mixed = vector_frame(spark, folder).withColumn(
        "values",
        F.when(label == 3, F.slice("values", 1, 32)).when(label != 4, F.col("values")),
    )
    store = VectorTable(spark, work_path(spark, "vectors"), VEC_DIM, buckets=4)
    taken = store.upsert(mixed.drop("label"))
    return store.rejects().select("namespace", "id", "reject_reason", F.lit(taken).cast("long").alias("taken"))


def delete_ids(spark, folder):
    store = _stored_vectors(spark, folder)
    ids = table(spark, folder, "labels").where("quality = 0")
    store.delete(ids=ids.select(F.col("doc_id").cast("string").alias("id")), namespace="low")
    return _record_columns(store.read())


def delete_filter(spark, folder):
    store = _stored_vectors(spark, folder)
    store.delete(condition={"label": {"$gte": 7, "$lt": 9}}, namespace="high")
    return _record_columns(store.read())


def delete_document(spark, folder):
    store = _stored_vectors(spark, folder)
    store.delete_by_document("d3", "low")
    return _record_columns(store.read())


def delete_all(spark, folder):
    store = _stored_vectors(spark, folder)
    store.delete(delete_all=True, namespace="low")
    return _record_columns(store.read())


def fetch(spark, folder):
    store = _stored_vectors(spark, folder)
    ids = table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return _record_columns(store.fetch(ids, "low"))


def index_stats(spark, folder):
    return vec.index_stats(vector_frame(spark, folder)).select(
        "namespace", "vector_count", F.col("dimension").cast("long").alias("dimension")
    )


def stats_history(spark, folder):
    at = F.lit("2024-01-01 00:05:00").cast("timestamp")
    return cat.stats_snapshot(vector_frame(spark, folder), at, VEC_DIM).select(
        "namespace", "vector_count", stamp(F.col("measured_at")).alias("measured_at")
    )


def stats_refresh(spark, folder):
    """The history after each of three batches, deletions and a compaction between them."""
    store = VectorTable(spark, work_path(spark, "vectors"), VEC_DIM, buckets=4)
    base = vector_frame(spark, folder).drop("label")
    label = F.substring("document_id", 2, 9).cast("int")
    store.upsert(base.where(label < 6), unique=True)
    store.refresh_stats()
    store.upsert(base.where(label >= 4))
    store.delete(condition={"label": 5}, namespace="high")
    store.refresh_stats()
    store.compact()
    store.delete(delete_all=True, namespace="low")
    store.upsert(base.where(label.isin(1, 5)))
    store.refresh_stats()
    return store.stats_history().select("seq", "namespace", "vector_count")


def vector_contract(spark, folder):
    label = F.col("label")
    bad = vector_frame(spark, folder).withColumn(
        "values",
        F.when(label == 3, F.slice("values", 1, 32)).when(label != 4, F.col("values")),
    )
    good, rejected = vec.contract(bad, VEC_DIM)
    return rejected.select("id", "reject_reason").unionByName(
        good.select("id", F.lit(None).cast("string").alias("reject_reason"))
    )


# Search over documents


def text_index(spark: SparkSession, folder: str) -> VectorTable:
    """Documents, chunked and embedded, as a stored vector table."""
    made = chunking.chunk_documents(documents(spark, folder))
    ready = embedding.with_embedding(made, "content", EMBEDDER)
    store = VectorTable(spark, work_path(spark, "index"), TEXT_DIM, buckets=8)
    store.upsert(vec.vector_records(ready), unique=True)
    return store


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    vectors = text_index(spark, folder)
    return srch.semantic_search(text_queries(spark, folder), vectors, EMBEDDER, settings=SEARCH)


def semantic_search(spark, folder):
    return _hits(spark, folder).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "document_id",
        "chunk_id",
        "content",
        F.round("score", 6).alias("score"),
        "page_number",
        "section_title",
    )


def search_totals(spark, folder):
    strict = replace(DEFAULTS, similarity_threshold=0.75)
    vectors = text_index(spark, folder)
    queries = text_queries(spark, folder)
    hits = srch.semantic_search(queries, vectors, EMBEDDER, include_metadata=False, settings=strict)
    return srch.totals(queries, hits)


def reranked(spark, folder):
    hits = srch.rerank(_hits(spark, folder), text_queries(spark, folder))
    return hits.select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "chunk_id",
        F.round("rerank_score", 6).alias("rerank_score"),
        F.round("score", 6).alias("score"),
    )


def source_references(spark, folder):
    names = documents(spark, folder).select("document_id", filename().alias("filename"))
    return srch.sources(_hits(spark, folder), names).select(
        "query_id",
        F.col("rank").cast("long").alias("rank"),
        "document_id",
        "document_name",
        "snippet",
        F.round("relevance_score", 6).alias("relevance_score"),
    )


def valid_queries(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.col("text").alias("query"),
        (F.col("turn") * 20).alias("top_k"),
        (F.col("turn") / 4).alias("similarity_threshold"),
    )
    agent = val.validate_agent_query(turns).select("conv_id", "turn", F.col("valid").alias("agent_valid"))
    return val.validate_search(turns).join(agent, ["conv_id", "turn"]).select(
        "conv_id", "turn", "valid", F.array_join("reject_reasons", ",").alias("reasons"), "agent_valid"
    )


def conversation_context(spark, folder):
    got = context.conversation_context(table(spark, folder, "conversations"), 3)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return got.select("conv_id", F.array_join(lines, "\n").alias("context"))


def token_usage(spark, folder):
    words = tx.word_count(F.col("text"))
    kind = F.when(F.col("role") == "user", "prompt_tokens").otherwise("completion_tokens")
    answers = table(spark, folder, "conversations").select(
        F.create_map(kind, words, F.lit("total_tokens"), words).alias("token_usage")
    )
    return context.token_usage(answers)


# Catalog


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    prepared = ingest.prepare(
        files.extract(upload_files(spark, folder)),
        processed_at=F.lit("2024-02-01 00:00:00").cast("timestamp"),
    )
    return cat.catalog_rows(prepared)


def catalog(spark, folder):
    return _catalog(spark, folder).select(
        "document_id",
        "filename",
        "file_type",
        "file_size",
        "page_count",
        F.col("word_count").cast("long").alias("word_count"),
        F.col("chunk_count").cast("long").alias("chunk_count"),
        "has_pii",
        F.array_join("pii_categories_found", ",").alias("pii_categories_found"),
        stamp(F.col("created_at")).alias("created_at"),
        "status",
        "error_message",
        "has_tree_index",
    )


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        "source",
        created_at().alias("created_at"),
    )


def catalog_page(spark, folder):
    return cat.page_of(_listing(spark, folder), page=3, page_size=15).select(
        "document_id", stamp(F.col("created_at")).alias("created_at"), "total", "has_more"
    )


def _collection(spark: SparkSession, folder: str) -> ingest.KnowledgeBase:
    """Uploaded files ingested in two batches."""
    base = ingest.KnowledgeBase(spark, work_path(spark, "kb"), SMALL_EMBEDDER, buckets=4)
    raw = upload_files(spark, folder)
    for half in (0, 1):
        base.ingest_files(raw.where(F.col("doc_id") % 2 == half).drop("doc_id", "path"), half, run="load")
    return base


def stored_catalog(spark, folder):
    """The catalog that ingest stores; the second batch comes twice."""
    base = _collection(spark, folder)
    again = upload_files(spark, folder).where("doc_id % 2 = 1").drop("doc_id", "path")
    base.ingest_files(again, 1, run="load")
    return base.catalog().select(
        "document_id",
        "filename",
        "namespace",
        F.col("word_count").cast("long").alias("word_count"),
        F.col("chunk_count").cast("long").alias("chunk_count"),
        "has_pii",
        F.array_join("pii_categories_found", ",").alias("pii_categories_found"),
        stamp(F.col("created_at")).alias("created_at"),
        "status",
        "error_message",
    )


def catalog_cursor(spark, folder):
    """The third page of the stored catalog, reached by the last rows of the first two."""
    rows = _collection(spark, folder).catalog()
    after = None
    for _ in range(2):
        last = cat.page_after(rows, after, 15).orderBy("created_at", F.desc("document_id")).first()
        after = (last["created_at"], last["document_id"]) if last else after
    return cat.page_after(rows, after, 15).select("document_id", stamp(F.col("created_at")).alias("created_at"))


def stored_deletion(spark, folder):
    """Catalog, chunk and vector counts of what is left after deleting stored documents."""
    base = _collection(spark, folder)
    gone = base.catalog().where("has_pii or status = 'failed'").select("document_id")
    report = base.delete_documents(gone, 0, run="deletions")
    chunks_left = base.chunks().groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"))
    vectors_left = base.vectors.read().groupBy("document_id").agg(F.count(F.lit(1)).alias("vectors"))
    deleted = report.where("deleted").agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        base.catalog()
        .select("document_id")
        .join(chunks_left, "document_id", "left")
        .join(vectors_left, "document_id", "left")
        .withColumn("deleted", deleted)
    )


def document_details(spark, folder):
    ids = table(spark, folder, "labels").where("toxic = 1").select(
        F.col("doc_id").cast("string").alias("document_id")
    )
    return cat.details(_listing(spark, folder), ids).select("document_id", "source")


def _delete_request(spark: SparkSession, folder: str) -> DataFrame:
    toxic = table(spark, folder, "labels").where("toxic = 1")
    known = toxic.select(F.col("doc_id").cast("string").alias("document_id"))
    unknown = toxic.select(F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias("document_id"))
    return known.union(unknown)


def deletion_report(spark, folder):
    return cat.deletion_report(_delete_request(spark, folder), _listing(spark, folder))


def documents_left(spark, folder):
    """Catalog and chunk rows that remain after the deletion."""
    made = chunking.chunk_documents(documents(spark, folder))
    rows, left = cat.delete_documents(
        _delete_request(spark, folder), _listing(spark, folder), made
    )
    n = chunking.chunk_counts(left)
    return rows.join(n, "document_id").select(
        "document_id", F.col("chunk_count").cast("long").alias("chunk_count")
    )


def pii_flags(spark, folder):
    """Catalog flags from a separate detection run."""
    docs = documents(spark, folder)
    base = docs.select(
        "document_id",
        F.lit(False).alias("has_pii"),
        F.array().cast("array<string>").alias("pii_categories_found"),
    )
    found = pii.with_pii(docs.select("document_id", "text"), redact=False)
    flags = found.where("pii.has_pii").select("document_id", "pii.has_pii", "pii.categories_found")
    return cat.with_flags(base, flags).select(
        "document_id",
        "has_pii",
        F.array_join("pii_categories_found", ",").alias("pii_categories_found"),
    )


STATUS_OF = {
    "signup": "pending",
    "view": "processing",
    "click": "processing",
    "purchase": "completed",
    "error": "failed",
}


def status_events(events: DataFrame) -> DataFrame:
    table_ = F.create_map(*[F.lit(x) for pair in STATUS_OF.items() for x in pair])
    return events.select(
        F.col("user_id").alias("id"),
        F.element_at(table_, F.col("event_type")).alias("status"),
        F.col("props").alias("error"),
        F.floor("value").cast("int").alias("progress"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def _states(spark: SparkSession, folder: str) -> DataFrame:
    return cat.latest_status(status_events(table(spark, folder, "events")))


def status_fold(spark, folder):
    return _states(spark, folder).select(
        "id",
        "status",
        "error",
        F.col("progress").cast("long").alias("progress"),
        stamp(F.col("created_at")).alias("created_at"),
        stamp(F.col("started_at")).alias("started_at"),
        stamp(F.col("completed_at")).alias("completed_at"),
    )


def status_counts(spark, folder):
    return cat.status_counts(_states(spark, folder))


def expired_uploads(spark, folder):
    uploads = upload_files(spark, folder).drop("content")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return cat.expired_uploads(uploads, 3600, now).select("path", "length")


# Streaming


def stream_chunks(spark, folder):
    """Chunks written by an incremental run over the documents."""
    target = work_path(spark, "chunks")
    store = stream.replace_batch(target)

    def handle(batch: DataFrame, number: int) -> None:
        docs = spread(batch).select(
            F.col("doc_id").cast("string").alias("document_id"),
            F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("content"),
        )
        store(chunking.chunk_documents(docs), number)

    source = stream.table_stream(spark, folder, "documents")
    stream.run_available(source, handle, work_path(spark, "checkpoint"))
    return _chunk_columns(spark.read.parquet(target))


def stream_index(spark, folder):
    """The whole ingest as a stream: redact, chunk, embed, upsert."""
    base = ingest.KnowledgeBase(spark, work_path(spark, "kb"), SMALL_EMBEDDER, buckets=8)

    def handle(batch: DataFrame, number: int) -> None:
        raw = spread(batch).select(
            F.lit("/in").alias("path"),
            F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
            F.octet_length("text").cast("long").alias("length"),
            created_at().alias("modificationTime"),
            F.encode(F.replace("text", F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content"),
        )
        base.ingest_files(raw, number)

    source = stream.table_stream(spark, folder, "documents")
    stream.run_available(source, handle, work_path(spark, "checkpoint"))
    return base.vectors.read().select(
        "id",
        "document_id",
        "namespace",
        F.try_variant_get("metadata", "$.filename", "string").alias("filename"),
        F.try_variant_get("metadata", "$.content", "string").alias("content"),
        F.try_variant_get("metadata", "$.missing", "string").alias("missing"),
    )


def _as_files(rows: DataFrame, name: Column, text: str) -> DataFrame:
    return spread(rows).select(
        F.concat(name, F.lit(".txt")).alias("filename"),
        F.octet_length(text).cast("long").alias("length"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modificationTime"),
        F.encode(F.replace(text, F.lit("\n"), F.lit("\n\n")), "UTF-8").alias("content"),
    )


def stream_replay(spark, folder):
    """Two streams into one collection, both counting from 0, every batch handled twice."""
    base = ingest.KnowledgeBase(spark, work_path(spark, "kb"), SMALL_EMBEDDER, buckets=4)
    names = {
        "documents": F.concat(F.lit("d"), F.col("doc_id").cast("string")),
        "benchmark": F.concat(F.lit("b"), F.col("item_id").cast("string")),
    }

    def replayed(run: str):
        store = base.handler(run)

        def handle(batch: DataFrame, number: int) -> None:
            raw = _as_files(batch, names[run], "text")
            if store(raw, number) != store(raw, number):
                raise AssertionError("a replay reports what the batch did")

        return handle

    for run in names:
        source = stream.table_stream(spark, folder, run)
        stream.run_available(source, replayed(run), work_path(spark, "checkpoint"))
    runs = base.ledger.entries().agg(F.countDistinct("run", "batch").alias("n")).scalar()
    return base.vectors.read().join(base.catalog().select("document_id", "filename"), "document_id").select(
        "id", "filename", F.try_variant_get("metadata", "$.content", "string").alias("content"),
        runs.alias("batches"),
    )


def stream_unique(spark, folder):
    """Uploads with copies suppressed by content."""
    uploads = stream.table_stream(spark, folder, "documents").select(
        tx.document_id(F.encode("text", "UTF-8"), F.lit("")).alias("document_id"),
        created_at().alias("created_at"),
    )
    target = work_path(spark, "unique")
    unique = stream.suppress_duplicates(uploads, "3650 days")
    stream.run_available(unique, stream.replace_batch(target), work_path(spark, "checkpoint"))
    return spark.read.parquet(target).select("document_id")


def stream_status(spark, folder):
    """Status counts per five minutes from the event stream."""
    events = status_events(stream.table_stream(spark, folder, "events"))
    target = work_path(spark, "status")
    live = stream.live_status_counts(events)
    stream.run_available(live, stream.replace_batch(target), work_path(spark, "checkpoint"), "update")
    return stream.latest_counts(spark.read.parquet(target)).select(
        stamp(F.col("start")).alias("start"), "status", "events"
    )


def stream_late(spark, folder):
    """Status counts over four batches, with the rows that came behind the watermark.

    Batches are quarters of the event time; each tenth event comes one batch late.
    """
    events = status_events(table(spark, folder, "events"))
    span = events.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    quarter = F.floor((F.unix_micros("ts") - span["a"]) * 4 / (span["b"] - span["a"] + 1))
    delayed = F.least(F.lit(3), quarter + F.when(F.col("seq") % 10 == 0, 1).otherwise(0))
    source, target = work_path(spark, "arrivals"), work_path(spark, "split")
    split = stream.LateSplit(spark, target, delay="10 minutes")
    checkpoint = work_path(spark, "checkpoint")
    arrivals = spark.readStream.schema(events.schema)
    for batch in range(4):
        events.where(delayed == batch).write.mode("append").parquet(source)
        stream.run_available(arrivals.parquet(source), split.handle, checkpoint)
    on_time = stream.status_counts_per_period(split.on_time())
    late = stream.status_counts_per_period(split.late()).withColumnRenamed("events", "late_events")
    both = on_time.join(late, ["start", "end", "status"], "full")
    return both.select(
        stamp(F.col("start")).alias("start"), "status",
        F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("late_events", F.lit(0)).alias("late_events"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        document_ids, upload_admission, extract_status, html_text, scanned_files, media_counts,
        pii_spans, customer_pii, customer_redacted, pii_summary, pii_redacted, pii_request,
        pii_extractions, pii_categories, pii_flags, pii_switched_off,
        chunks, chunk_counts, section_nodes,
        embedded, cache_split, cache_embed, cache_evict, cache_fresh, cache_clear,
        similarity, normalized, topk_single, topk_batch, topk_blocks, filtered_topk,
        approximate_topk, approximate_recall, inverted_topk, inverted_recall, search_rejects,
        upsert, compacted, upsert_rejects, delete_ids, delete_filter, delete_document, delete_all,
        fetch, index_stats, stats_history, stats_refresh, vector_contract,
        semantic_search, search_totals, reranked, source_references, valid_queries,
        conversation_context, token_usage,
        catalog, catalog_page, stored_catalog, catalog_cursor, stored_deletion,
        document_details, deletion_report, documents_left,
        status_fold, status_counts, expired_uploads,
        stream_chunks, stream_index, stream_replay, stream_unique, stream_status, stream_late,
    )
}
