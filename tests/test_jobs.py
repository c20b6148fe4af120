from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import catalog as cat
from docloom.operators import context
from docloom.operators import validation as val
from docloom.operators.embedding import HashedTokenEmbedder
from docloom.plans import search as srch
from docloom.plans.ingest import KnowledgeBase
from docloom.session import work_path
from docloom.sources import files
from docloom.streaming import ingest as stream


@pytest.fixture()
def uploads(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title One\n\nMail me at x@y.org\n\n![p](q.png)\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    (tmp_path / "sub" / "b.html").write_text("<title>B</title><h1>B</h1><p>hello <b>world</b></p><img src=x><table></table>")
    (tmp_path / "c.txt").write_bytes(b"caf\xe9")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.exe").write_bytes(b"x")
    (tmp_path / "big.txt").write_text("y" * 5000)
    return str(tmp_path)


SMALL = Settings(max_upload_bytes=4000)


def test_scan_and_extract(spark, uploads):
    accepted, rejected = files.scan_files(spark, uploads, SMALL)
    assert {r["filename"]: r["reject_reason"] for r in rejected.collect()} == {
        "e.exe": "file type not allowed", "big.txt": "file too large"
    }
    docs = {r["filename"]: r for r in files.extract(accepted).collect()}
    assert {n: (d["status"], d["error_message"]) for n, d in docs.items()} == {
        "a.md": ("completed", None), "b.html": ("completed", None),
        "c.txt": ("failed", "not valid UTF-8"), "d.pdf": ("failed", "unsupported format: pdf"),
    }
    html, md = docs["b.html"], docs["a.md"]
    assert html["content"] == "B\n\n# B\n\nhello world"
    assert html["metadata"]["title"] == "B" and html["metadata"]["table_count"] == 1 and html["metadata"]["has_images"]
    assert md["metadata"]["title"] == "Title One" and md["metadata"]["image_count"] == 1
    assert md["metadata"]["has_tables"] and md["metadata"]["page_count"] is None
    assert docs["c.txt"]["content"] is None and docs["c.txt"]["word_count"] is None
    good, bad = files.split_failures(files.extract(accepted))
    assert good.count() == 2 and bad.count() == 2


def test_size_limit_is_pushed_into_the_file_source(spark, uploads):
    accepted, _ = files.scan_files(spark, uploads, SMALL)
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,4000)" in plan


def test_knowledge_base_streams_replays_and_deletes(spark, uploads):
    base = KnowledgeBase(spark, work_path(spark, "kb"), HashedTokenEmbedder(32), 2, nodes=True)
    written = []

    def handle(batch, number):
        written.append(base.ingest_files(batch, number))
        # The same batch again, as after a lost driver.
        base.ingest_files(batch, number)

    source = stream.file_stream(spark, uploads, settings=SMALL)
    stream.run_available(source, handle, work_path(spark, "ck"))
    assert sum(written) == 2
    catalog = {r["filename"]: r for r in base.catalog().collect()}
    assert len(catalog) == 4 and base.chunks().count() == 2 and base.vectors.read().count() == 2
    a = catalog["a.md"]
    assert a["has_pii"] and a["pii_categories_found"] == ["email"] and a["chunk_count"] == 1
    assert a["has_tree_index"] and a["tree_node_count"] == 1
    assert not catalog["c.txt"]["has_tree_index"]
    assert catalog["c.txt"]["status"] == "failed" and catalog["c.txt"]["chunk_count"] == 0
    # No vector or chunk holds the address.
    text = base.chunks().where(F.col("document_id") == a["document_id"]).first()["content"]
    assert "[REDACTED_EMAIL]" in text and "x@y.org" not in text

    queries = spark.createDataFrame([(1, "hello world"), (2, "zzzz")], "query_id INT, query STRING")
    loose = Settings(similarity_threshold=0.5)
    hits = srch.semantic_search(queries, base.vectors, base.embedder, settings=loose)
    assert [r["document_id"] for r in hits.collect()] == [catalog["b.html"]["document_id"]]
    totals = {r["query_id"]: r["total_results"] for r in srch.totals(queries, hits).collect()}
    assert totals == {1: 1, 2: 0}
    named = srch.sources(hits, base.catalog()).first()
    assert named["document_name"] == "b.html" and "hello world" in named["snippet"]

    ids = spark.createDataFrame([(a["document_id"],), ("unknown",)], "document_id STRING")
    report = {r["document_id"]: r["deleted"] for r in base.delete_documents(ids, 50).collect()}
    assert report == {a["document_id"]: True, "unknown": False}
    assert base.catalog().count() == 3 and base.chunks().count() == 1 and base.vectors.read().count() == 1
    # Uploading it again brings it back.
    accepted, _ = files.scan_files(spark, uploads, SMALL)
    base.ingest_files(accepted, 51)
    assert base.catalog().count() == 4 and base.vectors.read().count() == 2


def test_rerank_prefers_shared_tokens(spark):
    queries = spark.createDataFrame([(1, "red green blue")], "query_id INT, query STRING")
    hits = spark.createDataFrame(
        [(1, "a", "red things", 0.9), (1, "b", "blue red", 0.8), (1, "c", "green RED", 0.85)],
        "query_id INT, chunk_id STRING, content STRING, score DOUBLE",
    )
    rows = srch.rerank(hits, queries).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["rerank_score"], 3)) for r in rows] == [("c", 0.667), ("b", 0.667), ("a", 0.333)]


def test_validation(spark):
    rows = [("ok", 5, 0.5), ("", 5, 0.5), ("x" * 1001, 51, 1.5), ("q", 0, -0.1), (None, None, None)]
    df = spark.createDataFrame(rows, "query STRING, top_k INT, similarity_threshold DOUBLE")
    got = [(r["valid"], r["reject_reasons"]) for r in val.validate_search(df).collect()]
    assert got == [
        (True, []), (False, ["query length"]),
        (False, ["query length", "top_k", "similarity_threshold"]),
        (False, ["top_k", "similarity_threshold"]), (False, ["query length"]),
    ]
    assert [r["valid"] for r in val.validate_agent_query(df).collect()] == [True, False, True, True, False]


def test_catalog_pages(spark):
    df = spark.range(45).select(
        F.format_string("d%02d", "id").alias("document_id"),
        F.timestamp_seconds(F.floor(F.col("id") / 2)).alias("created_at"),
    )
    seen, more = [], []
    for page in (1, 2, 3, 4):
        rows = cat.page_of(df, page, 20).orderBy(F.desc("created_at"), "document_id").collect()
        seen += [r["document_id"] for r in rows]
        more += [r["has_more"] for r in rows[:1]]
        assert all(r["total"] == 45 for r in rows)
    assert len(seen) == len(set(seen)) == 45 and seen[:3] == ["d44", "d42", "d43"]
    assert more == [True, True, False]


def test_status_fold(spark):
    at = [datetime(2024, 1, 1, 0, m) for m in range(6)]
    rows = [
        ("a", "pending", None, 0, at[0], 1), ("a", "processing", None, 10, at[1], 2),
        ("a", "completed", None, 100, at[2], 3), ("b", "processing", None, 5, at[3], 4),
        ("b", "failed", "boom", 6, at[3], 5), ("c", "pending", None, 0, at[4], 6), ("c", "other", None, 0, at[5], 7),
    ]
    events = spark.createDataFrame(rows, "id STRING, status STRING, error STRING, progress INT, ts TIMESTAMP, seq INT")
    states = cat.latest_status(events)
    got = {r["id"]: (r["status"], r["error"], r["progress"], r["completed_at"]) for r in states.collect()}
    assert got == {"a": ("completed", None, 100, at[2]), "b": ("failed", "boom", 6, at[3]), "c": ("pending", None, 0, None)}
    assert cat.status_counts(states).first().asDict() == {"pending": 1, "processing": 0, "completed": 1, "failed": 1}


def test_expired_uploads(spark, uploads):
    listed = files.list_files(spark, uploads)
    assert cat.expired_uploads(listed, 3600).count() == 0
    later = F.current_timestamp() + F.make_dt_interval(hours=F.lit(2))
    assert cat.expired_uploads(listed, 3600, later).count() == 6


def test_context_with_one_long_conversation(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("conv_id"),
        F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"),
    )
    got = {r["conv_id"]: [t["text"] for t in r["turns"]] for r in context.conversation_context(df, 4).collect()}
    assert got[1] == ["696", "697", "698", "699"] and len(got) == 1301


def test_duplicate_uploads_are_suppressed(spark, tmp_path):
    rows = [(i, f"d{i % 3}", datetime(2024, 1, 1, 0, i)) for i in range(9)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "i INT, document_id STRING, created_at TIMESTAMP").write.parquet(path)
    source = spark.readStream.schema("i INT, document_id STRING, created_at TIMESTAMP").parquet(path)
    target = work_path(spark, "unique")
    unique = stream.suppress_duplicates(source, "1 day")
    stream.run_available(unique, stream.replace_batch(target), work_path(spark, "ck"))
    assert sorted(r["document_id"] for r in spark.read.parquet(target).collect()) == ["d0", "d1", "d2"]
