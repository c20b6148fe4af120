"""Stored tables: append-only vectors, the batch ledger, the prefix cache, the catalog."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import approximate, inverted, nearest, pii
from docloom.operators import catalog as cat
from docloom.operators.embedding import HashedTokenEmbedder
from docloom.plans import search as srch
from docloom.plans.ingest import KnowledgeBase
from docloom.session import work_path
from docloom.sources import files
from docloom.sources.cache_table import CacheTable
from docloom.sources.ledger import Ledger
from docloom.sources.vector_table import VectorTable
from docloom.streaming import ingest as stream
from workload.queries import QUERIES


def rows_of(spark, *items):
    """Records (id, first value[, namespace])."""
    full = [(i, [float(x), 1.0], *(ns or ["default"])) for i, x, *ns in items]
    return spark.createDataFrame(full, "id STRING, values ARRAY<FLOAT>, namespace STRING")


def held(store):
    return {(r["namespace"], r["id"]): r["values"][0] for r in store.read().collect()}


def files_below(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def broken(df):
    """Rows of which the last one fails when it is computed."""
    bad = F.when(F.col("id") == "boom", F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    return df.withColumn("id", bad.cast("string"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Vector table


def test_batches_deletions_and_compaction(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 3)
    store.upsert(rows_of(spark, ("a", 1), ("b", 2), ("c", 3, "x"), ("d", 4, "x")), unique=True)
    store.upsert(rows_of(spark, ("a", 10), ("e", 5)))
    store.delete(ids=spark.createDataFrame([("b",), (None,), ("unknown",)], "id STRING"))
    want = {("default", "a"): 10, ("default", "e"): 5, ("x", "c"): 3, ("x", "d"): 4}
    assert held(store) == want
    before = files_below(store.path)
    store.delete(delete_all=True, namespace="x")
    store.upsert(rows_of(spark, ("c", 30, "x"), ("b", 20)))
    # A write touches no file of an earlier one.
    assert before.items() <= files_below(store.path).items()
    want = {("default", "a"): 10, ("default", "e"): 5, ("default", "b"): 20, ("x", "c"): 30}
    assert held(store) == want
    assert store.compact() == 5 and store.batches() == (5, []) and held(store) == want
    assert store.compact() == 5
    store.upsert(rows_of(spark, ("e", 50)))
    store.delete(condition={"id": "a"})
    assert held(store) == want | {("default", "e"): 50}
    store.delete(ids=spark.createDataFrame([("a",)], "id STRING"))
    want = {("default", "e"): 50, ("default", "b"): 20, ("x", "c"): 30}
    assert held(store) == want and store.stats().where("namespace is null").first()["vector_count"] == 3
    store.compact()
    store.vacuum()
    assert held(store) == want and sorted(p.name for p in Path(f"{store.path}/base").iterdir()) == ["seq=8"]
    assert all("changes" not in f for f in files_below(store.path))
    ids = spark.createDataFrame([("e",), ("c",), (None,)], "id STRING")
    for settings in (Settings(), Settings(pushed_ids=1)):
        table = VectorTable(spark, store.path, 2, 3, settings)
        assert [r["id"] for r in table.fetch(ids).collect()] == ["e"]


def test_keys_too_many_to_send_are_joined(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 3, Settings(broadcast_key_bytes=0))
    store.upsert(rows_of(spark, ("a", 1), ("b", 2)), unique=True)
    store.upsert(rows_of(spark, ("a", 10)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(store.read())
        assert held(store) == {("default", "a"): 10, ("default", "b"): 2}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_broken_write_loses_nothing(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 2)
    store.upsert(rows_of(spark, ("a", 1), ("b", 2)))
    late = rows_of(spark, ("a", 10), ("c", 3), ("boom", 9)).repartition(3)
    for unique in (True, False):
        with pytest.raises(Exception, match="lost"):
            store.upsert(broken(late), unique=unique, seq=2)
        assert held(store) == {("default", "a"): 1, ("default", "b"): 2}
    # The folder of a broken write stands without its mark; the same number is run again.
    Path(f"{store.path}/changes/seq=3/kind=change").mkdir(parents=True)
    assert store.batches() == (None, [1])
    assert store.upsert(late.where("id <> 'boom'"), seq=2) == 2
    want = {("default", "a"): 10, ("default", "b"): 2, ("default", "c"): 3}
    assert held(store) == want
    # Half a compaction counts for nothing.
    Path(f"{store.path}/base/seq=2").mkdir(parents=True)
    assert held(store) == want and store.compact() == 2 and held(store) == want
    store.vacuum()
    assert not Path(f"{store.path}/changes/seq=3").exists() and held(store) == want


def test_a_number_has_one_effect(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 2)
    twice = rows_of(spark, ("a", 1), ("a", 2), ("b", 3)).withColumn("ordinal", F.col("values")[0])
    assert store.upsert(twice, seq=4) == 3
    assert store.upsert(rows_of(spark, ("a", 99)), seq=4) == 3
    assert held(store) == {("default", "a"): 2, ("default", "b"): 3}


def test_rejects_stay_with_their_reason(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 2)
    bad = spark.createDataFrame(
        [("a", [1.0], "n"), ("a", [1.0], "n"), (None, [1.0, 2.0], "n"), ("b", [1.0, float("nan")], "n"),
         ("c", None, "n"), ("d", [1.0, 2.0], "n")],
        "id STRING, values ARRAY<FLOAT>, namespace STRING",
    )
    for seq, unique in ((1, False), (2, True)):
        assert store.upsert(bad, unique=unique, seq=seq) == 1
    reasons = sorted((r["seq"], r["reject_reason"]) for r in store.rejects().collect())
    one = ["missing id", "missing values", "not a number", "wrong dimension", "wrong dimension"]
    assert reasons == [(n, r) for n in (1, 2) for r in one]
    store.compact()
    store.vacuum()
    assert store.rejects().count() == 10 and held(store) == {("n", "d"): 1.0}


def test_statistics_go_on_from_the_last_entry(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 2)
    assert store.stats_history().count() == 0

    def check(seq):
        assert store.refresh_stats() == seq
        found = store.stats_history().where(F.col("seq") == seq)
        want = {r["namespace"]: r["vector_count"] for r in store.stats().where("vector_count > 0").collect()}
        got = {r["namespace"]: r["vector_count"] for r in found.collect() if r["vector_count"]}
        assert got == want

    store.upsert(rows_of(spark, ("a", 1), ("b", 2), ("c", 3, "x"), ("d", 4, "x")), unique=True)
    check(1)
    store.upsert(rows_of(spark, ("a", 10), ("e", 5)))
    store.delete(ids=spark.createDataFrame([("b",), ("unknown",)], "id STRING"))
    check(3)
    before = files_below(f"{store.path}/stats")
    check(3)
    assert files_below(f"{store.path}/stats") == before
    store.upsert(rows_of(spark, ("f", 1, "x")))
    store.delete(delete_all=True, namespace="x")
    store.upsert(rows_of(spark, ("c", 1, "x"), ("b", 1)))
    check(6)
    store.delete(ids=spark.createDataFrame([("b",)], "id STRING"))
    store.compact()
    store.vacuum()
    store.upsert(rows_of(spark, ("z", 1), ("e", 7)))
    check(8)
    store.delete(delete_all=True, namespace="x")
    store.delete(delete_all=True)
    check(10)
    assert store.stats_history().where("namespace is null").count() == 5


# Search


def test_vectors_are_not_shuffled_below_the_scores(spark):
    v = rows_of(spark, *[(f"v{i}", i) for i in range(50)])
    q = v.select(F.col("id").alias("query_id"), F.col("values").alias("query_vector"))
    plan = plan_of(nearest.nearest(v, q, 2))
    scored = plan[plan.index("MapInArrow") :]
    assert "Exchange" not in scored
    # Stored in waves: the candidates are files, so nothing below them runs again.
    several = nearest.nearest(v, q, 2, Settings(broadcast_query_bytes=7 * 16))
    assert "MapInArrow" not in plan_of(several) and several.count() == 250


def test_winners_are_fetched_by_pushed_ids(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 4)
    store.upsert(rows_of(spark, *[(f"v{i:03d}", i) for i in range(200)]), unique=True)
    hits = srch.search(store, [1.0, 0.0], 3)
    plan = plan_of(hits)
    pushed = [part for part in plan.split("PushedFilters: ") if "In(id, [v" in part.split("ReadSchema")[0]]
    assert pushed and "MapInArrow" not in plan
    assert [r["chunk_id"] for r in hits.orderBy("rank").collect()] == ["v199", "v198", "v197"]
    many = VectorTable(spark, store.path, 2, 4, Settings(pushed_ids=1))
    found = srch.search(many, [1.0, 0.0], 3)
    assert "In(id" not in plan_of(found) and found.count() == 3


def clustered(spark, n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    rows = [("a" if i % 5 else "b", f"v{i:05d}", (centres[i % 12] + rng.normal(size=width) * 0.4).tolist()) for i in range(n)]
    # One list holds a third of everything.
    rows += [("a", f"w{i:05d}", (centres[0] + rng.normal(size=width) * 0.05).tolist()) for i in range(n // 2)]
    return spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>")


def test_inverted_lists(spark):
    v = clustered(spark, 1200, 16, 1)
    quantizer = inverted.fit(v, 16, 24, sample=20)
    assert quantizer.centroids.shape == (24, 16)
    assert np.array_equal(quantizer.centroids, inverted.fit(v.repartition(7), 16, 24, sample=20).centroids)
    listed = inverted.by_list(v, quantizer)
    q = v.where("id like '%0'").select(F.col("id").alias("query_id"), F.col("values").alias("query_vector"), "namespace")
    exact = nearest.nearest(v, q, 16)
    every = inverted.nearest_probed(listed, q, quantizer, 24)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    few = inverted.nearest_probed(listed, q, quantizer, 5)
    assert approximate.recall(few, exact).first()["recall"] >= 0.9
    # Stored by list, only the probed partitions are opened.
    store = VectorTable(spark, work_path(spark, "v"), 16, 1)
    store.upsert(listed, unique=True)
    asked = q.where("query_id = 'w00010'")
    one = inverted.nearest_probed(store.read(), asked, quantizer, 2)
    opened = plan_of(one).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert one.count() == 5 and "namespace" in opened and opened.count("a#") == 2


def test_inverted_lists_of_little_data(spark):
    v = rows_of(spark, ("a", 1), ("b", 2))
    bad = v.unionByName(v.withColumn("values", F.lit(None).cast("array<float>")).withColumn("id", F.lit("none")))
    quantizer = inverted.fit(bad, 2, 8)
    listed = inverted.by_list(bad, quantizer)
    assert listed.where("id = 'none'").first()["namespace"] == "default#-1"
    q = v.select(F.col("id").alias("query_id"), F.col("values").alias("query_vector"))
    assert inverted.nearest_probed(listed, q, quantizer, 8).count() == 4
    empty = inverted.fit(v.limit(0), 2, 8)
    assert inverted.nearest_probed(inverted.by_list(v.limit(0), empty), q, empty, 3).count() == 0


# Ledger and collection


def test_ledger(spark):
    ledger = Ledger(spark, work_path(spark, "ledger"))
    assert ledger.entries().count() == 0
    a, b = ledger.open("a", 0), ledger.open("b", 0)
    assert (a.seq, b.seq, a.done) == (1, 2, False)
    # A batch that broke comes again under the same number.
    assert ledger.open("a", 0) == a
    ledger.close("a", 0, a.seq, 7)
    again = ledger.open("a", 0)
    assert (again.seq, again.done, again.effect) == (1, True, 7)
    assert ledger.open("a", 1).seq == 3
    assert [(r["run"], r["batch"], r["seq"], r["effect"]) for r in ledger.entries().collect()] == [("a", 0, 1, 7)]


def texts(spark, *items):
    rows = [(f"{name}.txt", text.encode(), len(text)) for name, text in items]
    return spark.createDataFrame(rows, "filename STRING, content BINARY, length BIGINT").withColumn(
        "modificationTime", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )


def test_runs_stay_apart_and_replays_have_no_effect(spark):
    base = KnowledgeBase(spark, work_path(spark, "kb"), HashedTokenEmbedder(16), 2)
    left, right = base.handler("left"), base.handler("right", "other")
    assert left(texts(spark, ("a", "one text")), 0) == 1 and right(texts(spark, ("b", "two texts")), 0) == 1
    assert base.catalog().count() == 2 and base.chunks().count() == 2 and base.cache.read().count() == 2
    before = files_below(base.root)
    # The same batch again, and even with other content.
    assert left(texts(spark, ("a", "one text")), 0) == 1 and left(texts(spark, ("x", "x"), ("y", "y")), 0) == 1
    assert files_below(base.root) == before
    assert {r["namespace"] for r in base.vectors.read().collect()} == {"default", "other"}
    assert {r["filename"]: r["namespace"] for r in base.catalog().collect()} == {"a.txt": "default", "b.txt": "other"}


def test_a_batch_that_breaks_is_run_again(spark):
    base = KnowledgeBase(spark, work_path(spark, "kb"), HashedTokenEmbedder(16), 2)
    base.ingest_files(texts(spark, ("a", "first")), 0)

    class Broken(HashedTokenEmbedder):
        def load(self):
            raise RuntimeError("lost worker")

    half = KnowledgeBase(spark, base.root, Broken(16), 2)
    with pytest.raises(Exception, match="lost worker"):
        half.ingest_files(texts(spark, ("b", "second")), 1)
    assert base.vectors.read().count() == 1 and base.ledger.entries().count() == 1
    assert base.ingest_files(texts(spark, ("b", "second")), 1) == 1
    assert base.vectors.read().count() == 2 and base.catalog().count() == 2 and base.chunks().count() == 2


def test_deletion_of_stored_documents_is_reported_once(spark):
    base = KnowledgeBase(spark, work_path(spark, "kb"), HashedTokenEmbedder(16), 2)
    base.ingest_files(texts(spark, ("a", "first"), ("b", "second")), 0)
    key = base.catalog().where("filename = 'a.txt'").select("document_id")
    ids = key.unionByName(spark.createDataFrame([("no",)], "document_id STRING"))
    for _ in range(2):
        report = {r["document_id"]: r["deleted"] for r in base.delete_documents(ids, 0, run="del").collect()}
        assert sorted(report.values()) == [False, True]
    assert base.catalog().count() == 1 and base.chunks().count() == 1 and base.vectors.read().count() == 1


def test_catalog_is_read_without_chunks_and_seeks(spark):
    base = KnowledgeBase(spark, work_path(spark, "kb"), HashedTokenEmbedder(16), 2)
    assert base.catalog().count() == 0
    for batch in range(2):
        rows = texts(spark, *[(f"f{batch}{i}", f"text {i}") for i in range(9)])
        minutes = F.make_dt_interval(mins=(F.length("filename") + F.substring("filename", 3, 1).cast("int") % 4))
        base.ingest_files(rows.withColumn("modificationTime", F.col("modificationTime") + minutes), batch)
    catalog = base.catalog()
    assert "chunks" not in plan_of(catalog) and "content" not in plan_of(catalog)
    want = [r["document_id"] for r in catalog.orderBy(F.desc("created_at"), "document_id").collect()]
    got, after = [], None
    while True:
        page = cat.page_after(catalog, after, 5).orderBy(F.desc("created_at"), "document_id").collect()
        if not page:
            break
        got += [r["document_id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["document_id"])
    assert got == want and len(got) == 18


def test_cursor_reaches_documents_without_a_time(spark):
    rows = [("a", 3), ("b", None), ("c", 3), ("d", None), ("e", 1)]
    df = spark.createDataFrame(rows, "document_id STRING, s INT").select(
        "document_id", F.timestamp_seconds("s").alias("created_at")
    )
    got, after = [], None
    for _ in range(5):
        row = cat.page_after(df, after, 1).first()
        got.append(row["document_id"])
        after = (row["created_at"], row["document_id"])
    assert got == ["a", "c", "e", "b", "d"] and cat.page_after(df, after, 1).count() == 0


def test_refused_uploads_of_a_stream_are_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, size in (("a.txt", 5), ("b.exe", 5), ("big.txt", 5000)):
        (tmp_path / "in" / name).write_text("y" * size)
    target, small = work_path(spark, "refused"), Settings(max_upload_bytes=4000)
    refused = stream.reject_stream(spark, str(tmp_path / "in"), settings=small)
    stream.run_available(refused, stream.replace_batch(target, "uploads"), work_path(spark, "ck"))
    got = {r["filename"]: r["reject_reason"] for r in spark.read.parquet(target).collect()}
    assert got == {"b.exe": "file type not allowed", "big.txt": "file too large"}


def test_two_streams_into_one_table(spark, tmp_path):
    target = work_path(spark, "both")
    for run in ("left", "right"):
        path = str(tmp_path / run)
        spark.range(3).withColumn("who", F.lit(run)).write.parquet(path)
        source = spark.readStream.schema("id BIGINT, who STRING").parquet(path)
        stream.run_available(source, stream.replace_batch(target, run), work_path(spark, "ck"))
    assert spark.read.parquet(target).count() == 6


def test_late_rows_are_kept_aside(spark, tmp_path):
    from datetime import datetime

    def at(minute):
        return datetime(2024, 1, 1, 1, minute)

    split = stream.LateSplit(spark, work_path(spark, "split"), delay="10 minutes")
    batches = [[("a", at(30)), ("b", at(1))], [("c", at(20)), ("d", at(19)), ("e", at(50))], [], [("f", at(39)), ("g", None)]]
    for _ in range(2):
        # The second round is a replay: every batch sees what it saw first.
        for number, rows in enumerate(batches):
            split.handle(spark.createDataFrame(rows, "status STRING, ts TIMESTAMP"), number)
    assert sorted(r["status"] for r in split.on_time().collect()) == ["a", "b", "c", "e", "g"]
    assert {r["status"]: r["watermark"] for r in split.late().collect()} == {"d": at(20), "f": at(40)}
    other = stream.LateSplit(spark, split.path, delay="10 minutes", run="other")
    other.handle(spark.createDataFrame([("h", at(0))], "status STRING, ts TIMESTAMP"), 5)
    assert split.on_time().count() == 6


# Cache


def test_lookup_opens_the_prefixes_of_the_batch(spark):
    cache = CacheTable(spark, work_path(spark, "cache"))
    df = spark.range(200).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text"))
    cache.embed_texts(df, "text", HashedTokenEmbedder(4), 1, ["id"])
    assert len(list(Path(cache.path).glob("prefix=*"))) == 16
    keys = df.limit(2).select(F.md5("text").alias("text_key")).unionByName(
        spark.createDataFrame([("f" * 32,)], "text_key STRING")
    )
    found = cache.lookup(keys)
    assert found.count() == 2 and "In(text_key, [" in plan_of(found)
    opened = plan_of(found).split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "prefix" in opened
    joined = CacheTable(spark, cache.path, Settings(pushed_ids=1)).lookup(keys)
    assert joined.count() == 2 and "Join" in plan_of(joined)
    # Keys another batch holds are not inserted a second time.
    cache.insert(cache.read().limit(5).withColumn("inserted_seq", F.lit(9).cast("long")))
    assert cache.read().count() == 200


# One-pass locator


def test_strings_are_found_in_one_pass(spark):
    docs = spark.createDataFrame(
        [("1", "😀 aab ab aab"), ("2", None), ("3", ""), ("4", "nothing"), ("5", "x" * 200_000 + "needle")],
        "document_id STRING, text STRING",
    )
    rows = [("1", "email", "ab"), ("1", "phone", "ab"), ("1", "email", "aab"), ("1", "email", "zz"), ("1", "email", "😀"),
            ("1", "email", "ab ab"), ("2", "email", "a"), ("3", "email", "a"), ("5", "email", "needle"), ("5", "email", "x"),
            ("6", "email", "a"), ("4", "unknown", "nothing"), ("1", "email", None)]
    found = spark.createDataFrame(rows, "document_id STRING, extraction_class STRING, extraction_text STRING")
    got = sorted((r["document_id"], r["start"], r["end"], r["text"], sorted(r["categories"]))
                 for r in pii.locate_extractions(docs, found).collect())
    assert got == [
        ("1", 0, 1, "😀", ["email"]), ("1", 2, 5, "aab", ["email"]), ("1", 3, 5, "ab", ["email", "phone"]),
        ("1", 3, 8, "ab ab", ["email"]), ("5", 0, 1, "x", ["email"]), ("5", 200_000, 200_006, "needle", ["email"]),
    ]
    merged = {r["document_id"]: r["pii"] for r in pii.with_pii_and_extractions(docs, found).collect()}
    assert merged["1"]["categories_found"] == ["email", "phone"] and merged["4"]["detections"] == []
    off = pii.with_pii_and_extractions(docs, found, settings=Settings(pii_enabled=False))
    assert off.where("pii.has_pii").count() == 0 and "Join" not in plan_of(off)


def test_scan_lists_what_it_refuses(spark, tmp_path):
    (tmp_path / "a.md").write_text("| a |\n|---|---|\n![x](y) ![z](w)")
    accepted, rejected = files.scan_files(spark, str(tmp_path))
    got = files.extract(accepted).first()["metadata"]
    assert (got["table_count"], got["image_count"]) == (1, 2) and rejected.count() == 0


@pytest.fixture()
def foldered(spark, folder, tmp_path):
    """The tables with documents and benchmark as folders of part files."""
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    whole.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    items.repartition(2).write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_a_table_that_is_a_folder_is_streamed_whole(spark, folder, foldered):
    target = work_path(spark, "rows")
    source = stream.table_stream(spark, foldered, "documents", files_per_batch=2)
    stream.run_available(source, stream.replace_batch(target), work_path(spark, "ck"))
    got = spark.read.parquet(target)
    want = spark.read.parquet(f"{folder}/documents.parquet")
    assert got.select("batch").distinct().count() == 2
    assert got.select(want.columns).exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("name", ["stream_chunks", "stream_index", "stream_replay"])
def test_streams_read_tables_of_part_files(spark, folder, foldered, name):
    got, want = QUERIES[name](spark, foldered), QUERIES[name](spark, folder)
    keep = [c for c in want.columns if c != "batches"]
    have = sorted(tuple(str(v) for v in r) for r in got.select(keep).collect())
    assert have and have == sorted(tuple(str(v) for v in r) for r in want.select(keep).collect())


def test_unique_uploads_of_part_files(spark, folder, foldered):
    got = sorted(r[0] for r in QUERIES["stream_unique"](spark, foldered).collect())
    assert got and got == sorted(r[0] for r in QUERIES["stream_unique"](spark, folder).collect())
