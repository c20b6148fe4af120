import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import approximate, inverted, nearest, skew
from docloom.operators import vectors as vec
from docloom.operators.filters import metadata_filter
from docloom.plans import search as srch
from docloom.session import work_path
from docloom.sources.vector_table import VectorTable

META = [
    {"n": 1, "s": "a", "b": True, "tags": ["x", "y"]},
    {"n": 2.5, "s": "b", "b": False},
    {"n": "1", "s": "c", "x-y": 5},
    {},
]


def records(spark, rows):
    """rows: (namespace, id, values, metadata JSON)"""
    df = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>, m STRING")
    return vec.normalize_records(df.withColumn("metadata", F.parse_json("m")).drop("m"))


@pytest.mark.parametrize(
    "condition,matches",
    [
        (None, [0, 1, 2, 3]), ({}, [0, 1, 2, 3]),
        ({"n": 1}, [0]), ({"n": {"$eq": 1.0}}, [0]), ({"n": "1"}, [2]),
        ({"n": {"$ne": 1}}, [1, 2]), ({"n": {"$gt": 1}}, [1]), ({"n": {"$gte": 1, "$lt": 2.5}}, [0]),
        ({"n": {"$lte": 2.5}}, [0, 1]), ({"s": {"$in": ["a", "c", 3]}}, [0, 2]),
        ({"s": {"$nin": ["a"]}}, [1, 2]), ({"s": {"$gt": "a"}}, [1, 2]),
        ({"b": True}, [0]), ({"b": {"$ne": True}}, [1]), ({"b": 1}, []),
        ({"tags": "y"}, [0]), ({"tags": {"$in": ["q", "x"]}}, [0]), ({"tags": {"$ne": "x"}}, []),
        ({"x-y": 5}, [2]), ({"x": {"$eq": 1}}, []),
        ({"s": {"$exists": True}}, [0, 1, 2]), ({"s": {"$exists": False}}, [3]),
        ({"$or": [{"n": 1}, {"s": "b"}]}, [0, 1]), ({"$and": [{"n": 1}, {"s": "b"}]}, []),
        ({"$and": [{"n": {"$gt": 0}}], "$or": [{"b": False}, {"s": "zz"}]}, [1]),
    ],
)
def test_metadata_filter(spark, condition, matches):
    import json

    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(META)], "i INT, m STRING")
    df = df.withColumn("metadata", F.parse_json("m"))
    got = df.where(metadata_filter(condition, F.col("metadata"))).select("i").collect()
    assert sorted(r["i"] for r in got) == matches


def test_whole_numbers_are_compared_exactly(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, f'{{"n": {big}}}'), (2, f'{{"n": {big - 1}}}'), (3, '{"n": 2.0}')], "i INT, m STRING")
    df = df.withColumn("metadata", F.parse_json("m"))

    def found(condition):
        return sorted(r["i"] for r in df.where(metadata_filter(condition, F.col("metadata"))).collect())

    assert found({"n": big}) == [1] and found({"n": {"$in": [big - 1]}}) == [2] and found({"n": {"$ne": big}}) == [2, 3]
    assert found({"n": {"$gt": big - 1}}) == [1] and found({"n": {"$lt": big}}) == [2, 3]
    assert found({"n": 2}) == [3] and found({"n": {"$lt": float("inf")}}) == [1, 2, 3] and found({"n": {"$gt": 2**70}}) == []


def test_bad_filters_are_refused(spark):
    for bad in ({"n": {"$near": 1}}, {"$not": []}):
        with pytest.raises(ValueError):
            metadata_filter(bad, F.col("metadata"))
    with pytest.raises(ValueError):
        metadata_filter({"n": 1})


def test_promoted_filter_reaches_the_scan(spark):
    store = VectorTable(spark, work_path(spark, "v"), 1, 2)
    store.upsert(records(spark, [("a", "1", [1.0], '{"document_id": "d"}')]))
    scan = store.read().where(vec.record_filter({"document_id": {"$eq": "d"}}, store.read()))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(document_id,d)" in plan
    assert scan.count() == 1


def state(store):
    rows = store.read().select("namespace", "id", "values", F.to_json("metadata").alias("m")).collect()
    return {(r["namespace"], r["id"]): (r["values"], r["m"]) for r in rows}


def test_table_life_cycle(spark):
    store = VectorTable(spark, work_path(spark, "v"), 2, 3)
    assert state(store) == {} and store.upsert(records(spark, [])) == 0
    rows = [(None if i % 2 else "ns/1 x", f"v{i}", [float(i), 1.0], f'{{"i": {i}}}') for i in range(10)]
    assert store.upsert(records(spark, rows)) == 10
    before = state(store)
    assert len(before) == 10 and before[("default", "v1")] == ([1.0, 1.0], '{"i":1}')
    # The same again changes nothing.
    assert store.upsert(records(spark, rows)) == 10 and state(store) == before
    # Same id, other namespace; replaced id; twice in one call, last ordinal wins.
    twice = records(spark, [("default", "v1", [9.0, 9.0], "{}"), ("default", "v2", [8.0, 8.0], "{}")])
    late = twice.withColumn("ordinal", F.lit(2)).unionByName(
        records(spark, [("default", "v1", [7.0, 7.0], "{}")]).withColumn("ordinal", F.lit(1))
    )
    assert store.upsert(late) == 3
    after = state(store)
    assert after[("default", "v1")] == ([9.0, 9.0], "{}") and after[("default", "v2")][0] == [8.0, 8.0]
    assert after[("ns/1 x", "v2")] == before[("ns/1 x", "v2")] and len(after) == 11
    # Records that break the contract are left out.
    assert store.upsert(records(spark, [("default", "bad", [1.0], "{}")])) == 0

    ids = spark.createDataFrame([("v1",), ("v2",), ("zz",)], "id STRING")
    assert sorted(r["id"] for r in store.fetch(ids).collect()) == ["v1", "v2"]
    assert sorted(r["id"] for r in store.fetch(ids, "ns/1 x").collect()) == ["v2"]
    assert store.delete() is True and state(store) == after
    assert store.delete(ids=ids)
    assert set(state(store)) == set(after) - {("default", "v1"), ("default", "v2")}
    assert store.delete(condition={"i": {"$gte": 7}}, namespace="ns/1 x")
    assert ("ns/1 x", "v8") not in state(store) and ("default", "v9") in state(store)
    # Everything first, then ids, then the filter.
    assert store.delete(ids=ids, condition={"i": 0}, namespace="ns/1 x", delete_all=True)
    assert {ns for ns, _ in state(store)} == {"default"}
    for i in (3, 5, 7, 9):
        store.delete(ids=spark.createDataFrame([(f"v{i}",)], "id STRING"))
    assert state(store) == {}


def test_pure_delete_and_upsert(spark):
    base = records(spark, [("a", "1", [1.0], '{"k": 1}'), ("b", "1", [2.0], "{}"), ("a", "2", [3.0], "{}")])
    ids = spark.createDataFrame([("1",)], "id STRING")

    def keys(df):
        return sorted((r["namespace"], r["id"]) for r in df.collect())

    assert keys(vec.delete(base, ids=ids, namespace="a")) == [("a", "2"), ("b", "1")]
    assert keys(vec.delete(base, condition={"k": 1}, namespace="a")) == [("a", "2"), ("b", "1")]
    assert keys(vec.delete(base, namespace="a", delete_all=True)) == [("b", "1")]
    assert keys(vec.delete(base)) == [("a", "1"), ("a", "2"), ("b", "1")]
    assert vec.deletion(base) is None
    assert keys(vec.deletion(base, ids=ids, namespace="b")) == [("b", "1")]
    new = records(spark, [("a", "1", [9.0], "{}"), ("c", "1", [4.0], "{}")])
    merged = vec.upsert(base, new)
    assert keys(merged) == [("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")]
    assert merged.where("namespace = 'a' and id = '1'").first()["values"] == [9.0]


def test_stats(spark):
    base = records(spark, [("a", "1", [1.0], "{}"), ("b", "1", [2.0], "{}"), ("a", "2", [3.0], "{}")])
    rows = {r["namespace"]: (r["vector_count"], r["dimension"]) for r in vec.index_stats(base).collect()}
    assert rows == {"a": (2, 1), "b": (1, 1), None: (3, 1)}


DIM = 6


def random_vectors(rng, n, copies=0):
    rows = [("a" if rng.random() < 0.7 else "b", f"v{i:04d}", rng.normal(size=DIM)) for i in range(n)]
    hot = rng.normal(size=DIM)
    # A third of everything may be one and the same vector.
    rows += [("a", f"h{i:04d}", hot) for i in range(copies)]
    rows.append(("a", "zero", np.zeros(DIM)))
    return [(ns, i, [float(x) for x in v]) for ns, i, v in rows], [float(x) for x in hot]


def brute(rows, queries):
    out = []
    for q, vector, ns, k, floor in queries:
        scored = []
        for space, key, values in rows:
            if space != ns:
                continue
            a, b = np.array(vector), np.array(values, dtype=np.float32).astype(float)
            n = np.linalg.norm(a) * np.linalg.norm(b)
            score = round(float(a @ b / n) if n else 0.0, 9) + 0.0
            if score >= floor:
                scored.append((-score, key))
        out += [(q, key, -s, rank + 1) for rank, (s, key) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [False, True])
def test_nearest_matches_brute_force(spark, blocks):
    rng = np.random.default_rng(5)
    rows, hot = random_vectors(rng, 400, copies=200)
    queries = [
        (i, [float(x) for x in rng.normal(size=DIM)], "ab"[i % 2], 1 + i % 9, -2.0 if i % 3 else 0.3)
        for i in range(30)
    ] + [(99, hot, "a", 7, 0.5), (100, [0.0] * DIM, "a", 3, -2.0), (101, hot, "none", 3, -2.0)]
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>").repartition(5)
    q = spark.createDataFrame(
        queries, "query_id INT, query_vector ARRAY<DOUBLE>, namespace STRING, top_k INT, similarity_threshold DOUBLE"
    )
    settings = Settings(broadcast_query_bytes=8 * DIM * 8) if blocks else Settings()
    got = nearest.nearest(v, q, DIM, settings).collect()
    assert sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in got) == brute(rows, queries)


def many_queries(spark, rows, n):
    queries = [(i, rows[i % len(rows)][2], "ab"[i % 2], 1 + i % 9, -2.0) for i in range(n)]
    return queries, spark.createDataFrame(
        queries, "query_id INT, query_vector ARRAY<DOUBLE>, namespace STRING, top_k INT, similarity_threshold DOUBLE"
    )


def test_queries_beyond_one_wave_meet_the_vectors_in_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAST_SIDE", 1)
    monkeypatch.setattr(nearest, "CELL_BYTES", 8 * DIM * 40)
    rows, _ = random_vectors(np.random.default_rng(8), 300, copies=90)
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>").repartition(5)
    queries, q = many_queries(spark, rows, 120)
    got = nearest.nearest(v, q, DIM, Settings(broadcast_query_bytes=8 * DIM * 8)).collect()
    assert sorted((r["query_id"], r["id"], round(r["score"], 9), r["rank"]) for r in got) == brute(rows, queries)


def test_jobs_do_not_grow_with_the_queries(spark):
    rows, _ = random_vectors(np.random.default_rng(9), 60)
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>")
    jobs = []
    for n in (20, 160):
        _, q = many_queries(spark, rows, n)
        spark.sparkContext.setJobGroup(f"waves-{n}", "")
        nearest.nearest(v, q, DIM, Settings(broadcast_query_bytes=8 * DIM * 8)).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"waves-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(jobs[1] - jobs[0]) <= 4


@pytest.mark.parametrize("n", [40, 400])
def test_driver_sees_one_wave_of_queries_at_most(spark, monkeypatch, n):
    rows, _ = random_vectors(np.random.default_rng(10), 200)
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>")
    _, q = many_queries(spark, rows, n)
    probes = inverted.fit(v, DIM, 4)
    seen, frame = [], type(v)
    whole = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: (seen.append(whole(df)), seen[-1])[1])
    listed = inverted.by_list(v, probes)
    hits = inverted.nearest_probed(listed, q, probes, 3, Settings(broadcast_query_bytes=8 * DIM * 8))
    assert hits.count() > 0 and sum(t.num_rows for t in seen) <= 9


def test_top_k_is_a_prefix_of_the_next(spark):
    rows, _ = random_vectors(np.random.default_rng(6), 100)
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>")
    found = [
        [r["chunk_id"] for r in srch.search(v, rows[0][2], k, "a", include_metadata=False).orderBy("rank").collect()]
        for k in (3, 4, 60)
    ]
    assert found[1][:3] == found[0] and found[2][:4] == found[1] and len(found[2]) == 60


def test_search_result_fields(spark):
    v = records(
        spark,
        [
            ("default", "c1", [1.0, 0.0], '{"document_id": "d1", "content": "hello", "page_number": 3}'),
            ("default", "c2", [0.5, 0.5], "{}"),
        ],
    )
    store = VectorTable(spark, work_path(spark, "v"), 2, 2)
    store.upsert(v)
    for source in (v, store):
        first, second = srch.search(source, [1.0, 0.0]).orderBy("rank").collect()
        assert (first["document_id"], first["content"], first["page_number"]) == ("d1", "hello", 3)
        assert (second["document_id"], second["content"], second["page_number"]) == ("", "", None)
        assert second["chunk_id"] == "c2" and round(second["score"], 6) == 0.707107
        bare = srch.search(source, [1.0, 0.0], include_metadata=False).orderBy("rank").first()
        assert (bare["document_id"], bare["content"], bare["metadata"]) == ("", "", None)
        only = srch.search(source, [1.0, 0.0], condition={"document_id": "d1"}).collect()
        assert [r["chunk_id"] for r in only] == ["c1"]


def test_approximate_with_full_radius_is_exact(spark):
    rows, _ = random_vectors(np.random.default_rng(7), 200)
    v = spark.createDataFrame(rows, "namespace STRING, id STRING, values ARRAY<FLOAT>")
    q = v.where("namespace = 'a'").limit(10).select(
        F.col("id").alias("query_id"), F.col("values").alias("query_vector"), "namespace"
    )
    exact = nearest.nearest(v, q, DIM)
    near = approximate.nearest_approximate(approximate.by_cell(v, 3), q, DIM, 3, 3)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, exact.collect()))
    narrow = approximate.nearest_approximate(approximate.by_cell(v, 3), q, DIM, 3, 0)
    share = approximate.recall(narrow, exact).first()
    assert 0 < share["recall"] <= 1 and share["exact_hits"] == 50


def test_top_n_with_one_hot_key(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    got = skew.top_n(df, ["k"], [F.desc("v")], 3, ["v"])
    hot = sorted((r["rank"], r["v"]) for r in got.where("k = 0").collect())
    assert [v for _, v in hot] == [4999, 4997, 4996] and [n for n, _ in hot] == [1, 2, 3]


def test_contract(spark):
    df = spark.createDataFrame(
        [("1", [1.0, 2.0]), ("2", [1.0]), ("3", None), ("", [1.0, 2.0]), ("5", [1.0, float("nan")])],
        "id STRING, values ARRAY<FLOAT>",
    )
    good, bad = vec.contract(df, 2)
    assert [r["id"] for r in good.collect()] == ["1"]
    assert sorted(r["reject_reason"] for r in bad.collect()) == [
        "missing id", "missing values", "not a number", "wrong dimension"
    ]


def test_every_hit_asked_for_and_rejects(spark):
    from docloom.operators.nearest import nearest, query_rejects

    records = spark.createDataFrame(
        [("default", f"v{i:03d}", [1.0, i / 100]) for i in range(80)], "namespace STRING, id STRING, values ARRAY<FLOAT>"
    )
    queries = spark.createDataFrame(
        [(1, [1.0, 0.0], 70), (2, [1.0], 3), (3, [1.0, 0.0], 0), (4, None, 2), (5, [1.0, 0.0], None)],
        "query_id INT, query_vector ARRAY<DOUBLE>, top_k INT",
    )
    hits = {r["query_id"]: r["count"] for r in nearest(records, queries, 2).groupBy("query_id").count().collect()}
    assert hits == {1: 70, 5: 5}
    rejects = {r["query_id"]: r["reason"] for r in query_rejects(queries, 2).collect()}
    assert rejects == {2: "vector size", 3: "top_k", 4: "vector size"}
