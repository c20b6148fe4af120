"""Registered queries: SQL where there is some, else the contract's columns and rows."""

import duckdb
import pytest

from check import TABLES, rows_of
from docloom.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, folder, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, folder), db.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, want.fetchall())


@pytest.mark.parametrize(
    "name, columns",
    [
        ("op1", "doc_id held_out n_tokens n_known train_tokens base_score score"),
        ("op2", "vec_id n_links component_id kept"),
        ("op3", "doc_id held_out lang_pred score"),
        ("op4", "doc_id start n_tokens ids_crc32"),
        ("op5", "doc_id n_shingles component_id kept"),
        ("op6", "doc_id n_tokens ids_sha256 decoded_sha256"),
        ("op8", "doc_id held_out score predicted"),
        ("op9", "doc_id n_bytes n_removed n_spans kept_sha256"),
    ],
)
def test_one_row_per_input_row(spark, folder, name, columns):
    query = next(q for n, q in QUERIES.items() if n.startswith(f"{name}_"))
    got = query(spark, folder)
    assert set(columns.split()) <= set(got.columns)
    source = "embeddings" if name == "op2" else "documents"
    assert got.count() == spark.read.parquet(f"{folder}/{source}.parquet").count()
    assert got.select(columns.split()[0]).distinct().count() == got.count()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op3_output_code_language"](spark, folder).where("held_out").join(docs, "doc_id")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0")
    scored = QUERIES["op8_rule_ensemble_quality"](spark, folder).where("held_out").join(labels, "doc_id")
    assert scored.where("quality = predicted").count() >= 0.95 * scored.count()
    lm = QUERIES["op1_suffix_tree_lm"](spark, folder).where("held_out").groupBy().sum("score", "base_score").first()
    assert lm[0] > lm[1]
