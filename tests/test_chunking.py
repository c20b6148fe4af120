import random

from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import chunking, sections


def chunks_of(spark, text, **options):
    df = spark.createDataFrame([("d", text)], "document_id STRING, content STRING")
    rows = chunking.chunk_documents(df, **options).orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in rows] == [f"d_chunk_{i}" for i in range(len(rows))]
    assert [r["metadata"]["chunk_index"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["char_count"] == len(r["content"]) and r["word_count"] == len(r["content"].split())
    return [r["content"] for r in rows]


def test_blank_text_has_no_chunks(spark):
    assert chunks_of(spark, " \n\n  ") == []


def test_long_paragraph_is_not_split(spark):
    assert chunks_of(spark, "x" * 5000) == ["x" * 5000]


def test_overlap_is_carried(spark):
    a, b = "a" * 500 + "b" * 100, "c" * 600
    first, second = chunks_of(spark, f"{a}\n\n{b}")
    assert first == a and second == a[-198:] + "\n\n" + b


def test_zero_means_default(spark):
    text = "\n\n".join(c * 600 for c in "abc")
    assert chunks_of(spark, text, overlap=0) == chunks_of(spark, text, overlap=200)
    assert chunks_of(spark, text, size=0) == chunks_of(spark, text)


GAP = "\n\n"


def packed(text, size, overlap):
    """Chunks as lists of paragraphs: each but the last is full, and hands on its tail."""
    parts, out = [], []
    for para in filter(None, map(str.strip, text.strip().split(GAP))):
        joined = GAP.join(parts)
        if parts and len(joined) + len(para) > size - 4:
            out.append(joined)
            tail = (joined + GAP)[-overlap:].strip()
            parts = [tail] if tail else []
        parts.append(para)
    return out + [GAP.join(parts)] * bool(parts)


def test_random_texts_follow_the_rule(spark):
    rng = random.Random(3)
    alphabet = ["a", "bb", "é", "😀", " ", "\n", "\n\n", " ", "ccc ddd", "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    for size, overlap in ((20, 5), (40, 1), (40, 2), (30, 60)):
        got = df.select("i", chunking.chunk_texts(F.col("t"), size, overlap).alias("c")).orderBy("i")
        for text, row in zip(texts, got.collect()):
            assert row["c"] == packed(text, size, overlap), (repr(text), size, overlap)


def test_metadata_is_copied(spark):
    df = spark.createDataFrame(
        [("d", "one\n\ntwo", ("f.md", "md"))],
        "document_id STRING, content STRING, metadata STRUCT<filename: STRING, file_type: STRING>",
    )
    row = chunking.chunk_documents(df).first()
    assert row["metadata"].asDict() == {"filename": "f.md", "file_type": "md", "chunk_index": 0}


def test_section_nodes(spark):
    text = "intro words here\n\n# First\n\none two three\n\nfour five six\n\n## Second\n\nseven\f\n\neight\f\n\nnine"
    df = spark.createDataFrame([("d", text)], "document_id STRING, content STRING")
    small = Settings(node_max_tokens=5, node_max_pages=2)
    rows = sections.document_nodes(df, settings=small).orderBy("node_index").collect()
    assert [(r["title"], r["token_count"], r["start_page"], r["end_page"]) for r in rows] == [
        (None, 3, 1, 1), ("First", 5, 1, 1), ("First", 3, 1, 1), ("Second", 4, 1, 2), ("Second", 1, 3, 3)
    ]
    assert rows[1]["content"] == "# First\n\none two three"
    whole = sections.document_nodes(df).collect()
    assert [r["title"] for r in whole] == [None, "First", "Second"]


def test_folds_across_blocks(spark):
    """More paragraphs than one fold block holds."""
    rng = random.Random(4)
    text = "\n\n".join("w" * rng.randint(1, 9) + f" {i}" for i in range(1500))
    df = spark.createDataFrame([("d", text)], "document_id STRING, content STRING")
    got = df.select(chunking.chunk_texts(F.col("content"), 60, 20).alias("c")).first()["c"]
    assert got == packed(text, 60, 20) and len(got) > 256
    small = Settings(node_max_tokens=7)
    rows = sections.document_nodes(df, settings=small).orderBy("node_index").collect()
    assert [r["token_count"] for r in rows] == [6] * 500
    assert "\n\n".join(r["content"] for r in rows) == text
