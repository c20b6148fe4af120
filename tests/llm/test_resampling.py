"""Importance resampling against a version of a few lines, on zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import resampling
from tests.llm.conftest import sentence


def features(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent=5, least=20):
    def buckets(text):
        return [zlib.crc32(f.encode()) % 10_000 for f in features(text)[1]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text))
    for text in target:
        t.update(buckets(text))
    s_all, t_all = s.total() + 10_000, t.total() + 10_000
    out = []
    for key, text in rows:
        found = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(found), weight, score, None, features(text)[0] >= least])
    long = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, row in enumerate(long[: len(long) * percent // 100]):
        row[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(df):
    rows = df.select("doc_id", "n_features", "weight", "score", "rank").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_checksums_of_spans_of_any_length():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    sizes = [1, 2, 3, 7, 255, 256, 257, 511, 512, 513, 1024, 5000, 100_000, *rng.integers(1, 900, 300)]
    starts = np.array([int(rng.integers(0, len(data) - n + 1)) for n in sizes])
    ends = starts + np.array(sizes)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert resampling.span_crc().of(data, starts, ends).tolist() == want
    assert resampling.span_crc().of(data, starts[:0], ends[:0]).tolist() == []


@pytest.mark.parametrize("percent, least", [(5, 20), (40, 3), (100, 0)])
def test_equals_brute_force(spark, docs_of, percent, least):
    rows = [(i, sentence(i, 5 + i % 60)) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "--- ... !"), (1003, "É É, é-x İ ß 中文 a1\x00b"), (1004, "x" * 3000 + " y " * 40)]
    rows += [(None, sentence(3, 40)), (2000, sentence(9, 50)), (2000, sentence(9, 50)), (2001, "A b C " * 30_000)]
    target = [sentence(i, 30) for i in range(5)] + [None, "", "x" * 3000]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    docs = docs_of(rows).withColumns({"weight": F.lit("w"), "_row": F.lit(1), "bucket": F.lit(2)})
    got = resampling.resample(docs, bench, percent, least)
    assert result(got) == brute(rows, target, percent, least)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs_of([]), none).count() == 0
    rows = [(i, sentence(i, 30)) for i in range(40)]
    assert result(resampling.resample(docs_of(rows), none)) == brute(rows, [])


def test_ranks_run_on_over_many_ranges(spark, docs_of):
    """A third of the rows have one id and text; ranges are cut inside such ties."""
    rows = [(7 if i % 3 == 0 else i, sentence(1 if i % 3 == 0 else i, 25)) for i in range(600)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = result(resampling.resample(docs_of(rows), docs_of(rows[:9]), percent=50))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, [t for _, t in rows[:9]], percent=50)
