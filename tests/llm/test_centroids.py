"""Centroid clustering against plain integers in Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.llm import centroids
from docloom.session import shared_folder

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k=16, rounds=3, width=64):
    kept = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]

    def name(i):
        return hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()

    centres = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, own in groups.items():
            centres[j] = [sum(col) // len(own) for col in zip(*own)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in placed)
    own = {j: sum(d for _, c, d in placed if c == j) for j in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, own[j], total, digest[j]) for i, j, d in placed), key=str)


def result(df):
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def vectors(n, seed, width=64):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) for _ in range(width)]) for i in range(n)]


def made(spark, rows):
    return spark.createDataFrame([(i, v, "other") for i, v in rows], SCHEMA)


def test_equals_brute_force(spark):
    rows = vectors(300, 1)
    one = rows[5][1]
    rows += [(1000 + i, one) for i in range(150)] + [(7, one), (7, one), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(2000, None), (2001, []), (2002, one[:63]), (2003, [None, *one[1:]]), (2004, [float("nan"), *one[1:]])]
    rows += [(2005, [float("inf"), *one[1:]]), (2006, [0.0] * 64), (2007, [-0.0] * 64), (2008, [2.0**19] * 64)]
    got = centroids.centroid_clusters(made(spark, rows))
    assert result(got) == brute(rows)
    assert len(got.first()["centroid"]) == 64


@pytest.mark.parametrize("n", [0, 1, 5, 16])
def test_few_vectors(spark, n):
    rows = vectors(n, 2)
    assert result(centroids.centroid_clusters(made(spark, rows))) == brute(rows)


def test_ties_and_empty_clusters(spark):
    """All vectors equal: every one in the first cluster, the others stay empty."""
    rows = [(i, [0.5] * 64) for i in range(40)]
    got = result(centroids.centroid_clusters(made(spark, rows)))
    assert got == brute(rows) and {r[1] for r in got} == {0}


def test_other_widths_and_rounds(spark):
    rows = vectors(60, 3, 8)
    got = centroids.centroid_clusters(made(spark, rows), k=3, rounds=6, dimension=8)
    assert result(got) == brute(rows, 3, 6, 8)


def test_components_that_do_not_fit(spark):
    with pytest.raises(Exception, match="beyond"):
        centroids.centroid_clusters(made(spark, [(1, [2.0**40] * 64)])).collect()


def test_earlier_states_are_deleted(spark):
    from pathlib import Path

    folder = Path(shared_folder(spark))
    centroids.centroid_clusters(made(spark, vectors(20, 4))).count()
    assert not list(folder.glob("centroid-state-*"))


def test_float_input(spark):
    rows = vectors(50, 5)
    df = made(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>"))
    cut = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert result(centroids.centroid_clusters(df)) == brute(cut)
