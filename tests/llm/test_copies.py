"""Near copies, repeats, leaks, vectors, language model, lists: against brute force."""

import itertools
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontamination, near_copies, near_vectors, repeats, suffix_tree_lm, url_lists
from docloom.llm import setsketch as sk
from docloom.llm.components import components
from docloom.llm.suffixes import suffix_array
from docloom.session import shared_folder
from .conftest import sentence


def roots(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def changed(text, at):
    words = text.split(" ")
    for i in at:
        words[i] = "other"
    return " ".join(words)


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(5)
    base = [sentence(k, 200) for k in range(4)]
    texts = [None, "", " \n ", "one two", "ONE two", "one two three", *base, *base[:2]]
    for k in range(60):
        texts.append(changed(base[k % 4], [rng.randrange(200) for _ in range(rng.randrange(12))]))
    sets = [shingles(None if t is None else t.lower()) for t in texts]
    links = [
        (a, b)
        for a, b in itertools.combinations(range(len(texts)), 2)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = roots(range(len(texts)), links)
    rows = near_copies.near_copies(docs_of(list(enumerate(texts)) + [(None, "x y")])).collect()
    for r in rows:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[r.doc_id]))
            assert r.kept == (r.component_id == r.doc_id)
    assert near_copies.near_copies(docs_of([])).count() == 0


def test_drop_copies_leaves_one_row_of_each_component(docs_of):
    one, two, three = (sentence(k, 200) for k in (1, 2, 3))
    near = changed(one, [7])
    rows = [(1, one), (1, one), (2, one), (3, two), (3, two.upper()), (4, three), (4, two), (5, near), (1, near)]
    rows += [(None, one), (None, one), (6, ""), (6, ""), (7, None)]
    left = near_copies.drop_copies(docs_of(rows), percent=80).collect()
    ids = Counter(r.doc_id for r in left)
    assert ids == {1: 1, 3: 1, 4: 1, None: 2, 6: 2, 7: 1}
    assert {r.text for r in left if r.doc_id == 4} == {three}


def repeated_bytes(texts, length):
    """Which bytes a string of ``length`` bytes covers that starts elsewhere too."""
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_pipeline_stages_keep_repeated_rows(spark, docs_of, folder):
    texts = [sentence(k, 120) for k in range(6)]
    shared = sentence(50, 90)
    texts[4], texts[5] = texts[4] + " " + shared, shared + " " + texts[5]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (4, texts[4])]
    once = corpus_pipeline.drop_near_copies(spark, docs_of(rows), folder)
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.cut_repeats(spark, once, folder).collect())
    want = []
    for k, (text, gone) in enumerate(zip(texts, repeated_bytes(texts, 400))):
        want.append((k, "".join(c for c, g in zip(text, gone) if not g)))
    assert got == want and want[0][1] == texts[0] and len(want[4][1]) < len(texts[4])


def test_likelihood_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 62, 4000).astype(np.uint64)
    sets = [np.unique(pool[:3000]), np.unique(pool[300:3000])]
    regs = sk.sketches(sets)
    joined = sk.sketches([np.union1d(*sets)])[0]
    assert (np.maximum(*regs) == joined).all()
    up, down = (regs[:1] > regs[1:]).sum(1), (regs[:1] < regs[1:]).sum(1)
    assert abs(sk.likely_similarity(up, down, np.array([3000.0]), np.array([2700.0]))[0] - 0.9) < 0.1


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = [rng.randint(0, rng.choice([0, 1, 3])) for _ in range(rng.randint(0, 50))]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_repeats_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    length, rng = 60, random.Random(9)
    shared = [sentence(k, 40) for k in range(3)]
    texts = [None, "", "short", "ab" * 100, "ü" * 90, shared[0], shared[0]]
    for k in range(40):
        part = shared[k % 3]
        low = rng.randrange(60)
        texts.append(sentence(100 + k, 15) + part[low : low + rng.randrange(40, 150)] + sentence(200 + k, 10))
    raws = [(t or "").encode() for t in texts]
    starts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    got = {r.doc_id: r for r in repeats.removed(docs_of(list(enumerate(texts))), length).collect()}
    for k, raw in enumerate(raws):
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        assert got[k].kept == bytes(b for b, g in zip(raw, gone) if not g)
        assert got[k].n_removed == sum(gone)
        assert len(got[k].spans) == sum(g and not p for p, g in zip([False, *gone], gone))
    left = repeats.remove(docs_of(list(enumerate(texts))), length)
    assert left.columns == docs_of([]).columns and left.count() == len(texts)
    assert repeats.removed(docs_of([]), length).count() == 0


def test_repeats_of_null_ids_equal_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    length, rng = 60, random.Random(11)
    shared = [sentence(k, 40) for k in range(3)]
    rows = [(None, None), (None, ""), (0, shared[0]), (None, shared[0]), (None, shared[1]), (None, shared[1])]
    for k in range(40):
        low = rng.randrange(60)
        part = shared[k % 3][low : low + rng.randrange(40, 150)]
        rows.append((None if k % 3 == 0 or k % 4 == 0 else k, sentence(100 + k, 15) + part + sentence(200 + k, 10)))
    want = []
    for (own, text), gone in zip(rows, repeated_bytes([t for _, t in rows], length)):
        want.append((own is None, own, sum(gone), bytes(b for b, g in zip((text or "").encode(), gone) if not g)))
    got = [(r.doc_id is None, r.doc_id, r.n_removed, bytes(r.kept)) for r in repeats.removed(docs_of(rows), length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(w[0] and w[2] for w in want)
    left = repeats.remove(docs_of(rows), length).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(
        (own, None if text is None else w[3].decode()) for (own, text), w in zip(rows, want)
    )


def test_pipeline_cuts_passages_of_over_fifty_words(spark, docs_of, folder, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 4)
    rng = random.Random(12)
    shared = [sentence(300 + k, 90).split() for k in range(3)]
    planted = [f"é{k:04d}" for k in range(51)]
    texts = [None, "", "x " * 60, "y " * 51, "z " * 52, " ".join(["lone", *planted])]
    texts.append("\n".join(planted) + "\tend")
    for k in range(40):
        low = rng.randrange(30)
        part = shared[k % 3][low : low + rng.randrange(40, 60)]
        texts.append(" ".join([sentence(400 + k, 15), *part, sentence(500 + k, 10)]))
    rows = [(None if k % 5 == 0 else k, t) for k, t in enumerate(texts)]
    parts = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    starts = Counter(tuple(p[i : i + 51]) for p in parts for i in range(len(p) - 50))
    want = []
    for (own, text), p, by_byte in zip(rows, parts, repeated_bytes(texts, 400)):
        raw, gone = (text or "").encode(), by_byte
        spans = [m.span() for m in re.finditer(b"[^\x20\x09-\x0d]+", raw)]
        for i in range(len(p) - 50):
            if starts[tuple(p[i : i + 51])] > 1:
                low, high = spans[i][0], spans[i + 50][1]
                gone[low:high] = [True] * (high - low)
        want.append((own, None if text is None else bytes(b for b, g in zip(raw, gone) if not g).decode()))
    assert want[5][1] == "lone " and want[6][1] == "\tend" and want[3][1] == texts[3]
    assert len(" ".join(planted).encode()) < 400
    left = corpus_pipeline.cut_repeats(spark, docs_of(rows), folder)
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(want)


def test_op9_reports_passages_of_over_fifty_words(spark, docs_of, tmp_path):
    from docloom.llm.queries import QUERIES

    rng = random.Random(13)
    shared = [sentence(700 + k, 90).split() for k in range(3)]
    planted = [f"é{k:04d}" for k in range(51)]
    texts = [None, "", "short", "y " * 51, "z " * 52, " ".join(planted[1:]), sentence(600, 200)]
    texts += [" ".join([sentence(601, 30), *planted, sentence(602, 30)]), "\n".join(planted) + "\tend"]
    for k in range(30):
        low = rng.randrange(30)
        part = shared[k % 3][low : low + rng.randrange(40, 60)]
        texts.append(" ".join([sentence(800 + k, 15), *part, sentence(900 + k, 10)]))
    texts += [" ".join(shared[0]), " ".join([*shared[0], "more"])]
    parts = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    starts = Counter(tuple(p[i : i + 51]) for p in parts for i in range(len(p) - 50))
    want = []
    for k, (text, p, by_byte) in enumerate(zip(texts, parts, repeated_bytes(texts, 400))):
        raw, found = (text or "").encode(), []
        spans = [m.span() for m in re.finditer(b"[^\x20\x09-\x0d]+", raw)]
        for i in range(len(p) - 50):
            if starts[tuple(p[i : i + 51])] > 1:
                if found and i <= found[-1][1]:
                    found[-1][1] = i + 51
                else:
                    found.append([i, i + 51])
        size = sum(spans[b - 1][1] - spans[a][0] for a, b in found)
        want.append((k, len(raw), sum(by_byte), len(found), size))
    assert want[7][2:] == want[8][2:] == (0, 1, len(" ".join(planted).encode()))
    assert any(w[2] for w in want) and not any(w[3] for w in want[:4] + want[5:7])
    folder, work = str(tmp_path), shared_folder(spark)
    docs_of(list(enumerate(texts))).write.parquet(f"{folder}/documents.parquet")
    before = set(os.listdir(work))
    found = QUERIES["op9_lyndon_suffix_dedup"](spark, folder)
    got = found.select("doc_id", "n_bytes", "n_removed", "n_passages", "passage_bytes")
    assert sorted(tuple(r) for r in got.collect()) == want
    assert all(n.startswith("repeats-") for n in set(os.listdir(work)) - before)


def test_leaks(spark, docs_of):
    items = [(1, sentence(1, 40)), (2, sentence(2, 30)), (3, "tiny"), (4, None), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    near = sentence(1, 40).replace("w1", "W1", 2)[5:]
    rows = [
        (1, sentence(9, 50) + " " + sentence(1, 40).upper() + " " + sentence(8, 50)),
        (2, "é " + near + " end"), (3, sentence(2, 30)[:60]), (4, None), (5, ""), (6, sentence(7, 400)),
        (7, changed(sentence(2, 30), [5]).replace(" ", ",  ")),
    ]
    docs = docs_of(rows)
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 1), (7, 2)}
    hit = found[1, 1]
    assert rows[0][1].encode()[hit.start_byte : hit.end_byte].decode().lower() == sentence(1, 40)
    assert hit.edits == 0
    left = decontamination.clean(docs, bench)
    assert {r.doc_id for r in left.collect()} == {3, 4, 5, 6} and left.columns == docs.columns
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_alignment_is_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(4)
    for _ in range(60):
        item = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 8)))
        text = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 12)))
        want = min(distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        got = decontamination.aligned(item, text, 99)
        assert got[0] == want == distance(item, text[got[1] : got[2]])


def test_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(6, 16))
    rows = []
    for k in range(120):
        v = centers[k % 6] + rng.normal(size=16) * 0.25 * rng.random()
        rows.append((k, v.tolist() if k % 10 else centers[0].tolist(), k % 2))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [math.nan] + [1.0] * 15, 1), (203, [1.0, None], 1)]
    rows += [(204, centers[0].tolist(), None), (205, [1.0, 2.0], 1), (206, [1.0, 2.0], 1), (207, [], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {i: (np.array(v), g) for i, v, g in rows if i < 200 or i in (205, 206)}
    links = [
        (a, b)
        for a, b in itertools.combinations(good, 2)
        if good[a][1] == good[b][1]
        and len(good[a][0]) == len(good[b][0])
        and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93
    ]
    want, n = roots([r[0] for r in rows], links), Counter(x for p in links for x in p)
    got = near_vectors.near_vectors(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert near_vectors.near_vectors(frame.limit(0)).count() == 0


def test_language_model(docs_of):
    rows = [(i, sentence(i % 7, 80).upper() if i % 2 else sentence(i % 7, 80)) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "never seen before"), (503, sentence(2, 80)), (503, sentence(2, 80))]
    docs = docs_of(rows).withColumn("held_out", F.col("doc_id") >= 500)
    got = suffix_tree_lm.score(docs, "held_out").collect()
    counts = Counter(w for i, t in rows if i < 500 for w in [*t.lower().split(), None])
    total, root = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    assert len(got) == len(rows)
    for r in got:
        tokens = [*(dict(rows)[r.doc_id] or "").lower().split(), None]
        assert (r.n_tokens, r.train_tokens) == (len(tokens), total)
        assert r.n_known == sum(counts[w] > 0 for w in tokens)
        base = sum(math.log10((counts[w] + 0.1) / root) for w in tokens)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    seen = next(r for r in got if r.doc_id == 503)
    assert seen.score > seen.base_score + 20
    assert suffix_tree_lm.score(docs.limit(0), "held_out").count() == 0


def listener(answers):
    """A chunk that only heard ``answers``."""
    chunk = suffix_tree_lm.Chunk.__new__(suffix_tree_lm.Chunk)
    chunk.row, chunk.buckets = {"chunk": 0}, 1
    chunk.said = {order: rows for order, rows in answers.groupby("about")}
    return chunk


ASKED = "bucket long, chunk long, keys binary, counts binary"


def test_language_model_counts_beyond_32_bits(spark, monkeypatch):
    keys = np.array([3, 8], np.uint64)
    frames = []
    for number in (0, 1):
        chunk = listener(pd.DataFrame({"about": []}))
        chunk.row = {"chunk": number}
        chunk.questions = lambda order: (keys, np.array([(1 << 31) + 1, 7]))
        frames.append(suffix_tree_lm._asked(chunk, 1))
    asked = spark.createDataFrame(pd.concat(frames), ASKED)
    got = suffix_tree_lm._answered(asked, 1).where("chunk = 0").toPandas()
    assert np.abs(listener(got).heard(1, keys)).tolist() == [(1 << 32) + 2, 14]


@pytest.mark.parametrize("n", [20_000_000, (1 << 25) + 3, 5_000_000_000])
def test_language_model_keeps_frequent_contexts_with_one_follower(spark, monkeypatch, n):
    keys = np.array([5], np.uint64)
    said = {"context": [5], "n": [n], "kinds": [1], "mass": [n - 0.75], "events": [n], "gain": [1000.0]}
    monkeypatch.setattr(suffix_tree_lm, "_contexts", lambda chunk: keys)
    monkeypatch.setattr(suffix_tree_lm, "_evidence", lambda chunk, root: pd.DataFrame(said))
    testimony = suffix_tree_lm._testimony(listener(pd.DataFrame({"about": []})), None)
    got = suffix_tree_lm._judged(spark.createDataFrame(testimony, ASKED)).toPandas()
    assert listener(got).heard(0, keys, np.float64).tolist() == [0.75 / n]


def test_url_lists(spark):
    entries = spark.createDataFrame(
        [
            ("domain", "b.com", "add", "2024-01-10"), ("domain", "b.com", "remove", "2024-03-05"),
            ("domain", "b.com", "add", "2024-06-01"), ("section", "x.org/en/", "add", "2024-02-01"),
            ("url", "http://x.org/en/p", "add", "2024-02-10"), ("domain", None, "add", "2024-01-01"),
            ("domain", "z.net", "add", "2024-02-02"), ("domain", "z.net", "remove", "2024-02-02"),
            ("domain", "b.com", "add", "2024-01-10"),
        ],
        "kind string, value string, action string, at string",
    ).withColumn("at", F.to_date("at"))
    cases = [
        ("http://a.b.com/", "2024-01-09", None), ("https://A.B.com:8/x", "2024-01-10", "b.com"),
        ("http://b.com", "2024-03-04", "b.com"), ("http://b.com", "2024-03-05", None),
        ("http://u@b.com.", "2025-01-01", "b.com"), ("http://x.org/en/q", "2024-02-01", "x.org/en/"),
        ("http://x.org/en/p#f", "2024-02-11", "http://x.org/en/p"), ("http://z.net/", "2024-02-03", None),
        (None, "2024-02-03", None), ("no url", "2024-02-03", None), ("http://b.com", None, None),
        ("http://bb.com/", "2024-02-03", None),
    ]
    frame = spark.createDataFrame([(i, u, t) for i, (u, t, _) in enumerate(cases * 2)], "id long, url string, t string")
    got = url_lists.evaluate(frame.withColumn("fetched_at", F.to_date("t")), entries).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert r.value == cases[r.id % len(cases)][2] and r.blocked == (r.value is not None)
    empty = url_lists.evaluate(frame.withColumn("fetched_at", F.to_date("t")), entries.limit(0))
    assert empty.where("blocked").count() == 0 and empty.count() == 2 * len(cases)


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, folder)
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.cut_repeats, corpus_pipeline.drop_leaks):
        for rows in (kept, kept.limit(0)):
            assert stage(spark, rows, folder).columns == docs.columns
    last = corpus_pipeline.run(spark, folder)
    assert 0 < last.count() < docs.count()
    assert last.where(~F.col("round_trip")).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "decontamination", "pieces"]


def test_a_vec_id_that_recurs_connects_nothing(spark):
    from docloom.llm import near_vectors

    a, b = [1.0, 0.0, 0.05, 0.0], [0.0, 1.0, 0.0, 0.05]
    rows = [(5, 1, a), (6, 1, [1.0, 0.01, 0.0, 0.0]), (5, 2, b), (7, 2, [0.01, 1.0, 0.0, 0.0]), (8, 3, a), (8, 3, b), (9, 3, b)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in near_vectors.near_vectors(df).collect())
    assert got == [
        (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False),
        (8, 0, 8, True), (8, 1, 8, True), (9, 1, 8, False),
    ]


def test_contained_neighbourhoods_and_hot_ones(spark, docs_of, monkeypatch):
    """Many extents of one passage, and one passage in most rows, against brute force."""
    from docloom.llm import repeats

    passage = " ".join(f"p{i}" for i in range(150))
    rows = [(i, f"x{i} " + passage[i % 7 : len(passage) - i % 11] + f" y{i}") for i in range(40)]
    rows += [(100 + i, f"{i} " * 3 + "hot " + "common words " * 9 + f"z{i}") for i in range(60)]
    monkeypatch.setattr(repeats, "HOT", 20)
    texts = {i: t.encode() for i, t in rows}
    seen = {}
    for i, t in texts.items():
        for at in range(len(t) - 99):
            seen.setdefault(t[at : at + 100], []).append((i, at))
    gone = {i: bytearray(len(t)) for i, t in texts.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                gone[i][at : at + 100] = b"\x01" * 100
    for r in repeats.removed(docs_of(rows), length=100).collect():
        kept = bytes(b for b, g in zip(texts[r.doc_id], gone[r.doc_id]) if not g)
        assert r.kept == kept and r.n_removed == sum(gone[r.doc_id]) and r.text == kept.decode("utf-8", "replace")


def _plain(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    plain, _, _ = decontamination.plain_form(data, np.array([0, len(data)]))
    return bytes(plain)


def _edits(item, text):
    """Least edits of ``item`` against any part of ``text``, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark, docs_of, monkeypatch):
    import random

    rng = random.Random(8)
    items = [sentence(i, rng.randrange(1, 16)) for i in range(24)] + ["w1 w2", "Ab", "ab", "--", "", "x", "É é"]
    bench = [(i, t) for i, t in enumerate(items)] + [(None, "w9 w8 w7 w6"), (99, None), (3, items[3])]
    texts = [None, "", "w1", "aw1 w2", "so w1 w2!", "AB c", "cab", "x", "É É é"]
    for n in range(60):
        words = sentence(1000 + n, 25)
        t = list(items[n % 24].encode())
        for _ in range(rng.randrange(0, 2 + len(t) // 9)):
            at = rng.randrange(len(t))
            kind = rng.randrange(3)
            t[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice(b"abcw012 ")]
            t = t or [120]
        texts.append(words[: rng.randrange(60)] + " " + bytes(t).decode() + " " + words[60:90])
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    want = {}
    for i, t in rows:
        for k, item in bench:
            own, text = _plain(item).strip(), _plain(t)
            if k is None or not own:
                continue
            if len(own) < 8:
                if f" {own.decode()} " in f" {text.decode()} ":
                    want[i, k] = 0
                continue
            budget = min(len(own) // 10, max(len(own) - 8, 0) // 8)
            found = _edits(own, text)
            if found <= budget:
                want[i, k] = found
    df = spark.createDataFrame(bench, "item_id long, text string")
    for size in (1 << 20, 64):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.leaks(docs_of(rows).withColumn("item_id", F.lit("x")), df).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want
    assert len(want) > 40
    for r in got:
        raw = (dict(rows)[r.doc_id] or "").encode()[r.start_byte : r.end_byte]
        assert _edits(_plain(dict(bench)[r.item_id]).strip(), _plain(raw.decode("utf-8", "ignore"))) <= r.edits + 1
