"""Language model, language and quality against versions in plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docloom.llm import language, quality, suffix_tree_lm
from tests.llm.conftest import sentence

END = None


def tokens_of(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), END]


class Tree:
    """The suffix tree of the module's docstring, over dictionaries."""

    def __init__(self, texts, least, gain, discount=0.75):
        self.least, self.discount = least, discount
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for own in map(tokens_of, texts):
            self.one.update(own)
            self.two.update(zip(own, own[1:]))
            self.three.update(zip(own, own[1:], own[2:]))
        self.total, self.kinds = self.one.total(), len(self.one)
        self.mass = {}
        followers = defaultdict(dict)
        for (a, b), n in self.two.items():
            if n >= 2:
                followers[a,][b] = n
        for (a, b, c), n in self.three.items():
            if n >= 2:
                followers[a, b][c] = n
        contexts = [(w,) for w in self.one if w is not END] + [p for p in self.two if p[1] is not END]
        for s in contexts:
            whole = self.one[s[0]] if len(s) == 1 else self.two[s]
            if whole < least:
                continue
            said = followers.get(s, {})
            total = sum(
                n * math.log((n - discount) / (whole * min(self.below(s, w), 1.0))) for w, n in said.items()
            )
            rest = whole - sum(said.values())
            left = (rest + discount * len(said)) / whole
            total += rest * math.log(max(left, 1e-300))
            if left > 0 and total >= gain:
                self.mass[s] = left

    def root(self, w):
        return (self.one[w] + 0.1) / (self.total + 0.1 * (self.kinds + 1))

    def below(self, s, w):
        if len(s) == 1:
            return self.root(w)
        n = self.two[s[1], w]
        return max((n if n >= 2 else 0) - self.discount, 0) / max(self.one[s[1]], 1) + self.root(w)

    def score(self, text):
        out, own = 0.0, tokens_of(text)
        for t, w in enumerate(own):
            p = self.root(w)
            for size, counts in ((1, self.two), (2, self.three)):
                s = tuple(own[t - size : t]) if t >= size else None
                if s in self.mass:
                    whole = self.one[s[0]] if size == 1 else self.two[s]
                    n = counts[(*s, w)]
                    p = (max(n - self.discount, 0) if n >= 2 else 0) / whole + self.mass[s] * p
            out += math.log10(p)
        return out


def test_suffix_tree_equals_brute_force(docs_of, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "LEAST", 4)
    monkeypatch.setattr(suffix_tree_lm, "GAIN", 1.5)
    # Small chunks, so that counts come together from many of them.
    monkeypatch.setattr(suffix_tree_lm, "CHUNK_BYTES", 2000)
    phrases = ["the cat sat on the mat", "A dog ran far away", "the cat ran on", "one two three one two four"]
    rows = [(i, " ".join(phrases[(i * 7 + k * k) % 4] for k in range(1 + i % 9))) for i in range(80)]
    rows += [(100 + i, sentence(i, 30)) for i in range(20)] + [(None, "the cat"), (7, "the cat"), (200, None), (201, ""), (202, "new")]
    docs = docs_of(rows).withColumn("held", F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)))
    tree = Tree([t for i, t in rows if i is None or i % 5], 4, 1.5)
    assert len([s for s in tree.mass if len(s) == 2]) > 3
    got = suffix_tree_lm.score(docs, "held").collect()
    want = sorted((str(i), round(tree.score(t), 8)) for i, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 8)) for r in got) == want
    base = {str(i): sum(math.log10(tree.root(w)) for w in tokens_of(t)) for i, t in rows if i != 7}
    assert all(r.base_score == pytest.approx(base[str(r.doc_id)]) for r in got if r.doc_id != 7)


def test_output_codes_equal_brute_force(docs_of):
    words = {"aa": "the thing that ", "bb": "der die Das und ", "cc": "que los las pará ", "dd": "il che gli una "}
    rows = [(i, words[k] * (2 + i % 5) + sentence(i, i % 4), k) for i, k in enumerate(sorted(words) * 9)]
    buckets, pseudo, gain = 1 << 15, 0.5, 12.0

    def trigrams(text):
        raw = [32, *((b | 32) if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()), 32]
        codes = [raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2] for i in range(len(raw) - 2)]
        return [(c * 0x9E3779B1 % (1 << 32)) >> 17 for c in codes]

    share = {}
    for lang in words:
        counts = Counter(b for _, t, k in rows if k == lang for b in trigrams(t))
        total = counts.total() + pseudo * buckets
        share[lang] = [(counts[b] + pseudo) / total for b in range(buckets)]
    code = language.codewords(4).tolist()
    langs, odds, apart = sorted(words), [], []
    for bit in range(len(code[0])):
        sides = []
        for sign in (1, -1):
            own = [share[k] for k, row in zip(langs, code) if row[bit] == sign]
            sides.append([sum(col) / len(own) for col in zip(*own)])
        odds.append([math.log(u) - math.log(d) for u, d in zip(*sides)])
        apart.append(sum((u - d) * o for u, d, o in zip(*sides, odds[-1])))
    trust = [a * len(apart) / sum(apart) for a in apart]

    def judged(text):
        if not text or not re.search(r"[^\W\d_]", text):
            return "und", 0.0, True
        own = trigrams(text)
        margins = [sum(o[b] for b in own) / len(text.encode()) for o in odds]
        loss = [
            sum(math.log1p(math.exp(-m * c * gain)) * w for m, c, w in zip(margins, row, trust)) for row in code
        ]
        best = min(range(4), key=loss.__getitem__)
        second = min(x for i, x in enumerate(loss) if i != best)
        return langs[best], 1 / sum(math.exp(loss[best] - x) for x in loss), second - loss[best] < 0.5

    model = language.fit(docs_of(rows))
    new = [*(t for _, t, _ in rows[:8]), "the und", "che Das los", "xyz", "12 !?", "", None, "gli é", "x" * 50_000 + " die"]
    got = language.identify(docs_of(list(enumerate(new))), model).orderBy("doc_id").collect()
    for row, text in zip(got, new):
        lang, score, ambiguous = judged(text)
        assert (row.lang_pred, row.ambiguous) == (lang, ambiguous) and row.score == pytest.approx(score, abs=1e-4), text


def statistics(text):
    """The statistics of a text, over Python strings."""
    tokens, lines = text.replace("\n", " ").split(" "), text.split("\n")
    letters = sum(c.isalpha() for c in text)
    spaces = sum(c in " \t\n\x0b\f\r" for c in text)
    rest = len(text) - letters - spaces
    n = len(text)
    part = (lambda a, b: a / b if b else 0.0)
    return {
        "log_chars": math.log1p(n), "word_length": n / len(tokens),
        "variety": math.log1p(len(set(tokens))) / math.log1p(len(tokens)),
        "distinct_lines": len(set(lines)) / len(lines), "line_words": len(tokens) / len(lines),
        "upper": part(sum(c.isupper() for c in text), n), "letters": part(n - rest - len(tokens) + 1, n),
        "digits": part(sum(c in "0123456789" for c in text), n),
        "marks": part(sum(c in "!?#$%&*|<>{}=~^_" for c in text), n),
        "stops": sum(c in ".,;:" for c in text) / len(tokens),
    }


def test_rules_equal_brute_force(spark, docs_of):
    good = [(i, sentence(i, 60 + i) + ".\nEnd.") for i in range(120)]
    bad = [(1000 + i, "SPAM!! 77 \n" * (40 + i % 9) + sentence(i, i)) for i in range(120)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    model = quality.fit(docs_of(good + bad), labels)
    new = good[:20] + bad[:20] + [(5000, None), (5001, ""), (5002, " \t\n"), (5003, "Été, 12 x!\n\nÉté"), (5004, "word " * 100_000), (5005, "a")]
    assert model.rules
    got = {r.doc_id: r._score for r in quality.score(docs_of(new), model).collect()}
    for key, text in new:
        stats, total = statistics(text or ""), model.intercept
        for conditions, weight in model.rules:
            if all(stats[n] <= t if sign == "<=" else stats[n] > t for n, sign, t in conditions):
                total += weight
        assert got[key] == pytest.approx(1 / (1 + math.exp(-total))), key
    kept = {r.doc_id for r in quality.reject(docs_of(new), model).collect()}
    assert kept == {k for k, s in got.items() if s >= 0.5}
    assert np.isfinite(list(got.values())).all()


def test_verdicts_of_contexts_travel_as_small_whole_numbers(spark):
    lm, rng = suffix_tree_lm, np.random.default_rng(5)
    keys = np.unique(rng.integers(1, 1 << 60, 20_000).astype(np.uint64))
    n = rng.integers(lm.LEAST, 500, len(keys))
    kinds = rng.integers(1, 9, len(keys))
    events = np.minimum(2 * kinds, n)
    gain = np.full(len(keys), 1e6) / lm.UNIT
    said = lm._packed(np.concatenate([n, events, kinds, gain.astype(np.int64)]))
    frame = pd.DataFrame({"bucket": [0], "chunk": [3], "keys": [lm._packed_keys(keys, 1)], "counts": [said]})
    got = lm._judged(spark.createDataFrame(frame, "bucket long, chunk long, keys binary, counts binary")).first()
    left = lm._shares(lm._unpacked(got.numbers))
    assert (left == ((n - events) + lm.DISCOUNT * kinds) / n).all() and (left > 0).all()
    # Shares as doubles took seven bytes each.
    assert len(got.numbers) < 4 * len(keys)


def test_words_and_pairs_are_asked_for_by_small_numbers(spark):
    lm, rng = suffix_tree_lm, np.random.default_rng(9)
    buckets, shift = 4, np.uint64(13)
    words = np.unique(rng.integers(1, 1 << 51, 3000).astype(np.uint64))
    counts = {k: np.minimum(rng.zipf(1.3, len(words)), 1 << 20) for k in (0, 1)}
    frames = []
    for k in counts:
        chunk = lm.Chunk.__new__(lm.Chunk)
        chunk.row, chunk.buckets, chunk.said = {"chunk": k}, buckets, {}
        chunk.questions = lambda order, k=k: (words[k::2], counts[k][k::2]) if k else (words, counts[0])
        frames.append(lm._asked(chunk, 1))
    asked = spark.createDataFrame(pd.concat(frames), "bucket long, chunk long, keys binary, counts binary")
    got = lm._answered(asked, 1, buckets).toPandas()
    bounds = [np.frombuffer(n, np.int64) for n in got[got["chunk"] == -1]["numbers"]]
    below = buckets * int(max(b[1] for b in bounds))
    total = counts[0].copy()
    total[1::2] += counts[1][1::2]
    assert sum(int(b[0]) for b in bounds) == len(words)
    for k, own in ((0, slice(None)), (1, slice(1, None, 2))):
        chunk.said = {order: rows.sort_values("bucket") for order, rows in got[got["chunk"] == k].groupby("about")}
        assert (np.abs(chunk.heard(1, words[own])) == total[own]).all()
        number, often = chunk.numbered(1, words[own], total[own]), total[own] >= 2
        first = number if k == 0 else first
        assert (number[often] == first[own][often]).all() and len(np.unique(number[often])) == often.sum()
        assert (number[often] < below).all() and (number[often] % buckets == words[own][often] % buckets).all()
    # A frequent word has a small number.
    same = words % buckets == words[np.argmax(total)] % buckets
    assert first[np.argmax(total)] < buckets and first[same & (total == 2)].min() > first[same & (total > 50)].max()
    # Pairs of numbers are told apart and take fewer bytes than hashes; too many of them are hashed.
    draw = rng.choice(np.flatnonzero(total >= 2), (2, 5000), p=total[total >= 2] / total[total >= 2].sum())
    left, right = first[draw[0]], first[draw[1]]
    keys, hashes = lm._joined(left, right, (below, below), shift), lm.mixed(left * lm._PAIR[0] + right * lm._PAIR[1]) >> shift
    assert len(np.unique(keys)) == len({*zip(left.tolist(), right.tolist())})
    assert 2 * len(lm._packed_keys(np.unique(keys), 1)) < len(lm._packed_keys(np.unique(hashes), 1))
    assert (lm._joined(left, right, (1 << 40, 1 << 30), shift) == hashes).all()


def test_suffix_tree_leaves_no_table(spark, docs_of):
    before = {t.name for t in spark.catalog.listTables()}
    assert suffix_tree_lm.score(docs_of([(1, "a b"), (2, None)]).withColumn("held", F.lit(False)), "held").count() == 2
    assert {t.name for t in spark.catalog.listTables()} == before
