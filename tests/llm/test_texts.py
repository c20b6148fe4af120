"""Encoders, token files, language, quality."""

import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docloom.llm import base, language, pieces, quality, token_files
from docloom.session import work_path
from .conftest import sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "  a   b  ", "\n\n", "a\nb c\t d", "é è ü ß ñ",
    "▁x ▁ y", "emoji 😀 x", "MiXed CASE It's don't we'll 12a3 a.b,c ...", "é J̌ H̱ İ Σας ﬁ K",
    "<|endoftext|> x <|ENDOFTEXT|>", "x y z　w", "\x00\x01 \x7f", "日本語 テキスト", "Ti " * 500,
    sentence(3, 3000),
]


def test_pieces_equal_the_library_and_spans_tile_the_text(docs_of):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = docs_of(list(enumerate(TEXTS))).withColumn("extra", F.lit(1))
    for row in pieces.encode(docs, MODEL).collect():
        text = row.text or ""
        assert row.ids == library.encode(text)
        assert row.decoded == library.decode(row.ids)
        raw = text.encode()
        if row.ids and "▁" not in text:
            assert row.starts[0] == 0 and row.ends[-1] == len(raw)
            assert row.starts[1:] == row.ends[:-1]
        for i, a, b in zip(row.ids, row.starts, row.ends):
            if not library.is_byte(i) and "▁" not in text:
                assert raw[a:b].decode() in library.id_to_piece(i).replace("▁", " ")
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(docs.withColumn("ids", F.lit(1)), MODEL)


def test_character_map_takes_the_longest_prefix():
    # A hand-made trie for "a" -> "x" and "ab" -> "yz": node numbers are xor-ed with labels.
    units = np.zeros(2048, np.uint32)
    results = b"x\0yz\0"

    def node(label, offset, leaf):
        return np.uint32(offset << 10 | (256 if leaf else 0) | label)

    units[0] = 512 << 10 & 0xFFFFFFFF
    at_a = 512 ^ 97
    units[at_a] = node(97, at_a ^ 256, True)  # children live at 256
    units[256] = np.uint32(1 << 31 | 0)
    at_b = 256 ^ 98
    units[at_b] = node(98, at_b ^ 320, True)
    units[320] = np.uint32(1 << 31 | 2)
    blob = np.uint32(units.nbytes).tobytes() + units.tobytes() + results
    known = pieces.CharacterMap(blob)
    assert known.longest(b"abc", 0) == (2, b"yz")
    assert known.longest(b"ac", 0) == (1, b"x")
    out, origin = known.normalise("aébab".encode())
    assert out == "xébyz".encode()
    assert origin.tolist() == [0, 1, 1, 3, 4, 4, 6]


def test_token_files_round_trip(spark, docs_of):
    library = Tokenizer.from_file(WORDS)
    path = work_path(spark, "files")
    token_files.write(docs_of(list(enumerate(TEXTS))), path, WORDS, end=2)
    at = 0
    for row in token_files.read(spark, path).orderBy("doc_id").collect():
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (row.ids, row.start, row.n_tokens) == (ids, at, len(ids))
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = work_path(spark, "files")
    token_files.write(docs_of([]), empty, WORDS, end=2)
    assert token_files.read(spark, empty).count() == 0


def test_blocks_decode_alone_and_damage_is_found():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.01, 3 * token_files.BLOCK // 2), 5000).astype(np.uint32)
    symbols, counts = np.unique(ids, return_counts=True)
    table = token_files.Frequencies(*token_files.Frequencies.of_counts(symbols.astype(np.int64), counts.astype(float)))
    payload, marks = token_files.encode_segment(ids, table)
    assert (token_files.decode_segment(payload, marks, table) == ids).all()
    last = token_files.decode_segment(payload[marks[1]["offset"] :], [{**marks[1], "offset": 0}], table)
    assert (last == ids[token_files.BLOCK :]).all()
    hurt = bytearray(payload)
    hurt[len(hurt) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.decode_segment(bytes(hurt), marks, table)


def test_language(docs_of):
    kinds = {"aa": "the thing that ", "bb": "der die das und ", "cc": "que los las para "}
    rows = [(i, kinds[k] * (5 + i % 7), k) for i, k in enumerate(sorted(kinds) * 20)]
    model = language.fit(docs_of(rows))
    found = language.identify(docs_of([(1, None), (2, ""), (3, "12 34"), (4, "die und das"), (5, "the that")]), model)
    assert [r.lang_pred for r in found.orderBy("doc_id").collect()] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert language.fit(docs_of([])) is None
    assert {r.lang_pred for r in language.identify(docs_of(rows), None).collect()} == {"und"}
    one = language.fit(docs_of([(1, "only one", "xx")]))
    assert language.identify(docs_of([(1, "some text")]), one).first().lang_pred == "xx"


@pytest.mark.parametrize("n", [2, 3, 5, 9, 40])
def test_codewords_differ(n):
    code = language.codewords(n)
    apart = (code[:, None] != code[None]).sum(axis=2)
    assert apart[~np.eye(n, dtype=bool)].min() >= min(1 << max(n - 2, 0), 8)


def test_quality(spark, docs_of):
    good = [(i, sentence(i, 60 + i) + ".") for i in range(120)]
    bad = [(1000 + i, "spam!! " * (40 + i)) for i in range(120)]
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (77777, 0)],
        "doc_id long, quality int",
    )
    model = quality.fit(docs_of(good + bad), labels)
    assert model.rules
    new = docs_of([(1, sentence(991, 80) + "."), (2, "spam!! " * 70), (3, None), (4, "")])
    scores = {r.doc_id: r._score for r in quality.score(new, model).collect()}
    assert scores[1] > 0.5 > scores[2] and scores[3] == scores[4]
    assert quality.reject(new, model).columns == new.columns
    assert quality.fit(docs_of(good), labels.limit(0)).rules == ()


def test_word_ids_equal_the_library_for_random_texts():
    import random

    library, known = Tokenizer.from_file(WORDS), token_files.WordTokenizer(WORDS)
    assert known.by_unit
    rng = random.Random(11)
    pools = ["ab \x1c\x1d\x1e\x1f\x85 c'd1\n\t", "".join(map(chr, range(1, 128))), "éÉß İıſ 'sT<|endoftext|>", "a\x1cb \x1f "]
    for text in ["a\x1cb \x1f", *("".join(rng.choices(rng.choice(pools), k=rng.randrange(30))) for _ in range(20_000))]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.ids(text), "<u4").tolist() == want, repr(text)


def test_units_outlive_a_full_cache_and_marks_need_no_library(monkeypatch):
    import random

    library, known = Tokenizer.from_file(WORDS), token_files.WordTokenizer(WORDS)
    merged, whole = [], []
    plain, encode = known.merged, known.library.encode
    monkeypatch.setattr(token_files, "CACHE_UNITS", 50)
    known.merged = lambda word: (merged.append(word), plain(word))[1]
    known.library = SimpleNamespace(encode=lambda text, **kw: (whole.append(text), encode(text, **kw))[1])
    for i in range(300):
        text = f"always STÜCK!! schön*** w{i}x{i}"
        assert np.frombuffer(known.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert merged.count("always") == 1 and merged.count("stück") == 1 and not whole
    rng = random.Random(12)
    pools = ["éÉñÜß ab'.,!*#$%&_-<|>\"", "Ünder ſtÿŸ's \u0338<=>!?\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(pools), k=rng.randrange(24)))
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(known.ids(text), "<u4").tolist() == want, repr(text)


def test_other_word_tokenizers_go_to_the_library():
    other = public_tokenizers.path("byte_bpe_50k.json")
    known, library = token_files.WordTokenizer(other), Tokenizer.from_file(other)
    assert not known.by_unit
    for text in ("", "A b  c\n", "It's <|endoftext|> é"):
        assert np.frombuffer(known.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files_of_repeated_rows_and_missing_ids(spark, docs_of):
    rows = [(None, "no id"), (None, "no id"), (None, None), (7, "same"), (7, "same"), (7, "other"), (1, sentence(5, 120_000))]
    path = work_path(spark, "files")
    docs = docs_of(rows).withColumn("_tie", F.lit(1)).withColumn("n_tokens", F.lit("x"))
    token_files.write(docs, path, WORDS, end=2)
    library = Tokenizer.from_file(WORDS)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    got = token_files.read(spark, path).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0] + [r.n_tokens for r in ordered])[:-1].tolist()
    assert [r.doc_id for r in ordered] == [None] * 3 + [1] + [7] * 3


def test_spans_of_texts_with_a_literal_mark_equal_the_library():
    import random

    known = pieces.encoder(MODEL)
    rng = random.Random(4)
    texts = ["▁", "▁▁ ▁", " ▁a", "a▁ b"] + ["".join(rng.choices("▁▁ abcé\n日", k=rng.randrange(1, 25))) for _ in range(4_000)]
    for text in texts:
        ids = known.ids(text)
        starts, ends = known.spans(text, ids)
        raw = text.encode()
        assert starts[0] == 0 and ends[-1] == len(raw) and (starts[1:] == ends[:-1]).all(), repr(text)
        proto = known.library.encode(text, return_type="proto")
        if not any(known.library.is_byte(int(i)) for i in ids):
            own = [(p.begin, p.end) for p in proto.pieces]
            assert list(zip(starts.tolist(), ends.tolist())) == own, repr(text)


def test_columns_in_the_way_are_named(docs_of):
    from docloom.llm import near_copies, repeats

    docs = docs_of([(1, "a text"), (2, "another")])
    model = language.fit(docs_of([(1, "only one", "xx")]))
    constant = quality.RuleEnsemble(0.0, ())
    cases = [
        (lambda d: language.identify(d, model), ("lang_pred", "score", "_lettered")),
        (lambda d: quality.score(d, constant), ("_score", "_stats")),
        (lambda d: quality.reject(d, constant), ("_stats", "_row")),
        (near_copies.drop_copies, ("_id", "_text_hash")),
        (repeats.remove, ("_id", "_no_id", "spans", "word_spans")),
    ]
    for operator, names in cases:
        for name in names:
            with pytest.raises(ValueError, match=name):
                operator(docs.withColumn(name, F.lit(1)))


def test_a_task_gives_its_free_memory_back():
    held = []

    def task(batches):
        for size in batches:
            # Freed below one that stays: the library keeps all of it.
            many = [bytearray(64_000) for _ in range(size)]
            held.append(many[-1])
            del many
            yield size

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    before = resident()
    assert list(base.tidy(task)(iter([3000]))) == [3000]
    assert resident() - before < 40_000_000


@pytest.mark.parametrize("end", [b"", b"\2\0\0\0"])
def test_units_of_many_texts_are_encoded_at_once(end):
    import random

    import pyarrow as pa

    library, known = Tokenizer.from_file(WORDS), token_files.WordTokenizer(WORDS)
    rng = random.Random(4)
    marks = ["", ".", "...", "!?", "'s", "'", "**", "<|", "|>", "$1", "-", "_"]
    letters = ["word", "Word", "ÉCOLE", "straße", "İl", "ŉa", "ſ", "ǅ", "µ", "ª", "é", "Ÿ", "K", "日本", "x9", "9", "\x1c", "×", "don't", ""]
    texts = ["".join(rng.choice(letters) + rng.choice(marks) + rng.choice([" ", "\n", "  ", "", "\r", "\t", " "]) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "<|endoftext|>", "A <|ENDOFTEXT|> b", "Aa Bb. CC... dd"]
    looked = []
    known.encoded = lambda unit, encoded=known.encoded: looked.append(unit) or encoded(unit)
    for own in (texts[:2000], texts[2000:]):
        ids, counts = known.ids_of_all(pa.array(own), end)
        want = [library.encode(t, add_special_tokens=False).ids + [2] * bool(end) for t in own]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # Words with other marks or letter cases are no units of their own.
    assert not {"Aa", "Bb.", "CC..."} & {*looked} and {"aa", "bb", "cc", "dd"} <= {*looked}
