"""Piece encoding of long texts and of texts without blanks, and its query on odd texts."""

import hashlib
import random

import public_tokenizers
import pytest

from docloom.llm import pieces
from docloom.llm.queries import op6_piece_offsets
from .conftest import sentence

MODEL = public_tokenizers.path("piece_bpe_32k.model")


class Watched:
    """A library that notes the longest text or list it was given."""

    def __init__(self, library):
        self.library, self.most = library, 0

    def __getattr__(self, name):
        return getattr(self.library, name)

    def encode(self, text):
        self.most = max(self.most, len(text))
        return self.library.encode(text)

    def decode(self, ids):
        self.most = max(self.most, len(ids))
        return self.library.decode(ids)


@pytest.mark.parametrize("change", [
    str, lambda t: t.replace(" ", "\n"), lambda t: t.replace(" w", "\n▁"), lambda t: t.replace(" w", "漢é"),
])
def test_no_call_grows_with_a_text(change):
    known = pieces.Encoder(MODEL)
    text = change(sentence(5, 400_000))
    want = known.library.encode(text)
    known.library = Watched(known.library)
    ids = known.ids(text)
    assert ids.tolist() == want
    assert known.decode(ids) == known.library.library.decode(want)
    starts, ends = known.spans(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text.encode()) and (starts[1:] == ends[:-1]).all()
    assert known.library.most < 300_000


def test_units_without_blanks_are_not_gathered():
    known = pieces.Encoder(MODEL)
    for n in range(300):
        text = sentence(n, 1_500).replace(" ", "\n")
        assert known.ids(text).tolist() == known.library.encode(text)
    assert sum(map(len, known.cache)) < 100_000


def test_parts_give_the_ids_of_the_whole_text(monkeypatch):
    known = pieces.Encoder(MODEL)
    rng = random.Random(11)
    signs = ["a", "b", " ", "  ", "\n", "▁", "é", "漢", "😀", "\0", "<s>", "<0x0A>", "the", "ing", "12", "..."]
    for _ in range(20_000):
        for name in ("PART_CHARS", "PART_IDS", "CACHE_CHARS"):
            monkeypatch.setattr(pieces, name, rng.randint(1, 9))
        text = "".join(rng.choices(signs, k=rng.randrange(25)))
        ids = known.ids(text)
        assert ids.tolist() == known.library.encode(text), repr(text)
        assert known.decode(ids) == known.library.decode(ids.tolist()), repr(text)


def test_op6_takes_empty_and_null_texts(spark, docs_of, tmp_path):
    texts = [None, "", "a", " ", "a b", sentence(2, 400), "日本語"]
    docs_of(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    found = op6_piece_offsets(spark, str(tmp_path))
    library = pieces.encoder(MODEL).library
    rows = found.collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for row in rows:
        ids = library.encode(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids) and row.spans_reach_end
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op6_makes_no_string_for_each_id(spark, folder):
    assert "array<string>" not in op6_piece_offsets(spark, folder)._jdf.queryExecution().toString()
