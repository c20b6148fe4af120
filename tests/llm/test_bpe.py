"""The byte-level BPE coder against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import byte_bpe
from docloom.llm.queries import QUERIES
from tests.llm.conftest import sentence

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe(PATH)


def test_random_texts_equal_the_library(library, coder):
    rng = random.Random(3)
    pools = [
        "ab  cd's 't12é\n\t .,!", "'sStTrevemlld ", "<|endoftext|> x", "\x1c\x1d\x1f\x85\xa0 　 a1",
        "éüñßıİſΩж中あ한ª²½Ⅷ़्️😀🏽‍", "".join(map(chr, range(0x20, 0x7F))),
    ]
    everything = [c for c in range(1, 0x32400) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randrange(0, 40))) for _ in range(15_000)]
    texts += ["".join(map(chr, rng.choices(everything, k=12))) for _ in range(5_000)]
    texts += ["<|endoftext|>" * 3 + " a<|endoftext|><|endof", "", " ", "\n\n  x"]
    for text in texts:
        ids = coder.ids(text).tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character_between_letters(library, coder):
    """Classes of all characters, other Unicode versions included."""
    known = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x33500 or c > 0xE0000) and c < 0xE0200]
    for lo in range(0, len(known), 500):
        text = "".join(f"a{chr(c)}1 {chr(c)}!" for c in known[lo : lo + 500])
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(known[lo])


def test_broken_id_sequences_decode_like_the_library(library, coder):
    rng = random.Random(5)
    for _ in range(3_000):
        ids = [rng.choice(coder.byte_ids[0x80:] if rng.random() < 0.7 else range(50_257)) for _ in range(12)]
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_one_very_long_unit(library, coder):
    text = "".join(random.Random(7).choices("abcdefg", k=300_000))
    assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not any(len(unit) > byte_bpe.CACHE_CHARS for unit in coder)


def test_other_tokenizer_files_are_refused(tmp_path):
    spec = json.load(open(PATH))
    for key, value in [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("decoder", None)]:
        path = tmp_path / f"{key}.json"
        path.write_text(json.dumps(spec | {key: value}))
        with pytest.raises(ValueError, match=key):
            byte_bpe.ByteBpe(str(path))
    with pytest.raises(ValueError, match="not supported"):
        byte_bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_rows(spark, docs_of, library):
    long = sentence(1, 200_000)
    rows = [(1, None), (2, ""), (3, "same text"), (3, "same text"), (4, long), (None, "<|endoftext|>é")]
    docs = docs_of(rows).withColumn("n_tokens", F.lit("kept"))
    got = byte_bpe.encode(docs, PATH).collect()
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in got) == want
    assert {r["n_tokens"] for r in got} == {"kept"}
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, decoded=False), PATH)
    assert sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in back.collect()) == want
    assert byte_bpe.encode(docs.limit(0), PATH).count() == 0
    for clash in ("ids", "decoded"):
        with pytest.raises(ValueError, match=clash):
            byte_bpe.encode(docs.withColumn(clash, F.lit(1)), PATH)


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op13_queue_byte_bpe"](spark, folder).collect()
    assert len(got) == len(docs)

    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == digest(",".join(map(str, ids)))
        assert r["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))
