import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.operators import pii


def report(spark, texts, **options):
    options.setdefault("include_text", True)
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, text STRING")
    rows = pii.with_pii(df, **options).orderBy("i").collect()
    return [r["pii"] for r in rows]


def found(p):
    return [(d["category"], d["text"], d["start"], d["end"]) for d in p["detections"]]


@pytest.mark.parametrize(
    "text,hits,redacted",
    [
        ('pwd: "hunter2" end', [("password", "hunter2", 6, 13)], 'pwd: "[REDACTED_PASSWORD]" end'),
        ("api_key = abc", [], "api_key = abc"),
        ("x SK-" + "a1" * 16, [("api_key", "SK-" + "a1" * 16, 2, 37)], "x [REDACTED_API_KEY]"),
        ("id 123456789 x", [("ssn", "123456789", 3, 12)], "id [REDACTED_SSN] x"),
        ("286-555-5136", [("phone", "286-555-5136", 0, 12)], "[REDACTED_PHONE]"),
        ("call +1 (286) 555-5136", [("phone", "1 (286) 555-5136", 6, 22)], "call +[REDACTED_PHONE]"),
        ("at 12 Main Street.", [("address", "12 Main Street", 3, 17)], "at [REDACTED_ADDRESS]."),
        ("12 Street", [], "12 Street"),
        ("é123-45-6789", [], "é123-45-6789"),
        ("plain", [], "plain"),
        ("", [], ""),
        ("😀 pass=x1 y", [("password", "x1", 7, 9)], "😀 pass=[REDACTED_PASSWORD] y"),
        ("4111111111111111", [("credit_card", "4111111111111111", 0, 16)], "[REDACTED_CREDIT_CARD]"),
        ("secret-key: '" + "Z" * 20 + "'", [("api_key", "Z" * 20, 13, 33)],
         "secret-key: '[REDACTED_API_KEY]'"),
        ("AIza" + "b" * 35, [("api_key", "AIza" + "b" * 35, 0, 39)], "[REDACTED_API_KEY]"),
        ("a.b@c.co|m!", [("email", "a.b@c.co|m", 0, 10)], "[REDACTED_EMAIL]!"),
    ],
)
def test_single_cases(spark, text, hits, redacted):
    got = report(spark, [text])[0]
    assert found(got) == hits
    assert got["redacted_content"] == redacted
    assert got["has_pii"] == bool(hits)
    assert got["categories_found"] == sorted({h[0] for h in hits})
    assert all(d["confidence"] == 0.8 and d["source"] == "regex" for d in got["detections"])


def test_overlap_union_and_splice(spark):
    key = "sk-" + "ab" * 20
    text = f"pass: {key} tail"
    union = report(spark, [text])[0]
    assert union["redacted_content"] == "pass: [REDACTED_PASSWORD] tail"
    # The same span twice is one detection, but both categories were found.
    assert found(union) == [("password", key, 6, 49)]
    assert union["categories_found"] == ["api_key", "password"]
    nested = "ssn 123-45-6789 Elm St"
    assert report(spark, [nested])[0]["redacted_content"] == "ssn [REDACTED_SSN]"
    splice = report(spark, [nested], overlap="splice")[0]["redacted_content"]
    # Later span first, then the earlier one at its original offsets.
    later = nested[:11] + "[REDACTED_ADDRESS]"
    assert splice == later[:4] + "[REDACTED_SSN]" + later[15:]


def test_options(spark):
    text = "pwd=a1 mail x@y.org"
    only = report(spark, [text], categories=["email"])[0]
    assert only["categories_found"] == ["email"] and only["redacted_content"] == "pwd=a1 mail [REDACTED_EMAIL]"
    assert report(spark, [text], categories=[])[0]["categories_found"] == ["email", "password"]
    off = report(spark, [text], settings=Settings(pii_enabled=False))[0]
    assert (off["has_pii"], off["categories_found"], off["detections"]) == (False, [], [])
    plain = report(spark, [text], include_text=False, redact=False)[0]
    assert plain["redacted_content"] is None and plain["detections"][0]["text"] is None
    with pytest.raises(ValueError):
        pii.pii_report(F.col("text"), categories=["name"])
    with pytest.raises(ValueError):
        pii.pii_report(F.col("text"), overlap="other")


def test_categories_per_row_and_request(spark):
    text = "pwd=a1 id 286-55-5136 mail x@y.org"
    df = spark.createDataFrame(
        [(0, text, ["email"]), (1, text, []), (2, text, None), (3, text, ["ssn", "password"])],
        "i INT, text STRING, wanted ARRAY<STRING>",
    )
    rows = pii.with_pii(df, row_categories=F.col("wanted")).orderBy("i").collect()
    assert [r["pii"]["categories_found"] for r in rows] == [
        ["email"], ["email", "password", "ssn"], ["email", "password", "ssn"], ["password", "ssn"]
    ]
    assert [d["category"] for d in rows[3]["pii"]["detections"]] == ["ssn", "password"]
    asked = pii.redaction_request(df, "text").first()["pii"]
    assert asked["redacted_content"] == "pwd=[REDACTED_PASSWORD] id 286-55-5136 mail x@y.org"
    assert pii.redaction_request(df, "text", redact=False).first()["pii"]["redacted_content"] is None


WORDS = (
    "12 7 99999 100000 Main Elm Street St Ave Ct. road, pass pwd: password= 'x \"y api_key: "
    "secret-key= access_token: sk- pk- AIza k3yk3yk3yk3yk3yk3yk3 4111111111111111 378282246310005 "
    "123-45-6789 123 45 6789 123456789 a@b.co é@x.org x.y@z.museum, 286-555-5136 (286) 555.5136 "
    "+1-286-555-5136 2865555136     é ü_1 😀 ( ) - . , ; \n \t"
).split(" ")

# Values each rule must find whole: (category, text before, value, text after).
PLANTED = [
    ("password", "pwd: ", "hunter2", ""), ("password", "PASS = '", "s3cr3t", "'"),
    ("password", "password:", "qwerty!", ""), ("api_key", "api-key=", "k" * 24, ""),
    ("api_key", "secret_key: \"", "q7" * 12, "\""), ("api_key", "accesstoken=", "t_" * 15, ""),
    ("api_key", "", "sk-" + "b2" * 20, ""), ("api_key", "", "PK-" + "c3" * 16, ""),
    ("api_key", "", "AIza" + "d" * 35, ""), ("credit_card", "", "4111111111111111", ""),
    ("credit_card", "", "5500005555555559", ""), ("credit_card", "", "378282246310005", ""),
    ("ssn", "", "123-45-6789", ""), ("ssn", "", "123 45 6789", ""),
    ("email", "", "first.last+tag@mail.example.org", ""), ("email", "", "x_1@y.co", ""),
    ("phone", "", "286-555-5136", ""), ("phone", "", "(286) 555-5136", ""),
    ("phone", "", "155.555.5136", ""), ("address", "", "12 Main Street", ""),
    ("address", "", "99999 Old Mill Rd", ""),
]
FILLER = ["lorem", "ipsum", "dolor", "été", "naïve", "😀", "straße", "Elm", "well", "off"]


def test_planted_values_are_found_where_they_stand(spark):
    rng = random.Random(7)
    texts, wants = [], []
    for _ in range(600):
        text, want = "", []
        for category, before, value, after in rng.choices(PLANTED, k=rng.randint(0, 6)):
            text += " ".join(rng.choices(FILLER, k=rng.randint(1, 4))) + " | " + before
            # A leading bracket is no word boundary: the number starts behind it.
            skip = 1 if value.startswith("(") else 0
            want.append((category, value[skip:], len(text) + skip, len(text) + len(value)))
            text += value + after + " | "
        texts.append(text + rng.choice(FILLER))
        wants.append(want)
    for text, want, p in zip(texts, wants, report(spark, texts)):
        assert sorted(found(p), key=lambda d: d[2]) == want, text
        assert p["categories_found"] == sorted({w[0] for w in want})
        assert all(text[d["start"] : d["end"]] == d["text"] for d in p["detections"])


def test_neutral_texts_have_no_detections(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choices(FILLER, k=rng.randint(0, 60))) for _ in range(300)]
    assert all(not p["has_pii"] and p["redacted_content"] == t for t, p in zip(texts, report(spark, texts)))


def test_union_leaves_no_detected_text(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(500)]
    for text, p in zip(texts, report(spark, texts)):
        spans = sorted((d["start"], d["end"]) for d in p["detections"])
        covered = set()
        for a, b in spans:
            covered |= set(range(a, b))
        clean = "".join(c for i, c in enumerate(text) if i not in covered)
        assert re.sub(r"\[REDACTED_[A-Z_]+\]", "", p["redacted_content"]) == clean


def test_long_texts_stay_fast(spark):
    start = time.time()
    numbers = " ".join(str(i) for i in range(60_000))
    address = "7 " + "word " * 200_000 + "Street"
    mails = "x@y.org, " * 60_000
    got = report(spark, [numbers, numbers + " Elm Street", address, mails], include_text=False)
    assert [len(p["detections"]) > 0 for p in got[1:]] == [True, True, True]
    assert len(got[3]["detections"]) == 60_000
    assert got[3]["redacted_content"] == "[REDACTED_EMAIL], " * 60_000
    assert got[2]["redacted_content"] == "[REDACTED_ADDRESS]"
    assert time.time() - start < 90


def test_extractions(spark):
    docs = spark.createDataFrame(
        [("d1", "ann a@b.org and a@b.org, code 77"), ("d2", "nothing")], "document_id STRING, text STRING"
    )
    rows = [
        ("d1", "EMAIL", "a@b.org"), ("d1", "email", "a@b.org"), ("d1", "company", "ann"),
        ("d1", "Secret", "77"), ("d1", "password", "77"), ("d1", "phone", "555"), ("d2", "address", "nothing"), ("d9", "ssn", "x"),
    ]
    extractions = spark.createDataFrame(
        rows, "document_id STRING, extraction_class STRING, extraction_text STRING"
    )
    got = pii.with_pii_and_extractions(docs, extractions, include_text=True).orderBy("document_id")
    first, second = [r["pii"] for r in got.collect()]
    # The model hit comes first and keeps its position; the later repeat is the regex's.
    assert [(d["source"], d["category"], d["start"]) for d in first["detections"]] == [
        ("langextract", "password", 30), ("langextract", "email", 4), ("regex", "email", 16)
    ]
    # One position, two categories: the first is shown, both were found.
    assert first["categories_found"] == ["api_key", "email", "password"]
    assert first["redacted_content"] == "ann [REDACTED_EMAIL] and [REDACTED_EMAIL], code [REDACTED_PASSWORD]"
    assert second["redacted_content"] == "[REDACTED_ADDRESS]"
    some = pii.locate_extractions(docs, extractions, ["email"]).collect()
    assert [(r["category"], r["start"], r["confidence"]) for r in some] == [("email", 4, 0.9)]


def test_redacting_twice_changes_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    once = pii.with_pii(docs).select("doc_id", F.col("pii.redacted_content").alias("text"))
    twice = pii.with_pii(once).select("doc_id", F.col("pii.redacted_content").alias("again"), "text")
    assert twice.where("text <> again").count() == 0
