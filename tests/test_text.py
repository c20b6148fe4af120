import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import html as hx
from docloom.functions import text as tx
from docloom.functions import vectors as fv
from docloom.functions.arrays import running


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("out")).first()["out"]


def many(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    return [r["o"] for r in df.select("i", column.alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name,kind",
    [
        ("a.HTM", "html"), ("b.tar.gz", "txt"), ("noext", "txt"), (".pdf", "txt"),
        ("c.webp", "image"), ("dir.md/x", "txt"), ("x/y.Md", "md"), ("end.", "txt"),
        ("a.b.docx", "docx"), ("..pdf", "pdf"),
    ],
)
def test_file_type(spark, name, kind):
    assert one(spark, tx.file_type(F.col("n")), n=name) == kind


def test_document_id_is_content_and_name(spark):
    want = hashlib.sha256("zé".encode() + "f.txt".encode()).hexdigest()[:16]
    assert one(spark, tx.document_id(F.encode("c", "UTF-8"), F.col("n")), c="zé", n="f.txt") == want
    assert one(spark, tx.document_id(F.encode("c", "UTF-8"), F.col("n")), c="zé", n="g.txt") != want


SPACED = st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x1f\x85\xa0  　é😀", max_size=12)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(SPACED, min_size=20, max_size=60))
def test_strip_and_word_count_follow_unicode_space(spark, texts):
    assert many(spark, tx.strip(F.col("t")), texts) == [t.strip() for t in texts]
    assert many(spark, tx.word_count(F.col("t")), texts) == [len(t.split()) for t in texts]


def test_strip_long_inner_run(spark):
    text = "a" + " " * 300_000 + "b "
    assert one(spark, F.length(tx.strip(F.col("t"))), t=text) == 300_002


def test_running_total_across_blocks(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("v"))
    got = df.select(running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("r")).first()["r"]
    assert got == [sum(range(1, i)) for i in range(1, 1001)]
    empty = spark.range(1).select(F.array().cast("array<int>").alias("v"))
    assert empty.select(running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("r")).first()["r"] == []


def test_html_to_text(spark):
    page = (
        "<html><head><title> T &amp; U </title><style>p{}</style></head><body><nav>skip</nav>"
        "<!-- gone --><script>var t='</p>'</script><h2 class='x'>Head</h2><p>One<br>two &lt;b&gt; "
        "&#233;&#x1F600;&#0; &amp;lt;</p><ul><li>a</li><li>b</li></ul><pre>x</pre><header>h</header>"
        "</body></html>"
    )
    text = one(spark, hx.html_to_text(F.col("h")), h=page)
    assert text == "## Head\n\nOne\ntwo <b> é😀&#0; &lt;\n\na\n\nb\n\nx\n\nh"
    assert one(spark, hx.html_title(F.col("h")), h=page) == "T & U"
    assert one(spark, hx.tag_count(F.col("h"), "li"), h=page) == 2
    assert one(spark, hx.tag_count(F.col("h"), "p"), h=page) == 1


def test_unclosed_parts(spark):
    def text(page):
        return one(spark, hx.html_to_text(F.col("h")), h=page)

    assert text("<p>a</p><script>x<p>b") == "a" and text("a<!-- b") == "a"
    assert text("<nav>a<p>b") == "a\n\nb"
    many = "<p>x</p>" + "<!-- <script>" * 20_000
    assert text(many) == "x"


def test_cosine_and_normalize(spark):
    df = spark.createDataFrame(
        [([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0])],
        "a ARRAY<FLOAT>, b ARRAY<FLOAT>",
    )
    rows = df.select(
        fv.cosine_similarity(F.col("a"), F.col("b")).alias("c"),
        fv.cosine_similarity(F.col("a"), F.col("a")).alias("self"),
        fv.l2_normalize(F.col("a")).alias("n"),
    ).collect()
    assert [round(r["c"], 9) for r in rows] == [0.96, 0.0, -1.0]
    assert [round(r["self"], 9) for r in rows] == [1.0, 0.0, 1.0]
    assert [round(x, 6) for x in rows[0]["n"]] == [0.6, 0.8] and rows[1]["n"] == [0.0, 0.0]


def test_named_and_numeric_entities(spark):
    from docloom.functions.html import html_title, html_to_text

    page = "<title>Tom&#39;s Caf&eacute;</title><p>Caf&eacute; &rsquo;x&rsquo; &amp;eacute; &nope; a&b &Auml;</p>"
    df = spark.createDataFrame([(page,)], "html STRING")
    row = df.select(html_to_text(F.col("html")).alias("text"), html_title(F.col("html")).alias("title")).first()
    assert row["title"] == "Tom's Café"
    assert "Café ’x’ &eacute; &nope; a&b Ä" in row["text"]


def test_references_are_decoded_once(spark):
    cases = {
        "&#38;lt;": "&lt;", "&amp;lt;": "&lt;", "&#x26;#60;": "&#60;", "&amp;#60;": "&#60;", "a&#60;b&lt;c": "a<b<c",
        "&#0; &#xD800; &#;": "&#0; &#xD800; &#;", "&nosuch; & &&amp;": "&nosuch; & &&", "&#233;&eacute;": "éé",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t STRING")
    got = {r["t"]: r["x"] for r in df.select("t", hx.html_to_text(F.col("t")).alias("x")).collect()}
    assert got == cases
