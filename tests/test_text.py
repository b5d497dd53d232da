import html

from pyspark.sql import functions as F

from conftest import rows
from tickerloom.constants import BOILERPLATE_PATTERNS
from tickerloom.functions import text as tx


def one(spark, value, function):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(function(F.col("t"))).first()[0]


def test_collapse_spaces(spark):
    cases = ["a  b", " a\t\tb\r\nc ", "a  b", "a b", "　a b\x1cc\x85", " ", "", None, "é  è\n", "a \tb", "a\t b"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i")
    assert [t for (t,) in rows(df, tx.collapse_spaces(F.col("t")))] == [" ".join((c or "").split()) for c in cases]


def test_strip_boilerplate_keeps_order_and_cuts_to_the_end(spark):
    texts = [
        "News body.\nsign UP for free newsletters now\nmore",
        "Cookie settings stay because the closing word is missing",
        "start Cookie banner. Notice and the rest",
        "x © 2024 Some Paper. All rights reserved. tail",
        "Privacy policy at position 0",
        "a    b   c   \n",
        "keep *Average returns of all",
        "Sign up for ſree", "ſign up for free newsletters x",
        None, "", "plain é text", "y" * 3001,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    found = [t for (t,) in rows(df, tx.strip_boilerplate(F.col("t")))]
    assert found == [
        "News body.",
        "Cookie settings stay because the closing word is missing",
        "start", "x", "", "a\n\nb\n\nc", "keep", "Sign up for ſree", "", "", "", "plain é text", "y" * 3001,
    ]
    assert len(one(spark, "y" * 3001, lambda c: tx.article_head(tx.strip_boilerplate(c), 3000))) == 3000
    assert len(one(spark, "y" * 3001, tx.article_head)) == 3001


def test_boilerplate_guard_changes_nothing(spark):
    """Texts made of pattern pieces: with and without the head test."""
    pieces = ["cookie ", "Notice", " x ", "© 2020 ", "all rights reserved", "\n\n\n", "Privacy policy", "*average returns"]
    texts = [a + b + c for a in pieces for b in pieces for c in pieces]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    no_head = [*BOILERPLATE_PATTERNS, "(?:never there)"]  # no fixed beginning, so no guard
    assert tx.literal_head(no_head[-1]) == ""
    same = tx.strip_boilerplate(F.col("t")).eqNullSafe(tx.strip_boilerplate(F.col("t"), no_head))
    assert df.where(~same).count() == 0


def test_literal_head():
    assert tx.literal_head(r"Cookie.*Notice.*") == "cookie"
    assert tx.literal_head(r"\*Average returns.*") == "*average returns"
    assert tx.literal_head(r"© \d{4}.*") == "© "
    assert tx.literal_head(r"abc?d") == "ab"
    assert tx.literal_head(r"abc+d") == "abc"
    assert tx.literal_head(r"abc|def") == ""


def test_noise_and_blocked(spark):
    df = spark.createDataFrame([("Ray ID: 3",), ("array identity",), (None,), ("CLOUDFLAREd",), ("You ARE using automation",)], "t string")
    c = F.col("t")
    assert rows(df, tx.has_noise(c), tx.is_noise(c), tx.is_blocked(c)) == [
        (True, True, False), (True, True, False), (False, True, False), (True, True, True), (False, False, True),
    ]


def test_junk_title(spark):
    df = spark.createDataFrame([(" url ",), ("\t ",), (None,), ("url x",)], "t string")
    assert [x for (x,) in rows(df, tx.is_junk_title(F.col("t")))] == [True, True, True, False]


def test_classifier_input(spark):
    df = spark.createDataFrame([("T", "é" * 801, False), ("T", "body", True)], "t string, c string, only boolean")
    assert [p for (p,) in rows(df, tx.classifier_input(F.col("t"), F.col("c"), F.col("only"), 800))] == [
        "제목: T\n\n본문:\n" + "é" * 800, "제목: T",
    ]
    whole = rows(df, tx.classifier_input(F.col("t"), F.col("c"), F.col("only")))
    assert whole[0][0].endswith("é" * 801)


def test_escape_html(spark):
    text = """<a href="x">it's & done</a>"""
    assert one(spark, text, tx.escape_html) == html.escape(text)


def test_markdown_to_html(spark):
    cases = {
        "## Head\ntext": "Head<br>text",
        "a\n---\nb": "a<br><br>b",
        " [핵심 요약] \nx": "<br>x",
        "***bi*** and **b** and *i*": "<strong><em>bi</em></strong> and <strong>b</strong> and <em>i</em>",
        "* one\n* two": "• one<br>• two",
        "a\n\n\n\nb": "a<br><br>b",
        "<b>it's</b>": "&lt;b&gt;it&x27;s&lt;/b&gt;",
        "x [kept] y": "x [kept] y",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    found = dict(rows(df, "t", tx.markdown_to_html(F.col("t"))))
    assert found == cases


LONG = "w" * 51


def test_unescape_html(spark):
    cases = [
        "it&#39;s &#x27;x&#X27; &#8217; &#128200;&#x1F4C8;", "&amp;lt; &lt;b&gt; &nbsp;|&copy;", "plain & bare &# &#; &#x;",
        "&#39;", "&#39;&#39;", "", "tail &#65;", "&hellip;&mdash;", "&#1234567890123456789012;|&#55296;|&#0;",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").orderBy("i")
    assert [t for (t,) in rows(df, tx.unescape_html(F.col("t")))] == [html.unescape(c) for c in cases]


def test_paragraphs(spark):
    cases = {
        f"<p>{LONG}</p><p>{'s' * 50}</p>": [LONG],
        f"<p>{LONG}<p class='x'>{LONG}2": [LONG, LONG + "2"],
        f"<script>var t='<p>{LONG}</p>'</script><p>a{LONG}</p>": ["a" + LONG],
        f"<!-- <p>{LONG}</p> --><p>b{LONG}</p>": ["b" + LONG],
        f"<P>x <b>bold</b> <a href='#'>link</a>{LONG}</P>": ["x bold link" + LONG],
        f"<p>{LONG}<div>outside</div>": [LONG],
        f"<p>{LONG}</article>outside": [LONG],
        f"<pre>{LONG}</pre><param>{LONG}": [],
        f"<p>  a &amp; b &lt;c&gt; {LONG} </p>": [f"a & b <c> {LONG}"],
        f"<p>{' ' * 60}</p><p>{LONG}</p>": ["", LONG],
        "no paragraphs": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(rows(df, "t", tx.paragraphs(F.col("t")))) == cases
    assert one(spark, f"<p>{LONG}</p><p>{LONG}</p>", tx.page_text) == f"{LONG} {LONG}"
    assert one(spark, None, tx.page_text) is None


def test_title_of(spark):
    assert one(spark, "first\nsecond", tx.title_of) == "first"
