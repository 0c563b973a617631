import random

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.dates import parse_published
from newsloom.functions.html import collapse_whitespace, html_to_text, paragraphs_to_text
from newsloom.operators.selection import prepare_for_models


def test_collapse_whitespace_splits_like_python(apply_to):
    texts = [f"a{chr(c)}{chr(c)}b{chr(c)}" for c in range(1, 0x3101)] + ["", "  ", "a b", " a  b ", "\x1ca\x85"]
    assert apply_to(collapse_whitespace, texts) == [" ".join(t.split()) for t in texts]


def test_collapse_whitespace_is_idempotent(apply_to):
    once = apply_to(collapse_whitespace, [" a \n b\t\tc ", "x"])
    assert apply_to(collapse_whitespace, once) == once == ["a b c", "x"]


def test_strip_takes_all_white_space(apply_to):
    texts = ["  a b\x1d\n", "\xa0", ""]
    assert apply_to(tx.strip, texts) == [t.strip() for t in texts]


def test_title_case_equals_str_title(apply_to):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB ß'3é-ΣσςÑñ.\n|x語ǆ") for _ in range(40)) for _ in range(500)]
    texts += ["they're 3d AI", "ßa", ""]
    assert apply_to(tx.title_case, texts) == [t.title() for t in texts]
    assert apply_to(tx.title_case, ["they're 3d AI"]) == ["They'Re 3D Ai"]


def _cut(text, size):
    if len(text) < size:
        return text
    head = text[:size]
    if " " not in head:
        return "error"
    return head[: head.rindex(" ") + 1].strip() + "..."


def test_cut_short(apply_to):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n𝒳é") for _ in range(rng.randrange(0, 40))) for _ in range(400)]
    texts += ["a" * 20, "a" * 19 + " ", "abc def ghi jkl mno p", ""]
    assert apply_to(lambda c: tx.cut_short(c, 20, "error"), texts) == [_cut(t, 20) for t in texts]


@pytest.mark.parametrize(
    "url, bare",
    [
        ("HTTP://Ex.com/a;b/c;p=1?q=1#f", "http://Ex.com/a;b/c"),
        ("http://h;x", "http://h;x"),
        ("http://h?q", "http://h"),
        ("https://www.wsj.com/a/1?mod=rss", "https://www.wsj.com/a/1"),
        ("  https://h/\tp\nq#x", "https://h/pq"),
        ("/relative/path?x", "/relative/path"),
        ("", ""),
    ],
)
def test_strip_query(apply_to, url, bare):
    assert apply_to(tx.strip_query, [url]) == [bare]


def test_remove_special_characters(apply_to):
    assert apply_to(tx.remove_special_characters, ["a-b é 1!"]) == ["ab  1"]
    assert apply_to(lambda c: tx.remove_special_characters(c, remove_digits=True), ["a1 b2"]) == ["a b"]


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, ""),
        ("plain", "plain"),
        ("   ", " "),
        (" \n ", "\n"),
        ("a &amp; b &eacute; &foo; &#150; &#x41;", "a & b é &foo – A"),
        ("<p>a</p><p>b</p>", "ab"),
        ("a<!-- no -->b<script>x<y</script><style>p{}</style><template><b>t</b></template>c", "abc"),
        ("<ruby>x<rt>y</rt></ruby>", "x"),
        ("<!DOCTYPE html><b>x<br>y</b>", "xy"),
        ("<pre>  </pre>|<b>  </b>", "  | "),
        ("<p>a<![CDATA[ raw ]]></p>", "a raw "),
        ("1 < 2 & 3", "1 < 2 & 3"),
    ],
)
def test_html_to_text(apply_to, markup, text):
    assert apply_to(html_to_text, [markup]) == [text]


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, None),
        ("no <b>paragraph</b> &amp;", "no <b>paragraph</b> &amp;"),
        ("<p>a</p> x <p>b</p>", "a. b"),
        ("<div><p>a<p>b</div><P>c", "ab. b. c"),
        ("<script>'<p>no</p>'</script><p>yes</p>", "yes"),
        ("<p><b>a<br><p>b</p>c</p>", "abc. b"),
    ],
)
def test_paragraphs_to_text(apply_to, markup, text):
    assert apply_to(paragraphs_to_text, [markup]) == [text]


def test_short_texts_and_combined(spark):
    rows = [
        (1, " A &amp; <b>B</b> | site ", "one  two | three", "pub", "me"),
        (2, None, None, None, None),
        (3, "same", "same", "pub", None),
        (4, "x" * 1000, "y " * 6000, "pub", None),
        (5, "t", "tail |", "pub", None),
        (6, "<![what[x]]>", "<![what[x]]>", "pub", None),
    ]
    df = spark.createDataFrame(rows, "id int, title string, summary string, publication string, author string")
    got = {r["id"]: r for r in prepare_for_models(df).collect()}
    assert got[1]["title_short"] == "A & B"
    assert got[1]["summary_short"] == "one two "
    assert got[1]["has_bad_content"] is False
    pad, gap = " " * 16, " " * 12
    assert got[1]["combined"] == (
        f"News article from pub\n{pad}Title:  A &amp; <b>B</b> | site \n{pad}Summary: one  two | three\n{gap}\n{pad}Author: me"
    )
    assert got[2]["title_short"] == got[2]["summary_short"] == ""
    assert got[2]["combined"] == f"News article from None\n{pad}Title: None"
    assert got[3]["combined"] == f"News article from pub\n{pad}Title: same"
    assert got[4]["title_short"] == "Error processing title"
    assert got[4]["summary_short"] == ("y " * 5000).strip() + "..."
    assert got[5]["summary_short"] == "tail "
    assert got[6]["title_short"] == "Error processing title"
    assert got[6]["summary_short"] == "Error processing summary"


@pytest.mark.parametrize(
    "text, iso",
    [
        ("Wed, 31 Jan 2024 10:20:30 GMT", "2024-01-31 10:20:30"),
        ("Wed, 31 Jan 2024 10:20:30 +0100", "2024-01-31 09:20:30"),
        ("Wed, 31 Jan 2024 10:20:30 EST", "2024-01-31 15:20:30"),
        ("2024-01-31T10:20:30Z", "2024-01-31 10:20:30"),
        ("soon", None),
    ],
)
def test_parse_published(apply_to, text, iso):
    assert apply_to(lambda c: F.date_format(parse_published(c), "yyyy-MM-dd HH:mm:ss"), [text]) == [iso]


@pytest.mark.parametrize(
    "text, iso",
    [
        ("30 Jan 2024 10:20 GMT", "2024-01-30 10:20:00"),
        ("Tue, 30 Jan 24 10:20:30 EST", "2024-01-30 15:20:30"),
        ("Tue, 30 Jan 95 10:20:30 UT", "1995-01-30 10:20:30"),
        ("Tuesday, 30 January 2024 10:20:30 +0530", "2024-01-30 04:50:30"),
        ("30 Jan 2024 10:20:30", "2024-01-30 10:20:30"),
        ("Tue Jan 30 10:20:30 2024", "2024-01-30 10:20:30"),
        ("Tue Jan  3 10:20:30 PST 2024", "2024-01-03 18:20:30"),
        ("Tue, 30 Jan 2024 10:39:00 EDT", "2024-01-30 14:39:00"),
        ("Tue, 30 Jan 2024 10:20:30 XYZ", "2024-01-30 10:20:30"),
        ("Tue, 30 Jan 2024 10:20:30 GMT+1", "2024-01-30 09:20:30"),
        ("2024-01-30T10:20:30.5-05:00", "2024-01-30 15:20:30"),
        ("20240130T10:20", "2024-01-30 10:20:00"),
        ("2024-01", "2024-01-01 00:00:00"),
        (" 30 Jan 2024\n", "2024-01-30 00:00:00"),
        ("Tue, 31 Feb 2024 10:20:30 GMT", None),
        ("Tue, 30 Foo 2024 10:20:30 GMT", None),
        ("25:00", None),
        ("\x01 2024", None),
        ("", None),
        (None, None),
    ],
)
def test_date_forms(apply_to, text, iso):
    assert apply_to(lambda c: F.date_format(parse_published(c), "yyyy-MM-dd HH:mm:ss"), [text]) == [iso]


def test_the_earlier_zone_names_keep_their_offset(apply_to):
    # the offset of the name, not that of the season
    assert apply_to(lambda c: F.hour(parse_published(c)), [f"30 {m} 2024 12:00:00 {z}" for m in ("Jan", "Jul") for z in ("EST", "EDT", "CET")]) == [17, 16, 11] * 2
