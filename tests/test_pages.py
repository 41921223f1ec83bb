import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.sources import pages
from skeinwork.sources.cleaning import block_end, clean


def test_decoding():
    text = "新能源汽车发布会：动力电池"
    assert pages.decode(text.encode(), "text/html; charset=iso-8859-1") == text
    assert pages.decode(text.encode("gb18030"), "") == text
    assert pages.decode("Überprüfung".encode("latin-1"), "charset=latin-1") == "Überprüfung"
    assert pages.decode(None) == "" and pages.decode(b"", "x") == ""


def test_page():
    page = """<html><head><title>News &amp; more</title><meta property="article:published_time" content="2026-05-18"><meta name=description content="d"></head>
    <body><script>var x = "<p>no</p>";</script><style>.a{color:red}</style><p>A sentence here.</p><a href="/x/1.html#top">One</a><a href="/x/1.html">again</a><a href="">empty</a><svg><a href="/no">no</a></svg></body>"""
    got = pages.parse(page, "https://a.example/list/")
    assert got["title"] == "News & more" and got["published"] == "2026-05-18" and got["description"] == "d"
    assert got["links"] == [{"href": "https://a.example/x/1.html", "text": "One"}]
    assert "A sentence here." in got["body"] and "color" not in got["body"] and "var x" not in got["body"]
    assert pages.parse(None, None) is None and pages.parse("", None)["links"] == []


def test_feed():
    rss = """<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>T</title><link>https://a.example/1</link><pubDate>Mon, 19 Feb 2024 20:48:28 +0800</pubDate><description>&lt;p&gt;body&lt;/p&gt;</description></item><item><title>no link</title></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="https://a.example/2"/><updated>2024-01-01T00:00:00Z</updated></entry></feed>"""
    assert pages.looks_like_feed(rss) and pages.looks_like_feed(atom) and not pages.looks_like_feed("<html>")
    assert pages.feed_entries(rss) == [{"title": "T", "link": "https://a.example/1", "content": "body", "published": "Mon, 19 Feb 2024 20:48:28 +0800"}]
    assert pages.feed_entries(atom)[0]["link"] == "https://a.example/2"
    assert pages.feed_entries("<rss><broken>") is None and pages.feed_entries(None) is None


def test_batches(spark):
    rows = spark.createDataFrame([(1, "https://a.example/", "<title>t</title>"), (2, None, None)], "id long, url string, html string")
    got = {r["id"]: r["page"] for r in pages.parsed(rows).collect()}
    assert got[1]["title"] == "t" and got[2] is None
    feeds = spark.createDataFrame([(1, "<rss/>"), (2, "<"), (3, None)], "id long, xml string")
    assert {r["id"]: r["entries"] for r in pages.feeds(feeds).collect()} == {1: [], 2: None, 3: None}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Fish &amp; chips  today", "Fish & chips today"),
        ("Before <script>var a = {b: 1};</script> after", "Before after"),
        ('Lead {"@context": "https://schema.org", "name": "{x}"} text', "Lead text"),
        ("正文开始 @media (max-width: 600px) { .nav { display: none } } 正文继续", "正文开始 正文继续"),
        ("文章 $(document).ready(function(){ var a = 1; if (a) { go(); } }); 结束", "文章 结束"),
        ("a <!-- hidden --> b", "a b"),
        ("Prices rose {see table} last year", "Prices rose {see table} last year"),
        (None, ""), ("", ""), (" \n ", ""),
    ],
)
def test_cleaning(text, want):
    assert clean(text) == want


def test_unbalanced_text_stays():
    assert block_end('{"a": "}"}', 0) == 10 and block_end("{", 0) == -1
    assert "long" in clean("{ " + "long " * 50_000)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab {}<>/&;=:'\"(1.新", max_size=80))
def test_cleaning_twice_changes_nothing(text):
    once = clean(text)
    assert clean(once) == once


def test_link_predicate(spark):
    base = "https://a.example/news/"
    rows = [("https://a.example/2026/05/18/x.html", "A good headline", True), ("https://a.example/about", "About this company", False), ("https://a.example/news/", "A list of news", False), ("mailto:x@a.example", "Write to us now", False), ("https://a.example/a.pdf.zip", "Download 20260518", False), ("https://a.example/x", "Company announces new plant", True), ("https://a.example/x", "abc", False), ("https://a.example/news/2024.html", "联系我们吧", False)]
    df = spark.createDataFrame(rows, "u string, t string, want boolean")
    assert df.where(pages.usable_link(F.lit(base), F.col("u"), F.col("t")) != F.col("want")).collect() == []


def test_body_predicate(spark):
    rows = [("太短", "", False), ("首页 登录 注册 投稿 验证码 联系我们 版权所有 站内导航", "", False), ("article section div span header footer nav", "", False), ("The company opened a plant in the north and will employ many people there.", "", True), ("企业库 销量 查询 采购 项目 工具栏 盖世", "", False)]
    df = spark.createDataFrame(rows, "b string, t string, want boolean")
    assert df.where(pages.substantive(F.col("b"), F.col("t")) != F.col("want")).collect() == []
