from pyspark.sql import functions as F

from skeinwork.operators import analysis as A
from skeinwork.operators import collect as C
from skeinwork.operators import serving as S

LANDING = "id long, source_id long, url string, html string, xml string, published_at string"


def landing(spark):
    page = "<nav><a href='/about'>About this company</a></nav><a href='/2024/01/05/x.html#top'>A good headline</a><a href='/2024/01/05/x.html'>again</a>"
    feed = "<rss><channel><item><title>T</title><link>https://a.example/1</link><pubDate>2024-01-05T00:00:00Z</pubDate></item><item><title>T2</title><link>https://a.example/1</link></item></channel></rss>"
    return spark.createDataFrame([(1, 7, "https://a.example/", page, feed, "2024-01-05T00:00:00Z"), (2, 7, "https://a.example/b/", None, "<rss", None), (3, 8, None, "", None, None)], LANDING)


def test_candidates(spark):
    assert [tuple(r) for r in C.listing_candidates(landing(spark)).select("source_id", "url", "title", "origin").collect()] == [(7, "https://a.example/2024/01/05/x.html", "A good headline", "listing")]
    assert [tuple(r) for r in C.feed_candidates(landing(spark)).select("source_id", "url", "title", "published_at", "origin").collect()] == [(7, "https://a.example/1", "T", "2024-01-05T00:00:00Z", "feed")]
    empty = landing(spark).limit(0)
    assert C.listing_candidates(empty).count() == 0 and C.feed_candidates(empty).count() == 0


def test_window_and_limit(spark):
    rows = spark.createDataFrame([(1, f"u{k}", f"2024-01-0{k}T00:00:00Z") for k in range(1, 6)] + [(1, "u0", None), (2, "v", "2020-01-01T00:00:00Z"), (3, "w", None)], "source_id long, url string, published_at string")
    windows = spark.createDataFrame([(1, 1_704_153_600, 1_704_326_400), (2, 1_704_153_600, 1_704_326_400)], "id long, window_start long, window_end long")
    got = lambda n: sorted(r["url"] for r in C.within(rows, windows, n).collect())
    assert got(200) == ["u0", "u2", "u3", "u4"] and got(2) == ["u3", "u4"]


def test_clusters_and_status(spark):
    items = spark.createDataFrame([(1, 1, "a b", "2024", None, 0.7, 3), (2, 1, "A-B", "2024", None, 0.9, 3), (3, 1, "new", "2024", None, 0.7, 3)], "id long, source_id long, title string, fetched_at string, published_at string, reliability double, richness int")
    events = spark.createDataFrame([(10, "New!"), (11, "new")], "id long, canonical_title string")
    groups = A.clusters(items)
    assert [tuple(r)[:4] for r in C.new_clusters(items, groups, events, A.cluster_key).collect()] == [("ab", "A-B", 2, 2)]
    assert [tuple(r) for r in C.known_clusters(groups, events, A.cluster_key).collect()] == [("new", 10)]
    raw = spark.createDataFrame([(1, "new"), (2, "new"), (3, "new"), (3, "new")], "id long, status string")
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    assert sorted(map(tuple, C.marked(raw, one(1), one(2)).collect())) == [(1, "processed"), (2, "rejected"), (3, "new")]


def test_runs(spark):
    runs = spark.createDataFrame([(1, "success", "2024", None, 5, 3, 2, 2), (2, "failed", None, "x", 5, 3, 0, 0), (3, "running", None, None, None, 0, 0, 0)], "id long, status string, ended_at string, error_summary string, collected_count int, deduped_count int, classified_count int, extracted_count int")
    got = {(r["id"], r["node"]): r["state"] for r in S.run_trace(runs).collect()}
    assert got[1, "extracted"] == "done" and got[2, "deduped"] == "done" and got[2, "classified"] == "failed" and got[2, "extracted"] == "open" and got[3, "collected"] == "open"
    assert sorted(tuple(r)[:4] for r in S.recovered(runs).collect()) == [(1, "success", "2024", None), (2, "failed", None, "x"), (3, "failed", None, "interrupted")]


def test_tag_filters(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "b", ["x"]), (3, "a", ["z"]), (4, None, None)], "id long, one string, many array<string>")
    got = lambda **w: sorted(r["id"] for r in S.tagged(rows, w).collect())
    assert got(one=("a",), many=("x", "z")) == [1, 3] and got(many=("y",)) == [1] and got(one=()) == [1, 2, 3, 4]


def test_first_of_each_takes_all_of_few(spark):
    rows = spark.createDataFrame([(1, 5), (1, 4), (1, 3), (2, 9)], "k long, v long")
    assert sorted(map(tuple, C.first_of_each(rows, "k", 2, F.asc("v")).collect())) == [(1, 3), (1, 4), (2, 9)]


def answers(url):
    if "broken" in url:
        raise TimeoutError("no answer")
    if "feed" in url:
        return "<?xml version='1.0'?><rss><channel><item><title>标题</title><link>https://a.example/1</link></item></channel></rss>".encode("gb18030"), "text/xml; charset=gb18030"
    return b"<a href='/2024/01/05/x.html'>A good headline</a>", "text/html"


def test_fetch_and_scan(spark):
    from skeinwork.sources import fetch

    sources = spark.createDataFrame([(1, "https://a.example/list/", "x"), (2, "https://a.example/feed", "x"), (3, "https://broken.example/", "x")], "id long, url string, text string")
    landing = fetch.fetched(sources, answers)
    assert {r["id"]: r["error"] for r in landing.collect()} == {1: None, 2: None, 3: "TimeoutError: no answer"}
    assert sorted((r["source_id"], r["origin"], r["title"]) for r in fetch.scanned(landing).collect()) == [(1, "listing", "A good headline"), (2, "feed", "标题")]
    assert fetch.scanned(landing.limit(0)).count() == 0
