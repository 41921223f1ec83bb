import math

from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators import analysis as A
from skeinwork.operators import serving as S
from skeinwork.vocab import AI, NEV

ITEM = "id long, source_id long, title string, raw_content string, content_excerpt string, author string, published_at string, fetched_at string, relevance_industry string, source_type string, industry_hint string, reliability double"


def item(i, title, body="", kind="media", hint=None, **more):
    base = dict(id=i, source_id=1, title=title, raw_content=body, content_excerpt=None, author=None, published_at=None, fetched_at=None, relevance_industry=None, source_type=kind, industry_hint=hint, reliability=0.75)
    return tuple((base | more).values())


def screened(spark, *rows):
    return {r["id"]: r for r in A.with_relevance(spark.createDataFrame(list(rows), ITEM)).collect()}


def test_relevance_goldens(spark):
    slogan = "资讯栏目每天对新能源电动汽车行业的新闻资讯第一时间报道"
    r = screened(
        spark, item(1, "假冒学历认证等网站 公安部网安局发布典型案例", hint="new_energy_vehicle"), item(2, "青年理论学习小组 座谈会", kind="government"),
        item(3, "Available representatives review every delegation notice"), item(4, "人工智能+能源 现场推进会"), item(5, "最后一页", slogan), item(6, "头条", slogan),
        item(7, "CATL expands energy storage"), item(8, "具身智能融资"), item(9, None, None), item(10, "", ""),
    )
    assert not r[1]["is_relevant"] and r[1]["screen_confidence"] == 0.9
    assert not r[2]["is_relevant"] and r[2]["negative_terms"] == ["青年理论学习", "学习小组"]
    assert not r[3]["is_relevant"] and r[3]["nev_terms"] == [] and r[3]["screen_confidence"] == 0.85
    assert r[4]["industry"] == AI and "人工智能" in r[4]["ai_terms"]
    assert r[5]["low_information"] and r[6]["low_information"]
    assert r[7]["industry"] == NEV and "CATL" in r[7]["nev_terms"]
    assert r[8]["industry"] == AI
    assert not r[9]["is_relevant"] and not r[10]["is_relevant"]


def test_rank_golden(spark):
    row = spark.createDataFrame([("high", 0.8, 1.0, ["政策/监管"], 2, "core", 100 * 3600, None)], "importance string, class_confidence double, reliability double, event_types array<string>, reliable_sources long, actor_level string, published_s long, fetched_s long")
    got = A.with_rank(row, 104 * 3600).first()["rank_score"]
    assert abs(got - (0.35 * 0.94 + 0.20 + 0.15 + 0.15 + 0.10 * math.log2(3) / math.log2(6) + 0.05)) < 1e-4


def test_freshness_edges(spark):
    ages = [(0, 1.0), (6, 1.0), (7, 0.85), (24, 0.85), (72, 0.6), (168, 0.35), (169, 0.15), (-5, 1.0)]
    df = spark.createDataFrame([(1_000_000 - h * 3600, w) for h, w in ages], "s long, want double")
    assert df.where(A.freshness(F.col("s"), F.lit(None).cast("long"), 1_000_000) != F.col("want")).count() == 0
    assert df.select(A.freshness(F.lit(None).cast("long"), F.lit(None).cast("long"), 0).alias("x")).first()["x"] == 0.3


def test_representative_and_ties(spark):
    rows = [item(10, "a b", "short", reliability=0.75), item(11, "a b", "a longer text", reliability=1.0), item(13, "tie", "x"), item(12, "tie", "x"), item(14, None, None, reliability=None)]
    got = {r["cluster_key"]: r for r in A.clusters(spark.createDataFrame(rows, ITEM)).collect()}
    assert got["ab"]["representative_id"] == 11 and got["ab"]["members"] == 2 and got["tie"]["representative_id"] == 12 and got[""]["representative_id"] == 14


def test_demo_cluster_keys(spark):
    want = {"动力电池政策发布": "battery-policy", "NVIDIA 推出": "nvidia-ai-chip", "OpenAI agent": "openai-agent", "宁德时代扩产": "catl-capacity", "BYD export": "byd-overseas", "Ａ-b_c!": "ａb_c"}
    df = spark.createDataFrame([(k, v) for k, v in want.items()], "t string, want string")
    assert df.where(A.cluster_key(F.col("t")) != F.col("want")).collect() == []


def test_classes_are_never_empty_and_tags_follow_the_taxonomy(spark):
    c = A.with_classes(spark.createDataFrame([item(1, "x"), item(2, None, None, kind=None), item(3, "比亚迪 发布 新品 海外", kind="company", relevance_industry=NEV)], ITEM))
    rows = {r["id"]: r for r in c.collect()}
    assert rows[1]["event_types"] == ["龙头企业动向"] and rows[1]["signals"] == ["竞争格局变化"] and rows[1]["subtags"] == ["基础模型"] and rows[1]["importance"] == "low"
    assert rows[3]["event_types"] == ["产品发布", "龙头企业动向", "海外扩张"] and rows[3]["entities"][0]["text"] == "比亚迪" and rows[3]["importance"] == "high"
    assert {r["dimension"] for r in A.tags(c).collect()} == {"industry", "industry_subtag", "event_type", "subject_role", "signal_attribute"}
    assert A.violations(c, "event_types", ("产品发布",)).count() == 3


def test_text_helpers(spark):
    df = spark.createDataFrame([("  a　b \n c ", "x" * 400), (None, None)], "a string, b string")
    r = df.select(T.compact(F.col("a")).alias("a"), T.excerpt(F.col("b")).alias("b")).collect()
    assert r[0]["a"] == "a b c" and r[0]["b"] == "x" * 360 + "..." and r[1]["a"] == "" and r[1]["b"] == ""
    d = spark.createDataFrame([("/20260527/ab/c.html", "日期： 2026年05月18日 16:49"), ("/20261327/20260101x", "发布时间:2026/2/30"), ("/120260527", None)], "u string, t string").select(T.url_date(F.col("u")).cast("string").alias("u"), T.text_date(F.col("t")).cast("string").alias("t")).collect()
    assert [tuple(x) for x in d] == [("2026-05-27", "2026-05-18"), ("2026-01-01", None), (None, None)]


def test_due_sources(spark):
    rows = [(1, True, 60, "2026-01-01T08:30:00Z", None), (2, True, 60, "2026-01-01T07:59:00Z", None), (3, False, 60, None, None), (4, True, None, None, None), (5, True, 0, None, "2026-01-01T07:30:00+00:00")]
    df = spark.createDataFrame(rows, "id long, enabled boolean, fetch_interval_minutes int, last_fetched_at string, last_checked_at string")
    nine = 1_767_258_000
    assert sorted(r["id"] for r in S.due_sources(df, nine).collect()) == [2, 4]
    windows = {r["id"]: r["window_start"] for r in S.source_windows(df, nine).collect()}
    assert windows[1] == nine - 1800 and windows[4] == nine - 86_400


def test_run_page(spark):
    runs = spark.createDataFrame([(i, f"2026-01-01T00:{i:02}:00Z") for i in range(1, 36)], "id long, started_at string")
    assert [r["id"] for r in S.run_page(runs, page=2).collect()] == list(range(25, 15, -1))


def test_running_runs(spark):
    runs = spark.createDataFrame([(1, "2026-01-01", "running"), (2, "2026-01-02", "running"), (3, "2026-01-03", "success")], "id long, started_at string, status string")
    assert {r["id"]: r["new_status"] for r in S.close_duplicate_running(runs).collect()} == {1: "failed", 2: "running", 3: "success"}
    assert S.close_duplicate_running(runs.limit(0)).count() == 0
    assert {r["new_status"] for r in S.close_duplicate_running(runs.where("id = 3")).collect()} == {"success"}
