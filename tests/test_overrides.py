import json

from pyspark.sql import functions as F

from skeinwork.operators import analysis as A
from skeinwork.operators import overrides as O
from tests.test_analysis import ITEM, item

FULL = {"industry_subtags": ["动力电池"], "event_types": ["融资/投资"], "importance_level": "medium", "importance_reason": "r", "subject_roles": ["投资机构"], "signal_attributes": ["机会信号"], "confidence": 1.7}


def test_class_overrides(spark):
    rows = A.with_classes(spark.createDataFrame([item(i, "x") for i in range(6)], ITEM))
    answers = [(0, json.dumps(FULL)), (1, json.dumps(FULL | {"event_types": ["随便造的标签"]})), (2, json.dumps(FULL | {"subject_roles": []})), (3, "no json"), (4, None), (0, None), (99, json.dumps(FULL))]
    got = {r["id"]: r for r in O.with_class_overrides(rows, spark.createDataFrame(answers, "id long, payload string")).collect()}
    assert len(got) == 6
    assert got[0]["event_types"] == ["融资/投资"] and got[0]["class_confidence"] == 1.0 and got[0]["class_mode"] == "answer"
    assert [got[i]["class_fallback_reason"] for i in range(1, 6)] == ["unknown_label", "incomplete", "incomplete", "no_answer", "no_answer"]
    assert got[1]["event_types"] == ["龙头企业动向"]


def test_fact_overrides(spark):
    rows = A.key_facts(A.with_classes(spark.createDataFrame([item(i, "a title", "some text here") for i in range(3)], ITEM)))
    answer = {"summary": " s ", "impact_analysis": "i", "key_facts": {"who": "w", "what": ""}, "source_spans": [{"field": "content", "start": -4, "end": 999, "quote": "q" * 300}]}
    got = {r["id"]: r for r in O.with_fact_overrides(rows, spark.createDataFrame([(0, json.dumps(answer)), (1, json.dumps(answer | {"summary": ""}))], "id long, payload string")).collect()}
    assert got[0]["summary_sentence"] == "s" and got[0]["key_facts"]["who"] == "w" and got[0]["key_facts"]["what"] == "a title"
    assert tuple(got[0]["source_spans"][0]) == ("raw_content", 0, 14, "q" * 260)
    assert got[1]["extraction_fallback_reason"] == "invalid_answer" and got[2]["extraction_fallback_reason"] == "no_answer" and got[2]["extraction_mode"] == "rules"


def test_bounded_text(spark):
    df = spark.createDataFrame([("<p>x</p>", "<b>An excerpt that is long enough</b>", "t"), (None, None, "a title with letters"), ("", None, None)], "raw_content string, content_excerpt string, title string")
    assert [r["x"] for r in df.select(O.bounded_text().alias("x")).collect()] == ["An excerpt that is long enough", "a title with letters", ""]
