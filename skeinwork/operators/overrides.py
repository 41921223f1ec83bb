"""Answers of an outside scorer laid over the results of the rules, row by row, with their provenance.

A scorer is any transformation that gives (id, payload) with a JSON object as text; rows without a usable answer keep the rules' result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.sources.cleaning import HIDDEN
from skeinwork.vocab import REFERENCE, Vocabulary

_CLASSES = "industry_subtags array<string>, event_types array<string>, importance_level string, importance_reason string, subject_roles array<string>, signal_attributes array<string>, confidence double"
_LISTS = {"industry_subtags": "subtags", "event_types": "event_types", "subject_roles": "subject_roles", "signal_attributes": "signals"}
_FACTS = ("who", "what", "when", "where", "why", "impact", "evidence")


def _answers(payloads: DataFrame, schema: str) -> DataFrame:
    """One answer an id (the largest text on repeats), parsed; a payload that is no JSON object of the schema is null."""
    one = payloads.groupBy(F.col("id").alias("__id")).agg(F.max("payload").alias("__payload"))
    return one.withColumn("__a", F.from_json("__payload", schema, {"mode": "PERMISSIVE"}))


def _outside(values: Column, allowed: list[str]) -> Column:
    return F.size(F.array_except(F.coalesce(values, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]))) > 0


def with_class_overrides(classified: DataFrame, payloads: DataFrame, vocab: Vocabulary = REFERENCE) -> DataFrame:
    """classified rows with the answers' labels, importance and confidence where an answer is complete and inside the taxonomy.

    Adds class_mode (answer or rules) and class_fallback_reason: no_answer, incomplete (a list is missing or empty, or importance is
    missing) or unknown_label. Confidence is clamped to 0 to 1 and keeps the rules' value if missing. Rows are kept, one each.
    """
    joined = classified.join(_answers(payloads, _CLASSES), classified["id"] == F.col("__id"), "left")
    a = lambda k: F.col(f"__a.{k}")
    allowed = {"industry_subtags": [s for tags in vocab.subtags.values() for s in tags], "event_types": list(vocab.events), "subject_roles": list(vocab.roles), "signal_attributes": list(vocab.signals)}
    lacks, unknown = a("importance_level").isNull(), ~F.coalesce(a("importance_level").isin(*vocab.importance_scores), F.lit(True))
    for k in _LISTS:
        lacks = lacks | (F.coalesce(F.size(a(k)), F.lit(0)) <= 0)
        unknown = unknown | _outside(a(k), allowed[k])
    reason = F.when(F.col("__payload").isNull(), "no_answer").when(lacks, "incomplete").when(unknown, "unknown_label")
    out = joined.withColumn("class_fallback_reason", reason)
    good = F.col("class_fallback_reason").isNull()
    changes = {mine: F.when(good, a(k)).otherwise(F.col(mine)) for k, mine in _LISTS.items()}
    changes |= {
        "importance": F.when(good, a("importance_level")).otherwise(F.col("importance")),
        "importance_reason": F.when(good, T.or_empty(a("importance_reason"), F.col("importance_reason"))).otherwise(F.col("importance_reason")),
        "class_confidence": F.when(good & a("confidence").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), a("confidence")))).otherwise(F.col("class_confidence")),
        "class_mode": F.when(good, "answer").otherwise("rules"),
    }
    return out.withColumns(changes).drop("__id", "__payload", "__a")


def with_fact_overrides(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """rows of key_facts() with the answers' summary, impact, facts and spans.

    An answer counts if its summary and impact_analysis have text. Facts fall back field by field; spans are clamped to the named text
    (an unknown field means raw_content), quotes are cut to 260 characters. Adds extraction_mode and extraction_fallback_reason.
    """
    schema = "summary string, impact_analysis string, key_facts struct<" + ",".join(f"`{f}`:string" for f in _FACTS) + ">, source_spans array<struct<field:string,start:int,end:int,quote:string>>"
    joined = rows.join(_answers(payloads, schema), rows["id"] == F.col("__id"), "left")
    a = lambda k: F.col(f"__a.{k}")
    reason = F.when(F.col("__payload").isNull(), "no_answer").when((T.compact(a("summary")) == "") | (T.compact(a("impact_analysis")) == ""), "invalid_answer")
    out = joined.withColumn("extraction_fallback_reason", reason)
    good = F.col("extraction_fallback_reason").isNull()
    fact = lambda f: F.coalesce(F.when(good & (T.compact(a(f"key_facts.`{f}`")) != ""), T.compact(a(f"key_facts.`{f}`"))), F.col(f"key_facts.`{f}`")).alias(f)

    def span(s: Column) -> Column:
        field = F.when(s["field"].isin("title", "content_excerpt"), s["field"]).otherwise("raw_content")
        size = F.length(F.coalesce(F.when(field == "title", F.col("title")).when(field == "content_excerpt", F.col("content_excerpt")).otherwise(F.col("raw_content")), F.lit("")))
        start = F.greatest(F.lit(0), F.least(size, F.coalesce(s["start"], F.lit(0))))
        return F.struct(field.alias("field"), start.alias("start"), F.greatest(start, F.least(size, F.coalesce(s["end"], size))).alias("end"), F.substring(T.compact(s["quote"]), 1, 260).alias("quote"))

    spans = F.when(good & (F.coalesce(F.size(a("source_spans")), F.lit(0)) > 0), F.transform(a("source_spans"), span)).otherwise(F.array("source_span"))
    return out.withColumns({
        "summary_sentence": F.when(good, T.compact(a("summary"))).otherwise(F.col("summary_sentence")), "impact_sentence": F.when(good, T.compact(a("impact_analysis"))).otherwise(F.col("impact_sentence")),
        "key_facts": F.struct(*[fact(f) for f in _FACTS]), "source_spans": spans, "extraction_mode": F.when(good, "answer").otherwise("rules"),
    }).drop("__id", "__payload", "__a", "source_span")


def bounded_text(most: int = 3500) -> Column:
    """The first of content, excerpt and title with at least 12 letters or digits, tags and scripts removed, cut to `most`: what a scorer gets to see."""
    tags = rf"(?is)<({'|'.join(HIDDEN)})\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]+>"
    each = [F.substring(T.compact(F.regexp_replace(F.substring(F.coalesce(F.col(c), F.lit("")), 1, most), tags, " ")), 1, most) for c in ("raw_content", "content_excerpt", "title")]
    return F.coalesce(*[F.when(F.regexp_count(x, F.lit(r"[\p{L}\p{N}]")) >= 12, x) for x in each], F.lit(""))
