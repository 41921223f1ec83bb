"""The best representative of each duplicate group (problem 6).

Fields are unpivoted to long rows, one for each item and field it can supply. Each value's votes, source trust times recency decay, are
summed; the winner of each field is taken by max_by and the winners are pivoted back to one row a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.timestamps import with_utc_seconds
from skeinwork.operators.timestamps import with_site

#: Trust of a source whose score is null or 0.
DEFAULT_TRUST = 0.5


def vote(rows: DataFrame, group: str, fields: dict[str, Column], trust: Column, seconds: Column, half_life_days: float | None, ties: Column) -> DataFrame:
    """One row a group: for each field the value with the most votes and, as <field>_votes, its votes.

    fields: name -> value, compared trimmed and in lower case; null and blank values don't vote. A vote is trust times 2 ** -(age in half-lives), age counted from the
    group's latest instant; an unknown instant counts as one half-life old, half_life_days None as no decay. Ties go to the larger `ties`
    (a column whose order is total). Votes are summed partially before the shuffle, so a hot group costs no more than its distinct values.
    """
    newest = rows.groupBy(F.col(group).alias("__g")).agg(F.max(seconds).alias("__newest"))
    aged = rows.join(newest, rows[group].eqNullSafe(newest["__g"]))
    decay = F.lit(1.0) if half_life_days is None else F.pow(F.lit(2.0), -F.coalesce((F.col("__newest") - seconds) / (86400.0 * half_life_days), F.lit(1.0)))
    each = F.array(*[F.struct(F.lit(k).alias("field"), v.cast("string").alias("value")) for k, v in fields.items()])
    long = aged.select(F.col(group).alias("__key"), (trust * decay).alias("__vote"), ties.alias("__ties"), F.explode(each).alias("__x"))
    spoken = long.where(F.col("__x.value").rlike(r"(?U)\S")).select("__key", "__vote", "__ties", F.col("__x.field").alias("__field"), F.col("__x.value").alias("__value"), F.lower(F.trim(F.col("__x.value"))).alias("__same"))
    summed = spoken.groupBy("__key", "__field", "__same").agg(F.sum("__vote").alias("__votes"), F.max(F.struct("__ties", "__value")).alias("__best"))
    best = summed.groupBy("__key").agg(*[x for k in fields for x in _winner(k)])
    return best.withColumnRenamed("__key", group)


def _winner(field: str) -> list[Column]:
    mine = F.when(F.col("__field") == field, F.struct("__votes", "__best"))
    return [F.max_by(F.col("__best.__value"), mine).alias(field), F.max(mine)["__votes"].alias(f"{field}_votes")]


def candidates(processed: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, item_id, trust, size, seconds, has_author, raw_id): what the choice needs, a narrow row for each processed item.

    Repeated deliveries count once. Lengths and instants are taken before the join, so no text is shuffled.
    """
    length = F.coalesce(F.when(F.length("raw_content") > 0, F.length("raw_content")), F.length("content_excerpt"), F.lit(0))
    thin = raw.select("id", "source_id", "published_at", F.coalesce(F.col("author").rlike(r"(?U)\S"), F.lit(False)).alias("has_author"), length.alias("size")).dropDuplicates(["id"])
    dated = with_utc_seconds(with_site(thin, sources), "seconds", F.col("published_at"), F.col("__site_locale"), F.col("__site_tz"))
    score = F.max("reliability_score")
    trust = sources.groupBy(F.col("id").alias("__source")).agg(F.when(F.isnan(score) | (score == 0), None).otherwise(score).alias("__score"))
    rated = dated.join(trust, dated["source_id"] == trust["__source"], "left")
    rated = rated.select(F.col("id").alias("raw_id"), F.coalesce("__score", F.lit(DEFAULT_TRUST)).alias("trust"), F.col("size").cast("long"), "seconds", "has_author")
    chosen = processed.select(F.col("id").alias("item_id"), "raw_item_id", F.col("canonical_event_id").alias("event_id")).where("event_id is not null").dropDuplicates(["item_id"])
    joined = chosen.join(rated, chosen["raw_item_id"] == rated["raw_id"], "left")
    return joined.select("event_id", "item_id", F.coalesce("trust", F.lit(DEFAULT_TRUST)).alias("trust"), F.coalesce("size", F.lit(0)).alias("size"), "seconds", F.coalesce("has_author", F.lit(False)).alias("has_author"), F.coalesce("raw_id", "raw_item_id").alias("raw_id"))


def survivors(processed: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, representative_item_id, author_item_id, published_item_id) of each event with at least two processed items.

    The order is given: source trust, characters of text, publication instant (unknown last), smaller raw id; so a vote is the item's
    place in that order and no decay is applied. Each item is unpivoted to the fields it can supply, each field's winner is the max_by of
    the order, and the winners are pivoted back; -1 where no item supplies a field. Items without an event have no row.
    """
    rank = F.struct(F.col("trust"), F.col("size"), F.coalesce("seconds", F.lit(-(1 << 62))).alias("instant"), (-F.col("raw_id")).alias("raw"), (-F.col("item_id")).alias("item"))
    supplies = F.filter(F.array(F.lit("representative"), F.when(F.col("has_author"), F.lit("author")), F.when(F.col("seconds").isNotNull(), F.lit("published"))), lambda x: x.isNotNull())
    long = candidates(processed, raw, sources).select("event_id", "item_id", rank.alias("rank"), F.explode(supplies).alias("field"))
    first = lambda k: F.coalesce(F.max_by("item_id", F.when(F.col("field") == k, F.col("rank"))), F.lit(-1)).alias(f"{k}_item_id")
    wide = long.groupBy("event_id").agg(F.count_if(F.col("field") == "representative").alias("n"), *[first(k) for k in ("representative", "author", "published")])
    return wide.where("n >= 2").drop("n")


def voted(processed: DataFrame, raw: DataFrame, sources: DataFrame, half_life_days: float | None) -> DataFrame:
    """(event_id, author, source_type, importance, and the votes of each as <field>_votes) of each event, by vote() over its processed items.

    Field by field the value with the most source trust, decayed by age, survives; ties go to the more trusted, longer, later item.
    """
    rows = candidates(processed, raw, sources)
    words = raw.select(F.col("id").alias("raw_id"), "author", "source_id").dropDuplicates(["raw_id"])
    kinds = sources.select(F.col("id").alias("source_id"), "type").dropDuplicates(["source_id"])
    levels = processed.select(F.col("id").alias("item_id"), "importance_level").dropDuplicates(["item_id"])
    whole = rows.join(words, "raw_id", "left").join(kinds, "source_id", "left").join(levels, "item_id")
    ties = F.struct("trust", "size", F.coalesce("seconds", F.lit(-(1 << 62))), -F.col("item_id"))
    return vote(whole, "event_id", {"author": F.col("author"), "source_type": F.col("type"), "importance": F.col("importance_level")}, F.col("trust"), F.col("seconds"), half_life_days, ties)


def found(processed: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases of problem 6."""
    return survivors(processed, raw, sources)
