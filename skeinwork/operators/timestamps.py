"""Normalising timestamp columns that mix formats, precisions and zones (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.timestamps import UTC_FORM, utc_text, with_utc_seconds

_SITE = ("__site_id", "__site_locale", "__site_tz")


def with_site(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds __site_locale and __site_tz of each row's source. One row a source is kept, so repeated sources change nothing.

    The join is left: rows whose source is missing or null get nulls. Spark broadcasts the few columns of sources if they are below
    its threshold and sorts both sides otherwise.
    """
    site = sources.groupBy(F.col("id").alias(_SITE[0])).agg(F.max("site_locale").alias(_SITE[1]), F.max("site_tz").alias(_SITE[2]))
    return items.join(site, items["source_id"] == site[_SITE[0]], "left").drop(_SITE[0])


def normalise_timestamps(items: DataFrame, sources: DataFrame, fields: dict[str, bool]) -> DataFrame:
    """(id, field, value, utc): one row for each distinct id, field and value, utc null where the value names no instant.

    fields: column name -> whether a value without a zone is UTC (else local time of the source's site). Columns beyond id, source_id
    and the fields are not read. Null values give no row; an empty table gives none; rows delivered twice count once. The fields are
    unpivoted before the components are extracted, so the expression is compiled once and the text of a page is never moved.
    """
    each = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("value"), F.lit(v).alias("as_utc")) for k, v in fields.items()])
    rows = items.select("id", "source_id", F.explode(each).alias("x")).select("id", "source_id", "x.*").where(F.col("value").isNotNull())
    placed = with_site(rows, sources)
    zone = F.when(F.col("as_utc"), F.lit("UTC")).otherwise(F.col(_SITE[2]))
    dated = with_utc_seconds(placed, "seconds", F.col("value"), F.col(_SITE[1]), zone)
    # An aggregate rather than distinct(): a filter on its result isn't pushed below the projections, which it would repeat.
    return dated.groupBy("id", "field", "value").agg(F.max(utc_text(F.col("seconds"))).alias("utc"))


def found(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases of problem 5: (id, field, utc) of values that name an instant and are not in the UTC form already."""
    out = normalise_timestamps(items, sources, {"published_at": False, "fetched_at": True})
    return out.where(F.col("utc").isNotNull() & ~F.col("value").rlike(UTC_FORM)).select("id", "field", "utc").distinct()
