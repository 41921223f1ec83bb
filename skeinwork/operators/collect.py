"""From pages and feeds to candidates, and from candidates to clusters and processed items, as set operations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators.serving import in_window
from skeinwork.sources import pages

CANDIDATE = ("source_id", "url", "title", "raw_content", "published_at", "origin")


def first_of_each(rows: DataFrame, key: str, most: int, *order: Column, place: str | None = None) -> DataFrame:
    """The first `most` rows of each key in a total order, numbered in `place` if named; Spark stops early in each task, below the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    first = rows.withColumn(place or "__place", F.row_number().over(window)).where(F.col(place or "__place") <= most)
    return first if place else first.drop("__place")


def listing_candidates(landing: DataFrame) -> DataFrame:
    """Candidates of listing pages: landing(id, source_id, url, html, published_at), one row a fetched page.

    Links are parsed in batches and kept where they look like articles; the label is the title. A page that can't be parsed has none.
    """
    links = pages.parsed(landing).select("id", F.explode("page.links").alias("link"))
    placed = links.join(landing.select("id", "source_id", F.col("url").alias("base"), "published_at"), "id")
    good = placed.where(pages.usable_link(F.col("base"), F.col("link.href"), F.col("link.text")))
    return good.select("source_id", F.col("link.href").alias("url"), F.col("link.text").alias("title"), F.lit(None).cast("string").alias("raw_content"), "published_at", F.lit("listing").alias("origin")).dropDuplicates(["source_id", "url"])


def feed_candidates(landing: DataFrame) -> DataFrame:
    """Candidates of feeds: landing(id, source_id, xml); malformed feeds have none. The first entry of a link counts."""
    entries = pages.feeds(landing).join(landing.select("id", "source_id"), "id").select("source_id", F.posexplode("entries").alias("at", "e"))
    rows = entries.select("source_id", F.col("e.link").alias("url"), F.col("e.title").alias("title"), F.col("e.content").alias("raw_content"), F.col("e.published").alias("published_at"), F.lit("feed").alias("origin"), "at")
    return rows.groupBy("source_id", "url").agg(F.min_by(F.struct("title", "raw_content", "published_at", "origin"), "at").alias("r")).select("source_id", "url", "r.*")


def within(candidates: DataFrame, windows: DataFrame, most: int = 200) -> DataFrame:
    """Candidates inside their source's window (windows(id, window_start, window_end)), at most `most` a source, newest first, then by url.

    Unknown instants stay, after the known ones. Sources without a window have no candidates.
    """
    seconds = T.iso_seconds(F.col("published_at"))
    inside = candidates.withColumn("seconds", seconds).join(windows.withColumnRenamed("id", "source_id"), "source_id")
    kept = inside.where(in_window(F.col("seconds"), F.col("window_start"), F.col("window_end"))).drop("window_start", "window_end")
    return first_of_each(kept, "source_id", most, F.desc_nulls_last("seconds"), F.asc("url"))


def new_clusters(accepted: DataFrame, clusters: DataFrame, events: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(cluster_key, canonical_title, representative_id, duplicate_count, first_seen_at, last_seen_at) of the keys that no event has yet.

    events(canonical_title) are known by the key of their title. accepted(id, title) supplies the representative's title.
    """
    known = events.select(key(F.col("canonical_title")).alias("cluster_key")).distinct()
    fresh = clusters.join(known, "cluster_key", "left_anti")
    titles = accepted.select(F.col("id").alias("representative_id"), F.col("title").alias("canonical_title"))
    return fresh.join(titles, "representative_id").select("cluster_key", "canonical_title", "representative_id", F.col("members").alias("duplicate_count"), F.col("first_seen").alias("first_seen_at"), F.col("last_seen").alias("last_seen_at"))


def known_clusters(clusters: DataFrame, events: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(cluster_key, event_id): the smallest event of each key that has one."""
    of = events.groupBy(key(F.col("canonical_title")).alias("cluster_key")).agg(F.min("id").alias("event_id"))
    return clusters.select("cluster_key").join(of, "cluster_key")


def marked(raw: DataFrame, processed: DataFrame, rejected: DataFrame) -> DataFrame:
    """(id, new_status): processed where processed(id) has the item, else rejected where rejected(id) has it, else as it was."""
    p = processed.select("id").distinct().withColumn("__p", F.lit(True))
    r = rejected.select("id").distinct().withColumn("__r", F.lit(True))
    out = raw.select("id", "status").dropDuplicates(["id"]).join(p, "id", "left").join(r, "id", "left")
    return out.select("id", F.when(F.col("__p"), "processed").when(F.col("__r"), "rejected").otherwise(F.col("status")).alias("new_status"))
