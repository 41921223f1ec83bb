"""Feed, event, run and source queries over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators.analysis import items_with_sources, once, richness

RANGES = {"24h": 86_400, "72h": 259_200, "7d": 604_800, "30d": 2_592_000}  # fixed values; "all" has no bound


def joined(processed: DataFrame, raw: DataFrame, sources: DataFrame, events: DataFrame | None = None, term: str | None = None) -> DataFrame:
    """Processed items with their raw item and source (inner) and event (left); repeated deliveries count once.

    Columns of equal names are told apart by prefixes: item_id, raw_id, event_id. Texts stay behind: content_length is their length, and
    for keyword(term) excerpt_hit says whether the excerpt holds the term and excerpt_head is as much of it as can finish one.
    """
    narrow = ["source_id", "source_name", "source_type", "industry_hint", "reliability", "title", "url", "author", "published_at", "fetched_at", "relevance_industry", "relevance_confidence"]
    marks = [] if term is None else [F.lower(F.coalesce("content_excerpt", F.lit(""))).contains(term.lower()).alias("excerpt_hit"), F.substring(F.lower(F.coalesce("content_excerpt", F.lit(""))), 1, len(term)).alias("excerpt_head")]
    r = once(items_with_sources(raw, sources).select(F.col("id").alias("raw_id"), *narrow, richness().alias("content_length"), *marks), "raw_id")
    p = processed.dropDuplicates(["id"]).select(F.col("id").alias("item_id"), "raw_item_id", F.col("canonical_event_id").alias("event_id"), "normalized_title", "summary", "importance_level", "rank_score", "confidence", "created_at", "workflow_run_id")
    out = p.join(r, F.col("raw_item_id") == F.col("raw_id")).drop("raw_item_id")
    if events is not None:
        e = events.select(F.col("id").alias("event_key"), "canonical_title", "duplicate_count")
        out = out.join(e, F.col("event_id") == F.col("event_key"), "left").drop("event_key")
    return out


def keyword(term: str) -> Column:
    """Case-insensitive containment over title, summary and excerpt, also across their joins, of joined(term=term)."""
    return F.col("excerpt_hit") | F.concat_ws(" ", *[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary", "excerpt_head")]).contains(term.lower())


def display_time() -> Column:
    return T.or_empty(F.col("published_at"), F.col("fetched_at"))


def feed(rows: DataFrame, now: int, term: str | None = None, importance: str | None = None, source_type: str | None = None, time_range: str = "7d", sort: str = "rank", limit: int = 50) -> DataFrame:
    """The filtered and ranked feed of joined() rows, at most `limit` (1 to 200) of them.

    An item's time is its publication, or the fetch where that is missing or can't be read as ISO; items without either leave every
    bounded range. Ties go by rank, time and id, so the order is total. Filters stand before the sort; the limit is a top-k plan.
    """
    if importance:
        rows = rows.where(F.col("importance_level") == importance)
    if source_type:
        rows = rows.where(F.col("source_type") == source_type)
    if term:
        rows = rows.where(keyword(term))
    if time_range != "all":
        rows = rows.where(F.coalesce(T.iso_seconds(F.col("published_at")), T.iso_seconds(F.col("fetched_at"))) >= now - RANGES[time_range])
    rank = [F.desc("rank_score"), F.desc_nulls_last("published_at"), F.asc("item_id")]
    order = rank if sort == "rank" else [display_time().desc(), *rank]
    return rows.orderBy(*order).limit(max(1, min(200, limit)))


def similar_reports(rows: DataFrame) -> DataFrame:
    """(event_id, item_id, place): all reports of each event, by reliability, publication and id; items without an event have none."""
    known = rows.where(F.col("event_id").isNotNull() & (F.col("event_id") != 0))
    order = Window.partitionBy("event_id").orderBy(F.desc_nulls_last("reliability"), F.desc_nulls_last("published_at"), "item_id")
    return known.select("event_id", "item_id", F.row_number().over(order).alias("place"))


def due_sources(sources: DataFrame, now: int) -> DataFrame:
    """Enabled sources whose interval (120 minutes if null or 0) has passed since the last fetch, else the last check, or that have neither."""
    minutes = F.coalesce(F.when(F.col("fetch_interval_minutes") != 0, F.col("fetch_interval_minutes")), F.lit(120))
    last = T.iso_seconds(T.or_empty(F.col("last_fetched_at"), F.col("last_checked_at")))
    return sources.where(F.col("enabled") & (last.isNull() | (F.lit(now) - last >= minutes * 60)))


def source_windows(sources: DataFrame, now: int) -> DataFrame:
    """(id, window_start, window_end): publication window of each enabled source's next fetch, a day if it was never fetched."""
    return sources.where("enabled").select("id", F.coalesce(T.iso_seconds(F.col("last_fetched_at")), F.lit(now - 86_400)).alias("window_start"), F.lit(now).cast("long").alias("window_end"))


def in_window(published: Column, start: Column, end: Column) -> Column:
    """Inclusive on both sides; unknown instants stay."""
    return published.isNull() | published.between(start, end)


def run_page(runs: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """One page of runs, newest first; page from 1, size 1 to 100."""
    size = max(1, min(100, size))
    return runs.orderBy(F.desc("started_at"), F.desc("id")).offset((max(1, page) - 1) * size).limit(size)


def run_durations(runs: DataFrame) -> DataFrame:
    """(id, seconds): whole seconds from start to end, never negative, null without an end."""
    return runs.select("id", F.greatest(F.lit(0), T.iso_seconds(F.col("ended_at")) - T.iso_seconds(F.col("started_at"))).alias("seconds"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """(trigger_type, id, started_at) of each trigger's newest run."""
    best = F.max_by(F.struct("id", "started_at"), F.struct("started_at", "id"))
    return runs.groupBy("trigger_type").agg(best.alias("x")).select("trigger_type", "x.id", "x.started_at")


def close_duplicate_running(runs: DataFrame, status: str = "running") -> DataFrame:
    """(id, new_status): of all runs in `status` the newest stays, the others become failed; other runs keep theirs.

    The newest is found by an aggregate, not by a window over all runs in one task.
    """
    newest = runs.where(F.col("status") == status).agg(F.max(F.struct("started_at", "id"))["id"].alias("keep")).select("keep")
    return runs.join(F.broadcast(newest), F.lit(True), "left").select("id", F.when((F.col("status") == status) & (F.col("id") != F.col("keep")), "failed").otherwise(F.col("status")).alias("new_status"))


def brief_items(rows: DataFrame, most: int = 8) -> DataFrame:
    """The top items with their place, by rank, publication and id."""
    top = rows.orderBy(F.desc("rank_score"), F.desc_nulls_last("published_at"), "item_id").limit(most)
    order = Window.orderBy(F.desc("rank_score"), F.desc_nulls_last("published_at"), "item_id")  # over at most `most` rows
    return top.withColumn("place", F.row_number().over(order))


def brief(items: DataFrame, heading: str = "# 产业舆情简报", empty: str = "当前筛选范围内暂无可生成简报的情报。") -> DataFrame:
    """One row: markdown of brief_items(), the range of their display times and their ids in order."""
    line = F.concat_ws("\n", F.concat(F.lit("## "), F.col("place").cast("string"), F.lit(". "), "normalized_title"), F.concat(F.lit("- 综合价值分："), F.format_string("%.2f", "rank_score")), F.concat(F.lit("- 来源："), "source_name"), F.concat(F.lit("- 原文："), "url"), F.lit(""))
    each = F.array_sort(F.collect_list(F.struct("place", line.alias("line"), "item_id")))
    out = items.agg(each.alias("x"), F.min(display_time()).alias("time_range_start"), F.max(display_time()).alias("time_range_end"))
    body = F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda i: i["line"]), "\n")).otherwise(F.lit(empty))
    return out.select(F.concat(F.lit(heading + "\n\n"), body).alias("content_markdown"), "time_range_start", "time_range_end", F.to_json(F.transform("x", lambda i: i["item_id"])).alias("item_ids"))


def summary(processed: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of counts: items, important ones, those left to verify, enabled sources, runs."""
    p = processed.dropDuplicates(["id"]).agg(F.count("*").alias("total_items"), F.count_if(F.col("importance_level") == "high").alias("high_items"))
    s = sources.agg(F.count_if("enabled").alias("enabled_sources"))
    w = runs.agg(F.count("*").alias("runs"))
    return p.join(F.broadcast(s), F.lit(True)).join(F.broadcast(w), F.lit(True)).withColumn("evidence_to_verify", F.greatest(F.lit(0), F.col("total_items") - F.col("high_items")))


def trace(rows: DataFrame) -> DataFrame:
    """(item_id, node_trace): the processing of each item as a JSON list of node records."""
    node = lambda name, **out: F.struct(F.lit(name).alias("node"), F.to_json(F.struct(*[v.alias(k) for k, v in out.items()])).alias("output"))
    c = F.col
    steps = [
        node("collect", source=c("source_name"), url=c("url")), node("normalize", title=c("normalized_title"), length=c("content_length")),
        node("deduplicate", event=c("event_id")), node("classify_tag", importance=c("importance_level"), confidence=c("confidence")), node("rank", score=c("rank_score")), node("extract", summary=c("summary")),
    ]
    return rows.select("item_id", F.to_json(F.array(*steps)).alias("node_trace"))


def tagged(rows: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """rows whose label columns, single or lists, hold one of the wanted labels each; an empty wish asks nothing."""
    for column, labels in wanted.items():
        if labels:
            held = F.arrays_overlap(F.col(column), F.array(*[F.lit(x) for x in labels])) if rows.schema[column].dataType.typeName() == "array" else F.col(column).isin(*labels)
            rows = rows.where(held)
    return rows


def run_trace(runs: DataFrame) -> DataFrame:
    """(id, place, node, n, state): the nodes of each run in order with their counts; the failed count belongs to the last node.

    A node is done if it or a later one has a count, else open, and in a failed run the first open one has failed.
    """
    nodes = ("collected", "deduped", "classified", "extracted")
    counts = F.array(*[F.coalesce(F.col(f"{k}_count"), F.lit(0)) for k in nodes])
    last = F.coalesce(F.array_max(F.transform(counts, lambda x, i: F.when(x > 0, i))), F.lit(-1))
    each = runs.select("id", "status", last.alias("last"), F.posexplode(counts).alias("place", "n"))
    name = F.element_at(F.array(*[F.lit(k) for k in nodes]), F.col("place") + 1)
    state = F.when(F.col("place") <= F.col("last"), "done").when((F.col("status") == "failed") & (F.col("place") == F.col("last") + 1), "failed").otherwise("open")
    return each.select("id", "place", name.alias("node"), "n", state.alias("state"))


def recovered(runs: DataFrame) -> DataFrame:
    """runs with every one that never ended set to failed, and a note where it has none."""
    lost = F.col("ended_at").isNull()
    return runs.withColumns({"status": F.when(lost, "failed").otherwise(F.col("status")), "error_summary": F.when(lost, F.coalesce("error_summary", F.lit("interrupted"))).otherwise(F.col("error_summary"))})


def due_order(due: DataFrame) -> DataFrame:
    """due sources with their place: never fetched first, then the longest ago, then by id. Sources are a small dimension."""
    last = T.iso_seconds(T.or_empty(F.col("last_fetched_at"), F.col("last_checked_at")))
    return due.withColumn("place", F.row_number().over(Window.orderBy(last.asc_nulls_first(), F.asc("id"))))


def dashboard(runs: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: newest run, when the last scheduled run ended, totals of all runs, and whether there is anything for a brief."""
    r = runs.agg(F.max_by("id", F.struct("started_at", "id")).alias("latest_run"), F.max(F.when(F.col("trigger_type") == "interval", F.col("ended_at"))).alias("last_scheduled_end"), *[F.sum(f"{k}_count").alias(k) for k in ("collected", "failed")])
    p = processed.agg((F.count("*") > 0).alias("can_brief"))
    return r.join(F.broadcast(p), F.lit(True))
