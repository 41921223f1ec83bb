"""Queries of the general operators by name, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.operators import analysis as A
from skeinwork.operators import collect as C
from skeinwork.operators import ledger as L
from skeinwork.operators import overrides as O
from skeinwork.operators import serving as S
from skeinwork.operators import timestamps
from skeinwork.plans import sql
from skeinwork.session import read_table
from skeinwork.sources import cleaning, fetch, pages, similarity
from skeinwork.streaming import ingest
from skeinwork.vocab import NEV, REFERENCE

Query = Callable[[SparkSession, str], DataFrame]
NOW = sql.NOW

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = dict(sql.SQL)


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def items(self) -> DataFrame:
        return A.items_with_sources(self.raw_items, self.sources)

    def narrow(self) -> DataFrame:
        return A.narrow(self.items())

    def classified(self) -> DataFrame:
        return A.once(A.with_classes(self.items()).drop("raw_content", "content_excerpt"))

    def screened(self) -> DataFrame:
        return A.once(A.with_relevance(self.items()).drop("raw_content", "content_excerpt"))

    def analysed(self) -> DataFrame:
        return A.analysed(self.raw_items, self.sources, NOW)

    def joined(self, **options) -> DataFrame:
        return S.joined(self.processed_items, self.raw_items, self.sources, **options)


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def joined_names(c: str) -> F.Column:
    return F.array_join(c, "|").alias(c)


@query
def feed_rank_topk(t):
    return S.feed(t.joined(), NOW, time_range="all").select("item_id", "rank_score", "published_at", "source_name", "title")


@query
def feed_time_topk(t):
    return S.feed(t.joined(), NOW, time_range="all", sort="time", limit=100).select("item_id", "rank_score", S.display_time().alias("display_time"))


@query
def time_window_feed(t):
    return S.feed(t.joined(), NOW, time_range="30d", limit=200).select("item_id", "rank_score")


@query
def analysed_feed(t):
    """Relevance, clusters, classes and ranks from raw items to a top list."""
    rows = t.analysed().orderBy(F.desc("rank_score"), F.desc_nulls_last("published_s"), "id").limit(50)
    return rows.select("id", "industry", "cluster_key", "members", "reliable_sources", "importance", "rank_score")


@query
def relevance_screen(t):
    r = t.screened()
    return r.select("id", F.size("nev_terms").alias("n_nev"), F.size("ai_terms").alias("n_ai"), F.size("negative_terms").alias("n_negative"), "low_information", "is_relevant", "industry", "screen_confidence")


@query
def relevance_terms(t):
    return t.screened().select("id", joined_names("nev_terms"), joined_names("ai_terms"))


@query
def relevance_verdict_counts(t):
    return t.screened().groupBy("is_relevant", "industry", "screen_confidence").agg(F.count("*").alias("n"))


@query
def relevance_vs_stored(t):
    stored = F.element_at(F.create_map(*[F.lit(x) for kv in REFERENCE.hints.items() for x in kv]), F.col("relevance_industry"))
    return t.screened().groupBy(F.coalesce(stored, F.lit("")).alias("stored"), F.col("industry").alias("screened")).agg(F.count("*").alias("n"))


def _shells():
    """Title and body of made-up pages without information; the third is mostly furniture, the fourth is not."""
    slogan, more = sql.SHELLS[0], "盖世汽车 汽车销量 "
    return [(F.lit("下一页"), F.lit("x")), (F.col("title"), F.lit(slogan)), (F.col("title"), F.concat(F.lit(slogan + more), F.repeat(F.lit("新闻"), 100))), (F.col("title"), F.concat(F.lit("企业库 销量 查询 采购 项目"), F.repeat(F.lit("新闻"), 100)))]


@query
def low_information(t):
    """Of all items and of page turners, slogans and furniture made from their titles."""
    made = [A.once(t.raw_items.select((F.col("id") * 10 + k).alias("id"), title.alias("title"), body.alias("raw_content"))) for k, (title, body) in enumerate(_shells())]
    rows = t.items().select("id", "title", "raw_content", "content_excerpt")
    for m in made:
        rows = rows.unionByName(m.withColumn("content_excerpt", F.lit(None).cast("string")))
    return A.once(A.with_relevance(rows).where("low_information").select("id", "title"))


@query
def keyword_search(t):
    return t.joined(term="Battery").where(S.keyword("Battery")).select("item_id", "title")


@query
def importance_filter(t):
    return t.joined().where("importance_level = 'high'").select("item_id", "rank_score")


@query
def source_type_filter(t):
    return t.joined().where("source_type = 'government'").select("item_id", "source_name")


@query
def tag_filter(t):
    return t.classified().where(F.array_contains("event_types", "产能/交付") & F.array_contains("signals", "机会信号")).select("id")


@query
def published_window(t):
    s = T.iso_seconds(F.col("published_at"))
    return t.narrow().where(S.in_window(s, F.lit(sql.WINDOW[0]), F.lit(sql.WINDOW[1]))).select("id", s.alias("seconds"))


@query
def due_sources(t):
    return S.due_sources(t.sources, sql.DUE_AT).select("id", "name")


@query
def source_windows(t):
    return S.source_windows(t.sources, sql.DUE_AT)


@query
def sources_list(t):
    score = F.when(~F.isnan("reliability_score"), F.col("reliability_score"))
    label = F.element_at(F.create_map(*[F.lit(x) for kv in REFERENCE.source_labels.items() for x in kv]), F.col("type"))
    return t.sources.select("id", "name", "type", label.alias("type_label"), score.alias("reliability"), "enabled").orderBy("type", F.desc_nulls_last("reliability"), "id")


@query
def cluster_keys(t):
    return t.narrow().select("id", A.normal_title(F.col("title")).alias("normal_title"), A.cluster_key(F.col("title")).alias("cluster_key"))


@query
def cluster_sizes(t):
    return A.clusters(t.narrow()).select("cluster_key", "members").where("members > 1")


@query
def cluster_representative(t):
    return A.clusters(t.narrow()).select("cluster_key", "representative_id")


@query
def cluster_seen_range(t):
    return A.clusters(t.narrow()).select("cluster_key", "first_seen", "last_seen")


@query
def reliable_coverage(t):
    return A.clusters(t.narrow()).select("cluster_key", "reliable_sources")


@query
def event_report_counts(t):
    j = t.joined()
    return j.groupBy("event_id").agg(F.count("*").alias("reports"), F.count_distinct(F.when(F.col("reliability") >= 0.65, F.col("source_id"))).alias("reliable_sources"), F.array_join(F.array_sort(F.collect_set("source_name")), "|").alias("names"))


@query
def event_detail(t):
    j = t.joined().groupBy("event_id").agg(F.count("*").alias("reports"), F.max("rank_score").alias("best_score"))
    return t.event_clusters.join(j, F.col("id") == F.col("event_id"), "left").select("id", "canonical_title", F.coalesce("reports", F.lit(0)).alias("reports"), "best_score")


@query
def similar_reports(t):
    return S.similar_reports(t.joined())


@query
def new_items_anti(t):
    return t.raw_items.dropDuplicates(["id"]).join(t.processed_items.select(F.col("raw_item_id").alias("id")), "id", "left_anti").select("id", "status")


@query
def scoped_semi(t):
    late = t.processed_items.where("workflow_run_id is not null and rank_score >= 0.6").select(F.col("raw_item_id").alias("id"))
    return t.raw_items.dropDuplicates(["id"]).join(late, "id", "left_semi").select("id", "source_id")


@query
def orphan_candidates(t):
    off = t.sources.where("enabled").select(F.col("id").alias("source_id"))
    return t.raw_items.dropDuplicates(["id"]).join(off, "source_id", "left_anti").select("id", "source_id")


def _classes(name: str, *columns: str):
    QUERIES[name] = lambda spark, sf_dir: Tables(spark, sf_dir).classified().select("id", *[joined_names(c) if c in ("event_types", "subject_roles", "signals", "subtags") else F.col(c) for c in columns])


_classes("classify_events", "event_types")
_classes("classify_roles", "subject_roles")
_classes("classify_signals", "signals")
_classes("classify_industry", "class_industry")
_classes("classify_subtags", "subtags")
_classes("classify_importance", "importance", "class_confidence", "importance_reason", "actor_level")


@query
def item_tags(t):
    return A.tags(t.classified()).select("id", "dimension", "value")


@query
def tag_counts(t):
    return A.tags(t.classified()).groupBy("dimension", "value").agg(F.count("*").alias("n"))


@query
def tags_by_dimension(t):
    return A.tags(t.classified()).groupBy("id", "dimension").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|").alias("tag_values"))


@query
def entities(t):
    """Of all items, half of which get a fourth name of the vocabulary in front of their title."""
    named = t.items().withColumn("title", F.when(F.length("title") % 2 == 0, F.concat(F.lit(REFERENCE.actors[3] + " "), "title")).otherwise(F.col("title")))
    return A.once(A.with_classes(named).drop("raw_content", "content_excerpt")).select("id", F.explode("entities").alias("e")).select("id", F.col("e.text").alias("entity"), F.col("e.type").alias("entity_type"), F.col("e.concat_offset").alias("concat_offset"))


@query
def taxonomy_violations(t):
    rows = t.raw_items.dropDuplicates(["id"]).withColumn("labels", F.when(F.col("relevance_industry").isNotNull(), F.array("relevance_industry")))
    return A.violations(rows, "labels", tuple(k for k in REFERENCE.hints if k != "new_energy_vehicle")).select("id", F.array_join("unknown", "|").alias("unknown"))


@query
def rank_score(t):
    return t.analysed().select("id", "rank_score")


@query
def rank_breakdown(t):
    return t.analysed().select("id", "importance_score", "source_score", "freshness_score", "event_type_score", "coverage_score", "key_actor_score")


@query
def freshness_buckets(t):
    f = A.freshness(T.iso_seconds(F.col("published_at")), T.iso_seconds(F.col("fetched_at")), sql.FRESH_AT)
    return t.narrow().groupBy(f.alias("freshness")).agg(F.count("*").alias("n"))


@query
def summary_counts(t):
    return S.summary(t.processed_items, t.sources, t.workflow_runs)


@query
def latest_run_per_trigger(t):
    return S.latest_runs(t.workflow_runs)


@query
def runs_page(t):
    return S.run_page(t.workflow_runs, page=2).select("id", "started_at", "status")


@query
def run_durations(t):
    return S.run_durations(t.workflow_runs)


@query
def close_duplicate_running(t):
    """The newest run of each state is put among the runs once more, running."""
    runs = t.workflow_runs.select("id", "started_at", "status")
    return S.close_duplicate_running(runs.unionByName(runs.where("status <> 'failed'").select((F.col("id") + 1_000_000).alias("id"), "started_at", F.lit("running").alias("status"))))


@query
def run_counters(t):
    j = t.processed_items.dropDuplicates(["id"]).groupBy("workflow_run_id").agg(F.count("*").alias("extracted"), F.count_distinct("canonical_event_id").alias("deduped"))
    return t.workflow_runs.join(j, F.col("id") == F.col("workflow_run_id"), "left").select("id", F.coalesce("extracted", F.lit(0)).alias("extracted"), F.coalesce("deduped", F.lit(0)).alias("deduped"))


@query
def content_hash(t):
    return A.once(t.items().select("id", T.content_hash(F.col("title"), F.col("raw_content")).alias("content_hash")))


@query
def exact_duplicates(t):
    """Of all items and of government items delivered again under another id with other blanks."""
    again = t.items().where("source_type = 'government'").select((-F.col("id")).alias("id"), F.concat(F.lit(" "), "title").alias("title"), F.concat("raw_content", F.lit(" \n ")).alias("raw_content"))
    rows = t.items().select("id", "title", "raw_content").unionByName(again)
    return A.once(rows.select("id", T.content_hash(F.col("title"), F.col("raw_content")).alias("content_hash"))).groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query
def excerpt(t):
    return A.once(t.items().select("id", T.excerpt(F.col("raw_content")).alias("excerpt")))


@query
def compact_text(t):
    return t.documents.select("doc_id", T.compact(F.col("text")).alias("compact"))


@query
def url_dates(t):
    return t.raw_items.dropDuplicates(["id"]).select("id", T.url_date(F.col("url")).cast("string").alias("day")).where("day is not null")


@query
def text_dates(t):
    return A.once(t.raw_items.select("id", T.text_date(F.col("raw_content")).cast("string").alias("day")).where("day is not null"))


@query
def iso_dates(t):
    return t.raw_items.dropDuplicates(["id"]).select("id", T.iso_seconds(F.col("published_at")).alias("published_s"), T.iso_seconds(F.col("fetched_at")).alias("fetched_s"))


@query
def backfill_dates(t):
    return L.backfilled_dates(t.raw_items)


@query
def clean_url(t):
    return t.raw_items.dropDuplicates(["id"]).select("id", T.without_fragment(F.concat("url", F.lit("#top"))).alias("clean"))


@query
def candidate_urls(t):
    one = t.raw_items.dropDuplicates(["id"])
    return one.where(pages.usable_link(F.lit("https://www.example/"), F.col("url"), F.coalesce("title", F.lit("")))).select("id", "url")


@query
def substantive_body(t):
    return t.raw_items.where(pages.substantive(T.compact(F.col("raw_content")), T.compact(F.col("title")))).select("id").distinct()


@query
def page_titles(t):
    html = F.concat(F.lit("<html><head><title>"), F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</title></head><body><script>var a = 1;</script><p>x</p><a href='/a#b'>go on</a></body></html>"))
    rows = t.raw_items.dropDuplicates(["id"]).where("title is not null").select("id", "url", html.alias("html"))
    return pages.parsed(rows).select("id", "page.title", F.size("page.links").alias("links"))


@query
def key_facts(t):
    k = A.key_facts(A.with_classes(t.items()))
    return A.once(k.select("id", *[F.col(f"key_facts.{c}").alias(c if c != "when" else "when_text") for c in ("who", "what", "when", "where", "why", "impact", "evidence")]))


@query
def summary_sentence(t):
    return A.once(A.key_facts(A.with_classes(t.items())).select("id", "summary_sentence"))


@query
def impact_sentence(t):
    return A.once(A.key_facts(A.with_classes(t.items())).select("id", "impact_sentence"))


@query
def source_span(t):
    return A.once(A.key_facts(A.with_classes(t.items())).select("id", F.col("source_span.field").alias("field"), F.col("source_span.end").alias("end_at"), F.col("source_span.quote").alias("quote")))


@query
def brief_items(t):
    return S.brief_items(t.joined()).select("place", "item_id", "rank_score", "source_name")


@query
def brief_markdown(t):
    return S.brief(S.brief_items(t.joined()))


@query
def source_upsert(t):
    """Sources that are switched off come again under a new name; those of the government are added under other ids."""
    fields = ["name", F.lit(45).alias("fetch_interval_minutes"), F.lit(False).alias("enabled")]
    new = t.sources.where("not enabled").select("id", F.concat("name", F.lit(" (new)")).alias("name"), *fields[1:])
    extra = t.sources.where("type = 'government'").select((F.col("id") + 1000).alias("id"), *fields)
    return L.upserted(t.sources, new.unionByName(extra), "id", ("enabled", "last_fetched_at", "last_checked_at", "last_error")).select("id", "name", "fetch_interval_minutes", "enabled")


@query
def patch_source(t):
    change = F.array(F.struct(F.lit("industry_hint").alias("field"), F.lit("").alias("value")), F.struct(F.lit("fetch_interval_minutes").alias("field"), F.lit("15").alias("value")))
    patch = t.sources.where("type <> 'media'").select("id", F.explode(change).alias("x")).select("id", "x.*")
    return L.patched(t.sources, patch, "id").select("id", "industry_hint", "fetch_interval_minutes")


@query
def source_create(t):
    """Sources asked for by URL: those whose URL is known are refused."""
    asked = t.sources.where("enabled").select(F.concat("url", F.when(F.col("type") == "media", "").otherwise("/new")).alias("url"))
    known = t.sources.select("url", F.lit("conflict").alias("outcome")).distinct()
    return asked.join(known, "url", "left").select("url", F.coalesce("outcome", F.lit("created")).alias("outcome"))


@query
def guarded_delete(t):
    """Sources that no item points at, of all and one more."""
    base = t.sources.select("id", "name").unionByName(t.sources.agg((F.max("id") + 1).alias("id"), F.lit("nobody's").alias("name")))
    return L.deletable(base, t.raw_items, "id", "source_id").select("id", "name")


@query
def ledger_enrich(t):
    batch = t.raw_items.where("status = 'processed'").select("url", F.lit("screened").alias("relevance_reason")).distinct()
    return L.enriched(t.raw_items.select("id", "url", "relevance_reason").dropDuplicates(["id"]), batch, "url", ("relevance_reason",)).select("id", "relevance_reason")


@query
def insert_or_enrich(t):
    """A batch of rejected items and of new addresses against the ledger of the others: what is known is enriched, the rest inserted."""
    raw = t.raw_items.select("id", "url", "status", "relevance_reason").dropDuplicates(["id"])
    ledger = raw.where("status <> 'new'")
    batch = raw.select("url", F.concat("status", F.lit(" again")).alias("relevance_reason"))
    out = L.enriched(ledger, batch, "url", ("relevance_reason",)).select("url", "relevance_reason", F.lit(False).alias("inserted"))
    return out.unionByName(L.new_rows(batch, ledger, "url").select("url", "relevance_reason", F.lit(True).alias("inserted")))


@query
def moved_urls(t):
    """Old addresses of items replaced by those of the sources' table."""
    return L.rewritten_urls(t.sources.select("id", "url", F.col("url").alias("canonical_url")), sql.MOVED).select("id", "url", "canonical_url")


@query
def json_fields(t):
    return t.raw_items.dropDuplicates(["id"]).select("id", F.coalesce(F.array_join(F.from_json("relevance_matched_terms_json", "array<string>"), "|"), F.lit("")).alias("terms"))


@query
def profile_counts(t):
    rows = t.narrow().select("source_type", "status", F.coalesce("relevance_industry", F.lit("none")).alias("industry"))
    return rows.groupingSets([["source_type"], ["status"], ["industry"]], "source_type", "status", "industry").agg(F.count("*").alias("n"))


@query
def class_overrides(t):
    one = lambda *x: F.array(*[F.lit(v) for v in x])
    payload = F.to_json(F.struct(one("动力电池").alias("industry_subtags"), one("产品发布").alias("event_types"), F.col("level").alias("importance_level"), one("投资机构").alias("subject_roles"), one("机会信号").alias("signal_attributes")))
    answers = t.processed_items.groupBy(F.col("raw_item_id").alias("id")).agg(F.max("importance_level").alias("level")).select("id", payload.alias("payload"))
    return O.with_class_overrides(t.classified(), answers).select("id", "importance", "class_mode", joined_names("event_types"))


@query
def bounded_text(t):
    return A.once(t.items().select("id", O.bounded_text().alias("bounded")).select("id", F.length("bounded").alias("size"), F.md5("bounded").alias("digest")))


@query
def event_tumbling(t):
    day = F.date_trunc("day", F.col("ts"))
    return t.events.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query
def event_dedupe(t):
    return L.first_by(t.events, "user_id", F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query
def cosine_topk(t):
    return similarity.nearest(t.embeddings, "vec_id", "embedding", every=50, k=5)


@query
def item_trace(t):
    """Each node's record, field by field."""
    nodes = S.trace(t.joined()).select("item_id", F.from_json("node_trace", "array<struct<node:string,output:string>>").alias("n"))
    field = lambda k, name: F.get_json_object(F.col("n")[k]["output"], f"$.{name}")
    names = F.array_join(F.transform("n", lambda x: x["node"]), ">").alias("nodes")
    return nodes.select("item_id", names, field(0, "url").alias("url"), field(1, "length").cast("long").alias("length"), field(2, "event").cast("long").alias("event"), field(3, "importance").alias("importance"), field(4, "score").cast("double").alias("score"), field(5, "summary").alias("summary"))


@query
def run_trace(t):
    """Each run's nodes with their counts, in order, and what failed."""
    return S.run_trace(t.workflow_runs).select("id", "place", "node", "n", "state")


@query
def runs_total(t):
    """A page of runs with the number of all and its own place among the pages."""
    return S.run_page(t.workflow_runs, page=1, size=20).select("id", "status").join(t.workflow_runs.agg(F.count("*").alias("total")), how="cross").withColumn("pages", F.ceil(F.col("total") / 20))


@query
def recovered_runs(t):
    """After a crash: runs without an end are failed, whatever state they were left in."""
    return S.recovered(t.workflow_runs).select("id", "status", "error_summary")


@query
def dashboard(t):
    return S.dashboard(t.workflow_runs, t.processed_items)


@query
def due_sources_order(t):
    return S.due_order(S.due_sources(t.sources, sql.DUE_AT)).select("id", "place")


@query
def item_detail(t):
    """Each item with its tags, the number of reports of its event and its place among them."""
    tags = A.tags(t.classified()).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|").alias("tag_values"))
    j = t.joined()
    reports = j.where("event_id is not null").groupBy("event_id").agg(F.count("*").alias("reports"))
    places = S.similar_reports(j).select("item_id", "place")
    out = j.select("item_id", "raw_id", "event_id", "title", "source_name").join(tags.withColumnRenamed("id", "raw_id"), "raw_id", "left")
    return out.join(reports, "event_id", "left").join(places, "item_id", "left").select("item_id", "title", "source_name", "tag_values", "reports", "place")


@query
def event_reports(t):
    """Each event with its first eight reports by reliability, publication and id."""
    j = S.similar_reports(t.joined()).where("place <= 8")
    lists = j.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_id"))), lambda x: x["item_id"].cast("string")), "|").alias("items"))
    return t.event_clusters.select("id", "canonical_title").join(lists, F.col("id") == F.col("event_id"), "left").select("id", "canonical_title", F.coalesce("items", F.lit("")).alias("items"))


@query
def tagged_feed(t):
    """The feed under all five tag filters at once: each asks for one of its labels."""
    wanted = {"class_industry": (NEV,), "event_types": ("政策/监管", "产能/交付", "产品发布"), "signals": ("政策信号", "机会信号", "竞争格局变化"), "subject_roles": ("政府/监管机构", "整车企业", REFERENCE.default_role), "subtags": tuple(REFERENCE.subtags[NEV])[:4]}
    rows = t.joined().join(t.classified().select(F.col("id").alias("raw_id"), *wanted), "raw_id")
    return S.feed(S.tagged(rows, wanted), NOW, time_range="all", limit=200).select("item_id", "rank_score")


@query
def decorated_feed(t):
    """Feed rows as they are shown: label of the source's kind, display time, at most eight tags."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in REFERENCE.source_labels.items() for x in kv]), F.col("source_type"))
    tags = A.tags(t.classified()).where("ord < 8").groupBy(F.col("id").alias("raw_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), "|").alias("visible_tags"))
    rows = S.feed(t.joined(), NOW, time_range="all", limit=200)
    return rows.join(tags, "raw_id").select("item_id", label.alias("type_label"), S.display_time().alias("display_time"), "visible_tags")


@query
def rank_reasons(t):
    return t.analysed().select("id", A.rank_reason().alias("reason"))


@query
def relevance_reasons(t):
    return t.screened().select("id", A.relevance_reason().alias("reason"))


@query
def evidence_strings(t):
    return t.classified().select("id", F.array_join(A.evidence(), "|").alias("evidence"))


@query
def backfill_rank(t):
    """Missing dates found in text or URL, and the rank each processed item gets with them."""
    dated = L.backfilled_dates(t.raw_items).select("id", F.unix_timestamp(F.to_timestamp("day")).alias("found_s"))
    rows = t.analysed().join(dated, "id")
    return A.with_rank(rows.withColumn("published_s", F.coalesce("published_s", "found_s")), NOW).select("id", "rank_score", "freshness_score")


@query
def taxonomy_table(t):
    rows = [("event_type", k, i) for i, k in enumerate(REFERENCE.events)] + [("subject_role", k, i) for i, k in enumerate(REFERENCE.roles)] + [("signal_attribute", k, i) for i, k in enumerate(REFERENCE.signals)]
    return t.spark.createDataFrame(rows, "dimension string, value string, place int")


@query
def ranking_rules(t):
    rows = [("importance", k, float(v)) for k, v in REFERENCE.importance_scores.items()] + [("event_type", k, float(v)) for k, v in REFERENCE.event_scores.items()]
    return t.spark.createDataFrame(rows, "part string, label string, score double")


def _landing(t) -> DataFrame:
    """A landing table of markup made of the items: each a page that links to the item, among navigation."""
    text = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(F.lit("<html><head><title>list</title><script>var a = '<a href=/no>no</a>';</script></head><body><nav><a href='/about'>About this company</a><a href='/login'>Sign in here</a></nav><ul><li><a href='"), text(F.col("url")), F.lit("'>"), text(F.col("title")), F.lit("</a></li></ul></body></html>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><rss><channel><item><title>"), text(F.col("title")), F.lit("</title><link>"), text(F.col("url")), F.lit("</link><pubDate>"), text(F.coalesce("published_at", F.lit(""))), F.lit("</pubDate></item><item><title>no link</title></item></channel></rss>"))
    one = t.raw_items.select("id", "source_id", "url", "title", "published_at").dropDuplicates(["id"]).where(F.trim("title") != "")
    return one.select("id", "source_id", F.lit("https://www.example/").alias("url"), "published_at", html.alias("html"), xml.alias("xml"))


@query
def listing_candidates(t):
    """Pages to candidates: parsed links, article predicate, the source's window, the first 50 a source."""
    found = C.listing_candidates(_landing(t))
    return C.within(found, t.sources.where("enabled").select("id", F.lit(sql.WINDOW[0]).alias("window_start"), F.lit(sql.WINDOW[1]).alias("window_end")), 50).select("source_id", "url")


@query
def feed_entries(t):
    """Feeds to candidates, the first 50 a source."""
    return C.within(C.feed_candidates(_landing(t)), t.sources.select("id", F.lit(0).alias("window_start"), F.lit(NOW).alias("window_end")), 50).select("source_id", "url")


@query
def candidate_union(t):
    """Candidates of listings and feeds together, counted by origin; the same address of both counts twice."""
    landing = _landing(t)
    both = C.listing_candidates(landing).select(*C.CANDIDATE).unionByName(C.feed_candidates(landing).select(*C.CANDIDATE))
    return both.groupBy("source_id", "origin").agg(F.count("*").alias("n"))


@query
def normalised_items(t):
    """Items as candidates, normalised: trimmed title, address without fragment, excerpt and hash; blank ones set aside."""
    good, bad = L.normalised(t.raw_items.select("id", "source_id", F.concat("url", F.lit("#top")).alias("url"), "title", "raw_content"))
    shown = good.select("id", "title", "canonical_url", "content_excerpt", "content_hash", "status")
    return A.once(shown.unionByName(bad.select("id", "title", F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("string").alias("content_excerpt"), F.lit(None).cast("string").alias("content_hash"), F.lit("rejected").alias("status"))))


@query
def insert_clusters(t):
    """Events to be opened: keys of the items that no event has yet."""
    rows = t.narrow()
    return C.new_clusters(rows, A.clusters(rows), t.event_clusters, A.cluster_key).select("cluster_key", "canonical_title", "representative_id", "duplicate_count")


@query
def cluster_lookup(t):
    return C.known_clusters(A.clusters(t.narrow()), t.event_clusters, A.cluster_key)


@query
def mark_processed(t):
    """Status of every item after a run that processes what is relevant and enabled."""
    s = t.screened()
    return C.marked(t.raw_items, s.where("enabled and is_relevant"), s.where("enabled and not is_relevant"))


@query
def insert_processed(t):
    """Rows to be added: relevant items that aren't processed yet."""
    done = t.processed_items.select(F.col("raw_item_id").alias("id"))
    return t.analysed().join(done, "id", "left_anti").select("id", "cluster_key", "importance", "class_confidence", "rank_score")


@query
def first_per_source(t):
    """The newest three fetches of each source."""
    rows = t.raw_items.select("id", "source_id", "fetched_at").dropDuplicates(["id"])
    return C.first_of_each(rows, "source_id", 3, F.desc("fetched_at"), F.asc("id"))


@query
def brief_row(t):
    """A brief as it is stored: kind, title, number of items and text."""
    return S.brief(S.brief_items(t.joined())).select(F.lit("daily").alias("brief_type"), F.concat(F.lit("产业舆情简报 "), F.substring(F.coalesce("time_range_end", F.lit("")), 1, 10)).alias("title"), F.size(F.from_json("item_ids", "array<bigint>")).alias("n_items"), F.length("content_markdown").alias("size"))


@query
def clean_text(t):
    """Every item's text freed of markup and code."""
    return A.once(cleaning.cleaned(t.raw_items, "id", "raw_content"))


@query
def clean_plain(t):
    """Texts that hold no sign of markup or code come out of the cleaner as one line and otherwise unchanged."""
    return A.once(cleaning.cleaned(t.raw_items.where(~F.coalesce(F.col("raw_content").rlike(r"[<{}&;@]|/\*"), F.lit(False))), "id", "raw_content"))


@query
def decoded_titles(t):
    """Titles as bytes of a page or feed, decoded and told apart."""
    xml = F.when(F.length("title") % 2 == 0, F.lit("<?xml version='1.0'?><rss>")).otherwise(F.lit("<html>"))
    rows = t.raw_items.select("id", F.encode(F.concat(xml, F.coalesce("title", F.lit(""))), "UTF-8").alias("payload"), F.lit("text/html; charset=utf-8").alias("content_type"))
    return A.once(fetch.decoded(rows))


@query
def collect_new(t):
    """A manual run: candidates of the pages that the ledger of processed items doesn't hold yet, normalised."""
    good, _ = L.normalised(C.listing_candidates(_landing(t)))
    ledger = t.raw_items.where("status = 'processed'").select("url").distinct()
    return L.new_rows(good.select("url", "source_id", "title"), ledger, "url").select("url", "title")


@query
def scoped_raw(t):
    """Raw items of each run, numbered in the order they were fetched."""
    runs = t.processed_items.where("workflow_run_id is not null").select(F.col("raw_item_id").alias("id"), "workflow_run_id").distinct()
    raw = t.raw_items.select("id", "fetched_at").dropDuplicates(["id"])
    return L.numbered(runs.join(raw, "id"), "workflow_run_id", F.asc("fetched_at"), F.asc("id")).select("workflow_run_id", "id", "place")


@query
def trace_tags(t):
    """Each item's tags in the order of dimension and label."""
    return A.tags(t.classified()).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dimension", "value"))), lambda x: F.concat(x["dimension"], F.lit("="), x["value"])), "|").alias("tags"))


@query
def cluster_trace(t):
    """Each cluster of several items: title of its representative, number of items, its sources' names."""
    rows = t.narrow().withColumn("cluster_key", A.cluster_key(F.col("title")))
    sets = rows.groupBy("cluster_key").agg(F.array_join(F.array_sort(F.collect_set("source_name")), "|").alias("source_names"))
    groups = A.clusters(rows).where("members > 1").join(sets, "cluster_key")
    titles = rows.select(F.col("id").alias("representative_id"), F.col("title").alias("canonical_title"))
    return groups.join(titles, "representative_id").select("cluster_key", "canonical_title", F.col("members").alias("raw_item_count"), "source_names")


@query
def stream_tumbling(t):
    w = ingest.tumbling_counts(t.events)
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_sessions(t):
    s = ingest.sessions(t.events)
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSS").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss.SSS").alias("end"), "n")


@query
def advanced_sources(t):
    """Sources after a run: those with a new item have moved on, all enabled ones were checked."""
    return ingest.advanced_sources(t.sources, t.raw_items.where("status = 'new'"), "2026-01-01T00:00:00Z").select("id", "last_fetched_at", "last_checked_at", "last_error")


@query
def p5_found(t):
    return timestamps.found(t.raw_items, t.sources)


