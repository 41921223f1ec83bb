"""Relevance, clustering, classification and ranking of items, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.session import cut
from skeinwork.vocab import AI, NEV, REFERENCE, Vocabulary


#: Titles of page turners.
TURNERS = ("最后一页", "上一页", "下一页", "尾页")


def items_with_sources(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """Deliveries joined to their source; sources are a dimension that Spark broadcasts while it is small.

    Adds source_name, source_type, industry_hint, reliability (null if missing or no number), enabled. Items without a source are kept
    out, as in every query over items. Repeated deliveries stay: narrow columns come first, in the scan, then once() collapses them, so
    that no text is shuffled to find them.
    """
    score = F.col("reliability_score")
    dim = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"), "industry_hint", F.when(~F.isnan(score), score).alias("reliability"), "enabled", "site_tz", "site_locale")
    return raw.join(dim, "source_id")


def once(rows: DataFrame, key: str = "id") -> DataFrame:
    """One row a key, of rows that are equal where the key is; texts among the columns would be shuffled, so drop them before."""
    return rows.dropDuplicates([key])


def narrow(items: DataFrame) -> DataFrame:
    """items once each, with the length of the text as `richness` in place of the texts."""
    return once(items.withColumn("richness", richness()).drop("raw_content", "content_excerpt"))


def full_text(summary: Column | None = None) -> Column:
    """Title, content and excerpt with one blank between, nulls as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "raw_content", "content_excerpt")])


def with_relevance(items: DataFrame, vocab: Vocabulary = REFERENCE) -> DataFrame:
    """Adds nev_terms, ai_terms, negative_terms, is_relevant, industry, confidence of the rule-based screen.

    Page turners and site slogans are rejected with confidence 0.9, texts with only negative terms likewise, texts without terms with
    0.85; others belong to the industry with more terms, ties to AI, with 0.72. Null fields count as empty.
    """
    shells = ("资讯栏目每天对新能源电动汽车行业的新闻资讯第一时间报道", "盖世汽车提供及时全面的:汽车销量、汽车资讯、汽车行业新闻、汽车销量排行榜、新能源汽车资讯、电动汽车资讯", "企业库 销量 查询 采购 项目")  # fixed values
    furniture = ("盖世汽车", "汽车销量", "汽车资讯", "汽车行业新闻", "新能源汽车资讯", "电动汽车资讯", "资讯栏目", "第一时间报道")  # fixed values
    out = items.withColumn("__text", full_text()).withColumn("__low", F.lower("__text"))
    text, low = F.col("__text"), F.col("__low")
    out = out.withColumns({"nev_terms": T.matched(text, low, vocab.relevance[NEV]), "ai_terms": T.matched(text, low, vocab.relevance[AI]), "negative_terms": T.matched(text, low, vocab.negative)})
    title = F.trim(F.coalesce("title", F.lit("")))
    body = F.trim(T.or_empty(F.col("raw_content"), F.col("content_excerpt")))
    rest = F.btrim(F.replace(body, F.when(title != "", title).otherwise("\x00")), F.lit(" -_｜|：:"))
    mostly = (rest != "") & (sum((rest.contains(w).cast("int") for w in furniture), F.lit(0)) >= 2)
    low_information = title.isin(*TURNERS) | (T.any_of(text, shells) & ((F.length(body) < 140) | mostly))
    nev, ai, negative = F.size("nev_terms"), F.size("ai_terms"), F.size("negative_terms")
    out = out.withColumn("low_information", low_information)
    relevant = ~F.col("low_information") & ((nev > 0) | (ai > 0))
    industry = F.when(relevant, F.when((ai > 0) & ((nev == 0) | (ai >= nev)), AI).otherwise(NEV)).otherwise("")
    confidence = F.when(F.col("low_information"), 0.9).when(relevant, 0.72).when(negative > 0, 0.9).otherwise(0.85)
    return out.withColumns({"is_relevant": relevant, "industry": industry, "screen_confidence": confidence}).drop("__text", "__low")


def relevance_reason(vocab: Vocabulary = REFERENCE) -> Column:
    """The verdict of a screened row in words. Fixed values, in the order of the rules."""
    negative = F.size("negative_terms") > 0
    meeting = F.arrays_overlap("negative_terms", F.array(*[F.lit(x) for x in vocab.meeting]))
    return (
        F.when(F.col("low_information"), F.when(F.trim(F.coalesce("title", F.lit(""))).isin(*TURNERS), "正文信息不足：疑似列表页或分页导航，不应进入产业情报库").otherwise("正文信息不足：疑似来源栏目模板或站点宣传语，不应进入产业情报库"))
        .when(F.col("is_relevant"), F.when(F.col("industry") == AI, "命中人工智能产业关键词").otherwise("命中新能源汽车产业关键词"))
        .when(negative & meeting, "内部会议，未命中产业关键词").when(negative, "内部会议或泛社会新闻，未命中产业关键词")
        .otherwise("未命中产业关键词，来源行业提示不足以入库")
    )


def evidence() -> Column:
    """What speaks for a classified row: its event types, the source's kind if known, and the level of the names in it if there are any."""
    events = F.concat(F.lit("事件类型命中："), F.array_join("event_types", ", "))
    kind = F.when(F.coalesce("source_type", F.lit("")) != "", F.concat(F.lit("来源类型："), "source_type"))
    level = F.when(F.col("actor_level") != "none", F.concat(F.lit("关键主体等级："), "actor_level"))
    return F.array_compact(F.array(events, kind, level))


def normal_title(title: Column) -> Column:
    """Lower case, letters, marks, digits and underscores only."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", "")


def cluster_key(title: Column) -> Column:
    """Key of the event a title reports: five topics first, else the first 28 characters of the normal title."""
    t = normal_title(title)
    has = lambda *words: T.any_of(t, words)
    return (
        F.when(has("电池", "battery") & has("政策", "监管", "policy"), "battery-policy").when(has("英伟达", "nvidia", "ai芯片"), "nvidia-ai-chip")
        .when(has("openai", "智能体", "agent"), "openai-agent").when(has("宁德时代", "catl"), "catl-capacity")
        .when(has("比亚迪", "byd") & has("海外", "oversea", "export"), "byd-overseas").otherwise(F.substring(t, 1, 28))
    )


def richness() -> Column:
    return F.length(T.or_empty(F.col("raw_content"), F.col("content_excerpt")))


def clusters(items: DataFrame, least_reliability: float = 0.65) -> DataFrame:
    """One row a cluster key: members, reliable sources, first and last fetch as text, and the representative's id.

    items need reliability, and either richness or the texts. The representative has the highest (reliability, 0.5 if null or 0; length; instant, 0 if unknown), then the
    smallest id. Everything is one partial and one final aggregate, so a hot key costs a row a task.
    """
    size = F.col("richness") if "richness" in items.columns else richness()
    rank = F.struct(F.coalesce(F.when(F.col("reliability") != 0, F.col("reliability")), F.lit(0.5)), size, F.coalesce(T.iso_seconds(F.col("published_at")), F.lit(0)), -F.col("id"))
    return items.groupBy(cluster_key(F.col("title")).alias("cluster_key")).agg(
        F.count("*").alias("members"), F.count_distinct(F.when(F.col("reliability") >= least_reliability, F.col("source_id"))).alias("reliable_sources"),
        F.min("fetched_at").alias("first_seen"), F.max("fetched_at").alias("last_seen"), F.max_by("id", rank).alias("representative_id"),
    )


def _labels(text: Column, rules: dict[str, tuple[str, ...]], also: dict[str, Column], default: str) -> Column:
    hits = [F.when(T.any_of(text, words) | also.get(label, F.lit(False)), F.lit(label)) for label, words in rules.items()]
    found = F.array_compact(F.array(*hits))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(default)))


def with_classes(items: DataFrame, vocab: Vocabulary = REFERENCE) -> DataFrame:
    """Adds class_industry, subtags, event_types, subject_roles, signals, importance, importance_reason, class_confidence, entities, actor_level.

    Words count as written, anywhere in title, content and excerpt. A known relevance_industry wins over the source's first hint, that
    over the words. Lists are in the order of the rules and never empty.
    """
    out = items.withColumn("__text", full_text())
    text = F.col("__text")
    government = F.coalesce(F.col("source_type") == "government", F.lit(False))
    entity = lambda a: F.when(F.instr(text, a) > 0, F.struct(F.lit(a).alias("text"), F.lit("agency" if a in vocab.agencies else "company").alias("type"), (F.instr(text, a) - 1).alias("concat_offset"), (F.instr(text, a) - 1 + len(a)).alias("end"), F.lit(0.9).alias("confidence")))
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in vocab.hints.items() for x in kv]), F.trim(F.get(F.split(F.coalesce("industry_hint", F.lit("")), ","), F.lit(0))))
    out = out.withColumns({
        "class_industry": F.when(F.col("relevance_industry").isin(*vocab.industries), F.col("relevance_industry")).otherwise(F.coalesce(hint, F.when(T.any_of(text, vocab.industry_words), NEV).otherwise(AI))),
        "event_types": _labels(text, vocab.events, {"政策/监管": government, "龙头企业动向": T.any_of(text, vocab.actors)}, vocab.default_event),
        "subject_roles": _labels(text, vocab.roles, {"政府/监管机构": government}, vocab.default_role),
        "entities": F.array_compact(F.array(*[entity(a) for a in vocab.actors])),
    })
    subtags = F.lit(None).cast("array<string>")
    for industry in vocab.industries:
        subtags = F.when(F.col("class_industry") == industry, _labels(text, vocab.subtags[industry], {}, next(iter(vocab.subtags[industry])))).otherwise(subtags)
    events = F.col("event_types")
    among = lambda *names: F.arrays_overlap(events, F.array(*[F.lit(n) for n in names]))
    signals = F.array_compact(F.array(*[F.when(among(*of) if of else T.any_of(text, vocab.regional_words), F.lit(s)) for s, of in vocab.signals.items()]))
    out = out.withColumns({"subtags": subtags, "signals": F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit(vocab.default_signal))), "actor_level": F.when(F.size("entities") > 0, "core").otherwise("none")})
    strong = F.coalesce(F.col("source_type").isin("government", "exchange"), F.lit(False)) | among("政策/监管", "风险/负面舆情")
    core = (F.col("actor_level") == "core") | among("技术突破", "供应链变化", "并购/重组")
    medium = T.any_of(text, vocab.medium_words)
    pick = lambda a, b, c, d: F.when(strong, a).when(core, b).when(medium, c).otherwise(d)
    return out.withColumns({
        "importance": pick("high", "high", "medium", "low"), "class_confidence": pick(0.82, 0.78, 0.68, 0.55),
        "importance_reason": pick("命中政府/监管、交易所或风险类高置信信号。", "涉及核心主体或可能改变产业格局的事件。", "包含明确进展，但影响范围仍需后续验证。", "产业影响较弱或事实支撑不足。"),
    }).drop("__text")


def tags(classified: DataFrame) -> DataFrame:
    """(id, dimension, value, ord): one row a tag of each item, dimensions in their order."""
    dims = {"industry": F.array("class_industry"), "industry_subtag": F.col("subtags"), "event_type": F.col("event_types"), "subject_role": F.col("subject_roles"), "signal_attribute": F.col("signals")}
    tagged = lambda k: lambda x: F.struct(F.lit(k).alias("dimension"), x.alias("value"))
    each = F.flatten(F.array(*[F.transform(v, tagged(k)) for k, v in dims.items()]))
    return classified.select("id", F.posexplode(each).alias("ord", "t")).select("id", "t.dimension", "t.value", "ord")


def violations(rows: DataFrame, labels: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose label list holds values outside the taxonomy, with them as `unknown`; null lists hold none."""
    unknown = F.array_except(F.coalesce(F.col(labels), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in allowed]))
    return rows.withColumn("unknown", unknown).where(F.size("unknown") > 0)


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def freshness(published: Column, fetched: Column, now: int) -> Column:
    """Score of the age at `now` (seconds since 1970) of the publication, else of the fetch; unknown 0.3, future 1."""
    hours = (F.lit(now) - F.coalesce(published, fetched)) / 3600.0
    return F.when(hours.isNull(), 0.3).when(hours <= 6, 1.0).when(hours <= 24, 0.85).when(hours <= 72, 0.6).when(hours <= 168, 0.35).otherwise(0.15)


def with_rank(rows: DataFrame, now: int, vocab: Vocabulary = REFERENCE) -> DataFrame:
    """Adds importance_score, source_score, freshness_score, event_type_score, coverage_score, key_actor_score and rank_score.

    rows need importance, class_confidence, reliability, event_types, reliable_sources, actor_level, published_s, fetched_s. Parts and
    total are rounded to 4 places, the total from unrounded parts.
    """
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in vocab.importance_scores.items() for x in kv]), F.col("importance")), F.lit(0.4))
    events = F.create_map(*[F.lit(x) for kv in vocab.event_scores.items() for x in kv])
    actor = F.create_map(*[F.lit(x) for kv in {"core": 1.0, "important": 0.75, "normal": 0.45, "none": 0.0}.items() for x in kv])
    n = F.col("reliable_sources")
    parts = {
        "importance_score": level * F.coalesce(F.lit(0.7) + F.lit(0.3) * _clamped(F.col("class_confidence")), F.lit(1.0)),
        "source_score": _clamped(F.coalesce("reliability", F.lit(0.5))),
        "freshness_score": freshness(F.col("published_s"), F.col("fetched_s"), now),
        "event_type_score": F.coalesce(F.array_max(F.transform("event_types", lambda e: F.coalesce(F.element_at(events, e), F.lit(0.4)))), F.lit(0.4)),
        "coverage_score": F.when(n <= 1, 0.2).otherwise(F.least(F.lit(1.0), F.log2(n + 1.0) / F.log2(F.lit(6.0)))),
        "key_actor_score": F.coalesce(F.element_at(actor, F.col("actor_level")), F.lit(0.0)),
    }
    weights = dict(zip(parts, (0.35, 0.20, 0.15, 0.15, 0.10, 0.05)))
    out = rows.withColumns({f"__{k}": v for k, v in parts.items()})
    total = sum((F.col(f"__{k}") * w for k, w in weights.items()), F.lit(0.0))
    return out.withColumn("rank_score", F.round(total, 4)).withColumns({k: F.round(f"__{k}", 4) for k in parts}).drop(*[f"__{k}" for k in parts])


def rank_reason() -> Column:
    """The scores of a ranked row in words."""
    two = lambda c: F.format_string("%.2f", F.col(c))
    return F.concat_ws(
        " | ", F.concat(F.lit("重要性 "), "importance", F.lit(" 得分 "), two("importance_score")), F.concat(F.lit("来源权威性得分 "), two("source_score")), F.concat(F.lit("时效性得分 "), two("freshness_score")),
        F.concat(F.lit("事件类型 "), F.array_join("event_types", ", "), F.lit(" 得分 "), two("event_type_score")),
        F.concat(F.lit("可靠相似报道 "), F.col("reliable_sources").cast("string"), F.lit(" 个，覆盖度得分 "), two("coverage_score")), F.concat(F.lit("关键主体等级 "), "actor_level", F.lit(" 得分 "), two("key_actor_score")),
    )


def analysed(raw: DataFrame, sources: DataFrame, now: int) -> DataFrame:
    """The whole chain over enabled sources: relevance, cluster statistics of the accepted items, classes, rank.

    All that comes from the text is computed in the scan; the narrow rows that are left are written once to the shared folder and feed
    both the cluster statistics and the join back on the key, so no text is read twice or shuffled.
    """
    accepted = with_relevance(items_with_sources(raw, sources).where("enabled")).where("is_relevant")
    dated = with_classes(accepted).withColumns({"cluster_key": cluster_key(F.col("title")), "richness": richness(), "published_s": T.iso_seconds(F.col("published_at")), "fetched_s": T.iso_seconds(F.col("fetched_at"))})
    rows = cut(once(dated.drop("raw_content", "content_excerpt")))
    stats = clusters(rows)
    return with_rank(rows.join(stats.select("cluster_key", "members", "reliable_sources", "representative_id"), "cluster_key"), now)


def newest_first(group: str, *order: Column) -> Window:
    return Window.partitionBy(group).orderBy(*order)


def key_facts(rows: DataFrame) -> DataFrame:
    """Adds key_facts, summary_sentence, impact_sentence and source_span by rules, from classified rows."""
    body = F.coalesce(*[F.when(x != "", x) for x in (T.compact(F.col(c)) for c in ("raw_content", "content_excerpt", "title"))], F.lit(""))
    lead = F.coalesce(*[F.when(x != "", x) for x in (T.compact(F.col(c)) for c in ("content_excerpt", "raw_content", "title"))], F.lit(""))
    signals = F.array_join(F.slice("signals", 1, 2), "、")
    impact = (
        F.when(F.col("importance") == "high", F.concat(F.lit("对"), "class_industry", F.lit("研究具有较高优先级，主要体现为"), signals, F.lit("，建议优先追踪政策落地、主体动作和后续相似报道。")))
        .when(F.col("importance") == "medium", F.concat(F.lit("对"), "class_industry", F.lit("具有跟踪价值，主要体现为"), signals, F.lit("，建议纳入观察列表。")))
        .otherwise(F.concat(F.lit("对"), "class_industry", F.lit("影响有限，适合作为背景素材保留。")))
    )
    out = rows.withColumns({"impact_sentence": impact, "__body": body})
    field = F.when(F.length("raw_content") > 0, "raw_content").when(F.length("content_excerpt") > 0, "content_excerpt").otherwise("title")
    whole = F.when(F.length("raw_content") > 0, F.col("raw_content")).when(F.length("content_excerpt") > 0, F.col("content_excerpt")).otherwise(F.coalesce("title", F.lit("")))
    who = T.or_empty(F.get("entities", F.lit(0))["text"], F.col("author"), F.lit("相关主体"))
    return out.withColumns({
        "key_facts": F.struct(who.alias("who"), F.col("title").alias("what"), T.or_empty(F.col("published_at"), F.col("fetched_at")).alias("when"), F.lit("公开来源披露").alias("where"), F.col("importance_reason").alias("why"), F.col("impact_sentence").alias("impact"), F.substring("__body", 1, 180).alias("evidence")),
        "summary_sentence": F.concat(F.substring(lead, 1, 150), F.lit(" 该信息被识别为"), F.array_join(F.slice("event_types", 1, 2), "、"), F.lit("，重要性为 "), "importance", F.lit("。")),
        "source_span": F.struct(field.alias("field"), F.lit(0).alias("start"), F.least(F.lit(180), F.length(whole)).alias("end"), F.substring(T.compact(whole), 1, 180).alias("quote")),
    }).drop("__body")
