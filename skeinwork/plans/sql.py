"""DuckDB SQL of the general queries, written for that dialect on its own, not derived from the plans."""

from __future__ import annotations

from skeinwork.vocab import AI, NEV, REFERENCE as V

#: Fixed clocks, in seconds since 1970: now of the feed and of ranks, of due sources, of freshness, and a publication window.
NOW, DUE_AT, FRESH_AT, WINDOW = 1_782_864_000, 1_782_641_400, 1_735_689_600, (1_709_251_200, 1_714_521_600)

WHITE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(x) -> str:
    return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)


def compact(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WHITE}+', ' ', 'g'), ' ')"


def first(*xs: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({x}, '')" for x in xs) + ", '')"


def any_of(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")" if words else "false"


def wide(term: str) -> bool:
    return any("一" <= c <= "鿿" for c in term)


def _escape(term: str) -> str:
    return term.lower().replace("-", r"\-")


def hit(term: str) -> str:
    return f"contains(txt, {lit(term)})" if wide(term) else f"regexp_matches(low, '(^|[^a-z0-9]){_escape(term)}([^a-z0-9]|$)')"


def matched(terms) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {hit(t)} THEN {lit(t)} END" for t in terms) + "], lambda x: x IS NOT NULL)"


def listed(rules, also, default: str) -> str:
    hits = ", ".join(f"CASE WHEN {any_of('txt', words)} OR {also.get(k, 'false')} THEN {lit(k)} END" for k, words in rules.items())
    return f"(SELECT CASE WHEN len(l) > 0 THEN l ELSE [{lit(default)}] END FROM (SELECT list_filter([{hits}], lambda x: x IS NOT NULL) AS l))"


def iso(x: str) -> str:
    shape = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
    offset = rf"CASE WHEN regexp_matches({x}, '[+-]\d{{2}}:\d{{2}}$') THEN (CAST(substr({x}, -5, 2) AS BIGINT) * 3600 + CAST(substr({x}, -2, 2) AS BIGINT) * 60) * CASE WHEN substr({x}, -6, 1) = '-' THEN -1 ELSE 1 END ELSE 0 END"
    return f"CASE WHEN regexp_matches({x}, '{shape}') THEN date_diff('day', DATE '1970-01-01', TRY_CAST(substr({x}, 1, 10) AS DATE)) * 86400 + CAST(substr({x}, 12, 2) AS BIGINT) * 3600 + CAST(substr({x}, 15, 2) AS BIGINT) * 60 + CAST(substr({x}, 18, 2) AS BIGINT) - {offset} END"


RAW = "SELECT DISTINCT ON (id) * FROM raw_items"
ITEMS = f"""SELECT r.*, s.name AS source_name, s.type AS source_type, s.industry_hint, CASE WHEN isnan(s.reliability_score) THEN NULL ELSE s.reliability_score END AS reliability, s.enabled,
 coalesce(r.title, '') || ' ' || coalesce(r.raw_content, '') || ' ' || coalesce(r.content_excerpt, '') AS txt, lower(coalesce(r.title, '') || ' ' || coalesce(r.raw_content, '') || ' ' || coalesce(r.content_excerpt, '')) AS low
 FROM ({RAW}) r JOIN sources s ON s.id = r.source_id"""
JOINED = f"""SELECT p.id AS item_id, p.canonical_event_id AS event_id, p.normalized_title, p.summary, p.importance_level, p.rank_score, p.confidence, i.id AS raw_id, i.source_id, i.source_name, i.source_type, i.reliability,
 i.title, i.url, i.published_at, i.fetched_at, i.content_excerpt FROM (SELECT DISTINCT ON (id) * FROM processed_items) p JOIN ({ITEMS}) i ON i.id = p.raw_item_id"""
DISPLAY = first("published_at", "fetched_at")
RANK = "rank_score DESC, published_at DESC NULLS LAST, item_id"

SHELLS = ("资讯栏目每天对新能源电动汽车行业的新闻资讯第一时间报道", "盖世汽车提供及时全面的:汽车销量、汽车资讯、汽车行业新闻、汽车销量排行榜、新能源汽车资讯、电动汽车资讯", "企业库 销量 查询 采购 项目")
_BODY = f"trim({first('raw_content', 'content_excerpt')}, ' ')"
_FURNITURE = ("盖世汽车", "汽车销量", "汽车资讯", "汽车行业新闻", "新能源汽车资讯", "电动汽车资讯", "资讯栏目", "第一时间报道")
_REST = f"trim(CASE WHEN trim(coalesce(title, ''), ' ') <> '' THEN replace({_BODY}, trim(title, ' '), '') ELSE {_BODY} END, ' -_｜|：:')"
_MOSTLY = f"({_REST} <> '' AND " + " + ".join(f"contains({_REST}, {lit(w)})::INT" for w in _FURNITURE) + " >= 2)"
SCREEN = f"""SELECT *, CASE WHEN low_information THEN false ELSE n_nev > 0 OR n_ai > 0 END AS is_relevant FROM (
 SELECT *, {matched(V.relevance[NEV])} AS nev, {matched(V.relevance[AI])} AS ai, {matched(V.negative)} AS neg, len(nev) AS n_nev, len(ai) AS n_ai, len(neg) AS n_negative,
 trim(coalesce(title, ''), ' ') IN ('最后一页', '上一页', '下一页', '尾页') OR ({any_of('txt', SHELLS)} AND (length({_BODY}) < 140 OR {_MOSTLY})) AS low_information FROM ({ITEMS}))"""
VERDICT = f"""SELECT *, CASE WHEN is_relevant THEN CASE WHEN n_ai > 0 AND (n_nev = 0 OR n_ai >= n_nev) THEN '{AI}' ELSE '{NEV}' END ELSE '' END AS industry,
 CAST(CASE WHEN low_information THEN 0.9 WHEN is_relevant THEN 0.72 WHEN n_negative > 0 THEN 0.9 ELSE 0.85 END AS DOUBLE) AS screen_confidence FROM ({SCREEN})"""

NORMAL = r"regexp_replace(lower(coalesce(title, '')), '[^\p{L}\p{M}\p{N}_]+', '', 'g')"
KEYED = f"""SELECT *, CASE WHEN {any_of('nt', ('电池', 'battery'))} AND {any_of('nt', ('政策', '监管', 'policy'))} THEN 'battery-policy' WHEN {any_of('nt', ('英伟达', 'nvidia', 'ai芯片'))} THEN 'nvidia-ai-chip'
 WHEN {any_of('nt', ('openai', '智能体', 'agent'))} THEN 'openai-agent' WHEN {any_of('nt', ('宁德时代', 'catl'))} THEN 'catl-capacity' WHEN {any_of('nt', ('比亚迪', 'byd'))} AND {any_of('nt', ('海外', 'oversea', 'export'))} THEN 'byd-overseas'
 ELSE substr(nt, 1, 28) END AS cluster_key"""
KEYS = f"{KEYED} FROM (SELECT *, {NORMAL} AS nt FROM ({ITEMS}))"
_ORDER = f"coalesce(nullif(reliability, 0), 0.5) DESC, length({first('raw_content', 'content_excerpt')}) DESC, coalesce({iso('published_at')}, 0) DESC, id"
CLUSTERS = f"SELECT cluster_key, count(*) AS members, count(DISTINCT CASE WHEN reliability >= 0.65 THEN source_id END) AS reliable_sources, min(fetched_at) AS first_seen, max(fetched_at) AS last_seen, first(id ORDER BY {_ORDER}) AS representative_id"

_GOV = "coalesce(source_type = 'government', false)"
_hints = "CASE trim(split_part(coalesce(industry_hint, ''), ',', 1), ' ') " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.hints.items()) + " END"


def classes(source: str) -> str:
    subtags = "CASE class_industry " + " ".join(f"WHEN {lit(k)} THEN {listed(v, {}, next(iter(v)))}" for k, v in V.subtags.items()) + " END"
    signals = ", ".join(f"CASE WHEN {' OR '.join(f'list_contains(event_types, {lit(e)})' for e in of) if of else any_of('txt', V.regional_words)} THEN {lit(k)} END" for k, of in V.signals.items())
    actors = " OR ".join(f"contains(txt, {lit(a)})" for a in V.actors)
    among = lambda *names: "(" + " OR ".join(f"list_contains(event_types, {lit(n)})" for n in names) + ")"
    strong = f"coalesce(source_type IN ('government', 'exchange'), false) OR {among('政策/监管', '风险/负面舆情')}"
    core = f"({actors}) OR {among('技术突破', '供应链变化', '并购/重组')}"
    pick = lambda a, b, c, d: f"CASE WHEN {strong} THEN {a} WHEN {core} THEN {b} WHEN {any_of('txt', V.medium_words)} THEN {c} ELSE {d} END"
    return f"""SELECT *, {subtags} AS subtags, (SELECT CASE WHEN len(l) > 0 THEN l ELSE [{lit(V.default_signal)}] END FROM (SELECT list_filter([{signals}], lambda x: x IS NOT NULL) AS l)) AS signals, CASE WHEN {actors} THEN 'core' ELSE 'none' END AS actor_level,
 {pick("'high'", "'high'", "'medium'", "'low'")} AS importance, CAST({pick(0.82, 0.78, 0.68, 0.55)} AS DOUBLE) AS class_confidence,
 {pick("'命中政府/监管、交易所或风险类高置信信号。'", "'涉及核心主体或可能改变产业格局的事件。'", "'包含明确进展，但影响范围仍需后续验证。'", "'产业影响较弱或事实支撑不足。'")} AS importance_reason FROM (
 SELECT *, CASE WHEN relevance_industry IN ('{NEV}', '{AI}') THEN relevance_industry ELSE coalesce({_hints}, CASE WHEN {any_of('txt', V.industry_words)} THEN '{NEV}' ELSE '{AI}' END) END AS class_industry,
 {listed(V.events, {'政策/监管': _GOV, '龙头企业动向': f'({actors})'}, V.default_event)} AS event_types, {listed(V.roles, {'政府/监管机构': _GOV}, V.default_role)} AS subject_roles FROM ({source}))"""


CLASSED = classes(ITEMS)
_dims = {"industry": "[class_industry]", "industry_subtag": "subtags", "event_type": "event_types", "subject_role": "subject_roles", "signal_attribute": "signals"}
TAGS_ORDERED = "SELECT id, value, row_number() OVER (PARTITION BY id ORDER BY d, ord) AS ord FROM (" + " UNION ALL ".join(f"SELECT id, {n} AS d, unnest({v}) AS value, generate_subscripts({v}, 1) AS ord FROM c" for n, v in enumerate(_dims.values())) + ")"
TAGS = " UNION ALL ".join(f"SELECT id, {lit(k)} AS dimension, unnest({v}) AS value, generate_subscripts({v}, 1) AS ord FROM c" for k, v in _dims.items())


def fresh(now: int, pub: str, fet: str) -> str:
    h = f"(({now} - coalesce({pub}, {fet})) / 3600.0)"
    return f"CAST(CASE WHEN coalesce({pub}, {fet}) IS NULL THEN 0.3 WHEN {h} <= 6 THEN 1.0 WHEN {h} <= 24 THEN 0.85 WHEN {h} <= 72 THEN 0.6 WHEN {h} <= 168 THEN 0.35 ELSE 0.15 END AS DOUBLE)"


ACCEPTED = f"{KEYED} FROM (SELECT *, {NORMAL} AS nt FROM ({VERDICT}) WHERE enabled AND is_relevant)"
_level = "CASE importance " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in V.importance_scores.items()) + " ELSE 0.4::DOUBLE END"
_event = "list_max(list_transform(event_types, lambda e: CASE e " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in V.event_scores.items()) + " ELSE 0.4::DOUBLE END))"
ANALYSED = f"""SELECT *, round(i_s * 0.35::DOUBLE + s_s * 0.2::DOUBLE + f_s * 0.15::DOUBLE + e_s * 0.15::DOUBLE + c_s * 0.1::DOUBLE + k_s * 0.05::DOUBLE, 4) AS rank_score FROM (
 SELECT c.*, k.members, k.reliable_sources, {_level} * (0.7::DOUBLE + 0.3::DOUBLE * class_confidence) AS i_s, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(reliability, 0.5::DOUBLE))) AS s_s, {fresh(NOW, 'published_s', 'fetched_s')} AS f_s, {_event} AS e_s,
 CASE WHEN k.reliable_sources <= 1 THEN 0.2::DOUBLE ELSE least(1.0::DOUBLE, log2(1.0::DOUBLE + k.reliable_sources) / log2(6.0::DOUBLE)) END AS c_s, CASE actor_level WHEN 'core' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k_s
 FROM (SELECT *, {iso('published_at')} AS published_s, {iso('fetched_at')} AS fetched_s FROM ({classes(ACCEPTED)})) c JOIN ({CLUSTERS} FROM ({ACCEPTED}) GROUP BY cluster_key) k USING (cluster_key))"""
_signals2 = "array_to_string(signals[1:2], '、')"
IMPACT = f"""CASE importance WHEN 'high' THEN '对' || class_industry || '研究具有较高优先级，主要体现为' || {_signals2} || '，建议优先追踪政策落地、主体动作和后续相似报道。' WHEN 'medium' THEN '对' || class_industry || '具有跟踪价值，主要体现为' || {_signals2} || '，建议纳入观察列表。' ELSE '对' || class_industry || '影响有限，适合作为背景素材保留。' END"""
_actor_list = "list_filter([" + ", ".join(f"CASE WHEN contains(txt, {lit(a)}) THEN {lit(a)} END" for a in V.actors) + "], lambda x: x IS NOT NULL)"
_url_runs = r"list_filter(list_transform(regexp_extract_all('/' || url || '/', '[^0-9](20\d{6})[^0-9]', 1), lambda x: TRY_CAST(substr(x, 1, 4) || '-' || substr(x, 5, 2) || '-' || substr(x, 7, 2) AS DATE)), lambda x: x IS NOT NULL)[1]"
_W = r"[\t\n\x0b\f\r ]*"
_label = "(?:发布时间|发布日期|发稿时间|更新时间|日期|时间)"
_forms = (rf"{_label}{_W}[:：]?{_W}(20\d{{2}}){_W}年{_W}(\d{{1,2}}){_W}月{_W}(\d{{1,2}}){_W}日", rf"{_label}{_W}[:：]?{_W}(20\d{{2}})[-/](\d{{1,2}})[-/](\d{{1,2}})")
_one = lambda p: f"TRY_CAST(regexp_extract(head, '{p}', 1) || '-' || lpad(regexp_extract(head, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract(head, '{p}', 3), 2, '0') AS DATE)"
TEXT_DATES = f"SELECT id, url, published_at, coalesce({_one(_forms[0])}, {_one(_forms[1])}) AS text_day, {_url_runs} AS url_day FROM (SELECT *, substr(raw_content, 1, 1200) AS head FROM ({RAW}))"
_HASH = f"sha256(lower({compact(chr(99) + 'oalesce(title, ' + chr(39) * 2 + ') || chr(10) || coalesce(raw_content, ' + chr(39) * 2 + ')')}))"
_NAV = "('about', 'contact', 'lxwm', 'xwzx', 'news', 'index', 'home', 'disclosure', 'listed', 'notice', 'press', 'blog', 'reits')"
_NAV_TITLE = ("联系我们", "联系", "新闻中心", "新闻发布", "信息披露", "首页", "公网安备", "copyright", "sitemap", "关于我们")
_ART_TITLE = ("发布", "召开", "印发", "公告", "通知", "公示", "签署", "会见", "调研", "投资", "融资", "launch", "announces", "article", "release", "reports")
LINKS = rf"""SELECT id, url FROM (SELECT *, lower(url) AS lu, coalesce(title, '') AS t, lower(coalesce(title, '')) AS lt, list_filter(string_split(regexp_replace(regexp_replace(lower(url), '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '/'), lambda p: p <> '') AS parts FROM ({RAW}))
 WHERE regexp_matches(lu, '^https?://') AND url <> 'https://www.example/' AND length(t) >= 4 AND NOT ({any_of('lu', ('investorannals', 'investorrelations', 'periodic-reports', 'javascript:', 'mailto:', '/login', '/signin', 'beian.gov.cn'))}
 OR {any_of('lt', ('periodic reports', 'investor relations', 'annual reports', 'interim reports'))} OR regexp_matches(lu, '\.(jpg|jpeg|png|gif|svg|css|js|ico|zip|rar)$') OR (coalesce(parts[-1], '') IN ('index.html', 'index.htm', 'index.shtml', '') AND coalesce(parts[-2], '') IN {_NAV})
 OR coalesce(parts[-1], '') IN {_NAV} OR {any_of('t', _NAV_TITLE)}) AND (regexp_matches(lu, '/20\d{{2}}|20\d{{6,}}|t20\d{{6}}_|content_\d+|art_\w+|/c\.html$|/news/[^/]*\d+|/[^/]*\d+[^/]*\.(html|htm|shtml)$') OR (length(t) >= 14 AND ({any_of('t', _ART_TITLE)} OR {any_of('lt', _ART_TITLE)})))"""

_made = [("'下一页'", "'x'"), ("title", lit(SHELLS[0])), ("title", f"{lit(SHELLS[0] + '盖世汽车 汽车销量 ')} || repeat('新闻', 100)"), ("title", "'企业库 销量 查询 采购 项目' || repeat('新闻', 100)")]
_plain = f"SELECT id, title, raw_content, content_excerpt FROM ({ITEMS})" + "".join(f" UNION ALL SELECT id * 10 + {k}, {a}, {b}, NULL FROM ({RAW})" for k, (a, b) in enumerate(_made))
MADE = f"SELECT *, coalesce(title, '') || ' ' || coalesce(raw_content, '') || ' ' || coalesce(content_excerpt, '') AS txt, lower(txt) AS low FROM ({_plain})"
_one_tag = lambda x: f"""regexp_replace(substr(coalesce({x}, ''), 1, 3500), '(?is){'|'.join(f'<{t}[^>a-z0-9_][^>]*>.*?</{t}>|<{t}>.*?</{t}>' for t in ('script', 'style', 'noscript', 'template', 'svg', 'canvas', 'iframe', 'object', 'embed'))}|<!--.*?-->|<[^>]+>', ' ', 'g')"""
_bound = lambda x: f"substr({compact(_one_tag(x))}, 1, 3500)"
_told = lambda x: f"CASE WHEN length(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 12 THEN {x} END"
BOUNDED = f"SELECT id, coalesce({', '.join(_told(c) for c in 'abc')}, '') AS bounded FROM (SELECT id, {', '.join(f'{_bound(c)} AS {k}' for k, c in zip('abc', ('raw_content', 'content_excerpt', 'title')))} FROM ({ITEMS}))"

_PHRASES = ("企业库", "销量", "查询", "采购", "项目", "AutoNews", "工具栏", "寻求", "报道", "公众号")
_MENU = ("首页", "APP下载", "登录", "注册", "投稿", "验证码", "联系我们", "联系邮箱", "版权所有", "站内导航", "版权声明", "扫码下载APP", "用户 反馈", "提交成功")
_MARKUP = "a article aside blockquote body button canvas cite div em figcaption figure footer form h1 h2 h3 h4 h5 h6 header img input label li main nav ol p path section span strong svg ul"
_many = lambda x, words: " + ".join(f"contains({x}, {lit(w)})::INT" for w in words)
_wide = lambda x: f"length(regexp_replace({x}, '[^一-鿿]', '', 'g'))"
_words = lambda x: f"len(regexp_extract_all({x}, '[A-Za-z][A-Za-z-]{{2,}}'))"
_ends = lambda x: f"length(regexp_replace({x}, '[^。！？!?]', '', 'g'))"
SUBSTANTIVE = f"""SELECT DISTINCT id FROM (SELECT *, regexp_replace(meaning, '{'|'.join(_PHRASES)}', ' ', 'g') AS rest_words, regexp_extract_all(lower(rest_words), '[a-z][a-z0-9-]*') AS toks, {_many('body', _MENU)} AS shells, {_many('meaning', _PHRASES)} AS hits
 FROM (SELECT *, regexp_replace(rest, '(?i)(^|[^\\p{{L}}\\p{{N}}_])https?://\\S+', '\\1 ', 'g') AS meaning FROM (SELECT *, CASE WHEN head <> '' AND instr(body, head) > 0 THEN substr(body, 1, instr(body, head) - 1) || ' ' || substr(body, instr(body, head) + length(head)) ELSE body END AS rest
 FROM (SELECT id, {compact('raw_content')} AS body, {compact('title')} AS head FROM raw_items)))) WHERE length(body) >= 20 AND NOT (
 (shells >= 5 AND ({_wide('rest')} < 120 OR {_ends('rest')} < 2)) OR (shells >= 3 AND {_wide('rest')} < 80 AND {_words('rest')} < 20) OR {any_of('body', ('html4', 'purchaseInfo', 'ProductName', 'add-author'))}
 OR (len(toks) >= 3 AND len(list_filter(toks, lambda x: x NOT IN ({', '.join(lit(w) for w in _MARKUP.split())}))) = 0) OR (hits >= 2 AND {_wide('rest_words')} < 20 AND {_words('rest_words')} < 8))"""

_where = "'公开来源披露'"
_tags_of = f"SELECT id, string_agg(value, '|' ORDER BY ord) AS tag_values FROM (WITH c AS ({CLASSED}) {TAGS_ORDERED}) GROUP BY id"
_similar = f"SELECT event_id, item_id, row_number() OVER (PARTITION BY event_id ORDER BY reliability DESC NULLS LAST, published_at DESC NULLS LAST, item_id) AS place FROM ({JOINED}) WHERE event_id IS NOT NULL AND event_id <> 0"
#: Addresses that moved: of a source, old to new.
MOVED = {"https://www.dribepa.example": "https://www.dribepa.example/en", "https://www.cigoco.example": "https://news.cigoco.example"}
_moved = lambda x: f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in MOVED.items()) + f" ELSE {x} END"
_label_case = "CASE source_type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.source_labels.items()) + " END"
_known = f"SELECT DISTINCT cluster_key FROM ({KEYED} FROM (SELECT *, {NORMAL.replace('title', 'canonical_title')} AS nt FROM event_clusters))"
_usable = LINKS.replace("SELECT id, url FROM", "SELECT id, source_id, url, title, published_at FROM", 1)
_page_items = f"SELECT * FROM ({RAW}) WHERE trim(coalesce(title, ''), ' ') <> ''"
_meeting = "(" + " OR ".join(f"list_contains(neg, {lit(w)})" for w in V.meeting) + ")"
_wish = {"event_types": ("政策/监管", "产能/交付", "产品发布"), "signals": ("政策信号", "机会信号", "竞争格局变化"), "subject_roles": ("政府/监管机构", "整车企业", V.default_role), "subtags": tuple(V.subtags[NEV])[:4]}
_granted = " AND ".join([f"class_industry = {lit(NEV)}", *[f"list_has_any({k}, [{', '.join(map(lit, v))}])" for k, v in _wish.items()]])

SQL: dict[str, str] = {
    "bounded_text": f"SELECT id, length(bounded) AS size, md5(bounded) AS digest FROM ({BOUNDED})",
    "substantive_body": SUBSTANTIVE,
    "clean_plain": f"SELECT id, {compact('raw_content')} AS cleaned FROM ({RAW}) WHERE NOT coalesce(regexp_matches(raw_content, '[<{{}}&;@]|/\\*'), false)",
    "decoded_titles": f"SELECT id, CASE WHEN length(title) % 2 = 0 THEN '<?xml version=''1.0''?><rss>' ELSE '<html>' END || coalesce(title, '') AS text, coalesce(length(title) % 2 = 0, false) AS is_feed FROM ({RAW})",
    "collect_new": f"SELECT DISTINCT ON (url) url, {compact('title')} AS title FROM ({_usable}) WHERE url NOT IN (SELECT url FROM raw_items WHERE status = 'processed') ORDER BY url",
    "scoped_raw": f"SELECT workflow_run_id, id, row_number() OVER (PARTITION BY workflow_run_id ORDER BY fetched_at, id) AS place FROM (SELECT DISTINCT p.workflow_run_id, r.id, r.fetched_at FROM processed_items p JOIN ({RAW}) r ON r.id = p.raw_item_id WHERE p.workflow_run_id IS NOT NULL)",
    "trace_tags": f"WITH c AS ({CLASSED}) SELECT id, string_agg(dimension || '=' || value, '|' ORDER BY dimension, value) AS tags FROM ({TAGS}) GROUP BY id",
    "cluster_trace": f"SELECT c.cluster_key, r.title AS canonical_title, c.members AS raw_item_count, n.source_names FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key) c JOIN (SELECT cluster_key, array_to_string(list_sort(list(DISTINCT source_name)), '|') AS source_names FROM ({KEYS}) GROUP BY cluster_key) n USING (cluster_key) JOIN ({RAW}) r ON r.id = c.representative_id WHERE c.members > 1",
    "stream_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_sessions": "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%g') AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, part",
    "advanced_sources": "SELECT id, CASE WHEN id IN (SELECT source_id FROM raw_items WHERE status = 'new') THEN '2026-01-01T00:00:00Z' ELSE last_fetched_at END AS last_fetched_at, CASE WHEN enabled THEN '2026-01-01T00:00:00Z' ELSE last_checked_at END AS last_checked_at, CASE WHEN enabled THEN NULL ELSE last_error END AS last_error FROM sources",
    "insert_or_enrich": f"SELECT url, CASE WHEN status = 'new' THEN status || ' again' ELSE status || ' again' END AS relevance_reason, status = 'new' AS inserted FROM ({RAW})",
    "moved_urls": f"SELECT id, {_moved('url')} AS url, {_moved('url')} AS canonical_url FROM sources",
    "source_create": "SELECT s.url || CASE WHEN s.type = 'media' THEN '' ELSE '/new' END AS url, CASE WHEN EXISTS (SELECT 1 FROM sources k WHERE k.url = s.url || CASE WHEN s.type = 'media' THEN '' ELSE '/new' END) THEN 'conflict' ELSE 'created' END AS outcome FROM sources s WHERE enabled",
    "run_trace": """SELECT id, place, node, n, CASE WHEN place <= last THEN 'done' WHEN status = 'failed' AND place = last + 1 THEN 'failed' ELSE 'open' END AS state FROM (SELECT *, CASE WHEN coalesce(extracted_count, 0) > 0 THEN 3 WHEN coalesce(classified_count, 0) > 0 THEN 2 WHEN coalesce(deduped_count, 0) > 0 THEN 1 WHEN coalesce(collected_count, 0) > 0 THEN 0 ELSE -1 END AS last FROM workflow_runs) w,
 LATERAL (SELECT 0 AS place, 'collected' AS node, coalesce(collected_count, 0) AS n UNION ALL SELECT 1, 'deduped', coalesce(deduped_count, 0) UNION ALL SELECT 2, 'classified', coalesce(classified_count, 0) UNION ALL SELECT 3, 'extracted', coalesce(extracted_count, 0)) x""",
    "runs_total": "SELECT id, status, (SELECT count(*) FROM workflow_runs) AS total, CAST(ceil((SELECT count(*) FROM workflow_runs) / 20.0) AS BIGINT) AS pages FROM workflow_runs ORDER BY started_at DESC, id DESC LIMIT 20",
    "recovered_runs": "SELECT id, CASE WHEN ended_at IS NULL THEN 'failed' ELSE status END AS status, CASE WHEN ended_at IS NULL THEN coalesce(error_summary, 'interrupted') ELSE error_summary END AS error_summary FROM workflow_runs",
    "dashboard": "SELECT first(id ORDER BY started_at DESC, id DESC) AS latest_run, max(ended_at) FILTER (trigger_type = 'interval') AS last_scheduled_end, CAST(sum(collected_count) AS BIGINT) AS collected, CAST(sum(failed_count) AS BIGINT) AS failed, (SELECT count(*) > 0 FROM processed_items) AS can_brief FROM workflow_runs",
    "due_sources_order": f"SELECT id, row_number() OVER (ORDER BY {iso('l')} ASC NULLS FIRST, id) AS place FROM (SELECT *, {first('last_fetched_at', 'last_checked_at')} AS l FROM sources) WHERE enabled AND ({iso('l')} IS NULL OR {DUE_AT} - {iso('l')} >= coalesce(nullif(fetch_interval_minutes, 0), 120) * 60)",
    "item_detail": f"SELECT j.item_id, j.title, j.source_name, g.tag_values, r.reports, s.place FROM ({JOINED}) j LEFT JOIN ({_tags_of}) g ON g.id = j.raw_id LEFT JOIN (SELECT event_id, count(*) AS reports FROM ({JOINED}) GROUP BY event_id) r ON r.event_id = j.event_id LEFT JOIN ({_similar}) s ON s.item_id = j.item_id",
    "event_reports": f"SELECT e.id, e.canonical_title, coalesce(s.items, '') AS items FROM event_clusters e LEFT JOIN (SELECT event_id, string_agg(item_id, '|' ORDER BY place) AS items FROM ({_similar}) WHERE place <= 8 GROUP BY event_id) s ON s.event_id = e.id",
    "tagged_feed": f"SELECT j.item_id, j.rank_score FROM ({JOINED}) j JOIN ({CLASSED}) c ON c.id = j.raw_id WHERE {_granted} ORDER BY {RANK.replace('published_at', 'j.published_at')} LIMIT 200",
    "decorated_feed": f"SELECT j.item_id, {_label_case} AS type_label, {DISPLAY} AS display_time, g.tag_values AS visible_tags FROM (SELECT * FROM ({JOINED}) ORDER BY {RANK} LIMIT 200) j JOIN ({_tags_of.replace('FROM (WITH', 'FROM (SELECT * FROM (WITH').replace(') GROUP BY id', ') WHERE ord <= 8) GROUP BY id')}) g ON g.id = j.raw_id",
    "rank_reasons": f"""SELECT id, '重要性 ' || importance || ' 得分 ' || printf('%.2f', round(i_s, 4)) || ' | 来源权威性得分 ' || printf('%.2f', round(s_s, 4)) || ' | 时效性得分 ' || printf('%.2f', round(f_s, 4)) || ' | 事件类型 ' || array_to_string(event_types, ', ') || ' 得分 ' || printf('%.2f', round(e_s, 4))
 || ' | 可靠相似报道 ' || reliable_sources || ' 个，覆盖度得分 ' || printf('%.2f', round(c_s, 4)) || ' | 关键主体等级 ' || actor_level || ' 得分 ' || printf('%.2f', round(k_s, 4)) AS reason FROM ({ANALYSED})""",
    "relevance_reasons": f"""SELECT id, CASE WHEN low_information THEN CASE WHEN trim(coalesce(title, ''), ' ') IN ('最后一页', '上一页', '下一页', '尾页') THEN '正文信息不足：疑似列表页或分页导航，不应进入产业情报库' ELSE '正文信息不足：疑似来源栏目模板或站点宣传语，不应进入产业情报库' END
 WHEN is_relevant THEN CASE WHEN industry = '{AI}' THEN '命中人工智能产业关键词' ELSE '命中新能源汽车产业关键词' END WHEN n_negative > 0 AND {_meeting} THEN '内部会议，未命中产业关键词' WHEN n_negative > 0 THEN '内部会议或泛社会新闻，未命中产业关键词' ELSE '未命中产业关键词，来源行业提示不足以入库' END AS reason FROM ({VERDICT})""",
    "evidence_strings": f"SELECT id, '事件类型命中：' || array_to_string(event_types, ', ') || CASE WHEN coalesce(source_type, '') <> '' THEN '|来源类型：' || source_type ELSE '' END || CASE WHEN actor_level <> 'none' THEN '|关键主体等级：' || actor_level ELSE '' END AS evidence FROM ({CLASSED})",
    "backfill_rank": f"""SELECT id, round(i_s * 0.35::DOUBLE + s_s * 0.2::DOUBLE + f2 * 0.15::DOUBLE + e_s * 0.15::DOUBLE + c_s * 0.1::DOUBLE + k_s * 0.05::DOUBLE, 4) AS rank_score, round(f2, 4) AS freshness_score FROM (SELECT a.*, {fresh(NOW, 'coalesce(a.published_s, d.found_s)', 'a.fetched_s')} AS f2
 FROM ({ANALYSED}) a JOIN (SELECT id, CAST(epoch(CAST(coalesce(text_day, url_day) AS TIMESTAMP)) AS BIGINT) AS found_s FROM ({TEXT_DATES}) WHERE published_at IS NULL AND coalesce(text_day, url_day) IS NOT NULL) d ON d.id = a.id)""",
    "taxonomy_table": " UNION ALL ".join(f"SELECT {lit(d)} AS dimension, {lit(k)} AS value, {i} AS place" for d, rules in (("event_type", V.events), ("subject_role", V.roles), ("signal_attribute", V.signals)) for i, k in enumerate(rules)),
    "ranking_rules": " UNION ALL ".join(f"SELECT {lit(p)} AS part, {lit(k)} AS label, {float(v)}::DOUBLE AS score" for p, rules in (("importance", V.importance_scores), ("event_type", V.event_scores)) for k, v in rules.items()),
    "listing_candidates": f"SELECT source_id, url FROM (SELECT DISTINCT ON (u.source_id, u.url) u.source_id, u.url, {iso('u.published_at')} AS seconds FROM ({_usable}) u JOIN sources s ON s.id = u.source_id WHERE s.enabled ORDER BY u.source_id, u.url) WHERE seconds IS NULL OR seconds BETWEEN {WINDOW[0]} AND {WINDOW[1]} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seconds DESC NULLS LAST, url) <= 50",
    "feed_entries": f"SELECT source_id, url FROM (SELECT i.source_id, i.url, {iso('trim(i.published_at)')} AS seconds FROM ({_page_items}) i JOIN sources s ON s.id = i.source_id) WHERE seconds IS NULL OR seconds BETWEEN 0 AND {NOW} QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY seconds DESC NULLS LAST, url) <= 50",
    "candidate_union": f"SELECT source_id, 'feed' AS origin, count(DISTINCT url) AS n FROM ({_page_items}) GROUP BY source_id UNION ALL SELECT source_id, 'listing', count(DISTINCT url) FROM ({_usable}) GROUP BY source_id",
    "normalised_items": f"""SELECT id, head AS title, CASE WHEN head <> '' THEN url END AS canonical_url, CASE WHEN head <> '' THEN CASE WHEN length(x) <= 360 THEN x ELSE rtrim(substr(x, 1, 360), ' ') || '...' END END AS content_excerpt,
 CASE WHEN head <> '' THEN sha256(lower(trim(head || ' ' || x, ' '))) END AS content_hash, CASE WHEN head <> '' THEN 'new' ELSE 'rejected' END AS status FROM (SELECT id, url, {compact('title')} AS head, {compact('raw_content')} AS x FROM ({RAW}))""",
    "insert_clusters": f"SELECT c.cluster_key, i.title AS canonical_title, c.representative_id, c.members AS duplicate_count FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key) c JOIN ({RAW}) i ON i.id = c.representative_id WHERE c.cluster_key NOT IN ({_known})",
    "cluster_lookup": f"SELECT cluster_key, min(id) AS event_id FROM ({KEYED} FROM (SELECT *, {NORMAL.replace('title', 'canonical_title')} AS nt FROM event_clusters)) WHERE cluster_key IN (SELECT cluster_key FROM ({KEYS})) GROUP BY cluster_key",
    "mark_processed": f"SELECT r.id, CASE WHEN v.enabled AND v.is_relevant THEN 'processed' WHEN v.enabled THEN 'rejected' ELSE r.status END AS new_status FROM ({RAW}) r LEFT JOIN ({VERDICT}) v ON v.id = r.id",
    "insert_processed": f"SELECT id, cluster_key, importance, class_confidence, rank_score FROM ({ANALYSED}) a WHERE NOT EXISTS (SELECT 1 FROM processed_items p WHERE p.raw_item_id = a.id)",
    "first_per_source": f"SELECT id, source_id, fetched_at FROM ({RAW}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id) <= 3",
    "feed_rank_topk": f"SELECT item_id, rank_score, published_at, source_name, title FROM ({JOINED}) ORDER BY {RANK} LIMIT 50",
    "feed_time_topk": f"SELECT item_id, rank_score, {DISPLAY} AS display_time FROM ({JOINED}) ORDER BY display_time DESC, {RANK} LIMIT 100",
    "time_window_feed": f"SELECT item_id, rank_score FROM ({JOINED}) WHERE coalesce({iso('published_at')}, {iso('fetched_at')}) >= {NOW - 2_592_000} ORDER BY {RANK} LIMIT 200",
    "analysed_feed": f"SELECT id, industry, cluster_key, members, reliable_sources, importance, rank_score FROM ({ANALYSED}) ORDER BY rank_score DESC, published_s DESC NULLS LAST, id LIMIT 50",
    "relevance_screen": f"SELECT id, n_nev, n_ai, n_negative, low_information, is_relevant, industry, screen_confidence FROM ({VERDICT})",
    "relevance_terms": f"SELECT id, array_to_string(nev, '|') AS nev_terms, array_to_string(ai, '|') AS ai_terms FROM ({SCREEN})",
    "relevance_verdict_counts": f"SELECT is_relevant, industry, screen_confidence, count(*) AS n FROM ({VERDICT}) GROUP BY ALL",
    "relevance_vs_stored": f"SELECT CASE relevance_industry WHEN 'new_energy_vehicle' THEN '{NEV}' WHEN 'nev' THEN '{NEV}' WHEN 'ai' THEN '{AI}' WHEN 'artificial_intelligence' THEN '{AI}' ELSE '' END AS stored, industry AS screened, count(*) AS n FROM ({VERDICT}) GROUP BY ALL",
    "low_information": f"SELECT id, title FROM ({SCREEN.replace(ITEMS, MADE)}) WHERE low_information",
    "keyword_search": f"SELECT item_id, title FROM ({JOINED}) WHERE contains(lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content_excerpt, '')), 'battery')",
    "importance_filter": f"SELECT item_id, rank_score FROM ({JOINED}) WHERE importance_level = 'high'",
    "source_type_filter": f"SELECT item_id, source_name FROM ({JOINED}) WHERE source_type = 'government'",
    "tag_filter": f"SELECT id FROM ({CLASSED}) WHERE list_contains(event_types, '产能/交付') AND list_contains(signals, '机会信号')",
    "published_window": f"SELECT id, {iso('published_at')} AS seconds FROM ({ITEMS}) WHERE {iso('published_at')} IS NULL OR {iso('published_at')} BETWEEN {WINDOW[0]} AND {WINDOW[1]}",
    "due_sources": f"SELECT id, name FROM (SELECT *, {first('last_fetched_at', 'last_checked_at')} AS l FROM sources) WHERE enabled AND ({iso('l')} IS NULL OR {DUE_AT} - {iso('l')} >= coalesce(nullif(fetch_interval_minutes, 0), 120) * 60)",
    "source_windows": f"SELECT id, coalesce({iso('last_fetched_at')}, {DUE_AT - 86400}) AS window_start, CAST({DUE_AT} AS BIGINT) AS window_end FROM sources WHERE enabled",
    "sources_list": "SELECT id, name, type, CASE type " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.source_labels.items()) + " END AS type_label, CASE WHEN isnan(reliability_score) THEN NULL ELSE reliability_score END AS reliability, enabled FROM sources",
    "cluster_keys": f"SELECT id, nt AS normal_title, cluster_key FROM ({KEYS})",
    "cluster_sizes": f"SELECT cluster_key, members FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key) WHERE members > 1",
    "cluster_representative": f"SELECT cluster_key, representative_id FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key)",
    "cluster_seen_range": f"SELECT cluster_key, first_seen, last_seen FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key)",
    "reliable_coverage": f"SELECT cluster_key, reliable_sources FROM ({CLUSTERS} FROM ({KEYS}) GROUP BY cluster_key)",
    "event_report_counts": f"SELECT event_id, count(*) AS reports, count(DISTINCT CASE WHEN reliability >= 0.65 THEN source_id END) AS reliable_sources, array_to_string(list_sort(list(DISTINCT source_name)), '|') AS names FROM ({JOINED}) GROUP BY event_id",
    "event_detail": f"SELECT e.id, e.canonical_title, coalesce(j.reports, 0) AS reports, j.best_score FROM event_clusters e LEFT JOIN (SELECT event_id, count(*) AS reports, max(rank_score) AS best_score FROM ({JOINED}) GROUP BY event_id) j ON j.event_id = e.id",
    "similar_reports": f"SELECT event_id, item_id, row_number() OVER (PARTITION BY event_id ORDER BY reliability DESC NULLS LAST, published_at DESC NULLS LAST, item_id) AS place FROM ({JOINED}) WHERE event_id IS NOT NULL AND event_id <> 0",
    "new_items_anti": f"SELECT id, status FROM ({RAW}) r WHERE NOT EXISTS (SELECT 1 FROM processed_items p WHERE p.raw_item_id = r.id)",
    "scoped_semi": f"SELECT id, source_id FROM ({RAW}) r WHERE EXISTS (SELECT 1 FROM processed_items p WHERE p.raw_item_id = r.id AND workflow_run_id IS NOT NULL AND rank_score >= 0.6)",
    "orphan_candidates": f"SELECT id, source_id FROM ({RAW}) r WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.id = r.source_id AND s.enabled)",
    "classify_events": f"SELECT id, array_to_string(event_types, '|') AS event_types FROM ({CLASSED})",
    "classify_roles": f"SELECT id, array_to_string(subject_roles, '|') AS subject_roles FROM ({CLASSED})",
    "classify_signals": f"SELECT id, array_to_string(signals, '|') AS signals FROM ({CLASSED})",
    "classify_industry": f"SELECT id, class_industry FROM ({CLASSED})",
    "classify_subtags": f"SELECT id, array_to_string(subtags, '|') AS subtags FROM ({CLASSED})",
    "classify_importance": f"SELECT id, importance, class_confidence, importance_reason, actor_level FROM ({CLASSED})",
    "item_tags": f"WITH c AS ({CLASSED}) SELECT id, dimension, value FROM ({TAGS})",
    "tag_counts": f"WITH c AS ({CLASSED}) SELECT dimension, value, count(*) AS n FROM ({TAGS}) GROUP BY ALL",
    "tags_by_dimension": f"WITH c AS ({CLASSED}) SELECT id, dimension, string_agg(value, '|' ORDER BY ord) AS tag_values FROM ({TAGS}) GROUP BY id, dimension",
    "entities": " UNION ALL ".join(f"SELECT id, {lit(a)} AS entity, {lit('agency' if a in V.agencies else 'company')} AS entity_type, instr(txt, {lit(a)}) - 1 AS concat_offset FROM (SELECT id, CASE WHEN length(title) % 2 = 0 THEN {lit(V.actors[3] + ' ')} || txt ELSE txt END AS txt FROM ({ITEMS})) WHERE contains(txt, {lit(a)})" for a in V.actors),
    "taxonomy_violations": f"SELECT id, relevance_industry AS unknown FROM ({RAW}) WHERE relevance_industry NOT IN ('nev', 'ai', 'artificial_intelligence')",
    "rank_score": f"SELECT id, rank_score FROM ({ANALYSED})",
    "rank_breakdown": f"SELECT id, round(i_s, 4) AS importance_score, round(s_s, 4) AS source_score, round(f_s, 4) AS freshness_score, round(e_s, 4) AS event_type_score, round(c_s, 4) AS coverage_score, round(k_s, 4) AS key_actor_score FROM ({ANALYSED})",
    "freshness_buckets": f"SELECT {fresh(FRESH_AT, iso('published_at'), iso('fetched_at'))} AS freshness, count(*) AS n FROM ({ITEMS}) GROUP BY 1",
    "summary_counts": "SELECT count(*) AS total_items, count(*) FILTER (importance_level = 'high') AS high_items, (SELECT count(*) FROM sources WHERE enabled) AS enabled_sources, (SELECT count(*) FROM workflow_runs) AS runs, greatest(0, count(*) - count(*) FILTER (importance_level = 'high')) AS evidence_to_verify FROM (SELECT DISTINCT ON (id) * FROM processed_items)",
    "latest_run_per_trigger": "SELECT trigger_type, id, started_at FROM workflow_runs QUALIFY row_number() OVER (PARTITION BY trigger_type ORDER BY started_at DESC, id DESC) = 1",
    "runs_page": "SELECT id, started_at, status FROM workflow_runs ORDER BY started_at DESC, id DESC LIMIT 10 OFFSET 10",
    "run_durations": f"SELECT id, CASE WHEN {iso('ended_at')} IS NULL THEN NULL ELSE greatest(0, {iso('ended_at')} - {iso('started_at')}) END AS seconds FROM workflow_runs",
    "close_duplicate_running": "SELECT id, CASE WHEN status = 'running' AND row_number() OVER (PARTITION BY status ORDER BY started_at DESC, id DESC) > 1 THEN 'failed' ELSE status END AS new_status FROM (SELECT id, started_at, status FROM workflow_runs UNION ALL SELECT id + 1000000, started_at, 'running' FROM workflow_runs WHERE status <> 'failed')",
    "run_counters": "SELECT w.id, count(p.id) AS extracted, count(DISTINCT p.canonical_event_id) AS deduped FROM workflow_runs w LEFT JOIN (SELECT DISTINCT ON (id) * FROM processed_items) p ON p.workflow_run_id = w.id GROUP BY w.id",
    "content_hash": f"SELECT id, {_HASH} AS content_hash FROM ({ITEMS})",
    "exact_duplicates": f"SELECT content_hash, count(*) AS n, min(id) AS first_id FROM (SELECT id, {_HASH} AS content_hash FROM (SELECT id, title, raw_content FROM ({ITEMS}) UNION ALL SELECT -id, ' ' || title, raw_content || ' ' || chr(10) || ' ' FROM ({ITEMS}) WHERE source_type = 'government')) GROUP BY content_hash HAVING count(*) > 1",
    "excerpt": f"SELECT id, CASE WHEN length(x) <= 360 THEN x ELSE rtrim(substr(x, 1, 360), ' ') || '...' END AS excerpt FROM (SELECT id, {compact('raw_content')} AS x FROM ({ITEMS}))",
    "compact_text": f"SELECT doc_id, {compact('text')} AS compact FROM documents",
    "url_dates": f"SELECT id, CAST(url_day AS VARCHAR) AS day FROM ({TEXT_DATES}) WHERE url_day IS NOT NULL",
    "text_dates": f"SELECT id, CAST(text_day AS VARCHAR) AS day FROM ({TEXT_DATES}) WHERE text_day IS NOT NULL",
    "iso_dates": f"SELECT id, {iso('published_at')} AS published_s, {iso('fetched_at')} AS fetched_s FROM ({RAW})",
    "backfill_dates": f"SELECT id, CAST(coalesce(text_day, url_day) AS VARCHAR) AS day, CASE WHEN text_day IS NOT NULL THEN 'text' ELSE 'url' END AS origin FROM ({TEXT_DATES}) WHERE published_at IS NULL AND coalesce(text_day, url_day) IS NOT NULL",
    "clean_url": f"SELECT id, regexp_replace(url || '#top', '#.*$', '') AS clean FROM ({RAW})",
    "candidate_urls": LINKS,
    "page_titles": f"SELECT id, {compact('title')} AS title, 1 AS links FROM ({RAW}) WHERE title IS NOT NULL",
    "key_facts": f"SELECT id, {first(f'{_actor_list}[1]', 'author', chr(39) + '相关主体' + chr(39))} AS who, title AS what, {first('published_at', 'fetched_at')} AS when_text, {_where} AS \"where\", importance_reason AS why, {IMPACT} AS impact, substr({first(compact('raw_content'), compact('content_excerpt'), compact('title'))}, 1, 180) AS evidence FROM ({CLASSED})",
    "summary_sentence": f"SELECT id, substr({first(compact('content_excerpt'), compact('raw_content'), compact('title'))}, 1, 150) || ' 该信息被识别为' || array_to_string(event_types[1:2], '、') || '，重要性为 ' || importance || '。' AS summary_sentence FROM ({CLASSED})",
    "impact_sentence": f"SELECT id, {IMPACT} AS impact_sentence FROM ({CLASSED})",
    "source_span": f"SELECT id, CASE WHEN length(raw_content) > 0 THEN 'raw_content' WHEN length(content_excerpt) > 0 THEN 'content_excerpt' ELSE 'title' END AS field, least(180, length(w)) AS end_at, substr({compact('w')}, 1, 180) AS quote FROM (SELECT *, {first('raw_content', 'content_excerpt', 'title')} AS w FROM ({ITEMS}))",
    "brief_items": f"SELECT row_number() OVER (ORDER BY {RANK}) AS place, item_id, rank_score, source_name FROM ({JOINED}) ORDER BY place LIMIT 8",
    "brief_markdown": f"""SELECT '# 产业舆情简报' || chr(10) || chr(10) || string_agg('## ' || place || '. ' || normalized_title || chr(10) || '- 综合价值分：' || printf('%.2f', rank_score) || chr(10) || '- 来源：' || source_name || chr(10) || '- 原文：' || url || chr(10), chr(10) ORDER BY place) AS content_markdown,
 min({DISPLAY}) AS time_range_start, max({DISPLAY}) AS time_range_end, '[' || string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY place) || ']' AS item_ids FROM (SELECT *, row_number() OVER (ORDER BY {RANK}) AS place FROM ({JOINED}) ORDER BY place LIMIT 8)""",
    "brief_row": f"""SELECT 'daily' AS brief_type, '产业舆情简报 ' || substr(coalesce(max({DISPLAY}), ''), 1, 10) AS title, CAST(count(*) AS INTEGER) AS n_items, length('# 产业舆情简报' || chr(10) || chr(10) || string_agg('## ' || place || '. ' || normalized_title || chr(10) || '- 综合价值分：' || printf('%.2f', rank_score) || chr(10) || '- 来源：' || source_name || chr(10) || '- 原文：' || url || chr(10), chr(10) ORDER BY place)) AS size
 FROM (SELECT *, row_number() OVER (ORDER BY {RANK}) AS place FROM ({JOINED}) ORDER BY place LIMIT 8)""",
    "source_upsert": "SELECT id, CASE WHEN NOT enabled THEN name || ' (new)' ELSE name END AS name, CASE WHEN NOT enabled THEN 45 ELSE fetch_interval_minutes END AS fetch_interval_minutes, enabled FROM sources UNION ALL SELECT id + 1000, name, 45, false FROM sources WHERE type = 'government'",
    "patch_source": "SELECT id, CASE WHEN type <> 'media' THEN NULL ELSE industry_hint END AS industry_hint, CASE WHEN type <> 'media' THEN 15 ELSE fetch_interval_minutes END AS fetch_interval_minutes FROM sources",
    "guarded_delete": "SELECT id, name FROM (SELECT id, name FROM sources UNION ALL SELECT max(id) + 1, 'nobody''s' FROM sources) WHERE id NOT IN (SELECT source_id FROM raw_items WHERE source_id IS NOT NULL)",
    "ledger_enrich": f"SELECT id, CASE WHEN status = 'processed' THEN 'screened' ELSE relevance_reason END AS relevance_reason FROM ({RAW})",
    "json_fields": f"SELECT id, coalesce(array_to_string(from_json(relevance_matched_terms_json, '[\"VARCHAR\"]'), '|'), '') AS terms FROM ({RAW})",
    "profile_counts": f"SELECT source_type, status, industry, count(*) AS n FROM (SELECT source_type, status, coalesce(relevance_industry, 'none') AS industry FROM ({ITEMS})) GROUP BY GROUPING SETS ((source_type), (status), (industry))",
    "class_overrides": f"SELECT c.id, coalesce(p.level, c.importance) AS importance, CASE WHEN p.level IS NOT NULL THEN 'answer' ELSE 'rules' END AS class_mode, CASE WHEN p.level IS NOT NULL THEN '产品发布' ELSE array_to_string(event_types, '|') END AS event_types FROM ({CLASSED}) c LEFT JOIN (SELECT raw_item_id, max(importance_level) AS level FROM processed_items GROUP BY raw_item_id) p ON p.raw_item_id = c.id",
    "event_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "event_dedupe": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    "cosine_topk": """SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS neighbour_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))), 6) AS similarity,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, v.vec_id) AS place FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE place <= 5""",
    "item_trace": f"SELECT item_id, 'collect>normalize>deduplicate>classify_tag>rank>extract' AS nodes, url, length({first('raw_content', 'content_excerpt')}) AS length, event_id AS event, importance_level AS importance, rank_score AS score, summary FROM ({JOINED.replace('i.content_excerpt FROM', 'i.content_excerpt, i.raw_content FROM')})",
}
