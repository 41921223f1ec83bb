"""Web pages and feeds: byte decoding, parsing and the predicates on links and bodies.

Parsing is a stateful scan, so it runs in Arrow batches; the predicates are built-in expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions import text as T
from skeinwork.sources.cleaning import HIDDEN, clean

# Meta keys that hold a publication date, in order.
DATE_KEYS = ("article:published_time", "og:article:published_time", "publishdate", "publish_date", "pubdate", "date", "dc.date", "dc.date.issued")
# Character pairs that betray a wrong decoding, of the commonest confusions of UTF-8 with Latin and Chinese encodings.
MOJIBAKE = ("ï¼", "ï½", "ï»¿", "â€", "â", "Ã", "Â", "ä¸", "äº", "å", "æ–", "è½", "èƒ", "é¾", "çš", "锛", "鈥", "銆", "妯", "鍙", "浜", "绛", "ðŸ")

PAGE = "struct<title:string,description:string,body:string,published:string,links:array<struct<href:string,text:string>>>"
_PAGE = pa.struct([("title", pa.string()), ("description", pa.string()), ("body", pa.string()), ("published", pa.string()), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())])))])
_BLANKS = re.compile(r"\s+")


def one_line(text: str) -> str:
    return _BLANKS.sub(" ", text).strip()


def decode(payload: bytes | None, content_type: str | None = None) -> str:
    """Bytes to text: of the encodings that fit, the one whose result shows the fewest signs of a wrong decoding, the earlier on ties."""
    if not payload:
        return ""
    named = re.search(r"charset=([\w.-]+)", content_type or "", re.I)
    best = None
    for place, encoding in enumerate(dict.fromkeys([*([named[1]] if named else []), "utf-8", "gb18030", "windows-1252", "latin-1"])):
        try:
            text = payload.decode(encoding)
        except (LookupError, UnicodeDecodeError):
            continue
        odd = 100 * text.count("�") + 20 * sum("\x80" <= c <= "\x9f" for c in text) + 10 * sum(map(text.count, MOJIBAKE))
        best = min(best or (odd, place, text), (odd, place, text))
    return best[2] if best else payload.decode("utf-8", "replace")


def looks_like_feed(text: str) -> bool:
    head = text[:200].lower()
    return head.startswith("<?xml") or any(tag in head for tag in ("<rss", "<feed", "<rdf"))


class _Reader(HTMLParser):
    """Collects title, meta values, links and text; everything inside silent tags is passed over, nested or not."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.silent: list[str] = []
        self.meta: dict[str, str] = {}
        self.title: list[str] = []
        self.body: list[str] = []
        self.links: list[tuple[str, list[str]]] = []
        self.in_title = self.in_link = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in HIDDEN:
            self.silent.append(tag)
        elif not self.silent:
            values = {k: v or "" for k, v in attrs}
            if tag == "meta" and (key := (values.get("name") or values.get("property") or "").lower()) and values.get("content"):
                self.meta[key] = one_line(html.unescape(values["content"]))
            self.in_title |= tag == "title"
            if tag == "a" and values.get("href"):
                self.links.append((values["href"], []))
                self.in_link = True

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag)]
            return
        if tag == "title":
            self.in_title = False
        elif tag == "a":
            self.in_link = False

    def handle_data(self, data: str) -> None:
        text = "" if self.silent else clean(data)
        if not text:
            return
        if self.in_title:
            self.title.append(text)
        if self.in_link:
            self.links[-1][1].append(text)
        if len(text) > 1:
            self.body.append(text)


def parse(page: str | None, base: str | None) -> dict | None:
    """Title, description, body, publication text and links (made absolute, fragments dropped, first of each kept) of a page; null for a null page."""
    if page is None:
        return None
    reader = _Reader()
    reader.feed(page)
    reader.close()
    links: dict[str, str] = {}
    for href, words in reader.links:
        try:
            url = urldefrag(urljoin(base or "", href.strip()))[0]
        except ValueError:
            continue
        if (label := one_line(" ".join(words))) and url not in links:
            links[url] = label
    meta = reader.meta
    published = next((meta[k] for k in DATE_KEYS if meta.get(k)), None)
    return {"title": one_line(" ".join(reader.title)), "description": meta.get("description") or meta.get("og:description") or "", "body": one_line(" ".join(reader.body)), "published": published, "links": [{"href": k, "text": v} for k, v in links.items()]}


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(page: str | None, base: str | None) -> dict | None:
        try:
            return parse(page, base)
        except (AssertionError, ValueError):  # what the parser raises on markup it can't read: such a page is empty
            return {"title": "", "description": "", "body": "", "published": None, "links": []}

    for batch in batches:
        pages = [one(h, u) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pages, _PAGE)], names=["id", "page"])


def parsed(rows: DataFrame) -> DataFrame:
    """(id, page) of rows(id, url, html); page is null where html is."""
    return rows.select("id", "url", "html").mapInArrow(_parse_batches, f"id bigint, page {PAGE}")


_ENTRIES = pa.list_(pa.struct([(k, pa.string()) for k in ("title", "link", "content", "published")]))
ENTRIES = "array<struct<title:string,link:string,content:string,published:string>>"


def feed_entries(document: str | None) -> list[dict] | None:
    """Entries of an RSS, Atom or RDF feed with a title and a link, in order; null for a null or malformed document."""
    if document is None:
        return None
    try:
        root = ElementTree.fromstring(document.strip())
    except (ElementTree.ParseError, ValueError):
        return None
    out = []
    for node in root.iter():
        if _name(node) in ("item", "entry"):
            found: dict[str, str] = {}
            for child in node:
                found.setdefault(_name(child), (child.get("href") if _name(child) == "link" else None) or one_line("".join(child.itertext())))
            content = next((found[k] for k in ("description", "summary", "content", "encoded") if found.get(k)), "")
            date = next((found[k] for k in ("pubdate", "published", "updated", "date") if found.get(k)), None)
            if found.get("title") and found.get("link"):
                out.append({"title": found["title"], "link": found["link"], "content": clean(content), "published": date})
    return out


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _feed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(map(feed_entries, batch.column("xml").to_pylist())), _ENTRIES)], names=["id", "entries"])


def feeds(rows: DataFrame) -> DataFrame:
    """(id, entries) of rows(id, xml); entries is null for malformed documents, so one bad feed never fails a run."""
    return rows.select("id", "xml").mapInArrow(_feed_batches, f"id bigint, entries {ENTRIES}")


# Fixed values of the link predicate.
_LISTING_URL = ("investorannals", "investorrelations", "periodic-reports")
_LISTING_TITLE = ("periodic reports", "investor relations", "annual reports", "interim reports")
_NO_ARTICLE = ("javascript:", "mailto:", "/login", "/signin", "beian.gov.cn")
_FILES = r"\.(jpg|jpeg|png|gif|svg|css|js|ico|zip|rar)$"
_NAV_PATH = ("about", "contact", "lxwm", "xwzx", "news", "index", "home", "disclosure", "listed", "notice", "press", "blog", "reits")
_NAV_TITLE = ("联系我们", "联系", "新闻中心", "新闻发布", "信息披露", "首页", "公网安备", "copyright", "sitemap", "关于我们")
_ARTICLE = (r"/20\d{2}", r"20\d{6,}", r"t20\d{6}_", r"content_\d+", r"art_\w+", r"/c\.html$", r"/news/[^/]*\d+", r"/[^/]*\d+[^/]*\.(html|htm|shtml)$")
_ARTICLE_TITLE = ("发布", "召开", "印发", "公告", "通知", "公示", "签署", "会见", "调研", "投资", "融资", "launch", "announces", "article", "release", "reports")


def usable_link(base: Column, url: Column, title: Column) -> Column:
    """Whether a link looks like an article: an http address other than the page's own, no listing, login, file or navigation target."""
    low, low_title = F.lower(url), F.lower(title)
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", ""), "/+$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    parent = F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    nav_title = T.any_of(title, _NAV_TITLE)
    index_page = last.isin("index.html", "index.htm", "index.shtml", "") & (parent.isin(*_NAV_PATH) | nav_title)
    barred = T.any_of(low, _LISTING_URL) | T.any_of(low_title, _LISTING_TITLE) | T.any_of(low, _NO_ARTICLE) | low.rlike(_FILES) | index_page | last.isin(*_NAV_PATH) | nav_title
    looks = low.rlike("|".join(f"(?:{p})" for p in _ARTICLE)) | ((F.length(title) >= 14) & (T.any_of(title, _ARTICLE_TITLE) | T.any_of(low_title, _ARTICLE_TITLE)))
    return low.rlike("^https?://") & (T.without_fragment(base) != url) & (F.length(title) >= 4) & ~barred & looks


# Fixed values of the body predicate.
_SHELL = ("首页", "APP下载", "登录", "注册", "投稿", "验证码", "联系我们", "联系邮箱", "版权所有", "站内导航", "版权声明", "扫码下载APP", "用户 反馈", "提交成功")
_PHRASES = ("企业库", "销量", "查询", "采购", "项目", "AutoNews", "工具栏", "寻求", "报道", "公众号")
_LEFT_OVER = ("html4", "purchaseInfo", "ProductName", "add-author")
_TAGS = (
    "a", "article", "aside", "blockquote", "body", "button", "canvas", "cite", "div", "em", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "img", "input", "label", "li", "main", "nav", "ol", "p", "path", "section", "span", "strong", "svg", "ul",
)


def substantive(body: Column, title: Column) -> Column:
    """Whether a cleaned body holds an article rather than a page shell. body and title: compacted text."""
    rest = F.when((title != "") & (F.instr(body, title) > 0), F.concat(F.substring(body, F.lit(1), F.instr(body, title) - 1), F.lit(" "), F.substring(body, F.instr(body, title) + F.length(title), F.length(body)))).otherwise(body)
    meaning = F.regexp_replace(rest, r"(?i)\bhttps?://\S+", " ")
    hits = sum((meaning.contains(p).cast("int") for p in _PHRASES), F.lit(0))
    left = F.regexp_replace(meaning, "|".join(_PHRASES), " ")
    shells = sum((body.contains(m).cast("int") for m in _SHELL), F.lit(0))
    wide = lambda c: F.regexp_count(c, F.lit("[一-鿿]"))
    words = lambda c: F.regexp_count(c, F.lit("[A-Za-z][A-Za-z-]{2,}"))
    tokens = F.regexp_extract_all(F.lower(left), F.lit("[a-z][a-z0-9-]*"), 0)
    tags_only = (F.size(tokens) >= 3) & F.forall(tokens, lambda x: x.isin(*_TAGS))
    shell = (shells >= 5) & ((wide(rest) < 120) | (F.regexp_count(rest, F.lit("[。！？!?]")) < 2)) | (shells >= 3) & (wide(rest) < 80) & (words(rest) < 20)
    return (F.length(body) >= 20) & ~(shell | T.any_of(body, _LEFT_OVER) | tags_only | (hits >= 2) & (wide(left) < 20) & (words(left) < 8))
