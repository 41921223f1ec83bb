"""Trusted marks of residue: unfilled templates, filler, error pages and script notices.

No wordings are listed. Marks are the syntax of templates, blanks and the customary filler words, on folded text (NFKC, lower case);
notices are known by the parts they are made of, in English, Chinese and German (README has the recall).
"""

from __future__ import annotations

import re

#: The words of the customary filler text, and what is typed to fill a field.
LOREM = "lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|do|eiusmod|tempor|incididunt|ut|labore|et|dolore|magna|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|ex|ea|commodo|consequat|duis|aute|irure|in|reprehenderit|voluptate|velit|esse|cillum|eu|fugiat|nulla|pariatur|excepteur|sint|occaecat|cupidatat|non|proident|sunt|culpa|qui|officia|deserunt|mollit|anim|id|est|laborum"
TYPED = r"asdf|qwer(?:ty)?|test|foo|bar|baz|blah|aaaa|bbbb|cccc|lorem|ipsum|xxxx|okok\w*|(?:test){2,}|(?:asd){2,}|x{4,}|1111|123"
_FILLED = re.compile(rf"(?:\b(?:{TYPED})\b[ .,]*){{2,}}|(?:\b(?:{LOREM})\b[ .,]*){{5,}}")
_FILLER = frozenset(LOREM.split("|")) | frozenset("asdf qwer qwerty test foo bar baz blah aaaa bbbb cccc xxxx".split())
_AGAIN_WIDE = re.compile(r"([一-鿿]{2,8}?)\1{2,}")
#: Placeholders of template languages, names of template variables, and what programs print for nothing.
_SYNTAX = re.compile(r"\$\{[^{}\n]{1,60}\}|\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<[%#]=?[^<>\n]{1,60}[%#]>|<[a-z]+_[a-z_]+>|\[\[[^\[\]\n]{1,60}\]\]|%%[^%\n]{1,60}%%|(?:undefined nan )?\[object object\]")
_FIELDS = "body title byline summary lead caption headline text abstract".split()
_VARIABLE = re.compile(rf"\b(?:cms|news|article|story|post|page|item)(?:[._](?:page|body|html))?[._](?:{'|'.join(_FIELDS)})(?:[._]?p\d+)?\b")
_VARIABLE_ENDS = tuple(c + f for c in "._" for f in _FIELDS)
#: A blank left where a name, sum, date or place belongs; counts when a line holds several.
BLANK = re.compile(r"_{3,}|\b(?:x{2,4}|yyy|zzz|tbd)\b|(?<![a-z])xx(?![a-z])|\*{3,}|\[\.{2,3}\]|<tbd>|\((?:待填|待补|待定|tbd|tba)\)|\bdd[/.-]mm[/.-]yyyy\b|\[[a-zäöü_ ]{3,20}\]|【[^【】\n]{2,6}】|〔[^〔〕\n]{2,6}〕|<[a-zäöü_ ]{2,16}>|<[一-鿿]{2,6}>")
_BLANK_SIGNS = ("___", "xx", "yyy", "zzz", "***", "[", "<", "(待", "tb", "【", "〔", "/mm", ".mm", "-mm")
_WORD = re.compile(r"[^\W\d_]")
_LATIN_WORD = re.compile(r"[a-z]+")
_ID = re.compile(r"\b(?=\w*\d)[0-9a-z_\-]{4,}\b|\d{4,}|[\[(][0-9a-f]{4,}[\])]|(?<=[:# ])(?:[0-9a-f]{6,})\b")


def few_pairs(folded: str) -> bool:
    """Whether a line has few different pairs of characters, as one that repeats itself to a large share has."""
    n = len(folded)
    return len({folded[k : k + 2] for k in range(n)}) <= 0.65 * n + 4


def _without_marks(folded: str) -> str:
    """The line without marks. Cheap tests go first: hardly any line holds what the patterns look for."""
    out = folded
    if any(c in out for c in "{<[%"):
        out = _SYNTAX.sub(" ", out)
    if any(c in out for c in _VARIABLE_ENDS):
        out = _VARIABLE.sub(" ", out)
    # The shortest of what counts are two typed words or five of the filler text; a number among them doesn't count.
    if sum(w in _FILLER for w in _LATIN_WORD.findall(out)) >= 2:
        out = _FILLED.sub(" ", out)
    if _HAN.search(out) and few_pairs(out):
        out = _AGAIN_WIDE.sub(" ", out)
    return out


def residue_share(folded: str) -> float:
    """Share of a folded line's letters that marks of residue cover; 1 for a line with several unfilled blanks."""
    blanks = len(BLANK.findall(folded)) if any(c in folded for c in _BLANK_SIGNS) else 0
    rest = _without_marks(folded)
    if not blanks and rest == folded:
        return 0.0
    total = len(_WORD.findall(folded))
    if blanks >= 3 and blanks * 30 >= total:
        return 1.0
    if rest == folded:
        return 1.0 if len(_WORD.findall(BLANK.sub("", folded))) <= 0.2 * total + 2 else 0.0
    left = len(_WORD.findall(_ID.sub(" ", BLANK.sub(" ", rest))))
    return 1.0 - left / total if total else 1.0


# General evidence -------------------------------------------------------------------------------------------------------
#
# Notices are not known by their wording: a line that names something of a site, says that it failed, or tells what to do about it, in
# hardly any other words, is one. Words by their part in such a notice, in English, Chinese and German.

_STATUS = r"\b(?:http ?)?[45][0-9]{2}\b"
_FAILED = r"""
not found|can ?not|can'?t|could(?: not|n'?t)|unable|unavailable|not (?:available|exist|respond|work|load)\w*|does(?: not|n'?t)|did(?: not|n'?t)|expired|denied|forbidden|unauthori[sz]ed|refused|rejected|error|errors|failed|failure|wrong|
timed? ?-?out|timeout|no longer|missing|gone|removed|deleted|withdrawn|broken|invalid|blocked|disabled|bad|sorry|oops|nothing|maintenance|interrupted|crashed|\w*exception|\w*error|overloaded|too many|limit exceeded|isn'?t|is not
不存在|找不到|无法|未找到|没有找到|失败|错误|出错|超时|失效|过期|拒绝|繁忙|抱歉|下线|删除|撤回|撤下|异常|打不开|走丢|不可用|无响应|维护|中断|禁止|禁用|拦截|崩溃|不支持|过于频繁|受限|无权
nicht gefunden|nicht (?:erreichbar|verfügbar|möglich|mehr|geladen|angezeigt|gefunden)|konnte\w* nicht|kann nicht|existiert nicht|fehler\w*|fehlgeschlagen|serverfehler|abgelaufen|verweigert|leider|ungültig|gesperrt|blockiert|deaktiviert|entfernt|gelöscht|wartung\w*|überlastet|zeitüberschreitung|ins leere|nichts
"""
_SITE = r"""
page|pages|site|website|link|url|address|server|gateway|service|session|database|request|connection|browser|content|article|story|document|resource|incident|traceback|host|region|captcha|robot|human|access|account|proxy|network
页面|网页|网站|链接|网址|服务器|网关|数据库|访问|系统|浏览器|请求|登录|会话|内容|文章|稿件|首页|接口|网络|连接|服务|资源|域名|权限|连接|安全验证|编号|代码
seite|webseite|link|url|adresse|server\w*|gateway|dienst|sitzung|datenbank|anfrage|verbindung|browser|inhalt|inhalte|artikel|beitrag|zugriff|vorgang|anwendung|netzwerk
"""
_REMEDY = r"""
try (?:it )?again|try later|retry|reload|refresh|go back|return to|check|contact|log in|sign in|enable|turn (?:it |them )?on|switch on|activate|allow|verify|wait|slow down|update your|support|administrator
稍后|重试|再试|刷新|返回|联系|检查|重新|开启|启用|更换|验证|允许|请稍候|管理员|升级|完成|继续
erneut|noch einmal|später|neu laden|aktivieren|einschalten|erlauben|erlaube|prüfen|zurück|anmelden|wenden sie sich|warten|administrator|aktualisieren
"""
_SCRIPT = r"""
javascript|java script|js|scripts?|scripting|noscript|脚本|skripte?|skripten
"""
_NEEDED = r"""
needs?|needed|requires?|required|must be|without|supports?|supported
需要|必须|支持|才能|依赖
benötigt|benötigen|erforderlich|braucht|ohne|unterstützt|aktive?
"""
_TEXT = r"""
text|headline|title|paragraph|lead|article|body|summary|caption|copy|story|name|date
正文|标题|摘要|导语|文章|内容|图片|作者|日期|文字|字数|\d+字
titel|überschrift|text|absatz|artikel|bildunterschrift|vorspann|name|datum
"""
_PENDING = r"""
insert|replace|goes here|to come|to follow|placeholder|sample|dummy|todo|tbd|tba|not for publication|before publishing|add your|enter your|type your|lorem|unpublished|draft
待补|待填|待定|待编辑|待完善|此处|填写|插入|占位|示例|草稿|请替换|样稿|测试|插入|以内
einfügen|einsetzen|ersetzen|folgt|platzhalter|mustertext|muster|beispieltext|blindtext|entwurf|noch nicht freigegeben|hier steht|eintragen
"""


def _words(block: str) -> tuple[re.Pattern, re.Pattern]:
    """Patterns of the words in the wide scripts, which need no bounds, and of the others."""
    words = [w.strip() for w in block.replace("\n", "|").split("|")]
    # Splitting is at bars outside brackets only.
    joined, depth = [], 0
    for w in words:
        if depth:
            joined[-1] += "|" + w
        elif w:
            joined.append(w)
        depth += w.count("(") - w.count(")")
    wide = [w for w in joined if w[0] >= "一"]
    narrow = [w for w in joined if w[0] < "一"]
    return re.compile("|".join(wide) or r"(?!)"), re.compile(rf"\b(?:{'|'.join(narrow)})\b")


_PARTS = {k: _words(v) for k, v in dict(failed=_FAILED, site=_SITE, remedy=_REMEDY, script=_SCRIPT, needed=_NEEDED, text=_TEXT, pending=_PENDING).items()}
#: Filler that says one short thing three times or more.
_AGAIN = re.compile(r"([^\W\d_]{2,12}?)[\W_]*(?:\1[\W_]*){2,}")
_PARTS["status"] = (re.compile(r"(?!)"), re.compile(_STATUS))
#: One of these is in each pair of _NOTICES, so without them there is nothing to look for.
_LEADING = ("failed", "script", "pending", "site")
_HAN, _LATIN = re.compile("[一-鿿]"), re.compile("[a-z0-9]")
#: Pairs of parts that make a notice, and the least share of a line's letters and digits that parts and small words must cover.
_NOTICES = (("failed", "site"), ("failed", "remedy"), ("failed", "status"), ("site", "status"), ("script", "remedy"), ("script", "failed"), ("script", "needed"), ("site", "remedy"), ("text", "pending"))
_SMALL = re.compile(r"\b(?:the|this|that|your?|you|we|it|is|are|was|were|to|of|on|in|at|for|or|and|an?|be|been|has|have|may|need|needs|please|our|here|by|with|from|us|if|again|later|die|der|das|den|dem|ein|eine|einen|sie|ihre?n?|ist|sind|wurde|wird|war|und|oder|bitte|zu|um|auf|in|im|es|hier|intern\w*|internal|fatal|most recent call last|dieser?|dieses|nicht|für|von)\b|[您请该本的了已被或在后并与和来以到再你此]")
_LONGEST, _NOTICE = 160, 0.6


def notice(folded: str) -> bool:
    """Whether a line says little but that something of a site failed, needs scripts or is yet to be filled in; for values without a story."""
    if not folded or len(folded) > _LONGEST:
        return False
    n = len(folded)
    # What repeats to such a share has few different pairs of characters.
    if few_pairs(folded) and sum(m.end() - m.start() for m in _AGAIN.finditer(folded)) >= _NOTICE * n:
        return True
    scripts = [k for k, x in enumerate((_HAN, _LATIN)) if x.search(folded)]
    spans = {name: [m.span() for k in scripts for m in _PARTS[name][k].finditer(folded)] for name in _LEADING}
    if not any(spans.values()):
        return False
    spans |= {name: [m.span() for k in scripts for m in _PARTS[name][k].finditer(folded)] for name in _PARTS if name not in spans}
    if not any(spans[a] and spans[b] for a, b in _NOTICES):
        return False
    covered = bytearray(n)
    for a, b in [*(x for each in spans.values() for x in each), *(m.span() for pattern in (_SMALL, _ID) for m in pattern.finditer(folded))]:
        covered[a:b] = b"\1" * (b - a)
    letters = [k for k, c in enumerate(folded) if c.isalnum()]
    return sum(covered[k] for k in letters) >= _NOTICE * len(letters)
