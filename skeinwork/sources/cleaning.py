"""Cleaning article text that page code has leaked into.

One reader over markup drops elements that hide their content; a second one walks over bracketed blocks and drops those whose tokens are
code rather than words, with the code tokens that lead up to them. No sites, scripts or trackers are known by name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text.
HIDDEN = ("script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed")

_MARKUP = re.compile(r"<!--.*?-->|<!\w[^<>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?:\s[^<>]*)?/?>", re.S)
_COMMENT = re.compile(r"/\*.*?\*/", re.S)
_INSIDE = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{}]")
_SIGN = re.compile(r"[:;=()\[\]\"'#$.,|&]")
_BINDING = re.compile(r"[:;=(]")
_LETTER = re.compile(r"[^\W\d_]")
#: What a token of code has that a word hasn't; and words of programs that lead up to a block.
_CODED = re.compile(r"[@#$=()\[\]_*>]|^[.:]\w|\w\.\w|^[,;>+~]+$|^[\w-]+:$")
_KEYWORD = frozenset("async await function var let const if else for while do try catch finally switch return new typeof".split())
_ELEMENT = frozenset("html body main header footer nav section article aside div span p ul ol li a img h1 h2 h3 h4 h5 h6 table tr td th form input button svg label".split())
_CLOSING = re.compile(r"[\s)(;,]*[);]")
#: Statements without a block: an assignment or call that ends in a semicolon, and rules of a style sheet that have none.
_STATEMENT = re.compile(r"(?:(?<=\s)|^)(?:(?:var|let|const)\s+)?[\w$][\w$.]*\s*(?:=\s*[^\s=;][^;{}]{0,200}|\([^;{}]{0,200}\))\s*;(?=\s|$)|@\w+\s+[\"'][^\"']*[\"']\s*;?")
_LOOSE = re.compile(r"(?:(?<=\s)|^)[{}();,]*[{}][{}();,]*(?=\s|$)")
_NEEDED = re.compile(r"[<{}&;@]|/\*")


def _visible(text: str) -> str:
    """The text between tags, without that of hidden elements; one that is never closed hides nothing."""
    out, at, hidden, since = [], 0, "", 0
    for tag in _MARKUP.finditer(text):
        name = (tag["name"] or "").lower()
        if hidden:
            if name == hidden and tag["end"]:
                hidden, at = "", tag.end()
            continue
        out.append(text[at : tag.start()])
        at = tag.end()
        if name in HIDDEN and not tag["end"] and not tag[0].endswith("/>"):
            hidden, since = name, tag.end()
    rest = text[since:] if hidden else text[at:]
    return " ".join([*out, _MARKUP.sub(" ", rest) if hidden else rest])


def block_end(text: str, start: int) -> int:
    """Place behind the brace that closes the one at `start`, -1 if none does. Braces within quotes don't count."""
    depth = 0
    for token in _INSIDE.finditer(text, start):
        if token[0] == "{":
            depth += 1
        elif token[0] == "}":
            depth -= 1
            if depth == 0:
                return token.end()
    return -1


def _is_code(inside: str) -> bool:
    """Whether signs stand among the letters as thickly as in programs, style sheets and data; in prose there is one in some thirty.

    One of them must bind, assign, call or end something: a placeholder such as {% page.title %} does not.
    """
    signs = len(_SIGN.findall(inside))
    return not inside.strip() or signs * 12 >= len(_LETTER.findall(inside)) and _BINDING.search(inside) is not None


def _lead(before: str) -> int:
    """Where the code that leads up to a block begins: behind the last token that can only be a word of the text."""
    begin, follows = len(before), ""
    for token in reversed(list(re.finditer(r"\S+", before[-600:]))):
        word = token[0]
        name = word.strip("(){};,").lower()
        named = follows[:1] in ("=", "(") and word.isidentifier() and word.isascii()
        if not (_CODED.search(word) or name in _KEYWORD or name in _ELEMENT and not follows.isalpha() or named):
            break
        begin, follows = max(0, len(before) - 600) + token.start(), word
    return begin


def _without_blocks(text: str) -> str:
    out, at = [], 0
    while (start := text.find("{", at)) >= 0:
        end = block_end(text, start)
        if end < 0 or not _is_code(text[start + 1 : end - 1]):
            out.append(text[at : start + 1])
            at = start + 1
            continue
        lead = at + _lead(text[at:start])
        out.append(text[at:lead] + " ")
        closing = _CLOSING.match(text, end) if "(" in text[lead:start] else None
        at = closing.end() if closing else end
    return "".join([*out, text[at:]])


def clean(value: str | None) -> str:
    """One line of readable text: entities decoded, markup, comments and code removed, white space collapsed. Null becomes empty.

    Applied to its own result it changes nothing, as it repeats until nothing is left to remove. Brackets without an end stay.
    """
    text = " ".join((value or "").split())
    while _NEEDED.search(text):
        before = text
        text = _COMMENT.sub(" ", _visible(html.unescape(text)))
        text = _LOOSE.sub(" ", _STATEMENT.sub(" ", _without_blocks(text)))
        text = " ".join(text.split())
        if text == before:
            break
    return text


def cleaned(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(<key>, cleaned): clean() of every row's text, in Arrow batches; rows and their number stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(clean, batch.column(1).to_pylist())), pa.string())], names=[key, "cleaned"])

    return rows.select(F.col(key).cast("bigint").alias(key), F.col(text)).mapInArrow(run, f"{key} bigint, cleaned string")
