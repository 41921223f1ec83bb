"""Unicode folding shared by the text operators.

Folding is NFKC followed by lower case. Spark has no NFKC expression, so these run in Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

_NOT_ALNUM = re.compile(r"[\W_]+")
#: What each code point folds to where its neighbours can't matter: a letter or digit, 0 for anything else; filled as code points are met.
_UNKNOWN, _SLOW = -2, -1
_TABLE = np.full(0x110000, _UNKNOWN, np.int32)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def folded(text: str) -> str:
    """NFKC, then lower case."""
    return unicodedata.normalize("NFKC", text).lower()


def letters_by_line(text: str) -> list[str]:
    """Each line's folded letters (str.isalpha: Unicode L*), lines split at newlines."""
    return ["".join(filter(str.isalpha, line)) for line in folded(text).split("\n")]


def alnum(text: str) -> str:
    """The folded text's letters and digits in order."""
    return _NOT_ALNUM.sub("", folded(text))


@cache
def _joining() -> frozenset[str]:
    """Characters that may change with what stands before them: combining marks and all second halves of a composition."""
    halves = (unicodedata.decomposition(chr(c)).split() for c in range(0x20000))
    second = {chr(int(h[1], 16)) for h in halves if len(h) == 2 and not h[0].startswith("<")}
    jamo = map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])
    return frozenset(second.union(jamo))


def _folded_point(code: int) -> int:
    char = chr(code)
    image = unicodedata.normalize("NFKC", char)
    if "Σ" in image or any(unicodedata.combining(c) or c in _joining() for c in char + image):
        return _SLOW
    kept = "".join(filter(str.isalnum, image.lower()))
    return _SLOW if len(kept) > 1 or (kept and len(image.lower()) > 1) else ord(kept) if kept else 0


def _looked_up(points: np.ndarray) -> np.ndarray:
    out = _TABLE[points]
    if out.min(initial=0) == _UNKNOWN:
        for code in np.unique(points[out == _UNKNOWN]).tolist():
            _TABLE[code] = _folded_point(code)
        out = _TABLE[points]
    return out


def alnum_points(text: str) -> np.ndarray:
    """code_points(alnum(text)), by one table look-up where no character depends on its neighbours."""
    out = _looked_up(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    return code_points(alnum(text)) if out.min(initial=0) < 0 else out[out > 0].astype(np.uint64)


def code_points(text: str) -> np.ndarray:
    """Code points as uint64; lone surrogates pass through."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, applied element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stretch_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all stretches of `width` code points, in order of position.

    A polynomial over mixed code points, put together from powers of two, so the cost is a few passes whatever the width.
    Empty if there are fewer than `width` code points.
    """
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        block, size = mix64(points + np.uint64(0x9E37)), 1
        done, out, left = 0, None, width
        while left:
            if left & 1:
                part = block[done : done + n]
                out = part.copy() if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
                done += size
            left >>= 1
            if left:
                block = block[: len(block) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + block[size:]
                size *= 2
    return mix64(out)


#: Letters and digits hashed at a time, so that arrays stay in the processor's cache.
CHUNK = 12_000


def stretches_of(texts: Iterable[str | None], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, hashes) of each text in turn: its folded letters and digits and stretch_hashes() of them. Null is an empty text.

    Short texts are hashed together, which spares most of the cost of small arrays.
    """
    waiting: list[np.ndarray] = []

    def hashed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        whole = stretch_hashes(np.concatenate(waiting), width) if waiting else ()
        at = 0
        for points in waiting:
            yield points, whole[at : at + max(0, len(points) - width + 1)]
            at += len(points)
        waiting.clear()

    load = 0
    for text in texts:
        waiting.append(alnum_points(text or ""))
        load += len(waiting[-1])
        if load >= CHUNK:
            yield from hashed()
            load = 0
    yield from hashed()
