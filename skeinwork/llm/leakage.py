"""Test passages inside training text (problem 8).

A positional inverted index over letters and digits: terms are all stretches of TERM characters of the test items. One scan of the
training texts stores the postings of these terms, a row a document with the places and terms in it, so the index is partitioned by
document and no text or posting is ever shuffled. From the document frequencies of the terms each window of PASSAGE characters of a test
item gets its rarest term; only those terms' postings are looked up, and where one stands the item's other terms are intersected with the
document's at the same offset. Terms that follow each other without a gap make an exact passage; proximity matches allow insertions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.fold import stretches_of
from skeinwork.session import stored

#: Characters of the shortest passage that counts, and of a term: two terms end to end are a passage.
PASSAGE, TERM = 50, 25
#: Characters of test items that one pass takes, which bounds what is sent to the executors; more items take more passes.
BLOCK = 4_000_000
#: Characters by which two parts of a passage may be further apart, or nearer, in the text than in the test item.
SLACK = 60
_BITS = 20


class Items:
    """The test items of one pass: their terms as numbers, in order, and the sorted hashes that the numbers stand for."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids, hashes = [], []
        for (item, _), (points, each) in zip(rows, stretches_of((text for _, text in rows), TERM)):
            if len(points) >= PASSAGE:
                self.ids.append(item)
                hashes.append(each)
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        self.of = [np.searchsorted(self.terms, h).astype(np.int32) for h in hashes]
        #: Whether any term begins with these bits: most stretches of a text are done after one look.
        self.begins = np.zeros(1 << _BITS, bool)
        self.begins[(self.terms >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def postings(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of a text's stretches that are terms."""
        if not len(self.terms):
            return np.empty(0, np.int32), np.empty(0, np.int32)
        may = np.flatnonzero(self.begins[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.terms, hashes[may]), len(self.terms) - 1)
        same = self.terms[number] == hashes[may]
        return may[same].astype(np.int32), number[same].astype(np.int32)

    def rarest(self, frequency: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(item, place in it) of each window's rarest term, by term; the first on ties. Windows with a term that no text has are left out."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        span = PASSAGE - TERM + 1
        for k, terms in enumerate(self.of):
            windows = np.lib.stride_tricks.sliding_window_view(frequency[terms], span)
            lead = windows.argmin(1) + np.arange(len(windows))
            for at in np.unique(lead[windows.min(1) > 0]).tolist():
                out[int(terms[at])].append((k, at))
        return dict(out)


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def exact(items: Items, leads: dict[int, list[tuple[int, int]]], places: np.ndarray, terms: np.ndarray) -> dict[int, int]:
    """Longest run of characters, PASSAGE at least, of each item that a document with these postings holds."""
    found: dict[int, int] = {}
    tried = set()
    for n in range(len(terms)):
        for k, at in leads.get(int(terms[n]), ()):
            shift = int(places[n]) - at
            if (k, shift) in tried or found.get(k) == len(items.of[k]) + TERM - 1:
                continue
            tried.add((k, shift))
            wanted = np.arange(len(items.of[k])) + shift
            here = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            begin, end = _runs((places[here] == wanted) & (terms[here] == items.of[k]))
            longest = int((end - begin).max(initial=0)) + TERM - 1
            if longest >= PASSAGE:
                found[k] = max(found.get(k, 0), longest)
    return found


def near(items: Items, holders: dict[int, list[tuple[int, int]]], places: np.ndarray, terms: np.ndarray, slack: int) -> dict[int, int]:
    """Characters covered, PASSAGE at least, of each item by terms that stand in its order and nearly at its distances.

    Terms of one item are walked in the order of the document; a chain goes on with the next term that stands further on in the item and
    whose offset has moved by at most `slack`.
    """
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for n in range(len(terms)):
        for k, at in holders.get(int(terms[n]), ()):
            hits[k].append((int(places[n]), at))
    found: dict[int, int] = {}
    for k, each in hits.items():
        best = covered = 0
        last: tuple[int, int] | None = None
        for place, at in sorted(each):
            if last and at > last[1] and abs((place - at) - (last[0] - last[1])) <= slack:
                covered += min(TERM, at - last[1])
            elif last and at == last[1]:
                continue
            else:
                covered = TERM
            last = (place, at)
            best = max(best, covered)
        if best >= PASSAGE:
            found[k] = best
    return found


def _store(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = items.value
        for batch in batches:
            out: list[tuple] = []
            for doc, (_, hashes) in zip(batch.column("doc_id").to_pylist(), stretches_of(batch.column("text").to_pylist(), TERM)):
                places, terms = index.postings(hashes)
                if len(places):
                    out.append((doc, places, terms))
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "places", "terms"])

    return run


def _match(items, lists, slack: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, by_term = items.value, lists.value
        for batch in batches:
            out: list[tuple] = []
            for doc, places, terms in zip(batch.column("doc_id").to_pylist(), batch.column("places"), batch.column("terms")):
                places, terms = places.values.to_numpy(zero_copy_only=False), terms.values.to_numpy(zero_copy_only=False)
                whole = exact(index, by_term["rarest"], places, terms)
                out += [(doc, index.ids[k], "exact", n) for k, n in whole.items()]
                if slack is not None:
                    out += [(doc, index.ids[k], "proximity", n) for k, n in near(index, by_term["all"], places, terms, slack).items() if k not in whole]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "item_id", "kind", "characters"])

    return run


def leaks(documents: DataFrame, items: DataFrame, slack: int | None = SLACK, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, kind, characters): documents(doc_id, text) that hold a passage of an item of items(item_id, item_text).

    kind exact: at least PASSAGE consecutive letters and digits stand in both, characters is the length of the longest such run. kind
    proximity, unless slack is None: no such run, but terms of the item in its order, their distances moved by at most `slack` from one to
    the next, that cover `characters` of it, PASSAGE at least. Texts are compared folded, all but letters and digits dropped. Null, empty
    and shorter texts never match. Equal rows count once; other columns are not read. Items are taken in passes of about `block`
    characters each, by a hash of their id, whatever their number; every pass reads all documents.
    """
    spark = documents.sparkSession
    tests = items.select("item_id", "item_text").where(F.col("item_text").isNotNull())
    passes = -(-(tests.select(F.sum(F.length("item_text"))).first()[0] or 0) // block)
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, kind string, characters bigint")
    for turn in range(passes):
        rows = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn).distinct().collect()
        index = Items(sorted((r[0], r[1]) for r in rows if r[0] is not None))
        sent = spark.sparkContext.broadcast(index)
        postings = stored(texts.mapInArrow(_store(sent), "doc_id bigint, places array<int>, terms array<int>"))
        counts = postings.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").count()  # a row a term of this pass, at most
        frequency = np.zeros(max(1, len(index.terms)), np.int64)
        for term, n in counts.collect():
            frequency[term] = n
        lists = {"rarest": index.rarest(frequency)}
        if slack is not None:
            lists["all"] = defaultdict(list)
            for k, terms in enumerate(index.of):
                for at, term in enumerate(terms.tolist()):
                    if frequency[term]:
                        lists["all"][term].append((k, at))
        out = out.union(postings.mapInArrow(_match(sent, spark.sparkContext.broadcast(lists), slack), "doc_id bigint, item_id bigint, kind string, characters bigint"))
    # kinds sort so that an exact match of a document that came twice wins.
    return out.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind"), F.max_by("characters", F.struct((F.col("kind") == "exact").cast("int"), "characters")).alias("characters"))


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Cases of problem 8: (doc_id, item_id)."""
    return leaks(documents, items, slack=None).select("doc_id", "item_id")
