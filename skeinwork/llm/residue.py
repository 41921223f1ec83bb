"""Template residue, filler, error pages and script notices instead of content (problem 4).

Values without any running text of a story are taken whole and apart into lines, both without numbers and ids. Lines that marks of residue
cover, or that are made of the parts of a notice, and the values that hold them are trusted. Near-duplicates of both kinds come from
partitioned SimHash tables, verified by Hamming distance and text similarity, and the trusted labels spread through their connected
components. A value is a case if it or one of its lines is labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.fold import code_points, folded, stretch_hashes
from skeinwork.llm import lines
from skeinwork.llm.near_duplicates import components
from skeinwork.llm.residue_words import notice, residue_share
from skeinwork.session import cut

#: Blocks of a 64-bit fingerprint, blocks that must be equal in a table (so two fingerprints with up to BLOCKS - EQUAL differing bits
#: share a table), the largest Hamming distance, the least similarity of texts, and the share of a line that marks must cover.
BLOCKS, EQUAL, NEAR, SIMILAR, COVERED = 9, 3, 6, 0.8, 0.35

_IDS = re.compile(r"\b(?=\w*\d)[0-9a-z\-]{2,}\b|\d+")
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def masked(line: str) -> str:
    """A folded line without numbers and ids."""
    return re.sub(r"\s+", " ", _IDS.sub("0", folded(line))).strip(" »·.…")


def fingerprint(text: str) -> int:
    """SimHash over 3-character stretches, as a signed 64-bit number."""
    points = code_points(text)
    hashes = stretch_hashes(points, min(3, max(1, len(points))))
    if not len(hashes):
        return 0
    ones = ((hashes[:, None] & _BITS) != 0).sum(0)
    return int(_BITS[ones * 2 > len(hashes)].sum(dtype=np.uint64).astype(np.int64))


FIELDS = ("raw_content", "content_excerpt")


def _node(key: str) -> int:
    points = code_points(key)
    return int(stretch_hashes(points, len(points))[0].astype(np.int64)) if key else 0


def _storyless(model: lines.LineModel, fields: tuple[str, ...]):
    """The values that hold no running text, line by line and whole: (id, field, node, text, trusted, print)."""

    def lacks_story(text: str) -> list[str]:
        each = [x for x in text.split("\n") if x.strip()]
        # The longest lines first: of a real story already the first one nearly always settles it.
        if any(model.running_text(x) for x in sorted(each, key=len, reverse=True)):
            return []
        return each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = {c: batch.column(c).to_pylist() for c in ("id", *fields)}
            for field in fields:
                for i, text in zip(columns["id"], columns[field]):
                    if not text or not text.strip():
                        continue
                    each = lacks_story(text)
                    parts = []
                    for line in each:
                        clean = folded(line).strip()
                        parts.append((masked(line), residue_share(clean) > COVERED or notice(lines.unwrapped(clean))))
                    if len(parts) > 1:
                        parts.append(("\n".join(key for key, _ in parts), any(trusted for _, trusted in parts)))
                    out += [(i, field, _node(key), key, trusted, fingerprint(key)) for key, trusted in parts]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["id", "field", "node", "text", "trusted", "print"])

    return run


def _tables(fp: Column) -> Column:
    """Keys of a fingerprint, one for each choice of EQUAL blocks: the table's number and the chosen blocks' bits."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned(fp, width * k).bitwiseAND(F.lit((1 << width) - 1)) for k in range(BLOCKS)]
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), EQUAL)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, width) + block[k]
        keys.append(key)
    return F.array(*keys)


def _grams(text: Column) -> Column:
    return F.array_distinct(F.when(F.length(text) > 2, F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array(text)))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes(node, text, print) within NEAR bits and at least SIMILAR in their 3-character stretches."""
    keyed = nodes.select("node", "print", F.explode(_tables(F.col("print"))).alias("key"))
    left, right = keyed.select(F.col("node").alias("a"), F.col("print").alias("pa"), "key"), keyed.select(F.col("node").alias("b"), F.col("print").alias("pb"), "key")
    close = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= NEAR)).select("a", "b").distinct()
    texts = lambda k: nodes.select(F.col("node").alias(k), _grams(F.col("text")).alias(f"g{k}"))
    both = close.join(texts("a"), "a").join(texts("b"), "b").withColumn("common", F.size(F.array_intersect("ga", "gb")))
    return both.where(F.col("common") >= SIMILAR * (F.size("ga") + F.size("gb") - F.col("common"))).select("a", "b")


def spread(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes (node) of all components of edges(a, b) that hold a seed, seeds among them."""
    label = components(edges)
    seeds = seeds.select("node").distinct()
    labelled = label.join(label.join(seeds, "node").select("label").distinct(), "label", "left_semi").select("node")
    return labelled.union(seeds).distinct()


def residue(items: DataFrame, model: lines.LineModel | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Cases of problem 4: (id, field) of values that hold residue and no running text of a story.

    Null and blank values are none; neither are values of page furniture alone, nor real texts that mention such words. Equal ids count
    once. The model of lines is fitted on the table itself unless given; an empty table gives no rows. fields: the columns looked at.
    """
    model = model or lines.model(items, trees=False)
    rows = items.select("id", *fields).mapInArrow(_storyless(model, fields), "id bigint, field string, node bigint, text string, trusted boolean, print bigint")
    parts = cut(rows.distinct())
    nodes = parts.groupBy("node", "text", "print").agg(F.max("trusted").alias("trusted"))
    labelled = spread(near_pairs(nodes), nodes.where("trusted"))
    return parts.join(labelled, "node", "left_semi").select("id", "field").distinct()


def found(items: DataFrame) -> DataFrame:
    """Cases of problem 4: (id, field)."""
    return residue(items)
