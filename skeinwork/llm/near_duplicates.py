"""Near-duplicate records with small edits (problem 3).

Exact copies are one class, whatever their number. Each class has a consistent MinHash fingerprint; its segments of a few values
each are keys. Classes that share keys and whose bit sketches are near are compared exactly on their whole stretch sets. README says
why the segments are MinHash values rather than Golay codewords.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.fold import alnum_points, code_points, mix64, stretch_hashes
from skeinwork.session import cut, stored

#: The most pairs just as similar as asked for that may share too few keys: one in a hundred.
LOST = 0.01
#: The most MinHash values of a text.
MOST = 480
#: Bits of the sketch, at most as many as MinHash values, and standard deviations above the mean that two sketches may differ by.
SKETCH, SPREAD = 384, 4.0
#: Rounds that throw all elements into bins before the remaining bins are filled one by one.
ROUNDS = 129
#: Letters and digits and texts worked on at a time, so that arrays stay in the processor's cache.
CHUNK, TEXTS = 12_000, 128
#: Texts a task remembers, so that a copy's keys are not made again; forgetting costs time only.
REMEMBERED = 100_000
_NONE, _HALF = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(32)
_SALTS = mix64(np.arange(1, ROUNDS + MOST + 1, dtype=np.uint64))


def stretches(points: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of all stretches of `width` letters and digits; of a shorter text, its own hash."""
    hashes = np.sort(stretch_hashes(points, min(width, max(1, len(points)))))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))] if len(hashes) else hashes


def fingerprints(hashes: np.ndarray, rows: np.ndarray, many: int, size: int) -> np.ndarray:
    """Consistent MinHash values, many x size, of the sets that `rows` (0 to many - 1, none empty) assigns the hashes to.

    One-permutation rounds: later rounds fill the bins that earlier ones leave empty. Two sets agree in a bin with the probability of
    their Jaccard similarity, also when they have few elements. Hashes must be mixed; repeated ones change nothing.
    """
    out = np.full(many * size, _NONE)
    left, of = hashes, rows
    for turn in range(ROUNDS):
        mixed = mix64(left + _SALTS[turn]) if turn else left
        slot = of * size + (((mixed >> _HALF) * np.uint64(size)) >> _HALF).astype(np.int64)
        free = out[slot] == _NONE
        np.minimum.at(out, slot[free], mixed[free])
        if turn & (turn - 1) == 0 or turn == ROUNDS - 1:  # looked at seldom, for most texts are done after the second or third round
            open_rows = (out.reshape(many, size) == _NONE).any(1)
            if not open_rows.any():
                break
            keep = open_rows[of]
            left, of = left[keep], of[keep]
    out = out.reshape(many, size)
    # Few elements: every bin still empty takes the smallest of a permutation of its own.
    for row in np.flatnonzero(open_rows):
        rest = np.flatnonzero(out[row] == _NONE)
        out[row, rest] = mix64(left[of == row][None, :] ^ _SALTS[ROUNDS + rest][:, None]).min(1)
    return out


def segments(least: float, shared: int = 1) -> tuple[int, int]:
    """(values of a segment, number of segments): the fewest segments of the longest size, so that at most LOST of the pairs at similarity
    `least` share fewer than `shared` of them.

    At 0.5, two shared, they are 104 of 4, which lose one pair in 100 there and one in 1,900 at 0.55; at 0.6, one shared, 57 of 5.
    """

    def lost(size: int, many: int) -> float:
        p = least**size
        return sum(math.comb(many, k) * p**k * (1 - p) ** (many - k) for k in range(shared))

    for size in (5, 4, 3, 2, 1):
        many = next((n for n in range(shared, MOST // size + 1) if lost(size, n) <= LOST), None)
        if many:
            return size, many
    raise ValueError(f"no {MOST} values find pairs at {least}")


def differing(least: float) -> int:
    """The most bits in which the sketches of texts `least` similar may differ: half the share of values that do, and SPREAD deviations."""
    share = (1 - least) / 2
    return int(SKETCH * share + SPREAD * math.sqrt(SKETCH * share * (1 - share)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


_WORDS = [f"s{k}" for k in range(SKETCH // 64)]
_TYPES = {"id": pa.int64(), "copy": pa.int64(), "copy2": pa.int64(), "keys": pa.list_(pa.int64())} | {w: pa.int64() for w in _WORDS}
_ROWS = "id bigint, copy bigint, copy2 bigint, keys array<bigint>, " + ", ".join(f"{w} bigint" for w in _WORDS)


def _sketches(width: int, segment: int, many: int):
    """(id, copy, copy2, keys, s0 ...) of each text; copy and copy2 are 128 bits of the letters and digits themselves.

    A text that the task has met before has neither keys nor sketch: the row of the first one speaks for it.
    """
    size = max(segment * many, SKETCH)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    salts = mix64(np.arange(1, many + 1, dtype=np.uint64))

    def sketched(bodies: list[np.ndarray]) -> tuple[list, list]:
        sizes = np.array([len(x) for x in bodies])
        points = np.concatenate(bodies)
        whole = stretch_hashes(points, width)
        at = np.arange(len(whole))
        row = np.repeat(np.arange(len(bodies)), sizes)[: len(whole)]
        inside = at + width <= np.cumsum(sizes)[row]
        short = np.flatnonzero(sizes < width)
        hashes = np.concatenate([whole[inside], *[stretch_hashes(bodies[k], len(bodies[k])) for k in short]])
        values = fingerprints(hashes, np.concatenate([row[inside], short]), len(bodies), size)
        keys = np.repeat(salts[None, :], len(bodies), 0)
        with np.errstate(over="ignore"):
            for k in range(segment):
                keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k : segment * many : segment])
        bits = (mix64(values[:, :SKETCH]) & np.uint64(1)).reshape(len(bodies), -1, 64)
        return _signed(keys).tolist(), _signed((bits * powers).sum(2, dtype=np.uint64)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        for batch in batches:
            rows: list[list] = []
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    for (n, _), keys, words in zip(waiting, *sketched([x for _, x in waiting])):
                        rows[n][3:] = [keys, *words]
                    waiting.clear()

            load = 0
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                points = alnum_points(text)
                if not len(points):
                    continue
                digest = xxhash.xxh3_128_intdigest(points.tobytes())
                rows.append([i, (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63), None, *[None] * len(_WORDS)])
                exact = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                if exact in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(exact)
                waiting.append((len(rows) - 1, points))
                load += len(points)
                if load >= CHUNK or len(waiting) >= TEXTS:
                    flush()
                    load = 0
            flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES.values())], names=list(_TYPES))

    return run


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body): the letters and digits alone."""
    for batch in batches:
        points = [alnum_points(x) for x in batch.column("text").to_pylist()]
        texts = [x.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass") for x in points]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "body"])


def _verified(width: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[int, np.ndarray] = {}
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb")]
            for a, b, ta, tb in zip(*columns):
                for i, t in ((a, ta), (b, tb)):
                    if i not in known:
                        known[i] = stretches(code_points(t), width)
                x, y = known[a], known[b]
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                few, many = (x, y) if len(x) <= len(y) else (y, x)
                common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                if common >= least * (len(x) + len(y) - common):
                    out.append((a, b, common / (len(x) + len(y) - common)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["a", "b", "similarity"])

    return run


def classes(texts: DataFrame, width: int, least: float, shared: int = 1, left_out: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, links) of texts(id, text): members(id, rep) puts copies (equal letters and digits) into classes named by their smallest
    id, links(a, b, similarity), a < b, are all pairs of classes at least `least` similar.

    Null texts and texts without letters and digits are in no class. Ids must be unique; equal rows count once. A text shorter than
    `width` is one stretch. Ids in left_out(id) are passed over; equal texts must be left out together. A class of any number of copies
    is one row in the join, so a third of all rows in one class costs nothing. Candidates share at least `shared` keys; two keep out most
    pairs that have only the page furniture of their source in common, whose number grows with the square of the source. One plan at every
    size: keys move once, pairs and sketches are narrow, and only candidates' letters and digits move.
    """
    narrow = texts.where(F.col("text").isNotNull()).select("id", "text")
    # Written once, before any shuffle: texts are folded once, and only distinct texts of a task have keys.
    rows = cut(narrow.mapInArrow(_sketches(width, *segments(least, shared)), _ROWS))
    if left_out is not None:
        rows = rows.join(stored(left_out.select("id").distinct()), "id", "left_anti")
    first = [F.first(c, ignorenulls=True).alias(c) for c in _WORDS]
    own = cut(rows.groupBy("copy", "copy2").agg(F.min("id").alias("rep"), *first))
    members = rows.select("id", "copy", "copy2").join(own.select("copy", "copy2", "rep"), ["copy", "copy2"]).select("id", "rep").distinct()
    keyed = rows.where(F.col("keys").isNotNull()).select("copy", F.explode("keys").alias("key"))
    # A merge join at every size: the planner takes the keys for as small as the texts they come from and would send small tables' to all.
    met = keyed.withColumnRenamed("copy", "copy_a").join(keyed.withColumnRenamed("copy", "copy_b").hint("merge"), "key").where("copy_a < copy_b").groupBy("copy_a", "copy_b").count().where(F.col("count") >= shared).drop("count")
    # 64 of the 128 bits name a class here; should two ever share them, both are looked up and compared.
    of = lambda k: own.select(F.col("copy").alias(f"copy_{k}"), F.col("rep").alias(k), *[F.col(w).alias(f"{w}_{k}") for w in _WORDS])
    apart: Column = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS), F.lit(0))
    near = stored(met.join(of("a"), "copy_a").join(of("b"), "copy_b").where(apart <= differing(least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    wanted = stored(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    compared = narrow.join(wanted, "id", "left_semi").mapInArrow(_bodies, "id bigint, body string")
    bodies = lambda k: compared.select(F.col("id").alias(k), F.col("body").alias(f"t{k}"))
    links = near.join(bodies("a"), "a").join(bodies("b"), "b").mapInArrow(_verified(width, least), "a bigint, b bigint, similarity double")
    return members, links.distinct()


def pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of ids, of linked classes and within a class."""
    links = links.select("a", "b")
    same = members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).groupBy("a", "b").count().where("count > 1").select("a", "b")
    of = lambda k: members.select(F.col("rep").alias(k), F.col("id").alias(f"id_{k}"))
    all_pairs = links.union(same).join(of("a"), "a").join(of("b"), "b").where(F.col("id_a") != F.col("id_b"))
    return all_pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges(a, b): label is the smallest node of its connected component.

    Min-label steps with pointer jumping, so a chain takes a logarithm of its length in steps; each step is written to the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        stepped = label.join(near, "node", "left").select("node", F.least("label", F.coalesce("near", "label")).alias("next"), "label")
        jumped = stepped.join(label.select(F.col("node").alias("next"), F.col("label").alias("beyond")), "next", "left")
        new = cut(jumped.select("node", F.least("next", F.coalesce("beyond", "next")).alias("label"), F.col("label").alias("old")))
        moved = not new.where("label <> old").isEmpty()
        label = new.select("node", "label")
        if not moved:
            return label


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, group_id, n_links): each record's connected component, named by its smallest id, and the number of classes its own is linked to."""
    links = cut(links.select("a", "b").distinct())
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = members.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
    return named.select("id", F.coalesce("label", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


#: Stretch width, least similarity and keys to be shared of the two kinds of records.
ITEMS, EVENTS = (8, 0.5, 2), (3, 0.6, 1)


def item_texts(items: DataFrame) -> DataFrame:
    """(id, text): title followed directly by raw_content, of items with non-blank raw_content."""
    return items.where(F.col("raw_content").rlike(r"(?U)\S")).select("id", F.concat(F.coalesce("title", F.lit("")), "raw_content").alias("text"))


def event_texts(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("canonical_title").alias("text"))


def found(items: DataFrame, events: DataFrame, left_out: DataFrame) -> DataFrame:
    """Cases of problem 3: (kind, id_a, id_b); items whose id is in left_out(id) take no part."""
    one = pairs(*classes(item_texts(items), *ITEMS, left_out)).select(F.lit("item").alias("kind"), "id_a", "id_b")
    two = pairs(*classes(event_texts(events), *EVENTS)).select(F.lit("event").alias("kind"), "id_a", "id_b")
    return one.unionByName(two)
