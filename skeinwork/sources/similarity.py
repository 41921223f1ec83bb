"""Nearest vectors by cosine similarity: a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.collect import first_of_each

#: Queries sent to the tasks at a time, which bounds what is broadcast to so many vectors, and rows multiplied at a time.
BLOCK, ROWS = 4_096, 512
_KINDS = (pa.int64(), pa.int64(), pa.float64())
_NAMES = ["query_id", "neighbour_id", "similarity"]


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.sqrt((vectors * vectors).sum(1))
    return vectors / np.where(norm > 0, norm, np.nan)[:, None]


def _best(sent, k: int):
    """The k best rows of a task for each query, whatever the number of its rows; equal similarities go to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        width = queries.shape[1]
        best_id = np.zeros((len(ids), 0), np.int64)
        best = np.zeros((len(ids), 0))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = [(i, v) for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()) if len(v) == width and None not in v]
                if not rows:
                    continue
                mine = np.array([i for i, _ in rows], np.int64)
                near = np.round(queries @ _unit(np.array([v for _, v in rows], float)).T, 6)
                near[np.isnan(near) | (mine[None, :] == ids[:, None])] = -np.inf
                best, best_id = np.hstack([best, near]), np.hstack([best_id, np.broadcast_to(mine, near.shape)])
                if best.shape[1] > k:
                    order = np.lexsort((best_id, -best), axis=1)[:, :k]
                    best, best_id = np.take_along_axis(best, order, 1), np.take_along_axis(best_id, order, 1)
        q, n = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_id[q, n]), pa.array(best[q, n])], names=_NAMES)

    return run


def nearest(vectors: DataFrame, key: str, vector: str, every: int = 50, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, similarity, place): the k nearest other rows of each row whose key is divisible by `every`.

    Queries are sent to the rows in blocks of about `block`, and each task keeps k candidates a query, so what is shuffled doesn't depend
    on the number of rows; every block reads all rows. Null and zero vectors, and vectors of another length than the query or with nulls,
    are no neighbours; equal keys count once. Ties go to the smaller key. Similarities are rounded to 6 places.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id is not null")
    queries = rows.where((F.col("id") % every == 0) & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))
    blocks = -(-queries.count() // block)
    out = spark.createDataFrame([], "query_id bigint, neighbour_id bigint, similarity double")
    for turn in range(blocks):
        chosen = {r["id"]: np.array(r["v"], float) for r in queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == turn).collect()}
        for width in sorted({len(v) for v in chosen.values()}):
            same = {i: v for i, v in sorted(chosen.items()) if len(v) == width and v.any()}
            if same:
                sent = spark.sparkContext.broadcast((np.array(list(same), np.int64), _unit(np.stack(list(same.values())))))
                out = out.union(rows.mapInArrow(_best(sent, k), "query_id bigint, neighbour_id bigint, similarity double"))
    distinct = out.groupBy("query_id", "neighbour_id").agg(F.max("similarity").alias("similarity"))
    placed = first_of_each(distinct, "query_id", k, F.desc("similarity"), F.asc("neighbour_id"), place="place")
    return placed.select(*_NAMES, "place")
