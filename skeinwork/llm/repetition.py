"""Repetition inside single documents (problem 9).

Every document is one draw from a multinomial over two hashed n-gram features: a character covered by an n-gram whose hash was seen
earlier in the document, and a fresh one. Two multinomials are counted over all documents, of the trusted target (documents with little
repetition) and of the raw corpus; the score is the log-likelihood ratio a character. It is affine in the repeated share, so the
threshold on the share is one deterministic threshold on the score, the same for every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.fold import mix64, stretches_of
from skeinwork.session import cut

#: Letters and digits of an n-gram, repeated share from which a document is a case, share up to which it is trusted.
WIDTH, SHARE, TRUSTED = 20, 0.3, 0.05


def repeated_characters(text: str, width: int = WIDTH) -> tuple[int, int]:
    """(letters and digits of the folded text, those lying in a stretch that also begins at an earlier place)."""
    return next((_repeated(points, hashes, width) for points, hashes in stretches_of([text], width)))


def _repeated(points: np.ndarray, hashes: np.ndarray, width: int) -> tuple[int, int]:
    if len(hashes) < 2:
        return len(points), 0
    ranked = np.sort(hashes)
    if (ranked[1:] != ranked[:-1]).all():
        return len(points), 0
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    again = order[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return len(points), 0
    edge = np.zeros(len(points) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return len(points), int((np.cumsum(edge)[:-1] > 0).sum())


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [_repeated(points, hashes, width) for points, hashes in stretches_of(batch.column("text").to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in counts], pa.int64()), pa.array([x for _, x in counts], pa.int64())], names=["doc_id", "total", "repeated"])

    return run


def score(documents: DataFrame, width: int = WIDTH, share: float = SHARE, trusted: float = TRUSTED) -> DataFrame:
    """(doc_id, total, repeated, share, llr, is_repetitive) of every row of documents(doc_id, text, ...).

    Null, empty and short texts have share 0. total counts letters and digits. llr is the length-normalised log-likelihood ratio of the
    trusted target against the raw corpus; lower means more repetition. Rows are kept as they are; other columns are not read. The
    counts of both multinomials are one row, summed on the executors.
    """
    counts = cut(documents.select("doc_id", "text").mapInArrow(_count(width), "doc_id bigint, total bigint, repeated bigint"))
    is_trusted = F.col("repeated") <= F.col("total") * trusted
    sums = counts.agg(*[F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k, keep in (("raw", F.lit(True)), ("trusted", is_trusted)) for c in ("total", "repeated")]).first()
    rate = {"raw": (sums["repeated_raw"] + 1) / (sums["total_raw"] + 2)}
    # The raw rate is the prior of the trusted one, which so never exceeds it: more repetition never scores higher. Without a trusted
    # document the two are equal, every score is 0 and the exact comparison decides.
    rate["trusted"] = (sums["repeated_trusted"] + 2 * rate["raw"]) / (sums["total_trusted"] + 2)
    low = math.log(rate["trusted"] / rate["raw"])
    high = math.log((1 - rate["trusted"]) / (1 - rate["raw"]))
    edge = share * low + (1 - share) * high
    part = F.when(F.col("total") > 0, F.col("repeated") / F.col("total")).otherwise(0.0)
    llr = part * low + (1 - part) * high
    near = abs(low - high) * 1e-9
    exact = F.col("repeated") >= F.col("total") * share
    return counts.select("doc_id", "total", "repeated", part.alias("share"), llr.alias("llr"), ((F.col("total") > 0) & (llr <= edge + near) & exact).alias("is_repetitive"))


#: Hashed n-grams of the second model: letters and digits of one, buckets, and occurrences in a document that are told apart.
GRAM, BUCKETS, TIMES = 8, 1 << 14, 3


def _features(points: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Feature of each n-gram of a text: its bucket, and whether it occurs for the first, second or a later time in the text."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(ranked)), 0)) if len(ranked) else np.empty(0, int)
    time = np.empty(len(hashes), np.int64)
    time[order] = np.minimum(np.arange(len(ranked)) - start, TIMES - 1)
    return time * BUCKETS + (mix64(hashes) >> np.uint64(50)).astype(np.int64)


def _feature_counts(width: int, trusted: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, TIMES * BUCKETS), np.int64)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for (points, grams), (whole, stretches) in zip(stretches_of(texts, GRAM), stretches_of(texts, width)):
                total, again = _repeated(whole, stretches, width)
                counted = np.bincount(_features(points, grams), minlength=TIMES * BUCKETS)
                sums[0] += counted
                if again <= total * trusted:
                    sums[1] += counted
        known = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(sums[0][known], pa.int64()), pa.array(sums[1][known], pa.int64())], names=["feature", "raw", "trusted"])

    return run


def _feature_scores(ratios):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_ratio = ratios.value
        for batch in batches:
            each = [log_ratio[_features(points, grams)] for points, grams in stretches_of(batch.column("text").to_pylist(), GRAM)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([float(x.mean()) if len(x) else 0.0 for x in each], pa.float64())], names=["doc_id", "llr"])

    return run


def ngram_scores(documents: DataFrame, width: int = WIDTH, trusted: float = TRUSTED, least: float = 0.0) -> DataFrame:
    """(doc_id, llr, is_kept) of every row of documents(doc_id, text, ...): is_kept is llr >= least.

    llr is the mean, over a text's n-grams, of the log-likelihood ratio of the trusted target (documents with little repetition) against the
    raw corpus, both multinomials over TIMES x BUCKETS hashed features counted over all documents, the raw one the prior of the other. So
    it tells n-grams that only repetitive texts hold, and ones that come again, from the rest. Null and short texts score 0. One partial
    count a task is summed, at most TIMES x BUCKETS rows, and their ratios are sent to all tasks.
    """
    texts = documents.select("doc_id", "text")
    counts = texts.mapInArrow(_feature_counts(width, trusted), "feature bigint, raw bigint, trusted bigint").groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, kept = np.full(TIMES * BUCKETS, 0.5), np.zeros(TIMES * BUCKETS)
    for feature, n, m in counts.collect():
        raw[feature] += n
        kept[feature] = m
    share = raw / raw.sum()
    prior = TIMES * BUCKETS
    target = (kept + prior * share) / (kept.sum() + prior)
    ratios = documents.sparkSession.sparkContext.broadcast(np.log(target / share))
    return texts.mapInArrow(_feature_scores(ratios), "doc_id bigint, llr double").withColumn("is_kept", F.col("llr") >= least)


def found(documents: DataFrame) -> DataFrame:
    """Cases of problem 9: (doc_id) of documents whose repeated share is at least SHARE."""
    return score(documents).where("is_repetitive").select("doc_id").distinct()
