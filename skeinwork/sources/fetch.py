"""Fetching as a hook: any callable that gives bytes for an address, called in the tasks, one source's failure never touching another's."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.operators.collect import CANDIDATE, feed_candidates, listing_candidates
from skeinwork.sources.pages import decode, looks_like_feed

#: Takes an address, gives the bytes and the content type that came with them; raises what it likes.
Fetcher = Callable[[str], tuple[bytes, str]]

_LANDING = "id bigint, source_id bigint, url string, text string, is_feed boolean, error string"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string())


def fetched(sources: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(id, source_id, url, text, is_feed, error) of each row of sources(id, url): one fetch each, decoded; text is null where it failed.

    error is the exception's kind and message. The callable must be picklable; a repeated task fetches again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, url in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist()):
                try:
                    text, error = decode(*fetcher(url)), None
                except Exception as x:  # noqa: BLE001
                    text, error = None, f"{type(x).__name__}: {x}"
                out.append((i, i, url, text, text is not None and looks_like_feed(text), error))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_KINDS)], names=[c.split()[0] for c in _LANDING.split(", ")])

    return sources.select("id", "url").mapInArrow(run, _LANDING)


def scanned(landing: DataFrame) -> DataFrame:
    """Candidates of fetched() rows: feeds are read as feeds, all else as listing pages; failed fetches have none."""
    good = landing.where("text is not null").withColumn("published_at", F.lit(None).cast("string"))
    lists = listing_candidates(good.where("not is_feed").withColumnRenamed("text", "html"))
    feeds = feed_candidates(good.where("is_feed").withColumnRenamed("text", "xml"))
    return lists.select(*CANDIDATE).unionByName(feeds.select(*CANDIDATE))


def decoded(rows: DataFrame) -> DataFrame:
    """(id, text, is_feed) of rows(id, payload, content_type): bytes decoded by the encoding that fits best; null bytes are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(p, c) for p, c in zip(batch.column("payload").to_pylist(), batch.column("content_type").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(list(map(looks_like_feed, texts)), pa.bool_())], names=["id", "text", "is_feed"])

    return rows.select("id", "payload", "content_type").mapInArrow(run, "id bigint, text string, is_feed boolean")
