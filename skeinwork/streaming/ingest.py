"""Incremental ingestion: micro-batches of candidates into the Parquet ledger, and windowed counts over event streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skeinwork.operators import ledger


class Store:
    """A ledger of versions in one folder: each commit writes a new version and then moves the pointer, so readers see whole states.

    Rows lie in buckets by a hash of `key`, so a batch meets only the buckets its keys fall into; compact() puts all versions into one.
    One writer at a time. A batch id that was committed before is passed over, which makes a repeated micro-batch harmless.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str = "url", buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def commits(self) -> list[str]:
        """Names of committed versions in order: <number>-<batch>-<random>."""
        fs, path = self._files()
        root = path(f"{self.folder}/_commits")
        return sorted(str(PurePosixPath(s.getPath().toString()).name) for s in fs.listStatus(root)) if fs.exists(root) else []

    def read(self, near: DataFrame | None = None) -> DataFrame | None:
        """Rows of all committed versions, None before the first; with `near` only those of the buckets that its keys fall into."""
        names = self.commits()
        since = max((n for n, name in enumerate(names) if name.split("-")[1] == "compact"), default=0)
        if not names:
            return None
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.folder}/{n}" for n in names[since:]])
        if near is not None:
            rows = rows.where(F.col("__bucket").isin([r[0] for r in near.select(self._bucket()).distinct().collect()]))
        return rows.drop("__bucket")

    def _commit(self, rows: DataFrame, batch: str) -> None:
        name = f"{len(self.commits()):09d}-{batch}-{uuid.uuid4().hex[:8]}"
        # Sorted by bucket, so that a filter on it reaches the scan and skips row groups by their statistics.
        rows.withColumn("__bucket", self._bucket()).repartition("__bucket").sortWithinPartitions("__bucket").write.parquet(f"{self.folder}/{name}")
        fs, path = self._files()
        fs.create(path(f"{self.folder}/_commits/{name}")).close()

    def append(self, rows: DataFrame, batch: int | str) -> bool:
        """Commits rows as the version of `batch`; false if that batch was committed before."""
        if any(n.split("-")[1] == str(batch) for n in self.commits()):
            return False
        self._commit(rows, str(batch))
        return True

    def compact(self) -> None:
        """Writes all rows as one version that readers start from; the versions before stay for readers that have begun, and for their batch ids."""
        rows = self.read()
        if rows is not None:
            self._commit(rows, "compact")


def ingest(candidates: DataFrame, store: Store, rejects: Store, checkpoint: str, screen: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Streams candidates(source_id, url, title, raw_content, ...) into the ledger, once a URL for ever.

    Each micro-batch is normalised and screened; rows with a blank title or URL go to `rejects`, URLs that the ledger holds are passed
    over by an anti-join, so no state grows with the stream. All input there is now is taken, then the query ends; call it again for more.
    """

    def step(batch: DataFrame, number: int) -> None:
        good, bad = ledger.normalised(batch)
        known = store.read(near=good)
        fresh = good.dropDuplicates(["url"]) if known is None else ledger.new_rows(good, known, "url")
        store.append(screen(fresh) if screen else fresh, number)
        rejects.append(bad, number)

    return candidates.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of a stream or table of events(ts, event_type, value); rows later than `late` are dropped from a stream.

    Timestamps without a zone are read as UTC in a UTC session, as watermarks need instants.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeated keys within the watermark; what comes later is left to the ledger's anti-join."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): activity of each user without a pause of `gap`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def advanced_sources(sources: DataFrame, batch: DataFrame, checked_at: str) -> DataFrame:
    """sources with last_fetched_at moved to checked_at where the batch has a candidate, last_checked_at moved for all enabled, errors cleared."""
    seen = batch.select(F.col("source_id").alias("__seen")).distinct()
    joined = sources.join(seen, sources["id"] == seen["__seen"], "left")
    return joined.withColumns({
        "last_fetched_at": F.when(F.col("__seen").isNotNull(), F.lit(checked_at)).otherwise(F.col("last_fetched_at")),
        "last_checked_at": F.when(F.col("enabled"), F.lit(checked_at)).otherwise(F.col("last_checked_at")),
        "last_error": F.when(F.col("enabled"), F.lit(None).cast("string")).otherwise(F.col("last_error")),
    }).drop("__seen")
