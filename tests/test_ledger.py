from datetime import datetime

from pyspark.sql import functions as F

from skeinwork.operators import ledger as L
from skeinwork.sources import similarity
from skeinwork.streaming import ingest


def test_new_rows_and_repeats(spark):
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "url string, x int")
    known = spark.createDataFrame([("b",)], "url string")
    assert [r["url"] for r in L.new_rows(batch, known, "url").collect()] == ["a"]


def test_enrich_keeps_old_values(spark):
    ledger = spark.createDataFrame([("a", "old", "t"), ("b", "old", "t"), ("c", None, "t")], "url string, reason string, title string")
    batch = spark.createDataFrame([("a", "new"), ("b", None)], "url string, reason string")
    got = {r["url"]: (r["reason"], r["title"]) for r in L.enriched(ledger, batch, "url", ("reason",)).collect()}
    assert got == {"a": ("new", "t"), "b": ("old", "t"), "c": (None, "t")}


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a", True, 60), (2, "b", False, 60)], "id long, name string, enabled boolean, minutes int")
    new = spark.createDataFrame([(2, "B", True, 30), (3, "c", True, 15)], "id long, name string, enabled boolean, minutes int")
    got = sorted(map(tuple, L.upserted(base, new, "id", ("enabled",)).collect()))
    assert got == [(1, "a", True, 60), (2, "B", False, 30), (3, "c", True, 15)]
    assert L.upserted(base, new.limit(0), "id", ()).count() == 2


def test_patch(spark):
    base = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "id long, hint string, minutes int")
    patch = spark.createDataFrame([(1, "hint", ""), (1, "minutes", "7")], "id long, field string, value string")
    assert sorted(map(tuple, L.patched(base, patch, "id").collect())) == [(1, None, 7), (2, "y", 6)]


def test_normalised_sets_blank_rows_aside(spark):
    rows = spark.createDataFrame([(1, " https://a.example/1#x ", "  T ", " body  text "), (1, None, "T", "x"), (1, "https://a.example/2", " ", "x")], "source_id long, url string, title string, raw_content string")
    good, bad = L.normalised(rows)
    g = good.first()
    assert g["title"] == "T" and g["canonical_url"] == "https://a.example/1" and g["raw_content"] == "body text" and bad.count() == 2


def test_rewritten_urls(spark):
    rows = spark.createDataFrame([("a", "a"), ("c", None)], "url string, canonical_url string")
    assert sorted(map(tuple, L.rewritten_urls(rows, {"a": "b"}).collect()), key=repr) == [("b", "b"), ("c", None)]


def test_stream_is_idempotent(spark, tmp_path):
    schema = "source_id long, url string, title string, raw_content string"
    source = tmp_path / "in"
    spark.createDataFrame([(1, "https://a.example/1", "A", "x"), (1, "https://a.example/1", "A again", "x"), (1, "", "B", "x")], schema).coalesce(1).write.parquet(str(source / "1"))
    store, rejects = ingest.Store(spark, str(tmp_path / "ledger")), ingest.Store(spark, str(tmp_path / "rejects"))
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    ingest.ingest(stream(), store, rejects, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 1 and rejects.read().count() == 1
    spark.createDataFrame([(1, "https://a.example/1", "A", "x"), (2, "https://a.example/2", "C", "y")], schema).coalesce(1).write.parquet(str(source / "2"))
    ingest.ingest(stream(), store, rejects, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["url"] for r in store.read().collect()) == ["https://a.example/1", "https://a.example/2"]
    ingest.ingest(stream(), store, rejects, str(tmp_path / "cp")).awaitTermination()
    assert store.read().count() == 2
    assert store.append(store.read(), 0) is False
    before = sorted(map(tuple, store.read().collect()))
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before and store.append(store.read(), 0) is False
    one = store.read().where("url like '%1'")
    assert store.read(near=one).where("url like '%1'").count() == 1 and ingest.Store(spark, str(tmp_path / "none")).read() is None
    assert store.append(store.read().limit(0), "later") and store.read().count() == 2


def test_windows(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 5), 7, "view", 1.0), (2, datetime(2024, 1, 1, 0, 50), 7, "view", 2.0), (3, datetime(2024, 1, 1, 2, 0), 7, "view", 4.0)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert sorted((r["n"], r["total"]) for r in ingest.tumbling_counts(df).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r["n"] for r in ingest.sessions(df).collect()) == [1, 1, 1]
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = ingest.first_seen(stream, "user_id", "3 hours").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 1


def test_sources_advance_only_with_candidates(spark):
    sources = spark.createDataFrame([(1, True, "old", "old", "e"), (2, True, "old", "old", "e"), (3, False, "old", "old", "e")], "id long, enabled boolean, last_fetched_at string, last_checked_at string, last_error string")
    got = {r["id"]: tuple(r)[2:] for r in ingest.advanced_sources(sources, spark.createDataFrame([(1,)], "source_id long"), "now").collect()}
    assert got == {1: ("now", "now", None), 2: ("old", "now", None), 3: ("old", "old", "e")}


def test_nearest(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, 0.1])]
    got = similarity.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", k=2).collect()
    assert [(r["neighbour_id"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [(1, 1), (5, 2)]
    more = spark.createDataFrame([*rows, (50, [1.0, 0.2]), (100, [0.5, 0.5]), (150, [1.0]), (200, None), (250, [0.0, 0.0]), (6, [1.0, 0.0, 1.0]), (7, [1.0, None]), (7, [1.0, None])], "vec_id long, embedding array<float>")
    by_block = lambda n: sorted(map(tuple, similarity.nearest(more, "vec_id", "embedding", k=3, block=n).collect()))
    assert by_block(1) == by_block(100) and {r[0] for r in by_block(2)} == {0, 50, 100}
    assert similarity.nearest(more.limit(0), "vec_id", "embedding").count() == 0


def test_first_by(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 9)], "k long, v long")
    assert sorted(map(tuple, L.first_by(df, "k", F.asc("v")).collect())) == [(1, 2), (2, 9)]
