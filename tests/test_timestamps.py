from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest

from skeinwork.operators import timestamps

ITEMS = "id long, source_id long, published_at string, fetched_at string, title string, value string, utc string, field string"
SOURCES = "id long, site_locale string, site_tz string, value string"
SITES = [(1, "zh-CN", "Asia/Shanghai", "x"), (2, "de-DE", "Europe/Berlin", "x"), (3, "en-US", "America/New_York", "x"), (4, "en-AU", "Australia/Sydney", "x"), (5, "en-GB", "Europe/London", "x"), (6, None, None, None)]

CASES = [
    (1, "2024-01-05T08:00:00+08:00", "2024-01-05T00:00:00Z"),
    (1, "2024年1月22日上午12:48", "2024-01-21T16:48:00Z"),
    (1, "2024年1月22日下午12:48（北京时间）", "2024-01-22T04:48:00Z"),
    (1, "发布时间：２０２４－０２－０２ １８：２６：３０", "2024-02-02T10:26:30Z"),
    (1, "20240118", "2024-01-17T16:00:00Z"),
    (1, "1704628911.318", "2024-01-07T12:01:51Z"),
    (1, "1705564206320501", "2024-01-18T07:50:06Z"),
    (1, "1706226208765", "2024-01-25T23:43:28Z"),
    (2, "12.04.2024, 05:28 Uhr CEST", "2024-04-12T03:28:00Z"),
    (2, "Stand: 15. März 2024 05:13", "2024-03-15T04:13:00Z"),
    (2, "31.03.2024 02:30:00", "2024-03-31T01:30:00Z"),  # skipped: read with the offset before the change
    (2, "27.10.2024 02:30:00", "2024-10-27T00:30:00Z"),  # twice: the earlier instant
    (3, "3/10/2024 2:30 AM", "2024-03-10T07:30:00Z"),
    (3, "11/3/2024 1:30 AM", "2024-11-03T05:30:00Z"),
    (3, "Updated May 6, 2024 7:30 AM", "2024-05-06T11:30:00Z"),
    (3, "Fri, 05 Jan 2024 17:32:43 GMT", "2024-01-05T17:32:43Z"),
    (3, "09-Mar-2024 14:08:13 EST", "2024-03-09T19:08:13Z"),
    (4, "8 February 2024 06:46 AEDT", "2024-02-07T19:46:00Z"),
    (4, "8 February 2024 06:46 EDT", "2024-02-07T19:46:00Z"),
    (5, "07/01/2024 20:34", "2024-01-07T20:34:00Z"),
    (5, "30/04/2024 02:39 BST", "2024-04-30T01:39:00Z"),
    (5, "29 February 2024", "2024-02-29T00:00:00Z"),
    (6, "2024-05-06 07:08", "2024-05-06T07:08:00Z"),
    (9, "2024-05-06 07:08:09,999 -02:30", "2024-05-06T09:38:09Z"),
    (2, "2025-02-30 10:15", None), (2, "2025-13-04T08:00:00Z", None), (2, "30/02/2024", None), (2, "0000-00-00 00:00:00", None), (2, "刚刚", None), (2, "N/A", None), (2, " ", None), (2, "", None),
    (2, "2024-05-06 25:00", None), (2, "12:30", None), (2, "29.02.2023", None), (2, "1234567", None), (3, "13/13/2024", None),
    (5, "x" * 100_000, None), (5, "x" * 100_000 + " 2024-05-06", "2024-05-05T23:00:00Z"),
]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SITES, SOURCES)


def test_each_spelling(spark, sources):
    rows = [(i, s, v, None, "t", "clash", "clash", "clash") for i, (s, v, _) in enumerate(CASES)]
    got = {r["id"]: r["utc"] for r in timestamps.normalise_timestamps(spark.createDataFrame(rows, ITEMS), sources, {"published_at": False}).collect()}
    for i, (site, value, want) in enumerate(CASES):
        assert got[i] == want, (site, value[:60], got[i])


def test_found_leaves_out_canonical_null_and_repeated_rows(spark, sources):
    rows = [(1, 1, "2024-01-05T08:00:00Z", "2024-01-05 08:00:00")] * 2 + [(2, 1, None, None), (3, None, "2024-01-05 08:00:00", "x"), (None, 1, "2024-01-05 08:00:00", None)]
    got = timestamps.found(spark.createDataFrame([r + (None,) * 4 for r in rows], ITEMS), sources).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "fetched_at", "2024-01-05T08:00:00Z"), (3, "published_at", "2024-01-05T08:00:00Z"), (None, "published_at", "2024-01-05T00:00:00Z")], key=repr)


def test_empty_tables(spark, sources):
    empty = spark.createDataFrame([], ITEMS)
    assert timestamps.found(empty, sources).count() == 0
    one = spark.createDataFrame([(1, 1, "2024-01-05 08:00:00", None) + (None,) * 4], ITEMS)
    assert [r["utc"] for r in timestamps.found(one, spark.createDataFrame([], SOURCES)).collect()] == ["2024-01-05T08:00:00Z"]


def test_local_times_agree_with_zoneinfo(spark, sources):
    """Every half hour around both changes of the year, in each zone."""
    rows, want = [], {}
    for site, _, zone, _ in SITES[:5]:
        for day in ("2024-03-10", "2024-03-31", "2024-04-07", "2024-10-06", "2024-10-27", "2024-11-03"):
            for half in range(48):
                local = datetime.fromisoformat(f"{day}T{half // 2:02}:{half % 2 * 30:02}:00").replace(tzinfo=ZoneInfo(zone), fold=0)
                rows.append((len(rows), site, local.strftime("%Y-%m-%d %H:%M:%S"), None, None, None, None, None))
                want[len(rows) - 1] = local.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    got = {r["id"]: r["utc"] for r in timestamps.normalise_timestamps(spark.createDataFrame(rows, ITEMS), sources, {"published_at": False}).collect()}
    assert got == want
