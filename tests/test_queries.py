"""Every core query with SQL against DuckDB on the smallest tables."""

import math
import os
import re
from pathlib import Path

import duckdb
import pytest

from skeinwork.plans import core

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER / f}')")
    return con


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(core.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_every_query_has_columns_without_clashes(spark):
    for name, f in core.QUERIES.items():
        columns = f(spark, str(FOLDER)).columns
        assert len(set(columns)) == len(columns), name


#: Queries that give back texts or long parts of them.
WITH_TEXT = {"excerpt", "normalised_items", "compact_text"}


def plan(spark, name):
    return core.QUERIES[name](spark, str(FOLDER))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_no_query_shuffles_whole_texts(spark, name):
    """Texts are read in the scan and are done with there: none is collected by an aggregate or named by an exchange's sort."""
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    for column in ("raw_content", "content_excerpt"):
        if name in WITH_TEXT:
            continue
        assert not re.search(rf"(?:first|max|min|max_by|min_by|collect_list|collect_set)\({column}#", text), column
    # No plan line above an exchange projects a text: what is exchanged is what the node below it gives.
    lines = text.split("\n")
    for n, line in enumerate(lines[:-1]):
        if "Exchange" in line and name not in WITH_TEXT:
            below = lines[n + 1]
            listed = re.search(r"(?:Project|FileScan parquet|MapInArrow|output=)[^\[]*\[(.*?)\]", below)
            names = re.findall(r"(?:^|, )(\w+)#", listed.group(1)) if listed else []
            assert "raw_content" not in names and "content_excerpt" not in names, line


def test_text_is_pruned_from_scans_that_do_not_need_it(spark):
    for name in ("importance_filter", "feed_rank_topk", "iso_dates", "first_per_source", "scoped_semi"):
        assert "raw_content" not in "".join(re.findall(r"ReadSchema: struct<[^>]*>", plan(spark, name))), name
