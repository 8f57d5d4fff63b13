"""Every registered query with SQL gives DuckDB's rows over the smallest tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from folio.plans.registry import FLAGSHIP, ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


def plain(value):
    if pd.isna(value):
        return None
    return round(float(value), 6) if isinstance(value, float) else value


def rows(frame, columns):
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE


@needs_data
def test_url_filter_reaches_the_scan(spark):
    from folio.operators.pages import extract_pages
    from pyspark.sql import functions as F

    pages = extract_pages(spark.read.parquet(f"{DATA}/pages.parquet"))
    plan = pages.where(F.col("url").startswith("http://")).select("url")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,http://)" in plan
    assert "html" not in plan.split("ReadSchema")[1]


@needs_data
@pytest.mark.parametrize("name", ["markdown_render", "openapi_render"])
def test_parts_are_spread_before_their_pages_are_made(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    before, after = plan.split("Exchange", 1)
    assert "<li" in before and "<li" not in after
