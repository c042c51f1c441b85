import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.operators.paging import build_page_index, page_bounds, read_page
from tessera.session import scratch_path


def test_page_bounds():
    assert page_bounds(None, None, 250, 25) == (0, 25) and page_bounds(0, -3, 250, 25) == (0, 25)
    assert page_bounds(400, 2, 250, 25) == (500, 250) and page_bounds(10, 7, 250, 25) == (70, 10)


@pytest.fixture(scope="module")
def index(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([None, *range(40)]), k, f"t{k}") for k in range(2000)]
    df = spark.createDataFrame(rows, "score int, id long, text string").repartition(6)
    path = scratch_path(spark, f"t-page-{uuid.uuid4().hex[:8]}")
    build_page_index(df, [F.col("score").desc_nulls_last(), F.col("id")], path)
    return path, sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))


@pytest.mark.parametrize(("count", "page"), [(7, 0), (100, 3), (400, 7), (1, 1999), (300, 6), (10, 200), (9, 10**9)])
def test_pages_of_an_index(spark, index, count, page):
    path, rows = index
    got = read_page(spark, path, count, page, cap=250, default=25)
    size = min(count, 250)
    assert [tuple(r) for r in got.collect()] == rows[page * size:(page + 1) * size]


def test_a_page_is_read_by_its_ranges_and_rows(spark, index):
    path, rows = index
    got = read_page(spark, path, 5, 150, cap=250, default=25)
    assert got.count() == 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "GreaterThanOrEqual(_row" in plan


def test_an_empty_index(spark):
    path = scratch_path(spark, f"t-page-{uuid.uuid4().hex[:8]}")
    build_page_index(spark.createDataFrame([(1,)], "id long").limit(0), [F.col("id")], path)
    assert read_page(spark, path, 5, 0, 250, 25).collect() == []
