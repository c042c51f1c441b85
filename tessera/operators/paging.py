"""Page index (P9): any page of an ordered table by reading only its rows.

``build_page_index`` orders a table once into ranges and notes how many rows
each holds; ``read_page`` finds the ranges a page lies in from these counts and
reads them with their row numbers as filters, so page 10,000 costs what the
first one costs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def page_bounds(count: int | None, page_no: int | None, cap: int, default: int) -> tuple[int, int]:
    """(offset, rows) of a page: count above the cap → cap, missing or ≤ 0 →
    default; page missing or below 0 → 0."""
    count = default if count is None or count <= 0 else min(count, cap)
    return (0 if page_no is None or page_no < 0 else page_no) * count, count


def build_page_index(df: DataFrame, order: list[Column], path: str) -> None:
    """Write ``df`` in the order of ``order`` (which should be total; equal rows
    are numbered in some order, the same for every reader) as
    ``rows/part=<range>`` with ``_row``, the row's number in its range, and
    ``parts``: rows before each range and in it.

    One exchange by range.  A range is named by its task and written by it
    alone; the window over counts has one row a range."""
    spark = df.sparkSession
    df.limit(0).write.parquet(f"{path}/columns")  # for pages beyond the last row
    at = F.monotonically_increasing_id()  # the task's number and the row's in it
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at)
    rows = rows.withColumn("part", F.shiftright("_at", 33).cast("int")).withColumn("_row", F.col("_at") - F.shiftleft(F.shiftright("_at", 33), 33))
    rows.drop("_at").write.partitionBy("part").parquet(f"{path}/rows")
    parts = spark.read.schema("_row long, part int").parquet(f"{path}/rows").groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n").write.parquet(f"{path}/parts")


def read_page(spark: SparkSession, path: str, count: int | None, page_no: int | None, cap: int, default: int) -> DataFrame:
    """One page of an index, in order.  The ranges it lies in (at most ``cap``
    of them hold a row of it) are looked up first; the scan is pruned to them
    and to the page's rows."""
    offset, size = page_bounds(count, page_no, cap, default)
    parts = spark.read.parquet(f"{path}/parts").where((F.col("before") < offset + size) & (F.col("before") + F.col("n") > offset))
    hits = parts.orderBy("part").collect()  # ranges of one page
    if not hits:
        return spark.read.parquet(f"{path}/columns")
    rows = spark.read.parquet(f"{path}/rows")
    wanted = F.lit(False)
    for p in hits:
        wanted |= (F.col("part") == p.part) & (F.col("_row") >= offset - p.before) & (F.col("_row") < offset + size - p.before)
    return rows.where(wanted).orderBy("part", "_row").drop("part", "_row")
