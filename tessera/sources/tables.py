"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; selecting ``columns`` lets Catalyst prune the read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def live(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Keep live rows (``is_deleted = false``); a NULL flag is not live.

    As a plain filter it is pushed into the Parquet scan.
    """
    return df.filter(~F.col(flag))
