"""JSON resource files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file ``{"k": "v", ...}`` (e.g. extension → MIME type, or
    a language's label strings) → (key, value) rows.  The object is read
    as one text value and exploded with ``from_json`` as a map."""
    text = spark.read.option("wholetext", True).text(path)
    m = F.from_json(F.col("value"), "map<string,string>")
    return text.select(F.explode(m).alias("key", "value"))


def read_timezones(spark: SparkSession, path: str) -> DataFrame:
    """Time-zone list (JSON array of objects with a nested ``utc`` list) →
    one row per (zone entry, IANA name)."""
    df = spark.read.option("multiLine", True).schema(
        "value string, abbr string, offset double, isdst boolean, name string, utc array<string>").json(path)
    return df.select("value", "abbr", "offset", "isdst", "name", F.explode_outer("utc").alias("iana"))
