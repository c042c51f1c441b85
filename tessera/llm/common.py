"""Word splitting, hashing and scratch tables shared by the operators here.

All helpers work on whole texts as UTF-8 bytes; a null text has no words.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path

U64 = np.uint64
#: Two odd multipliers for the polynomial hashes, and one for the final mix.
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
MIX = 0xFF51AFD7ED558CCD
MASK = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8 (bytes.split() cuts at exactly
    these six characters)."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_words(text: str | None) -> list[bytes]:
    """``words`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def word_hashes(ws: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=U64, count=len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (finaliser of a multiplicative hash)."""
    h = h ^ (h >> U64(33))
    h = h * U64(MIX)
    return h ^ (h >> U64(29))


def rolling(w: np.ndarray, length: int, base: int) -> np.ndarray:
    """Rabin-Karp hash (mod 2^64) of every run of ``length`` values.

    ``out[i] = sum(w[i + j] * base**(length - 1 - j))``, built by doubling, so
    the cost per value is logarithmic in the length.  Empty if too short."""
    n = len(w) - length + 1
    if n <= 0:
        return np.empty(0, U64)
    out, have = None, 0
    power, block = 1, w
    rest = length
    while rest:
        if rest & 1:
            # runs of `power` values go in front of what is gathered so far
            if out is None:
                out, have = block, power
            else:
                shift = U64(pow(base, have, 1 << 64))
                m = len(out) - power
                out = block[:m] * shift + out[power:power + m]
                have += power
        rest >>= 1
        if rest:
            m = len(block) - power
            if m <= 0:
                raise AssertionError("run longer than the values")
            block = block[:m] * U64(pow(base, power, 1 << 64)) + block[power:power + m]
            power *= 2
    return out[:n]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the
    lineage is cut, and what is read later survives a lost executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``scratch`` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that go to a Python task at once where whole texts do: with texts of a
#: few KB, some MB on either side of the pipe instead of some tens.
BATCH_ROWS = 500


@contextmanager
def batches_of(spark: SparkSession, rows: int = BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows for the jobs run inside."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of the jobs run inside go when the job ends, not when the
    driver happens to collect its garbage."""
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column over the whole table (one scan)."""
    return df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def bucket_count(df: DataFrame, text: str = "text", bytes_per_bucket: int = 4 << 20) -> int:
    """Hash buckets for the words of a text column: enough that the values of
    one bucket fit a task, and several buckets per shuffle partition."""
    return max(-(-text_bytes(df, text) // bytes_per_bucket), 4 * shuffle_partitions(df.sparkSession))


#: A side of a join that was written and is below this many bytes in memory is
#: broadcast; beyond, Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, name: str, row_bytes: int = 64) -> DataFrame:
    """``df`` written to the shared folder, with a broadcast hint if its rows
    (counted), of ``row_bytes`` each, stay below BROADCAST_BYTES."""
    df = stored(df, name)
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
