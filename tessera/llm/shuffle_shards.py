"""Uniform shuffle into shards of exact sizes (operator 9).

The rows lie in partitions; every shard is a row of pieces of fixed size.  A
communication matrix says how many rows each partition sends to each piece: it
is drawn from the multivariate hypergeometric law, so its sums are exactly the
partition and piece sizes and, with a random choice of the rows inside each
partition and a random order inside each piece, the whole is a uniformly
random permutation.  Pieces are small, so no task ever holds a shard.

The matrix is never gathered: it is defined by splitting the partitions in
halves again and again, each half's row drawn with a seed of its own, and each
task walks down to its own row.
"""

from __future__ import annotations

from math import e, floor, lgamma, log, log1p, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.common import batches_of, discard, scratch, stored

SHARDS = 24
#: Most rows of a piece, which one task puts in order.
PIECE_ROWS = 20_000
SEED = 20_240_917


def piece_sizes(n_rows: int, n_shards: int, piece_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of every piece; shard sizes are at most one
    apart, and so are the pieces of a shard."""
    base, more = divmod(n_rows, n_shards)
    of = np.full(n_shards, base, np.int64)
    of[:more] += 1
    pieces = np.maximum(1, -(-of // piece_rows))
    shard = np.repeat(np.arange(n_shards), pieces)
    k = np.arange(len(shard)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = k * of[shard] // pieces[shard]
    return shard, first, (k + 1) * of[shard] // pieces[shard] - first


def matrix_row(counts: np.ndarray, sizes: np.ndarray, at: int, seed: int) -> np.ndarray:
    """Row ``at`` of the communication matrix: how many of the partition's
    ``counts[at]`` rows go to each piece.  Rows and columns sum to ``counts``
    and ``sizes``; the same for every caller with the same arguments."""
    total = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, left = 0, len(counts), sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        first = _draw(rng, left, int(total[mid] - total[lo]))
        if at < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def _draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """Colours of ``n`` balls drawn without replacement from ``sizes``: pairs
    of halves, down to single colours (numpy's own draw is limited to a total
    below 1e9, its two-colour draw likewise, so larger ones are split)."""
    total = int(sizes.sum())
    if n == 0 or len(sizes) == 1:
        return np.full(len(sizes), n) if len(sizes) == 1 else np.zeros_like(sizes)
    if total < 1_000_000_000:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    half = len(sizes) // 2
    a, b = int(sizes[:half].sum()), int(sizes[half:].sum())
    k = _two(rng, a, b, n)
    return np.concatenate([_draw(rng, sizes[:half], k), _draw(rng, sizes[half:], n - k)])


def _two(rng: np.random.Generator, a: int, b: int, n: int) -> int:
    """Balls of the first colour among ``n`` drawn from a + b, for any sizes
    (numpy's own draw takes less than 1e9 of each colour)."""
    return int(rng.hypergeometric(a, b, n)) if max(a, b) < 1_000_000_000 else ratio_of_uniforms(rng, a, b, n)


def ratio_of_uniforms(rng: np.random.Generator, a: int, b: int, n: int) -> int:
    """The same draw by ratio-of-uniforms rejection under the hat for the
    hypergeometric law (width 2 sqrt(2/e) deviations and 3 - 2 sqrt(3/e) more).
    The law itself is evaluated, not a limit of it; the work does not depend on
    the sizes."""
    low, high = max(0, n - b), min(a, n)
    if low == high:
        return low
    p = a / (a + b)
    mean = n * p
    width = 2 * sqrt(2 / e) * sqrt(mean * (1 - p) * (a + b - n) / (a + b - 1) + 0.5) + 3 - 2 * sqrt(3 / e)
    mode = (n + 1) * (a + 1) // (a + b + 2)
    top = _log_chance(mode, a, b, n)
    while True:
        u, v = 1 - rng.random(), rng.random()  # u > 0
        k = floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= _log_chance(k, a, b, n) - top:
            return k


def _log_chance(k: int, a: int, b: int, n: int) -> float:
    """Log of the hypergeometric law, up to a constant of (a, b, n), as two
    binomials at one rate in saddle-point form: no large terms cancel."""
    rate = n / (a + b)
    return _log_binomial(k, a, rate) + _log_binomial(n - k, b, rate)


def _log_binomial(k: int, n: int, p: float) -> float:
    if k in (0, n):
        return n * (log1p(-p) if k == 0 else log(p)) if n else 0.0
    return (_stirling(n) - _stirling(k) - _stirling(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
            + 0.5 * (log(n) - log(k) - log(n - k) - log(2 * pi)))


def _stirling(n: int) -> float:
    """log n! less Stirling's formula for it (without the constant)."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n ** 2) / n ** 2) / n ** 2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by its series where the terms cancel."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    r = (x - mean) / (x + mean)
    total, term, j = (x - mean) * r, 2 * x * r, 1
    while True:
        term *= r * r
        j += 2
        if total + term / j == total:
            return total
        total += term / j


def uniform_shards(df: DataFrame, n_shards: int = SHARDS, tie_cols: list[str] | None = None,
                   piece_rows: int = PIECE_ROWS, seed: int = SEED) -> DataFrame:
    """Add ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each
    shard): a uniformly random order of all rows, shard sizes at most one apart.

    ``tie_cols`` put the rows of a partition into one order before the draw, so
    that a task run again deals the same rows the same way; rows equal in all of
    them are interchangeable.  By default all columns of a sortable type.

    Nulls in any column, repeated rows and texts of any length are rows like
    others.  Fewer rows than shards leave shards empty; no rows, no rows.
    Columns of the input named ``shard`` or ``slot`` are replaced.

    The input is written to the shared folder, since the partitions must be
    the same when they are counted and when they are dealt, and again with each
    row's piece, so that what is exchanged does not depend on dealing anew; the
    first copy is then deleted."""
    df = df.drop("shard", "slot")
    names = df.columns
    ties = tie_cols or [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    spark = df.sparkSession
    path = scratch(spark, "shuffle-input")
    df.write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).withColumn("_part", F.spark_partition_id())
    counted = {r._part: r.n for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    counts = np.array([counted.get(p, 0) for p in range(max(counted, default=-1) + 1)], np.int64)
    shard, first, sizes = piece_sizes(int(counts.sum()), n_shards, piece_rows)
    shared = spark.sparkContext.broadcast((counts, sizes))  # 8 bytes a partition and a piece

    def deal(batches):
        at = TaskContext.get().partitionId()
        counts, sizes = shared.value
        left = None
        rng = np.random.default_rng([seed, at, len(counts)])
        for batch in batches:
            if not batch.num_rows:
                continue
            if left is None:
                left = matrix_row(counts, sizes, at, seed)
            take = _draw(rng, left, batch.num_rows)
            left = left - take
            piece = rng.permutation(np.repeat(np.arange(len(take), dtype=np.int32), take))
            order = rng.integers(0, 1 << 62, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece, pa.int32()), pa.array(order, pa.int64())],
                                             names=[*batch.schema.names, "_piece", "_order"])
        if left is not None and left.any():
            raise RuntimeError(f"partition {at} has not the {counts[at]} rows that were counted")

    schema = StructType([*[f for f in rows.schema if f.name != "_part"], StructField("_piece", IntegerType()), StructField("_order", LongType())])
    dealt = rows.drop("_part").sortWithinPartitions(*[F.col(f"`{c}`") for c in ties]).mapInArrow(deal, schema)
    with batches_of(spark):
        dealt = stored(dealt, "shuffle-dealt")
    discard(spark, path)
    place = spark.createDataFrame(pd.DataFrame({"_piece": np.arange(len(shard)), "shard": shard, "_first": first}),
                                  "_piece int, shard int, _first long")
    w = Window.partitionBy("_piece").orderBy("_order", *[F.col(f"`{c}`") for c in ties])
    return (dealt.withColumn("_rank", F.row_number().over(w) - 1).join(place, "_piece")
            .select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("_first") + F.col("_rank")).alias("slot")))


def op9_shards(spark, sf_dir: str) -> DataFrame:
    """Operator 9: all `documents` into shards 0 to 23, counts at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = uniform_shards(docs, SHARDS)
    size = (F.octet_length(text) + 8).cast("long")
    return out.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
