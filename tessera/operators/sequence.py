"""Order-dependent helpers that stay parallel when one key is huge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def _materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder named by
    ``spark.checkpoint.dir`` (cuts lineage; survives executor loss)."""
    from tessera.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _shift_batches(key: str, cols: list[str], prefix: str):
    def flags(pdf: pd.DataFrame, pid: int, first: bool, last: bool) -> pd.DataFrame:
        pdf["_pid"] = pid
        pdf["_first"] = False
        if first:
            pdf.loc[0, "_first"] = True
        pdf["_last"] = last
        return pdf

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        held: pd.DataFrame | None = None  # last row so far: its successor is not known yet
        emitted = False
        for pdf in batches:
            if pdf.empty:
                continue
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            held = pdf.iloc[[-1]].reset_index(drop=True)
            body = pdf.iloc[:-1].reset_index(drop=True)
            if len(body):
                nxt = pdf.iloc[1:].reset_index(drop=True)
                a, b = body[key], nxt[key]
                same = ((a == b) | (a.isna() & b.isna())).fillna(False).to_numpy(dtype=bool)
                for c in cols:
                    body[prefix + c] = pd.Series(np.where(same, nxt[c].astype(object), None), dtype=object)
                yield flags(body, pid, not emitted, False)
                emitted = True
        if held is not None:
            for c in cols:
                held[prefix + c] = pd.Series([None], dtype=object)
            yield flags(held, pid, not emitted, True)
    return run


def next_in_sequence(df: DataFrame, key: str, order: str, cols: list[str], prefix: str = "next_",
                     partitions: int | None = None) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the next row of the same
    ``key`` in ``order`` (NULL on the last row of a key).

    Skew-safe replacement for ``lead(...).over(partitionBy(key).orderBy(order))``:
    rows are range-partitioned on (key, order) — the sampled boundaries split
    a hot key over several tasks — and sorted within tasks; successors are
    taken inside each task, and each task's last row is completed from the
    first row of the next non-empty task (a table of at most one row per
    partition, broadcast).  No task holds more than its range.  The per-task
    result is checkpointed once because two branches read it.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, order).sortWithinPartitions(key, order)
    base = df.schema
    extra = [StructField(prefix + c, base[c].dataType, True) for c in cols]
    schema = StructType(list(base.fields) + extra + [StructField("_pid", IntegerType()),
                                                     StructField("_first", BooleanType()),
                                                     StructField("_last", BooleanType())])
    # used twice below (heads and rows): materialise it once so both see the
    # same range boundaries (a re-run could sample different ones)
    local = _materialise(ranged.mapInPandas(_shift_batches(key, cols, prefix), schema))
    heads = local.filter("_first").select("_pid", F.col(key).alias("_hk"), *[F.col(c).alias("_h_" + c) for c in cols])
    w = Window.orderBy("_pid")  # one row per non-empty partition: bounded by the partition count
    nxt = heads.select(F.col("_pid"), *[F.lead(c).over(w).alias(c) for c in ["_hk"] + ["_h_" + c for c in cols]])
    patched = local.join(F.broadcast(nxt), "_pid", "left")
    use = F.col("_last") & F.col("_hk").eqNullSafe(F.col(key))
    out = patched.select(*[F.col(f.name) for f in base.fields],
                         *[F.when(use, F.col("_h_" + c)).otherwise(F.col(prefix + c)).alias(prefix + c) for c in cols])
    return out


def _same(values: pd.Series, k) -> np.ndarray:
    """values == k, with NULL equal to NULL."""
    if pd.isna(k):
        return values.isna().to_numpy()
    return (values == k).fillna(False).to_numpy(dtype=bool)


def _cumsum_batches(key: str, value: str, out: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        carry_key, carry = None, 0  # running total of the key that continues across batches
        first_key, seen = None, False
        for pdf in batches:
            if pdf.empty:
                continue
            if not seen:
                first_key, seen = pdf[key].iloc[0], True
            sums = pdf.groupby(key, sort=False, dropna=False)[value].cumsum()
            if carry_key is not None:
                sums = sums + np.where(_same(pdf[key], carry_key), carry, 0)
            pdf[out] = sums.astype("int64")
            carry_key, carry = pdf[key].iloc[-1], int(pdf[out].iloc[-1])
            pdf["_pid"] = pid
            pdf["_head"] = _same(pdf[key], first_key)
            yield pdf
    return run


def running_sum(df: DataFrame, key: str, order: list[str], value: str, out: str,
                partitions: int | None = None) -> DataFrame:
    """``out`` = inclusive running sum of ``value`` per ``key`` in ``order``.

    Skew-safe replacement for ``sum(value).over(partitionBy(key).orderBy(order))``:
    rows are range-partitioned on (key, *order), so a huge key spans several
    tasks; each task sums locally, and only the first key of a task can
    continue an earlier task — its offset is the running total of the run of
    earlier tasks that end in that key, computed with windows on a summary of
    at most one row per partition and broadcast back.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order)
    schema = StructType(list(df.schema.fields) + [StructField(out, LongType()), StructField("_pid", IntegerType()),
                                                  StructField("_head", BooleanType())])
    local = _materialise(ranged.mapInPandas(_cumsum_batches(key, value, out), schema))
    # per partition: first key, last key and the last key's local total
    summary = local.groupBy("_pid").agg(
        F.min_by(F.col(key), F.struct(key, *order)).alias("_fk"),
        F.max_by(F.struct(F.col(key).alias("k"), F.col(out).alias("t")), F.struct(key, *order)).alias("_last"))
    # Partitions are ordered by key, so the earlier partitions that end in the
    # key a partition starts with form a contiguous run right before it: the
    # offset is the running total of that run (windows over the summary,
    # which has at most one row per partition).
    w = Window.orderBy("_pid")
    s1 = summary.select("_pid", "_fk", F.col("_last.k").alias("_lk"), F.col("_last.t").alias("_lt"))
    s1 = s1.withColumn("_grp", F.sum(F.when(F.lag("_lk").over(w).eqNullSafe(F.col("_lk")), 0).otherwise(1))
                       .over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s1 = s1.withColumn("_cum", F.sum("_lt").over(
        Window.partitionBy("_grp").orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)))
    offsets = s1.select("_pid", F.when(F.lag("_lk").over(w).eqNullSafe(F.col("_fk")), F.lag("_cum").over(w))
                        .otherwise(F.lit(0)).cast("long").alias("_off"))
    j = local.join(F.broadcast(offsets), "_pid", "left")
    return j.withColumn(out, F.col(out) + F.when(F.col("_head"), F.coalesce("_off", F.lit(0))).otherwise(F.lit(0))) \
        .drop("_pid", "_head", "_off")
