"""Counting hashes of many tokens over all documents in two exchanges.

A *chunk* is a run of documents that one task reads (a few MB of text).  Its
task hashes the tokens, keeps each distinct one once (this pre-aggregation
bounds what a hot token sends to one entry a chunk), cuts them by hash bucket
and packs each (bucket, chunk) *cell* into one binary value.  The first
exchange brings the cells of a bucket together, where a task compares them
and answers every cell; the second brings the answers of a chunk back to its
documents, which travel beside the cells as one compressed value.  Since the
documents and the cells of a chunk leave the same task, nothing depends on a
row numbering that a second scan would have to repeat.

Input rows should come from a stored table (or another source that gives a
lost task the same rows again), as every chunk is named by its task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, BinaryType, IntegerType, LongType, StructField, StructType

CELL, DOCS, ANSWER = 0, 1, 2
#: Text of one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 3 << 20
PACKED = StructType([
    StructField("kind", ByteType()), StructField("bucket", IntegerType()),
    StructField("chunk", LongType()), StructField("payload", BinaryType()),
])


def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list, list]]:
    """(chunk id, ids, texts) for the (id, text) rows of this task, both strings."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    texts: list = []
    size = 0
    for pdf in batches:
        for i, t in zip(pdf.iloc[:, 0].tolist(), pdf.iloc[:, 1].tolist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 16
            if size >= CHUNK_BYTES:
                yield base + seq, ids, texts
                ids, texts, size, seq = [], [], 0, seq + 1
    if ids:
        yield base + seq, ids, texts


def pack_docs(ids: list, texts: list) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(pickle.dumps((ids, texts), protocol=5))


def unpack_docs(payload: bytes) -> tuple[list, list]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "payload"])


def exchange(df: DataFrame, id_col: str, text_col: str, n_buckets: int,
             make_cells: Callable[[list, list], Iterator[tuple[int, bytes]]],
             answer_cells: Callable[[list[bytes]], list[bytes]],
             assemble: Callable[[list, list, dict[int, bytes]], pd.DataFrame],
             schema: StructType) -> DataFrame:
    """Run the two exchanges.

    ``make_cells(ids, texts)`` gives (bucket, cell) pairs of a chunk,
    ``answer_cells(cells)`` an answer for every cell of one bucket, and
    ``assemble(ids, texts, answers by bucket)`` the rows of a chunk.  Ids go
    as strings (exact for any type, null or not); ``schema`` has the id first,
    as a string, which is cast back here."""

    def send(batches):
        for chunk, ids, texts in chunks(batches):
            rows = [(CELL, b, chunk, cell) for b, cell in make_cells(ids, texts)]
            rows.append((DOCS, (chunk * 7919 + (chunk >> 32)) % n_buckets, chunk, pack_docs(ids, texts)))
            yield frame(rows)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf[pdf["kind"] == CELL]
        said = answer_cells(cells["payload"].tolist())
        rows = list(zip([ANSWER] * len(said), cells["bucket"].tolist(), cells["chunk"].tolist(), said, strict=True))
        return pd.concat([frame(rows), pdf[pdf["kind"] == DOCS]])

    def collect(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, texts = unpack_docs(pdf.loc[pdf["kind"] == DOCS, "payload"].iloc[0])
        said = pdf[pdf["kind"] == ANSWER]
        return assemble(ids, texts, dict(zip(said["bucket"].tolist(), said["payload"].tolist(), strict=True)))

    out = (df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
           .mapInPandas(send, PACKED)
           .groupBy("bucket").applyInPandas(answer, PACKED)
           .groupBy("chunk").applyInPandas(collect, schema))
    name = schema[0].name
    return out.withColumn(name, F.col(name).cast(df.schema[id_col].dataType))


def concat(parts: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype)
