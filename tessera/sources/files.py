"""S3 file catalogue crawl and G7 animated-GIF detection over a folder."""

from __future__ import annotations

import ctypes
import ctypes.util
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A file of more bytes is hashed split by split instead of as one value.
WHOLE_BYTES = 128 << 20
#: Names that Spark's line reader takes for compressed files, which have no splits.
_PACKED = r"\.(gz|gzip|bz2|deflate|snappy|lz4|zst|zstd)$"
_BOM = b"\xef\xbb\xbf"


def crawl_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S3: recursive file catalogue: name, extension, folder, size, SHA-256
    of the content and modification time.  ``binaryFile`` lists and reads
    the files in parallel (one row per file); the content of those above
    WHOLE_BYTES is not read that way but by ``large_digests``."""
    options = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    files = spark.read.format("binaryFile").options(**options).load(path).withColumn("_uri", F.col("_metadata.file_path"))
    large = _is_large()
    whole = files.where(~large).withColumn("sha256", F.sha2("content", 256)).drop("content")
    digests = large_digests(spark.read.options(**options), path)
    if digests:
        found = spark.createDataFrame(list(digests.items()), "_uri string, sha256 string")
        whole = whole.unionByName(files.where(large).drop("content").join(found, "_uri"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return whole.select(
        F.col("path"), name.alias("name"),
        F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise(F.lit(""))).alias("extension"),
        F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
        F.col("length").alias("bytes"), "sha256",
        F.col("modificationTime").alias("modified_at"))


def _is_large() -> Column:
    """Files to hash by splits; Spark drops the others before it reads any."""
    return (F.col("_metadata.file_size") > WHOLE_BYTES) & ~F.lower("_metadata.file_path").rlike(_PACKED)


@cache
def _sha256() -> ctypes.CDLL:
    """OpenSSL's SHA-256, whose state, unlike that of ``hashlib``, is plain
    bytes that can go from one task to the next."""
    lib = ctypes.CDLL(ctypes.util.find_library("crypto"))
    lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    return lib


def _hashed(state: bytes | None, data: bytes) -> bytes:
    """The state (none: the first) after ``data``."""
    held = ctypes.create_string_buffer(state, 128) if state else ctypes.create_string_buffer(128)
    if not state:
        _sha256().SHA256_Init(held)
    _sha256().SHA256_Update(held, data, len(data))
    return held.raw


def _digest(state: bytes) -> str:
    out = ctypes.create_string_buffer(32)
    _sha256().SHA256_Final(out, ctypes.create_string_buffer(state, 128))
    return out.raw.hex()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(split, bytes) of the neighbouring rows of one split in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        split, lines = batch.column(0).to_numpy(), batch.column(1)
        _, offsets, data = lines.buffers()
        wide = np.int64 if pa.types.is_large_binary(lines.type) else np.int32
        at = np.frombuffer(offsets, wide)[lines.offset:lines.offset + len(lines) + 1]
        edge = [0, *(np.flatnonzero(split[1:] != split[:-1]) + 1).tolist(), len(split)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(split[a]), memoryview(data)[int(at[a]):int(at[b])].tobytes()


def large_digests(reader, path: str) -> dict[str, str]:
    """SHA-256 by URI of the files that ``_is_large``.

    A file is read as lines between line feeds, which keeps its bytes, so that
    Spark cuts it into splits.  SHA-256 is one chain: round k hashes the k-th
    split of every file from the state after the one before, in a task of its
    own.  To the driver come a row a split and a state a file and round.

    Files are read twice, once to count the bytes of each split: only their sum
    tells if the last line has a line feed, and if the reader took off a byte
    order mark.  A line is one value, so at most 2 GB of a file have no line feed."""
    lines = reader.option("lineSep", "\n").text(path).where(_is_large())
    uri, start = F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("start")
    split = F.xxhash64("_metadata.file_path", "_metadata.file_block_start")
    counted = lines.groupBy(uri, F.col("_metadata.file_size").alias("size"), start, split.alias("split"), F.spark_partition_id().alias("part")).agg(
        F.sum(F.octet_length("value").cast("long") + 1).alias("bytes")).orderBy("uri", "start").collect()
    of: dict[str, list] = {}
    for r in counted:
        of.setdefault(r.uri, []).append(r)
    more, state = {}, {}
    for u, rs in of.items():
        off = sum(r.bytes for r in rs) - rs[0].size
        if off not in (0, 1, -3, -2):
            raise RuntimeError(f"{u}: the lines of its splits are not its {rs[0].size} bytes")
        more[u] = off % 3 == 1  # a line feed after the last line that is not in the file
        state[u] = _hashed(None, _BOM if off < 0 else b"")
    rows = lines.select(split.alias("split"), F.concat(F.col("value").cast("binary"), F.lit(bytearray(b"\n"))).alias("line"))
    for k in range(max(map(len, of.values()), default=0)):
        turn = {rs[k].split: (u, rs[k].bytes - (more[u] and k == len(rs) - 1)) for u, rs in of.items() if k < len(rs)}
        before = {s: (state[u], size) for s, (u, size) in turn.items()}

        def chain(batches, before=before):
            now = {}
            for s, data in _stretches(batches):
                if s in before:
                    held, left = now.get(s, before[s])
                    now[s] = _hashed(held, data[:left]), left - len(data[:left])
            yield pa.RecordBatch.from_pydict({"split": pa.array(now, pa.int64()), "state": pa.array([h for h, _ in now.values()], pa.binary()),
                                              "left": pa.array([n for _, n in now.values()], pa.int64())})

        hashed = rows.mapInArrow(chain, "split long, state binary, left long").rdd
        parts = sorted({rs[k].part for rs in of.values() if k < len(rs)})
        got = {r.split: r for r in hashed.context.runJob(hashed, list, parts)}
        if got.keys() != turn.keys() or any(r.left for r in got.values()):
            raise RuntimeError("files changed while they were read")
        state |= {turn[s][0]: bytes(r.state) for s, r in got.items()}
    return {u: _digest(s) for u, s in state.items()}


# GIF graphic-control extension followed by an image or extension block:
# two or more of these mean the file has several frames.
_FRAME = re.compile(rb"\x00\x21\xF9\x04.{4}\x00[\x2C\x21]", re.S)


def count_gif_frames(data: bytes | None) -> int:
    return len(_FRAME.findall(data or b""))


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"path": pdf["path"],
                            "frames": pd.Series([count_gif_frames(b) for b in pdf["content"]], dtype="int32")})


def animated_gifs(spark: SparkSession, path: str) -> DataFrame:
    """GIF files with their frame-marker count and ``is_animated``
    (more than one marker).  The byte scan runs per file in
    ``mapInPandas``; files are listed and read in parallel."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*.gif").load(path).select("path", "content")
    out = df.mapInPandas(_frames, "path string, frames int")
    return out.withColumn("is_animated", F.col("frames") > 1)
