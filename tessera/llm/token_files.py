"""Token ids as flat binary files (operator 13).

A folder of token files holds, for each part (a range of documents in id order):

* ``ids-<name>.bin``: the ids of all its documents, one after another, as
  little-endian unsigned integers of 16 bits (32 where the vocabulary needs them);
* ``offsets-<name>.bin``: little-endian unsigned 64-bit integers, the place of
  each document's first id in the part and, last, the number of ids;

and two small tables: ``docs`` (document id, part, row in the part) and
``parts`` (part, name, documents, ids, and ``base``, the ids of all parts
before, by a prefix sum).  A document's ids are a slice of a memory-mapped file.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.common import BROADCAST_BYTES, batches_of, scratch

END_ID = 2
#: A word of Latin-1 letters, alone or after one space, is one word of the
#: byte-level pattern.
PLAIN = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: The byte-level alphabet: a byte that prints in Latin-1 stands for itself, the
#: others for the characters from 256 on, in order.
_PRINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: A longer piece is encoded each time it occurs; shorter ones are remembered
#: in two generations of so many.
PIECE_BYTES, KNOWN = 48, 200_000


def cut_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where texts (UTF-8, one after another in ``data``, beginning at
    ``starts``) may be cut, their beginnings included: every token of the
    byte-level pattern ends before a space or line feed that follows a character
    other than white space, and between a letter or digit and a mark.  Only
    places where ASCII or U+00C0 to U+00FF stands before are looked at; to
    leave one out makes a longer piece, no other ids."""
    gap = (data == 32) | (data == 10)
    mark = (data == 46) | (data == 44)
    before = np.zeros_like(data)
    before[1:] = data[:-1]
    two = np.zeros_like(data)
    two[2:] = data[:-2]
    latin = (before >= 0x80) & (two == 0xC3)
    lower = before | 0x20
    word = ((lower >= 97) & (lower <= 122)) | ((before >= 48) & (before <= 57)) | (latin & (before != 0x97) & (before != 0xB7))
    cut = (gap & (((before > 32) & (before < 127)) | latin)) | (mark & word)
    cut[starts[starts < len(cut)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, as little-endian bytes, by a tokenizer file.

    Where the file's pattern is known to cut at ``cut_places`` (byte-level
    splitting, nothing normalised, no added token that takes white space with
    it), a text's ids are those of its pieces, and a distinct piece is encoded
    once while it is remembered; other tokenizers encode whole texts.  Strings
    of special tokens in a text are ordinary text."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id)
        self.code = "H" if self.dtype == "<u2" else "I"
        self.end = self._bytes([end_id])
        self.by_piece = cuts_at_space(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not in ``known``.  Plain ones are single words
        of the pattern, whose byte-level form is known, and go to the model."""
        if len(self.known) > KNOWN:
            self.old, self.known = self.known, {}
        model, plain, old = self.tokenizer.model, PLAIN.fullmatch, self.old.get
        here, rest = {}, []
        for p in pieces:
            if (ids := old(p)) is not None:
                here[p] = ids
            elif plain(p):
                here[p] = self._bytes([t.id for t in model.tokenize(p.encode().decode("latin-1").translate(BYTE_LEVEL))])
            else:
                rest.append(p)
        here.update(zip(rest, self._encode(rest), strict=True))
        self.known.update((k, v) for k, v in here.items() if len(k) <= PIECE_BYTES)
        return here

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text of a string array, and the end id; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_piece:
            yield from (ids + self.end for ids in self._encode(texts.to_pylist()))
            return
        starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        lo, hi = int(starts[0]), int(starts[-1])
        if hi == lo:
            yield from [self.end] * len(texts)
            return
        data = texts.buffers()[2].slice(lo, hi - lo)
        starts = starts - lo
        cuts = cut_places(np.frombuffer(data, np.uint8), starts[:-1])
        ends = np.append(cuts, hi - lo)
        pieces = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(ends.astype(np.int64)), data).dictionary_encode()
        words = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        got = list(map(self.known.get, words))
        here = self._learn([w for w, g in zip(words, got, strict=True) if g is None])
        ids = pa.array([here[w] if g is None else g for w, g in zip(words, got, strict=True)], pa.large_binary())
        found = ids.take(pieces.indices)
        place = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy(zero_copy_only=False))])
        at = place[np.searchsorted(cuts, starts)].tolist()
        out = memoryview(found.buffers()[2] or b"")
        for k in range(len(texts)):
            yield bytes(out[at[k]:at[k + 1]]) + self.end


@functools.lru_cache(maxsize=1)
def encoder(path: str, end_id: int) -> Encoder:
    """The encoder of a worker process, which its tasks share with all that it
    remembers: a tokenizer takes longer to load than many parts take to encode,
    and one a task would be held until the last is collected."""
    return Encoder(path, end_id)


def cuts_at_space(path: str) -> bool:
    """Whether the tokenizer file splits by the byte-level pattern alone, so
    that no token spans the place between a character and white space."""
    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    pre = conf.get("pre_tokenizer") or {}
    return (not conf.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
            and not any(t.get("lstrip") or t.get("rstrip") or not t.get("special") for t in conf.get("added_tokens", [])))


def id_type(vocabulary: int, end_id: int = END_ID) -> str:
    """The narrowest type of the format that holds every id."""
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class Mapped:
    """Values of one flat file by slice: memory-mapped where the store is a
    mounted one, else read by ranges."""

    def __init__(self, path: str, dtype: str):
        store, at = _store(path)
        self.dtype = np.dtype(dtype)
        self.size = store.get_file_info(at).size // self.dtype.itemsize
        mounted = isinstance(store, pafs.LocalFileSystem)
        # an empty file cannot be mapped
        self.mapped = np.memmap(at, self.dtype, "r") if mounted and self.size else np.empty(0, self.dtype) if mounted else None
        self.file = None if mounted else store.open_input_file(at)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.file is None:
            return self.mapped[part]
        lo, hi, _ = part.indices(self.size)
        return np.frombuffer(self.file.read_at((hi - lo) * self.dtype.itemsize, lo * self.dtype.itemsize), self.dtype)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_ID) -> None:
    """Encode the whole texts of ``docs`` and write token files to the new
    folder ``path`` (on storage that driver and executors share), documents in
    ascending order of ``id_col``.

    A null or empty text is a document of the end id alone.  A null id comes
    first; rows of one id are ordered by a hash of their text, and rows equal in
    both are the same documents.  An empty table gives a folder of no parts.
    Other columns of ``docs``, whatever their names, are not read.

    The documents are exchanged once, by ranges of ids; a task encodes its range
    in order and writes the part's two files, a document at a time.  File names
    are an attempt's own and get into the tables only when its task commits, so
    attempts that are lost or repeated leave nothing that readers see."""
    spark = docs.sparkSession
    store, at = _store(path)
    store.create_dir(at, recursive=True)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    id_field = StructField("id", rows.schema["id"].dataType)
    schema = StructType([id_field, StructField("part", IntegerType()), StructField("row", LongType()),
                         StructField("n_ids", LongType()), StructField("name", StringType())])

    def write(batches):
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        encode = ids = offsets = None
        row = place = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if encode is None:
                    encode = encoder(tokenizer, end_id)
                    store, at = _store(path)
                    ids = store.open_output_stream(f"{at}/ids-{name}.bin", buffer_size=1 << 20)
                    offsets = store.open_output_stream(f"{at}/offsets-{name}.bin", buffer_size=1 << 16)
                width = np.dtype(encode.dtype).itemsize
                counts = np.empty(batch.num_rows, np.int64)
                for k, data in enumerate(encode(batch.column(1))):
                    ids.write(data)
                    counts[k] = len(data) // width
                starts = place + np.cumsum(counts) - counts
                offsets.write(starts.astype("<u8").tobytes())
                place += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(counts), part, np.int32)),
                     pa.array(np.arange(row, row + len(counts))), pa.array(counts), pa.array([name] * len(counts))], names=schema.names)
                row += len(counts)
            if offsets is not None:
                offsets.write(np.array([place], "<u8").tobytes())
        finally:
            for f in (ids, offsets):
                if f is not None:
                    f.close()

    with batches_of(spark):
        rows.mapInArrow(write, schema).write.parquet(f"{path}/rows")
    made = spark.read.schema(schema).parquet(f"{path}/rows")
    parts = made.groupBy("part", "name").agg(F.count("*").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts.select("*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
                 F.lit(Encoder(tokenizer, end_id).dtype).alias("dtype")).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of a folder of token files, from the files: ``id``,
    ``start`` (ids of all documents before), ``n_tokens`` (end id included),
    ``ids_crc32`` (unsigned, of the ids as little-endian 32-bit integers) and,
    if ``with_ids``, ``ids``.

    Tasks read the rows of ``docs`` in any order and number, so a part is not
    the unit of work; each slices the mapped files."""
    rows, parts = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/parts")
    if parts.count() * 128 <= BROADCAST_BYTES:  # one row a part
        parts = F.broadcast(parts)
    rows = rows.select("id", "part", "row").join(parts, "part").select("id", "row", "name", "base", "dtype")
    fields = [rows.schema["id"], StructField("start", LongType()), StructField("n_tokens", LongType()), StructField("ids_crc32", LongType())]
    schema = StructType(fields)
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def read(batches):
        name, ids, offsets = None, None, None
        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(1, 5)]
            out: tuple[list, ...] = ([], [], [], [])
            for row, part, base, dtype in zip(*cols, strict=True):
                if part != name:
                    name, ids, offsets = part, Mapped(f"{path}/ids-{part}.bin", dtype), Mapped(f"{path}/offsets-{part}.bin", "<u8")
                lo, hi = map(int, offsets[row:row + 2])
                found = ids[lo:hi].astype("<u4")
                for to, value in zip(out, (base + lo, hi - lo, zlib.crc32(found.tobytes()), found), strict=True):
                    to.append(value)
            arrays = [pa.array(c, pa.int64()) for c in out[:3]]
            if with_ids:
                arrays.append(pa.array(out[3], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return rows.mapInArrow(read, schema)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 13: every whole text of `documents` as ids in flat files, read back."""
    import public_tokenizers

    path = scratch(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    found = read_token_files(spark, path, with_ids=False)
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")
