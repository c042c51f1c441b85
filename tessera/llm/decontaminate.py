"""Benchmark decontamination by winnowing (operator 3).

From the hashes of all k-word grams of a text, every run of w neighbouring
hashes keeps its smallest (the last one if equal).  A passage of k + w - 1
words that a document shares with a benchmark item is one such run in both, so
both keep the same fingerprint from it: joining the fingerprints misses no
shared window.  A fingerprint of common words may join many texts that share no
window, so what is joined on next is the hash of the windows that kept it: a
document and an item meet only if they share a window.  Each joint fingerprint
is then extended to the maximal run of equal words, word by word, and counts if
it spans a window.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.cells import concat
from tessera.llm.common import BASE_A, BASE_B, U64, batches_of, mix, rolling, stored, word_hashes

WINDOW = 13
GRAM = 5
#: A document is contaminated if at least one word in SHARE of them is hit.
SHARE = 20
#: Bytes that end a word: all ASCII but 0-9 and a-z; A-Z become a-z.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_SPLIT).split() if text else []


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Position kept of every run of ``window`` hashes: its last smallest."""
    if len(h) < window:
        return np.empty(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.arange(len(runs)) + window - 1 - runs.argmin(axis=1)


def fingerprints(w: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) that a text keeps so that no shared passage of
    ``span`` words is missed.  ``w``: hashes of its words."""
    k = min(GRAM, span)
    h = mix(rolling(w, k, BASE_A) + U64(span))
    at = np.unique(winnow(h, span - k + 1))
    return h[at], at


def window_runs(w: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, how many neighbouring windows of ``span`` words keep each,
    hashes of all windows in order)."""
    k = min(GRAM, span)
    h = mix(rolling(w, k, BASE_A) + U64(span))
    kept = h[winnow(h, span - k + 1)].view(np.int64)
    first = np.flatnonzero(np.concatenate([[True], kept[1:] != kept[:-1]]))
    return kept[first], np.diff(np.append(first, len(kept))), mix(rolling(w, span, BASE_B) + U64(span)).view(np.int64)


def _spans(n_words: int, window: int, short: list[int]) -> list[int]:
    return [s for s in [*short, window] if s <= n_words]


def _hits(doc: list[bytes], dw: np.ndarray, items: list[tuple], window: int) -> tuple[np.ndarray, list]:
    """(which words are hit, items with an occurring window) for one document
    and its candidate items (ids, text)."""
    hit = np.zeros(len(doc) + 1, np.int32)
    found = []
    kept: dict[int, dict[int, list[int]]] = {}
    for item_id, text in items:
        item = plain_words(text)
        span = min(window, len(item))
        if not span or span > len(doc):
            continue
        if span not in kept:
            by = kept[span] = defaultdict(list)
            for h, at in zip(*map(np.ndarray.tolist, fingerprints(dw, span)), strict=True):
                by[h].append(at)
        reach: dict[int, int] = {}  # by diagonal: the end of the last extended run
        seen = False
        for h, j in zip(*map(np.ndarray.tolist, fingerprints(word_hashes(item), span)), strict=True):
            for i in kept[span].get(h, ()):
                if reach.get(i - j, 0) > i:
                    continue
                a, b = i, j
                while a and b and doc[a - 1] == item[b - 1]:
                    a, b = a - 1, b - 1
                e, f = i, j
                while e < len(doc) and f < len(item) and doc[e] == item[f]:
                    e, f = e + 1, f + 1
                reach[i - j] = e
                if e - a >= span:
                    hit[a] += 1
                    hit[e] -= 1
                    seen = True
        if seen:
            found.append(item_id)
    return np.cumsum(hit[:-1]) > 0, found


def sharing_pairs(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, item_key) of the texts that share a window, by fingerprint and window hash.

    ``docs``: key, text; ``items``: item_key, item_text.  Only fingerprints that
    the items have go on with their windows, at most window - GRAM + 1 each, so
    the rows joined are a bounded number a document word; no fingerprint,
    however common, pairs texts that share no window."""
    def lengths(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": sorted({len(plain_words(t)) for t in pdf["item_text"]} & set(range(1, window)))})

    short = sorted(r.n for r in items.select("item_text").mapInPandas(lengths, "n int").distinct().collect())  # below `window`

    def runs(spans_of):
        def of(batches):
            for batch in batches:
                keys, prints, sizes, windows = [], [], [], []
                for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    w = word_hashes(plain_words(t))
                    for span in spans_of(len(w)):
                        kept, n, hashes = window_runs(w, span)
                        keys.append(np.full(len(kept), key, np.int64))
                        prints.append(kept)
                        sizes.append(n)
                        windows.append(hashes)
                ends = np.concatenate([[0], np.cumsum(concat(sizes, np.int64))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(concat(keys, np.int64)), pa.array(concat(prints, np.int64)),
                                                  pa.ListArray.from_arrays(ends, concat(windows, np.int64))], names=schema.names)
        return of

    schema = StructType([StructField("key", LongType()), StructField("print", LongType()), StructField("windows", ArrayType(LongType()))])
    of_item = items.select("item_key", "item_text").mapInArrow(runs(lambda n: [min(window, n)] if n else []), schema)
    of_item = stored(of_item.select(F.col("key").alias("item_key"), "print", F.explode("windows").alias("win")).distinct(), "item-windows")
    of_doc = docs.select("key", "text").mapInArrow(runs(lambda n: _spans(n, window, short)), schema)
    of_doc = of_doc.join(of_item.select("print").distinct(), "print", "left_semi").select("key", "print", F.explode("windows").alias("win"))
    return of_doc.join(of_item, ["print", "win"]).select("key", "item_key").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Which words of each document lie in windows of benchmark items.

    A window is ``window`` consecutive words of an item; an item of fewer words
    is one window.  Returns one row per input row: the id, ``n_words``,
    ``n_hit``, ``items`` (ids of the items with occurring windows, sorted as
    strings) and ``spans`` (maximal hit runs ``[first word, word after the
    last]``).

    A null or empty text has no words and no hits; an item without words
    matches nothing; repeated rows and repeated items are judged alike, an
    item id counting once; a null document id stays null; an item with a null
    id hits words but is not listed.  Columns other than the four named are
    not read.  With an empty benchmark nothing is hit; no documents, no rows.

    The fingerprint join carries no size hint: Spark broadcasts the benchmark
    side while it is under ``spark.sql.autoBroadcastJoinThreshold`` and
    shuffles both sides beyond."""
    id_type = docs.schema[id_col].dataType
    docs = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("item_text"))

    id_field = StructField("id", StringType())
    # different item texts with their ids; documents go by a hash of the text, so that equal texts (and null ids) need no group
    items = items.groupBy("item_text").agg(F.collect_set("item").alias("item"))
    items = stored(items.withColumn("item_key", F.xxhash64("item_text")), "items")
    docs = docs.withColumn("key", F.xxhash64("text"))
    with batches_of(docs.sparkSession):
        joint = sharing_pairs(docs, items, window)
        candidates = joint.join(items, "item_key").groupBy("key").agg(F.collect_list(F.struct("item", "item_text")).alias("candidates"))
        candidates = stored(candidates, "candidates")

    def extend(batches):
        for pdf in batches:
            out = []
            for i, t, cand in zip(pdf["id"], pdf["text"], pdf["candidates"], strict=True):
                doc = plain_words(t)
                if cand is None or not len(cand):
                    out.append((i, len(doc), 0, [], []))
                    continue
                hit, found = _hits(doc, word_hashes(doc), [(list(c["item"]), c["item_text"]) for c in cand], window)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                out.append((i, len(doc), int(hit.sum()), sorted({f for ids in found for f in ids}), edge.reshape(-1, 2).tolist()))
            yield pd.DataFrame(out, columns=schema.names)

    schema = StructType([id_field, StructField("n_words", LongType()), StructField("n_hit", LongType()),
                         StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(ArrayType(IntegerType())))])
    both = docs.join(candidates, "key", "left").select("id", "text", "candidates")
    out = both.mapInPandas(extend, schema)
    return out.select(F.col("id").cast(id_type).alias(id_col), *schema.names[1:]).withColumn(
        "contaminated", ((F.col("n_hit") > 0) & (F.lit(SHARE) * F.col("n_hit") >= F.col("n_words"))).cast(BooleanType()))


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Operator 3: whole `documents` against whole `benchmark`, 13-word windows."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
