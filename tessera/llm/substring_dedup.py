"""Exact substring deduplication (operator 2).

Rabin-Karp hashes of every window of ``length`` words are counted over all
documents (`cells`); the windows that occur more than once, anywhere, merge
into maximal removal intervals.  A window is told apart by 64 bits of one
polynomial hash, 16 bits of a second one and its bucket, itself drawn from
the second one (about 90 bits in all, growing with the data).
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm import cells
from tessera.llm.common import BASE_A, BASE_B, U64, bucket_count, mix, rolling, word_hashes, words

LENGTH = 35


class _Windows:
    """The windows of a chunk's documents, in the order in which their cells
    hold them."""

    def __init__(self, texts: list, length: int, n_buckets: int):
        self.words = [words(t) for t in texts]
        lens = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.ends = np.cumsum(lens)
        w = cells.concat([word_hashes(ws) for ws in self.words if ws], U64)
        doc = np.repeat(np.arange(len(texts)), lens)
        a = rolling(w, length, BASE_A)
        b = rolling(mix(w + U64(length)), length, BASE_B)
        inside = doc[:len(a)] == doc[length - 1:] if len(a) else np.empty(0, bool)
        self.start = np.flatnonzero(inside)
        self.a, b = mix(a[inside]), mix(b[inside])
        self.extra = (b & U64(0xFFFF)).astype(np.uint16)
        self.bucket = ((b >> U64(20)) % U64(n_buckets)).astype(np.int32)
        order = np.argsort(self.a, kind="stable")
        sa, sb = self.a[order], b[order]
        again = np.zeros(len(order) + 1, bool)  # equal to the window before it in this order
        again[1:-1] = (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1])
        self.known = np.zeros(len(order), bool)  # repeated within the chunk itself
        self.known[order] = again[:-1] | again[1:]
        send = np.zeros(len(order), bool)
        send[order] = ~again[:-1]
        sent = np.flatnonzero(send)
        key = self.bucket[sent]
        self.sent = sent[np.argsort(key.astype(np.uint16) if n_buckets < 1 << 16 else key, kind="stable")]
        self.counts = np.bincount(key, minlength=1)

    def cells(self):
        at = 0
        for b in np.flatnonzero(self.counts):
            i = self.sent[at:at + self.counts[b]]
            at += self.counts[b]
            yield int(b), self.a[i].tobytes() + self.extra[i].tobytes()

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Start positions (in the chunk's words) of the repeated windows."""
        flag = self.known.copy()
        at = 0
        for b in np.flatnonzero(self.counts):
            n = int(self.counts[b])
            i = self.sent[at:at + n]
            at += n
            flag[i] |= np.unpackbits(np.frombuffer(answers[int(b)], np.uint8), count=n).astype(bool)
        return self.start[flag]


def _answer(payloads: list[bytes]) -> list[bytes]:
    sizes = [len(p) // 10 for p in payloads]
    a = cells.concat([np.frombuffer(p, U64, n) for p, n in zip(payloads, sizes, strict=True)], U64)
    extra = cells.concat([np.frombuffer(p, np.uint16, n, 8 * n) for p, n in zip(payloads, sizes, strict=True)], np.uint16)
    order = np.argsort(a)
    sa, sx = a[order], extra[order]
    twice = np.zeros(len(a) + 1, bool)
    twice[1:-1] = (sa[1:] == sa[:-1]) & (sx[1:] == sx[:-1])
    if len(a) > 2 and (tie := sa[1:] == sa[:-1]).any() and (tie & ~twice[1:-1]).any():
        order = np.lexsort((extra, a))  # equal first hashes of different windows: sort by both
        sa, sx = a[order], extra[order]
        twice[1:-1] = (sa[1:] == sa[:-1]) & (sx[1:] == sx[:-1])
    flag = np.empty(len(a), bool)
    flag[order] = twice[:-1] | twice[1:]
    ends = np.cumsum(sizes)
    return [np.packbits(flag[e - n:e]).tobytes() for e, n in zip(ends, sizes, strict=True)]


def remove_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            length: int = LENGTH) -> DataFrame:
    """Remove every word that a repeated window of ``length`` words covers.

    A window is repeated if its word sequence also starts anywhere else, in
    the same document included; all windows are judged on the input.  Returns
    one row per input row: the id, ``n_words``, ``n_removed``, ``kept_text``
    (kept words joined by one space) and ``spans`` (maximal removed intervals
    ``[first word, word after the last]``).

    A null or empty text has no words and gives ``n_words`` 0 and an empty
    text; a text shorter than a window loses nothing; rows repeated in the
    input repeat each other's windows; a null id stays null; other columns
    are not read, whatever their names.  An empty table gives no rows."""
    n_buckets = bucket_count(df, text_col)
    schema = StructType([
        StructField(id_col, StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("kept_text", StringType()), StructField("spans", ArrayType(ArrayType(IntegerType()))),
    ])

    def make(ids, texts):
        return _Windows(texts, length, n_buckets).cells()

    def assemble(ids, texts, answers):
        win = _Windows(texts, length, n_buckets)
        hits = win.repeated(answers)
        step = np.zeros((int(win.ends[-1]) if len(win.ends) else 0) + 1, np.int32)
        step[hits] += 1
        np.subtract.at(step, hits + length, 1)
        gone = np.cumsum(step)[:-1] > 0
        first = np.searchsorted(hits, np.concatenate([[0], win.ends[:-1]]))
        last = np.searchsorted(hits, win.ends)
        out = []
        begin = 0
        for k, ws in enumerate(win.words):
            if first[k] == last[k]:
                out.append((ids[k], len(ws), 0, b" ".join(ws).decode("utf-8", "surrogatepass"), []))
            else:
                cut = gone[begin:begin + len(ws)]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]])))
                out.append((ids[k], len(ws), int(cut.sum()), b" ".join(compress(ws, ~cut)).decode("utf-8", "surrogatepass"),
                            edge.reshape(-1, 2).tolist()))
            begin += len(ws)
        return pd.DataFrame(out, columns=schema.names)

    return cells.exchange(df, id_col, text_col, n_buckets, make, _answer, assemble, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Operator 2 over whole `documents`: windows of 35 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = remove_repeated_windows(docs, "doc_id", "text", LENGTH)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
