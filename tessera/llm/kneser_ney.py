"""Interpolated modified Kneser-Ney models over hashed symbols, counted and kept
in shards.

A symbol is a hash of BITS bits; an n-gram's key is the joint hash of the keys of
the n-gram without its last symbol (its context) and without its first.  Keys are
cut into equal ranges, the shards.  The highest order uses counts, every lower
one the number of distinct symbols in front (continuation counts).  A level of the
model holds, by shard, the count of each n-gram and the number of n-grams that
continue it, by their counts; probabilities are worked out of these where they are
looked up.  Nothing but one row of sums a level comes to the driver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from tessera.llm.cells import concat
from tessera.llm.common import BASE_A, BASE_B, U64, discard, mix, scratch

#: An unseen symbol is one of so many, or of as many as there are if these are more.
SYMBOLS = 1 << 16
#: Bits of a key.
BITS = 56


def _from_counts(n: tuple[int, ...]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return 0.5, 0.75, 0.9  # too few n-grams to estimate from
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams counted once to four times."""
    return _from_counts(tuple(int(x or 0) for x in counts.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()))


def spread(h: np.ndarray) -> np.ndarray:
    """Keys of symbols from their numbers or 64-bit hashes."""
    return mix(h) >> U64(64 - BITS)


def keys(symbols: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1 .. order, the key of the k symbols that end at each place (0
    where fewer stand in front)."""
    out = [symbols]
    for k in range(1, order):
        key = np.zeros(len(symbols), U64)
        key[k:] = joint(out[-1][k - 1:-1], out[-1][k:])
        out.append(key)
    return out


def joint(front: np.ndarray, back: np.ndarray) -> np.ndarray:
    return spread(front * U64(BASE_A) + back * U64(BASE_B))


def different(key: np.ndarray) -> np.ndarray:
    """The different keys, ascending (np.unique hashes them first, which is slower)."""
    key = np.sort(key)
    return key[np.append(True, key[1:] != key[:-1])[:len(key)]]


def pack(a: np.ndarray) -> bytes:
    """Compressed byte by byte: of small numbers the upper bytes take no room."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpack(b: bytes, dtype=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_keys(ascending: np.ndarray) -> bytes:
    return pack(np.diff(ascending, prepend=U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, U64), dtype=U64)


def edges(ascending: np.ndarray, n_buckets: int, first: int, last: int) -> np.ndarray:
    """Where the keys of each of the shards ``first`` .. ``last`` - 1 begin, and the end."""
    return np.searchsorted(ascending, np.array([_start(b, n_buckets) for b in range(first, last + 1)], U64))


def _start(bucket: int, n_buckets: int) -> int:
    return (bucket << BITS) // n_buckets


def find(have: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``wanted`` are there, the place of these in ``have``)."""
    if not len(have):
        return np.zeros(len(wanted), bool), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(have, wanted), len(have) - 1)
    there = have[at] == wanted
    return there, at[there]


#: n-grams that continue a context, by their count: 1, 2, 3 and more, and what
#: the latter count above 3 in all.
CONTINUED = 4


def _classes(c: np.ndarray) -> np.ndarray:
    return np.stack([c == 1, c == 2, c >= 3, np.maximum(c - 3, 0)]).astype(np.int64)


def _sums(which: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the columns of ``rows`` by number (exact up to 2^53)."""
    return np.stack([np.bincount(which, weights=r, minlength=n) for r in rows]).astype(np.int64)


PART, ABOVE, TABLE = 0, 1, 2
STATS = ("c1", "c2", "c3", "c4", "types", "whole")
_CELL = StructType([StructField("kind", IntegerType()), StructField("bucket", IntegerType()), StructField("payload", BinaryType())])
_BUILT = StructType([_CELL[0], StructField("turn", IntegerType()), *_CELL[1:], *[StructField(s, LongType()) for s in STATS]])


def _parts(symbols: np.ndarray, real: np.ndarray, k: int, top: bool, n_buckets: int, first: int, last: int) -> list[tuple[int, int, bytes]]:
    """Cells of the different k-grams that end at ``real`` places: context, rest
    and, at the top, count."""
    at = np.flatnonzero(real)
    below = keys(symbols, k - 1)[-1]
    ctx, low = below[at - 1], below[at]
    key = joint(ctx, low)
    mine = (key >= U64(_start(first, n_buckets))) & (key < U64(_start(last, n_buckets)))
    key, where, c = np.unique(key[mine], return_index=True, return_counts=True)
    ctx, low = ctx[mine][where], low[mine][where]
    edge = edges(key, n_buckets, first, last)
    out = []
    for b, (i, j) in enumerate(zip(edge[:-1], edge[1:], strict=True), first):
        if i < j:
            order = i + np.argsort(ctx[i:j], kind="stable")
            out.append((PART, b, pickle.dumps((pack_keys(ctx[order]), pack(low[order]), pack(c[order]) if top else None))))
    return out


def _above(ctx: np.ndarray, low: np.ndarray, c: np.ndarray, n_buckets: int) -> list[tuple[int, int, bytes]]:
    """What different n-grams tell of the n-grams one symbol shorter: how many end
    with each, and how many continue it."""
    ends, n = np.unique(low, return_counts=True)
    begins, which = np.unique(ctx, return_inverse=True)
    cont = _sums(which, _classes(c), len(begins))
    a, b = edges(ends, n_buckets, 0, n_buckets), edges(begins, n_buckets, 0, n_buckets)
    return [(ABOVE, k, pickle.dumps((pack_keys(ends[a[k]:a[k + 1]]), pack(n[a[k]:a[k + 1]]),
                                     pack_keys(begins[b[k]:b[k + 1]]), pack(cont[:, b[k]:b[k + 1]].ravel()))))
            for k in range(n_buckets) if a[k] < a[k + 1] or b[k] < b[k + 1]]


def _turns(n_buckets: int, rounds: int) -> list[int]:
    """The first shard of each round."""
    return [r * n_buckets // rounds for r in range(rounds)]


def _build(pdf: pd.DataFrame, n_buckets: int, rounds: int) -> pd.DataFrame:
    """A shard of a level, and the cells for the level below, with the round that
    takes them."""
    parts = [pickle.loads(p) for p in pdf.loc[pdf["kind"] == PART, "payload"]]
    above = [pickle.loads(p) for p in pdf.loc[pdf["kind"] == ABOVE, "payload"]]
    ctx, low = concat([unpack_keys(p[0]) for p in parts], U64), concat([unpack(p[1], U64) for p in parts], U64)
    gram, where, which = np.unique(joint(ctx, low), return_index=True, return_inverse=True)
    ctx, low = ctx[where], low[where]
    if above:
        ends, begins = concat([unpack_keys(p[0]) for p in above], U64), concat([unpack_keys(p[2]) for p in above], U64)
        key, at = np.unique(np.concatenate([ends, begins]), return_inverse=True)
        c = _sums(at[:len(ends)], [concat([unpack(p[1]) for p in above], np.int64)], len(key))[0]
        cont = np.concatenate([unpack(p[3]).reshape(CONTINUED, -1) for p in above], axis=1)
        cont = _sums(at[len(ends):], cont, len(key))
        own = c[np.searchsorted(key, gram)]
    else:  # the highest order, which nothing continues
        key = gram
        c = own = _sums(which, [concat([unpack(p[2]) for p in parts], np.int64)], len(gram))[0]
        cont = np.zeros((CONTINUED, 0), np.int64)
    told = [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c > 0).sum()), int(c.sum())]
    bucket = int(pdf["bucket"].iloc[0])
    rows = [(TABLE, 0, bucket, pickle.dumps((pack_keys(key), pack(c), pack(cont.ravel()))), *told)]
    if parts:
        turn = np.searchsorted(_turns(n_buckets, rounds), np.arange(n_buckets), side="right") - 1
        rows += [(kind, int(turn[b]), b, payload, *[0] * len(STATS)) for kind, b, payload in _above(ctx, low, own, n_buckets)]
    return pd.DataFrame(rows, columns=_BUILT.names)


@dataclass(frozen=True)
class Model:
    """Discounts by level from 1 on; of the symbols, how many different ones were
    counted, the sum of their (continuation) counts, and how many were counted once,
    twice and more often."""

    order: int
    discounts: list[tuple[float, float, float]]
    types: int
    whole: int
    counted: tuple[int, int, int]

    def p(self, said: list[np.ndarray], place: list[np.ndarray], real: np.ndarray, own: np.ndarray, size: int) -> np.ndarray:
        """Probability of the symbol at each ``real`` place, an unseen one being
        one of ``size``.  ``said``: by level, what ``answers`` gives for the n-grams
        asked; ``place``: by level, which of them ends at each place.  Where ``own`` is
        set, the text was itself counted: an n-gram counts once less, and one counted
        once has not followed its context."""
        at = np.flatnonzero(real)
        own = own[at]
        mine = np.flatnonzero(own)

        def less(c, d):
            return c - np.array([0, *d])[np.clip(c, 0, 3)]

        c, d = said[0][0], self.discounts[0]
        left = sum(x * n for x, n in zip(d, self.counted, strict=True)) if self.whole else 1
        whole = max(self.whole, 1)
        p, q = [((less(x, d) + left / size) / whole)[place[0][at]] for x in (c, np.maximum(c - 1, 0))]
        q = q[mine]
        for k in range(2, self.order + 1):
            # by n-gram and by context, then at every place
            d, c, (n1, n2, n3, more) = self.discounts[k - 1], said[k - 1][0], said[k - 2][1:]
            total, taken = n1 + 2 * n2 + 3 * n3 + more, d[0] * n1 + d[1] * n2 + d[2] * n3
            weight = np.where(total > 0, taken / np.maximum(total, 1), 1)
            gram, ctx = place[k - 1][at], place[k - 2][at - 1]
            rest = np.where(total > 1, np.maximum(taken - d[0], 1e-9) / np.maximum(total - 1, 1), 1)
            lower = weight[ctx] * p
            gram_q, ctx_q = gram[mine], ctx[mine]
            q = np.where(c[gram_q] > 1, less(c - 1, d)[gram_q] / np.maximum(total - 1, 1)[ctx_q] + lower[mine], rest[ctx_q] * q)
            p = less(c, d)[gram] / np.maximum(total, 1)[ctx] + lower
        p[mine] = q
        return p


def answers(shard: pd.DataFrame, asked: list[list[np.ndarray]], order: int) -> list[list[np.ndarray]]:
    """For each of ``asked`` (ascending keys by level, one model after the other), by
    level the count of each n-gram and, below the highest order, CONTINUED.
    ``shard``: rows of ``fit`` of one bucket."""
    out = [[nothing(k, len(key), order) for k, key in enumerate(a)] for a in asked]
    for k, payload in zip(shard["level"], shard["payload"], strict=True):
        have, c, cont = pickle.loads(payload)
        have, c, cont = unpack_keys(have), unpack(c), unpack(cont).reshape(CONTINUED, -1)
        for a, said in zip(asked, out, strict=True):
            there, at = find(have, a[k])
            said[k][0, there] = c[at]
            if len(said[k]) > 1:
                said[k][1:, there] = cont[:, at]
    return out


def nothing(level: int, n: int, order: int) -> np.ndarray:
    """The answer of ``level`` (from 0 on) for ``n`` unknown n-grams."""
    return np.zeros((1 + CONTINUED * (level % order < order - 1), n), np.int64)


def fit(texts: DataFrame, padded: Callable, order: int, n_buckets: int, rounds: int, base: int = 0) -> tuple[DataFrame, Model]:
    """((level, bucket, payload) rows, levels from ``base`` on; model) of ``texts``, rows that ``padded(row)``
    turns into symbols, with ``order`` - 1 ones in front of each text, and which of
    them are real.  Each level is built in ``rounds``, one range of shards after
    the other, so that the cells of one round only are on disk at a time."""
    spark = texts.sparkSession
    shards, told, above = [], [], []
    for k in range(order, 0, -1):
        built = []
        for r in range(rounds):
            first, last = [*_turns(n_buckets, rounds), n_buckets][r:r + 2]

            def send(batches, k=k, first=first, last=last):
                for pdf in batches:
                    for row in pdf.itertuples():
                        yield pd.DataFrame(_parts(*padded(row), k, k == order, n_buckets, first, last), columns=_CELL.names)

            cells = [texts.mapInPandas(send, _CELL)] if k > 1 else []
            cells += [_read(spark, path, ABOVE).where(F.col("turn") == r).select(*_CELL.names) for path in above]
            path = scratch(spark, f"kn{k}")
            reduce(DataFrame.unionByName, cells).groupBy("bucket").applyInPandas(lambda pdf: _build(pdf, n_buckets, rounds), _BUILT).write.partitionBy("kind", "turn").parquet(path)
            built.append(path)
            for path in above:
                discard(spark, f"{path}/kind={ABOVE}/turn={r}")
        above = built
        level = reduce(DataFrame.unionByName, [_read(spark, path, TABLE) for path in built])
        told.insert(0, [int(x or 0) for x in level.agg(*[F.sum(s) for s in STATS]).first()])
        shards.append(level.select(F.lit(base + k - 1).alias("level"), "bucket", "payload"))
    n1, n2, _, _, types, whole = told[0]
    model = Model(order, [_from_counts(tuple(t[:4])) for t in told], types, whole, (n1, n2, types - n1 - n2))
    return reduce(DataFrame.unionByName, shards), model


def _read(spark: SparkSession, path: str, kind: int) -> DataFrame:
    return spark.read.schema(_BUILT).parquet(path).where(F.col("kind") == kind)
