"""Toxicity by class-conditional Kneser-Ney models (operator 5).

Two models of the bytes of a word, one for toxic and one for ordinary text,
are counted from the labelled rows.  Their n-grams run from the start of the
word, up to GRAM bytes; both back off to the same distribution, estimated from
the pooled continuation counts, so an expression that neither has seen weighs
nothing and a rare one little, while the forms of a toxic stem share its
weight.  The counts and the model are tables sharded by Spark, with every
n-gram; the distinct n-grams of a chunk of documents are joined with them.  A
document's score compares the two log-likelihoods, normalised by
length, over the whole text and at its most toxic word, through a logistic
curve fitted on labelled rows that the counts have not seen.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm import kneser_ney as kn
from tessera.llm.common import batches_of, bucket_count, shuffle_partitions, stored
from tessera.llm.decontaminate import plain_words

#: Longest n-gram in bytes; most labelled rows that the curve's four weights are
#: fitted on.
GRAM, CURVE_ROWS = 6, 50_000
#: Labelled rows are dealt into FOLDS by the CRC-32 of their id: fold 0 is held
#: out, the last one fits the curve, the others are counted.
FOLDS = 5
#: Text of one chunk: its n-grams are looked up together, each distinct one once.
CHUNK_BYTES = 3 << 20
#: Chunks that go to a Python task at once.
CHUNK_ROWS = 8


def _grams(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, n-gram) of every byte after the space in front of each word: the
    byte with up to GRAM - 1 before it, packed into a long, first byte highest."""
    a = np.frombuffer(b"".join(b" " + w + b" " for w in ws), np.uint8).astype(np.int64)
    lens = np.fromiter((len(w) + 2 for w in ws), np.int64, len(ws))
    word = np.repeat(np.arange(len(ws)), lens)
    at = np.arange(len(a)) - np.repeat(np.cumsum(lens) - lens, lens)
    key = np.zeros(len(a), np.int64)
    for back in range(GRAM - 1, -1, -1):
        before = np.zeros(len(a), np.int64)
        before[back:] = a[:len(a) - back]
        key = np.where(at >= back, key << 8 | before, key)
    return word[at > 0], key[at > 0]


def _pack(a: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


_CHUNK = StructType([StructField("chunk", LongType()), StructField("ids", ArrayType(StringType())), StructField("words", BinaryType()),
                     StructField("lens", BinaryType()), StructField("held", BinaryType()), StructField("times", BinaryType())])


def _chunk_rows(batches):
    """Documents as the distinct words of their chunk that they hold, in order,
    and how often."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    ids, lens, held, times, size = [], [], [], [], 0
    known: dict[bytes, int] = {}

    def row():
        words = zstandard.ZstdCompressor(level=6).compress(b" ".join(known))
        return pd.DataFrame([(base + seq, ids, words, _pack(np.array(lens)), _pack(np.concatenate(held)), _pack(np.concatenate(times)))], columns=_CHUNK.names)

    for pdf in batches:
        for i, t in zip(pdf["id"], pdf["text"], strict=True):
            c = Counter(plain_words(t))
            at = np.fromiter((known.setdefault(w, len(known)) for w in c), np.int64, len(c))
            order = np.argsort(at)
            ids.append(i)
            lens.append(len(c))
            held.append(np.diff(at[order], prepend=0))
            times.append(np.fromiter(c.values(), np.int64, len(c))[order])
            size += len(t or "") + 16
            if size >= CHUNK_BYTES:
                yield row()
                ids, lens, held, times, size, seq, known = [], [], [], [], 0, seq + 1, {}
    if ids:
        yield row()


def _read(r) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, words held by document, which, how often) of a chunk."""
    lens, held = _unpack(r.lens), _unpack(r.held)
    run = np.cumsum(held)
    first = np.cumsum(lens) - lens
    before = np.append(0, run)[first]  # what the documents in front add up to
    return zstandard.ZstdDecompressor().decompress(r.words).split(), lens, run - np.repeat(before, lens), _unpack(r.times)


def _taken(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c <= 0, 0.0).when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _shorter(key: str) -> Column:
    """The n-gram without its first byte."""
    n = " + ".join(f"int({key} >= {1 << (8 * k)}L)" for k in range(1, GRAM))
    return F.expr(f"{key} & (shiftleft(1L, 8 * ({n})) - 1L)")


def _shared(grams: DataFrame) -> DataFrame:
    """(low, below): pooled probability of the last byte of ``low``, an n-gram of
    ``grams`` (key) without its first byte, after the others, by continuation
    counts, order below order."""
    levels = []
    longer = grams.select("key")
    for _ in range(GRAM - 1):
        levels.append(stored(longer.groupBy(_shorter("key").alias("low")).agg(F.count("*").alias("c")), "toxic-continued"))
        longer = levels[-1].where("low >= 256").select(F.col("low").alias("key"))
    below = None
    for level in reversed(levels):
        d = kn._discounts(level)
        level = level.withColumn("ctx", F.shiftright("low", 8)).withColumn("off", _taken(F.col("c"), d))
        sums = level.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("off").alias("taken"))
        level = level.join(sums, "ctx")
        if below is None:
            rest = F.lit(1 / 256)
        else:
            level = level.withColumn("suffix", F.when(F.col("low") >= 256, _shorter("low"))).join(
                below.select(F.col("low").alias("suffix"), "below"), "suffix", "left")
            rest = F.when(F.col("low") >= 256, F.col("below")).otherwise(1 / 256)
        below = stored(level.select("low", ((F.col("c") - F.col("off")) / F.col("total") + F.col("taken") / F.col("total") * rest).alias("below")), "toxic-below")
    return below


def model(counts: DataFrame) -> DataFrame:
    """(ctx, key, ratio, unseen) of every n-gram of ``counts`` (key, ordinary,
    toxic): its context, the log-likelihood ratio (toxic over ordinary) of its
    last byte, and the ratio of a byte not seen after this context."""
    rows = counts.withColumn("ctx", F.shiftright("key", 8)).withColumn("low", _shorter("key"))
    sums = []
    for c in ("toxic", "ordinary"):
        d = kn._discounts(counts.select(F.col(c).alias("c")))
        rows = rows.withColumn(f"{c}_off", _taken(F.col(c), d))
        sums += [F.sum(c).alias(f"{c}_total"), F.sum(f"{c}_off").alias(f"{c}_taken")]
    rows = rows.join(rows.groupBy("ctx").agg(*sums), "ctx").join(_shared(counts), "low")
    log = {}
    for c in ("toxic", "ordinary"):
        total = F.col(f"{c}_total")
        backoff = F.when(total > 0, F.col(f"{c}_taken") / total).otherwise(1.0)
        p = F.when(total > 0, (F.col(c) - F.col(f"{c}_off")) / total).otherwise(0.0) + backoff * F.col("below")
        log[c] = F.log(F.greatest(p, F.lit(1e-12))), F.log(F.greatest(backoff, F.lit(1e-12)))
    return rows.select("ctx", "key", *[(log["toxic"][k] - log["ordinary"][k]).cast("float").alias(n) for k, n in enumerate(("ratio", "unseen"))])


def _buckets(key: np.ndarray, n_buckets: int):
    """(bucket, positions in ``key``) of every bucket that has some; an n-gram is
    in its context's."""
    b = (key >> 8) % n_buckets
    order = np.argsort(b, kind="stable")
    edge = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, edge) if len(key) else []:
        yield int(b[part[0]]), part


def _look_up(chunk: DataFrame, table: DataFrame, n_buckets: int) -> DataFrame:
    """(id, peak, by_byte, mean) of every document: the highest ratio of a word,
    the highest by byte, and the mean by byte over the text (0 without words)."""
    cell = StructType([StructField("bucket", IntegerType()), StructField("chunk", LongType()), StructField("payload", BinaryType())])

    def ask(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            for r in pdf.itertuples():
                ws = zstandard.ZstdDecompressor().decompress(r.words).split()
                if ws:
                    key = np.unique(_grams(ws)[1])
                    yield pd.DataFrame([(b, r.chunk, pack.compress(np.diff(key[part], prepend=0).tobytes())) for b, part in _buckets(key, n_buckets)], columns=cell.names)

    def answer(cells: pd.DataFrame, grams: pd.DataFrame) -> pd.DataFrame:
        grams = grams.sort_values("key")
        have = np.append(grams["key"].to_numpy(np.int64), -1)  # a last entry that no key equals
        ratio, unseen = (np.append(grams[c].to_numpy(np.float32), np.float32(0)) for c in ("ratio", "unseen"))
        out = []
        for r in cells.itertuples():
            key = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(r.payload), np.int64))
            at = np.searchsorted(have[:-1], key)
            ctx = np.searchsorted(have[:-1], key >> 8 << 8)  # the first n-gram of the context, if any
            v = np.where(have[at] == key, ratio[at], np.where(have[ctx] >> 8 == key >> 8, unseen[ctx], np.float32(0)))
            out.append((r.bucket, r.chunk, zstandard.ZstdCompressor(level=3).compress(v.astype(np.float32).tobytes())))
        return pd.DataFrame(out, columns=cell.names)

    schema = StructType([StructField("id", StringType()), *[StructField(c, DoubleType()) for c in ("peak", "by_byte", "mean")]])

    def features(said: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(said["bucket"], said["payload"], strict=True))
        out = []
        for r in held.itertuples():
            ws, lens, at, times = _read(r)
            x = np.zeros((len(lens), 3))
            if ws:
                word, key = _grams(ws)
                key, which = np.unique(key, return_inverse=True)
                value = np.empty(len(key))
                for b, part in _buckets(key, n_buckets):
                    value[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(by[b]), np.float32)
                ratio = np.bincount(word, value[which], minlength=len(ws))[at]
                n = (np.fromiter(map(len, ws), np.float64, len(ws)) + 1)[at]
                some = np.flatnonzero(lens)
                first = (np.cumsum(lens) - lens)[some]
                x[some] = np.c_[np.maximum.reduceat(ratio, first), np.maximum.reduceat(ratio / np.maximum(n, 5), first),
                                np.add.reduceat(ratio * times, first) / np.add.reduceat(n * times, first)]
            out.append(pd.DataFrame(x, columns=schema.names[1:]).assign(id=list(r.ids))[schema.names])
        return pd.concat(out) if out else pd.DataFrame(columns=schema.names)

    asked = chunk.select("chunk", "words").mapInPandas(ask, cell)
    shard = table.select("key", "ratio", "unseen", F.pmod("ctx", F.lit(n_buckets)).cast("int").alias("bucket"))
    answers = asked.groupBy("bucket").cogroup(shard.groupBy("bucket")).applyInPandas(answer, cell)
    return answers.groupBy("chunk").cogroup(chunk.groupBy("chunk")).applyInPandas(features, schema)


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (intercept last) of a logistic regression, lightly ridged."""
    a = np.c_[x, np.ones(len(x))]
    b = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        ridge = 1e-3 * np.array([1.0] * x.shape[1] + [0.0])
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * b)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def fold(id_col: Column) -> Column:
    """CRC-32 of the id as text, modulo FOLDS; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(FOLDS)), F.lit(0)).cast("int")


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Score every document between 0 and 1, higher where toxic is likelier.

    ``labels``: ids with ``label_col`` 1 or 0 (null: not labelled; an id with
    both counts as 1).  Returns one row per input row: the id, ``held_out``
    (its label is never read: CRC-32 of the id as text divisible by FOLDS) and
    ``score``.  Only the text enters a score.

    A null or empty text scores as one without any evidence; repeated rows
    score alike; a null id is held out and stays null; other columns are not
    read.  Without labels of both classes the score is the toxic share of the
    labels, 0.5 if there are none.  No documents, no rows.

    The documents are written to the shared folder as the words they hold, and
    every n-gram of the counted rows is in the model, whatever their number."""
    id_type = df.schema[id_col].dataType
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    known = (labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where("label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label")).where(fold(F.col("id")) != 0))
    n_buckets = max(-(-bucket_count(docs) // 4), 2 * shuffle_partitions(spark)) | 1
    with batches_of(spark):
        chunk = stored(docs.mapInPandas(_chunk_rows, _CHUNK), "toxic-chunks")
    # labels grow with the documents: the same shuffled join at every size
    picked = (chunk.select("chunk", F.posexplode("ids").alias("at", "id")).where(fold(F.col("id")).between(1, FOLDS - 2))
              .join(known.hint("shuffle_hash"), "id").groupBy("chunk").agg(F.collect_list(F.struct("at", "label")).alias("picked")))  # within a chunk
    picked = picked.select("chunk", F.col("picked.at").alias("at"), F.col("picked.label").alias("label"))

    def count(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                ws, lens, held, times = _read(r)
                label = np.full(len(lens), -1)
                label[np.asarray(r.at)] = np.asarray(r.label)
                label = np.repeat(label, lens)
                n = [np.bincount(held[label == y], times[label == y], minlength=len(ws)) for y in (0, 1)]
                some = np.flatnonzero(n[0] + n[1])
                if len(some):
                    word, key = _grams([ws[k] for k in some])
                    key, which = np.unique(key, return_inverse=True)
                    n = [np.bincount(which, c[some][word]).astype(np.int64) for c in n]
                    yield pd.DataFrame({"key": key, "ordinary": n[0], "toxic": n[1]})

    schema = StructType([StructField("key", LongType()), StructField("ordinary", LongType()), StructField("toxic", LongType())])
    with batches_of(spark, CHUNK_ROWS):
        counts = stored(chunk.drop("ids").join(picked.hint("shuffle_hash"), "chunk").mapInPandas(count, schema)
                        .groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "toxic-counts")
    with batches_of(spark, CHUNK_ROWS):
        found = stored(_look_up(chunk, model(counts), n_buckets), "toxic-features")

    fit = found.where(fold(F.col("id")) == FOLDS - 1).join(known.hint("shuffle_hash"), "id").select("peak", "by_byte", "mean", "label")
    fit = fit.orderBy(F.xxhash64("peak", "by_byte", "mean"), "label").limit(CURVE_ROWS).toPandas()  # CURVE_ROWS rows
    if fit["label"].nunique() == 2 and not counts.isEmpty():
        *weights, at0 = _curve(fit[["peak", "by_byte", "mean"]].to_numpy(), fit["label"].to_numpy(np.float64)).tolist()
        x = sum((F.col(c) * w for c, w in zip(("peak", "by_byte", "mean"), weights, strict=True)), F.lit(at0))
        score = 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))
    else:
        share = known.agg(F.avg("label")).first()[0]
        score = F.lit(0.5 if share is None else float(share))
    return found.select(F.col("id").cast(id_type).alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), score.alias("score"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Operator 5: every text of `documents`, learnt from `labels.toxic`."""
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
