"""N-gram Jaccard self-join with signature trees (operator 8).

1. Every document's set of distinct word shingles is hashed to 64 bits, and
   the documents that hold a shingle are counted over the corpus (`cells`).
   A set can only link to another if the share of its shingles that occur
   elsewhere reaches the threshold, so most sets are settled here.
2. Equal sets fold into one representative.
3. The remaining sets are dealt into shards by a shingle of their prefix (the
   rarest shingles, of which linked sets must share one): the one that most
   sets share, so that groups of near copies meet.  A set also visits each
   smaller-numbered shard in which another set has a prefix shingle with it.
4. A shard's task holds a signature tree of its sets and one of its visitors
   and joins them by dual traversal (`signature_tree`), confirming each
   candidate by its exact Jaccard; pairs that are connected already are
   skipped, so a group of near copies costs no quadratic work.
5. Components of the links give the classes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from tessera.llm import cells
from tessera.llm.common import BASE_A, BASE_B, U64, batches_of, bucket_count, lower_words, mix, rolling, stored, word_hashes
from tessera.llm.components import components
from tessera.llm.signature_tree import link

WORDS = 5
PERCENT = 80
#: Sets of one shard, and visitors that one task compares with them.
SHARD_SETS = 1000
VISITORS = 4000


class _Sets:
    """Distinct shingles of a chunk's documents; their order in the cells."""

    def __init__(self, texts: list, n: int, n_buckets: int):
        ws = [lower_words(t) for t in texts]
        lens = list(map(len, ws))
        w = cells.concat([word_hashes(x) for x in ws if x], U64)
        rolled = mix(rolling(w, n, BASE_A))
        self.sets, at = [], 0
        for k in lens:
            if k >= n:
                s = np.sort(rolled[at:at + k - n + 1])
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif k:
                s = mix(rolling(w[at:at + k], k, BASE_B) + U64(k))
            else:
                s = np.empty(0, U64)
            self.sets.append(s)
            at += k
        tokens = cells.concat(self.sets, U64)
        self.distinct, self.which, self.df = np.unique(tokens, return_inverse=True, return_counts=True)
        bucket = ((mix(self.distinct ^ U64(BASE_B)) >> U64(20)) % U64(n_buckets)).astype(np.int32)
        self.sent = np.argsort(bucket.astype(np.uint16) if n_buckets < 1 << 16 else bucket, kind="stable")
        self.counts = np.bincount(bucket, minlength=1)

    def cells(self):
        at = 0
        for b in np.flatnonzero(self.counts):
            i = self.sent[at:at + self.counts[b]]
            at += self.counts[b]
            low = np.ascontiguousarray(self.distinct[i].view(np.uint8).reshape(-1, 8)[:, :6])
            yield int(b), low.tobytes() + np.minimum(self.df[i], 0xFFFF).astype(np.uint16).tobytes()

    def classes(self, answers: dict[int, bytes]) -> list[np.ndarray]:
        """For every document and shingle: 0 if no other document has it, else
        a class that grows with the number of documents."""
        got = np.zeros(len(self.distinct), np.uint8)
        at = 0
        for b in np.flatnonzero(self.counts):
            n = int(self.counts[b])
            got[self.sent[at:at + n]] = np.frombuffer(answers[int(b)], np.uint8)
            at += n
        each = got[self.which]
        return np.split(each, np.cumsum([len(s) for s in self.sets])[:-1]) if self.sets else []


def _answer(payloads: list[bytes]) -> list[bytes]:
    """Class of every entry: 0 for one document, 1 for 2 or 3, 2 for 4 to 7 ..."""
    sizes = [len(p) // 8 for p in payloads]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    df = np.empty(len(wide), np.int64)
    at = 0
    for p, n in zip(payloads, sizes, strict=True):
        wide[at:at + n, :6] = np.frombuffer(p, np.uint8, 6 * n).reshape(-1, 6)
        df[at:at + n] = np.frombuffer(p, np.uint16, n, 6 * n)
        at += n
    key = wide.view(U64).ravel()
    order = np.argsort(key)
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    total = np.zeros(int(new.sum()), np.int64)
    np.add.at(total, group, df[order])
    said = np.empty(len(key), np.uint8)
    said[order] = np.floor(np.log2(total)).astype(np.uint8)[group] if len(key) else said
    ends = np.cumsum(sizes)
    return [said[e - n:e].tobytes() for e, n in zip(ends, sizes, strict=True)]


def shingle_sets(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """(id, n_shingles, digest, tokens, prefix) per document.  ``digest`` names
    the set (null: empty); ``tokens`` (packed, those that other documents have)
    and ``prefix`` are null where the set cannot link to another."""
    n_buckets = bucket_count(df, text_col)
    schema = StructType([
        StructField("id", StringType()), StructField("n_shingles", LongType()), StructField("digest", BinaryType()),
        StructField("tokens", BinaryType()), StructField("prefix", ArrayType(LongType())),
    ])

    def make(ids, texts):
        return _Sets(texts, n, n_buckets).cells()

    def assemble(ids, texts, answers):
        held = _Sets(texts, n, n_buckets)
        out = []
        for i, s, c in zip(ids, held.sets, held.classes(answers), strict=True):
            need = -(-percent * len(s) // 100)
            shared = c > 0
            digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
            if not len(s) or shared.sum() < need:
                out.append((i, len(s), digest, None, None))
                continue
            first = np.lexsort((s, c))[:len(s) - need + 1]
            first = first[shared[first]]
            out.append((i, len(s), digest, s[shared].tobytes(), s[first].view(np.int64).tolist()))
        return pd.DataFrame(out, columns=schema.names)

    return cells.exchange(df, id_col, text_col, n_buckets, make, _answer, assemble, schema)


def _shards(tokens: DataFrame) -> DataFrame:
    """(digest, shard): the shard of each set by its most shared prefix token.
    Sets of one token beyond SHARD_SETS are split into pieces, small groups
    are packed together."""
    home = tokens.groupBy("digest").agg(F.max(F.struct("sets", "token"))["token"].alias("home"))
    home = stored(home, "home")
    n = home.count()
    packed = max(1, -(-n // SHARD_SETS))
    size = home.groupBy("home").agg(F.count("*").alias("size"))
    piece = F.pmod(F.xxhash64("digest"), F.ceil(F.col("size") / SHARD_SETS))
    return home.join(size, "home").select("digest", F.when(
        F.col("size") > SHARD_SETS, F.xxhash64("home", piece)).otherwise(F.pmod(F.xxhash64("home"), F.lit(packed))).alias("shard"))


def _members(tokens: DataFrame, shards: DataFrame) -> DataFrame:
    """(digest, shard, part, visitor): each set in its own shard, and in every
    smaller-numbered shard where another set has one of its prefix tokens."""
    at = stored(tokens.select("digest", "token").join(shards, "digest"), "at")
    there = at.select("token", F.col("shard").alias("to")).distinct()
    visits = stored(at.join(there, "token").where("to < shard").select("digest", F.col("to").alias("shard")).distinct(), "visits")
    parts = visits.groupBy("shard").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("parts"))
    visitors = visits.join(parts, "shard").select(
        "digest", "shard", F.pmod(F.xxhash64("digest"), "parts").cast("int").alias("part"), F.lit(True).alias("visitor"))
    own = shards.join(parts, "shard", "left").select(
        "digest", "shard", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("visitor"))
    return own.unionByName(visitors)


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between set digests: a spanning forest of the pairs of
    each shard whose Jaccard similarity reaches ``percent``."""
    live = sets.where("prefix IS NOT NULL")
    tokens = live.groupBy("digest").agg(F.first("prefix").alias("prefix")).select("digest", F.explode("prefix").alias("token"))
    count = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    tokens = stored(tokens.join(count, "token"), "tokens")
    shards = stored(_shards(tokens), "shards")
    members = _members(tokens, shards)
    whole = live.groupBy("digest").agg(F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(t, U64) for t in pdf["tokens"]]
        pdf = pdf.assign(least=np.fromiter((int(t[0]) for t in held), U64, len(held)), at=range(len(held)))
        pdf = pdf.sort_values(["visitor", "least", "n", "digest"])  # sets alike come near each other in the tree
        order = pdf["at"].tolist()
        names = pdf["digest"].tolist()
        forest = link([held[k] for k in order], pdf["n"].to_numpy(np.int64), int((~pdf["visitor"]).sum()), percent,
                      own=bool(pdf["part"].iloc[0] == 0))
        pairs = [(names[k], names[r]) for k, r in enumerate(forest.labels().tolist()) if k != r]
        return pd.DataFrame(pairs, columns=["a", "b"])

    return (members.join(whole, "digest").groupBy("shard", "part")
            .applyInPandas(join, StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Classes of documents connected by Jaccard links of their word n-grams.

    Returns one row per input row: the id, ``n_shingles`` and
    ``component_id``, the smallest id reachable by links (itself included).
    Two documents link when ``100 * |A & B| >= percent * |A | B|``; words are
    those of the text with A-Z lower-cased; a text of fewer than ``n`` words
    has one shingle, its whole sequence.

    A null or empty text has an empty set, links to nothing and is its own
    component.  Rows repeated in the input share a component.  A null id stays
    null and never names a component that holds another id.  Other columns are
    not read.  An empty table gives no rows."""
    with batches_of(df.sparkSession):
        sets = stored(shingle_sets(df, id_col, text_col, n, percent), "sets")
        links = stored(linked_sets(sets, percent), "links")
    roots = components(links, "components")
    least = sets.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"))
    classes = least.join(roots, least["digest"] == roots["node"], "left").select(
        "digest", "least", F.coalesce("root", "digest").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(named, "root").select("digest", "component_id")
    out = sets.select("id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over whole `documents`: 5-word shingles, Jaccard 0.8."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, "doc_id", "text", WORDS, PERCENT).select("doc_id", "n_shingles", "component_id")
