"""Corpus pipeline over `documents`: quality filter, near-duplicate removal,
benchmark decontamination, mixing of sources, sharding.

Each stage works on all that the one before kept, and all but the last return
the columns of their input.  Rows are told apart by doc_id and text; rows equal
in both share every decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import sized, stored
from tessera.llm.decontaminate import contamination
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.quality import quality
from tessera.llm.shuffle_shards import uniform_shards


def _key() -> Column:
    """Key of a row, as text: doc_id (empty if null) and a hash of its text."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))


def _decisions(keyed: DataFrame, name: str, *values: str) -> DataFrame:
    """Decisions by key, as the two numbers of the key."""
    part = F.split("_key", ":")
    got = keyed.select(F.when(part[0] != "", part[0]).cast("long").alias("_id"), part[1].cast("long").alias("_hash"), *values)
    return sized(got, name)


def _match(docs: DataFrame, decided: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(decided["_id"]) & (F.xxhash64(docs["text"]) == decided["_hash"])


def _without(docs: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """``docs`` less the rows whose key is in ``keys``."""
    gone = _decisions(keys.select("_key").distinct(), name)
    return docs.join(gone, _match(docs, gone), "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose perplexity under a model of the trusted rows
    (`labels.quality` 1) is beyond their language's threshold."""
    keyed = docs.withColumn("_key", _key())
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    scored = quality(keyed, keyed.select("doc_id", "_key").join(good, "doc_id").select("_key"), "_key", "text", "lang")
    return _without(docs, scored.where("NOT keep"), "rejected")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of 5-word-shingle Jaccard links of
    0.8 or more: the one with the smallest key.  Of repeated rows one stays."""
    keyed = docs.withColumn("_key", _key())
    found = near_duplicates(keyed, "_key", "text").groupBy("_key").agg(
        F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    found = found.select("_key", (F.col("_key") == F.col("component_id")).alias("stays"), (F.col("rows") > 1).alias("repeated"))
    found = _decisions(found.where("NOT stays OR repeated"), "copies", "stays")
    gone = docs.join(found, _match(docs, found), "left_anti")
    once = docs.join(found.where("stays"), _match(docs, found), "left_semi").dropDuplicates(["doc_id", "text"])
    return gone.unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of which a twentieth or more lies in 13-word windows
    of `benchmark` items."""
    keyed = docs.withColumn("_key", _key())
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_key", "text")
    return _without(docs, found.where("contaminated"), "contaminated")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix of sources takes it (not at
    all, once or twice); repeated rows are taken alike, each as often as the
    least taken of them."""
    keyed = docs.withColumn("_key", _key())
    copies = mix(keyed, "_key", "text", "source").groupBy("_key").agg(F.min("copies").alias("_copies")).where("_copies > 0")
    copies = _decisions(copies, "mixed", "_copies")
    both = docs.join(copies, _match(docs, copies))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*[docs[c] for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles all rows uniformly into 24 shards, counts at most one apart:
    the columns of the input, ``shard`` and ``slot``."""
    return uniform_shards(docs, tie_cols=["doc_id", "n_chars", "source", "lang", "text"])


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicate_filter),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: Language models, signature trees and random draws have no SQL form here; the
#: stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages, one after another, to `documents`; what a stage keeps
    is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k + 1}")
    return docs
