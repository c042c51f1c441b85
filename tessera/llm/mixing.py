"""Mixing sources to target weights by Pareto order sampling (operator 4).

Each source's target in words fixes how often its documents are taken on
average.  The whole part of that number is certain copies of every document;
the rest is drawn by Pareto order sampling: each document gets a random odds
divided by its inclusion odds, and the smallest ranks are taken until the
source's target is met.  Targets are sums of words, so the sample's size is
fixed in words, up to half of the last document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Weights of the sources in order, repeating; share of all words to take;
#: most copies of a document (and times a source's words).
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Ranks are cut into BINS ranges and the last range again, so that no task
#: sorts more than a BINS * BINS-th part of a source.
BINS = 4096


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: Column) -> Column:
    """Uniform number in (0, 1), fixed by the id and SEED: the first 52 bits
    of an MD5 sum."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long")
    return (h + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, a null one last, weigh WEIGHTS in turn and share
    SHARE of all words; a target stops at MOST times its source's size and the
    excess is reshared by weight.  That is one level L with target
    ``min(MOST * size, L * weight)``: ordered by ``size / weight``, the sources
    up to some place are capped and the rest share what is left."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    full = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
         .withColumn("open_weight", F.sum("weight").over(after))
         .withColumn("whole", F.lit(SHARE) * F.sum("source_size").over(full)))
    s = s.withColumn("level", (F.col("whole") - F.col("capped")) / F.col("open_weight"))
    # taken as capped, too many sources only lower the level: the highest that caps none of its own is the true one
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(full)
    return s.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("weight"), "cap")).alias("target"))


def _running(rows: DataFrame, keys: list[str], by: str, out: str) -> DataFrame:
    """Words of the ranges before each range ``by``, within ``keys``: the sums
    of the ranges first, then a window over at most BINS rows a key."""
    sums = rows.groupBy(*keys, by).agg(F.sum("unit").alias("words"))
    w = Window.partitionBy(*keys).orderBy(by)
    return sums.withColumn(out, F.sum("words").over(w) - F.col("words"))


def pareto_sample(docs: DataFrame) -> DataFrame:
    """Add ``taken`` copies to (id, source, size, share, draw).

    ``share`` (0 or more, times a document is to be taken) gives its whole
    part in certain copies; among the documents of a source, the fractions are
    drawn so that their words come to the sum of ``fraction * size``: by rising
    rank (ties by id), every document whose middle lies below that sum.
    Documents without words are never drawn."""
    whole = F.floor("share")
    fraction = F.col("share") - whole
    # odds of the draw over odds of inclusion, carried to (0, 1) so that ranks can be cut into equal ranges
    odds = (F.col("draw") / (1 - F.col("draw"))) / (fraction / (1 - fraction))
    d = docs.withColumn("whole", whole.cast("long")).withColumn("fraction", fraction)
    in_draw = (F.col("fraction") > 0) & (F.col("size") > 0)
    d = d.withColumn("rank", F.when(in_draw, odds / (1 + odds))).withColumn("unit", F.when(in_draw, F.col("size")).otherwise(0))
    drawn_from = F.col("rank").isNotNull()  # least() would skip a null
    d = d.withColumn("bin", F.when(drawn_from, F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1))))
    d = d.withColumn("fine", F.when(drawn_from, F.least(F.floor((F.col("rank") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1))))
    d = stored(d, "mix")
    need = d.groupBy("source").agg(F.round(F.sum(F.col("fraction") * F.col("size")), 6).alias("need"))

    def cut(level: DataFrame, by: str, before: str) -> DataFrame:
        """Ranges with the source's need, and which of them holds its end."""
        return level.withColumn("state", F.when(F.col(before) + F.col("words") <= F.col("need"), "in")
                                .when(F.col(before) >= F.col("need"), "out").otherwise("split"))

    same = lambda a, b: a["source"].eqNullSafe(b["s"])
    need = need.withColumnRenamed("source", "s")
    drawn = d.where("bin IS NOT NULL")
    first = _running(drawn, ["source"], "bin", "before")
    first = cut(first.join(need, same(first, need)).drop("s"), "bin", "before").select(
        F.col("source").alias("s"), F.col("bin").alias("b"), "before", "need", "state")
    first = stored(first, "mix-bins")
    split = first.where("state = 'split'")
    inner = drawn.join(split, same(drawn, split) & (drawn["bin"] == split["b"])).drop("s", "b", "state")
    second = _running(inner, ["source", "bin"], "fine", "inside")
    second = second.join(split, same(second, split) & (second["bin"] == split["b"])).drop("s", "b", "state")
    second = cut(second.withColumn("inside", F.col("inside") + F.col("before")), "fine", "inside").select(
        F.col("source").alias("s"), F.col("bin").alias("b"), F.col("fine").alias("f"), "inside", "need", "state")
    second = stored(second, "mix-fine")
    last = second.where("state = 'split'")
    edge = inner.drop("before", "need").join(last, same(inner, last) & (inner["bin"] == last["b"]) & (inner["fine"] == last["f"])).drop("s", "b", "f", "state")
    w = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("upto", F.col("inside") + F.sum("size").over(w))
    chosen = edge.select(*d.columns, (F.col("upto") - F.col("size") / 2 < F.col("need")).alias("drawn"))

    a = first.where("state <> 'split'").select("s", "b", (F.col("state") == "in").alias("drawn"))
    b = second.where("state <> 'split'").select("s", "b", "f", (F.col("state") == "in").alias("drawn"))
    by_bin = drawn.join(a, same(drawn, a) & (drawn["bin"] == a["b"]))
    by_fine = drawn.join(b, same(drawn, b) & (drawn["bin"] == b["b"]) & (drawn["fine"] == b["f"]))
    rest = d.where("bin IS NULL").withColumn("drawn", F.lit(False))
    every = rest.unionByName(by_bin.drop("s", "b")).unionByName(by_fine.drop("s", "b", "f")).unionByName(chosen)
    return every.withColumn("copies", F.col("whole") + F.col("drawn").cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Copies of every document in a mix that gives each source its target.

    Returns one row per input row: the id, ``source``, ``size`` (words),
    ``source_size``, ``target`` (words the source is to give) and ``copies``
    (0 to MOST).  Reruns agree, whatever the partitions: the draw depends on
    the id alone.

    A null or empty text has size 0 and, in a source with a target, the whole
    copies alone; a source without words has target 0; a null source is one of
    its own; rows with one id (null too) share their draw and are ranked side
    by side.  Other columns are not read.  An empty table gives no rows."""
    slim = stored(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                            n_words(F.col(text_col)).alias("size")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes), "mix-targets").withColumnRenamed("source", "s")
    docs = slim.join(targets, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    docs = docs.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("draw", draw(F.col("id")))
    out = pareto_sample(docs)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over whole `documents`: source weights 3, 1, 2, repeating."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
