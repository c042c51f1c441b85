"""Merkle manifest of a table (operator 11), by a butterfly exchange.

Rows are leaves, in order within their group (a source); the nodes of a level
are hashed in runs of ``fanout`` up to the group's root, and the groups' roots
likewise up to the root of the table.

A *part* is an aligned run of ``fanout ** part_levels`` leaves of a group; a
task builds its subtree alone.  Then, round by round, parts swap subtree roots:
those at the same place (lane) of ``fanout`` neighbouring subtrees meet, and
each of them notes the others' roots as its own proof and hashes their common
ancestor for itself.  After as many rounds as the tree has levels every part
knows its whole proof and the root; nothing is sent down the tree again.  Where
a subtree has fewer parts than its neighbours (the last of a level, or a small
group beside a large one), its parts also serve the lanes it does not have.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import stored

FANOUT = 3
#: Levels inside a part: 3 ** 8 = 6,561 leaves.
PART_LEVELS = 8
#: Rounds between two writes of the swapped roots.
ROUNDS = 4


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_hash(*values: Column) -> Column:
    """Hash of values in order: each ``-`` if null, else its bytes in UTF-8, a
    colon and itself."""
    def part(v: Column) -> Column:
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v) for v in values]), 256)


def subtree(leaves: list[str], levels: int | None, fanout: int) -> list[list[str]]:
    """Nodes of every level over ``leaves``, which come first: ``levels`` levels
    up, or to a single node if None."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[k:k + fanout])) for k in range(0, len(below), fanout)])
    return out


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows by (group, order, leaf), with ``at``: the task's number and the
    row's in it, in one value."""
    order = [F.col("grp").asc_nulls_first(), F.col("ord").asc_nulls_first(), F.col("leaf"), F.col("row")]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("grp", "ord", "leaf", "changed", "carried", F.monotonically_increasing_id().alias("at")), "merkle-ordered")


def _spans(rows: DataFrame) -> DataFrame:
    """For each (task, group) of ordered rows: the task's first row of the group
    (``first``), the group's rows in tasks before (``before``), in all
    (``total``), and the group's number in order (``g``).

    One row a task and a group; the only window over all of them is over tasks."""
    spans = rows.groupBy(F.shiftright("at", 33).alias("task"), "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = spans.groupBy("grp").agg(F.min("task").alias("task0"), F.sum("n").alias("total"))
    per_task = groups.groupBy("task0").agg(F.count("*").alias("n0"))
    earlier = Window.orderBy("task0").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    per_task = per_task.select("task0", F.coalesce(F.sum("n0").over(earlier), F.lit(0)).alias("g0"))
    within = Window.partitionBy("task0").orderBy(F.col("grp").asc_nulls_first())
    groups = groups.join(per_task, "task0").select(F.col("grp").alias("_grp"), "total", (F.col("g0") + F.row_number().over(within) - 1).alias("g"))
    so_far = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("*", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("before"))
    return spans.join(groups, F.col("grp").eqNullSafe(F.col("_grp"))).drop("_grp", "n")


def _parts(rows: DataFrame, spans: DataFrame, size: int, levels: int, fanout: int) -> DataFrame:
    """One row a part: its leaves in order, as arrays, and its subtree's root."""
    rows = rows.withColumn("_task", F.shiftright("at", 33)).withColumnRenamed("grp", "_grp")
    rows = rows.join(spans, (F.col("_task") == F.col("task")) & F.col("_grp").eqNullSafe(F.col("grp")))
    place = F.col("before") + F.col("at") - F.col("first")
    rows = rows.select("g", "total", place.alias("place"), F.floor(place / size).alias("part"), "leaf", "changed", "carried")
    parts = rows.groupBy("g", "total", "part").agg(  # at most `size` rows each
        F.sort_array(F.collect_list(F.struct("place", "leaf", "changed", "carried"))).alias("_rows"))
    parts = parts.select("g", "part", F.ceil(F.col("total") / size).alias("parts"), F.col("_rows.leaf").alias("leaves"),
                         F.col("_rows.changed").alias("changed"), F.col("_rows.carried").alias("carried"))

    @F.pandas_udf(StringType())
    def root(leaves: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([subtree(list(x), None if n == 1 else levels, fanout)[-1][0] for x, n in zip(leaves, parts, strict=True)], dtype=object)

    return stored(parts.withColumn("root", root("leaves", "parts")), "merkle-parts")


def _swap(e: DataFrame, active: Column, parent: list[Column], digit: Column, rank: Column, sizes: Column) -> DataFrame:
    """One round.  ``e`` has a row a part: ``id``, ``root`` (of its subtree),
    ``path`` and anything else, which is kept in ``id``.  ``parent`` names the
    subtree above, ``digit`` this subtree's place under it, ``rank`` the part's
    place in the subtree and ``sizes`` the parts of all subtrees under the
    parent.  Parts that are not ``active`` stay as they are."""
    lanes = F.array_max("sizes")
    mine = F.element_at("sizes", (F.col("digit") + 1).cast("int"))
    sent = e.select("*", F.array(*[p.cast("long") for p in parent]).alias("parent"), digit.alias("digit"), rank.alias("rank"), sizes.alias("sizes"),
                    active.alias("active"))
    sent = sent.select("*", F.explode(F.sequence(F.col("rank"), lanes - 1, mine)).alias("lane"))
    home = F.col("lane") == F.col("rank")
    met = sent.groupBy("active", "parent", "lane").agg(F.sort_array(F.collect_list(F.struct(  # at most `fanout` rows
        "digit", "root", F.when(home, F.struct("id", "path")).alias("home")))).alias("met"))
    above = F.when(F.col("active"), F.sha2(F.array_join("met.root", ""), 256))
    each = met.select("active", "met", above.alias("above"), F.explode("met").alias("me")).where("me.home IS NOT NULL")
    side = lambda keep: F.array_join(F.transform(F.filter("met", keep), lambda m: m.root), "")
    left, right = side(lambda m: m.digit < F.col("me.digit")), side(lambda m: m.digit > F.col("me.digit"))
    step = F.concat(F.col("me.home.path"), left, F.lit("."), right, F.lit(";"))
    return each.select(F.col("me.home.id").alias("id"), F.when(F.col("active"), F.col("above")).otherwise(F.col("me.root")).alias("root"),
                       F.when(F.col("active"), step).otherwise(F.col("me.home.path")).alias("path"))


def _group_sizes(parts: DataFrame, fanout: int) -> tuple[DataFrame, int, int]:
    """For each group, its number of parts, and for each round over groups the
    parts of the subtrees beside its own and of those before it in its own; the
    rounds inside groups and over groups."""
    groups = stored(parts.groupBy("g").agg(F.first("parts").alias("parts")), "merkle-groups")
    top = groups.agg(F.max("parts"), F.count("*")).first()  # two numbers

    def rounds(n: int | None) -> int:
        r = 0
        while fanout ** r < (n or 0):
            r += 1
        return r

    inside, over = rounds(top[0]), rounds(top[1])
    # parts of groups before a group in its subtree, level by level from the group itself (0) upwards
    out = groups.withColumn("top", F.array().cast("array<struct<sizes:array<bigint>,rank:bigint>>")).withColumn("in_subtree", F.lit(0).cast("long"))
    for r in range(over):
        digit = lambda c: F.floor(c / fanout ** r) % fanout
        under = groups.groupBy(F.floor(F.col("g") / fanout ** (r + 1)).alias("up")).agg(
            *[F.sum(F.when(digit(F.col("g")) == d, F.col("parts")).otherwise(0)).alias(f"s{d}") for d in range(fanout)])
        under = under.select("up", F.array(*[f"s{d}" for d in range(fanout)]).alias("sizes"))
        d = digit(F.col("g"))
        before = F.aggregate(F.slice("sizes", F.lit(1), d.cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        out = (out.join(under, F.floor(F.col("g") / fanout ** (r + 1)) == F.col("up"))
               .select("g", "parts", F.concat("top", F.array(F.struct("sizes", F.col("in_subtree").alias("rank")))).alias("top"),
                       (F.col("in_subtree") + before).alias("in_subtree")))
    return stored(out.select("g", F.col("top")), "merkle-sizes"), inside, over


def butterfly(parts: DataFrame, fanout: int) -> DataFrame:
    """Proofs above the parts: ``g``, ``part``, ``subroot`` (the group's),
    ``root`` and ``path``, the digests left and right of the part's ancestor at
    each level, as ``left.right;`` from below."""
    sizes, inside, over = _group_sizes(parts, fanout)
    e = parts.join(sizes, "g").select(F.struct("g", "part", "parts", "top", F.lit(None).cast("string").alias("subroot")).alias("id"), "root", F.lit("").alias("path"))
    for r in range(inside):
        width = fanout ** r
        part, n = F.col("id.part"), F.col("id.parts")
        up = F.floor(part / (width * fanout))
        beside = F.array(*[F.greatest(F.least(n - (up * fanout + d) * width, F.lit(width)), F.lit(0)).cast("long") for d in range(fanout)])
        e = _swap(e, n > width, [F.col("id.g"), up], F.floor(part / width) % fanout, part % width, beside)
        e = stored(e, "merkle-round") if r % ROUNDS == ROUNDS - 1 else e
    e = e.select(F.col("id").withField("subroot", F.col("root")).alias("id"), "root", "path")
    for r in range(over):
        g, at = F.col("id.g"), F.element_at("id.top", r + 1)
        e = _swap(e, F.lit(True), [F.floor(g / fanout ** (r + 1))], F.floor(g / fanout ** r) % fanout, F.col("id.part") + at.rank, at.sizes)
        e = stored(e, "merkle-round") if r % ROUNDS == ROUNDS - 1 else e
    return e.select("id.g", "id.part", "id.subroot", "root", "path")


def merkle_manifest(df: DataFrame, id_col: str, group_col: str, leaf: Column, changed: Column,
                    fanout: int = FANOUT, part_levels: int = PART_LEVELS) -> DataFrame:
    """Merkle tree over the rows of ``df``, groups of ``group_col`` in byte order
    and rows of a group in the order of ``id_col``: ``id``, ``leaf``,
    ``subroot`` (of the group), ``root``, ``proof`` (the digests beside the
    row's path, joined, from below), ``proof_sha256``, and, with the row's
    ``changed`` leaf (null: its own) and the same proof, ``folded_root`` and
    ``verified`` (equals ``root``).

    ``leaf`` and ``changed`` are hashes computed from the row.  A null group is a
    group of its own and comes first, a null id before all others; rows of one id
    are ordered by their leaf, and rows equal in both are alike.  A single row's
    leaf is the root, with an empty proof.  No rows give none.  Only the columns
    named are read, so others may have any name.

    The leaves are written and exchanged twice, by range of (group, id) and by
    part; parts are bounded, however large a group is."""
    rows = stored(df.select(F.col(id_col).cast("string").alias("carried"), F.col(id_col).alias("ord"), F.col(group_col).alias("grp"), leaf.alias("leaf"),
                            F.when(changed != leaf, changed).alias("changed"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    ordered = _ordered(rows)
    parts = _parts(ordered, stored(_spans(ordered), "merkle-spans"), fanout ** part_levels, part_levels, fanout)
    proofs = butterfly(parts, fanout)
    found = parts.drop("root").join(proofs, ["g", "part"])
    names = ["leaf", "subroot", "root", "proof", "proof_sha256", "folded_root"]
    schema = StructType([StructField(n, StringType()) for n in ["id", *names]])  # ids as text, exact beside nulls

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in pdf.itertuples(index=False):
                levels = subtree(list(part.leaves), None if part.parts == 1 else part_levels, fanout)
                upper = [tuple(s.split(".")) for s in part.path.split(";")[:-1]]
                above = "".join(left + right for left, right in upper)
                out: list[tuple] = []
                for k, own in enumerate(part.leaves):
                    proof, folded, at = [], part.changed[k] or own, k
                    for nodes in levels[:-1]:
                        first = at - at % fanout
                        left, right = "".join(nodes[first:at]), "".join(nodes[at + 1:first + fanout])
                        proof.append(left + right)
                        folded, at = digest(left + folded + right), at // fanout
                    for left, right in upper:
                        folded = digest(left + folded + right)
                    whole = "".join(proof) + above
                    out.append((part.carried[k], own, part.subroot, part.root, whole, digest(whole), folded))
                yield pd.DataFrame(out, columns=["id", *names])

    done = found.mapInPandas(fold, schema)
    return done.select(F.col("id").cast(df.schema[id_col].dataType).alias("id"), *names, (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: Merkle manifest of `documents`; rows whose id has an even
    crc32 are verified with line feeds deleted from their text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    changed = F.when(even & F.contains("text", F.lit("\n")), hashed(F.replace("text", F.lit("\n"), F.lit("")))).otherwise(hashed(F.col("text")))
    out = merkle_manifest(docs, "doc_id", "source", hashed(F.col("text")), changed)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
