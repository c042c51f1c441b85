"""Nearest vectors by cosine with a navigable small-world graph per shard
(operator 10).

Equal vectors fold into one entry that keeps the smallest ids, entries are
dealt into shards of bounded size by a hash, and each shard's task builds a
hierarchical navigable small-world graph, stored as flat neighbour arrays in
one row.  Every query block then walks every shard's graph, and the shards'
results are merged by exact score.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from tessera.llm.common import stored

K = 5
#: Entries of a shard's graph; neighbours of a node above the lowest layer
#: (twice as many there); width of the search.
SHARD_ROWS, LINKS, WIDTH = 4096, 16, 96
#: Queries that one task walks through one graph.
QUERY_BLOCK = 1024
SEED = 7


def _choose(vec: np.ndarray, at: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """For each node of ``at`` at most ``m`` of its candidates (nearest first):
    one is kept if it is nearer to the node than to any kept before; what is
    left free is filled with the nearest others.  -1 where there are fewer."""
    n, c = cand.shape
    out = np.full((n, m), -1, np.int32)
    for lo in range(0, n, 256):
        ids, s = cand[lo:lo + 256], sim[lo:lo + 256]
        v = vec[ids]
        between = v @ v.transpose(0, 2, 1)
        kept = np.zeros(ids.shape, bool)
        full = np.zeros(len(ids), np.int64)
        for j in range(c):
            apart = ~(kept & (between[:, j] >= s[:, j, None])).any(axis=1)
            take = apart & (full < m) & (s[:, j] > -2)
            kept[:, j] = take
            full += take
        rank = np.where(kept, 0, 1) * 2 * c + np.arange(c)
        order = np.argsort(np.where(s > -2, rank, 4 * c), axis=1, kind="stable")[:, :m]
        picked = np.take_along_axis(ids, order, axis=1)
        out[lo:lo + 256, :picked.shape[1]] = np.where(np.take_along_axis(s, order, axis=1) > -2, picked, -1)
    return out


def build(vec: np.ndarray, links: int = LINKS, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers of the graph over unit vectors, the lowest first: (nodes, flat
    neighbour array with a row for each of these nodes, -1 where free).

    Every node reaches a layer by chance, each layer holding a ``links``-th of
    the one below.  As a shard is small, a layer's neighbours are chosen from
    the exactly nearest nodes of the layer, and links are made both ways."""
    rng = np.random.default_rng(seed)
    top = np.floor(-np.log(1 - rng.random(len(vec))) / np.log(links)).astype(int)
    layers = []
    for level in range(int(top.max()) + 1 if len(vec) else 0):
        nodes = np.flatnonzero(top >= level).astype(np.int32)
        m = 2 * links if level == 0 else links
        wide = min(3 * links, len(nodes) - 1)
        chosen = np.full((len(nodes), m), -1, np.int32)
        if wide > 0:
            cand = np.empty((len(nodes), wide), np.int32)
            sim = np.empty((len(nodes), wide), np.float32)
            for lo in range(0, len(nodes), 512):
                s = vec[nodes[lo:lo + 512]] @ vec[nodes].T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -3
                near = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
                value = np.take_along_axis(s, near, axis=1)
                order = np.argsort(-value, axis=1, kind="stable")
                cand[lo:lo + 512] = nodes[np.take_along_axis(near, order, axis=1)]
                sim[lo:lo + 512] = np.take_along_axis(value, order, axis=1)
            one_way = _choose(vec, nodes, cand, sim, m // 2)
            # links back, as far as the other end has room; its nearest first
            chosen[:, :one_way.shape[1]] = one_way
            place = np.full(len(vec), -1, np.int64)
            place[nodes] = np.arange(len(nodes))
            a, k = np.nonzero(one_way >= 0)
            b = one_way[a, k]
            near = np.einsum("ij,ij->i", vec[nodes[a]], vec[b])
            for i in np.argsort(-near, kind="stable"):
                row = chosen[place[b[i]]]
                free = int((row >= 0).sum())
                if free < m and not (row == nodes[a[i]]).any():
                    row[free] = nodes[a[i]]
        layers.append((nodes, chosen))
    return layers


def walk(vec: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], query: np.ndarray, width: int) -> list[int]:
    """Nodes found near the query: greedy descent through the upper layers,
    then a best-first search of ``width`` in the lowest one."""
    if not layers:
        return []
    at = int(layers[-1][0][0])
    best = float(vec[at] @ query)
    for nodes, links in reversed(layers[1:]):
        while True:
            near = links[np.searchsorted(nodes, at)]
            near = near[near >= 0]
            if not len(near):
                break
            s = vec[near] @ query
            k = int(s.argmax())
            if s[k] <= best:
                break
            at, best = int(near[k]), float(s[k])
    links = layers[0][1]
    seen = np.zeros(len(vec), bool)
    seen[at] = True
    todo, found = [(-best, at)], [(best, at)]
    while todo:
        s, node = heapq.heappop(todo)
        if -s < found[0][0] and len(found) >= width:
            break
        near = links[node]
        near = near[near >= 0]
        near = near[~seen[near]]
        seen[near] = True
        for v, x in zip((vec[near] @ query).tolist(), near.tolist(), strict=True):
            if len(found) < width:
                heapq.heappush(found, (v, x))
                heapq.heappush(todo, (-v, x))
            elif v > found[0][0]:
                heapq.heapreplace(found, (v, x))
                heapq.heappush(todo, (-v, x))
    return [x for _, x in found]


def _clean(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec) with whole, finite, non-zero vectors of doubles."""
    v = F.col("vec")
    df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return df.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in values]) if len(values) else np.empty((0, 0))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows times a power of two (exact, and the same cosine), so that squares
    neither overflow nor vanish."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: its vectors, the ids of each (the k + 1 smallest), and
    the graph's layers as flat arrays."""
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.withColumn("vec", F.transform("vec", lambda x: x + 0.0)).distinct()  # -0.0 is 0.0
    few = few.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k + 1)
    entries = stored(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    dims = entries.groupBy(F.size("vec").alias("dims")).agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    dealt = entries.withColumn("dims", F.size("vec")).join(dims, "dims").withColumn("shard", F.pmod(F.xxhash64("vec"), "parts").cast("int"))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(least=[int(i[0]) for i in pdf["ids"]]).sort_values("least")
        whole = _matrix(pdf["vec"].tolist())
        layers = build(_unit(whole).astype(np.float32))
        return pd.DataFrame([(int(pdf["dims"].iloc[0]), int(pdf["shard"].iloc[0]), whole.tobytes(), [np.asarray(i, np.int64).tolist() for i in pdf["ids"]],
                              [nodes.tobytes() for nodes, _ in layers], [links.tobytes() for _, links in layers])], columns=_INDEX.names)

    return stored(dealt.groupBy("dims", "shard").applyInPandas(make, _INDEX), "graphs")


_INDEX = StructType([StructField("dims", IntegerType()), StructField("shard", IntegerType()), StructField("vectors", BinaryType()),
                     StructField("ids", ArrayType(ArrayType(LongType()))), StructField("nodes", ArrayType(BinaryType())),
                     StructField("links", ArrayType(BinaryType()))])


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K,
            width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` found nearest to each row of ``queries``
    (both: an id and a vector) by cosine in double precision, a row with the
    query's own id left out.

    Returns (query_id, rank from 1, vec_id, score), nearest first, ties to the
    smaller id.  Equal vectors share an entry but all their rows can be found
    (an entry keeps the k + 1 smallest ids, more than one query can need).

    Vectors that are null, zero or hold null or non-finite components take no
    part, nor does a row with a null id; a query is compared with vectors of
    its own length only; rows repeated in the input count once; other columns
    are not read.  Fewer candidates than ``k`` are all returned, no candidates
    none.  The search is approximate; a shard of at most ``width`` entries is
    searched whole."""
    graphs = index(_clean(vectors, id_col, vec_col), k, shard_rows)
    asked = _clean(queries, id_col, vec_col).distinct()
    n = asked.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    # the stated query set meets all shards block by block
    pairs = graphs.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    shards = graphs.groupBy("dims").agg(F.collect_set("shard").alias("shards"))
    asked = (asked.withColumn("dims", F.size("vec")).withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int"))
             .join(shards, "dims").select("vec_id", "vec", "dims", "block", F.explode("shards").alias("shard")))

    def search(graph: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(graph) and len(block):
            g = graph.iloc[0]
            whole = np.frombuffer(g["vectors"], np.float64).reshape(-1, int(g["dims"]))
            vec = _unit(whole).astype(np.float32)
            whole = _scaled(whole)
            norms = np.sqrt((whole * whole).sum(axis=1))
            layers = []
            for nodes, links in zip(g["nodes"], g["links"], strict=True):
                nodes = np.frombuffer(nodes, np.int32)
                layers.append((nodes, np.frombuffer(links, np.int32).reshape(len(nodes), -1)))
            asked_vec = _scaled(_matrix(block["vec"].tolist()))
            unit = _unit(asked_vec).astype(np.float32)
            for q, (query_id, v) in enumerate(zip(block["vec_id"].tolist(), asked_vec, strict=True)):
                found = np.arange(len(vec)) if len(vec) <= width else np.array(walk(vec, layers, unit[q], width))
                score = (whole[found] * v).sum(axis=1) / (norms[found] * np.sqrt((v * v).sum()))
                rows = [(-s, i) for s, x in zip(score.tolist(), found.tolist(), strict=True) for i in g["ids"][x] if i != query_id]
                out += [(query_id, int(i), -s) for s, i in heapq.nsmallest(k, rows)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = (pairs.groupBy("dims", "shard", "block").cogroup(asked.groupBy("dims", "shard", "block"))
             .applyInPandas(search, StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.distinct().withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_nearest(spark, sf_dir: str) -> DataFrame:
    """Operator 10: rows of `embeddings` whose vec_id is divisible by 50,
    against all rows; 5 nearest by cosine."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
