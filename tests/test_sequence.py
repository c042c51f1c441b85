import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators.sequence import next_in_sequence


def test_next_in_sequence_matches_lead_with_a_hot_key(spark):
    rnd = random.Random(2)
    rows = [(0 if rnd.random() < 0.5 else rnd.randint(1, 30), i, rnd.randint(0, 9), f"s{i % 4}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, o int, v int, s string")
    got = next_in_sequence(df, "k", "o", ["v", "s"], partitions=7)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("*", F.lead("v").over(w).alias("next_v"), F.lead("s").over(w).alias("next_s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sum_matches_window_with_a_hot_key(spark):
    from tessera.operators.sequence import running_sum

    rnd = random.Random(4)
    rows = [(0 if rnd.random() < 0.6 else rnd.randint(1, 40), i, rnd.randint(0, 50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, o int, v long")
    got = running_sum(df, "k", ["o"], "v", "cs", partitions=9)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w).alias("cs"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_running_sum_with_null_keys(spark):
    from tessera.operators.sequence import running_sum

    rows = [(None, i, 1) for i in range(200)] + [(1, i, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, o int, v long")
    got = {((r.k if r.k is not None else -1), r.o): r.cs
           for r in running_sum(df, "k", ["o"], "v", "cs", partitions=6).collect()}
    assert all(got[(-1, i)] == i + 1 for i in range(200))
    assert all(got[(1, i)] == 2 * (i + 1) for i in range(50))
    nxt = {((r.k if r.k is not None else -1), r.o): r.next_v
           for r in next_in_sequence(df, "k", "o", ["v"], partitions=6).collect()}
    assert all(nxt[(-1, i)] == 1 for i in range(199)) and nxt[(-1, 199)] is None
