import math

from pyspark.sql import functions as F

from tessera.functions.keys import decode_key, encode_key, key_is_valid
from tessera.operators import geo as G


def _score(spark, km, seconds, hints):
    df = spark.createDataFrame([(float(km), float(seconds), float(hints))], "km double, s double, h double")
    return df.select(G.score_expr(F.col("km"), F.col("s"), F.col("h")).alias("x")).first()[0]


def test_score_distance_boundaries(spark):
    # rule v1 as published: 15*floor(km/10), >750 -> 800, >999 -> 1000
    assert _score(spark, 0, 0, 0) == 1000
    assert _score(spark, 9.99, 0, 0) == 1000
    assert _score(spark, 10, 0, 0) == 985
    assert _score(spark, 669, 0, 0) == 10
    assert _score(spark, 670, 0, 0) == 0
    assert _score(spark, 700, 0, 0) == 0
    assert _score(spark, 750, 0, 0) == 0
    assert _score(spark, 750.1, 0, 0) == 200
    assert _score(spark, 800, 0, 0) == 200
    assert _score(spark, 999, 0, 0) == 200
    assert _score(spark, 999.1, 0, 0) == 0


def test_score_time_and_hints(spark):
    assert _score(spark, 0, 59, 0) == 1000        # 9.83 < 10 -> no deduction
    assert _score(spark, 0, 60, 0) == 990         # exactly 10
    assert _score(spark, 0, 61, 0) == 989         # 10.1666 not floored -> floor(989.83)
    assert _score(spark, 0, 600, 0) == 900        # capped at 100
    assert _score(spark, 0, 0, 3) == 985
    assert _score(spark, 0, 0, 50) == 900         # capped at 100
    assert _score(spark, 0, -1, -1) == 1000       # cleaned inputs (-1) deduct nothing


def test_distance_known_value(spark):
    # Tokyo -> Osaka, about 396 km
    df = spark.createDataFrame([(35.6812, 139.7671, 34.7025, 135.4959)], "a double, b double, c double, d double")
    km = df.select(G.distance_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert math.isclose(km, 403.0, rel_tol=0.02)


def test_key_round_trip(spark):
    ids = [1, 2, 61, 62, 63, 3843, 3844, 238327, 123456789, 62 ** 6 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "n long")
    df = df.withColumn("k", encode_key(F.col("n")))
    out = df.select("n", "k", decode_key(F.col("k")).alias("d"), key_is_valid(F.col("k")).alias("v")).collect()
    for r in out:
        assert len(r.k) == 6 and r.d == r.n and r.v


def test_key_invalid(spark):
    df = spark.createDataFrame([("",), ("abc",), ("!!!!!!",), (None,)], "k string")
    out = df.select(decode_key(F.col("k")).alias("d")).collect()
    assert [r.d for r in out] == [0, 0, 0, 0]
    z = spark.createDataFrame([(0,), (-5,)], "n long").select(encode_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in z] == ["", ""]
