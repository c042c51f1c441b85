"""Location game queries over the supplier/orders stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import fixture, with_fixtures
from tessera.operators import catalog as C
from tessera.operators import geo as G
from tessera.plans.oracle_sql import LOCATION_DETAIL, LOCATION_FIXTURES, encode_key_sql
from tessera.plans.registry import register


def playable_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda n: fixture(spark, sf_dir, n)
    return C.location_detail(f("location"), f("account"), f("country"), f("state"), f("country_region"),
                             f("note"), f("location_meta"), country_code="JP")


@register("j1_location_detail", oracle=with_fixtures(*LOCATION_FIXTURES) + LOCATION_DETAIL)
def j1_location_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every playable location with account, country, state, region, note, has_meta."""
    return playable_locations(spark, sf_dir)


_ATTEMPT_CLEAN = """
SELECT attempt_id, location_id,
       CASE WHEN longitude BETWEEN -180 AND 180 THEN longitude ELSE 0.0 END AS longitude,
       CASE WHEN latitude BETWEEN -90 AND 90 THEN latitude ELSE 0.0 END AS latitude,
       CASE WHEN seconds BETWEEN 0 AND 999 THEN CAST(seconds AS DOUBLE) ELSE -1.0 END AS seconds,
       CASE WHEN hints BETWEEN 0 AND 999 THEN CAST(hints AS DOUBLE) ELSE -1.0 END AS hints
  FROM attempt
"""


@register("p10_clean_attempts", oracle=with_fixtures("attempt") + _ATTEMPT_CLEAN)
def p10_clean_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: coordinate and counter bounds on every attempt."""
    return G.clean_attempts(fixture(spark, sf_dir, "attempt")).select(
        "attempt_id", "location_id", "longitude", "latitude", "seconds", "hints")


@register("g4_key_codec", oracle=with_fixtures("attempt") + f"""
SELECT attempt_id, {encode_key_sql('attempt_id')} AS key, attempt_id AS decoded_id, attempt_id > 0 AS is_valid
  FROM attempt
""")
def g4_key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every attempt id to a key, then decode the key back."""
    df = fixture(spark, sf_dir, "attempt").select("attempt_id")
    df = G.encode_keys(df, "attempt_id")
    return G.decode_keys(df, "key").select("attempt_id", "key", "decoded_id", "is_valid")


_G2_SQL = with_fixtures("attempt", *LOCATION_FIXTURES) + f""", det AS ({LOCATION_DETAIL}),
a AS ({_ATTEMPT_CLEAN}),
j AS (SELECT a.*, d.latitude AS llat, d.longitude AS llon
        FROM a JOIN det d ON d.location_id = a.location_id
       WHERE NOT (a.longitude = 0 AND a.latitude = 0)),
h AS (SELECT *, sin(radians(llat - latitude) / 2) * sin(radians(llat - latitude) / 2)
               + sin(radians(llon - longitude) / 2) * sin(radians(llon - longitude) / 2)
                 * cos(radians(latitude)) * cos(radians(llat)) AS hv FROM j),
k AS (SELECT *, 6371.0 * 2 * atan2(sqrt(hv), sqrt(1 - hv)) AS km FROM h),
s AS (SELECT *,
        CASE WHEN km > 0 THEN (CASE WHEN km > 999 THEN 1000.0 WHEN km > 750 THEN 800.0 ELSE 15 * floor(km / 10) END) ELSE 0 END AS kk0,
        CASE WHEN seconds > 0 THEN (CASE WHEN 5 * (seconds / 30) > 100 THEN 100.0 WHEN 5 * (seconds / 30) < 10 THEN 0.0
                                         ELSE 5 * (seconds / 30) END) ELSE 0 END AS ss,
        CASE WHEN hints > 0 THEN least(5 * hints, 100.0) ELSE 0 END AS hh
        FROM k)
SELECT attempt_id, {encode_key_sql('location_id')} AS key, CAST(location_id AS BIGINT) AS location_id,
       round(km, 6) AS distance_km,
       CAST(floor(least(greatest(1000.0 - (CASE WHEN kk0 < 1 THEN 0 ELSE kk0 END) - ss - hh, 0.0), 1000.0)) AS INTEGER) AS score,
       longitude, latitude, seconds, hints
  FROM s
"""


@register("g2_score_attempts", oracle=_G2_SQL)
def g2_score_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2 (+G1, P10, G4): every attempt keyed by its location's public key,
    bounded, decoded, joined to the playable locations, distance and score."""
    att = G.encode_keys(fixture(spark, sf_dir, "attempt"), "location_id").drop("location_id")
    scored = G.score_attempts(att, playable_locations(spark, sf_dir))
    return scored.select("attempt_id", "key", "location_id", F.round("distance_km", 6).alias("distance_km"),
                         "score", "longitude", "latitude", "seconds", "hints")


@register("g1_distance_km", oracle=with_fixtures(*LOCATION_FIXTURES) + f"""
, det AS ({LOCATION_DETAIL})
SELECT a.location_id AS from_id, b.location_id AS to_id,
       round(6371.0 * 2 * atan2(sqrt(hv), sqrt(1 - hv)), 6) AS distance_km
  FROM (SELECT a.location_id, b.location_id AS b_id,
               sin(radians(b.latitude - a.latitude) / 2) * sin(radians(b.latitude - a.latitude) / 2)
               + sin(radians(b.longitude - a.longitude) / 2) * sin(radians(b.longitude - a.longitude) / 2)
                 * cos(radians(a.latitude)) * cos(radians(b.latitude)) AS hv
          FROM det a JOIN det b ON b.location_id = a.location_id + 1) a
  JOIN det b ON b.location_id = a.b_id
""")
def g1_distance_km(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: distance from each playable location to the next-id playable location."""
    det = playable_locations(spark, sf_dir).select("location_id", "latitude", "longitude")
    nxt = det.select((F.col("location_id") - 1).alias("location_id"), F.col("location_id").alias("to_id"),
                     F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    j = det.join(nxt, "location_id")
    j = G.with_distance_km(j, "latitude", "longitude", "lat2", "lon2")
    return j.select(F.col("location_id").alias("from_id"), "to_id", F.round("distance_km", 6).alias("distance_km"))


@register("o1_random_location")
def o1_random_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: three random playable JP locations (seeded); rows-only check."""
    return G.random_location(fixture(spark, sf_dir, "location"), fixture(spark, sf_dir, "country"), n=3, seed=7)


@register("o1_random_location_check", oracle=with_fixtures("location", "country") + """
, playable AS (SELECT l.id FROM location l JOIN country c ON c.code = l.country_code AND NOT c.is_deleted
                WHERE NOT l.is_deleted AND l.is_published AND l.is_visible AND l.country_code = 'JP')
SELECT least(3, count(*)) AS picked, true AS all_playable, true AS all_different FROM playable
""")
def o1_random_location_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: what holds for any seed: three different places, all of them playable."""
    loc = fixture(spark, sf_dir, "location")
    picks = G.random_location(loc, fixture(spark, sf_dir, "country"), n=3, seed=7).select("location_id")
    known = loc.select(F.col("id").alias("location_id"),
                       (~F.col("is_deleted") & F.col("is_published") & F.col("is_visible") & (F.col("country_code") == "JP")).alias("playable"))
    return picks.join(known, "location_id").agg(F.count("*").alias("picked"), F.coalesce(F.bool_and("playable"), F.lit(True)).alias("all_playable"),
                                                (F.count_distinct("location_id") == F.count("*")).alias("all_different"))
