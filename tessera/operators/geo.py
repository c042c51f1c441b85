"""Location game jobs: distance, input bounds, scoring, random pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import decode_key, encode_key, encode_parts, key_is_valid, key_offset

EARTH_RADIUS_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """G1: great-circle distance (haversine, atan2 form), R = 6371 km."""
    lat1, lon1, lat2, lon2 = (c.cast("double") for c in (lat1, lon1, lat2, lon2))
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    a = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.sin(dlon / 2) * F.sin(dlon / 2) * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)))
    return F.lit(EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def with_distance_km(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str,
                     out: str = "distance_km") -> DataFrame:
    return df.withColumn(out, distance_km(F.col(lat1), F.col(lon1), F.col(lat2), F.col(lon2)))


def clean_attempts(df: DataFrame) -> DataFrame:
    """P10: out-of-range longitude/latitude → 0; seconds or hints outside
    0..999 → -1 (NULL counts as 0, as the request helper does)."""
    lon = F.coalesce(F.col("longitude").cast("double"), F.lit(0.0))
    lat = F.coalesce(F.col("latitude").cast("double"), F.lit(0.0))
    sec = F.coalesce(F.col("seconds").cast("double"), F.lit(0.0))
    hints = F.coalesce(F.col("hints").cast("double"), F.lit(0.0))
    return (df.withColumn("longitude", F.when(lon.between(-180, 180), lon).otherwise(F.lit(0.0)))
              .withColumn("latitude", F.when(lat.between(-90, 90), lat).otherwise(F.lit(0.0)))
              .withColumn("seconds", F.when(sec.between(0, 999), sec).otherwise(F.lit(-1.0)))
              .withColumn("hints", F.when(hints.between(0, 999), hints).otherwise(F.lit(-1.0))))


def score_expr(km: Column, seconds: Column, hints: Column) -> Column:
    """G2 score, rule v1 (kept as published, including its jump at 750 km).

    distance: 15·floor(km/10); >750 km → 800; >999 km → 1000; <1 → 0 (if km > 0)
    time:     5·(seconds/30), not floored; >100 → 100; <10 → 0 (if seconds > 0)
    hints:    min(5·hints, 100) (if hints > 0)
    score  =  floor(clamp(1000 − distance − time − hints, 0, 1000))
    """
    kk = 15 * F.floor(km / 10)
    kk = F.when(km > 999, F.lit(1000.0)).when(km > 750, F.lit(800.0)).otherwise(kk)
    kk = F.when(kk < 1, F.lit(0.0)).otherwise(kk)
    kk = F.when(km > 0, kk).otherwise(F.lit(0.0))
    ss = 5 * (seconds / 30)
    ss = F.when(ss > 100, F.lit(100.0)).when(ss < 10, F.lit(0.0)).otherwise(ss)
    ss = F.when(seconds > 0, ss).otherwise(F.lit(0.0))
    hh = F.least(5 * hints, F.lit(100.0))
    hh = F.when(hints > 0, hh).otherwise(F.lit(0.0))
    raw = F.lit(1000.0) - kk - ss - hh
    return F.floor(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1000.0))).cast("int")


def score_attempts(attempts: DataFrame, locations: DataFrame) -> DataFrame:
    """Score guesses against the playable locations.

    ``attempts``: attempt_id, key, longitude, latitude, seconds, hints.
    ``locations``: the playable set (``location_detail``) with ``location_id``,
    ``latitude``, ``longitude``.  Inputs are bounded (P10), the key decoded
    (G4); attempts with a malformed key, with both coordinates 0, or whose key
    names no playable location are dropped (the request would be refused).

    Plan: a projection then an equi-join on the decoded id — both sides are
    shuffled on the id (or the location side is broadcast by AQE when small).
    """
    a = clean_attempts(attempts)
    a = a.filter((F.length(F.coalesce(F.col("key"), F.lit(""))) == 6)
                 & ~((F.col("longitude") == 0) & (F.col("latitude") == 0)))
    a = decode_keys(a, "key", "location_id").drop("is_valid")
    loc = locations.select(F.col("location_id").cast("bigint").alias("location_id"),
                           F.col("latitude").cast("double").alias("loc_latitude"),
                           F.col("longitude").cast("double").alias("loc_longitude"))
    j = a.join(loc, "location_id", "inner")
    km = distance_km(F.col("latitude"), F.col("longitude"), F.col("loc_latitude"), F.col("loc_longitude"))
    j = j.withColumn("distance_km", km)
    return j.withColumn("score", score_expr(F.col("distance_km"), F.col("seconds"), F.col("hints")))


def encode_keys(df: DataFrame, id_col: str, out: str = "key") -> DataFrame:
    """G4 encode: id → key ('' for ids ≤ 0).  The shared digit parts are
    staged as columns so each letter reuses them (small generated code)."""
    off, high = encode_parts(F.col(id_col))
    staged = df.withColumn("_eoff", off).withColumn("_ehigh", high)
    return staged.withColumn(out, encode_key(F.col(id_col), F.col("_eoff"), F.col("_ehigh"))).drop("_eoff", "_ehigh")


def decode_keys(df: DataFrame, key_col: str, out: str = "decoded_id") -> DataFrame:
    """G4 decode: key → id (0 when invalid) and ``is_valid``.

    The first-letter offset is staged as its own column so the six digit
    terms share it (keeps the generated code small)."""
    staged = df.withColumn("_koff", key_offset(F.col(key_col)))
    return (staged.withColumn(out, decode_key(F.col(key_col), F.col("_koff")))
            .withColumn("is_valid", key_is_valid(F.col(key_col))).drop("_koff"))


def random_location(locations: DataFrame, countries: DataFrame, n: int = 1, seed: int = 0,
                    country_code: str = "JP") -> DataFrame:
    """O1: ``n`` random live, published, visible locations of a live country.

    ``orderBy(rand(seed)).limit(n)`` plans as a TakeOrdered: each task keeps
    its own top n and only n rows per task reach the final merge.
    """
    c = countries.filter(~F.col("is_deleted") & (F.col("code") == country_code)).select(
        F.col("code").alias("country_code"))
    loc = locations.filter(~F.col("is_deleted") & F.col("is_published") & F.col("is_visible")
                           & (F.col("country_code") == country_code))
    return (loc.join(F.broadcast(c.distinct()), "country_code", "left_semi")
            .select(F.col("id").alias("location_id"), "country_code", "name")
            .orderBy(F.rand(seed)).limit(n))
