"""Photo metadata jobs: EXIF GPS → decimal (G3) and photo meta rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import no_null


def _ratio(c: Column) -> Column:
    """'n/d' → n / d (NULL when malformed or d = 0)."""
    num = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.split_part(c, F.lit("/"), F.lit(2)).try_cast("double")
    return F.try_divide(num, den)


def _dms(arr: Column) -> Column:
    d, m, s = (_ratio(F.try_element_at(arr, F.lit(i))) for i in (1, 2, 3))
    return d + ((m * 60) + s) / 3600


def exif_to_decimal(df: DataFrame, lat_col: str = "GPSLatitude", lat_ref: str = "GPSLatitudeRef",
                    lon_col: str = "GPSLongitude", lon_ref: str = "GPSLongitudeRef",
                    dir_col: str = "GPSImgDirection") -> DataFrame:
    """EXIF degree/minute/second rationals + N/S/E/W → signed decimal
    latitude/longitude and the image direction (when its denominator > 0).
    Rows without both coordinates and valid references get NULLs."""
    refs = ["E", "W", "N", "S"]
    ok = (F.col(lat_col).isNotNull() & F.col(lon_col).isNotNull()
          & F.col(lat_ref).isin(refs) & F.col(lon_ref).isin(refs))
    lat = _dms(F.col(lat_col))
    lon = _dms(F.col(lon_col))
    lat = F.when(F.upper(no_null(F.col(lat_ref))) == "S", -lat).otherwise(lat)
    lon = F.when(F.upper(no_null(F.col(lon_ref))) == "W", -lon).otherwise(lon)
    den = F.split_part(F.coalesce(F.col(dir_col), F.lit("")), F.lit("/"), F.lit(2)).try_cast("double")
    direction = F.when(den > 0, _ratio(F.col(dir_col)))
    return (df.withColumn("latitude", F.when(ok, lat)).withColumn("longitude", F.when(ok, lon))
              .withColumn("direction", F.when(ok, direction)))


def photo_meta(df: DataFrame, key: str = "file_id") -> DataFrame:
    """Photo fields → meta rows ``image.*`` (make, model, exposure,
    aperture, shutter, iso, datetime, width, height) and ``geo.*``
    (latitude, longitude, direction from G3).  A missing field is stored as
    'N', as the write path turns false into 'N'."""
    g = exif_to_decimal(df)

    def txt(c: str) -> Column:
        v = no_null(F.col(c))
        return F.when(v != "", v)

    def pos(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.when(v > 0, v.cast("long").cast("string"))

    aperture = F.when(F.col("ApertureValue").isNotNull(), _ratio(F.col("ApertureValue")).cast("string"))
    fields = [("image.make", txt("Make")), ("image.model", txt("Model")), ("image.exposure", txt("ExposureTime")),
              ("image.aperture", aperture), ("image.shutter", txt("ShutterSpeedValue")),
              ("image.iso", pos("ISOSpeedRatings")), ("image.datetime", txt("DateTime")),
              ("image.width", pos("ExifImageWidth")), ("image.height", pos("ExifImageLength")),
              ("geo.latitude", F.col("latitude").cast("string")), ("geo.longitude", F.col("longitude").cast("string")),
              ("geo.direction", F.col("direction").cast("string"))]
    has_geo = F.col("latitude").isNotNull()
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(v, F.lit("N")).alias("value"),
                              (has_geo if k.startswith("geo.") else F.lit(True)).alias("keep")) for k, v in fields])
    out = g.select(F.col(key), F.explode(rows).alias("kv")).filter("kv.keep")
    return out.select(key, "kv.key", "kv.value")
