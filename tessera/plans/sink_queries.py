"""Source, sink and image-metadata queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, HOME_URL, fixture, table, with_fixtures
from tessera.operators import images as I
from tessera.plans.oracle_sql import q
from tessera.plans.registry import register
from tessera.plans.request_queries import LOCALES
from tessera.sources import files as FS
from tessera.sources import sinks as SK

DEFAULT_LANG = "en-us"
PATH_SQL = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+(/[^?#]*)', 1), ''), '/')"


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]+(/[^?#]*)", 1), F.lit("")), F.lit("/"))
    return p.select("page_id", path.alias("path"))


def _sitemap_sql() -> str:
    tab = "    "
    suffix = f"CASE WHEN length(path) > 1 THEN path ELSE '' END"
    parts = [q(f"{tab}<url>\r\n{tab * 2}<loc>{HOME_URL}"), suffix, q("</loc>\r\n")]
    for lang in LOCALES:
        rel = "canonical" if lang == DEFAULT_LANG else "alternate"
        prefix = "" if lang == DEFAULT_LANG else "/" + lang
        parts += [q(f'{tab * 2}<xhtml:link rel="{rel}" hreflang="{SK._hreflang(lang)}" href="{HOME_URL}{prefix}'), suffix,
                  q('"/>\r\n')]
    parts += [q(f"{tab * 2}<lastmod>"), f"strftime(date_trunc('hour', TIMESTAMP '{AS_OF}'), '%Y-%m-%dT%H:%M:%SZ')",
              q(f"</lastmod>\r\n{tab}</url>\r\n")]
    return (f"SELECT page_id, path, " + " || ".join(parts) + " AS sitemap_item "
            f"FROM (SELECT page_id, {PATH_SQL} AS path FROM pages) p")


@register("s5_sitemap_rows", oracle=_sitemap_sql())
def s5_sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap item of every page path in every site language."""
    return SK.sitemap_rows(_page_paths(spark, sf_dir), LOCALES, DEFAULT_LANG, HOME_URL, AS_OF)


def _hreflang_sql() -> str:
    p = f"regexp_replace({PATH_SQL}, '^/+', '')"
    rows = [f"SELECT page_id, 0 AS ord, 'canonical' AS rel, NULL AS hreflang, NULL AS type, '{HOME_URL}/' || {p} AS href FROM pages",
            f"SELECT page_id, 1, 'alternate', 'x-default', NULL, '{HOME_URL}/' || {p} FROM pages"]
    for i, lang in enumerate(LOCALES):
        pre = "" if lang == DEFAULT_LANG else lang + "/"
        rows.append(f"SELECT page_id, {10 + i}, 'alternate', '{lang}', NULL, '{HOME_URL}/{pre}' || {p} FROM pages")
        rows.append(f"SELECT page_id, {100 + i}, 'alternate', '{lang}', 'application/rss+xml', '{HOME_URL}/{pre}rss.xml' FROM pages")
    return "\nUNION ALL\n".join(rows)


@register("s6_hreflang_rows", oracle=_hreflang_sql())
def s6_hreflang_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, x-default, language and RSS link rows of every page."""
    out = SK.hreflang_rows(_page_paths(spark, sf_dir), LOCALES, DEFAULT_LANG, HOME_URL)
    return out.select("page_id", "ord", "rel", "hreflang", "type", "href")


def _rss_sql() -> str:
    uuid = "lower(trim(guid) || '-' || translate(trim(locale), '-_', ''))"
    text = q(SK.RSS_ITEM_TEMPLATE)
    for token, value in (("[TITLE]", "title"), ("[AUTHOR]", "author"), ("[URL]", "url"), ("[SUMMARY]", "summary"),
                         ("[CONTENT]", "html")):
        text = f"replace({text}, {q(token)}, trim(coalesce({value}, '')))"
    text = f"replace({text}, '[UUID]', {uuid})"
    text = f"replace({text}, '[PUBLISH_DTS]', strftime(publish_at, '%a, %d %b %Y %H:%M:%S +0000'))"
    text = f"replace({text}, '[UPDATED_DTS]', strftime(updated_at, '%a, %d %b %Y %H:%M:%S +0000'))"
    return with_fixtures("rss_source") + f"SELECT doc_id, {uuid} AS item_id, chr(13) || chr(10) || {text} AS rss_item FROM rss_source"


@register("s7_rss_items", oracle=_rss_sql())
def s7_rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS item of every document (whole text as content)."""
    return SK.rss_items(fixture(spark, sf_dir, "rss_source")).select("doc_id", "item_id", "rss_item")


_ENVELOPE_ERRORS = ("CASE WHEN display_name IS NULL THEN ['Name missing', 'Check profile', 'Name missing', 'Name missing'] "
                    "WHEN type = 'account.expired' THEN ['Account expired'] ELSE [] END")


@register("s8_to_envelope", oracle=with_fixtures("account") + f"""
, e AS (SELECT id, login, type, {_ENVELOPE_ERRORS} AS errs FROM account),
m AS (SELECT *, errs[-1] AS last, list_distinct(list_filter(errs, lambda x: x <> errs[-1])) AS more FROM e)
SELECT CASE WHEN len(errs) = 0 THEN '{{"meta":{{"code":200}},"data":' || to_json(struct_pack(id := id, login := login, type := type)) || '}}'
            WHEN len(errs) > 1 AND len(more) > 0
            THEN '{{"meta":{{"code":200,"text":' || to_json(last) || ',"more":' || to_json(list_sort(more)) || '}},"data":'
                 || to_json(struct_pack(id := id, login := login, type := type)) || '}}'
            ELSE '{{"meta":{{"code":200,"text":' || to_json(last) || '}},"data":'
                 || to_json(struct_pack(id := id, login := login, type := type)) || '}}' END AS envelope
  FROM m
""")
def s8_to_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON envelope (code, last error, earlier distinct errors, data) of every account."""
    a = fixture(spark, sf_dir, "account")
    errs = (F.when(F.col("display_name").isNull(),
                   F.array(*[F.lit(x) for x in ("Name missing", "Check profile", "Name missing", "Name missing")]))
            .when(F.col("type") == "account.expired", F.array(F.lit("Account expired")))
            .otherwise(F.array().cast("array<string>")))
    df = a.select("id", "login", "type", errs.alias("errors"))
    return SK.to_envelope(df, 200, "errors")


@register("s9_to_xml_rows", oracle="""
SELECT '<nation id="' || n_nationkey || '">' || chr(10) || '    <name>' || replace(replace(n_name, '&', '&amp;'), '<', '&lt;') || '</name>' || chr(10)
       || '    <region>' || n_regionkey || '</region>' || chr(10) || '    <is_asia>' || CASE WHEN n_regionkey = 2 THEN 'true' ELSE 'false' END
       || '</is_asia>' || chr(10) || '</nation>' AS xml
  FROM nation
""")
def s9_to_xml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation row as an XML element (key as attribute)."""
    n = table(spark, sf_dir, "nation")
    df = n.select(F.col("n_nationkey").alias("@id"), F.col("n_name").alias("name"),
                  F.col("n_regionkey").alias("region"), (F.col("n_regionkey") == 2).alias("is_asia"))
    return SK.to_xml_rows(df, "nation")


@register("s10_wire_form", oracle=with_fixtures("tokens") + """
SELECT id, guid, account_id, CAST(floor(epoch(created_at)) AS BIGINT) AS created_at,
       CAST(floor(epoch(updated_at)) AS BIGINT) AS updated_at, CASE WHEN is_deleted THEN 'Y' ELSE 'N' END AS is_deleted
  FROM tokens
""")
def s10_wire_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API wire form (Y/N, epoch seconds) of every token row."""
    return SK.wire_form(fixture(spark, sf_dir, "tokens"))


@register("s3_crawl_files")
def s3_crawl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: catalogue of the table files themselves (name, size, SHA-256); rows-only."""
    return FS.crawl_files(spark, sf_dir, "*.parquet").select("name", "extension", "bytes", "sha256")


def _exif(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixture(spark, sf_dir, "exif_row")
    return e.select("file_id", F.array("lat_d", "lat_m", "lat_s").alias("GPSLatitude"),
                    F.col("lat_ref").alias("GPSLatitudeRef"), F.array("lon_d", "lon_m", "lon_s").alias("GPSLongitude"),
                    F.col("lon_ref").alias("GPSLongitudeRef"), F.col("direction").alias("GPSImgDirection"),
                    F.col("make").alias("Make"), F.col("model").alias("Model"), F.col("exposure").alias("ExposureTime"),
                    F.col("aperture").alias("ApertureValue"), F.col("shutter").alias("ShutterSpeedValue"),
                    F.col("iso").alias("ISOSpeedRatings"), F.col("taken").alias("DateTime"),
                    F.col("width").alias("ExifImageWidth"), F.col("height").alias("ExifImageLength"))


def _ratio_sql(x: str) -> str:
    return f"(TRY_CAST(split_part({x}, '/', 1) AS DOUBLE) / nullif(TRY_CAST(split_part({x}, '/', 2) AS DOUBLE), 0))"


_G3_CTE = with_fixtures("exif_row") + f"""
, g AS (SELECT *, lat_d IS NOT NULL AND lon_d IS NOT NULL AND lat_ref IN ('E', 'W', 'N', 'S') AND lon_ref IN ('E', 'W', 'N', 'S') AS ok,
               {_ratio_sql('lat_d')} + (({_ratio_sql('lat_m')} * 60) + {_ratio_sql('lat_s')}) / 3600 AS la,
               {_ratio_sql('lon_d')} + (({_ratio_sql('lon_m')} * 60) + {_ratio_sql('lon_s')}) / 3600 AS lo
          FROM exif_row),
h AS (SELECT *, CASE WHEN ok THEN CASE WHEN upper(lat_ref) = 'S' THEN -la ELSE la END END AS latitude,
               CASE WHEN ok THEN CASE WHEN upper(lon_ref) = 'W' THEN -lo ELSE lo END END AS longitude,
               CASE WHEN ok AND TRY_CAST(split_part(coalesce(direction, ''), '/', 2) AS DOUBLE) > 0 THEN {_ratio_sql('direction')} END AS dir
          FROM g)
"""


@register("g3_exif_to_decimal", oracle=_G3_CTE + """
SELECT file_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, round(dir, 6) AS direction FROM h
""")
def g3_exif_to_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal coordinates and direction from the EXIF GPS fields of every photo row."""
    out = I.exif_to_decimal(_exif(spark, sf_dir))
    return out.select("file_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"),
                      F.round("direction", 6).alias("direction"))


def _txt(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN trim({c}) END"


def _pos(c: str) -> str:
    return f"CASE WHEN TRY_CAST({c} AS DOUBLE) > 0 THEN CAST(CAST(trunc(TRY_CAST({c} AS DOUBLE)) AS BIGINT) AS VARCHAR) END"


@register("g5_photo_meta", oracle=_G3_CTE + "\n UNION ALL\n".join(
    f"SELECT file_id, {q(k)} AS key, coalesce({v}, 'N') AS value FROM h" + (" WHERE latitude IS NOT NULL" if k.startswith("geo.") else "")
    for k, v in [("image.make", _txt("make")), ("image.model", _txt("model")), ("image.exposure", _txt("exposure")),
                 ("image.aperture", f"CASE WHEN aperture IS NOT NULL THEN CAST({_ratio_sql('aperture')} AS VARCHAR) END"),
                 ("image.shutter", _txt("shutter")), ("image.iso", _pos("iso")), ("image.datetime", _txt("taken")),
                 ("image.width", _pos("width")), ("image.height", _pos("height")),
                 ("geo.latitude", "CAST(latitude AS VARCHAR)"), ("geo.longitude", "CAST(longitude AS VARCHAR)"),
                 ("geo.direction", "CAST(dir AS VARCHAR)")]))
def g5_photo_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5 (+G3): image.* and geo.* meta rows of every photo row."""
    return I.photo_meta(_exif(spark, sf_dir))
