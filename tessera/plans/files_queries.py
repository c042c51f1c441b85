"""File catalogue queries over the `part` stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import QUOTA_BYTES, fixture, table, with_fixtures
from tessera.operators import files as FL
from tessera.operators.paging import build_page_index, read_page
from tessera.plans.registry import register
from tessera.session import scratch_path


def _sql_map(table: dict[str, str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN '{v}'" for k, v in table.items()) + " END"


@register("a7_quota_remaining", oracle=with_fixtures("file", "account") + f"""
SELECT a.id AS account_id, {QUOTA_BYTES} AS upload_limit, coalesce(u.upload_bytes, 0) AS upload_bytes,
       greatest({QUOTA_BYTES} - coalesce(u.upload_bytes, 0), 0) AS bucket_remain
  FROM account a LEFT JOIN (SELECT account_id, sum(bytes) AS upload_bytes FROM file WHERE NOT is_deleted
                             GROUP BY account_id) u ON u.account_id = a.id
""")
def a7_quota_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage left for every account (limit 400,000 bytes)."""
    limits = fixture(spark, sf_dir, "account").select(F.col("id").alias("account_id"),
                                                      F.lit(QUOTA_BYTES).alias("upload_limit"))
    return FL.quota_remaining(fixture(spark, sf_dir, "file"), limits).select(
        "account_id", "upload_limit", F.col("upload_bytes").cast("long").alias("upload_bytes"),
        F.col("bucket_remain").cast("long").alias("bucket_remain"))


_W1 = with_fixtures("file_req") + f"""
, o AS (SELECT id, account_id, CAST(bytes AS BIGINT) AS bytes,
               row_number() OVER (PARTITION BY account_id ORDER BY arrival, id) AS rn FROM file_req),
r AS (SELECT id, account_id, rn, bytes > 0 AND bytes <= {QUOTA_BYTES} AS accepted,
             CAST(CASE WHEN bytes > 0 AND bytes <= {QUOTA_BYTES} THEN {QUOTA_BYTES} - bytes ELSE {QUOTA_BYTES} END AS BIGINT) AS remaining
        FROM o WHERE rn = 1
      UNION ALL
      SELECT o.id, o.account_id, o.rn, o.bytes > 0 AND o.bytes <= r.remaining,
             CASE WHEN o.bytes > 0 AND o.bytes <= r.remaining THEN r.remaining - o.bytes ELSE r.remaining END
        FROM r JOIN o ON o.account_id = r.account_id AND o.rn = r.rn + 1)
SELECT id, account_id, accepted, remaining FROM r
"""
_W1 = _W1.replace("WITH ", "WITH RECURSIVE ", 1)


@register("w1_admit_uploads", oracle=_W1)
def w1_admit_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy upload admission for every upload request, 400,000-byte quota per account."""
    up = fixture(spark, sf_dir, "file_req")
    quotas = up.select("account_id").distinct().withColumn("quota", F.lit(QUOTA_BYTES))
    return FL.admit_uploads(up, quotas)


@register("p9_page", oracle=with_fixtures("file_req") + """
SELECT id, account_id, bytes FROM file_req ORDER BY bytes DESC, id LIMIT 250 OFFSET 500
""")
def p9_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page (page 2) of uploads by size, requested count 400 → capped at 250."""
    up = fixture(spark, sf_dir, "file_req").select("id", "account_id", "bytes")
    return FL.page(up, [F.col("bytes").desc(), F.col("id")], count=400, page_no=2, cap=250, default=25)


@register("p9_deep_page", oracle="""
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem
 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 250 OFFSET 5000
""")
def p9_deep_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far into all line items by price, read through a page index."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"))
    path = scratch_path(spark, f"p9-{uuid.uuid4().hex}")
    build_page_index(rows, [F.col("price").desc(), F.col("l_orderkey"), F.col("l_linenumber")], path)
    return read_page(spark, path, count=400, page_no=20, cap=250, default=25)


_J17_EXT = "trim(CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE '' END)"
_J17 = with_fixtures("file_upload") + f"""
, e AS (SELECT id, name, given_mime,
               CASE WHEN {_J17_EXT} = '' THEN coalesce({_sql_map(FL.MIME_TO_EXT, 'lower(trim(given_mime))')}, '')
                    ELSE {_J17_EXT} END AS extension FROM file_upload),
m AS (SELECT *, coalesce(nullif(trim(given_mime), ''), {_sql_map(FL.EXT_TO_MIME, 'lower(extension)')}, '{FL.DEFAULT_MIME}') AS mimetype FROM e)
SELECT id, name, extension, mimetype,
       CASE WHEN split_part(lower(mimetype), '/', 1) = 'audio' THEN 'file-audio'
            WHEN split_part(lower(mimetype), '/', 1) = 'image' THEN 'file-image'
            WHEN split_part(lower(mimetype), '/', 1) = 'video' THEN 'file-video'
            WHEN strpos(lower(mimetype), 'officedocument.spreadsheetml') > 1 OR strpos(lower(mimetype), 'vnd.ms-excel') > 1
              OR strpos(lower(mimetype), 'officedocument.presentationml') > 1 OR strpos(lower(mimetype), 'vnd.ms-powerpoint') > 1
              OR strpos(lower(mimetype), 'officedocument.wordprocessingml') > 1 OR strpos(lower(mimetype), 'vnd.ms-word') > 1
              THEN 'file-powerpoint'
            WHEN lower(mimetype) = 'application/zip' THEN 'file-zipper'
            WHEN lower(mimetype) = 'application/pdf' THEN 'file-pdf'
            WHEN lower(mimetype) IN ('application/javascript', 'application/xhtml+xml', 'application/xslt+xm',
                                     'application/json', 'application/xml') THEN 'file-code'
            ELSE 'file-lines' END AS icon
  FROM m
"""


@register("j17_with_mime", oracle=_J17)
def j17_with_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, MIME type and icon for every upload."""
    df = FL.with_mime(fixture(spark, sf_dir, "file_upload"), "name", "given_mime")
    return df.select("id", "name", "extension", "mimetype", "icon")


@register("p11_valid_uploads", oracle=_J17.replace("SELECT id, name, extension, mimetype,\n", "SELECT id, mimetype,\n", 1)
          .split("CASE WHEN split_part")[0].rstrip().rstrip(",") + f"""
       , mimetype IN ({", ".join(f"'{v}'" for v in FL.VALID_UPLOAD_TYPES)}) AS is_valid_upload,
       lower(mimetype) IN ({", ".join(f"'{v}'" for v in FL.RESIZABLE_TYPES)}) AS is_resizable
  FROM m
""")
def p11_valid_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11 (+J17): allow-list and resizable flags for every upload."""
    df = FL.with_mime(fixture(spark, sf_dir, "file_upload"), "name", "given_mime")
    return FL.valid_uploads(df).select("id", "mimetype", "is_valid_upload", "is_resizable")


@register("p12_acl_flags", oracle=with_fixtures("file_upload") + """
SELECT id, access, access <> 'private' AS is_public, access <> 'public-read-write' AS is_readonly FROM (
  SELECT id, CASE WHEN length(trim(coalesce(password, ''))) > 0 THEN 'private'
                  WHEN lower(trim(coalesce(acl, ''))) IN ('private', 'public-read', 'public-read-write')
                  THEN lower(trim(coalesce(acl, ''))) ELSE 'private' END AS access
    FROM file_upload) x
""")
def p12_acl_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access list and flags for every upload (password forces private)."""
    return FL.acl_flags(fixture(spark, sf_dir, "file_upload"), "acl", "password").select(
        "id", "access", "is_public", "is_readonly")


@register("g6_plan_renditions", oracle=with_fixtures("file_upload") + f"""
, x AS (SELECT *, {_J17_EXT} AS ext, NOT is_animated AND width > 960 AS make_medium,
               NOT is_animated AND width > 480 AS make_thumb, length(trim(coalesce(password, ''))) > 0 AS locked
          FROM file_upload)
SELECT id, make_medium, make_thumb,
       CASE WHEN make_medium AND NOT locked AND ext <> '' THEN replace(name, '.' || ext, '_medium.' || ext) END AS medium_name,
       CASE WHEN make_thumb AND NOT locked AND ext <> '' THEN replace(name, '.' || ext, '_thumb.' || ext) END AS thumb_name,
       replace(replace(replace(replace(name, '_original', ''), '_medium', ''), '_small', ''), '_thumb', '') AS base_name,
       greatest(coalesce(TRY_CAST(TRY_CAST(regexp_replace(split_part(name, '-', 1), '[^0-9.+\\-]', '', 'g') AS DOUBLE) AS INTEGER), 0), 0) AS owner_id
  FROM x
""")
def g6_plan_renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendition plan, names, base name and owner for every upload."""
    df = FL.plan_renditions(fixture(spark, sf_dir, "file_upload"), "name", "width", "is_animated", "password")
    return df.select("id", "make_medium", "make_thumb", "medium_name", "thumb_name", "base_name", "owner_id")
