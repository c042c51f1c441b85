"""Stand-in inputs derived from the driver tables.

The reference keeps its data in application tables (usage log, accounts,
locations, notes, files).  The driver tables have none of those, so each
stand-in is a plain projection of a driver table written in SQL that runs
unchanged in Spark SQL and in DuckDB.  ``queries()`` and ``oracle_sql()``
therefore start from the very same rows: Spark runs the block through
``spark.sql`` and the oracle puts it in a ``WITH`` clause.

These blocks only shape rows into the schema a job expects; none of them does
any of the job's work.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed evaluation instant for the `events` data (2024-01-01 .. 2024-01-30).
AS_OF = "2024-01-31 00:00:00"
AS_OF_DATE = "2024-01-31"
HOME_URL = "http://home.example"

FIXTURE_SQL: dict[str, str] = {}

FIXTURE_SQL["usage_raw"] = """
SELECT event_id AS id,
       CAST(user_id % 4 + 1 AS INT) AS site_id,
       CAST(CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS INT) AS token_id,
       CAST(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 700
                 WHEN event_type = 'error' THEN 404
                 WHEN event_id % 11 = 0 THEN 302 ELSE 200 END AS INT) AS http_code,
       CASE WHEN event_type = 'purchase' THEN 'POST' WHEN event_type = 'signup' THEN '' ELSE 'GET' END AS request_type,
       CASE CAST(event_id % 9 AS INT) WHEN 0 THEN '/API/location/random?x=' || CAST(user_id AS STRING)
            WHEN 1 THEN '/ja-jp/file/2024-01/' || CAST(user_id AS STRING) || '-pic.JPG'
            WHEN 2 THEN '/api/files/list' WHEN 3 THEN '/wp-admin/setup.php' WHEN 4 THEN ''
            ELSE '/ja-jp/' || event_type || '/' || CAST(user_id % 12 AS STRING) END AS request_uri,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'HTTPS://Search.Example/' || event_type
            WHEN 2 THEN 'ab' ELSE 'http://home.example/today' END AS referrer,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'ja_JP' WHEN 1 THEN 'EN' ELSE 'toolong' END AS locale_code,
       ts AS event_at,
       '10.0.' || CAST(user_id % 8 AS STRING) || '.' || CAST(user_id % 200 AS STRING) AS from_ip,
       CASE CAST(user_id % 6 AS INT)
            WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
            WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1'
            WHEN 2 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
            WHEN 3 THEN 'curl/8.4.0' WHEN 4 THEN 'Googlebot/2.1' ELSE NULL END AS agent,
       CAST(CASE WHEN event_id % 10 = 0 THEN -value ELSE value END AS DECIMAL(16,8)) AS seconds,
       CAST(event_id % 30 AS INT) AS sqlops,
       event_id % 50 = 0 AS is_deleted
  FROM events
"""

FIXTURE_SQL["account"] = """
SELECT CAST(c_custkey + 1 AS INT) AS id, lower(c_name) AS login,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS display_name,
       'F' || CAST(c_custkey AS STRING) AS first_name, 'L' || CAST(c_nationkey AS STRING) AS last_name,
       'u' || CAST(c_custkey AS STRING) || '@mail.example' AS email,
       CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'account.admin' WHEN 1 THEN 'account.expert' WHEN 2 THEN 'account.pro'
            WHEN 3 THEN 'account.expired' WHEN 4 THEN 'account.global' ELSE 'account.basic' END AS type,
       CASE WHEN c_custkey % 2 = 0 THEN 'ja_JP' ELSE 'en_US' END AS locale_code,
       c_custkey % 20 = 0 AS is_deleted, md5(c_name) AS guid
  FROM customer
"""

# Every customer × four keys (those of a quarter of the customers deleted), written as
# a UNION ALL of four projections so no plan carries a cross join.
_ACCOUNT_META_KEYS = [("profile.avatar", 1), ("preference.can_email", 2), ("preference.fontsize", 3),
                      ("preference.theme", 4)]
FIXTURE_SQL["account_meta"] = "\nUNION ALL\n".join(f"""
SELECT CAST(c_custkey + 1 AS INT) AS account_id, '{key}' AS key,
       {"'a' || CAST(c_custkey % 5 AS STRING) || '.png'" if key == "profile.avatar" else
        "CASE WHEN c_custkey % 2 = 0 THEN 'Y' ELSE 'N' END" if key == "preference.can_email" else
        "CAST(c_custkey % 4 AS STRING)" if key == "preference.fontsize" else "'default'"} AS value,
       (c_custkey + {n}) % 7 = 0 OR c_custkey % 4 = 3 AS is_deleted
  FROM customer""" for key, n in _ACCOUNT_META_KEYS) + "\n"

FIXTURE_SQL["tokens"] = """
SELECT CAST(user_id + 1 AS INT) AS id, md5(CAST(user_id AS STRING)) || '-' || CAST(user_id AS STRING) AS guid,
       CAST(user_id + 1 AS INT) AS account_id, min(ts) AS created_at, max(ts) AS updated_at,
       user_id % 25 = 0 AS is_deleted
  FROM events GROUP BY user_id
"""

FIXTURE_SQL["location"] = """
SELECT CAST(s_suppkey + 1 AS INT) AS id, CASE WHEN s_suppkey % 4 = 3 THEN 'US' ELSE 'JP' END AS country_code,
       CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE CAST(s_nationkey AS INT) END AS state_id,
       s_name AS name, 'p' || CAST(s_suppkey AS STRING) || '.jpeg' AS src,
       CAST(122 + CAST(s_suppkey * 37 % 2400 AS DOUBLE) / 100 AS DECIMAL(12,8)) AS longitude,
       CAST(24 + CAST(s_suppkey * 53 % 2100 AS DOUBLE) / 100 AS DECIMAL(12,8)) AS latitude,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey + 1 AS INT) END AS note_id,
       s_suppkey % 5 <> 4 AS is_published, s_suppkey % 7 <> 6 AS is_visible, s_suppkey % 19 = 18 AS is_deleted,
       CAST(s_suppkey % 50 + 1 AS INT) AS created_by
  FROM supplier
"""

FIXTURE_SQL["state"] = """
SELECT n_nationkey AS id, n_regionkey AS region_id, 'JP' AS country_code, n_name AS name,
       'lbl' || replace(n_name, ' ', '') AS label, n_nationkey % 11 = 10 AS is_deleted
  FROM nation
"""

FIXTURE_SQL["country_region"] = """
SELECT r_regionkey AS id, 'JP' AS country_code, r_name AS name, r_regionkey = 4 AS is_deleted
  FROM region
"""

FIXTURE_SQL["attempt"] = """
SELECT o_orderkey AS attempt_id, CAST(o_custkey % 10 + 1 AS INT) AS location_id,
       122 + CAST(o_orderkey * 41 % 2400 AS DOUBLE) / 100 AS longitude,
       CASE WHEN o_orderkey % 97 = 0 THEN 95.0E0 ELSE 24 + CAST(o_orderkey * 31 % 2100 AS DOUBLE) / 100 END AS latitude,
       CAST(o_orderkey % 1100 - 20 AS INT) AS seconds, CAST(o_orderkey % 27 - 2 AS INT) AS hints
  FROM orders
"""

FIXTURE_SQL["note"] = """
SELECT CAST(doc_id + 1 AS INT) AS id, CASE WHEN doc_id % 10 = 0 THEN 'note.secret' ELSE 'note.normal' END AS type,
       text AS content, doc_id % 6 = 0 AS is_private, doc_id % 31 = 0 AS is_deleted,
       CAST(doc_id % 50 + 1 AS INT) AS updated_by
  FROM documents
"""

FIXTURE_SQL["note_version"] = """
SELECT CAST(conv_id + 1 AS INT) AS note_id, CAST(turn AS INT) AS version, 'note.normal' AS type,
       CASE WHEN turn % 3 = 2 THEN role ELSE text END AS content, turn % 4 = 3 AS is_private
  FROM conversations
"""

FIXTURE_SQL["file_req"] = """
SELECT CAST(p_partkey + 1 AS INT) AS id, CAST(p_partkey % 40 + 1 AS INT) AS account_id, p_partkey AS arrival,
       replace(p_name, ' ', '_') || CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf'
            WHEN 3 THEN '.exe' ELSE '' END AS name,
       p_size * 1000 + CAST(p_partkey % 700 AS INT) AS bytes, CAST(p_size * 40 AS INT) AS width,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'private' WHEN 1 THEN 'public-read' WHEN 2 THEN 'public-read-write' ELSE 'other' END AS acl
  FROM part
"""

QUOTA_BYTES = 400000


_REGISTERED: dict[int, str] = {}


def register_driver_tables(spark: SparkSession, sf_dir: str) -> None:
    """Expose each driver parquet file as a temp view named after the table
    (once per session and directory)."""
    # The stored times are wall-clock values read as UTC (the reference's
    # server zone); conversions to epoch seconds and day text go through the
    # session zone, so it is pinned here for every query.
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    key = id(spark)
    if _REGISTERED.get(key) == sf_dir and spark.catalog.tableExists("events"):
        return
    _REGISTERED[key] = sf_dir
    for name in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one stand-in block on Spark against the driver tables in ``sf_dir``."""
    register_driver_tables(spark, sf_dir)
    return spark.sql(FIXTURE_SQL[name])


def with_fixtures(*names: str) -> str:
    """``WITH`` clause that defines the named stand-ins for the DuckDB oracle."""
    return "WITH " + ",\n".join(f"{n} AS ({FIXTURE_SQL[n]})" for n in names) + "\n"

FIXTURE_SQL["country"] = """
SELECT code, CASE code WHEN 'JP' THEN 'Japan' ELSE 'United States' END AS name,
       'lblCountry' || code AS label, CASE code WHEN 'JP' THEN 0 ELSE 10 END AS sort_order,
       true AS is_available, false AS is_deleted
  FROM (SELECT DISTINCT CASE WHEN s_suppkey % 4 = 3 THEN 'US' ELSE 'JP' END AS code FROM supplier) c
"""

FIXTURE_SQL["location_meta"] = """
SELECT CAST(p_partkey % 150 + 1 AS INT) AS location_id, 'photo.' || lower(replace(p_brand, '#', '')) AS key,
       p_type AS value, p_partkey % 9 = 0 AS is_deleted
  FROM part
"""

FIXTURE_SQL["note_meta"] = """
SELECT CAST(doc_id + 1 AS INT) AS note_id, 'source.' || source AS key, lang AS value,
       doc_id % 5 = 0 OR doc_id % 3 = 1 AS is_deleted
  FROM documents
"""

FIXTURE_SQL["note_history"] = """
SELECT CAST(conv_id * 10 + turn AS INT) AS id, CAST(conv_id + 1 AS INT) AS note_id, role AS type, text AS content,
       CAST(turn % 50 + 1 AS INT) AS updated_by, turn % 7 = 6 AS is_deleted
  FROM conversations
"""

FIXTURE_SQL["locale"] = """
SELECT lang || '-' || CASE lang WHEN 'en' THEN 'us' ELSE lang END AS code, lang AS language_code,
       lang <> 'es' AS is_available, lang = 'en' AS is_default, false AS is_deleted
  FROM (SELECT DISTINCT lang FROM documents) d
"""

FIXTURE_SQL["site"] = """
SELECT CAST(n_nationkey + 1 AS INT) AS id, CAST(n_nationkey + 1 AS INT) AS account_id, n_name AS name, md5(n_name) AS guid,
       CASE WHEN n_nationkey % 3 = 0 THEN 'en-us' WHEN n_nationkey % 3 = 1 THEN 'fr-fr' ELSE 'xx-yy' END AS locale_code,
       n_nationkey % 2 = 0 AS https, 'theme' || CAST(n_regionkey AS STRING) AS theme,
       n_nationkey = 3 AS is_default, n_nationkey % 12 = 11 AS is_deleted
  FROM nation
"""

FIXTURE_SQL["site_url"] = """
SELECT CAST(page_id + 1 AS INT) AS id, CAST(page_id % 25 + 1 AS INT) AS site_id,
       lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS url,
       page_id % 4 = 0 AS is_active, page_id % 13 = 12 AS is_deleted,
       make_timestamp(2024, 1, CAST(page_id % 28 + 1 AS INT), CAST(page_id % 24 AS INT), CAST(page_id % 60 AS INT), 0) AS updated_at
  FROM pages
"""

FIXTURE_SQL["site_meta"] = """
SELECT CAST(page_id % 25 + 1 AS INT) AS site_id,
       CASE WHEN page_id % 3 = 0 THEN 'banner.src' ELSE 'site.keywords' END AS key,
       'b' || CAST(page_id AS STRING) || '.png' AS value, page_id % 5 = 4 AS is_deleted
  FROM pages
"""

FIXTURE_SQL["host_request"] = """
SELECT page_id AS request_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS host
  FROM pages
"""

FIXTURE_SQL["note_request"] = """
SELECT o_orderkey AS request_id, CAST(o_custkey % 60 + 1 AS INT) AS account_id,
       CAST(o_orderkey % 997 + 1 AS INT) AS note_id
  FROM orders
"""

FIXTURE_SQL["file"] = """
SELECT CAST(p_partkey + 1 AS INT) AS id, CAST(p_partkey % 40 + 1 AS INT) AS account_id,
       replace(p_name, ' ', '_') AS name, p_size * 1000 + CAST(p_partkey % 700 AS INT) AS bytes,
       CASE WHEN p_partkey % 3 = 0 THEN NULL
            ELSE make_timestamp(2024, CAST(p_partkey % 3 AS INT), CAST(p_partkey % 28 + 1 AS INT), 0, 0, 0) END AS expires_at,
       p_partkey % 17 = 16 AS is_deleted,
       substr(md5(p_name || CAST(p_partkey AS STRING)), 1, 8) || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 9, 4)
         || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 13, 4) || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 17, 4)
         || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 21, 12) AS guid
  FROM part
"""

FIXTURE_SQL["file_request"] = """
SELECT o_orderkey AS request_id, CAST(o_custkey % 60 + 1 AS INT) AS account_id,
       CASE WHEN o_orderkey % 19 = 0 THEN 0 ELSE CAST(o_orderkey % 2500 + 1 AS INT) END AS file_id
  FROM orders
"""

FIXTURE_SQL["account_request"] = """
SELECT c_custkey AS request_id,
       CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE 'new' || CAST(c_custkey AS STRING) END AS login,
       CASE WHEN c_custkey % 2 = 0 THEN 'U' || CAST(c_custkey + 7 AS STRING) || '@Mail.Example' ELSE 'x@y' END AS email,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'en-us' WHEN 1 THEN 'fr_CA' WHEN 2 THEN 'es-mx' ELSE 'zz' END AS locale
  FROM customer
"""

FIXTURE_SQL["label_text"] = """
SELECT 'lbl' || replace(n_name, ' ', '') AS label,
       CASE WHEN n_nationkey % 4 = 0 OR n_nationkey % 5 = 2 THEN ' ' ELSE lower(n_name) || '-ja' END AS value
  FROM nation
"""

FIXTURE_SQL["site_request"] = """
SELECT page_id AS request_id, CAST(page_id % 23 + 1 AS INT) AS site_id,
       upper(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS url
  FROM pages
"""

FIXTURE_SQL["file_upload"] = """
SELECT CAST(p_partkey + 1 AS INT) AS id, CAST(p_partkey % 40 + 1 AS INT) AS account_id,
       CASE WHEN p_partkey % 7 = 0 THEN replace(p_name, ' ', '_')
            ELSE CAST(p_partkey % 40 + 1 AS STRING) || '-' || replace(p_name, ' ', '_') END
         || CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN '.jpg' WHEN 1 THEN '_thumb.png' WHEN 2 THEN '.pdf'
                 WHEN 3 THEN '.gif' WHEN 4 THEN '' ELSE '.docx' END AS name,
       CASE CAST(p_partkey % 6 AS INT) WHEN 4 THEN 'image/png' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
            ELSE NULL END AS given_mime,
       CAST(p_size * 40 AS INT) AS width, p_partkey % 11 = 0 AS is_animated,
       CASE WHEN p_partkey % 9 = 0 THEN 'pw' || CAST(p_partkey AS STRING) ELSE '' END AS password,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'private' WHEN 1 THEN 'Public-Read' WHEN 2 THEN 'public-read-write' ELSE 'other' END AS acl
  FROM part
"""

FIXTURE_SQL["meta_change"] = """
SELECT CAST(o_custkey + 1 AS INT) AS account_id,
       CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN ' Profile.Avatar ' WHEN 1 THEN 'preference.theme' WHEN 2 THEN 'nodotkey'
            WHEN 3 THEN 'preference.fontsize' ELSE 'profile.bio' END AS key,
       CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE ' ' || o_orderpriority || ' ' END AS value,
       o_orderkey AS seq
  FROM orders
"""

FIXTURE_SQL["note_change"] = """
SELECT conv_id * 100 + turn AS request_id, CAST(turn % 50 + 1 AS INT) AS account_id,
       CASE WHEN turn % 5 = 4 THEN 0 ELSE CAST(conv_id % 997 + 1 AS INT) END AS note_id,
       CASE WHEN turn % 6 = 5 THEN '  ' ELSE text END AS content,
       CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'NOTE.Secret' WHEN 1 THEN 'bogus' ELSE 'note.locked' END AS type,
       CASE WHEN turn % 2 = 0 THEN 'y' ELSE 'N' END AS private
  FROM conversations
"""

FIXTURE_SQL["url_change"] = """
SELECT page_id AS seq, CAST(CASE WHEN page_id % 2 = 0 THEN page_id + 1 WHEN page_id % 6 = 1 THEN page_id % 50 + 100001
                                 ELSE page_id + 200001 END AS INT) AS id,
       CAST(page_id % 25 + 1 AS INT) AS site_id,
       upper(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) || '/x' AS url, page_id % 3 = 1 AS is_active
  FROM pages
"""

FIXTURE_SQL["file_stamp"] = """
SELECT CAST(p_partkey + 1 AS INT) AS id,
       CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'g' || CAST(p_partkey AS STRING) END AS guid,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE make_timestamp(2024, 1, CAST(p_partkey % 28 + 1 AS INT), 0, 0, 0) END AS start_at,
       CASE WHEN p_partkey % 4 = 0 THEN NULL
            ELSE make_timestamp(2024, CAST(1 + p_partkey % 2 AS INT), CAST(p_partkey % 28 + 1 AS INT), 0, 0, 0) END AS until_at,
       p_partkey % 5 <> 0 AS is_active
  FROM part
"""

FIXTURE_SQL["account_signup"] = """
SELECT c_custkey AS request_id,
       CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN c_name WHEN 1 THEN 'ab' WHEN 2 THEN 'New_' || CAST(c_custkey % 300 AS STRING)
            WHEN 3 THEN 'Sign' || CAST(c_custkey AS STRING) ELSE 'x' || CAST(c_custkey AS STRING) END AS nickname,
       CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'U' || CAST(c_custkey % 60 + 3 AS STRING) || '@Mail.Example'
            WHEN 1 THEN 'a@b' WHEN 2 THEN 'Dup' || CAST(c_custkey % 40 AS STRING) || '@Mail.Example'
            WHEN 3 THEN 'dup' || CAST(c_custkey % 50 AS STRING) || '@mail.example' ELSE '' END AS email,
       CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS display_name,
       CASE WHEN c_custkey % 7 = 0 THEN 'short' ELSE 'longpassword' || CAST(c_custkey AS STRING) END AS password,
       CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'f' WHEN 1 THEN 'G' ELSE 'x' END AS gender,
       ' L' || CAST(c_nationkey AS STRING) || ' ' AS last_name, 'F' || CAST(c_custkey AS STRING) AS first_name,
       CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'en-us' WHEN 1 THEN 'fr_CA' WHEN 2 THEN 'es-mx' ELSE 'zz' END AS locale,
       'UTC' AS timezone,
       CASE WHEN c_custkey % 2 = 0 THEN 'Account.PRO' ELSE 'bogus' END AS type
  FROM customer
"""

FIXTURE_SQL["account_update"] = """
SELECT o_orderkey AS request_id, CAST(o_custkey + 1 AS INT) AS account_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'wrong' ELSE md5(c_name) END AS account_guid,
       'D' || CAST(o_orderkey AS STRING) AS display_name, 'New' || CAST(o_orderkey AS STRING) || '@Mail.Example' AS email,
       CASE WHEN o_orderkey % 2 = 0 THEN 'g' ELSE 'm' END AS gender, 'en-us' AS locale_code
  FROM orders JOIN customer ON c_custkey = o_custkey
"""

FIXTURE_SQL["file_register"] = """
SELECT p_partkey AS request_id, CAST(p_partkey % 60 + 1 AS INT) AS account_id,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN ''
            WHEN 1 THEN substr(md5(p_name || CAST(p_partkey AS STRING)), 1, 8) || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 9, 4)
              || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 13, 4) || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 17, 4)
              || '-' || substr(md5(p_name || CAST(p_partkey AS STRING)), 21, 12)
            ELSE 'bad-guid' END AS file_guid,
       CASE WHEN p_partkey % 11 = 0 THEN 'ab' ELSE replace(p_name, ' ', '_') END AS local_name,
       ' ' || p_name || ' ' AS file_name, '2024-01' AS path, md5(p_name) AS file_hash,
       CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE p_size * 1000 END AS bytes,
       CASE WHEN p_partkey % 17 = 0 THEN 'x' ELSE ' Image/JPEG ' END AS mimetype,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '2024-03-01 10:00:00' WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE '2023-12-31' END AS expires_at,
       CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN 'private' WHEN 1 THEN 'PUBLIC-READ' ELSE 'public-read-write' END AS access
  FROM part
"""

FIXTURE_SQL["contact_request"] = """
SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn % 5 = 0 THEN '' ELSE ' ' || role || ' ' END AS name,
       CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'User' || CAST(conv_id AS STRING) || '@Mail.Example' WHEN 1 THEN 'bad-mail' ELSE '' END AS mail,
       CASE WHEN turn % 2 = 0 THEN '' ELSE 'S' || CAST(turn AS STRING) END AS subject, text AS message
  FROM conversations
"""

FIXTURE_SQL["site_change"] = """
SELECT page_id AS request_id, CAST(CASE WHEN page_id % 2 = 0 THEN page_id % 25 + 1 ELSE page_id % 60 + 1 END AS INT) AS account_id,
       CASE WHEN page_id % 3 = 0 THEN CAST(page_id % 25 + 1 AS INT) ELSE 0 END AS site_id,
       ' Site ' || CAST(page_id AS STRING) AS name, 'About ' || CAST(page_id AS STRING) AS description, ' A,B ' AS keywords,
       CASE CAST(page_id % 3 AS INT) WHEN 0 THEN 'EN-US' WHEN 1 THEN 'fr-fr' ELSE 'xx' END AS locale,
       CASE WHEN page_id % 2 = 0 THEN 'y' ELSE 'n' END AS https, 'Dark' AS theme,
       lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1)) AS url
  FROM pages
"""

FIXTURE_SQL["token_seen"] = """
SELECT DISTINCT CAST(user_id + 1 AS INT) AS id, md5(CAST(user_id AS STRING)) || '-' || CAST(user_id AS STRING) AS guid
  FROM events
"""

FIXTURE_SQL["token_revoke"] = """
SELECT DISTINCT CAST(user_id + 1 AS INT) AS id,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN md5(CAST(user_id AS STRING)) || '-' || CAST(user_id AS STRING)
            ELSE 'nope' END AS guid
  FROM events
"""

FIXTURE_SQL["login_request"] = """
SELECT o_orderkey AS login_id, CAST(CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 ELSE -1 END AS INT) AS account_id FROM orders
"""

FIXTURE_SQL["path_request"] = """
SELECT page_id AS request_id,
       '/' || regexp_extract(url, '^[a-zA-Z]+://[^/]+/([a-z]{2})/', 1) || CASE WHEN page_id % 2 = 0 THEN '-jp' ELSE '-us' END
         || CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '/api/note/' WHEN 1 THEN '/note/' WHEN 2 THEN '/files/' ELSE '/wp-admin/' END
         || substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4) || '-'
         || substr(md5(url), 17, 4) || '-' || substr(md5(url), 21, 12)
         || '/' || CAST(page_id % 7 AS STRING) || '/edit/edit?ref=' || CAST(page_id AS STRING) AS request_uri,
       CASE CAST(page_id % 3 AS INT) WHEN 0 THEN 'api.example.com' WHEN 1 THEN 'files.example.com' ELSE 'www.example.com' END AS host
  FROM pages
"""

FIXTURE_SQL["ip_headers"] = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 5 = 0 THEN '10.1.' || CAST(user_id % 250 AS STRING) || '.7' ELSE NULL END AS cf_connecting_ip,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'unknown' WHEN 1 THEN '2001:db8::' || CAST(user_id % 9 AS STRING) ELSE NULL END AS x_forwarded_for,
       CASE WHEN event_id % 7 = 0 THEN 'garbage-' || CAST(user_id AS STRING) ELSE '192.168.0.' || CAST(user_id % 256 AS STRING) END AS remote_addr
  FROM events
"""

FIXTURE_SQL["licence_request"] = """
SELECT n_nationkey AS id,
       CASE CAST(n_nationkey % 6 AS INT) WHEN 0 THEN 'CC0' WHEN 1 THEN 'cc by-sa' WHEN 2 THEN 'CC BY-NC' WHEN 3 THEN 'bogus'
            WHEN 4 THEN 'CC BY-NC-SA' ELSE 'CC BY' END AS licence_code
  FROM nation
"""

FIXTURE_SQL["local_time"] = """
SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE ' 0' || CAST(o_orderkey % 10 AS STRING) || ':3' || CAST(o_orderkey % 6 AS STRING) || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ':0' || CAST(o_orderkey % 10 AS STRING) END END AS local_text,
       CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Asia/Tokyo' WHEN 1 THEN 'Asia/Kolkata' ELSE 'UTC' END AS tz
  FROM orders
"""

FIXTURE_SQL["label_file"] = """
SELECT DISTINCT lang AS lang_code, 'lbl.' || source AS key, ' v-' || lang || '-' || source || ' {year} ' AS value FROM documents
UNION ALL
SELECT DISTINCT lang || '_' || upper(CASE lang WHEN 'en' THEN 'us' ELSE lang END) AS lang_code, 'lbl.' || source AS key,
       CASE WHEN source < 'src3' THEN 'loc-' || lang || '-' || source || ' {version_id}' ELSE ' ' END AS value
  FROM documents
"""

FIXTURE_SQL["lang_request"] = """
SELECT event_id AS request_id,
       CASE WHEN event_id % 5 = 0 THEN 'FR-fr' WHEN event_id % 5 = 1 THEN 'x' ELSE NULL END AS cookie_lang,
       CASE CAST(event_id % 3 AS INT) WHEN 0 THEN '/ja-jp/view/' || CAST(user_id AS STRING) WHEN 1 THEN '/About/'
            ELSE '/' || event_type END AS request_uri,
       CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'de-DE,de;q=0.9,en;q=0.8' WHEN 1 THEN 'es' WHEN 2 THEN 'ja,en_GB;q=0.5'
            ELSE 'zz' END AS accept_language
  FROM events
"""

FIXTURE_SQL["file_meta"] = """
SELECT CAST(p_partkey % 40 + 1 AS INT) AS file_id,
       CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'Image.W' || CAST(p_partkey AS STRING)
            WHEN 1 THEN 'image.exif.f' || CAST(p_partkey AS STRING)
            WHEN 2 THEN 'geo.gps.pos.k' || CAST(p_partkey AS STRING)
            ELSE 'flat' || CAST(p_partkey AS STRING) END AS key,
       CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS STRING) ELSE p_type END AS value,
       p_partkey % 13 = 0 AS is_deleted
  FROM part
"""

FIXTURE_SQL["customer_record"] = """
SELECT c_custkey AS customer_id, 'cus_' || lpad(CAST(c_custkey AS STRING), 8, '0') AS id, c_name AS name,
       CASE WHEN c_custkey % 3 = 0 THEN '+1-555-' || lpad(CAST(c_custkey AS STRING), 6, '0') ELSE '' END AS phone,
       'u' || CAST(c_custkey AS STRING) || '@mail.example' AS email,
       lpad(CAST(c_custkey % 100000 AS STRING), 5, '0') AS postal_code, n_name AS country,
       CAST(n_regionkey AS STRING) AS state, c_mktsegment AS line1, '' AS line2, 'City' || CAST(c_nationkey AS STRING) AS city
  FROM customer JOIN nation ON n_nationkey = c_nationkey
"""

FIXTURE_SQL["location_review"] = """
SELECT CAST(l_suppkey + 1 AS INT) AS location_id, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS key,
       'Quantity ' || CAST(CAST(l_quantity AS INT) AS STRING) || ', flag ' || l_returnflag AS content,
       l_shipdate AS publish_at, CAST(l_discount * 50 AS DECIMAL(6,3)) AS rating, l_linenumber = 7 AS is_deleted
  FROM lineitem
"""

FIXTURE_SQL["exif_row"] = """
SELECT CAST(s_suppkey + 1 AS INT) AS file_id,
       CAST(CAST(floor((2400 + s_suppkey * 53 % 2100) / 100) AS BIGINT) AS STRING) || '/1' AS lat_d,
       CAST(CAST(floor(((2400 + s_suppkey * 53 % 2100) % 100) * 36 / 60) AS BIGINT) AS STRING) || '/1' AS lat_m,
       CAST(((2400 + s_suppkey * 53 % 2100) % 100) * 36 % 60 AS STRING) || CASE WHEN s_suppkey % 11 = 0 THEN '/0' ELSE '/1' END AS lat_s,
       CAST(CAST(floor((12200 + s_suppkey * 37 % 2400) / 100) AS BIGINT) AS STRING) || '/1' AS lon_d,
       CAST(CAST(floor(((12200 + s_suppkey * 37 % 2400) % 100) * 36 / 60) AS BIGINT) AS STRING) || '/1' AS lon_m,
       CAST(((12200 + s_suppkey * 37 % 2400) % 100) * 36 % 60 * 100 AS STRING) || '/100' AS lon_s,
       CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 2 = 1 THEN 'S' ELSE 'N' END AS lat_ref,
       CASE WHEN s_suppkey % 3 = 0 THEN 'W' WHEN s_suppkey % 17 = 0 THEN 'x' ELSE 'E' END AS lon_ref,
       CASE CAST(s_suppkey % 4 AS INT) WHEN 0 THEN CAST(s_suppkey % 360 AS STRING) || '/1' WHEN 1 THEN '5/0' ELSE NULL END AS direction,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'Maker' || CAST(s_suppkey % 7 AS STRING) END AS make,
       'M' || CAST(s_suppkey AS STRING) AS model, '1/' || CAST(s_suppkey % 500 + 1 AS STRING) AS exposure,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 40 + 10 AS STRING) || '/10' END AS aperture,
       CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE CAST(s_suppkey % 9 AS STRING) || '/1' END AS shutter,
       CAST(s_suppkey % 8 * 100 AS STRING) AS iso, '2024:01:' || CAST(s_suppkey % 28 + 10 AS STRING) || ' 10:00:00' AS taken,
       CAST(s_suppkey % 5 * 1000 AS STRING) AS width, CAST(s_suppkey % 4 * 750 AS STRING) AS height
  FROM supplier
"""

FIXTURE_SQL["rss_source"] = """
SELECT doc_id,
       substr(md5(CAST(doc_id AS STRING)), 1, 8) || '-' || substr(md5(CAST(doc_id AS STRING)), 9, 4) || '-'
         || substr(md5(CAST(doc_id AS STRING)), 13, 4) || '-' || substr(md5(CAST(doc_id AS STRING)), 17, 4) || '-'
         || substr(md5(CAST(doc_id AS STRING)), 21, 12) AS guid,
       lang || '_' || upper(lang) AS locale, source || ' #' || CAST(doc_id AS STRING) AS title,
       'Author ' || CAST(doc_id % 50 AS STRING) AS author, 'https://home.example/note/' || CAST(doc_id AS STRING) AS url,
       ' ' || source || ' ' AS summary, text AS html,
       make_timestamp(2024, 1, CAST(doc_id % 28 + 1 AS INT), CAST(doc_id % 24 AS INT), 0, 0) AS publish_at,
       make_timestamp(2024, 2, CAST(doc_id % 28 + 1 AS INT), CAST(doc_id % 24 AS INT), 30, 0) AS updated_at
  FROM documents
"""

# every document with hash tags and bracketed foot notes in its text
FIXTURE_SQL["tagged_text"] = """
SELECT doc_id, text || ' #' || upper(lang) || ', #' || source || '! #' || lang
       || CASE WHEN doc_id % 3 = 0 THEN ' See [1. from ' || source || '] and [2. in [' || lang || '] words], [1. from ' || source || ']'
               WHEN doc_id % 3 = 1 THEN ' [no note] [3.  ] [a. row ' || CAST(doc_id AS STRING) || ' ]' ELSE '' END AS text
  FROM documents
"""

# every page url, and for some pages the same url spelt in another way
FIXTURE_SQL["page_link"] = """
SELECT page_id, url FROM pages
UNION ALL
SELECT page_id + 10000000 AS page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, 'https://', 'http://') ELSE replace(url, 'http://', 'https://') END
       || CASE WHEN page_id % 3 = 0 THEN '' ELSE '/' END AS url
  FROM pages WHERE url NOT LIKE '%/'
"""

FIXTURE_SQL["lookup_request"] = """
SELECT c_custkey AS request_id,
       CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'u' || CAST(c_custkey + 7 AS STRING) || '@mail.example'
            WHEN 1 THEN 'U' || CAST(c_custkey AS STRING) || '@Mail.Example' WHEN 2 THEN 'u' || CAST(c_custkey AS STRING) || '@mail.example'
            WHEN 3 THEN 'u' ELSE NULL END AS lookup,
       CASE WHEN c_custkey % 7 = 0 THEN 'short' ELSE 'password' || CAST(c_custkey % 2 AS STRING) END AS password
  FROM customer
"""

# Rows for the declared keys only: every table of the catalogue that other
# operators do not read, and the guid columns they leave out.
FIXTURE_SQL["language"] = """
SELECT DISTINCT lang AS code FROM documents WHERE lang <> 'fr'
"""

FIXTURE_SQL["location_key"] = """
SELECT CAST(s_suppkey + 1 AS INT) AS id, CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE CAST(s_suppkey % 2000 AS INT) END AS updated_by,
       md5(CAST(s_suppkey % 90 AS STRING)) AS guid
  FROM supplier
"""

FIXTURE_SQL["note_key"] = """
SELECT CAST(doc_id + 1 AS INT) AS id, md5(text) AS guid FROM documents
"""

FIXTURE_SQL["file_url"] = """
SELECT o_orderkey AS id, CAST(o_orderkey % 2300 AS INT) AS file_id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS INT) END AS account_id,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 1100 + 1 AS INT) END AS token_id,
       md5(CAST(o_orderkey % 1400 AS STRING) || o_orderstatus) AS guid
  FROM orders
"""

FIXTURE_SQL["contact"] = """
SELECT CAST(conv_id * 100 + turn AS INT) AS id, md5(text) AS guid FROM conversations WHERE turn % 2 = 0
"""

FIXTURE_SQL["contact_meta"] = """
SELECT CAST(conv_id * 100 + turn AS INT) AS contact_id, 'sent.' || role AS key FROM conversations WHERE turn % 3 > 0
"""

FIXTURE_SQL["note_meta_change"] = """
SELECT CAST(doc_id * 7 % 1200 + 1 AS INT) AS note_id,
       CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' Source.' || source WHEN 1 THEN 'geo.place ' WHEN 2 THEN 'plain' ELSE 'Tag.' || lang END AS key,
       CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '   ' ELSE ' v' || CAST(doc_id AS STRING) END AS value, doc_id AS seq
  FROM documents
"""

FIXTURE_SQL["file_meta_change"] = """
SELECT CAST(o_orderkey % 50 + 1 AS INT) AS file_id,
       CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'Image.W' || CAST(o_orderkey % 400 AS STRING) WHEN 1 THEN 'image.alt' ELSE 'none' END AS key,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE o_orderpriority END AS value, o_orderkey AS seq
  FROM orders
"""
