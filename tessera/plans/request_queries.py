"""Request-path queries: route parse, GUID in path, hostile-probe filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import HOME_URL, fixture, with_fixtures
from tessera.operators import usage as U
from tessera.plans.oracle_sql import q, usage_ctes
from tessera.plans.registry import register

# Locale path segments recognised by the router.
LOCALES = ["en-us", "ja-jp", "fr-fr", "de-de", "es-es"]


def _route_sql(uri: str, host: str | None) -> str:
    """P7 as DuckDB SQL: yields columns req_path, route, pg_root, pg_sub."""
    locs = "[" + ", ".join(q(x) for x in LOCALES) + "]"
    filters = "[" + ", ".join(q(x) for x in U.ROUTE_FILTERS) + "]"
    parts = f"list_transform(string_split(coalesce({uri}, ''), '/'), lambda p: lower(trim(p)))"
    kept = f"list_filter({parts}, lambda p: length(p) > 0 AND NOT list_contains({locs}, p))"
    no_query = f"split_part(array_to_string({kept}, '/'), '?', 1)"
    segs = f"list_filter(string_split({no_query}, '/'), lambda p: length(trim(p)) > 0)"
    by_host = "NULL"
    if host:
        label = f"split_part(lower(trim({host})), '.', 1)"
        by_host = "CASE " + " ".join(f"WHEN {label} = {q(k)} THEN {q(v)}" for k, v in U.SUBDOMAIN_ROUTES.items()) + " END"
    return f"""
s0 AS (SELECT *, {segs} AS segs, {by_host} AS by_host FROM src),
s1 AS (SELECT *, coalesce(list_contains({filters}, segs[1]), false) AS inf FROM s0),
s2 AS (SELECT *, coalesce(by_host, CASE WHEN inf THEN segs[1] END, 'web') AS route,
              '/' || coalesce(url_decode(array_to_string(segs, '/')), array_to_string(segs, '/')) AS req_path,
              url_decode(CASE WHEN inf THEN segs[2] ELSE segs[1] END) AS pg_root,
              CASE WHEN inf THEN list_slice(segs, 3, len(segs)) ELSE list_slice(segs, 2, len(segs)) END AS rest
         FROM s1),
s3 AS (SELECT *, list_reduce(rest, lambda acc, x: CASE
                   WHEN regexp_matches(x, '^[0-9]+(\\.[0-9]+)?$')
                        OR NOT list_contains(list_concat(acc, [req_path, route, coalesce(pg_root, '')]), x)
                   THEN list_append(acc, coalesce(url_decode(x), x)) ELSE acc END, []::VARCHAR[]) AS pg_sub0
         FROM s2),
routed AS (SELECT *, coalesce(pg_sub0, []::VARCHAR[]) AS pg_sub FROM s3)"""


@register("p7_parse_route", oracle=with_fixtures("path_request") + ", src AS (SELECT * FROM path_request),"
          + _route_sql("request_uri", "host") + "\nSELECT request_id, req_path, route, pg_root, pg_sub FROM routed")
def p7_parse_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route, page root and sub-pages of every request path (host routing on)."""
    df = U.parse_route(fixture(spark, sf_dir, "path_request"), LOCALES, "request_uri", "host")
    return df.select("request_id", "req_path", "route", "pg_root", "pg_sub")


@register("p8_guid_from_path", oracle=with_fixtures("path_request") + ", src AS (SELECT * FROM path_request),"
          + _route_sql("request_uri", "host") + """
SELECT request_id, coalesce(trim(list_filter(list_slice(pg_sub, 1, 9), lambda s: length(trim(s)) = 36)[-1]), '') AS guid
  FROM routed""")
def p8_guid_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right-most 36-character sub-page (GUID) of every request path."""
    df = U.parse_route(fixture(spark, sf_dir, "path_request"), LOCALES, "request_uri", "host")
    return U.guid_from_path(df).select("request_id", "guid")


def _probe_sql() -> str:
    segs = "[" + ", ".join(q(x) for x in U.PROBE_SEGMENTS) + "]"
    ext = " OR ".join(f"contains(u, {q('.' + e)})" for e in U.PROBE_EXTENSIONS)
    flag = " OR ".join(f"contains(u, {q(f)})" for f in U.PROBE_FLAGS)
    return f"""
, p AS (SELECT request_id, lower(trim(coalesce(request_uri, ''))) AS u,
               list_transform(list_slice(list_prepend(coalesce(pg_root, ''), pg_sub), 1, 4), lambda s: lower(trim(s))) AS f4
          FROM routed)
SELECT request_id, CASE WHEN coalesce(list_has_any(f4, {segs}), false) THEN 'segment' WHEN {ext} THEN 'extension'
                        WHEN {flag} THEN 'flag' END AS probe_reason
  FROM p"""


@register("p6_classify_probe", oracle=usage_ctes() + ", src AS (SELECT id AS request_id, request_uri FROM usage),"
          + _route_sql("request_uri", None) + _probe_sql().replace(
              "\nSELECT request_id, CASE", "\nSELECT request_id, probe_reason IS NOT NULL AS is_probe, probe_reason FROM (SELECT request_id, CASE")
          + ") x")
def p6_classify_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 (+P7, M13): hostile-probe flag and reason for every logged request."""
    usage = U.normalise_usage(fixture(spark, sf_dir, "usage_raw"), HOME_URL).select(
        F.col("id").alias("request_id"), "request_uri")
    routed = U.parse_route(usage, LOCALES, "request_uri")
    return U.classify_probe(routed).select("request_id", "is_probe", "probe_reason")
