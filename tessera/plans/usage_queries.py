"""Usage-log queries over the `events` stand-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, AS_OF_DATE, FIXTURE_SQL, HOME_URL, fixture
from tessera.operators import usage as U
from tessera.plans.oracle_sql import usage_ctes, window_start
from tessera.plans.registry import REGISTRY, register

REPORT_DAYS = 30  # the report cap; covers the whole `events` range


def usage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.normalise_usage(fixture(spark, sf_dir, "usage_raw"), home_url=HOME_URL)


_M13_COLS = ("id site_id token_id http_code request_type request_uri referrer locale_code "
             "event_on from_ip agent seconds sqlops is_deleted is_api is_file").split()


@register("m13_normalise_usage", oracle=usage_ctes() + f"""
SELECT {", ".join(c if c != "seconds" else "round(CAST(seconds AS DOUBLE), 6) AS seconds" for c in _M13_COLS)},
       CAST(floor(epoch(event_at)) AS BIGINT) AS event_unix
  FROM usage
""")
def m13_normalise_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request rows → stored usage rows (every row of `events`)."""
    df = usage_log(spark, sf_dir)
    return df.select(*[F.round(F.col(c).cast("double"), 6).alias(c) if c == "seconds" else F.col(c)
                       for c in _M13_COLS],
                     F.unix_timestamp("event_at").alias("event_unix"))


_A1_SQL = usage_ctes() + f"""
, site_dim AS ({FIXTURE_SQL["site"]}),
w AS (SELECT * FROM usage
         WHERE NOT is_deleted AND NOT is_api AND http_code BETWEEN 200 AND 299
           AND event_on >= {window_start(REPORT_DAYS)}),
data AS (SELECT site_id, event_on,
                COUNT(CASE WHEN NOT is_file THEN id END) AS pages,
                COUNT(CASE WHEN is_file THEN id END) AS files,
                COUNT(DISTINCT CASE WHEN NOT is_file THEN token_id END) AS cids,
                COUNT(DISTINCT CASE WHEN NOT is_file THEN concat(coalesce(from_ip, ''), coalesce(agent, '')) END) AS page_agents,
                COUNT(DISTINCT CASE WHEN is_file THEN concat(coalesce(from_ip, ''), coalesce(agent, '')) END) AS file_agents
           FROM w GROUP BY site_id, event_on),
zeros AS (SELECT s.site_id, strftime(CAST(DATE '{AS_OF_DATE}' - CAST(g.g AS INTEGER) AS DATE), '%Y-%m-%d') AS event_on,
                 0 AS pages, 0 AS files, 0 AS cids, 0 AS page_agents, 0 AS file_agents
            FROM (SELECT id AS site_id FROM site_dim) s, generate_series(0, {REPORT_DAYS}) g(g))
SELECT site_id, event_on, CAST(epoch(CAST(event_on AS TIMESTAMP)) AS BIGINT) AS event_unix,
       SUM(pages) AS pages, SUM(files) AS files, SUM(cids) AS cids,
       SUM(page_agents) AS page_agents, SUM(file_agents) AS file_agents
  FROM (SELECT * FROM data UNION ALL SELECT * FROM zeros) t
 WHERE event_on >= {window_start(REPORT_DAYS)}
 GROUP BY site_id, event_on
 ORDER BY event_on DESC, site_id
"""


@register("a1_site_daily_stats", oracle=_A1_SQL)
def a1_site_daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 (flagship, +O3): daily usage per site over the last 30 days, zero-filled calendar."""
    sites = fixture(spark, sf_dir, "site").select(F.col("id").alias("site_id"))
    return U.site_daily_stats(usage_log(spark, sf_dir), as_of=AS_OF, days=REPORT_DAYS, sites=sites)


@register("a2_client_top_k", oracle=usage_ctes() + f"""
, per_client AS (
  SELECT site_id, token_id AS client_id, COUNT(id) AS pages,
         COUNT(DISTINCT concat(coalesce(from_ip, ''), coalesce(agent, ''))) AS visitors
    FROM usage
   WHERE NOT is_deleted AND NOT is_api AND http_code BETWEEN 200 AND 299
     AND event_on >= {window_start(REPORT_DAYS)} AND NOT is_file AND token_id IS NOT NULL
   GROUP BY site_id, token_id)
SELECT site_id, rank, client_id, pages, visitors FROM (
  SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY pages DESC, visitors DESC, client_id) AS rank
    FROM per_client) r
 WHERE rank <= 25
""")
def a2_client_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: top 25 clients per site by pages (with distinct visitors), last 30 days."""
    return U.client_top_k(usage_log(spark, sf_dir), as_of=AS_OF, days=REPORT_DAYS, count=25)


@register("a2_client_names", oracle=REGISTRY["a2_client_top_k"].oracle.replace("WITH ", f"WITH account AS ({FIXTURE_SQL['account']}),\n", 1)
          .replace("SELECT site_id, rank, client_id, pages, visitors FROM (",
                   "SELECT site_id, rank, client_id, pages, visitors, a.display_name AS name, a.login AS code FROM (")
          .replace(" WHERE rank <= 25", " LEFT JOIN account a ON a.id = r.client_id\n WHERE rank <= 25"))
def a2_client_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the top 25 clients per site with name and code."""
    clients = fixture(spark, sf_dir, "account").select(F.col("id").alias("client_id"), F.col("display_name").alias("name"), F.col("login").alias("code"))
    return U.client_top_k(usage_log(spark, sf_dir), as_of=AS_OF, days=REPORT_DAYS, count=25, clients=clients)
