"""Streaming queries: each replays stand-in files through the streaming job
(trigger availableNow) and returns the sink read back as a batch frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.fixtures import AS_OF, HOME_URL, fixture
from tessera.operators.usage import normalise_usage, sessionize
from tessera.plans.merge_queries import _M2_BASE
from tessera.plans.oracle_sql import usage_ctes
from tessera.plans.registry import REGISTRY, register
from tessera.plans.request_queries import LOCALES
from tessera.session import scratch_path
from tessera.streaming import jobs as S
from tessera.streaming.log import TableLog


def _run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


#: Arrival order of the request rows: the middle days first, then the newest, then
#: the oldest; a tenth of the first slice is delivered once more with the last.
_FIRST, _SECOND = "2024-01-11", "2024-01-21"


def _ingest(spark: SparkSession, sf_dir: str) -> str:
    """Land the request rows as files in three slices, out of order, and run X1
    after each; returns the path of the log."""
    base = _run_dir(spark, "x1")
    raw = fixture(spark, sf_dir, "usage_raw")
    day = F.date_format("event_at", "yyyy-MM-dd")
    middle = raw.where((day >= _FIRST) & (day < _SECOND))
    for rows in (middle, raw.where(day >= _SECOND), raw.where(day < _FIRST).unionByName(middle.where("id % 10 = 0"))):
        rows.write.mode("append").parquet(f"{base}/in")
        S.usage_stream(spark, f"{base}/in", f"{base}/usage", f"{base}/ckpt-x1", HOME_URL, LOCALES).awaitTermination()
    return f"{base}/usage"


def _land_usage(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    """Normalised request rows as files, in two arrivals of which the second
    holds the older days; returns the run folder and the schema."""
    base = _run_dir(spark, name)
    usage = normalise_usage(fixture(spark, sf_dir, "usage_raw"), HOME_URL)
    for rows in (usage.where(F.col("event_on") >= _FIRST), usage.where(F.col("event_on") < _FIRST)):
        rows.write.mode("append").parquet(f"{base}/in")
    return base, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in usage.schema)


_X1_COLS = ["id", "site_id", "token_id", "http_code", "request_uri", "event_on", "is_api", "is_file",
            "is_probe", "probe_reason"]


def _x1_oracle() -> str:
    p6 = REGISTRY["p6_classify_probe"].oracle
    body = p6[len(usage_ctes()):]
    return (usage_ctes() + body.replace("\nSELECT request_id, probe_reason IS NOT NULL AS is_probe",
                                        ", probe AS (SELECT request_id, probe_reason IS NOT NULL AS is_probe", 1)
            + ")\nSELECT u.id, u.site_id, u.token_id, u.http_code, u.request_uri, u.event_on, u.is_api, u.is_file,"
              " p.is_probe, p.probe_reason FROM usage u JOIN probe p ON p.request_id = u.id")


@register("x1_usage_stream", oracle=_x1_oracle())
def x1_usage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 (+M13, U1, P6): streaming ingest of every request row, de-duplicated on id."""
    return TableLog(spark, _ingest(spark, sf_dir)).table("usage").select(*_X1_COLS)


@register("x1_late_rows", oracle=usage_ctes() + f"""
SELECT id, event_on, (epoch_us(top) - epoch_us(event_at)) // 1000000 AS seconds_behind
  FROM usage, (SELECT max(event_at) AS top FROM usage) WHERE event_on < '{_FIRST}' AND top - event_at > INTERVAL 1 DAY
""")
def x1_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of requests that came more than a day behind the newest one then known."""
    late = TableLog(spark, _ingest(spark, sf_dir)).table("late")
    return late.select("id", F.date_format("event_at", "yyyy-MM-dd").alias("event_on"),
                       F.floor(F.expr("unix_micros(timestamp'1970-01-01 00:00:00' + behind) / 1000000")).alias("seconds_behind"))


_X2_ROWS = """
 FROM usage WHERE NOT is_deleted AND NOT is_api AND http_code BETWEEN 200 AND 299
"""
_X2_COUNTS = "COUNT(CASE WHEN NOT is_file THEN id END) AS pages, COUNT(CASE WHEN is_file THEN id END) AS files"
_X2_DISTINCT = """COUNT(DISTINCT CASE WHEN NOT is_file THEN token_id END) AS approx_cids,
       COUNT(DISTINCT CASE WHEN NOT is_file THEN coalesce(from_ip, '') || coalesce(agent, '') END) AS approx_page_agents,
       COUNT(DISTINCT CASE WHEN is_file THEN coalesce(from_ip, '') || coalesce(agent, '') END) AS approx_file_agents"""


def _daily(spark: SparkSession, sf_dir: str) -> str:
    base, schema = _land_usage(spark, sf_dir, "x2")
    S.usage_daily_stream(spark, f"{base}/in", f"{base}/daily", f"{base}/ckpt", schema, max_files_per_trigger=4).awaitTermination()
    return f"{base}/daily"


@register("x2_usage_daily_stream", oracle=usage_ctes() + f"SELECT site_id, event_on, {_X2_COUNTS}, {_X2_DISTINCT}" + _X2_ROWS + "GROUP BY site_id, event_on")
def x2_usage_daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming daily counters per site from stored sketches; the oracle counts
    exactly, as a sketch does up to some hundred distinct values a day and site."""
    return S.usage_daily(spark, _daily(spark, sf_dir))


@register("x2_usage_daily_counts", oracle=usage_ctes() + f"SELECT site_id, event_on, {_X2_COUNTS}" + _X2_ROWS + "GROUP BY site_id, event_on")
def x2_usage_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact page and file counters of the streaming daily report."""
    return S.usage_daily(spark, _daily(spark, sf_dir)).select("site_id", "event_on", "pages", "files")


@register("x2_usage_range", oracle=usage_ctes() + f"""
, e AS (SELECT site_id, {_X2_COUNTS}, {_X2_DISTINCT}""" + _X2_ROWS + """ AND event_on BETWEEN '2024-01-08' AND '2024-01-21' GROUP BY site_id)
SELECT site_id, pages, files, true AS cids_near, true AS page_agents_near, true AS file_agents_near FROM e
""")
def x2_usage_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks' counters and distinct visitors per site, from the daily sketches alone;
    the estimates are held against exact counts, within three standard errors."""
    est = S.usage_daily(spark, _daily(spark, sf_dir), ("site_id",), "2024-01-08", "2024-01-21")
    usage = normalise_usage(fixture(spark, sf_dir, "usage_raw"), HOME_URL).where(
        "NOT is_deleted AND NOT is_api AND http_code BETWEEN 200 AND 299 AND event_on BETWEEN '2024-01-08' AND '2024-01-21'")
    visitor = F.concat(F.coalesce("from_ip", F.lit("")), F.coalesce("agent", F.lit("")))
    exact = usage.groupBy("site_id").agg(
        F.countDistinct(F.when(~F.col("is_file"), F.col("token_id"))).alias("cids"),
        F.countDistinct(F.when(~F.col("is_file"), visitor)).alias("page_agents"),
        F.countDistinct(F.when(F.col("is_file"), visitor)).alias("file_agents"))
    error = 3 * 1.04 / 2 ** (S.SKETCH_LG_K / 2)
    near = [(F.abs(F.col(f"approx_{c}") - F.col(c)) <= F.col(c) * error).alias(f"{c}_near") for c in ("cids", "page_agents", "file_agents")]
    return est.withColumnRenamed("site_id", "_site").join(exact, F.col("_site").eqNullSafe(F.col("site_id"))).select("site_id", "pages", "files", *near)


SESSION_GAP_DAYS = 1


@register("x3_token_sessions", oracle=usage_ctes() + f"""
, t AS (SELECT token_id, event_at FROM usage WHERE token_id IS NOT NULL AND NOT is_deleted),
g AS (SELECT *, CASE WHEN lag(event_at) OVER w IS NULL OR event_at >= lag(event_at) OVER w + INTERVAL {SESSION_GAP_DAYS} DAY
                     THEN 1 ELSE 0 END AS new_session
        FROM t WINDOW w AS (PARTITION BY token_id ORDER BY event_at)),
s AS (SELECT *, sum(new_session) OVER (PARTITION BY token_id ORDER BY event_at ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT token_id, strftime(min(event_at), '%Y-%m-%d %H:%M:%S.%g') AS session_start,
       strftime(max(event_at) + INTERVAL {SESSION_GAP_DAYS} DAY, '%Y-%m-%d %H:%M:%S.%g') AS session_end,
       count(*) AS requests
  FROM s GROUP BY token_id, sid
""")
def x3_token_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle-expiring sessions (1-day gap) of every token in the ingested log."""
    base, schema = _land_usage(spark, sf_dir, "x3")
    S.token_sessions_stream(spark, f"{base}/in", f"{base}/sessions", f"{base}/ckpt", SESSION_GAP_DAYS, schema,
                            max_files_per_trigger=4).awaitTermination()
    out = S.token_sessions(spark, f"{base}/sessions")
    return out.select("token_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSS").alias("session_start"),
                      F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSS").alias("session_end"), "requests")


def _note_stream(spark: SparkSession, sf_dir: str) -> str:
    """Land note versions as files in three arrival slices and run X4."""
    base = _run_dir(spark, "x4")
    v = fixture(spark, sf_dir, "note_version")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = [F.col("version") == 0, F.col("version").between(1, 3), F.col("version") >= 4]
    for cond in slices:
        v.filter(cond).repartition(n, "note_id").write.mode("append").parquet(f"{base}/in")
    S.note_changes_stream(spark, f"{base}/in", f"{base}/notes", f"{base}/ckpt-x4", AS_OF, max_files_per_trigger=n).awaitTermination()
    return f"{base}/notes"


@register("x4_note_history", oracle=_M2_BASE + """
SELECT note_id, version, type, content, is_private FROM s
 WHERE nv IS NOT NULL AND (type <> nt OR content <> nc OR is_private <> np)
""")
def x4_note_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 (+M2): history rows written by the note change stream over all versions."""
    return S.note_history(spark, _note_stream(spark, sf_dir)).select("note_id", "version", "type", "content", "is_private")


@register("x4_note_current", oracle=_M2_BASE + """
SELECT note_id, version, type, content, is_private FROM s WHERE nv IS NULL
""")
def x4_note_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4 (+M2): current notes after the note change stream over all versions."""
    return S.current_notes(spark, _note_stream(spark, sf_dir)).select("note_id", "version", "type", "content", "is_private")


@register("x3_token_sessions_batch", oracle=REGISTRY["x3_token_sessions"].oracle)
def x3_token_sessions_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3 in batch: the same 1-day idle sessions computed with the skew-safe
    sessionizer over the normalised log (no streaming)."""
    usage = normalise_usage(fixture(spark, sf_dir, "usage_raw"), HOME_URL).filter(~F.col("is_deleted"))
    s = sessionize(usage, "token_id", "event_at", SESSION_GAP_DAYS * 86400)
    return s.select("token_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss.SSS").alias("session_start"),
                    F.date_format("session_end", "yyyy-MM-dd HH:mm:ss.SSS").alias("session_end"), "requests")
