"""Usage-log jobs: row normalisation, daily site report, client ranking,
request classification and route parsing.

Every function takes and returns DataFrames and uses only built-in column
expressions (route parsing also uses array lambdas, which Spark evaluates
without code generation but still in the JVM); no Python runs here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import live


def _blank(c: Column) -> Column:
    """Template fields arrive as text; NULL and '' mean the same thing."""
    return F.coalesce(c, F.lit("")) == ""


def _cut_trim(c: Column, n: int) -> Column:
    """``TRIM(LEFT(x, n))`` — cut first, then trim (the stored order)."""
    return F.trim(F.left(c, F.lit(n)))


def normalise_usage(raw: DataFrame, home_url: str = "") -> DataFrame:
    """Turn raw request rows into stored usage rows.

    Applies the insert template rules (ids > 0 else NULL, status code range,
    defaults, length cuts, absolute run time) and then the before-insert
    rules (lower-case URI, short referrers dropped, API first then file
    flag, ``event_on`` = day of ``event_at``).  Optional ``platform``,
    ``browser`` and ``version`` columns are kept when present.
    """
    cols = set(raw.columns)

    def opt(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    referrer = F.col("referrer")
    if home_url:
        referrer = F.replace(F.try_url_decode(referrer), F.lit(home_url), F.lit(""))
    referrer = F.when(_blank(referrer), F.lit(None)).otherwise(_cut_trim(referrer, 1024))
    uri = F.lower(F.when(_blank(F.col("request_uri")), F.lit("/"))
                  .otherwise(_cut_trim(F.col("request_uri"), 512)))
    locale = F.col("locale_code")

    out = raw.select(
        F.col("id"),
        F.when(F.col("site_id") > 0, F.col("site_id")).cast("int").alias("site_id"),
        F.when(F.col("token_id") > 0, F.col("token_id")).cast("int").alias("token_id"),
        F.when(F.col("http_code").between(100, 599), F.col("http_code"))
         .otherwise(F.lit(200)).cast("smallint").alias("http_code"),
        F.when(_blank(F.col("request_type")), F.lit("GET"))
         .otherwise(_cut_trim(F.col("request_type"), 8)).alias("request_type"),
        uri.alias("request_uri"),
        F.when(F.length(F.coalesce(referrer, F.lit(""))) > 3, F.lower(referrer)).alias("referrer"),
        F.when(F.length(locale).between(2, 5), F.lower(_cut_trim(locale, 6))).alias("locale_code"),
        F.col("event_at"),
        F.date_format(F.col("event_at"), "yyyy-MM-dd").alias("event_on"),
        _cut_trim(F.coalesce(F.col("from_ip"), F.lit("")), 64).alias("from_ip"),
        F.when(_blank(F.col("agent")), F.lit(None)).otherwise(_cut_trim(F.col("agent"), 2048)).alias("agent"),
        F.when(_blank(opt("platform")), F.lit(None)).otherwise(_cut_trim(opt("platform"), 64)).alias("platform"),
        F.when(_blank(opt("browser")), F.lit("Unknown")).otherwise(_cut_trim(opt("browser"), 64)).alias("browser"),
        F.when(_blank(opt("version")), F.lit(None)).otherwise(_cut_trim(opt("version"), 64)).alias("version"),
        F.abs(F.col("seconds")).alias("seconds"),
        F.col("sqlops").cast("smallint").alias("sqlops"),
        F.when(_blank(opt("message")), F.lit(None)).otherwise(_cut_trim(opt("message"), 512)).alias("message"),
        F.coalesce(F.col("is_deleted"), F.lit(False)).alias("is_deleted"),
    )
    is_api = F.col("request_uri").like("%/api/%")
    is_file = ~is_api & (F.col("request_uri").like("%/file/%") | F.col("request_uri").like("%/files/%"))
    return out.withColumn("is_api", is_api).withColumn("is_file", is_file)


def _window_rows(usage: DataFrame, days: int, as_of: str, site_id: int | None) -> DataFrame:
    """Live, successful, non-API rows on or after ``as_of - days``.

    The day test is on ``event_on`` text (the stored rule); the equivalent
    ``event_at >= start of that day`` is added so the time range is pushed
    into the Parquet scan (row-group skipping, partition pruning)."""
    start_day = F.date_sub(F.to_date(F.lit(as_of)), days)
    start = F.date_format(start_day, "yyyy-MM-dd")
    cond = (~F.col("is_deleted")) & (~F.col("is_api")) & F.col("http_code").between(200, 299) \
        & (F.col("event_on") >= start)
    if "event_at" in usage.columns:
        cond = cond & (F.col("event_at") >= start_day.cast("timestamp"))
    if site_id is not None:
        cond = cond & (F.col("site_id") == F.lit(site_id))
    return usage.filter(cond)


def clamp_days(days: int | None, cap: int = 30, default: int = 14) -> int:
    """Report range rule: above the cap → cap, below 1 → default."""
    if days is None or days < 1:
        return default
    return min(days, cap)


def site_daily_stats(usage: DataFrame, as_of: str, days: int = 14,
                     site_id: int | None = None, sites: DataFrame | None = None) -> DataFrame:
    """A1: per-site daily page/file counts with a zero-filled calendar.

    ``usage`` is the normalised log (``normalise_usage``).  ``days`` follows
    the report rule (cap 30, default 14); the calendar holds ``days + 1``
    days ending at ``as_of``.  With ``site_id=None`` every site is reported
    and the calendar is crossed with the set of sites (``sites`` or, if not
    given, the distinct sites of ``usage``, for which the whole log is read);
    rows without a site are not reported.

    Plan: one pass over the window rows with map-side partial aggregation
    per (site, day); exact distinct counts use Spark's distinct-aggregate
    rewrite (the distinct values are shuffled by (site, day, value), which
    spreads a hot site over many tasks).  The calendar is generated per site
    with ``sequence`` (no join), and the two small sides are unioned and
    summed.
    """
    days = clamp_days(days)
    rows = _window_rows(usage, days, as_of, site_id)
    rows = rows.filter(F.col("site_id").isNotNull())
    page = ~F.col("is_file")
    visitor = F.concat(F.coalesce(F.col("from_ip"), F.lit("")), F.coalesce(F.col("agent"), F.lit("")))
    data = rows.groupBy("site_id", "event_on").agg(
        F.count(F.when(page, F.col("id"))).alias("pages"),
        F.count(F.when(F.col("is_file"), F.col("id"))).alias("files"),
        F.count_distinct(F.when(page, F.col("token_id"))).alias("cids"),
        F.count_distinct(F.when(page, visitor)).alias("page_agents"),
        F.count_distinct(F.when(F.col("is_file"), visitor)).alias("file_agents"),
    )
    if site_id is not None:
        site_keys = usage.sparkSession.range(1).select(F.lit(site_id).cast("int").alias("site_id"))
    elif sites is not None:
        site_keys = sites.select(F.col("site_id").cast("int")).distinct()
    else:
        site_keys = usage.select("site_id").filter(F.col("site_id").isNotNull()).distinct()
    end = F.to_date(F.lit(as_of))
    zeros = site_keys.select(
        "site_id",
        F.explode(F.sequence(F.date_sub(end, days), end)).alias("day"),
    ).select(
        "site_id",
        F.date_format("day", "yyyy-MM-dd").alias("event_on"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("pages", "files", "cids", "page_agents", "file_agents")],
    )
    out = data.unionByName(zeros).groupBy("site_id", "event_on").agg(
        *[F.sum(c).alias(c) for c in ("pages", "files", "cids", "page_agents", "file_agents")]
    )
    return out.select(
        "site_id", "event_on",
        F.unix_timestamp(F.to_timestamp(F.col("event_on"), "yyyy-MM-dd")).alias("event_unix"),
        "pages", "files", "cids", "page_agents", "file_agents",
    ).orderBy(F.col("event_on").desc(), F.col("site_id"))


def client_top_k(usage: DataFrame, as_of: str, days: int = 14, count: int = 10,
                 site_id: int | None = None, clients: DataFrame | None = None) -> DataFrame:
    """A2: pages and distinct visitors per client (token), top ``count`` per site.
    With ``clients`` (client_id, name, code) each ranked client carries its
    name and code, joined after the ranking.

    ``count`` follows the rule (cap 25, default 10) and ``days`` the report
    rule (cap 30, default 14).  Ranking is by pages desc, then client id.
    Per-(site, client) totals are pre-aggregated map-side; the per-site
    ``row_number() <= k`` filter is planned as a window group limit, so each
    map task ships at most k rows per site to the final ranking.
    """
    days = clamp_days(days)
    count = 10 if count is None or count <= 0 else min(count, 25)
    rows = _window_rows(usage, days, as_of, site_id).filter(
        ~F.col("is_file") & F.col("token_id").isNotNull())
    visitor = F.concat(F.coalesce(F.col("from_ip"), F.lit("")), F.coalesce(F.col("agent"), F.lit("")))
    per_client = rows.groupBy("site_id", F.col("token_id").alias("client_id")).agg(
        F.count("id").alias("pages"),
        F.count_distinct(visitor).alias("visitors"),
    )
    w = Window.partitionBy("site_id").orderBy(F.col("pages").desc(), F.col("visitors").desc(), F.col("client_id"))
    top = (per_client.withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= count)
           .select("site_id", "rank", "client_id", "pages", "visitors"))
    return top if clients is None else top.join(clients.select("client_id", "name", "code"), "client_id", "left")


# Blocked path segments, protected extensions and URI flags of
# the hostile-probe filter (must equal the reference's lists).
PROBE_SEGMENTS = [
    "phpmyadmin", "phpmyadm1n", "phpmy", "pass", "tools", "typo3", "xampp", "www", "web",
    "wp-admin", "wp-content", "wp-includes", "vendor", "config", "dockerfile",
    "storage", "logs", "log",
    ".aws", ".env", ".git", ".gitignore", ".ds_store", ".py", ".svn", ".vscode",
    ".dockerignore",
    "app.js", "config.js",
    "application.yml", "wlwmanifest.xml",
    "settings.yaml",
]
PROBE_EXTENSIONS = ["conf", "env", "ini", "php", "sql", "md"]
PROBE_FLAGS = ["../..", "0x"]


def classify_probe(df: DataFrame, segments_col: str = "pg_segments", uri_col: str = "request_uri") -> DataFrame:
    """Flag hostile probes; adds ``is_probe`` and ``probe_reason``.

    ``segments_col`` holds the routed path segments (``parse_route``);
    blocked words must equal one of the first four (root + three subs).
    Extensions and flags match anywhere in the lower-cased URI.
    """
    first4 = F.transform(F.slice(F.col(segments_col), 1, 4), lambda s: F.lower(F.trim(s)))
    uri = F.lower(F.trim(F.coalesce(F.col(uri_col), F.lit(""))))
    blocked = F.arrays_overlap(first4, F.array(*[F.lit(s) for s in PROBE_SEGMENTS]))
    ext = F.lit(False)
    for e in PROBE_EXTENSIONS:
        ext = ext | F.contains(uri, F.lit("." + e))
    flag = F.lit(False)
    for f in PROBE_FLAGS:
        flag = flag | F.contains(uri, F.lit(f))
    reason = (F.when(F.coalesce(blocked, F.lit(False)), F.lit("segment"))
              .when(ext, F.lit("extension")).when(flag, F.lit("flag")))
    return df.withColumn("probe_reason", reason).withColumn("is_probe", reason.isNotNull())


# First-segment routes and sub-domain routes.
ROUTE_FILTERS = ["api", "cdn", "files", "webhook"]
SUBDOMAIN_ROUTES = {"api": "api", "cdn": "cdn", "hooks": "hooks", "webhook": "hooks",
                    "webhooks": "hooks", "file": "files", "files": "files"}


def parse_route(df: DataFrame, locales: list[str], uri_col: str = "request_uri",
                host_col: str | None = None) -> DataFrame:
    """Request path → route, page root and sub-pages.

    Locale segments and blank segments are dropped, the query string is
    cut, the route comes from the host's first label when it names one,
    else from a first segment in ``ROUTE_FILTERS``, else ``web``.  Sub-page
    segments repeat-free: a segment already used as a value is skipped
    unless numeric.  Adds ``req_path``, ``route``, ``pg_root``, ``pg_sub``
    (array) and ``pg_segments`` (root followed by subs).
    """
    locs = F.array(*[F.lit(x.lower()) for x in locales]) if locales else F.array().cast("array<string>")
    parts = F.transform(F.split(F.coalesce(F.col(uri_col), F.lit("")), "/"), lambda p: F.lower(F.trim(p)))
    kept = F.filter(parts, lambda p: (F.length(p) > 0) & ~F.array_contains(locs, p))
    joined = F.array_join(kept, "/")
    no_query = F.split_part(joined, F.lit("?"), F.lit(1))
    segs = F.filter(F.split(no_query, "/"), lambda p: F.length(F.trim(p)) > 0)
    first = F.try_element_at(segs, F.lit(1))
    in_filters = F.coalesce(F.array_contains(F.array(*[F.lit(x) for x in ROUTE_FILTERS]), first), F.lit(False))
    if host_col:
        label = F.split_part(F.lower(F.trim(F.col(host_col))), F.lit("."), F.lit(1))
        sub_map = F.create_map(*[F.lit(x) for kv in SUBDOMAIN_ROUTES.items() for x in kv])
        by_host = F.try_element_at(sub_map, label)
    else:
        by_host = F.lit(None).cast("string")
    tmp = df.withColumn("_segs", segs).withColumn("_inf", in_filters)
    route = F.coalesce(by_host, F.when(F.col("_inf"), F.try_element_at("_segs", F.lit(1))), F.lit("web"))
    req_path = F.concat(F.lit("/"), F.coalesce(F.try_url_decode(F.array_join("_segs", "/")), F.array_join("_segs", "/")))
    root = F.try_url_decode(F.when(F.col("_inf"), F.try_element_at("_segs", F.lit(2)))
                            .otherwise(F.try_element_at("_segs", F.lit(1))))
    tmp = tmp.withColumn("req_path", req_path).withColumn("route", route).withColumn("pg_root", root)
    rest = F.slice(F.col("_segs"), F.when(F.col("_inf"), F.lit(3)).otherwise(F.lit(2)), 1 << 20)

    def step(acc, x):
        used = F.concat(acc, F.array(F.col("req_path"), F.col("route"), F.coalesce(F.col("pg_root"), F.lit(""))))
        keep = x.rlike("^[0-9]+(\\.[0-9]+)?$") | ~F.array_contains(used, x)
        return F.when(keep, F.array_append(acc, F.coalesce(F.try_url_decode(x), x))).otherwise(acc)

    subs = F.aggregate(rest, F.array().cast("array<string>"), step)
    out = tmp.withColumn("pg_sub", subs)
    out = out.withColumn("pg_segments", F.concat(F.array(F.coalesce(F.col("pg_root"), F.lit(""))), F.col("pg_sub")))
    return out.drop("_segs", "_inf")


def guid_from_path(df: DataFrame, subs_col: str = "pg_sub") -> DataFrame:
    """Right-most of the first nine sub-pages whose length is 36, else ''."""
    cands = F.filter(F.slice(F.col(subs_col), 1, 9), lambda s: F.length(F.trim(s)) == 36)
    return df.withColumn("guid", F.coalesce(F.trim(F.try_element_at(cands, F.lit(-1))), F.lit("")))


_IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"
_IPV6 = r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(([0-9a-fA-F]{1,4}:){0,7}[0-9a-fA-F]{0,4})?::(([0-9a-fA-F]{1,4}:){0,7}[0-9a-fA-F]{0,4})?)$"


def _valid_ip(c: Column) -> Column:
    return c.rlike(_IPV4) | c.rlike(_IPV6)


def client_ip(df: DataFrame, headers: tuple[str, ...] = ("cf_connecting_ip", "x_forwarded_for", "remote_addr")) -> DataFrame:
    """First header (in order) holding a valid IP; else
    ``Invalid IP (n Characters)`` with the longest trimmed header length
    among the headers present (NULL header = absent)."""
    picks = [F.when(F.col(h).isNotNull() & _valid_ip(F.col(h)), F.col(h)) for h in headers]
    lens = [F.coalesce(F.length(F.trim(F.col(h))), F.lit(0)) for h in headers]
    longest = F.greatest(*lens) if len(lens) > 1 else lens[0]
    fallback = F.concat(F.lit("Invalid IP ("), longest.cast("string"), F.lit(" Characters)"))
    return df.withColumn("client_ip", F.trim(F.coalesce(*picks, fallback)))


def sessionize(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Idle-gap sessions per key in batch: a new session starts when the
    previous event of the key is ``gap_seconds`` or more earlier.

    Skew-safe: the previous event comes from ``next_in_sequence`` over
    descending time and the session number from ``running_sum`` of session
    starts — both range-partition on (key, time), so a key with a third of
    all events is spread over many tasks — then one aggregate per session.
    Output: key, session_start, session_end (last event + gap), requests.
    """
    from tessera.operators.sequence import next_in_sequence, running_sum

    e = events.select(F.col(key), F.col(ts), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us")) \
        .filter(F.col(key).isNotNull())
    e = e.withColumn("_neg", -F.col("_us"))
    prev = next_in_sequence(e, key, "_neg", ["_us"], prefix="_prev")
    starts = prev.withColumn("_start", F.when(F.col("_prev_us").isNull()
                                              | (F.col("_us") - F.col("_prev_us") >= gap_seconds * 1_000_000), 1)
                             .otherwise(0).cast("long"))
    numbered = running_sum(starts, key, ["_us", "_neg"], "_start", "_sid")
    return (numbered.groupBy(key, "_sid")
            .agg(F.min(ts).alias("session_start"), F.max(ts).alias("_last"), F.count("*").alias("requests"))
            .select(key, "session_start",
                    (F.col("_last").cast("timestamp") + F.make_interval(secs=F.lit(gap_seconds))).alias("session_end"),
                    "requests"))
