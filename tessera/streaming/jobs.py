"""Structured Streaming jobs (X1–X4) over file sources.

Every job reads a file source with an explicit schema and a checkpoint, and
writes through ``foreachBatch`` to a ``TableLog`` (see ``log.py``): a batch is
committed once, however often it is delivered, and small parts are merged as
the log grows.  None of them needs a watermark for right results: X1 looks up
the days a batch touches, X2 and X3 store partial results that merge in any
order, so input in any order gives what the batch jobs give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.useragent import parse_user_agent
from tessera.operators.merge import merge_notes
from tessera.operators.usage import classify_probe, normalise_usage, parse_route
from tessera.streaming.log import TableLog

USAGE_RAW_SCHEMA = (
    "id long, site_id int, token_id int, http_code int, request_type string, request_uri string, "
    "referrer string, locale_code string, event_at timestamp, from_ip string, agent string, "
    "seconds decimal(16,8), sqlops int, is_deleted boolean"
)
NOTE_VERSION_SCHEMA = "note_id int, version int, type string, content string, is_private boolean"


def _reader(spark: SparkSession, schema: str | None, max_files_per_trigger: int | None):
    reader = spark.readStream
    if schema:
        reader = reader.schema(schema)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader


def _start(rows: DataFrame, log: TableLog, ckpt: str, apply: Callable[[DataFrame, dict], tuple[list[dict], dict]],
           after: Callable[[], None], trigger_once: bool) -> StreamingQuery:
    """Run ``apply(batch, head)``, which stages parts and returns them with the
    new marks, for each batch that is not committed yet, and commit; then
    ``after``, which merges small parts."""
    def each(batch: DataFrame, batch_id: int) -> None:
        head, writer = log.head(), log.writer(ckpt)
        if log.done(head, writer, batch_id):
            return
        parts, marks = apply(batch, head)
        log.commit(head, parts, writer=writer, batch=batch_id, marks=marks)
        after()

    out = rows.writeStream.foreachBatch(each).option("checkpointLocation", ckpt)
    return (out.trigger(availableNow=True) if trigger_once else out.trigger(processingTime="30 seconds")).start()


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key of a table whose rows carry ``seq`` (``max_by``:
    partial aggregation, no window)."""
    vals = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*vals), "seq").alias("_r")).select(*keys, "_r.*")


# ----------------------------------------------------------------------- X1
def usage_stream(spark: SparkSession, src: str, out: str, ckpt: str, home_url: str = "",
                 locales: list[str] | None = None, late_after: str = "1 day",
                 max_files_per_trigger: int | None = None, trigger_once: bool = True) -> StreamingQuery:
    """Raw request files → stored usage rows (M13) with user-agent
    fields (U1) and probe flags (P6/P7), once per id, in the log at ``out``:
    table ``usage``, partitioned by day, and table ``late`` (id, event_at,
    behind: how long before the newest event then known) of the rows that came
    more than ``late_after`` behind.  Late rows are stored like others.

    Rows of one id on one day are one request delivered again: the first stays,
    in one batch the earliest.  A batch reads the ids of the days it touches
    and no others (partition pruning by a list of days), so its cost does not
    grow with the age of the log.  Rows without an id are all kept.

    A batch's rows are dealt out before they are parsed, however few files they
    came in, and each different user agent is parsed once."""
    log = TableLog(spark, out)
    raw = _reader(spark, USAGE_RAW_SCHEMA, max_files_per_trigger).parquet(src)

    def apply(arrived: DataFrame, head: dict) -> tuple[list[dict], dict]:
        rows = normalise_usage(parse_user_agent(arrived.repartition("id", "event_at"), "agent", distinct=True), home_url)
        batch = classify_probe(parse_route(rows, locales or [], "request_uri"))
        batch = batch.drop("req_path", "route", "pg_root", "pg_sub", "pg_segments")
        keys = ["id", "event_on"]
        alone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
        rest = [c for c in batch.columns if c not in keys]
        first = F.min_by(F.struct(*rest), F.struct("event_at", F.xxhash64(*rest)))
        new = batch.groupBy(*keys, alone.alias("_alone")).agg(first.alias("_r")).select(*keys, "_r.*")
        seen = log.table("usage", head)
        if seen is not None:
            day = F.date_format("event_at", "yyyy-MM-dd").alias("event_on")  # as M13 has it
            days = [r.event_on for r in arrived.select(day).distinct().collect()]  # one row a day
            seen = seen.where(F.col("event_on").isin([d for d in days if d]) | F.lit(None in days) & F.col("event_on").isNull())
            known = seen.select(F.col("id").alias("_id"), F.col("event_on").alias("_on"))
            new = new.join(known, (F.col("id") == F.col("_id")) & F.col("event_on").eqNullSafe(F.col("_on")), "left_anti")
        part = log.stage("usage", new, ["event_on"])
        stored, parts, high = log.staged(part), [part], head["marks"].get("event_at")
        if high is not None:
            behind = F.timestamp_micros(F.lit(high)) - F.col("event_at").cast("timestamp")
            late = stored.select("id", "event_at", behind.alias("behind")).where(F.col("behind") > F.expr(f"INTERVAL {late_after}"))
            parts.append(log.stage("late", late))
        top = stored.agg(F.max(F.unix_micros(F.col("event_at").cast("timestamp")))).first()[0]  # one number
        return parts, {"event_at": max(x for x in (top, high) if x is not None)} if (top, high) != (None, None) else {}

    def after() -> None:
        log.merge("usage", partition_by=["event_on"])
        log.merge("late")

    return _start(raw, log, ckpt, apply, after, trigger_once)


# ----------------------------------------------------------------------- X2
#: log2 of a sketch's buckets: a standard error of 1.04 / sqrt(4096) = 1.6 %;
#: small counts (some hundreds) are exact.
SKETCH_LG_K = 12
_COUNTS, _SKETCHES = ["pages", "files"], ["cids", "page_agents", "file_agents"]


def usage_daily_partials(usage: DataFrame) -> DataFrame:
    """Per site and day: page and file counts, and sketches of the distinct
    clients and visitors, which merge over batches and over days."""
    rows = usage.filter(~F.col("is_deleted") & ~F.col("is_api") & F.col("http_code").between(200, 299))
    visitor = F.concat(F.coalesce("from_ip", F.lit("")), F.coalesce("agent", F.lit("")))
    page, file = ~F.col("is_file"), F.col("is_file")
    sketch = lambda c: F.hll_sketch_agg(c, F.lit(SKETCH_LG_K))
    return rows.groupBy("site_id", "event_on").agg(
        F.count(F.when(page, F.col("id"))).alias("pages"), F.count(F.when(file, F.col("id"))).alias("files"),
        sketch(F.when(page, F.col("token_id"))).alias("cids"), sketch(F.when(page, visitor)).alias("page_agents"),
        sketch(F.when(file, visitor)).alias("file_agents"))


def merge_partials(partials: DataFrame, by: list[str]) -> DataFrame:
    """Partials of ``usage_daily_partials`` merged by any of their keys."""
    return partials.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _COUNTS], *[F.hll_union_agg(c).alias(c) for c in _SKETCHES])


def with_estimates(partials: DataFrame) -> DataFrame:
    """Sketches replaced by the ``approx_`` numbers they stand for."""
    return partials.select(*[c for c in partials.columns if c not in _SKETCHES], *[F.hll_sketch_estimate(c).alias(f"approx_{c}") for c in _SKETCHES])


def usage_daily_stream(spark: SparkSession, src: str, out: str, ckpt: str, schema: str | None = None,
                       max_files_per_trigger: int | None = None, trigger_once: bool = True) -> StreamingQuery:
    """Streaming daily site counters.  Each batch adds its partials to
    table ``daily`` of the log at ``out``; no state is kept in the stream, and
    a row of any age counts for its day.  ``usage_daily`` reads them back."""
    log = TableLog(spark, out)
    by = ["site_id", "event_on"]
    return _start(_reader(spark, schema, max_files_per_trigger).parquet(src), log, ckpt,
                  lambda batch, head: ([log.stage("daily", usage_daily_partials(batch))], {}),
                  lambda: log.merge("daily", lambda rows: merge_partials(rows, by)), trigger_once)


def usage_daily(spark: SparkSession, out: str, by: tuple[str, ...] = ("site_id", "event_on"),
                first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """X2 read back: counters and estimated distincts per site and day, or per
    site over a range of days (``by=("site_id",)``) from the same sketches."""
    rows = TableLog(spark, out).table("daily")
    if first_day:
        rows = rows.where(F.col("event_on") >= first_day)
    if last_day:
        rows = rows.where(F.col("event_on") <= last_day)
    return with_estimates(merge_partials(rows, list(by)))


# ----------------------------------------------------------------------- X3
def session_partials(usage: DataFrame, lifespan_days: int) -> DataFrame:
    """Requests of a token in one slot of time of a session's idle limit:
    first, last and number.  Two requests in one slot are less than the limit
    apart, so a slot lies in one session, whatever lies between them; a hot
    token's requests come down to a row a slot before anything is shuffled."""
    slot = F.floor(F.unix_micros(F.col("event_at").cast("timestamp")) / F.lit(lifespan_days * 86_400_000_000))
    rows = usage.filter(F.col("token_id").isNotNull() & ~F.col("is_deleted"))
    return rows.groupBy("token_id", slot.alias("slot")).agg(
        F.min("event_at").alias("first_seen"), F.max("event_at").alias("last_seen"), F.count("*").alias("requests"))


def merge_sessions(partials: DataFrame) -> DataFrame:
    """Session partials of the same token and slot merged."""
    return partials.groupBy("token_id", "slot").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("requests").alias("requests"))


def join_sessions(partials: DataFrame, lifespan_days: int) -> DataFrame:
    """Sessions from partials: slots of a token are joined while the pause
    between them is below the limit.  A token has at most one row a slot, so its
    window grows with time only, not with its requests."""
    from pyspark.sql import Window

    gap = F.make_interval(days=F.lit(lifespan_days))
    w = Window.partitionBy("token_id").orderBy("slot")
    before = F.lag("last_seen").over(w)
    starts = F.when(before.isNull() | (F.col("first_seen") >= before + gap), 1).otherwise(0)
    rows = merge_sessions(partials).withColumn("_new", starts)
    rows = rows.withColumn("_sid", F.sum("_new").over(w))
    return rows.groupBy("token_id", "_sid").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("requests").alias("requests")).select(
        "token_id", F.col("first_seen").alias("session_start"), (F.col("last_seen") + gap).alias("session_end"), "requests", "first_seen", "last_seen")


def token_sessions_stream(spark: SparkSession, src: str, out: str, ckpt: str, lifespan_days: int = 120, schema: str | None = None,
                          max_files_per_trigger: int | None = None, trigger_once: bool = True) -> StreamingQuery:
    """Idle-expiring sessions per token.  Each batch adds its partials to
    table ``slots`` of the log at ``out``; ``token_sessions`` joins them."""
    log = TableLog(spark, out)
    return _start(_reader(spark, schema, max_files_per_trigger).parquet(src), log, ckpt,
                  lambda batch, head: ([log.stage("slots", session_partials(batch, lifespan_days))], {"lifespan_days": lifespan_days}),
                  lambda: log.merge("slots", merge_sessions), trigger_once)


def token_sessions(spark: SparkSession, out: str, closed_by: str | None = None) -> DataFrame:
    """X3 read back: token_id, session_start, session_end (last request and the
    limit), requests, first_seen, last_seen; with ``closed_by`` only sessions
    that had ended by then."""
    log = TableLog(spark, out)
    head = log.head()
    found = join_sessions(log.table("slots", head), head["marks"]["lifespan_days"])
    return found if closed_by is None else found.where(F.col("session_end") <= F.to_timestamp(F.lit(closed_by)))


# ----------------------------------------------------------------------- X4
NOTE_BUCKETS = 64


def _note_bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(NOTE_BUCKETS)).cast("int")


def note_changes_stream(spark: SparkSession, src: str, out: str, ckpt: str, as_of: str,
                        max_files_per_trigger: int | None = None, trigger_once: bool = True) -> StreamingQuery:
    """Note version files → current notes and history (M2 per batch), as
    tables ``current`` and ``history`` of the log at ``out``.

    For each batch the rows that earlier versions of the log hold for the
    touched notes are read, M2 runs on them and the new versions, and the new
    current rows (with ``seq``, the version they were computed for) and the
    history rows are committed together.  Compaction changes no row, so it and
    repeated batches may come in any order.

    ``current`` is laid out by hash bucket of note_id, and a batch reads only
    the buckets it touches (a list of at most ``NOTE_BUCKETS`` numbers)."""
    log = TableLog(spark, out)

    def apply(batch: DataFrame, head: dict) -> tuple[list[dict], dict]:
        batch = batch.withColumn("bucket", _note_bucket(F.col("note_id"))).persist()
        try:
            keep = ["version", "type", "content", "is_private", "guid", "seq"]
            rows = log.table("current", head)
            if rows is None:
                prev = spark.createDataFrame([], NOTE_VERSION_SCHEMA + ", guid string")
            else:
                buckets = [r.bucket for r in batch.select("bucket").distinct().collect()]
                touched = rows.where(F.col("bucket").isin(buckets)).join(batch.select("note_id").distinct(), "note_id", "left_semi")
                prev = newest(touched.select("note_id", *keep), ["note_id"]).drop("seq")
            notes, history = merge_notes(prev, batch.drop("bucket"), as_of)
            notes = notes.withColumn("seq", F.lit(head["version"] + 1)).withColumn("bucket", _note_bucket(F.col("note_id")))
            return [log.stage("current", notes, ["bucket"]), log.stage("history", history)], {}
        finally:
            batch.unpersist()

    def after() -> None:
        log.merge("current", _newest_notes, ["bucket"])
        log.merge("history")

    return _start(_reader(spark, NOTE_VERSION_SCHEMA, max_files_per_trigger).parquet(src), log, ckpt, apply, after, trigger_once)


def _newest_notes(rows: DataFrame) -> DataFrame:
    return newest(rows, ["note_id"])


def current_notes(spark: SparkSession, out: str, version: int | None = None) -> DataFrame:
    """X4 read back: one row per note, as of the newest or an older version of the log."""
    log = TableLog(spark, out)
    return _newest_notes(log.table("current", log.version(version) if version else None)).drop("seq", "bucket")


def note_history(spark: SparkSession, out: str) -> DataFrame:
    """X4 read back: the replaced states of all notes."""
    return TableLog(spark, out).table("history")


def compact(spark: SparkSession, out: str, keep_versions: int = 10) -> None:
    """Merge all parts of every table of a log into one each, current notes
    with only their newest rows, and delete what only older versions need."""
    log = TableLog(spark, out)
    folds: dict[str, tuple] = {"current": (_newest_notes, ["bucket"]), "usage": (None, ["event_on"]),
                               "daily": (lambda rows: merge_partials(rows, ["site_id", "event_on"]), []), "slots": (merge_sessions, [])}
    for name in log.head()["tables"]:
        fold, layout = folds.get(name, (None, []))
        log.merge(name, fold, layout, whole=True)
    log.expire(keep_versions)
