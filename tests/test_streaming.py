import datetime as dt
import itertools
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tessera.fixtures import HOME_URL, fixture
from tessera.operators.usage import normalise_usage, sessionize
from tessera.plans.request_queries import LOCALES
from tessera.session import scratch_path
from tessera.streaming import jobs as S
from tessera.streaming.log import CommitConflict, TableLog

SF = "/root/testdata/sf0.001"


def _base(spark, name):
    return scratch_path(spark, f"t-{name}-{uuid.uuid4().hex[:8]}")


def _lose_commit(ckpt):
    """Take the last batch's commit from a stream's checkpoint: it is delivered again."""
    last = max(int(n) for n in os.listdir(f"{ckpt}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{ckpt}/commits/{name}"):
            os.remove(f"{ckpt}/commits/{name}")


# --------------------------------------------------------------- table log
def _rows(log, name="t", at=None):
    return sorted(tuple(r) for r in log.table(name, at).collect())


def _part(log, values, name="t"):
    return log.stage(name, log.spark.createDataFrame([(v,) for v in values], "v int"))


def test_log_reads_committed_parts_only(spark):
    log = TableLog(spark, _base(spark, "log"))
    assert log.head()["version"] == 0 and log.table("t") is None
    a, lost = _part(log, [1, 2]), _part(log, [9])
    first = log.commit(log.head(), [a], writer="w", batch=0)
    assert _rows(log) == [(1,), (2,)] and lost["part"] not in str(first)
    # the same batch again, from the version it saw at first: nothing is added
    assert log.commit({"version": 0, "tables": {}, "schemas": {}, "writers": {}, "marks": {}}, [lost], writer="w", batch=0)["version"] == 1
    second = log.commit(first, [_part(log, [3]), _part(log, [7], "u")], writer="w", batch=1, marks={"m": 5})
    assert _rows(log) == [(1,), (2,), (3,)] and _rows(log, "u") == [(7,)] and log.head()["marks"] == {"m": 5}
    assert _rows(log, at=log.version(1)) == [(1,), (2,)]  # as of the first version
    # a writer that stopped before it moved the pointer, and a pointer that is gone
    log._put("current", "1", replace=True)
    assert log.head() == second
    log._fs.delete(log._at("manifest", "current"), False)
    assert log.head() == second


def test_log_commits_of_two_writers(spark):
    log = TableLog(spark, _base(spark, "log"))
    for v in range(4):
        log.commit(log.head(), [_part(log, [v])], writer="w", batch=v)
    seen = log.head()
    merged = log.merge("t")  # beside a batch that started before it
    assert len(merged["tables"]["t"]) == 1
    after = log.commit(seen, [_part(log, [4])], writer="w", batch=4)
    assert after["version"] == merged["version"] + 1 and _rows(log) == [(0,), (1,), (2,), (3,), (4,)]
    with pytest.raises(CommitConflict):  # what it removes is gone
        log.commit(seen, [_part(log, [0, 1])], {"t": [p["part"] for p in seen["tables"]["t"][:2]]})
    with pytest.raises(CommitConflict):  # computed without the other stream's batch
        log.commit(seen, [_part(log, [5])], writer="other", batch=0)
    assert not log._put(f"{after['version']:020d}.json", "{}", replace=False)
    assert _rows(log) == [(0,), (1,), (2,), (3,), (4,)]


def test_log_merges_by_size_and_expires(spark):
    log = TableLog(spark, _base(spark, "log"))
    counts = []
    for v in range(30):
        log.commit(log.head(), [_part(log, range(100 * v, 100 * v + 100))], writer="w", batch=v)
        log.merge("t")
        counts.append(len(log.head()["tables"]["t"]))
    assert max(counts) <= 9 and _rows(log) == [(v,) for v in range(3000)]
    assert log.expire(keep=2) > 20 and log.expire(keep=2) == 0
    assert _rows(log) == [(v,) for v in range(3000)]
    assert log.version(1) is None and log.head()["version"] > 30
    folders = [d for d in os.listdir(f"{log.path.removeprefix('file:')}/data/t") if d.startswith("part=")]
    kept = {p["part"] for n in (0, 1) for p in log.version(log.head()["version"] - n)["tables"]["t"]}
    assert {f"part={p}" for p in kept} == set(folders)


# ---------------------------------------------------------------------- X1
def test_usage_stream_in_any_order_is_exactly_once(spark):
    base = _base(spark, "x1")
    raw = fixture(spark, SF, "usage_raw").cache()
    order = [raw.where("id % 3 = 1 AND event_at >= '2024-01-10'"), raw.where("id % 3 = 0"),
             raw.where("id % 3 = 2 OR id % 3 = 1 AND event_at < '2024-01-10' OR id % 30 = 0")]  # some for the second time

    def run():
        S.usage_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", HOME_URL, LOCALES).awaitTermination()

    for k, rows in enumerate(order):
        rows.write.mode("append").parquet(f"{base}/in")
        run()
        if k == 1:  # delivered again, before and after a compaction
            _lose_commit(f"{base}/ck")
            run()
            S.compact(spark, f"{base}/out")
            _lose_commit(f"{base}/ck")
            run()
    run()  # nothing new
    want = normalise_usage(raw, HOME_URL)
    cols = ["id", "site_id", "token_id", "http_code", "request_uri", "event_on", "is_api", "is_file"]
    got = TableLog(spark, f"{base}/out").table("usage")
    assert got.count() == want.count() == raw.count()
    assert got.select(*cols).exceptAll(want.select(*cols)).isEmpty()
    late = TableLog(spark, f"{base}/out").table("late")
    top = raw.where("id % 3 = 1 AND event_at >= '2024-01-10'").agg(F.max("event_at")).first()[0]
    seen = {r.id for r in raw.collect() if r.id % 3 == 0 and top - r.event_at > dt.timedelta(days=1)}
    assert seen and seen <= {r.id for r in late.collect()} and late.where("id % 30 = 0").count() == sum(i % 30 == 0 for i in seen)


def test_usage_stream_parses_each_agent_once(spark, monkeypatch):
    """Agents are parsed in the batch, once each and not once a row and a job, and
    the rows of a single file are dealt out before."""
    base, seen, parse = _base(spark, "x1a"), [], S.parse_user_agent

    def parsed(df, col, distinct=False):
        seen.append((df.isStreaming, distinct, "RepartitionByExpression" in df._jdf.queryExecution().logical().toString()))
        return parse(df, col, distinct)

    monkeypatch.setattr(S, "parse_user_agent", parsed)
    raw = fixture(spark, SF, "usage_raw").limit(100)
    raw.coalesce(1).write.parquet(f"{base}/in")
    S.usage_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", HOME_URL, LOCALES).awaitTermination()
    assert seen == [(False, True, True)]
    got = TableLog(spark, f"{base}/out").table("usage").select("id", "platform", "browser", "version")
    want = normalise_usage(parse(raw, "agent"), HOME_URL).select("id", "platform", "browser", "version")
    assert got.count() == 100 and got.exceptAll(want).isEmpty()


def test_usage_stream_nulls_and_conflicts(spark):
    base = _base(spark, "x1")
    raw = fixture(spark, SF, "usage_raw").limit(1)
    at = lambda day: F.to_timestamp(F.lit(f"2024-01-{day} 10:00:00"))
    rows = [raw.withColumn("id", F.lit(None).cast("long")), raw.withColumn("id", F.lit(None).cast("long")),
            raw.withColumns({"id": F.lit(5).cast("long"), "event_at": at("02"), "request_uri": F.lit("/a")}),
            raw.withColumns({"id": F.lit(5).cast("long"), "event_at": at("02") + F.expr("INTERVAL 1 HOUR"), "request_uri": F.lit("/b")}),
            raw.withColumns({"id": F.lit(5).cast("long"), "event_at": at("03"), "request_uri": F.lit("/c")})]
    for r in rows[:4]:
        r.write.mode("append").parquet(f"{base}/in")
    for more in (None, rows[4]):
        if more is not None:
            more.write.mode("append").parquet(f"{base}/in")
        S.usage_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck").awaitTermination()
    got = TableLog(spark, f"{base}/out").table("usage").collect()
    assert sorted(r.request_uri for r in got if r.id == 5) == ["/a", "/c"] and sum(r.id is None for r in got) == 2


# ---------------------------------------------------------------------- X2
_USAGE = ("id long, site_id int, token_id int, http_code int, event_on string, event_at timestamp, from_ip string, agent string, "
          "is_api boolean, is_file boolean, is_deleted boolean")


def test_daily_sketches_merge_over_batches_and_days(spark):
    base = _base(spark, "x2")
    n = 60_000
    rows = spark.range(n).selectExpr(
        "id", "1 AS site_id", "CAST(id % 20000 AS INT) AS token_id", "200 AS http_code", "concat('2024-01-0', id % 5 + 1) AS event_on",
        "timestamp'2024-01-01 00:00:00' AS event_at", "CAST(id % 30000 AS STRING) AS from_ip", "CAST(NULL AS STRING) AS agent",
        "false AS is_api", "id % 4 = 3 AS is_file", "false AS is_deleted")
    for day in (3, 1, 5, 4, 2):  # days out of order, each a file or more
        rows.where(f"event_on = '2024-01-0{day}'").coalesce(2).write.mode("append").parquet(f"{base}/in")
    S.usage_daily_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", _USAGE, max_files_per_trigger=1).awaitTermination()
    assert len(TableLog(spark, f"{base}/out").head()["tables"]["daily"]) < 10  # merged on the way
    daily = S.usage_daily(spark, f"{base}/out").collect()
    assert sorted((r.event_on, r.pages, r.files) for r in daily) == [(f"2024-01-0{d}", 9000, 3000) for d in range(1, 6)]
    whole = S.usage_daily(spark, f"{base}/out", ("site_id",)).first()
    exact = rows.where("NOT is_file").agg(F.countDistinct("token_id"), F.countDistinct("from_ip")).first()
    assert (whole.pages, whole.files) == (45_000, 15_000)
    for got, want in zip((whole.approx_cids, whole.approx_page_agents), exact, strict=True):
        assert abs(got - want) <= 3 * 1.04 / 64 * want
    part = S.usage_daily(spark, f"{base}/out", ("site_id",), "2024-01-02", "2024-01-03").first()
    assert part.pages == 18_000


# ---------------------------------------------------------------------- X3
def _sessions(df):
    return sorted((r.token_id, str(r.session_start), str(r.session_end), r.requests) for r in df.collect())


def test_sessions_with_a_hot_token_equal_the_batch_job(spark):
    base, rnd = _base(spark, "x3"), random.Random(2)
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=rnd.randrange(40 * 86_400)), False) for _ in range(3000)]  # half of all rows
    rows += [(rnd.randrange(2, 60), start + dt.timedelta(seconds=rnd.randrange(40 * 86_400)), rnd.random() < 0.05) for _ in range(3000)]
    rows += [(70, start + dt.timedelta(days=k), False) for k in (3, 4, 6)] + [(None, start, False)]  # exactly the limit apart
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "token_id int, event_at timestamp, is_deleted boolean")
    for k in range(4):
        df.where(F.pmod(F.xxhash64("event_at"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    S.token_sessions_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", 1, "token_id int, event_at timestamp, is_deleted boolean",
                            max_files_per_trigger=1).awaitTermination()
    want = sessionize(df.where("NOT is_deleted"), "token_id", "event_at", 86_400)
    assert _sessions(S.token_sessions(spark, f"{base}/out")) == _sessions(want)
    assert TableLog(spark, f"{base}/out").table("slots").where("token_id = 1").count() <= 4 * 41  # a row a slot and batch
    S.compact(spark, f"{base}/out")
    assert _sessions(S.token_sessions(spark, f"{base}/out")) == _sessions(want)
    closed = S.token_sessions(spark, f"{base}/out", "2024-01-05 00:00:00").where("token_id = 70")
    assert [(str(r.first_seen), r.requests) for r in closed.collect()] == [("2024-01-04 00:00:00", 1)]


def test_sessions_merge_when_events_arrive_out_of_order(spark):
    base = _base(spark, "x3")
    for part in (["2024-01-03 12:00:00", "2024-01-05 06:00:00"], ["2024-01-04 08:00:00"]):
        spark.createDataFrame([(7, t, False) for t in part], "token_id int, event_at string, is_deleted boolean") \
            .selectExpr("token_id", "CAST(event_at AS TIMESTAMP) AS event_at", "is_deleted").coalesce(1).write.mode("append").parquet(f"{base}/in")
        S.token_sessions_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", 1,
                                "token_id int, event_at timestamp, is_deleted boolean").awaitTermination()
    got = [(r.token_id, str(r.first_seen), str(r.last_seen), r.requests) for r in S.token_sessions(spark, f"{base}/out").collect()]
    assert got == [(7, "2024-01-03 12:00:00", "2024-01-05 06:00:00", 3)]


# ---------------------------------------------------------------------- X4
def _versions(spark, rows, path):
    spark.createDataFrame(rows, S.NOTE_VERSION_SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("steps", sorted(set(itertools.permutations(["lose", "compact", "lose"]))) + [("compact", "compact", "lose")])
def test_note_stream_keeps_every_note_and_state(spark, steps):
    """A batch whose commit is lost is delivered again, and the log is compacted,
    in any order between two batches: no note and no state of one goes."""
    base = _base(spark, "x4")

    def run():
        S.note_changes_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", "2024-01-01").awaitTermination()

    def history():
        return sorted((r.note_id, r.version, r.content) for r in S.note_history(spark, f"{base}/out").collect())

    def now():
        return {r.note_id: r.content for r in S.current_notes(spark, f"{base}/out").collect()}

    _versions(spark, [(1, 1, "note.normal", "A", False), (2, 1, "note.normal", "x", False)], f"{base}/in")
    run()
    guid = S.current_notes(spark, f"{base}/out").where("note_id = 1").first().guid
    _versions(spark, [(1, 2, "note.normal", "B", False)], f"{base}/in")
    run()
    for step in steps:
        if step == "compact":
            S.compact(spark, f"{base}/out", keep_versions=1)
        else:
            _lose_commit(f"{base}/ck")
            run()
        assert now() == {1: "B", 2: "x"} and history() == [(1, 1, "A")]
    _versions(spark, [(1, 3, "note.normal", "C", False), (3, 1, "note.normal", "new", False)], f"{base}/in")
    run()
    assert now() == {1: "C", 2: "x", 3: "new"} and history() == [(1, 1, "A"), (1, 2, "B")]
    assert S.current_notes(spark, f"{base}/out").where("note_id = 1").first().guid == guid


def test_note_stream_that_stops_before_its_commit(spark, monkeypatch):
    base = _base(spark, "x4")
    _versions(spark, [(1, 1, "note.normal", "A", False)], f"{base}/in")
    S.note_changes_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", "2024-01-01").awaitTermination()
    _versions(spark, [(1, 2, "note.normal", "B", False)], f"{base}/in")
    with monkeypatch.context() as m:
        m.setattr(TableLog, "commit", lambda *a, **k: 1 / 0)  # both parts are written, nothing is committed
        with pytest.raises(Exception, match="division"):
            S.note_changes_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", "2024-01-01").awaitTermination()
    assert [r.content for r in S.current_notes(spark, f"{base}/out").collect()] == ["A"]
    S.note_changes_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ck", "2024-01-01").awaitTermination()
    assert [r.content for r in S.current_notes(spark, f"{base}/out").collect()] == ["B"]
    assert [r.content for r in S.note_history(spark, f"{base}/out").collect()] == ["A"]
    assert [r.content for r in S.current_notes(spark, f"{base}/out", version=1).collect()] == ["A"]  # as of then
