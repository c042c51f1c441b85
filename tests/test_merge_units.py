from tessera.operators import merge as M


def test_meta_last_change_wins_and_blank_deletes(spark):
    parent = spark.createDataFrame([(1, False), (2, True)], "id int, is_deleted boolean")
    cur = spark.createDataFrame([(1, "a.b", "x", False)], "pid int, key string, value string, is_deleted boolean")
    chg = spark.createDataFrame([(1, "A.B", " y ", 1), (1, "a.b", "z", 2), (1, "a.c", "  ", 3), (1, "nodot", "v", 4),
                                 (2, "a.b", "q", 5)], "pid int, key string, value string, seq int")
    got = {(r.pid, r.key): (r.value, r.is_deleted) for r in M.merge_meta(cur, chg, parent, "pid", "2024-01-01").collect()}
    assert got == {(1, "a.b"): ("z", False), (1, "a.c"): ("", True)}


def test_history_has_every_step(spark):
    rows = [(1, 0, "note.normal", "a", False), (1, 1, "note.normal", "b", False), (1, 2, "note.normal", "b", False),
            (1, 3, "note.normal", "c", True)]
    df = spark.createDataFrame(rows, "note_id int, version int, type string, content string, is_private boolean")
    notes, hist = M.merge_notes(df.filter("version = 0"), df.filter("version > 0"), "2024-01-01")
    assert sorted(r.version for r in hist.collect()) == [0, 2]
    n = notes.first()
    assert (n.version, n.content, n.is_private) == (3, "c", True)


def test_active_url_newest_wins(spark):
    cur = spark.createDataFrame([(1, 10, "a", True, False, "2024-01-01"), (2, 10, "b", True, False, "2024-01-02")],
                                "id int, site_id int, url string, is_active boolean, is_deleted boolean, updated_at string") \
        .selectExpr("id", "site_id", "url", "is_active", "is_deleted", "CAST(updated_at AS TIMESTAMP) AS updated_at")
    chg = spark.createDataFrame([(3, 10, "C", True)], "id int, site_id int, url string, is_active boolean").selectExpr("*", "CAST(id AS LONG) AS seq")
    got = {r.id: r.is_active for r in M.enforce_active_url(cur, chg, "2024-02-01").collect()}
    assert got == {1: False, 2: False, 3: True}
