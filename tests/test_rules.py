"""Hand cases of permission rules and of requests that meet in one batch."""

from tessera.operators import catalog as C
from tessera.operators import merge as M

ACCT = [(1, "account.basic", True), (2, "account.basic", False), (3, "account.admin", False), (4, "account.admin", True)]
NOW = "2024-02-01 00:00:00"


def _acct(spark):
    return spark.createDataFrame(ACCT, "id int, type string, is_deleted boolean")


def _got(df, *cols):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.select(*cols).collect()}


def test_only_live_accounts_edit_notes(spark):
    note = spark.createDataFrame([(9, 1, False, False), (8, 2, True, False)], "id int, updated_by int, is_private boolean, is_deleted boolean")
    hist = spark.createDataFrame([(9, 2, False), (8, 1, False)], "note_id int, updated_by int, is_deleted boolean")
    pairs = spark.createDataFrame([(a, n) for a in (1, 2, 3, 4, 77) for n in (8, 9)], "account_id int, note_id int")
    got = _got(C.note_can_edit(pairs, _acct(spark), note, hist), "account_id", "note_id", "can_edit")
    assert {k for k, v in got.items() if v} == {(2, 9), (2, 8), (3, 8), (3, 9)}


def test_files_deleted_expired_and_new(spark):
    files = spark.createDataFrame([(5, 1, None, True), (6, 2, "2024-01-31", False), (7, 2, NOW, False)],
                                  "id int, account_id int, expires_at string, is_deleted boolean") \
        .selectExpr("id", "account_id", "CAST(expires_at AS TIMESTAMP) AS expires_at", "is_deleted")
    pairs = spark.createDataFrame([(a, f) for a in (1, 2, 3) for f in (None, 0, 5, 6, 7, 99)], "account_id int, file_id int")
    got = _got(C.file_can_edit(pairs, _acct(spark), files, NOW), "account_id", "file_id", "can_edit")
    assert {k for k, v in got.items() if v} == {(2, None), (2, 0), (2, 7), *((3, f) for f in (None, 0, 5, 6, 7, 99))}


def test_private_notes_need_a_live_viewer(spark):
    note = spark.createDataFrame([(9, 1, True, False), (8, 2, True, False)], "id int, updated_by int, is_private boolean, is_deleted boolean")
    req = spark.createDataFrame([(v, n) for v in (1, 2, 3, 4) for n in (8, 9)], "viewer_id int, note_id int")
    got = _got(C.visible_to(note, req, _acct(spark)), "viewer_id", "note_id", "can_read")
    assert {k for k, v in got.items() if v} == {(2, 8), (3, 8), (3, 9)}


def test_an_admin_updates_an_expired_file(spark):
    guid = "g" * 36
    files = spark.createDataFrame([(6, 2, "2024-01-31", False, guid)], "id int, account_id int, expires_at string, is_deleted boolean, guid string") \
        .selectExpr("id", "account_id", "CAST(expires_at AS TIMESTAMP) AS expires_at", "is_deleted", "guid")
    reqs = spark.createDataFrame([(n, a, guid, "local", "public", "p", 10, "image/png", None, "private", "h") for n, a in ((1, 3), (2, 2), (3, 4))],
                                 "request_id long, account_id int, file_guid string, local_name string, file_name string, path string, bytes long, "
                                 "mimetype string, expires_at string, access string, file_hash string")
    out = {r.request_id: (r.action, r.name, r.public_name) for r in M.register_files(reqs, _acct(spark), files, NOW).collect()}
    assert out == {1: ("update", None, "public"), 2: ("reject", None, "public"), 3: ("reject", None, "public")}


def test_last_change_of_a_url_by_sequence(spark):
    cur = spark.createDataFrame([(1, 1, "a.example", True, False, "2024-01-01")], "id int, site_id int, url string, is_active boolean, is_deleted boolean, t string") \
        .selectExpr("id", "site_id", "url", "is_active", "is_deleted", "CAST(t AS TIMESTAMP) AS updated_at")
    for order in (1, -1):
        rows = [(5, 1, "b.example", True, 1), (5, 1, "c.example", True, 2)][::order]
        chg = spark.createDataFrame(rows, "id int, site_id int, url string, is_active boolean, seq long")
        got = {r.id: (r.url, r.is_active) for r in M.enforce_active_url(cur, chg, NOW).collect()}
        assert got == {1: ("a.example", False), 5: ("c.example", True)}


def test_claims_in_the_order_of_requests(spark):
    rows = [(1, "a", "x@mail"), (2, "b", "x@mail"), (3, "b", "y@mail"), (4, "c", "y@mail"), (5, "a", None), (6, "c", None), (7, "d", None)]
    new = spark.createDataFrame(rows, "request_id long, login string, _mail string")
    assert sorted(r.request_id for r in M._first_claims(new).collect()) == [1, 3, 6, 7]
    assert M._first_claims(new.limit(0)).collect() == []


def test_nested_meta_conflicts_and_numbers(spark):
    import json

    from tessera.operators.content import nest_meta

    rows = [(1, "a.b", "5"), (1, "a.b.c", "x"), (1, "A.d", "NaN"), (1, "a.e", "1d"), (1, "a.f", "-2.5e3"), (1, "a.g", "{x"), (1, "a.h", "1e999")]
    df = spark.createDataFrame([(*r, False) for r in rows], "id int, key string, value string, is_deleted boolean")
    got = json.loads(nest_meta(df, "id").first().meta_json)
    assert got == {"a": {"b": {"c": "x"}, "d": "NaN", "e": "1d", "f": -2500.0, "g": "{x", "h": "1e999"}}
