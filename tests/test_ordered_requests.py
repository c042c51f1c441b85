"""Requests of one batch that depend on each other, against one-by-one versions."""

import random

import pytest

from tessera.operators import merge as M
from tessera.operators.graph import components


def _claims(rows):
    logins, mails, out = set(), set(), []
    for r, login, mail in sorted(rows):
        if login not in logins and (mail is None or mail not in mails):
            logins.add(login)
            mails.add(mail)
            out.append(r)
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 2_000_000), (2, 2_000_000), (3, 4)])
def test_claims_against_one_by_one(spark, seed, limit):
    rnd = random.Random(seed)
    rows = [(k, f"l{rnd.randrange(70)}", None if rnd.random() < 0.1 else f"m{rnd.randrange(70)}") for k in range(150)]
    rows += [(1000 + k, "hot", f"n{k}") for k in range(60)] + [(2000 + k, f"p{k}", "hot") for k in range(60)]  # a shared login, a shared mail
    rows += [(3000 + k, f"c{(k + 1) // 2}", f"c{k // 2}") for k in rnd.sample(range(80), 80)]  # a chain
    rows += [(4000 + k, f"solo{k}", None) for k in range(5)] + [(5000, "l1", "m1"), (5001, "l1", "m1")]
    rnd.shuffle(rows)
    new = spark.createDataFrame(rows, "request_id long, login string, _mail string")
    got = M._first_claims(new, component_pairs=limit)
    assert sorted(r.request_id for r in got.collect()) == _claims(rows)


def _jobs(spark, f):
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("rest", "")
    return n


def test_claims_of_long_chains_take_few_jobs(spark):
    jobs = {}
    for n in (8, 128):
        rows = [(k, f"c{(k + 1) // 2}", f"c{k // 2}") for k in range(n)]
        new = spark.createDataFrame(rows, "request_id long, login string, _mail string")
        jobs[n] = _jobs(spark, lambda new=new, rows=rows: _same(M._first_claims(new), rows))
    assert jobs[128] <= 3 * jobs[8]  # rounds over requests would take 16 times as many


def _same(df, rows):
    assert sorted(r.request_id for r in df.collect()) == _claims(rows)


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (7, 7), (300, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(51)}, **{k: 100 for k in range(100, 140)}, **{k: 200 for k in (200, 201, 202)}}
    assert components(df.limit(0)).collect() == []


def _apply(notes, history, accounts, requests):
    """Every request in order, with the whole rule of a single write."""
    notes = {n[0]: dict(zip(("id", "type", "content", "private", "deleted", "by"), n, strict=True)) for n in notes}
    history, touched = list(history), {}
    for _, account, note, content, type_, private in sorted(requests, key=lambda r: r[0]):
        me, n = accounts.get(account), notes.get(note)
        if me is None or me[1] or n is None:
            continue
        past = any(h == (note, account, False) for h in history)
        if not (me[0] in ("account.admin", "account.global") or not n["deleted"] and (n["by"] == account or not n["private"] and past)):
            continue
        content = content.strip()
        new = {"id": note, "type": type_ if type_ in M.NOTE_TYPES else "note.normal", "content": content or n["content"],
               "private": private in ("Y", "1", "TRUE"), "deleted": not content, "by": account}
        if any(new[c] != n[c] for c in ("type", "content", "private")):
            history.append((note, n["by"], n["deleted"]))
        notes[note] = touched[note] = new
    return touched


@pytest.mark.parametrize("seed", [1, 2])
def test_each_write_is_judged_on_the_note_it_finds(spark, seed):
    rnd = random.Random(seed)
    accounts = {k: ("account.admin" if k == 1 else "account.global" if k == 2 else "account.basic", k == 9) for k in range(1, 10)}
    notes = [(n, "note.normal", f"t{n % 3}", rnd.random() < 0.4, rnd.random() < 0.2, rnd.randrange(1, 10)) for n in range(1, 41)]
    history = sorted({(rnd.randrange(1, 41), rnd.randrange(1, 10), rnd.random() < 0.3) for _ in range(50)})
    requests = [(k, rnd.randrange(1, 12), rnd.choice([1, 1, rnd.randrange(1, 44)]), rnd.choice(["", "  ", "t0", "t1", "t2", " new "]),
                 rnd.choice(["note.normal", "note.normal", "note.locked", "x"]), rnd.choice(["N", "N", "Y"])) for k in range(900)]
    rnd.shuffle(requests)
    out = M.apply_note_changes(
        spark.createDataFrame(notes, "id int, type string, content string, is_private boolean, is_deleted boolean, updated_by int"),
        spark.createDataFrame(requests, "request_id long, account_id int, note_id int, content string, type string, private string"),
        spark.createDataFrame([(k, *v) for k, v in accounts.items()], "id int, type string, is_deleted boolean"),
        spark.createDataFrame(history, "note_id int, updated_by int, is_deleted boolean"))
    want = _apply(notes, history, accounts, requests)
    got = {r.id: {"id": r.id, "type": r.type, "content": r.content, "private": r.is_private, "deleted": r.is_deleted, "by": r.updated_by}
           for r in out.where("action = 'update'").collect()}
    assert got == want and len(got) > 20
