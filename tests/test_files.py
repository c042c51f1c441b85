import gzip
import hashlib
import random

from tessera.operators import files as FL
from tessera.sources import files as FS


def _brute(rows, quota):
    out, rem = {}, {}
    for rid, acc, arr, size in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        r = rem.setdefault(acc, quota)
        ok = 0 < size <= r
        if ok:
            r -= size
        rem[acc] = r
        out[rid] = (ok, r)
    return out


def test_admit_uploads_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 2, 3, 7]), rnd.randint(0, 500), rnd.choice([0, 5, 40, 90, 150, 400])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, account_id int, arrival int, bytes int")
    quotas = df.select("account_id").distinct().selectExpr("account_id", "1000 AS quota")
    got = {r.id: (r.accepted, r.remaining) for r in FL.admit_uploads(df, quotas, partitions=3).collect()}
    assert got == _brute(rows, 1000)


def test_rejected_file_does_not_consume(spark):
    rows = [(1, 1, 1, 600), (2, 1, 2, 600), (3, 1, 3, 300)]
    df = spark.createDataFrame(rows, "id int, account_id int, arrival int, bytes int")
    q = df.select("account_id").distinct().selectExpr("account_id", "1000 AS quota")
    got = {r.id: r.accepted for r in FL.admit_uploads(df, q, partitions=2).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_admit_uploads_phases_match_brute_force(spark):
    rnd = random.Random(9)
    # one hot account with most files, sizes spread so many late files still fit
    rows = [(i, 1 if rnd.random() < 0.7 else rnd.choice([2, 3]), rnd.randint(0, 2000),
             rnd.choice([0, 3, 8, 20, 55, 140, 400])) for i in range(1500)]
    df = spark.createDataFrame(rows, "id int, account_id int, arrival int, bytes int")
    quotas = df.select("account_id").distinct().selectExpr("account_id", "1000 AS quota")
    want = _brute(rows, 1000)
    got = {r.id: (r.accepted, r.remaining)
           for r in FL.admit_uploads(df, quotas, partitions=5).collect()}
    assert got == want


def test_admit_uploads_null_sizes_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (2, 1, 2, 5)], "id int, account_id int, arrival int, bytes int")
    q = spark.createDataFrame([(1, 10)], "account_id int, quota int")
    assert {r.id: (r.accepted, r.remaining) for r in FL.admit_uploads(df, q, partitions=2).collect()} == {1: (False, 10), 2: (True, 5)}


def test_admit_uploads_every_account_shape(spark):
    # quotas of 0, none and 2^40; ties in arrival; halving sizes (one admission a phase); accounts without an overflow
    rnd = random.Random(21)
    rows = [(i, 1, 0, 1 << (40 - i)) for i in range(40)] + [(100 + i, 2, rnd.randint(0, 3), rnd.randint(-5, 60)) for i in range(200)]
    rows += [(400 + i, 3, i, 7) for i in range(20)] + [(500 + i, 4, i, 1) for i in range(5)] + [(600, 5, 0, 3)]
    quota = {1: (1 << 40) - 1, 2: 333, 3: 1000, 4: 0}
    df = spark.createDataFrame(rows, "id int, account_id int, arrival int, bytes long")
    q = spark.createDataFrame(list(quota.items()), "account_id int, quota long")
    got = {r.id: (r.accepted, r.remaining) for r in FL.admit_uploads(df, q, partitions=3).collect()}
    want = {}
    for acc in range(1, 6):
        want |= _brute([r for r in rows if r[1] == acc], quota.get(acc, 0))
    assert got == want


def test_large_files_are_hashed_split_by_split(spark, tmp_path, monkeypatch):
    rnd = random.Random(4)
    contents = {
        "random.bin": rnd.randbytes(60_000), "end.bin": rnd.randbytes(50_000) + b"\n", "mark.csv": b"\xef\xbb\xbf" + b"a;b\r\n" * 9_000,
        "mark and no end.csv": b"\xef\xbb\xbf" + b"a;b\n" * 9_000 + b"last", "feeds.txt": b"\n" * 40_000, "one line.txt": b"\0" * 45_000,
        "long lines.txt": b"\n".join(rnd.randbytes(7_000).replace(b"\n", b"") for _ in range(6)), "returns.txt": b"\r" * 30_000 + b"\n\r" * 9_000,
        "twice.bin": b"ab\n\xff" * 10_000, "twice too.bin": b"ab\n\xff" * 10_000, "small.bin": rnd.randbytes(9_000),
        "packed.gz": gzip.compress(rnd.randbytes(15_000)),
    }
    for i, (name, data) in enumerate(contents.items()):
        folder = tmp_path / f"sub {i % 3}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_bytes(data)
    monkeypatch.setattr(FS, "WHOLE_BYTES", 10_000)
    # no value may hold a whole large file; splits of a few KB, rests of several files in one partition
    conf = {"spark.sql.sources.binaryFile.maxLength": "20000", "spark.sql.files.maxPartitionBytes": "6000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = {r.name: (r.bytes, r.sha256) for r in FS.crawl_files(spark, str(tmp_path)).collect()}
        some = {r.name for r in FS.crawl_files(spark, str(tmp_path), "*.csv").collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}
    assert some == {"mark.csv", "mark and no end.csv"}
