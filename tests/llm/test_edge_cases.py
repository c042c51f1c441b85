"""Nulls, empty and very long texts, ties, repeated rows, empty tables and
columns with clashing names, for every operator of tessera.llm."""

import random

import pytest

from tessera.llm.decontaminate import contamination
from tessera.llm.license_scan import scan_licenses
from tessera.llm.mixing import mix
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.page_text import extract_text
from tessera.llm.quality import quality
from tessera.llm.shuffle_shards import uniform_shards
from tessera.llm.substring_dedup import remove_repeated_windows
from tessera.llm.toxicity import toxicity
from tessera.llm.vector_search import nearest

SCHEMA = ("doc_id long, text string, lang string, source string, id string, bucket int, chunk long, payload string, "
          "key string, score double, target string, taken string, share string, rank string, h string, `a b` string")
BIG = (1 << 53) + 1


def _docs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    long = " ".join(word() for _ in range(60_000))
    text = " ".join(word() for _ in range(80))
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, "   \n\t ", "en", None),
            (None, "one two", None, "b"), (None, text + " tail", "en", "b"), (5, long, "de", "b"), (BIG, "x" * 300_000, "de", "a"),
            (6, "tie tie tie tie " * 30, "en", "b"), (7, "Grüße ퟿ 漢字 \x00 end", "en", "a")]
    return spark.createDataFrame([(*r, "i", 1, 2, "p", "k", 0.5, "t", "q", "s", "r", "h", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return _docs(spark).coalesce(2)


def _ids(df, col="doc_id"):
    return sorted((r[col] for r in df.select(col).collect()), key=lambda x: (x is None, x))


IDS = [1, 1, 2, 3, 4, 5, 6, 7, BIG, None, None]


def test_substring_dedup(spark, docs):
    out = remove_repeated_windows(docs)
    assert _ids(out) == IDS
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.n_removed, r.kept_text, r.spans) for r in by[1]] == [(80, 80, "", [[0, 80]])] * 2
    assert (by[2][0].n_words, by[2][0].kept_text) == (0, "") and by[3][0].n_words == by[4][0].n_words == 0
    assert by[6][0].n_removed == 120  # its windows repeat within the text
    assert by[5][0].n_words == 60_000 and by[5][0].n_removed == 0
    assert sorted((r.n_words, r.n_removed, r.kept_text) for r in by[None]) == [(2, 0, "one two"), (81, 80, "tail")]
    assert remove_repeated_windows(docs.limit(0)).collect() == []


def test_near_duplicates(spark, docs):
    out = near_duplicates(docs)
    assert _ids(out) == IDS
    got = {(r.doc_id, r.n_shingles): r.component_id for r in out.collect()}
    assert got[(1, 76)] == 1 and got[(None, 77)] == 1 and got[(None, 1)] is None
    assert got[(2, 0)] == 2 and got[(3, 0)] == 3 and got[(4, 0)] == 4 and got[(BIG, 1)] == BIG
    assert near_duplicates(docs.limit(0)).collect() == []


def test_contamination(spark, docs):
    text = docs.where("doc_id = 1").first().text
    items = spark.createDataFrame([(10, " ".join(text.split()[20:40])), (9, "ONE  two!"), (11, None), (12, ""), (9, "one two"), (None, "tie tie")],
                                  "item_id long, text string")
    got = {}
    for r in contamination(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.items, r.contaminated))
    assert got[1] == [(80, 20, ["10"], True)] * 2
    assert sorted(got[None]) == [(2, 2, ["9"], True), (81, 20, ["10"], True)]
    assert got[6] == [(120, 120, [], True)] and got[2] == [(0, 0, [], False)]
    assert contamination(docs.limit(0), items).collect() == []
    assert all(not r.contaminated for r in contamination(docs, items.limit(0)).collect())


def test_mix(spark, docs):
    out = mix(docs)
    assert _ids(out) == IDS
    rows = out.collect()
    assert all(0 <= r.copies <= 2 for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, 0, r.target, 0])
        s[0] += r.size
        s[1] += r.size * r.copies
        s[3] = max(s[3], r.size)
        assert r.source_size is not None
    assert abs(sum(s[2] for s in by.values()) - 1.5 * sum(s[0] for s in by.values())) < 1e-6
    assert all(abs(s[1] - s[2]) <= s[3] for s in by.values())
    assert mix(docs.limit(0)).collect() == []


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity(docs, labels)
    assert _ids(out) == IDS
    assert all(0 <= r.score <= 1 for r in out.collect())
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).collect() == []


def test_page_text(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", "<p>Hi", "h", "t"), (None, None, None, "h", "t"), (2, "not a url", "", "h", "t"),
                                   (2, "not a url", "", "h", "t"), (BIG, "http://a.example/y", "<div>" * 3000 + "deep" + "<b" * 5, "h", "t"),
                                   (4, "http://b.example", "w " * 200_000, "h", "t")],
                                  "page_id long, url string, html string, host string, template string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert got[1] == "Hi" and got[None] == "" and got[2] == "" and got[BIG] == "deep" and got[4] == " ".join(["w"] * 200_000)
    assert extract_text(pages).count() == 6 and extract_text(pages.limit(0)).collect() == []


def test_quality(spark, docs):
    trusted = spark.createDataFrame([(1,), (5,), (7,), (1,), (None,), (99,)], "doc_id long")
    out = quality(docs, trusted)
    assert _ids(out) == IDS
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].score == got[1][1].score and got[2][0].keep and got[3][0].keep and got[2][0].n_words == 0
    assert all(r.threshold is not None for rows in got.values() for r in rows)
    assert all(r.keep and r.threshold is None for r in quality(docs, trusted.limit(0)).collect())
    assert quality(docs.limit(0), trusted).collect() == []


def test_uniform_shards(spark, docs):
    out = uniform_shards(docs.withColumn("slot", docs.doc_id), 4)
    assert out.columns == [*docs.columns, "shard", "slot"] and _ids(out) == IDS
    shards = {}
    for r in out.collect():
        shards.setdefault(r.shard, []).append(r.slot)
    assert sorted(map(len, shards.values())) == [2, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert uniform_shards(docs.limit(0), 4).collect() == []
    assert uniform_shards(docs.limit(2), 24).select("shard").distinct().count() == 2


def test_nearest(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (None, [1.0, 0.0]),
            (6, [0.0, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [float("inf"), 1.0]), (50, [1e-200, 1e-200]), (10, [-0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as rank", "1 as dims", "2 as shard")
    got = {}
    for r in nearest(v, v.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [i for _, i in got[0]][:3] == [1, 7, 50] and [k for k, _ in got[0]] == [1, 2, 3, 4, 5] and [i for _, i in got[0]][3:] == [6, 10]
    assert len(got[50]) == 5
    assert nearest(v.limit(0), v).collect() == [] and nearest(v, v.limit(0)).collect() == []


def test_license_scan(spark, docs):
    out = scan_licenses(docs)
    assert _ids(out) == IDS and all(r.licenses == [] for r in out.collect())
    one = spark.createDataFrame([(1, "a\nLicensed under CC BY-NC 4.0.\nb"), (2, "w " * 100_000 + "Released under the MIT License. " + "w " * 100_000),
                                 (3, "This work is licensed under the GNU General Public License, version 9.")], "doc_id long, text string")
    got = {r.doc_id: [x.license for x in r.licenses] for r in scan_licenses(one).collect()}
    assert got == {1: ["CC-BY-NC-4.0"], 2: ["MIT"], 3: []}
    assert scan_licenses(docs.limit(0)).collect() == []
