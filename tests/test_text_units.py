"""Hand cases for the text helpers that have no SQL oracle."""

import hashlib
import json
import os
import struct
import tempfile

from pyspark.sql import functions as F

from tessera.operators import text as T
from tessera.operators.merge import note_hash
from tessera.sources import files as FS
from tessera.sources import resources as R


def test_scrub_note_lists_code_and_escape():
    src = "<p>Intro <b>bold</b></p><ul><li>one</li><li>two</li></ul>a < b\n```\ncode  \n\n\n  x\n```"
    out = T.scrub_note_text(src)
    assert "**bold**" in out
    assert "* one\n* two" in out
    assert "a &lt; b" in out
    assert "```\ncode\n" in out


def test_footnotes_nested_and_numbered():
    text = "Start [1. first note] middle [2. second [with] nest] end"
    assert T.extract_footnotes(text) == ["first note", "second [with] nest"]
    assert T.extract_footnotes("[1. at start]") == ["at start"]
    assert T.extract_footnotes("".join(f"x [{n}. note {n}] " for n in range(1, 151))) == [f"note {n}" for n in range(1, 151)]
    assert T.extract_footnotes("[open [1. a] ] [2.  ] [3. b] [1. a] [never") == ["a", "b"]
    assert T.extract_footnotes(None) == []
    assert T.extract_footnotes("no notes here") == []


def test_footnotes_job(spark):
    df = spark.createDataFrame([(1, "A [1. x] B [2. y]"), (2, "none")], "id long, t string")
    rows = sorted((r.id, r.idx, r.note) for r in T.footnotes(df, "id", "t").collect())
    assert rows == [(1, 1, "x"), (1, 2, "y")]


def test_html_decode_named_and_numeric(spark):
    from tessera.functions.text import html_decode

    cases = [("caf&eacute; &#8217;&#233;&#x1F600;", 4, "café ’é😀"), ("&amp;lt; &lt;&gt;&quot;&nbsp;|", 4, '&lt; <>"\u00a0|'),
             ("&apos; &nosuch; & &; &#0; &#xD800; a&b", 4, "&apos; &nosuch; & &; &#0; &#xD800; a&b"),
             ("&apos;&hearts;&NotEqualTilde;&AMP;", 5, "'♥≂̸&"), ("", 4, ""), (None, 5, None), ("&eacute", 4, "&eacute")]
    for text, version, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(html_decode(F.col("t"), version)).first()[0] == want, text


def test_hashtags_exact_dedup(spark):
    df = spark.createDataFrame([("Party at #party and #art, then #Art! #",)], "t string")
    assert T.hashtags(df, "t").first().hashtags == ["party", "art"]


def test_unique_words_order_and_bounds(spark):
    df = spark.createDataFrame([("The cat's <b>hat</b> & the CAT... a " + "x" * 70,)], "t string")
    assert T.unique_words(df, "t").first().words == ["the", "cats", "hat", "cat"]


def test_note_hash_matches_hashlib(spark):
    df = spark.createDataFrame([("note.normal", "a\\b", True)], "t string, c string, p boolean")
    got = df.select(note_hash(F.col("t"), F.col("c"), F.col("p")).alias("h")).first().h
    assert got == hashlib.sha512("note.normala\\\\bY".encode()).hexdigest()


def test_read_json_map_and_timezones(spark):
    d = tempfile.mkdtemp()
    with open(os.path.join(d, "m.json"), "w") as f:
        json.dump({"jpg": "image/jpeg", "pdf": "application/pdf"}, f)
    with open(os.path.join(d, "tz.json"), "w") as f:
        json.dump([{"value": "A", "abbr": "a", "offset": 1, "isdst": False, "name": "n", "utc": ["X/Y", "X/Z"]}], f)
    m = {r.key: r.value for r in R.read_json_map(spark, os.path.join(d, "m.json")).collect()}
    assert m == {"jpg": "image/jpeg", "pdf": "application/pdf"}
    assert sorted(r.iana for r in R.read_timezones(spark, os.path.join(d, "tz.json")).collect()) == ["X/Y", "X/Z"]


def _gif(frames: int) -> bytes:
    body = b""
    for _ in range(frames):
        body += b"\x00\x21\xF9\x04" + b"\x04\x0a\x00\x00" + b"\x00\x2C" + b"\x00" * 9
    return b"GIF89a" + struct.pack("<HH", 1, 1) + b"\x00\x00\x00" + body + b"\x3B"


def test_animated_gifs(spark):
    d = tempfile.mkdtemp()
    os.makedirs(os.path.join(d, "sub"))
    for name, n in (("one.gif", 1), ("sub/two.gif", 2)):
        with open(os.path.join(d, name), "wb") as f:
            f.write(_gif(n))
    with open(os.path.join(d, "note.txt"), "w") as f:
        f.write("not a gif")
    got = {os.path.basename(r.path): (r.frames, r.is_animated) for r in FS.animated_gifs(spark, d).collect()}
    assert got == {"one.gif": (1, False), "two.gif": (2, True)}
    cat = {r.name: r.sha256 for r in FS.crawl_files(spark, d).collect()}
    assert cat["note.txt"] == hashlib.sha256(b"not a gif").hexdigest()


def test_scrub_notes_holds_few_texts(spark):
    """Long notes reach the worker some at a time, not 10,000 in an Arrow batch."""
    df = spark.createDataFrame([(1, "<p>a<b>b"), (2, None), (3, "")], "id int, note string")
    got = T.scrub_notes(df, "note")
    assert got.columns == ["id", "note", "scrubbed"]
    assert [r.scrubbed for r in got.orderBy("id").collect()] == [T.scrub_note_text(t) for t in ("<p>a<b>b", None, "")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "MapInPandas" not in plan
