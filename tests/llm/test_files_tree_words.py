"""Token files, Merkle manifest and spelling variants: brute force, exact
round trips and edge cases."""

import hashlib
import random
import uuid
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import merkle_manifest as merkle
from tessera.llm import spelling_variants as spelling
from tessera.llm.oracle_sql import ORACLE_SQL
from tessera.llm.queries import QUERIES
from tessera.llm.token_files import Encoder, op13_token_files, read_token_files, write_token_files
from tessera.session import scratch_path
from tools_compare import digest

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, g long, part long, root string, word string, n long, row string, id string, `a b` string"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_spelling_variants"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE_SQL[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    assert rows and sorted(cols) == sorted(df.columns)
    assert digest(cols, rows)[0] == digest(df.columns, [tuple(r) for r in df.collect()])[0]


# ------------------------------------------------------------------ tokens
def _tokenizer():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_token_files_hold_the_ids_of_whole_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    found = {r.doc_id: r for r in op13_token_files(spark, SF).collect()}
    assert len(found) == len(docs)
    start, t = 0, _tokenizer()
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        r = found[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


_CHARS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list(" \n\t.,'’sS\x00\x1c\x85\xa0×÷éß　 \xad")))


ENCODER = Encoder(BPE)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(_CHARS, max_size=40)), max_size=6))
def test_ids_by_piece_are_those_of_the_whole(texts):
    e, t = ENCODER, ENCODER.tokenizer
    e.known.clear()
    want = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], e.dtype).tobytes() for x in texts]
    assert list(e(pa.array(texts, pa.string()))) == want
    assert list(e(pa.array(["x", *texts], pa.string())[1:])) == want  # a slice, and pieces that are remembered


def test_other_tokenizers_encode_whole_texts(spark):
    path, words = scratch_path(spark, f"t-tok-{uuid.uuid4().hex[:8]}"), public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([("b", "Plain  words, AND more"), ("a", None)], "name string, body string")
    write_token_files(docs, path, words, "name", "body", end_id=49407)
    assert ENCODER.by_piece and not Encoder(words).by_piece
    t = Tokenizer.from_file(words)
    t.encode_special_tokens = True
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [(r.id, r.start, r.ids) for r in rows] == [
        ("a", 0, [49407]), ("b", 1, [*t.encode("Plain  words, AND more", add_special_tokens=False).ids, 49407])]


def _edge_rows():
    long = " ".join(f"w{k % 977}" for k in range(40_000))
    return [(1, "one two", "a"), (1, "one two", "a"), (1, "another", "a"), (2, None, None), (3, "", "b"), (None, "no id", "b"),
            (4, long, "a"), (5, "x" * 200_000, "b"), (6, "<|endoftext|> \x00 漢字\r\n", "é"), ((1 << 60) + 1, "far", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "en", 3, 1, 1, "r", "w", 1, "x", "i", "z") for r in _edge_rows()], SCHEMA).repartition(3)


def test_token_files_edge_cases(spark, edge):
    path, t = scratch_path(spark, f"t-tok-{uuid.uuid4().hex[:8]}"), _tokenizer()
    write_token_files(edge, path, BPE)
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [r.id for r in rows] == [None, 1, 1, 1, 2, 3, 4, 5, 6, (1 << 60) + 1]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, _ in _edge_rows())
    assert Counter((r.id, tuple(r.ids)) for r in rows) == want
    # the flat files themselves: all ids in order, offsets of 64 bits
    parts = spark.read.parquet(f"{path}/parts").orderBy("part").collect()
    local = path.removeprefix("file:")
    flat = np.concatenate([np.fromfile(f"{local}/ids-{p.name}.bin", p.dtype) for p in parts])
    assert flat.tolist() == [x for r in rows for x in r.ids]
    for p in parts:
        offsets = np.fromfile(f"{local}/offsets-{p.name}.bin", "<u8")
        assert len(offsets) == p.n_docs + 1 and offsets[-1] == p.n_ids
    empty = scratch_path(spark, f"t-tok-{uuid.uuid4().hex[:8]}")
    write_token_files(edge.limit(0), empty, BPE)
    assert read_token_files(spark, empty).collect() == []


# ------------------------------------------------------------------ Merkle
def _h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _tree(nodes):
    """Root, and for each node the (left, right) digests beside its path."""
    paths, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        up, owners = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k:k + 3]
            for j in range(len(run)):
                for i in own[k + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(_h("".join(run)))
            owners.append(sum(own[k:k + 3], []))
        nodes, own = up, owners
    return nodes[0], paths


def _brute(rows):
    """(id, leaf, subroot, root, proof hash, folded root) for (id, group, leaf, changed)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    sub, inner = [], {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        root, inner[s] = _tree([r[2] for r in groups[s]])
        sub.append(root)
    root, outer = _tree(sub)
    out = []
    for k, s in enumerate(order):
        for r, path in zip(groups[s], inner[s], strict=True):
            path, folded = path + outer[k], r[3]
            for a, b in path:
                folded = _h(a + folded + b)
            out.append((r[0], r[2], sub[k], root, _h("".join(a + b for a, b in path)), folded, folded == root))
    return Counter(out)


MANY = {f"s{k:02}": 1 + k % 4 for k in range(11)} | {"s05": 200, "é": 9}


@pytest.mark.parametrize(("sizes", "levels"), [({"a": 1}, 1), ({"a": 3, "b": 28, None: 1}, 1), (MANY, 0), (MANY, 1), (MANY, 3)])
def test_merkle_parts_of_any_size_give_the_same_tree(spark, sizes, levels):
    rnd = random.Random(5)
    rows = [(k, s, _h(f"{s}-{k}"), _h(f"{s}-{k}" + "!" * rnd.randrange(2))) for s, n in sizes.items() for k in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, grp string, a string, b string")
    got = merkle.merkle_manifest(df, "id", "grp", F.col("a"), F.col("b"), part_levels=levels).drop("proof")
    assert Counter(tuple(r) for r in got.collect()) == _brute(rows)


def test_merkle_edge_cases(spark, edge):
    leaf = merkle.leaf_hash(F.col("doc_id"), F.col("source"), F.col("text"))
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    rows = [(i, s, h := _h(part(i) + part(s) + part(t)), h) for i, t, s in _edge_rows()]
    got = merkle.merkle_manifest(edge, "doc_id", "source", leaf, leaf, part_levels=1).collect()
    assert Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == _brute(rows)
    assert all(r.verified for r in got)
    alone = merkle.merkle_manifest(edge.where("doc_id = 4"), "doc_id", "source", leaf, F.lit("0")).first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof == "" and not alone.verified and alone.folded_root == "0"
    assert merkle.merkle_manifest(edge.limit(0), "doc_id", "source", leaf, leaf).collect() == []


# ---------------------------------------------------------------- spelling
def _words(rows):
    out = Counter()
    for i, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lower + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run
                out[word] += len(word) >= 6
            run = ""
    return {w: n for w, n in out.items() if n >= 5}


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def _variants(words):
    form, out = {}, []
    for w, n in words.items():
        near = [x for x in words if _near(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out.append([w, form[w], w, n, len(near), words[form[w]] if form[w] else None])
    for r in out:
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out))


@pytest.mark.parametrize("index_words", [1, 3, 4096])
def test_variants_against_all_pairs(spark, index_words):
    rnd = random.Random(9)
    stems = ["".join(rnd.choice("abé") for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    pool = []
    for s in stems:  # small alphabet: runs of one letter, chains and crowded indexes
        pool += [s] * rnd.choice([1, 6, 30, 200])
        for _ in range(8):
            k = rnd.randrange(len(s))
            pool += [rnd.choice([s[:k] + s[k + 1:], s[:k] + rnd.choice("abé") + s[k:], s[:k] + rnd.choice("abé") + s[k + 1:]])] * rnd.choice([1, 5, 7, 40])
    pool += ["aaaaaa"] * 900 + ["aaaaaaa"] * 100 + ["aaaaaaaa"] * 9 + ["AaAaAaB"] * 6
    rnd.shuffle(pool)
    rows = [(k, rnd.choice([" ", "-", "1"]).join(pool[k::40])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = _variants(_words(rows))
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain
    got = spelling.spelling_variants(df, index_words=index_words)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_variants_edge_cases(spark, edge):
    assert spelling.spelling_variants(edge.limit(0)).collect() == []
    assert spelling.spelling_variants(edge.where("text IS NULL OR text = ''")).collect() == []
    got = {r.word: r for r in spelling.spelling_variants(edge, min_letters=2, min_count=1).collect()}
    assert got["one"].n == 2 and got["x" * 200_000].n_near == 0 and got["endoftext"].root == "endoftext"
    far = spark.createDataFrame([(k, "x" * 5000 + " " + "x" * 4999 + " " + "x" * 5000) for k in range(6)], "doc_id long, text string")
    got = {len(r.word): r for r in spelling.spelling_variants(far, index_words=1).collect()}
    assert got[5000].n_near == got[4999].n_near == 1
