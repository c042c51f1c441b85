"""Operators of tessera.llm against brute force, round trips and held-out rows."""

import collections
import hashlib
import math
import os
import random
import textwrap

import duckdb
import numpy as np
import pytest

from tessera.llm import kneser_ney, license_scan, mixing, quality, queries, shuffle_shards, signature_tree, vector_search
from tessera.llm.common import BASE_A, lower_words, rolling, words
from tessera.llm.decontaminate import contamination, plain_words, sharing_pairs
from tessera.llm.ngram_join import near_duplicates
from tessera.llm.page_text import extract_text
from tessera.llm.substring_dedup import remove_repeated_windows
from tools_compare import digest

SF = "/root/testdata/sf0.001"


def _corpus(spark, n=160, seed=1):
    """Random texts, near copies of some, shared passages and a common line."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(3000)]
    text = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passage, line = text(60), text(8)
    rows = []
    for i in range(n):
        if i and rnd.random() < 0.4:
            w = list(rnd.choice(rows)[1])
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = text(rnd.randint(1, 200))
            if rnd.random() < 0.3:
                w = line + w
            if rnd.random() < 0.1:
                w = w + passage
        rows.append((i * 3, w))
    rnd.shuffle(rows)
    return spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    df = queries.QUERIES[name](spark, SF)
    res = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in res.description]
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, res.fetchall())[0]


def test_rolling_hash_is_the_polynomial():
    w = np.random.default_rng(1).integers(0, 2**64, 80, dtype=np.uint64)
    for k in (1, 2, 13, 35, 64, 80):
        want = [sum(int(w[i + j]) * pow(BASE_A, k - 1 - j) for j in range(k)) % 2**64 for i in range(80 - k + 1)]
        assert [int(x) for x in rolling(w, k, BASE_A)] == want


def test_repeated_windows(spark):
    docs = _corpus(spark)
    k = 12
    rows = {r.doc_id: words(r.text) for r in docs.collect()}
    count = collections.Counter(tuple(w[i:i + k]) for w in rows.values() for i in range(len(w) - k + 1))
    for r in remove_repeated_windows(docs, length=k).collect():
        w = rows[r.doc_id]
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if count[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        assert r.kept_text.encode() == b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert [i for a, b in r.spans for i in range(a, b)] == [i for i, g in enumerate(gone) if g]


def test_contamination_spans(spark):
    docs = _corpus(spark, seed=2)
    rnd = random.Random(4)
    texts = [r.text.split() for r in docs.collect()]
    items = [(n, " ".join(t[a:a + rnd.randint(1, 40)])) for n, t in enumerate(rnd.sample(texts, 30)) for a in [rnd.randrange(len(t))]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = plain_words(t)
        for a in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows[tuple(w[a:a + min(13, len(w))])].add(str(i))
    source = {r.doc_id: plain_words(r.text) for r in docs.collect()}
    for r in contamination(docs, bench).collect():
        w, hit, found = source[r.doc_id], set(), set()
        for g, ids in windows.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a:a + len(g)]) == g:
                    hit.update(range(a, a + len(g)))
                    found |= ids
        assert r.n_hit == len(hit) and r.items == sorted(found)
        assert {i for a, b in r.spans for i in range(a, b)} == hit


def test_near_duplicate_components(spark):
    docs = _corpus(spark, 300, 3)
    sets = {}
    for r in docs.collect():
        w = lower_words(r.text)
        sets[r.doc_id] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    up = {i: i for i in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_signature_tree_misses_no_link():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in rng.integers(1, 300, 40)]
    sets = []
    for _ in range(150):
        s = base[rng.integers(len(base))]
        sets.append(np.unique(np.concatenate([s[rng.random(len(s)) > 0.08], rng.integers(0, 2**64, rng.integers(0, 12), dtype=np.uint64)])))
    sizes = np.array([len(s) for s in sets])
    for residents, own in ((150, True), (90, True), (90, False)):
        got = signature_tree.link(sets, sizes, residents, 80, own).labels()
        up = list(range(150))
        for a in range(residents):
            for b in range(a + 1 if own else residents, 150):
                n = len(np.intersect1d(sets[a], sets[b]))
                if 100 * n >= 80 * (sizes[a] + sizes[b] - n):
                    x, y = up[a], up[b]
                    up = [min(x, y) if u in (x, y) else u for u in up]
        assert got.tolist() == up


def test_kneser_ney_by_hand(spark):
    """The sharded tables give the probabilities of a plain implementation."""
    docs = _corpus(spark, 60, 6).selectExpr("doc_id", "text", "'en' AS lang")
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    vocabulary, alike = quality._vocabulary(docs, 7, 1 / 2000, 3)
    said = collections.Counter(w for r in docs.collect() for w in words(r.text))
    own = {w for w, c in said.items() if c >= max(3, said.total() / 2000)}
    assert 50 < len(own) == len(vocabulary) < len(said)
    assert sum(np.exp(alike[quality.SHAPES:quality.FIRST_WORD]).round()[np.unique([quality.shape(w) for w in set(said) - own])]) == len(set(said) - own)
    symbols = quality._Symbols(vocabulary)
    order = 3
    seqs = {r.doc_id: [quality.BEGIN] * (order - 1) + symbols(words(r.text), "en").tolist() for r in docs.collect()}
    grams = collections.Counter(tuple(s[i - 2:i + 1]) for d, s in seqs.items() if d % 2 == 0 for i in range(2, len(s)))
    counts = {3: grams}
    for k in (2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return (0.5, 0.75, 0.9)
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3))

    ds = {k: discounts(counts[k]) for k in counts}

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / kneser_ney.SYMBOLS
        own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        off = lambda c: ds[k][min(c, 3) - 1] if c else 0
        total = sum(own.values())
        c = own.get(gram, 0)
        return (c - off(c)) / total + sum(map(off, own.values())) / total * p(gram[1:])

    def left_out(gram):
        """p for a document that was counted: each n-gram counts once less."""
        k, off = len(gram), lambda c: ds[len(gram)][min(c, 3) - 1] if c else 0
        own = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        total, c, taken = sum(own.values()), counts[k][gram] - 1, sum(map(off, own.values()))
        if k == 1:
            return (c - off(c)) / total + taken / total / kneser_ney.SYMBOLS
        if c:
            return (c - off(c)) / (total - 1) + taken / total * p(gram[1:])
        return ((taken - off(1)) / (total - 1) if total > 1 else 1) * left_out(gram[1:])

    got = {r.doc_id: r for r in quality.perplexities(docs, trusted, "doc_id", "text", "lang", order, 1 / 2000, 3).selectExpr("CAST(id AS LONG) AS doc_id", "nll", "trusted").collect()}
    for d in [d for d in seqs if d % 2][:12]:
        want = sum(alike[seqs[d][i]] - math.log(p(tuple(seqs[d][i - 2:i + 1]))) for i in range(2, len(seqs[d])))
        assert got[d].nll == pytest.approx(want, rel=1e-4) and not got[d].trusted
    for d in [d for d in seqs if d % 2 == 0][:12]:
        want = sum(alike[seqs[d][i]] - math.log(left_out(tuple(seqs[d][i - 2:i + 1]))) for i in range(2, len(seqs[d])))
        assert got[d].nll == pytest.approx(want, rel=1e-4) and got[d].trusted


def test_quality_words_of_many_languages(spark):
    """More words than 16-bit symbols: the same text in 70 languages that share
    no word scores the same in each, and each word is a symbol of its language."""
    rnd = random.Random(3)
    text = [" ".join(rnd.choices([f"w{i}" for i in range(950)], k=400)) for _ in range(2)] + [" ".join(f"w{i}" for i in range(950))] * 2
    rows = [(4 * k + i, f"l{k}", t) for k in range(70) for i, t in enumerate(text)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4).cache()
    vocabulary, _ = quality._vocabulary(docs, 7, 1 / 4000, 1)
    assert len(vocabulary) == 70 * 950 > kneser_ney.SYMBOLS
    symbols = quality._Symbols(vocabulary)
    for lang in ("l0", "l69"):
        assert (np.sort(symbols(words(text[2]), lang)[:-1]) == quality.FIRST_WORD + np.arange(950)).all()
    got = quality.perplexities(docs, docs.where("doc_id % 4 < 3"), "doc_id", "text", "lang", 3, 1 / 4000, 1).toPandas()
    for _, nll in got.groupby(got["id"].astype(int) % 4)["nll"]:
        assert len(nll) == 70 and nll.max() == pytest.approx(nll.min(), rel=1e-6)


def test_pipeline_words_of_many_languages(spark, tmp_path, monkeypatch):
    """The pipeline's quality filter, too, takes more words than 16-bit symbols."""
    import corpus_pipeline

    whole, sizes = quality._vocabulary, []

    def vocabulary(docs, n_buckets, share, least):
        got = whole(docs, n_buckets, 1 / 4000, 1)
        sizes.append(len(got[0]))
        return got

    monkeypatch.setattr(quality, "_vocabulary", vocabulary)
    text = " ".join(f"w{i}" for i in range(950))
    docs = spark.createDataFrame([(k, f"l{k}", text) for k in range(70)], "doc_id long, lang string, text string")
    spark.createDataFrame([(k, 1) for k in range(70)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).count() == 70
    assert sizes == [70 * 950]


def test_quality_rejects_junk_and_keeps_clean(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality(docs, labels.where("quality = 1 AND doc_id % 3 <> 0")).join(labels, "doc_id").where("doc_id % 3 = 0 OR quality = 0")
    by = {(r.quality, r.keep): r["count"] for r in got.groupBy("quality", "keep").count().collect()}
    assert by.get((1, False), 0) <= 0.02 * (by[(1, True)] + by.get((1, False), 0))
    assert by[(0, False)] >= 0.9 * (by[(0, False)] + by.get((0, True), 0))


def test_quality_tells_replaced_and_shuffled_words(spark):
    """An invented language whose content words go together by topic: clean
    texts stay; with other words, made up or in any order, they go."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    little, content = [word()[:3] for _ in range(40)], [word() for _ in range(3000)]
    weight = [1 / (i + 10) for i in range(3000)]

    def clean():
        out = []
        while len(out) < 150:
            a, b = rnd.choice(little), rnd.choices(content, weight)[0]
            out += [a, b] if rnd.random() < 0.6 else [a, rnd.choice(little), b]
        return out

    def other(ws):
        return [w if w in little else word() for w in ws]

    texts = [("clean", clean()) for _ in range(900)]
    texts += [("replaced", other(clean())) for _ in range(200)] + [("shuffled", rnd.sample(x := clean(), len(x))) for _ in range(200)]
    rows = [(i, kind, " ".join(ws), "xx") for i, (kind, ws) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, kind string, text string, lang string").repartition(4)
    got = quality.quality(docs, docs.where("doc_id < 600")).join(docs.select("doc_id", "kind"), "doc_id").where("doc_id >= 600").toPandas()
    kept = got.groupby("kind")["keep"].mean()
    assert kept["clean"] >= 0.95 and kept["replaced"] <= 0.05 and kept["shuffled"] <= 0.05, kept


def _pairs(spark, share):
    """Texts of pairs of rare words of one shape: 400 trusted ones, 60 more, and 60
    whose words are those of other pairs."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bdgklmnprst") + rnd.choice("aeiou") for _ in range(4))
    pairs = [(word(), word()) for _ in range(1000)]

    def text(crossed):
        took = rnd.sample(pairs, 30)
        return " ".join(f"{a} {b}" for (a, _), (_, b) in zip(took, took[crossed:] + took[:crossed], strict=True))

    docs = spark.createDataFrame([(i, "xx", text(i >= 460)) for i in range(520)], "doc_id long, lang string, text string").repartition(4)
    said = collections.Counter(w for r in docs.collect() for w in words(r.text))
    assert max(said.values()) < max(quality.MIN_COUNT, share * said.total())
    return docs


def test_quality_tells_rare_words(spark):
    """Words too rare to be symbols of the model of classes are known by the other."""
    docs = _pairs(spark, quality.MIN_SHARE)
    kept = {r.doc_id: r.keep for r in quality.quality(docs, docs.where("doc_id < 400")).collect()}
    assert sum(kept[i] for i in range(400, 460)) >= 57 and sum(kept[i] for i in range(460, 520)) <= 3


def test_pipeline_tells_rare_words(spark, tmp_path):
    """The pipeline's quality filter, too, knows words that are no symbols of the model of classes."""
    import corpus_pipeline

    docs = _pairs(spark, quality.MIN_SHARE)
    spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_filter(spark, docs, str(tmp_path)).collect()}
    assert len(kept & set(range(400, 460))) >= 57 and len(kept & set(range(460, 520))) <= 3


def test_quality_threshold_needs_different_texts(spark):
    """One trusted text, however often, rejects none; a language with few takes
    the quantile of all."""
    rnd = random.Random(8)
    text = lambda: " ".join(rnd.choices(["a", "bee", "sea", "Delta,", "echo.", "fox"], k=40))
    rows = [(i, "xx", text()) for i in range(40)] + [(i, "xx", rows0) for rows0 in [text()] for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert quality.quality(docs, docs.where("doc_id >= 100")).where("NOT keep").count() == 0
    more = spark.createDataFrame([(i, "yy", text()) for i in range(1000, 1000 + 2 * quality.MIN_TEXTS)], docs.schema)
    got = quality.quality(docs.union(more), docs.union(more).where("doc_id >= 100")).select("lang", "threshold").distinct().collect()
    assert len({r.threshold for r in got}) <= 2 and all(r.threshold < 100 for r in got)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    from tessera.llm.toxicity import toxicity

    got = toxicity(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = got["score"].rank(), got["toxic"] == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    # measured: 0.936 and 0.945; part of these toxic texts holds no expression that tells it apart
    assert auc > 0.92 and ((got["score"] >= 0.5) == y).mean() > 0.93


def test_toxicity_keeps_rare_expressions(spark):
    """Toxic words counted once weigh beside more than a million other n-grams."""
    from zlib import crc32

    from tessera.llm.toxicity import toxicity

    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=10))
    by_fold = collections.defaultdict(list)
    for i in range(6000):
        by_fold[crc32(str(i).encode()) % 5].append(i)
    filler = [[word() for _ in range(600)] for _ in range(300)]
    rows, labels = [], []

    def add(fold, ws, y):
        rows.append((by_fold[fold].pop(), " ".join(ws)))
        labels.append((rows[-1][0], y))

    for ws in filler:  # every word twice in the counted rows
        add(1, ws, 0)
        add(2, ws, 0)
    for _ in range(150):
        rare = word()
        for fold in (3, 4, 0):
            add(fold, [*rnd.choices(filler[0], k=30), rare], 1)
            add(fold, rnd.choices(filler[1], k=31), 0)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).join(labels, "doc_id").where("held_out").toPandas()
    rank, y = got["score"].rank(), got["toxic"] == 1
    assert len(got) == 300 and (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) > 0.95


def test_template_of_a_host_is_removed(spark):
    rows = []
    for i in range(40):
        host = "a" if i % 2 else "b"
        rows.append((i, f"https://{host}.example/{i}", f"<div><p>Site {host} rules.</p><h1>Head {i}</h1><p>Body &amp; <b>text</b> {i}</p>"
                     f"<div class='comments'><p>nice</p></div></div><footer>end</footer>"))
    rows.append((99, "https://c.example/1", "<p>Site a rules.</p>"))
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got.pop(99) == "Site a rules."
    assert got == {i: f"Head {i}\nBody & text {i}" for i in got}


def test_copied_pages_are_no_template(spark):
    """Copies of a page count as one, and no article or body is a template."""
    page = "<html><body><div><p>Site rules.</p></div>{}</body></html>"
    copied = page.format("<div><h1>Copied</h1><p>One page under several urls.</p></div>")
    rows = [(i, f"https://a.example/{i}", page.format(f"<div><h1>Head {i}</h1><p>Text {i}</p></div>")) for i in range(12)]
    rows += [(100 + i, f"https://a.example/c{i}", copied) for i in range(8)] + [(200, "https://a.example/c0", copied)] * 2
    rows += [(400 + i, f"https://d.example/{i}", f"<html><head><meta name=n content={i}></head><body><p>Same body.</p></body></html>") for i in range(4)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == (f"Head {r.page_id}\nText {r.page_id}" if r.page_id < 100 else "Copied\nOne page under several urls." if r.page_id < 300
                          else "Same body."), r
    from tessera.llm.page_text import Page

    assert not any(first == 0 for _, first, _, _ in Page("<body><div><article>x<p>y</p></article></div></body>").trees)


@pytest.mark.parametrize("html", [
    "<div class='content-sidebar-wrap'><article><p>Kept.</p></article></div>", "<div class='has-sidebar'><h1>Kept.</h1></div>",
    "<div id='nav-content-area'><main><p>Kept.</p></main></div>", "<div class='layout-no-sidebar'><p>Kept.</p></div>",
    "<div class='widget'><div><article>Kept.</article></div></div>", "<p class='share-price'>Kept.</p>",
    "<svg-icon></svg-icon><p>Kept.</p>", "<svg viewBox='0 0 1 1'/><p>Kept.</p>", "<title-bar></title-bar><p>Kept.</p>", "<math/><p>Kept.</p>",
    "<template-x>Kept.</template-x>", "<svg><path/>gone</svg><title>gone</title><p>Kept.</p>",
    "<p>Kept.<span class='share'> Tell <b>all</b></span></p><div class='post-comments'><article class='comment'><p>gone</p></article></div>",
    "<div class='sidebar'><p>gone</p></div><p>Kept.</p><div class='ad'>gone</div><div id='siteFooter'>gone</div><ul class='share-links'><li>gone</ul>"])
def test_marks_take_no_article(html):
    from tessera.llm.page_text import Page

    assert Page(html).main_text(set()) == ["Kept."]


def test_license_templates_rank_by_compression():
    s = license_scan.Scanner()
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        assert text in [license_scan.TEMPLATES[-j][1] for _, j in s.rank(text)[:license_scan.RANKED]], (k, name)
        assert name in [x[0] for x in s.text("line one\n" + text + "\nline two")]
    assert s.text("This work is licensed under the GNU General Public License, version 7.") == []


def test_mix_targets_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 300, "d": 5, None: 70}
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    target, open_ = {}, dict(zip(names, [3, 1, 2, 3, 1], strict=True))
    left = 1.5 * sum(sizes.values())
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del open_[s]
    assert {s: pytest.approx(t) for s, t in target.items()} == got


def test_mix_is_the_pareto_order(spark):
    """Inside a source, the documents with the smallest ranks are taken."""
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 23), f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix(d).collect())) for d in (docs, docs.repartition(7))]
    assert runs[0] == runs[1]
    draws = {r.doc_id: r.u for r in docs.select("doc_id", mixing.draw(docs["doc_id"]).alias("u")).collect()}
    for s in {r[1] for r in runs[0]}:
        rows = sorted((draws[r[0]], r) for r in runs[0] if r[1] == s)
        copies = [r[5] for _, r in rows]
        assert copies == sorted(copies, reverse=True) and copies[0] - copies[-1] <= 1
        target, taken = rows[0][1][4], sum(r[2] * r[5] for _, r in rows)
        assert abs(target - taken) <= 23


def test_communication_matrix():
    counts, sizes = np.array([5, 0, 17, 30, 1, 47]), np.array([20, 20, 20, 20, 20])
    m = np.array([shuffle_shards.matrix_row(counts, sizes, p, 3) for p in range(6)])
    assert m.sum(axis=1).tolist() == counts.tolist() and m.sum(axis=0).tolist() == sizes.tolist() and (m >= 0).all()
    # each row follows the hypergeometric law: mean counts over many seeds
    mean = np.mean([shuffle_shards.matrix_row(counts, np.array([70, 20, 10]), 3, s) for s in range(600)], axis=0)
    assert np.allclose(mean, 30 * np.array([0.7, 0.2, 0.1]), atol=0.5)
    shard, first, size = shuffle_shards.piece_sizes(1003, 24, 10)
    per = np.bincount(shard, size)
    assert per.max() - per.min() <= 1 and per.sum() == 1003 and size.max() <= 10


def test_uniform_shards_deal_and_repeat(spark):
    df = spark.range(5000).withColumnRenamed("id", "n").repartition(6)
    a = {r.n: (r.shard, r.slot) for r in shuffle_shards.uniform_shards(df, 24, piece_rows=50).collect()}
    assert len(a) == 5000 and len(set(a.values())) == 5000
    by = np.bincount([s for s, _ in a.values()])
    assert by.min() >= 208 and by.max() <= 209
    order = [a[n][0] for n in range(5000)]
    assert abs(np.corrcoef(range(5000), order)[0, 1]) < 0.06


def test_vector_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    m = (centres[rng.integers(40, size=5000)] + 0.4 * rng.normal(size=(5000, 24))).astype(np.float32)
    m[100:400] = m[99]  # a very common vector
    df = spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in vector_search.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=1500).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = m.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 5000, 50):
        s = u @ u[q]
        s[q] = -9
        best = np.lexsort((np.arange(5000), -np.round(s, 12)))[:5]
        assert len(got[q]) == 5 and all(abs(s[i] - v) < 1e-12 for i, v in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits >= 0.95 * 500
    assert [i for i, _ in got[100]] == [99, 101, 102, 103, 104]


def test_two_licenses_in_one_line():
    scan = license_scan.Scanner().text
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit, cc = "Licensed under the MIT License.", "Licensed under CC BY-SA 4.0."
    apache, agpl = "Licensed under the Apache License, Version 2.0.", gpl.replace("General", "Affero General")
    for text, want in ((f"Code: {mit} Text: {gpl}", {"MIT", "GPL-3.0"}), (f"{apache} Licensed under CC BY-NC 4.0.", {"Apache-2.0", "CC-BY-NC-4.0"}),
                       (f"Licensed under CC0 1.0. {agpl}", {"CC0-1.0", "AGPL-3.0"}), (f"{mit} {cc}", {"MIT", "CC-BY-SA-4.0"}),
                       (agpl, {"AGPL-3.0"}), (f"{agpl} {agpl}", {"AGPL-3.0"})):
        assert {x[0] for x in scan(text)} == want, text


@pytest.mark.parametrize("width", [30, 60, 78])
def test_notices_over_lines(width):
    for name, text in license_scan.TEMPLATES:
        for front in ("", "# ", " * "):
            wrapped = "\n".join(front + x for x in textwrap.wrap(text, width))
            got = license_scan.Scanner().text(f"Title\n\n{wrapped}\n\nThe end of it.")
            assert [(x[0], x[4]) for x in got] == [(name, 2)], (text, got)


def test_blocks_cover_every_key_word():
    rnd = random.Random(1)
    lines = [" ".join(rnd.choice(["word", "licensed", "x"]) for _ in range(rnd.randint(0, 500))) for _ in range(30)]
    text = "\n".join(lines)
    joined = " ".join(b for _, b in license_scan.candidate_blocks(text))
    assert joined.count("licensed") >= text.count("licensed")


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version on a small corpus."""
    import corpus_pipeline as p

    docs = _corpus(spark, 120, 9).selectExpr("doc_id", "text", "IF(doc_id % 2 = 0, 'en', 'de') AS lang", "concat('s', doc_id % 4) AS source",
                                             "CAST(length(text) AS LONG) AS n_chars")
    docs = docs.unionByName(docs.where("doc_id % 30 = 0")).unionByName(
        spark.createDataFrame([(None, None, None, None, None), (7, "Zz! " * 200, "en", "s1", 800)], "doc_id long, text string, lang string, source string, n_chars long"))
    items = [(1, docs.where("doc_id = 33").first().text)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 360, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r.doc_id, r.text)
    want = collections.Counter(map(key, docs.collect()))

    out = p.quality_filter(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    kept = collections.Counter(map(key, out.collect()))
    keyed = docs.withColumn("k", p._key())
    good = keyed.where("doc_id % 6 = 0").select("k")
    keep = {r.k: r.keep for r in quality.quality(keyed, good, "k").collect()}
    assert kept == collections.Counter({key(r): want[key(r)] for r in keyed.collect() if keep[r.k]})
    assert sum(kept.values()) >= 0.9 * sum(want.values())

    out = p.near_duplicate_filter(spark, docs, str(tmp_path)).collect()
    kept = collections.Counter(map(key, out))
    groups = collections.defaultdict(set)
    for r in near_duplicates(docs.where("doc_id IS NOT NULL")).collect():
        groups[r.component_id].add(r.doc_id)
    assert all(n == 1 for n in kept.values()) and (None, None) in kept
    assert all(len({d for d, _ in kept} & g) == 1 for g in groups.values())

    out = collections.Counter(map(key, p.decontaminate(spark, docs, str(tmp_path)).collect()))
    item = plain_words(items[0][1])
    grams = {tuple(item[i:i + 13]) for i in range(len(item) - 12)} if len(item) >= 13 else {tuple(item)}

    def dirty(text):
        w, hit = plain_words(text), set()
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
        return hit and 20 * len(hit) >= len(w)

    assert out == collections.Counter({k: n for k, n in want.items() if not dirty(k[1])})

    one = docs.dropDuplicates(["doc_id", "text"])
    out = collections.Counter(map(key, p.mix_sources(spark, one, str(tmp_path)).collect()))
    keyed = one.withColumn("k", p._key())
    copies = {r.k: r.copies for r in mixing.mix(keyed, "k").collect()}
    assert out == collections.Counter({key(r): copies[r.k] for r in keyed.collect() if copies[r.k]})

    out = p.shard(spark, docs, str(tmp_path))
    assert out.columns == [*docs.columns, "shard", "slot"] and collections.Counter(map(key, out.collect())) == want
    assert [name for name, _ in p.STAGES] and len(p.STAGES) == 5


def test_digest_of_kept_text(spark):
    r = queries.QUERIES["op2_substring_dedup"](spark, SF).where("n_removed = 0").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(b" ".join(words(text))).hexdigest()


def test_common_words_make_no_candidates(spark):
    # eight words stand in every text, so all fingerprints of them are joint; only one pair shares 13 words
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    common = "these eight common words stand in every text"
    texts = [" ".join([word() for _ in range(10)] + [common] + [word() for _ in range(10)]) for _ in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts[:80])) + [(80, texts[100]), (None, texts[100] + " x")], "key long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts[80:])], "item_key long, item_text string")
    assert sorted((r.key, r.item_key) for r in sharing_pairs(docs.fillna(-1, ["key"]), items).collect()) == [(-1, 20), (80, 20)]
    out = {r.doc_id: r for r in contamination(docs.withColumnRenamed("key", "doc_id"), items, "doc_id", "text", "item_key", "item_text").collect()}
    assert {k for k, r in out.items() if r.contaminated} == {80, None}
    assert out[80].n_hit == 28 and list(out[80]["items"]) == ["20"]


def test_wrappers_around_the_article_stay(spark):
    article = "<article><p>First words.</p><form><p>Mail me</p></form></article>"
    pages = {
        "form": (f"<body><form id=aspnetForm><nav>Menu</nav>{article}<input><label>Name</label></form></body>", "First words."),
        "role": (f"<body><div role=search>{article}</div><div role=search>Find</div></body>", "First words."),
        "label": (f"<body><fieldset><label>{article}</label></fieldset></body>", "First words."),
        "heading": ("<body><form action=/><h1>Head</h1><div>Body text</div><button>Send</button></form></body>", "Head\nBody text"),
        "subscribe": ("<body><form><div>Your mail</div></form><div role=dialog>Accept</div><p>Text <button>Go</button>here</p></body>", "Text here"),
    }
    df = spark.createDataFrame([(k, f"https://{k}.example/", v[0]) for k, v in pages.items()], "page_id string, url string, html string")
    assert {r.page_id: r.text for r in extract_text(df).collect()} == {k: v[1] for k, v in pages.items()}


def test_large_hypergeometric_draws_follow_the_law():
    # small sizes against the law itself
    rng = np.random.default_rng(8)
    for a, b, n in ((5, 7, 6), (40, 400, 90), (3000, 200, 1500)):
        draws = 20_000
        got = collections.Counter(shuffle_shards.ratio_of_uniforms(rng, a, b, n) for _ in range(draws))
        law = {k: math.comb(a, k) * math.comb(b, n - k) / math.comb(a + b, n) for k in range(max(0, n - b), min(a, n) + 1)}
        assert set(got) <= set(law)
        cells = [(got[k], draws * p) for k, p in law.items() if draws * p >= 5]
        chi = sum((x - y) ** 2 / y for x, y in cells)
        assert chi < len(cells) + 4.5 * (2 * len(cells)) ** 0.5
    # 10^12 rows: neighbours' chances in the exact ratio, and mean and deviation as they should be
    a, b, n = 4 * 10**11, 6 * 10**11, 3 * 10**9
    for k in (1_200_000_000, 1_200_050_000, 1_199_900_001):
        step = math.log((a - k) * (n - k)) - math.log((k + 1) * (b - n + k + 1))
        got = shuffle_shards._log_chance(k + 1, a, b, n) - shuffle_shards._log_chance(k, a, b, n)
        assert abs(got - step) < 1e-9
    x = np.array([shuffle_shards._two(rng, a, b, n) for _ in range(4000)], float)
    sd = (n * 0.24 * (a + b - n) / (a + b - 1)) ** 0.5
    assert abs(x.mean() - 0.4 * n) < 4.5 * sd / 4000 ** 0.5 and abs(x.std() / sd - 1) < 0.06


def test_pipeline_bounds_drop_nothing(spark, tmp_path, monkeypatch):
    """Sizes of shards, visits, bins, pieces and broadcasts cut the work of the
    stages, not their results: with tiny ones every stage keeps the same rows."""
    import corpus_pipeline as p
    from tessera.llm import common, ngram_join

    docs = _corpus(spark, 120, 11).selectExpr("doc_id", "text", "'en' AS lang", "concat('s', doc_id % 4) AS source", "CAST(length(text) AS LONG) AS n_chars").cache()
    spark.createDataFrame([(1, docs.where("doc_id = 33").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 360, 6)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    def kept():
        out = [collections.Counter((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()) for _, stage in p.STAGES[:-1]]
        shards = shuffle_shards.uniform_shards(docs, 24, piece_rows=shuffle_shards.PIECE_ROWS).collect()
        return [*out, collections.Counter((r.doc_id, r.text) for r in shards), collections.Counter(r.shard for r in shards)]

    whole = kept()
    for module, name, least in ((ngram_join, "SHARD_SETS", 2), (ngram_join, "VISITORS", 1), (mixing, "BINS", 2), (shuffle_shards, "PIECE_ROWS", 1), (common, "BROADCAST_BYTES", 0)):
        monkeypatch.setattr(module, name, least)
    assert kept() == whole
    assert whole[1].total() < 120 and 0 < whole[2].total() < 120
