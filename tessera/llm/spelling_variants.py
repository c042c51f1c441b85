"""Spelling variants of frequent words (operator 12): words at edit distance
one, found with bit-sliced position indexes.

An index holds, for every position and letter, the set of its words that have
that letter there, as one long integer with a bit a word.  A query word runs
through its letters once and keeps three sets: words that agree so far, words
with one letter replaced, and words with one letter less (compared one position
further left).  All words of the index take each step together.

The vocabulary is cut into indexes so that no link is lost: two words differ at
one place of the longer one, the first where they part, and that place lies in
the first or the second half of its length; outside that half the two are the
same.  So each word goes, for its own length and for the next (as the shorter
word), into one index for each half, by the letters outside.  An index of too
many words has its half cut again, down to single positions, where an index
holds at most a word for every letter and one shorter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import _LOWER, batches_of, sized, stored

RUN = re.compile("[a-zÀ-ÿ]+")
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
#: Words of one index.
INDEX_WORDS = 4096
#: Different words that a task counts before it hands the counts on.
HELD_WORDS = 200_000
#: One run of letters in so many of a document has a letter deleted.
DAMAGED = 199


def damaged(doc_id: str, run: str) -> str:
    """The run, with one letter deleted where the crc32 of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words of all whole texts after ``damaged``, with at least
    so many letters and occurrences.  All runs of a document that are equal are
    damaged alike, so a document's runs are counted first."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for pdf in batches:
            for i, text in zip(pdf["id"].tolist(), pdf["text"].tolist(), strict=True):
                runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")))
                name = i or ""
                for run, n in runs.items():
                    if len(run) >= min_letters:
                        word = damaged(name, run)
                        if len(word) >= min_letters:
                            held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame(held.items(), columns=["word", "n"])
                    held.clear()
        if held:
            yield pd.DataFrame(held.items(), columns=["word", "n"])

    counted = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _letters(word: Column, start: Column, end: Column) -> Column:
    """Letters of ``word`` from ``start`` (counted from 0) to before ``end``."""
    return F.substring(word, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def _keyed(places: DataFrame) -> DataFrame:
    """Rows (word, n, long: length of the longer word, start, end) with the key
    of their index: length, half and the letters outside the half, which are one
    position further left behind it where the word is the shorter one."""
    longer, length = F.col("long"), F.length("word")
    rest = _letters(F.col("word"), F.col("end") - (longer - length), length)
    return places.select("word", "n", "long", "start", "end", F.concat_ws(
        ":", "long", "start", "end", _letters(F.col("word"), F.lit(0), F.col("start")), rest).alias("key"))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice, for either half of its stretch."""
    mid = F.floor((F.col("start") + F.col("end")) / 2)
    both = F.array(F.struct(F.col("start").cast("long").alias("start"), mid.alias("end")), F.struct(mid.alias("start"), F.col("end").cast("long").alias("end")))
    return rows.select("word", "n", "long", F.explode(both).alias("half")).select("word", "n", "long", "half.start", "half.end")


def index_rows(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(key, word, n, long, start, end): every word once for each index it is in."""
    length = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(length, length + 1)).alias("long"))
    rows = _keyed(_halves(sides.select("word", "n", "long", F.lit(0).alias("start"), F.col("long").alias("end"))))
    rows, ready = stored(rows, "variant-rows"), []
    while True:
        crowded = rows.where(F.col("end") - F.col("start") > 1).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > index_words)
        crowded = sized(crowded.select("key"), "variant-crowded")
        if crowded.isEmpty():
            break
        ready.append(rows.join(crowded, "key", "left_anti"))
        rows = stored(_keyed(_halves(rows.join(crowded, "key", "left_semi"))), "variant-rows")
    for r in ready:
        rows = rows.unionByName(r)
    return rows


def near_in_index(words: list[tuple[int, str]], longer: int, start: int, end: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, count of the best one, the best one) for every word
    with near ones in an index of (count, word) pairs: those of ``longer``
    letters and those with one less, which differ at a place from ``start`` to
    before ``end`` where they first part.  Best is the largest count, then the
    smallest word."""
    words = sorted(words, key=lambda x: (-x[0], x[1]))  # so the lowest bit of a set is the best
    n_places = end - start
    at: list[dict[str, int]] = [{} for _ in range(n_places)]
    same = shorter = 0
    for k, (_, w) in enumerate(words):
        bit = 1 << k
        if len(w) == longer:
            same |= bit
        else:
            shorter |= bit
        for letters, c in zip(at, w[start:end], strict=False):
            letters[c] = letters.get(c, 0) | bit
    if not same:
        return
    count, best = [0] * len(words), [-1] * len(words)
    for k, (_, w) in enumerate(words):
        if len(w) != longer:
            continue
        agree, replaced, deleted, left = same | shorter, 0, 0, {}
        for letters, c in zip(at, w[start:end], strict=True):
            here = letters.get(c, 0)
            part = agree & ~here  # the first place where they part
            deleted = deleted & left.get(c, 0) | part & shorter  # compared one position further left
            replaced = replaced & here | part & same
            agree &= here
            left = letters
        found = replaced | deleted
        if found:
            count[k] += found.bit_count()
            first = (found & -found).bit_length() - 1
            best[k] = first if best[k] < 0 else min(best[k], first)
        while deleted:
            j = (deleted & -deleted).bit_length() - 1
            deleted &= deleted - 1
            count[j] += 1
            best[j] = k if best[j] < 0 else min(best[j], k)
    for k, (_, w) in enumerate(words):
        if count[k]:
            yield w, count[k], words[best[k]][0], words[best[k]][1]


def near_words(words: DataFrame, index_words: int = INDEX_WORDS) -> DataFrame:
    """(word, n_near, best): the number of words at edit distance one, and the
    commonest of them (ties: the smallest) with its count."""
    rows = index_rows(words, index_words)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def each():
            for pdf in batches:
                yield from zip(*(pdf[c].tolist() for c in ("key", "n", "word", "long", "start", "end")), strict=True)

        out: list[tuple] = []
        for _, group in groupby(each(), key=lambda r: r[0]):
            members = list(group)
            if len(members) > 1:
                out.extend(near_in_index([r[1:3] for r in members], *members[0][3:]))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])
                out = []
        yield pd.DataFrame(out, columns=["word", "near", "best_n", "best"])

    found = rows.repartition("key").sortWithinPartitions("key").mapInPandas(search, "word string, near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")).select(
        "word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): each word's last form.  Steps double,
    so a chain of n forms takes log2(n) joins; forms get commoner by a factor
    each step, so chains are short and end."""
    known = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        nxt = known.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        known = stored(known.join(nxt, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "variant-roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.drop("moved")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_letters: int = MIN_LETTERS,
                      min_count: int = MIN_COUNT, ratio: int = RATIO, index_words: int = INDEX_WORDS) -> DataFrame:
    """Words of all texts with their usual spelling: ``word``, ``n`` (its
    occurrences), ``n_near`` (words at edit distance one), ``form`` and
    ``form_n`` (the commonest of these and its count, if at least ``ratio``
    times the word's; else null) and ``root`` (the last form from form to form).

    A null or empty text has no words; a null id counts as an empty one.  Rows
    repeated count each time.  Of equally common near words the smallest in
    code-point order is the form.  No text, no rows.  Texts are read whole, and
    other columns, whatever their names, not at all."""
    with batches_of(docs.sparkSession):
        words = stored(word_counts(docs, id_col, text_col, min_letters, min_count), "variant-words")
    found = words.join(near_words(words, index_words), "word", "left")
    usual = F.col("best_n") >= ratio * F.col("n")
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(usual, F.col("best")).alias("form"),
                                F.when(usual, F.col("best_n")).alias("form_n")), "variant-forms")
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 12: the words of `documents` and their usual spellings."""
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
