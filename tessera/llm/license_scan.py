"""License scan by conditional compression (operator 1).

The words around a key that may speak of a license are searched for every
template: its wording must be there, and no word that tells licenses apart may
differ.  What is found is compressed on its own and with the template as a raw
zstandard dictionary; the template that saves most is the notice, its words are
taken out, and the rest is searched again until nothing is found.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Public license notices, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
#: A block is looked at if it holds one of these.
KEYS = ("licen", "copyright", "redistribut", "permission", "public domain", "creative commons", "free software")
#: Rank by compression that a template reaches at least on its own text, share
#: of a template's words that must be there, and words looked at to either side
#: of a key (the longest template has fewer).
RANKED, SHARE, AROUND = 5, 0.9, 120
_KEY = re.compile("|".join(KEYS).replace(" ", r"\s+(?:\W+\s+)?"), re.I)
#: A word may go on in the next line after its hyphen.
_WORD = re.compile(r"[^\W_]+(?:(?:[.\-/]|-[ \t\r]*\n[ \t#*/;%]*)[^\W_]+)*", re.U)
_BROKEN = re.compile(r"-\s\W*")
#: Words that do not tell licenses apart; any other missing word refuses.
_PLAIN = frozenset("a an and any as by either following for if in is it of or out that the this to under with you your".split())


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


_TEMPLATE_WORDS = [_words(t) for _, t in TEMPLATES]
_TELLING = [set(ws) - _PLAIN for ws in _TEMPLATE_WORDS]


class Scanner:
    """The templates as prepared dictionaries; one object a task."""

    def __init__(self):
        self._plain = zstandard.ZstdCompressor(level=3)
        self._with = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
                      for _, t in TEMPLATES]
        self._known: dict[str, list] = {}

    def rank(self, block: str) -> list[tuple[float, int]]:
        """(share of the size saved, template), most saving first."""
        raw = block.lower().encode("utf-8", "surrogatepass")
        alone = len(self._plain.compress(raw))
        return sorted(((1 - len(c.compress(raw)) / alone, -k) for k, c in enumerate(self._with)), reverse=True)

    def _place(self, want: list[str], have: list[str], match: SequenceMatcher):
        """(words of ``have`` that are the template's, missing, between) at the
        first place that confirms the template, or None."""
        least = SHARE * len(want) / (0.3 * len(want) + 1)  # the longest run of a place that confirms
        have, slack = list(have), len(want) // 5 + 1
        while True:
            match.set_seq1(want)
            top = match.find_longest_match(0, len(want), 0, len(have))
            if top.size < least:
                return None
            lo = max(0, top.b - top.a - slack)
            near = have[lo:top.b + len(want) - top.a + slack]
            same = [m for m in SequenceMatcher(None, want, near, autojunk=False).get_matching_blocks() if m.size]
            kept = sum(m.size for m in same)
            missing = [w for i, w in enumerate(want) if not any(m.a <= i < m.a + m.size for m in same)]
            between = same[-1].b + same[-1].size - same[0].b - kept if same else 0
            if kept >= SHARE * len(want) and not set(missing) - _PLAIN and between <= 0.2 * len(want):
                return [lo + m.b + i for m in same for i in range(m.size)], len(missing), between
            have[top.b:top.b + top.size] = ["\0"] * top.size
            match = SequenceMatcher(None, want, have, autojunk=False)

    def block(self, block: str) -> list[tuple[str, float, int, int, int]]:
        """(license, size saved, template words missing, words in between, line
        breaks in front) of every notice of a block, the best one a license."""
        got = self._known.get(block)
        if got is None:
            if len(self._known) > 20_000:
                self._known.clear()
            at = [m.span() for m in _WORD.finditer(block)]
            have = [_BROKEN.sub("-", block[lo:hi].lower()) for lo, hi in at]
            found: dict[str, tuple] = {}
            while True:
                held, match, best = set(have), SequenceMatcher(None, [], have, autojunk=False), None
                for k, want in enumerate(_TEMPLATE_WORDS):
                    place = self._place(want, have, match) if _TELLING[k] <= held else None
                    if place:
                        lo, hi = at[place[0][0]][0], at[place[0][-1]][1]
                        raw = block[lo:hi].lower().encode("utf-8", "surrogatepass")
                        alone = len(self._plain.compress(raw))
                        less = alone - len(self._with[k].compress(raw))
                        if less > 0 and (best is None or less > best[0]):
                            best = less, place[0], (TEMPLATES[k][0], less / alone, place[1], place[2], block.count("\n", 0, lo))
                if best is None:
                    break
                for i in best[1]:
                    have[i] = "\0"
                name = best[2][0]
                if name not in found or best[2][1] > found[name][1]:
                    found[name] = best[2]
            got = self._known[block] = list(found.values())
        return got

    def text(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, size saved, missing, between, first line) of a text."""
        if not text or not _KEY.search(text):
            return []
        out: dict[str, tuple] = {}
        for n, block in candidate_blocks(text):
            for name, saved, missing, between, line in self.block(block):
                if name not in out or saved > out[name][1]:
                    out[name] = (name, saved, missing, between, n + line)
        return sorted(out.values())


def candidate_blocks(text: str):
    """(number of the first line, block): the text from AROUND words in front of
    a key to AROUND words after it, over any lines; what overlaps is one."""
    words = [m.span() for m in re.finditer(r"\S+", text)]
    starts = [lo for lo, _ in words]
    spans: list[list[int]] = []
    for m in _KEY.finditer(text):
        first, last = (bisect_right(starts, x) - 1 for x in (m.start(), m.end() - 1))
        lo, hi = max(0, first - AROUND), min(len(words), last + AROUND + 1)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        else:
            spans.append([lo, hi])
    line = at = 0
    for lo, hi in spans:
        start = starts[lo]
        line, at = line + text.count("\n", at, start), start
        yield line, text[start:words[hi - 1][1]]


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that the notices in each text name.

    Returns one row per input row: the id and ``licenses``, by identifier: the
    name, ``saved`` (share of the compressed size that the template saves),
    ``missing`` (template words that are not there; only words that tell no
    licenses apart), ``between`` (words set in between) and ``line`` (number of
    the line in which the notice begins, from 0).

    A null or empty text names none; repeated rows get equal results; a null id
    stays null; other columns are not read.  No rows, no rows.  Texts are read
    whole; nothing is shuffled."""
    id_type = df.schema[id_col].dataType
    one = StructType([StructField("license", StringType()), StructField("saved", DoubleType()), StructField("missing", IntegerType()),
                      StructField("between", IntegerType()), StructField("line", LongType())])

    def scan(batches):
        scanner = Scanner()
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "licenses": [scanner.text(t) for t in pdf["text"]]})

    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).mapInPandas(
        scan, StructType([StructField("id", StringType()), StructField("licenses", ArrayType(one))]))
    return out.select(F.col("id").cast(id_type).alias(id_col), "licenses")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over whole `documents`: per document the licenses named,
    comma-joined, how many, and the greatest share of size saved."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.concat_ws(",", F.transform("licenses", lambda x: x["license"])).alias("licenses"),
                      F.size("licenses").cast("long").alias("n_licenses"), F.array_max(F.transform("licenses", lambda x: x["saved"])).alias("saved"))
