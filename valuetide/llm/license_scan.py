"""Licences of files by TF-IDF cosine of headers and licence files to templates, inherited from the nearest ancestor directory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuetide.llm.common import WORD, stored

# Licences by SPDX identifier and the names that they go by.
NAMES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("GPL", "GNU General Public License"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "Eclipse Public License, version 2.0"),
    ("BSL-1.0", "Boost Software License, Version 1.0"),
    ("Unlicense", "The Unlicense"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
]

# The ways in which a name is put into a sentence.
PHRASES = ["{0}", "Released under the {0}.", "Licensed under the {0}.", "Licensed under {0}.", "This work is licensed under the {0}.", "This software is distributed under the terms of the {0}."]

# Notices and licence texts, with their usual line breaks.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""
_GNU_NOTICE = """This {0} is free software: you can redistribute it and/or modify
it under the terms of the GNU {1} as published by
the Free Software Foundation, either version {2} of the License, or
(at your option) any later version."""
TEXTS = [
    ("MIT", f"{_MIT_GRANT}\n\n{_MIT_REST}"),
    ("MIT", _MIT_GRANT),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_THIRD}\n{_BSD_REST}"),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    ),
    ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", _GNU_NOTICE.format("program", "General Public License", "2")),
    ("GPL-3.0", _GNU_NOTICE.format("program", "General Public License", "3")),
    ("LGPL-2.1", _GNU_NOTICE.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU_NOTICE.format("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", _GNU_NOTICE.format("program", "Affero General Public License", "3")),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\nCopyright (C) 1989, 1991 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\nCopyright (C) 2007 Free Software Foundation, Inc."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\nCopyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.\nIf a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use are permitted under the BSD 3-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
]
#: Single lines of these notices name a licence, but not its version.
LINE_NAMES = [("it under the terms of the GNU General Public License as published by", "GPL"), ("it under the terms of the GNU Lesser General Public License as published by", "LGPL"), ("it under the terms of the GNU Affero General Public License as published by", "AGPL-3.0")]

#: A sentence or line is looked at if it has one of these.
HINTS = "licen[cs]e|copyright|rights reserved|spdx|permission is hereby|permission to use|redistribution|public domain|under the terms|free software|source code form"
#: Least cosine of a window to a template, and least share of a text's words in its best window for a licence file.
COSINE = 0.75
FILE_SHARE = 0.5
#: Sentences and lines of a window; the longer ones begin only where no hint stands in the sentence before.
WINDOW_UNITS = [1, 2, 3, 4, 8, 16, 32]
SHORT_UNITS = 2
#: A sentence of more words is also cut into windows of words around its hints: words before the hint, words in all.
LONG_WORDS = 24
WORD_WINDOWS = [(before, size) for before in (0, 3, 6) for size in (4, 7, 11, 16)]
#: A file of this name is a licence file if it has a licence.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice|copyright)[^/]*$"
#: Directories with a licence that are sent to every task; more are joined by a shuffle.
BROADCAST_DIRS = 200_000

_TERM = r"[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9]|[A-Za-z0-9]"
_HINT_WORD = "licen[cs]|copyright|reserved|spdx|permission|redistribut|domain"


def templates() -> list[tuple[str, str]]:
    """(licence, text): SPDX lines, names in their phrases, notices and texts, and telling lines of notices."""
    spdx = [(name, f"SPDX-License-Identifier: {name}") for name, _ in NAMES if re.search(r"\d|^[A-Z]+$|Unlicense", name)]
    spdx += [(name, f"SPDX-License-Identifier: {name}{end}") for name, _ in NAMES if "GPL-" in name for end in ("-only", "-or-later")]
    named = [(name, phrase.format(title)) for name, title in NAMES for phrase in PHRASES]
    return spdx + named + TEXTS + [(name, line) for line, name in LINE_NAMES]


def terms_of(text: str) -> list[str]:
    return re.findall(_TERM, text.lower())


def _term_column(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_TERM})"), F.lit(1))


def units_of(text: Column) -> Column:
    """Lines, cut again after sentences, without those that hold no word."""
    return F.filter(F.split(text, r"\n|(?<=[.!?;])\s+"), lambda u: u.rlike("[A-Za-z0-9]"))


def windows_of(units: Column, hinted: Column) -> Column:
    """Runs of units from each one with a hint, and runs of words around the hints of long units.

    ``units`` and ``hinted`` must be plain columns: inside a lambda an expression is worked out anew for each element.
    """
    at = F.filter(F.sequence(F.lit(1), F.size(units)), lambda i: F.element_at(hinted, i))
    first = lambda i: (i == 1) | ~F.element_at(hinted, F.greatest(i - 1, F.lit(1)))
    sizes = F.array(*[F.lit(n) for n in WINDOW_UNITS])
    runs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(sizes, lambda n: (n <= SHORT_UNITS) | first(i)), lambda n: F.array_join(F.slice(units, i, n), "\n"))))
    long = F.filter(F.transform(at, lambda i: F.split(F.trim(F.element_at(units, i)), r"\s+")), lambda w: F.size(w) > LONG_WORDS)

    def cut(words: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(words)), lambda j: F.lower(F.element_at(words, j)).rlike(_HINT_WORD))
        shapes = F.array(*[F.struct(F.lit(b).alias("before"), F.lit(n).alias("size")) for b, n in WORD_WINDOWS])
        return F.flatten(F.transform(places, lambda j: F.transform(shapes, lambda s: F.array_join(F.slice(words, F.greatest(F.lit(1), j - s["before"]), s["size"]), " "))))

    # a sequence over no units would run backwards
    return F.when(F.size(units) > 0, F.array_distinct(F.concat(runs, F.flatten(F.transform(long, cut)))))


def with_windows(files: DataFrame) -> DataFrame:
    """``files`` (with ``text``) with ``windows`` and ``words`` in place of the text, both null where no hint stands.

    Each step's arrays pass a generator of one row, so that the next step reads them as columns.
    """
    kept = [c for c in files.columns if c != "text"]
    text = F.col("text")
    read = F.when(F.lower(text).rlike(HINTS), F.struct(units_of(text).alias("units"), F.regexp_count(text, F.lit(WORD)).alias("words")))
    units = files.select(*kept, F.explode(F.array(read)).alias("read"))
    flagged = units.select(*kept, "read", F.explode(F.array(F.transform("read.units", lambda u: F.lower(u).rlike(HINTS)))).alias("hinted"))
    plain = flagged.select(*kept, F.explode(F.array(F.struct("read.units", "read.words", "hinted"))).alias("read"))
    return plain.select(*kept, windows_of(F.col("read.units"), F.col("read.hinted")).alias("windows"), F.col("read.words").alias("words"))


def _template_terms(spark: SparkSession) -> DataFrame:
    rows = []
    for k, (name, text) in enumerate(templates()):
        terms = terms_of(text)
        rows += [(k, name, len(terms), t, terms.count(t)) for t in sorted(set(terms))]
    return spark.createDataFrame(rows, "template int, licence string, size int, term string, tf int")


def score_windows(windows: DataFrame) -> DataFrame:
    """``window, licence, cosine``: the best template of each distinct window that reaches COSINE.

    Inverse document frequencies are counted over all windows and templates. Of templates whose cosines are in the same
    twentieth the one of most terms counts, then the higher cosine, then the smaller name.
    """
    known = _template_terms(windows.sparkSession)
    made = windows.select("window").distinct().select("window", F.xxhash64("window").alias("w1"), F.hash("window").alias("w2"))
    keyed = stored(made.select("window", F.struct("w1", "w2", F.length("window").alias("w3")).alias("w")))
    terms = stored(keyed.select("w", F.explode(_term_column(F.col("window"))).alias("term")).groupBy("w", "term").agg(F.count("*").alias("tf")))
    total = keyed.count() + len(templates())
    held = terms.groupBy("term").agg(F.count("*").alias("n")).unionByName(known.groupBy("term").agg(F.count("*").alias("n")))
    idf = stored(held.groupBy("term").agg(F.sum("n").alias("n")).select("term", (F.log(F.lit(float(1 + total)) / (1 + F.col("n"))) + 1).alias("idf")))
    weighed = terms.join(idf, "term").select("w", "term", (F.col("tf") * F.col("idf")).alias("v"))
    fitted = stored(known.join(idf, "term").select("template", "licence", "size", "term", (F.col("tf") * F.col("idf")).alias("t")))
    lengths = F.broadcast(fitted.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("length")))  # a row per template
    norms = weighed.groupBy("w").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dots = weighed.join(F.broadcast(fitted), "term").groupBy("w", "template", "licence", "size").agg(F.sum(F.col("v") * F.col("t")).alias("dot"))  # a row per template's term
    near = dots.join(lengths, "template").join(norms, "w").withColumn("cosine", F.round(F.col("dot") / (F.col("norm") * F.col("length")), 9)).where(F.col("cosine") >= COSINE)
    order = F.struct((-F.floor(F.col("cosine") * 20 + 1e-6)).alias("class"), (-F.col("size")).alias("size"), (-F.col("cosine")).alias("c"), "licence")
    best = near.groupBy("w").agg(F.min(order).alias("b"))
    return keyed.join(best, "w").select("window", F.col("b.licence").alias("licence"), (-F.col("b.c")).alias("cosine"), (-F.col("b.size")).alias("terms"))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory, its parents and the root (''), as an array."""
    parts = F.split(directory, "/")
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, n), "/"))))


def scan_licences(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path", broadcast_dirs: int = BROADCAST_DIRS) -> DataFrame:
    """``doc_id, path, own_licence, cosine, licence, inherited_from`` of every row of ``files``.

    Texts are cut into lines and sentences; from each with a hint, windows of one to 32 of them (and of words around the hint in long sentences) are compared with
    SPDX lines, names, notices and licence texts. The row's own licence is that of its best window (see ``score_windows``; then the
    longer window). A row whose best window holds at least FILE_SHARE of its words, or whose file
    name says so, is a licence file of its directory; of several the best, then the smallest path counts. Rows without an own
    licence take that of the nearest directory above them (their own first) with a licence file.

    Null and empty texts have none of their own; a null path has no directory and inherits nothing; repeated rows each get their
    row; ties go to the smaller name; very long texts give windows around their hints only, each once; other columns are ignored; an empty
    table gives an empty result.

    Only windows leave the scan, and only distinct ones are scored, by a hash of 96 bits and their length. Directories are resolved once each and sent to
    all tasks (up to ``broadcast_dirs`` of them, else joined), so one that holds a third of all files gathers nothing.
    """
    source = files.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    found = stored(with_windows(source.select("row", "doc_id", "path", directory_of(F.col("path")).alias("dir"), "text")))
    each = found.select("row", "path", "dir", "words", F.explode("windows").alias("window"))
    scores = score_windows(each)
    best = each.join(scores, "window").withColumn("share", F.regexp_count("window", F.lit(WORD)) / F.col("words"))
    order = F.struct((-F.floor(F.col("cosine") * 20 + 1e-6)).alias("class"), (-F.col("terms")).alias("terms"), (-F.col("cosine")).alias("c"), "licence", (-F.col("share")).alias("share"), "dir", "path")
    own = stored(
        best.groupBy("row").agg(F.min(order).alias("b"), F.max(F.struct("share", "licence")).alias("widest"))
        .select("row", F.col("b.licence").alias("own_licence"), (-F.col("b.c")).alias("cosine"), "b.dir", "b.path", F.col("widest.share").alias("share"))
    )
    file = (F.col("share") >= FILE_SHARE) | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))
    held = own.where(file & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own_licence")).alias("b"))
    held = held.select(F.col("dir").alias("above"), F.col("b.own_licence").alias("given"))
    dirs = found.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.array_distinct(ancestors(F.col("dir")))).alias("above"))
    nearest = stored(dirs.join(held, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "given")).alias("n")).select("dir", F.col("n.above").alias("above"), F.col("n.given").alias("given")))
    if nearest.count() <= broadcast_dirs:
        nearest = F.broadcast(nearest)
    joined = found.select("row", "doc_id", "path", "dir").join(own.select("row", "own_licence", "cosine"), "row", "left").join(nearest, "dir", "left")
    return joined.select(
        "doc_id", "path", "own_licence", "cosine", F.coalesce("own_licence", "given").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("above")).alias("inherited_from")
    )
