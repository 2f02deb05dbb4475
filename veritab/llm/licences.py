"""License scans: TF-IDF cosine of notices to templates, then inheritance from the nearest licence file above.

Units are header blocks: runs of neighbouring lines around each line that holds a marker word, from up to BEFORE lines
before it, LENGTHS lines from the marker on, comment signs stripped; runs of several lines have at most BLOCK_CHARS
characters, a marker line alone has any length. The whole text of a file whose name is that of a licence file is a
unit too. Equal units are scored once. A unit's terms are its lower-cased runs of ASCII letters and digits, weighted by
count times ln((1 + templates) / (1 + templates with the term)) + 1; terms that no template has weigh most and only
lengthen the unit. Only terms shared with a template are joined, so the products are sparse, and the template side is
a constant. A unit's licence is that of the template with the highest cosine, from LEAST on, ties to the first
licence in code point order. Each marker line speaks for the best unit that covers it (highest cosine, ties to the
first licence), so parts of a notice do not name a sibling of its licence. A file's licences are those of its lines.

A file has the licences of its own units. One without takes those of the licence file in the nearest directory above
it (its own directory first): the ancestors of every distinct directory are joined to the directories of licence
files by equality, so files meet one row of their directory and no prefix is compared with another. Licence files
themselves inherit like other files if their text names no licence.

Defined cases: null text counts as empty; a null path has no directory and inherits nothing; files without any
licence get null. A file's own licences follow from its text and its kind alone, so rows with equal or null paths are
judged each on its own and repeated rows alike; licence files of one directory count together. An empty table gives
no rows. Other columns are kept, whatever their names. Column expressions only.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.columns import ascii_lower, fresh_name, let
from veritab.session import durable

LEAST = 0.7
# Marker words, names of licence files, and the notices that licences ask for.
MARKER = (
    r"(?i)licen[sc]|copyright|warrant|permission is hereby|hereby granted|redistribution|public domain|"
    r"written permission|without fee"
)
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"
#: Signs of comments at both ends of a line.
COMMENT = r"^[\x20\x09-\x0D#*/;%!<>-]+|[\x20\x09-\x0D*/#>-]+$"
BEFORE, LENGTHS, BLOCK_CHARS = 3, (1, 2, 3, 4, 5, 6, 7, 8, 12, 16, 24), 4000


def _gnu(name: str, version: str, work: str = "program") -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        f"License as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version."
    )


_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
    "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
    "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
    "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_END = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    'the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_CREATIVE = {
    "CC-BY-4.0": "Attribution",
    "CC-BY-SA-4.0": "Attribution-ShareAlike",
    "CC-BY-NC-4.0": "Attribution-NonCommercial",
    "CC-BY-NC-SA-4.0": "Attribution-NonCommercial-ShareAlike",
}
_GNU = {
    "GPL-2.0": ("General Public", "2", "June 1991"),
    "GPL-3.0": ("General Public", "3", "29 June 2007"),
    "LGPL-2.1": ("Lesser General Public", "2.1", "February 1999"),
    "LGPL-3.0": ("Lesser General Public", "3", "29 June 2007"),
    "AGPL-3.0": ("Affero General Public", "3", "19 November 2007"),
}
#: Public licences' own notices, titles and short texts, and the usual one-line forms.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    # The conditions alone would also fit the first part of the longer licence; with the disclaimer they don't.
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD_2 + _BSD_3),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    *((c, f"Licensed under {' '.join(c.rsplit('-', 1)).replace('-', ' ', 1)}.") for c in _CREATIVE),
    *(
        (c, f"This work is licensed under a Creative Commons {name} 4.0 International License.")
        for c, name in _CREATIVE.items()
    ),
    *((c, f"This work is licensed under the GNU {name} License, version {v}.") for c, (name, v, _) in _GNU.items()),
    *((c, f"GNU {name.upper()} LICENSE Version {v}, {day}") for c, (name, v, day) in _GNU.items()),
    *((c, _gnu(name, v, "library" if name[0] == "L" else "program")) for c, (name, v, _) in _GNU.items()),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_END),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ),
)


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(ascii_lower(text), "[^a-z0-9]+", " "), " "), "")


def _template_terms() -> tuple[list[tuple[int, str, str, float]], float]:
    """(template, licence, term, weight of the term in the template's unit vector), and the weight of an unknown term."""
    counts = []
    for licence, text in TEMPLATES:
        found: dict[str, int] = {}
        for term in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split():
            found[term] = found.get(term, 0) + 1
        counts.append((licence, found))
    n = len(counts)
    frequency: dict[str, int] = {}
    for _, found in counts:
        for term in found:
            frequency[term] = frequency.get(term, 0) + 1
    weight = {t: log((1 + n) / (1 + d)) + 1 for t, d in frequency.items()}
    rows = []
    for k, (licence, found) in enumerate(counts):
        norm = sum((c * weight[t]) ** 2 for t, c in found.items()) ** 0.5
        rows += [(k, licence, t, weight[t], c * weight[t] / norm) for t, c in found.items()]
    return rows, log(1 + n) + 1


def score_units(units: DataFrame) -> DataFrame:
    """(uid, licence, cosine) of each distinct unit (uid, unit) that is close enough to a template.

    ``uid`` stands for the text of a unit, which would otherwise travel with each of its terms.
    """
    spark = units.sparkSession
    rows, unknown = _template_terms()
    templates = spark.createDataFrame(rows, "template int, licence string, term string, weight double, share double")
    weights = F.broadcast(templates.select("term", "weight").distinct())  # a few hundred terms, constant
    counted = (
        units.select("uid", "unit")
        .dropDuplicates(["uid"])
        .select("uid", F.explode(terms(F.col("unit"))).alias("term"))
        .groupBy("uid", "term")
        .agg(F.count("*").alias("n"))
        .join(weights, "term", "left")
        .withColumn("value", F.col("n") * F.coalesce("weight", F.lit(unknown)))
    )
    norms = counted.groupBy("uid").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    products = (
        counted.join(F.broadcast(templates.select("template", "licence", "term", "share")), "term")
        .groupBy("uid", "template", "licence")
        .agg(F.sum(F.col("value") * F.col("share")).alias("product"))
    )
    cosine = F.round(F.col("product") / F.col("norm"), 6)
    scored = products.join(norms, "uid").select("uid", "licence", cosine.alias("cosine"))
    best = F.max_by("licence", F.struct("cosine", "order"))
    return (
        scored.where(F.col("cosine") >= LEAST)
        .withColumn("order", -_place(F.col("licence")))
        .groupBy("uid")
        .agg(best.alias("licence"), F.max("cosine").alias("cosine"))
    )


def directory(path: Column) -> Column:
    """The part before the last slash; empty for a name alone, null for null."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """``folder`` and all above it, the top ('') included."""
    parts = F.split(folder, "/")
    return F.array_union(
        F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
        F.array(F.lit("")),
    )


def _blocks(text: Column) -> Column:
    """(line, first, last, lines) of each marker line of ``text``: its number from 1 and the lines around it."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, COMMENT, ""))
    reach = LENGTHS[-1]

    def around(ls: Column) -> Column:
        marked = F.filter(F.sequence(F.lit(1), F.size(ls)), lambda i: F.get(ls, i - 1).rlike(MARKER))
        return F.transform(
            marked,
            lambda i: F.struct(
                i.alias("line"),
                F.slice(ls, F.greatest(i - BEFORE, F.lit(1)), i + reach - F.greatest(i - BEFORE, F.lit(1))).alias("near"),
                (i - F.greatest(i - BEFORE, F.lit(1))).alias("before"),
            ),
        )

    return let(lines, around)


def _units(near: Column, before: Column) -> Column:
    """(from, to, unit): the runs of the lines ``near`` that hold the marker line, ``before`` lines before it or fewer."""

    def run(back: Column, length: Column) -> Column:
        return F.struct(
            back.alias("back"), length.alias("length"),
            F.array_join(F.slice(near, before - back + 1, back + length), " ").alias("unit"),
        )

    lengths = F.filter(F.array(*[F.lit(n) for n in LENGTHS]), lambda n: (n == 1) | (n <= F.size(near) - before))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), before), lambda b: F.transform(lengths, lambda n: run(b, n))))
    alone = lambda r: (r["back"] == 0) & (r["length"] == 1)
    return F.filter(runs, lambda r: alone(r) | (F.length(r["unit"]) <= BLOCK_CHARS))


def own_licences(files: DataFrame) -> DataFrame:
    """(key, own, cosine) of each of ``files`` (key, is_licence, text; one row a key) that names a licence."""
    marked = files.where(F.col("text").rlike(MARKER))
    runs = (
        marked.select("key", F.explode(_blocks(F.col("text"))).alias("b"))
        .select("key", "b.line", F.explode(_units(F.col("b.near"), F.col("b.before"))).alias("u"))
        .select("key", (F.col("line") - F.col("u.back")).alias("first"), (F.col("line") + F.col("u.length") - 1).alias("last"), "u.unit")
    )
    whole = files.where("is_licence").select("key", F.lit(1).alias("first"), F.lit(2**31 - 1).alias("last"), F.col("text").alias("unit"))
    units = durable(runs.unionByName(whole).withColumn("uid", F.md5("unit")).dropDuplicates(["key", "first", "last"]))
    found = units.drop("unit").join(score_units(units), "uid")
    lines = units.where("last < 2147483647").select("key", F.col("first").alias("line"), "last").where("line = last").select("key", "line").distinct()
    # A run covers its own lines only: at most BEFORE + LENGTHS[-1]; a whole text stands for itself as line 0.
    covered = found.where("last < 2147483647").select(
        "key", "licence", "cosine", F.explode(F.sequence("first", "last")).alias("line")
    )
    spoken = covered.join(lines, ["key", "line"]).unionByName(
        found.where("last = 2147483647").select("key", "licence", "cosine", F.lit(0).alias("line"))
    )
    best = spoken.groupBy("key", "line").agg(
        F.max("cosine").alias("cosine"), F.max_by("licence", F.struct("cosine", -_place(F.col("licence")))).alias("licence")
    )
    return best.groupBy("key").agg(F.sort_array(F.collect_set("licence")).alias("own"), F.max("cosine").alias("cosine"))


def _place(licence: Column) -> Column:
    """Place of a licence in code point order."""
    names = sorted({name for name, _ in TEMPLATES})
    return F.create_map(*[F.lit(x) for k, name in enumerate(names) for x in (name, k)])[licence]


def scan(df: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``df`` with ``own`` (its licences, sorted), ``cosine`` (of the best), ``licences`` and ``inherited_from``."""
    names = {n: fresh_name(df, n) for n in ("own", "cosine", "licences", "inherited_from")}
    at = {n: fresh_name(df, f"licence_{n}") for n in ("key", "folder", "own", "cosine", "above", "given", "own_key", "in_folder")}
    t = F.coalesce(df[text], F.lit(""))
    is_licence = F.coalesce(F.element_at(F.split(df[path], "/"), -1).rlike(LICENCE_FILE), F.lit(False))
    key = F.concat(F.md5(t), is_licence.cast("string"))
    seen = df.select(key.alias("key"), is_licence.alias("is_licence"), t.alias("text"), df[path].alias("path"))
    telling = seen.where(F.col("is_licence") | F.col("text").rlike(MARKER))
    of_text = durable(own_licences(telling.dropDuplicates(["key"]).drop("path")))
    of_folder = (
        telling.where("is_licence AND path IS NOT NULL")
        .select(directory(F.col("path")).alias("above"), "key")
        .distinct()
        .join(of_text, "key")
        .groupBy("above")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("given"))
    )
    folders = df.select(directory(df[path]).alias("folder")).where("folder IS NOT NULL").distinct()
    nearest = (
        folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("above"))
        .join(of_folder, "above")
        .groupBy("folder")
        .agg(F.max_by(F.struct("above", "given"), F.length("above")).alias("from"))
        .select(F.col("folder").alias(at["in_folder"]), F.col("from.above").alias(at["above"]), F.col("from.given").alias(at["given"]))
    )
    own = of_text.select(F.col("key").alias(at["own_key"]), F.col("own").alias(at["own"]), F.col("cosine").alias(at["cosine"]))
    return (
        df.withColumns({at["key"]: key, at["folder"]: directory(df[path])})
        .join(own, F.col(at["key"]) == F.col(at["own_key"]), "left")
        .join(nearest, F.col(at["folder"]) == F.col(at["in_folder"]), "left")
        .select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.col(at["own"]).alias(names["own"]),
            F.col(at["cosine"]).alias(names["cosine"]),
            F.coalesce(at["own"], at["given"]).alias(names["licences"]),
            F.when(F.col(at["own"]).isNull(), F.col(at["above"])).alias(names["inherited_from"]),
        )
    )
