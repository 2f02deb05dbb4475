import textwrap

import duckdb

from tests.llm.conftest import DATA
from veritab.llm import licences
from veritab.llm.oracle import ORACLE
from veritab.llm.queries import QUERIES


def scanned(spark, rows):
    table = spark.createDataFrame(rows, "path string, text string, own string")
    out = licences.scan(table)
    assert out.count() == len(rows)
    return {r.path: r for r in out.collect()}


def test_templates_find_themselves(spark):
    units = spark.createDataFrame([(t, t) for _, t in licences.TEMPLATES], "uid string, unit string")
    got = {r.uid: r for r in licences.score_units(units).collect()}
    for name, text in licences.TEMPLATES:
        assert got[text].licence == name and got[text].cosine == 1.0


def test_inheritance_takes_the_nearest(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    got = scanned(
        spark,
        [
            ("LICENSE", gpl, "x"),
            ("a/LICENSE.txt", "first line\n" + mit, "x"),
            ("a/b/c/code.py", "nothing", "x"),
            ("a/b/own.py", "# " + gpl + "\nx = 1", "x"),
            ("ab/code.py", "nothing", "x"),
            ("code.py", None, "x"),
            ("z/COPYING", "no licence is named here", "x"),
            ("z/code.py", "", "x"),
            (None, mit, None),
            (None, None, None),
        ],
    )
    of = {k: (r.licences, r.inherited_from) for k, r in got.items() if k is not None}
    assert of["a/b/c/code.py"] == (["MIT"], "a")
    assert of["a/b/own.py"] == (["GPL-3.0"], None)
    assert of["ab/code.py"] == of["code.py"] == of["z/code.py"] == of["z/COPYING"] == (["GPL-3.0"], "")


def test_prose_and_changed_notices(spark):
    got = scanned(
        spark,
        [
            ("p", "The licence of a driver was lost, and so was the copyright of the long story they wrote.", None),
            ("q", "# Code is licensed under the Apache License, Version 2.0!", None),
            ("r", "Released under the MIT License.\nLicensed under CC BY-NC 4.0.", None),
            ("s", "Released under the MIT License.", None),
        ],
    )
    assert got["p"].licences is None
    assert got["q"].licences == ["Apache-2.0"]
    assert got["r"].licences == ["CC-BY-NC-4.0", "MIT"] and got["s"].licences == ["MIT"]
    assert "own_" in got["p"].asDict()


GPL = """# This file is part of a tool.
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int x;"""
APACHE = """// Copyright 2020 A. Person
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
// Unless required by applicable law or agreed to in writing, software
// distributed under the License is distributed on an "AS IS" BASIS,
// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def wrapped(text, sign="# ", width=70):
    return "\n".join(sign + line for line in textwrap.wrap(text, width))


def test_wrapped_headers_and_full_texts(spark):
    bsd2, bsd3 = (b + licences._BSD_END for b in (licences._BSD_2, licences._BSD_2 + licences._BSD_3))
    mit = licences._MIT + licences._MIT_END
    lgpl = licences._gnu("Lesser General Public", "2.1", "library").replace("software:", "software;")
    files = {
        "gpl.py": (GPL, ["GPL-3.0"]),
        "gpl2.c": (wrapped(licences._gnu("General Public", "2"), " * ", 60), ["GPL-2.0"]),
        "lgpl.c": (wrapped(lgpl, " * ", 60), ["LGPL-2.1"]),
        "mpl.c": (MPL, ["MPL-2.0"]),
        "apache.cc": (APACHE, ["Apache-2.0"]),
        "bsd2.py": ("# Copyright (c) 2019, A. Person\n" + wrapped(bsd2) + "\nimport os", ["BSD-2-Clause"]),
        "bsd3.py": ("# Copyright (c) 2019, A. Person\n" + wrapped(bsd3), ["BSD-3-Clause"]),
        "mit.py": ("# Copyright (c) 2019 A. Person\n#\n" + wrapped(mit), ["MIT"]),
        "isc.js": (wrapped(licences._ISC, "// "), ["ISC"]),
        "m/LICENSE": ("MIT License\n\nCopyright (c) 2019 A. Person\n\n" + wrapped(mit, ""), ["MIT"]),
        "b/LICENSE": ("Copyright (c) 2019, A. Person\nAll rights reserved.\n\n" + wrapped(bsd3, ""), ["BSD-3-Clause"]),
        "c/LICENSE.md": ("Copyright (c) 2019, A. Person\n\n" + wrapped(bsd2, ""), ["BSD-2-Clause"]),
        "prose.txt": ("A licence to fish was needed.\nThe copyright of the song was sold.\nNo warranty was given.", None),
    }
    got = scanned(spark, [(path, text, "x") for path, (text, _) in files.items()])
    assert {p: r.own_ for p, r in got.items()} == {p: own for p, (_, own) in files.items()}


def test_rows_of_one_path_and_clashing_names(spark):
    mit, cc = "Released under the MIT License.", "Licensed under CC BY 4.0."
    rows = [(None, mit, 1), (None, cc, 2), (None, None, 3), ("a", mit, 4), ("a", cc, 5), ("a", cc, 6)]
    names = "path string, text string, `from` int, _own int, _path int, _cosine int, licence_key int, cosine int"
    table = spark.createDataFrame([(p, t, n, n, n, n, n, n) for p, t, n in rows], names)
    got = {r["from"]: r.licences for r in licences.scan(table).collect()}
    assert got == {1: ["MIT"], 2: ["CC-BY-4.0"], 3: None, 4: ["MIT"], 5: ["CC-BY-4.0"], 6: ["CC-BY-4.0"]}


def test_odd_and_empty_tables(odd_documents, no_documents):
    table = odd_documents.withColumnRenamed("source", "path")
    assert licences.scan(table).count() == odd_documents.count()
    assert licences.scan(no_documents.withColumnRenamed("source", "path")).count() == 0


def test_query_equals_sql(spark):
    got = QUERIES["op9_license_scans"](spark, DATA).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(ORACLE["op9_license_scans"]).df().sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.fillna("-").equals(want.fillna("-"))


def test_no_python_in_the_plan(documents):
    table = documents.selectExpr("source AS path", "text")
    plan = licences.scan(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
