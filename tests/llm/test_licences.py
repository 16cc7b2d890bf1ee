"""Licence notices: wrapped and marked texts, held-out variants, and every row's own notices."""

import re

import pytest

from candleforge.llm import licences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, paragraph int, f long, row long"


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def scanned(spark, model, rows):
    return licences.scan(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS), *model).collect()


def test_notices_are_found(spark, model):
    rows = [(1, "Text.\nReleased under the MIT License.\nMore."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0."), (4, "He took the licence and was released under bail. Mit."), (5, None), (6, ""), (7, "See the license for details."), (8, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in scanned(spark, model, rows)}
    assert {k: v.family for k, v in got.items()} == {1: "mit", 2: "gpl", 3: "cc-by-nc", 7: "unknown", 8: "apache"}
    assert all(v.confirmed for k, v in got.items() if k != 7) and got[1].paragraph == 1


def test_rows_with_the_same_or_no_id_keep_their_own(spark, model):
    mit, apache, nc = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0."
    got = scanned(spark, model, [(None, mit), (None, nc), (7, mit), (7, apache), (7, apache)])
    assert sorted((str(r.doc_id), r.family) for r in got) == [("7", "apache"), ("7", "apache"), ("7", "mit"), ("None", "cc-by-nc"), ("None", "mit")]
    assert scanned(spark, model, []) == []
    far = scanned(spark, model, [(1, "word " * 400_000 + mit + " tail" * 1000)])
    assert [(r.family, r.confirmed) for r in far] == [("mit", True)] and abs(far[0].word - 400_000) < 20


#: Held-out wordings, none of which is trained: wrapped by hand, in comments, with other names and versions.
HELD_OUT = {
    "gpl": [
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
        "# You can redistribute this script and modify it under the terms\n# of the GNU General Public License version 2 as published\n# by the Free Software Foundation.",
        "The source is available under the GNU General Public License, v3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files (the\n\"Software\"), to deal in the Software without restriction, including\nwithout limitation the rights to use, copy, modify, merge, publish,\ndistribute, sublicense, and/or sell copies of the Software",
        "/*\n * This library is released under the MIT license.\n */",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,\nEXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF\nMERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "bsd": [
        " * Redistributions of source code must retain the above copyright\n *    notice, this list of conditions and the following disclaimer.",
        "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file of the project.",
    ],
    "apache": ["you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0", "All code here is licensed under the Apache License, version 2.0"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "lgpl": ["under the terms of the GNU Lesser General Public License as\npublished by the Free Software Foundation"],
    "cc-by-sa": ["The photos are licensed under a Creative Commons\nAttribution-ShareAlike 3.0 Unported License."],
    "cc-by": ["This article is licensed under a Creative Commons Attribution 3.0 License."],
    "isc": ["Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."],
    "eupl": ["Licensed under the EUPL, Version 1.2"],
}
CLEAN = ["The committee released the report under the new terms.", "He is a licensed driver and public speaker.", "No part of the city was free of the storm.", "Copy the list of names and publish it.", "The library is open to any person with a card.", "Version 2.0 of the story was published by the paper.", "The rights of the public to use the park", "a b c d"]


def test_held_out_wordings(spark, model):
    wanted = [(k, t) for k, ts in HELD_OUT.items() for t in ts]
    rows = [(i, f"Some words before it.\n\n{t}\n\nAnd more words behind.") for i, (_, t) in enumerate(wanted)] + [(1000 + i, t) for i, t in enumerate(CLEAN)]
    got = scanned(spark, model, rows)
    families = {}
    for r in got:
        families.setdefault(r.doc_id, set()).add(r.family)
    right = [wanted[i][0] in families.get(i, ()) for i in range(len(wanted))]
    wrong = [(r.doc_id, r.family) for r in got if r.doc_id < 1000 and r.family not in (wanted[r.doc_id][0], "unknown")]
    assert sum(right) >= 0.85 * len(right), [w for w, ok in zip(wanted, right, strict=True) if not ok]
    assert len(wrong) <= 0.1 * len(got), wrong
    assert not [r for r in got if r.doc_id >= 1000 and r.confirmed]


def test_notices_of_the_documents(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    want = set()
    for r in base.collect():
        if re.search(r"licensed? under|the MIT License", r.text or "", re.I):
            want.add(r.doc_id)
    got = {r.doc_id for r in licences.op9_license_scan(spark, SF).where("confirmed and family <> 'proprietary'").collect()}
    assert got == want and want
