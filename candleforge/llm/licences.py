"""Licence notices by a trained paragraph classifier.

DataFrame functions only on the data's path. A paragraph ends at a blank line (or one of comment marks
only) or behind a line that ends a sentence, so that a wrapped notice stays together. Its pairs of neighbouring words
(ASCII letters and digits, lower case; comment marks vanish) that the model knows are found in one pass over the whole texts; runs of them
with no more than ``GAP`` words between are the candidates. A multinomial logistic regression
over these sparse pairs, trained on the driver from the notices below and
a bounded sample of other paragraphs, gives the probability of each licence family, of
``none`` and of ``unknown``; the least probability of a family is calibrated on notices left out of the training. A
prediction is confirmed if the run holds enough of the pairs of one of the family's
templates, or they of the run's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, cut

#: Fixed notices and phrases of public licences, by family.
PHRASES = {
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the AGPL v3 license.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is licensed under the Apache License 2.0.",
        "Released under the Apache 2.0 license.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "This software is licensed under the BSD License.",
        "Licensed under the 2-clause BSD license, also known as the simplified BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Available under the Creative Commons Attribution license.",
        "Content is licensed under CC BY 3.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial license.",
        "Content is licensed under CC BY-NC-SA 4.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ],
    "cc-by-nd": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Available under the Creative Commons Attribution-NoDerivs license.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nd/4.0/",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Available under the Creative Commons Attribution-ShareAlike license.",
        "Text is available under CC BY-SA 3.0.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 1.0.",
        "Released under the Eclipse Public License.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "eupl": [
        "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");",
        "Licensed under the European Union Public Licence.",
        "You may not use this work except in compliance with the Licence. You may obtain a copy of the Licence at: https://joinup.ec.europa.eu/software/page/eupl",
        "SPDX-License-Identifier: EUPL-1.2",
    ],
    "gfdl": [
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
        "Available under the GNU Free Documentation License.",
        "Licensed under the GNU FDL.",
        "SPDX-License-Identifier: GFDL-1.3-or-later",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v2.0.",
        "Released under the GNU GPL, version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This software is released under the GPL v3 license.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "Licensed under the ISC License.",
        "Released under the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Released under the LGPL v3 license.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Released under the MPL 2.0 license.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright. All rights reserved.",
        "This document is proprietary and confidential. Unauthorized copying is strictly prohibited.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work has been dedicated to the public domain under CC0 1.0.",
        "No rights reserved. Released under CC0.",
        "The author disclaims copyright to this source code.",
        "SPDX-License-Identifier: CC0-1.0",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "Licensed under the zlib license.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Notices of no family known here, and sentences that only sound like one.
UNKNOWN = ["Licensed under the terms found in the LICENSE file.", "See the license for details.", "Use is subject to license terms.", "Distributed under a custom license.", "This material may be used under the terms of the agreement.", "Licensed under the terms of a separate agreement.", "Released under a license of its own.", "SPDX-License-Identifier: LicenseRef-Other"]
NONE = ["The driver's license was issued by the county office.", "She is a licensed nurse and works in the city.", "The general public was invited to the opening.", "He was released under bail by the court.", "The version of the story that was told is not true.", "The foundation supports free education for the public.", "Students at MIT study the terms of the problem.", "The Apache helicopter was seen over the hills.", "Permission to leave was granted by the officer.", "A copy of the letter was sent to the office.", "The author is free to copy the work of others.", "The terms of the agreement were published in the paper.", "For any purpose other than this the rooms are closed.", "In no event will the team be late again."]
#: The documented bounds of what is fitted: documents sampled for ``none``, and their paragraphs.
SAMPLE_DOCS, SAMPLE = 500, 2000
SIMILAR, GAP = 0.6, 12
#: Between paragraphs: a line's end behind a sentence, or a blank line or one of comment marks.
_BETWEEN = r"(?<=[.!?:;])[\"')\]]{0,2}[ \t\r]*\n|\n[\s*#/;%-]*\n"


def paragraphs(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys, paragraph, text``: the paragraphs of each text that have words, counted from 0."""
    parts = docs.select(*keys, F.posexplode(F.split("text", _BETWEEN)).alias("paragraph", "text"))
    return parts.where(F.col("text").rlike("[A-Za-z0-9]"))


def _pairs(text: str):
    """Hashes of the pairs of neighbouring words of a column."""
    w = F.split(F.regexp_replace(F.lower(text), "^[^a-z0-9]+|[^a-z0-9]+$", ""), "[^a-z0-9]+")
    return F.when(F.size(w) >= 2, F.transform(F.arrays_zip(F.slice(w, F.lit(1), F.size(w) - 1).alias("a"), F.slice(w, F.lit(2), F.size(w) - 1).alias("b")), lambda x: F.xxhash64(x["a"], x["b"])))


class Classifier:
    """Weights by feature for each family, and for ``none`` and ``unknown``; what is in no family's phrases has none."""

    def __init__(self, families: list[str], weights: dict[int, np.ndarray], bias: np.ndarray, least: float):
        self.families, self.weights, self.bias, self.least = families, weights, bias, least


def train(phrases: list[tuple[str, frozenset[int]]], none: list[frozenset[int]], rounds: int = 250, rate: float = 0.5, decay: float = 1e-3) -> Classifier:
    """Logistic regression by full gradient steps; every fifth phrase only calibrates the threshold, then all are fitted."""
    families = [*sorted({k for k, _ in phrases} - {"unknown"}), "unknown", "none"]
    vocabulary = sorted({f for _, s in phrases for f in s})
    column = {f: i for i, f in enumerate(vocabulary)}

    def matrix(sets: list[frozenset[int]]) -> np.ndarray:
        x = np.zeros((len(sets), len(vocabulary)), np.float64)
        for i, s in enumerate(sets):
            x[i, [column[f] for f in s if f in column]] = 1
        return x

    def fit(some: list[tuple[str, frozenset[int]]]) -> tuple[np.ndarray, np.ndarray]:
        x = matrix([s for _, s in some] + none)
        y = np.array([families.index(k) for k, _ in some] + [len(families) - 1] * len(none))
        weight = np.where(y == len(families) - 1, max(1.0, len(some)) / max(1, len(none)), 1.0)
        w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
        hot = np.eye(len(families))[y]
        for _ in range(rounds):
            z = x @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p = (p / p.sum(axis=1, keepdims=True) - hot) * weight[:, None]
            w -= rate * (x.T @ p / len(some) * 4 + decay * w)
            b -= rate * p.sum(axis=0) / len(some)
        return w, b

    left_out = [x for i, x in enumerate(phrases) if i % 5 == 4]
    w, b = fit([x for i, x in enumerate(phrases) if i % 5 != 4])
    z = matrix([s for _, s in left_out]) @ w + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    wrong = [row.max() for row, (k, _) in zip(p, left_out, strict=True) if families[int(row.argmax())] != k and row.argmax() < len(families) - 2]
    w, b = fit(phrases)
    return Classifier(families, {f: w[i] for f, i in column.items()}, b, float(np.clip(max(wrong, default=0.0), 0.4, 0.6)))


def fit(docs: DataFrame) -> tuple[Classifier, DataFrame]:
    """A classifier, and the templates as ``family, template, size, f``."""
    spark = docs.sparkSession
    texts = [(k, i, t) for k, ts in {**PHRASES, "unknown": UNKNOWN}.items() for i, t in enumerate(ts)] + [("none", i, t) for i, t in enumerate(NONE)]
    sets = {(r["family"], r["template"]): set(r["f"]) for r in spark.createDataFrame(texts, "family string, template int, text string").select("family", "template", _pairs("text").alias("f")).collect()}
    phrases = [(k, frozenset(s)) for (k, _), s in sorted(sets.items()) if k != "none"]
    # pairs of sampled paragraphs that phrases have too; the rest weighs nothing
    n = docs.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("none")), F.lit(1 << 30)) < int(min(1.0, SAMPLE_DOCS / max(1, n)) * (1 << 30))
    known = spark.createDataFrame([(f,) for f in sorted({f for _, s in phrases for f in s})], "f long")
    own = [frozenset(s) for (k, _), s in sorted(sets.items()) if k == "none"]
    sampled = paragraphs(docs.where(draw).select("doc_id", "text"), "doc_id").select("doc_id", "paragraph", F.explode(_pairs("text")).alias("f"))
    hits = sampled.join(F.broadcast(known), "f").groupBy("doc_id", "paragraph").agg(F.array_sort(F.collect_set("f")).alias("s")).orderBy("doc_id", "paragraph").limit(SAMPLE).collect()
    # sampled paragraphs with several of a phrase's pairs are notices themselves
    some = [frozenset(r["s"]) for r in hits if max((len(s.intersection(r["s"])) for _, s in phrases), default=0) < 3]
    rows = [(k, i, len(s), f) for (k, i), s in sets.items() if k not in ("none", "unknown") for f in s]
    return train(phrases, own + some + [frozenset()] * 20), spark.createDataFrame(rows, "family string, template int, size int, f long")


def scan(docs: DataFrame, classifier: Classifier, templates: DataFrame, similar: float = SIMILAR, gap: int = GAP) -> DataFrame:
    """A row for each notice: ``doc_id, paragraph, word, family, probability, similarity, confirmed``.

    ``word`` is the place of the notice's first known pair among the words of its paragraph.
    ``unknown`` is what is a notice by the classifier but of no family with enough
    probability. ``similarity`` is the share of a template's pairs that the notice holds or the
    share of the notice's that the template holds, the greater of the two; the latter
    confirms parts of a notice. Null and empty texts and an empty table have no notices; each of the rows that repeat an id,
    or have none, gives its own. Texts of any length are read whole. Ties go to the family first in
    alphabetical order. Other columns aren't read.
    """
    spark = docs.sparkSession
    k, families = len(classifier.families), classifier.families
    weights = spark.createDataFrame([(f, [float(x) for x in w]) for f, w in classifier.weights.items()], "f long, w array<double>")
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = ["row", "doc_id", "paragraph"]
    with Scratch(spark) as scratch:
        # one pass over the texts, written, so that the numbers of rows stay
        hits = scratch.table(paragraphs(given, "row", "doc_id").select(*key, F.posexplode(_pairs("text")).alias("at", "f")).join(F.broadcast(weights.select("f")), "f"))
        order = Window.partitionBy("row", "paragraph").orderBy("at")
        new = F.coalesce((F.col("at") - F.lag("at").over(order) > gap).cast("int"), F.lit(1))
        run = hits.withColumn("new", new).withColumn("run", F.sum("new").over(order))
        found = scratch.table(run.groupBy(*key, "run", "f").agg(F.min("at").alias("lo"), F.max("at").alias("hi")))
        key = [*key, "run"]
        z = found.join(F.broadcast(weights), "f").groupBy(*key).agg(F.min("lo").alias("word"), (F.max("hi") - F.min("lo") + 1).alias("own"), *[(F.sum(F.get("w", F.lit(i))) + float(classifier.bias[i])).alias(f"z{i}") for i in range(k)])
        z = z.withColumn("top", F.greatest(*[F.col(f"z{i}") for i in range(k)]))
        z = z.withColumn("total", sum((F.exp(F.col(f"z{i}") - F.col("top")) for i in range(1, k)), F.exp(F.col("z0") - F.col("top"))))
        p = lambda i: F.exp(F.col(f"z{i}") - F.col("top")) / F.col("total")
        best = F.greatest(*[F.struct(p(i).alias("p"), F.lit(-i).alias("i")) for i in range(k - 2)])
        name = F.get(F.array(*[F.lit(x) for x in families]), -F.col("best.i"))
        sure = F.col("best.p") >= classifier.least
        notices = z.where(p(k - 1) < 0.5).withColumn("best", best)
        notices = scratch.table(notices.select(*key, "word", "own", F.when(sure, name).otherwise(F.lit("unknown")).alias("family"), F.when(sure, F.col("best.p")).otherwise(p(k - 2)).alias("probability")))
        met = found.join(notices.select("row", "paragraph", "run", "family", "own"), ["row", "paragraph", "run"]).join(F.broadcast(templates), ["f", "family"]).groupBy("row", "paragraph", "run", "template", "size", "own").agg(F.count("*").alias("met"))
        near = met.groupBy("row", "paragraph", "run").agg(F.max(F.col("met") / F.least("size", "own")).alias("similarity"))
        same = notices.join(near, ["row", "paragraph", "run"], "left")
        similarity = F.least(F.coalesce("similarity", F.lit(0.0)), F.lit(1.0))
        return cut(same.select("doc_id", "paragraph", "word", "family", F.round("probability", 6).alias("probability"), F.round(similarity, 6).alias("similarity"), (similarity >= similar).alias("confirmed")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, *fit(docs))
