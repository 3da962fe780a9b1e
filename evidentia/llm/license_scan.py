"""Licence families of paragraphs: a logistic regression over word n-grams, trained here, applied with expressions.

The classifier is trained on the driver from the templates below, cut and varied, against paragraphs of ordinary
prose; what it learns is a small table of n-gram weights. Scoring explodes the n-grams of a paragraph and joins that
table. A prediction needs a confidence above a calibrated limit and enough shared words with the family's template;
otherwise the paragraph is of no known family.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import where_after

# How the licences name themselves, and the paragraphs of their texts and notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is available under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL version 2 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU LGPL version 3 or later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
    ],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU AGPL version 3 or later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "GFDL": [
        "Licensed under the GNU Free Documentation License.",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-2.0/",
    ],
    "Unlicense": [
        "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Licensed under the zlib License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    ],
    "Artistic-2.0": [
        "Licensed under the Artistic License 2.0.",
        "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    ],
    "WTFPL": [
        "Licensed under the WTFPL, version 2.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    ],
    "OFL-1.1": [
        "Licensed under the SIL Open Font License, Version 1.1.",
        "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 public domain dedication.",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this work may be reproduced without written permission of the copyright holder.",
    ],
}
#: The part of the templates that stands alone as a heading.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License", "Apache License, Version 2.0"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL"],
    "GFDL": ["GNU Free Documentation License"],
    "BSD": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License", "Mozilla Public License, version 2.0"],
    "EPL-2.0": ["Eclipse Public License"],
    "Unlicense": ["The Unlicense"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License"],
    "Artistic-2.0": ["Artistic License"],
    "WTFPL": ["Do What The F*ck You Want To Public License"],
    "OFL-1.1": ["SIL Open Font License"],
    "CC-BY": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"],
    "CC0": ["CC0 1.0"],
    "proprietary": ["All rights reserved"],
}
#: Prose that mentions licences, software and rights without granting anything.
OTHER = [
    "The license of the driver was taken away by the police.",
    "He is free to use the software of his choice without permission.",
    "The public was asked to read the general terms and conditions of the work.",
    "A copy of the book was released last year, and all copies were sold.",
    "She holds a degree from MIT and works on version 2 of the source code.",
    "The apache helicopter landed in the public square.",
    "A creative and common way to use the work of others.",
    "You may obtain a copy of the form at the office under the following conditions.",
    "The foundation published a new version of its public report.",
    "The authors of this work thank the international public for its attribution.",
    "The software was released in version 4.0 and is distributed by the company.",
    "Any person may use the library for free, subject to the rules of the house.",
    "The author of the document is not liable for the use of this list.",
    "A fishing license is required by law for all persons above a certain age.",
    "The materials of the course are provided by the contributors without charge.",
    "Boost the signal and publish the font in bold.",
    "The eclipse was seen by the general public, and all of the artistic work was copied.",
    "Which license should a new project choose, and what does each of them permit?",
    "The court held that the agreement gives no warranty and limits any claim for damages.",
    "Permission to enter the building is granted to anyone with a written notice.",
]
#: Closed-class words, which alone say nothing; a paragraph of nothing else has no features.
PLAIN = frozenset(
    "a about above after all along also an and any anyone are as at away be been before below but by can each either for from had has have he her his how i if in into is it its "
    "may more most must new no nor not of on once one only or other our out over s shall she should so some such than that the their them then there these they this to under up upon us "
    "was we were what when where whether which who whom will with within without would you your".split()
)
UNKNOWN = "unknown"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _features(words: list[str]) -> set[str]:
    """Words and pairs of neighbours of which one at least says something."""
    out = {w for w in words if w not in PLAIN}
    return out | {f"{a} {b}" for a, b in zip(words, words[1:]) if a not in PLAIN or b not in PLAIN}


def _variants(rng: np.random.Generator, families: list[str], times: int) -> tuple[list[list[str]], list[int], list[int]]:
    """Texts of each family and of none: whole, cut at the end, and among other words; their families and the run they are of."""
    noise = [w for t in OTHER for w in _words(t)] + [f"zz{k}" for k in range(300)]
    texts: list[list[str]] = []
    labels: list[int] = []
    runs: list[int] = []
    for k, family in enumerate(families):
        for text in TEMPLATES.get(family, OTHER):
            words = _words(text)
            for turn in range(times):
                n = len(words) if rng.random() < 0.5 else max(min(len(words), 6), int(len(words) * rng.uniform(0.6, 1.0)))
                some = list(rng.choice(noise, int(rng.integers(0, 30))))
                texts.append(words[:n] + some if rng.random() < 0.5 else some + words[:n])
                labels.append(k)
                runs.append(turn)
    for turn in range(150):
        texts.append(list(rng.choice(noise, int(rng.integers(3, 40)))))
        labels.append(len(families) - 1)
        runs.append(turn % times)
    return texts, labels, runs


def _regression(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    for _ in range(rounds):
        p = _softmax(x @ w + b) - y
        w -= 2.0 * (x.T @ p / len(p) + 1e-4 * w)
        b -= 2.0 * p.mean(axis=0)
    return w, b


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def train(seed: int = 7, rounds: int = 150, times: int = 8, folds: int = 5) -> tuple[list[str], dict[str, tuple[float, ...]], tuple[float, ...], float]:
    """Families (the unknown one last), weights of each n-gram, biases, and the least probability of a prediction.

    That probability is calibrated on licences the model does not know: in each fold some families are left out of
    the training, and their texts should be below it, while unseen variants of known families should be above it.
    """
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    texts, labels, runs = _variants(rng, families, times)
    rows = [_features(w) for w in texts]
    known = sorted({f for family in TEMPLATES for t in TEMPLATES[family] for f in _features(_words(t))})
    column = {f: j for j, f in enumerate(known)}
    x = np.zeros((len(rows), len(known)), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, [column[f] for f in r if f in column]] = 1.0
    label, apart = np.array(labels), np.array(runs) == 0
    y = np.eye(len(families), dtype=np.float32)[label]
    own, strange = [], []
    for fold in range(folds):
        out = (label % folds == fold) & (label < len(families) - 1)
        w, b = _regression(x[~apart & ~out], y[~apart & ~out], rounds // 2)
        p = _softmax(x[apart] @ w + b)
        top = p[:, :-1].max(axis=1)
        right = (p[:, :-1].argmax(axis=1) == label[apart]) & ~out[apart] & (label[apart] < len(families) - 1)
        own.append(top[right])
        strange.append(top[out[apart]])
    own, strange = np.concatenate(own), np.concatenate(strange)
    limits = np.arange(0.5, 0.96, 0.01)
    limit = float(max(limits, key=lambda v: ((own >= v).mean() + (strange < v).mean(), -v)))
    w, b = _regression(x, y, rounds)
    return families, {f: tuple(np.round(w[j].astype(float), 6)) for f, j in column.items()}, tuple(np.round(b.astype(float), 6)), round(limit, 6)


def _heading(name: str) -> int:
    """So many words at most has a paragraph that is a heading with this name."""
    return 2 * len(_words(name)) + 2


def telling(least_shared: float) -> list[str]:
    """Words of which every paragraph that scan() may find holds one.

    Of each template, the words that are in more than 1 - least_shared of its n-grams, those first that ordinary prose has not (short ones, which are words in some language, last),
    longer ones first: without any of them a paragraph shares too little. Of each heading, one word.
    """
    common = {w for t in OTHER for w in _words(t)}
    order = lambda w: (2 * (w.isalpha() and len(w) < 3) + (w in common), -len(w), w)
    out: set[str] = set()
    for t in (t for texts in TEMPLATES.values() for t in texts):
        features = _features(_words(t))
        covered: set[str] = set()
        for w in sorted({w for f in features for w in f.split()} - PLAIN, key=order):
            if len(covered) > (1 - least_shared) * len(features):
                break
            covered |= {f for f in features if w in f.split()}
            out.add(w)
    for t in (t for texts in NAMES.values() for t in texts):
        if not out & set(_words(t)):
            out.add(min(_words(t), key=order))
    return sorted(out)


def paragraphs(text: Column) -> Column:
    """Array of position, block, joined and paragraph: each line that holds a word, and each block of several such lines.

    Blocks are separated by lines without a word; their lines are joined by spaces. `block` is the position of its first line.
    """
    lines = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i)), lambda i: i.isNotNull())
    bounds = F.concat(F.array(F.lit(-1)), blank, F.array(F.size(lines)))
    blocks = F.transform(F.arrays_zip(F.slice(bounds, 1, F.size(bounds) - 1).alias("before"), F.slice(bounds, 2, F.size(bounds) - 1).alias("after")), lambda b: F.struct((b["before"] + 1).alias("at"), F.slice(lines, b["before"] + 2, b["after"] - b["before"] - 1).alias("lines")))
    row = lambda position, at, joined, x: F.struct(position.alias("position"), at.alias("block"), F.lit(joined).alias("joined"), x.alias("paragraph"))
    single = lambda b: F.transform(b["lines"], lambda x, i: row(b["at"] + i, b["at"], False, x))
    whole = lambda b: F.filter(F.array(row(b["at"], b["at"], True, F.concat_ws(" ", b["lines"]))), lambda _: F.size(b["lines"]) > 1)
    return F.flatten(F.transform(blocks, lambda b: F.concat(single(b), whole(b))))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_shared: float = 0.5) -> DataFrame:
    """One row per paragraph of a known licence family: doc_id, position, family, probability, shared, paragraph.

    A paragraph is a line, or a block of lines up to a blank one, joined by spaces, with the position of its first line;
    a block is given where none of its lines alone is of its family. Only the text counts, whole. `shared` is the
    largest part of a template of the family whose n-grams the paragraph holds. A heading that holds a family's name is of that family, whatever the probability of so
    few words. Only paragraphs with one of the templates' telling words are scored, as no other can share enough; a row that stands in the table twice gives its paragraphs
    twice. Null and empty texts, and an empty table, give no rows. Other columns are ignored.

    The model's table has some hundred n-grams whatever the data, and is broadcast. A paragraph's n-grams are joined
    with it and added up within the row by array functions; only what is found is shuffled, to hold blocks against their lines.
    """
    families, weights, biases, limit = train()
    strong = telling(least_shared)
    says = lambda c: F.arrays_overlap(F.split(F.lower(c), "[^a-z0-9]+"), F.array(*[F.lit(w) for w in strong]))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")).where(says(F.col("text")))
    rows = rows.select("doc_id", "row", F.explode(F.filter(paragraphs(F.col("text")), lambda p: says(p["paragraph"]))).alias("p")).select("doc_id", "row", "p.*")
    known = {f: k for k, f in enumerate(weights)}
    names = F.array(*[F.lit(f) for f in known])
    words = F.regexp_extract_all(F.lower("paragraph"), F.lit("[a-z0-9]+"), 0)
    rows = rows.withColumn("words", words)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("words", i - 1), F.get("words", i)))
    # the n-grams of the model that the paragraph holds, each once
    rows = rows.withColumn("held", F.array_intersect(F.concat("words", pairs), names))
    table = F.map_from_arrays(names, F.array(*[F.array(*[F.lit(float(x)) for x in w]) for w in weights.values()]))
    z = F.aggregate("held", F.array(*[F.lit(float(b)) for b in biases]), lambda s, f: F.zip_with(s, table[f], lambda a, b: a + b))
    rows = rows.withColumn("z", z)
    named = F.coalesce(*[F.when((F.size("words") <= _heading(t)) & F.concat(F.lit(" "), F.concat_ws(" ", "words"), F.lit(" ")).contains(f" {' '.join(_words(t))} "), F.lit(families.index(f) + 1)) for f, texts in NAMES.items() for t in texts])
    rows = rows.withColumn("named", named).withColumn("top", F.array_max("z")).withColumn("at", F.coalesce("named", F.array_position("z", F.col("top")).cast("int")))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top")))
    rows = rows.withColumn("probability", F.exp(F.get("z", F.col("at") - 1) - F.col("top")) / total).withColumn("family", F.get(F.array(*[F.lit(f) for f in families]), F.col("at") - 1))
    share = lambda t: F.size(F.array_intersect("held", F.array(*[F.lit(f) for f in sorted(_features(_words(t)))]))) / F.lit(float(len(_features(_words(t)))))
    cases = None
    for family, texts in TEMPLATES.items():
        own = F.greatest(*map(share, texts), F.when(F.col("named").isNotNull(), 1.0).otherwise(0.0))
        cases = F.when(F.col("family") == family, own) if cases is None else cases.when(F.col("family") == family, own)
    rows = rows.withColumn("shared", F.round(cases, 6))
    found = where_after(rows, (F.size("held") > 0) & (F.col("family") != UNKNOWN) & (F.col("named").isNotNull() | (F.col("probability") >= limit)) & (F.col("shared") >= least_shared))
    alone = F.count_if(~F.col("joined")).over(W.partitionBy("row", "block", "family"))
    return found.select("doc_id", "row", "block", "joined", "position", "family", "probability", "shared", "paragraph").withColumn("alone", alone).where(~F.col("joined") | (F.col("alone") == 0)).select("doc_id", "position", "family", "probability", "shared", "paragraph")


def classify(paragraph: str, least_shared: float = 0.5) -> str:
    """The family of one paragraph, in plain Python: what scan() is tested against."""
    families, weights, biases, limit = train()
    words = _words(paragraph)
    held = {f for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))] if f in weights}
    if not held:
        return UNKNOWN
    for f, texts in NAMES.items():
        if any(len(words) <= _heading(t) and f" {' '.join(_words(t))} " in f" {' '.join(words)} " for t in texts):
            return f
    z = np.array(biases) + sum(np.array(weights[f]) for f in held)
    p = 1.0 / np.exp(z - z.max()).sum()
    family = families[int(np.argmax(z))]
    if family == UNKNOWN or p < limit:
        return UNKNOWN
    shared = max(len(held & _features(_words(t))) / len(_features(_words(t))) for t in TEMPLATES[family])
    return family if round(shared, 6) >= least_shared and math.isfinite(p) else UNKNOWN
