"""Licence scans: a trained paragraph classifier, confirmed by templates.

Shingles (three words) are taken over the words of the whole text, across line
ends, and every line that a template's shingle touches is a candidate; so are
lines, and pairs of one-word lines, of fewer words that are all of a shorter
template.  Neighbouring candidates, up to one that ends a sentence, are one
paragraph, as the lines of a wrapped notice are.  Paragraphs
are classified by logistic regression over sparse hashed word 1- to 3-grams.
Classes are licence families and ``unknown``; probabilities are calibrated by a
temperature fitted on held-out paragraphs, and a family needs at least
``MIN_PROBABILITY``.  A prediction counts as confirmed if the paragraph shares
enough shingles with a template of that family; unconfirmed ones are reported
as unknown.  Confirmation asks for a template's shingle, and however a notice is
wrapped all lines that its shingles touch are candidates.

The model is fitted in the driver on variations of the templates (a fixed,
small set); it becomes a constant of the plan, and scanning is one pass of SQL
functions without shuffle.

Defined cases
-------------
* null or empty text: no findings; null ids are kept;
* a line that no template's shingle touches: cannot be confirmed, so not listed; a blank line ends a paragraph;
* repeated rows and lines: each is listed; ties between families: the first in order;
* empty table: empty result; very long texts: every line is read, whole;
* extra columns: ``scan`` keeps them and adds ``findings``, in place of a column of that name.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

SPACE = 1 << 14
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.5
#: Opening or characteristic sentences of public licence texts and the usual notices.
SENTENCES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "This software is released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "mpl": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "Released under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the copyright holder.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
#: Titles, and short identifiers as they stand in file headers.
TITLES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License", "Apache License 2.0", "Apache License, Version 2.0"), "mit": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "bsd": ("BSD License", "BSD 2-Clause License", "BSD 3-Clause License"), "isc": ("ISC License", "The ISC License"),
    "gpl": ("GNU General Public License", "GNU General Public License v3.0", "GPL v2", "GPL v3", "GPLv2", "GPLv3"),
    "lgpl": ("GNU Lesser General Public License", "GNU Lesser General Public License v3.0", "LGPL v3", "LGPLv3"),
    "agpl": ("GNU Affero General Public License", "GNU Affero General Public License v3.0", "AGPL v3", "AGPLv3"),
    "mpl": ("Mozilla Public License", "Mozilla Public License 2.0"), "cc-by": ("Creative Commons Attribution 4.0 International",),
    "cc-by-sa": ("Creative Commons Attribution-ShareAlike 4.0 International",), "cc-by-nc": ("Creative Commons Attribution-NonCommercial 4.0 International",),
    "public-domain": ("The Unlicense", "CC0 1.0 Universal"),
}
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "apache": ("Apache-2.0",), "mit": ("MIT",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"), "isc": ("ISC",), "gpl": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "agpl": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "mpl": ("MPL-2.0",),
    "cc-by": ("CC-BY-4.0",), "cc-by-sa": ("CC-BY-SA-4.0",), "cc-by-nc": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0"), "public-domain": ("CC0-1.0", "Unlicense"),
}
TEMPLATES = {f: (*t, *TITLES.get(f, ()), *(f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(f, ()))) for f, t in SENTENCES.items()}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Licence words in other uses, and licences outside the families: what unknown is learned from.
OTHERS = (
    "She renewed her driving licence at the office and paid the fee for the year.",
    "The pilot lost his license after the inquiry, and the club moved on without him.",
    "Poets take some licence with the facts, and readers forgive them.",
    "Copyright law was discussed in parliament for three days before the vote.",
    "The fishing license costs twelve coins and is valid on the lower river.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the Eclipse Public License, version 2.0.",
    "Distributed under the terms of the Academic Free License.",
    "SPDX-License-Identifier: EPL-2.0",
    "SPDX-License-Identifier: Zlib",
    "SPDX-License-Identifier: Artistic-2.0",
    "SPDX-License-Identifier: NONE",
    "Eclipse Public License",
    "Fishing License",
    "See the file for the licence that applies here.",
    "Apache helicopters and Apache tribes share no more than a name.",
    "He left the room as is, with the books on the floor.",
    "The committee redistributed the seats between the two districts.",
)


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]


def bucket(gram: str) -> int:
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % SPACE


def grams(own: list[str]) -> list[str]:
    return [" ".join(own[i : i + n]) for n in (1, 2, 3) for i in range(len(own) - n + 1)]


def shingle_hashes(own: list[str]) -> list[int]:
    """Signed hashes of the runs of three words, or of all words where they are fewer."""
    hashes = {xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2)) if own}
    return sorted(h - (1 << 64) if h >> 63 else h for h in hashes)


def _examples(seed: int) -> list[tuple[list[str], int]]:
    """Variations: noise words around and inside, a part of a long template, changed years and versions."""
    rng, out = random.Random(seed), []
    noise = words(" ".join(OTHERS)) + "the and of to in that it for on with as was is are by at from or an be this which you we they his her".split()
    made = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(300)]

    def some(n: int) -> list[str]:
        return [rng.choice(noise if rng.random() < 0.4 else made) for _ in range(n)]

    for label, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            own = words(template)
            for _ in range(14):
                part = own if len(own) < 14 or rng.random() < 0.5 else own[(i := rng.randrange(len(own) - 10)) : i + rng.randint(10, len(own))]
                part = [w if rng.random() > 0.04 else rng.choice(made) for w in part]
                out.append((some(rng.choice([0, 0, 0, 2, 6])) + part + some(rng.choice([0, 0, 0, 2, 6])), label))
    for text in OTHERS:
        own = words(text)
        out += [(some(rng.choice([0, 0, 4])) + own + some(rng.choice([0, 0, 4])), len(TEMPLATES)) for _ in range(10)]
    out += [(some(rng.randint(3, 60)) + [rng.choice(["license", "copyright", "licensed", "apache", "licence"])] + some(rng.randint(3, 60)), len(TEMPLATES)) for _ in range(300)]
    rng.shuffle(out)
    return out


class Model:
    """Weights by bucket and class, class biases, temperature."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, text: str) -> np.ndarray:
        z = (self.bias + _vector(words(text)) @ self.weights) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _vector(own: list[str]) -> np.ndarray:
    x = np.zeros(SPACE)
    found = list({bucket(g) for g in grams(own)})
    if found:
        x[found] = 1 / np.sqrt(len(found))
    return x


@lru_cache(maxsize=1)
def trained(seed: int = 5) -> Model:
    """Softmax regression by gradient descent on four fifths of the variations; the rest fits the temperature."""
    data = _examples(seed)
    used = np.array(sorted({bucket(g) for f in TEMPLATES for t in TEMPLATES[f] for g in grams(words(t))} | {bucket(g) for t in OTHERS for g in grams(words(t))}))
    x = np.array([_vector(own)[used] for own, _ in data])
    y = np.eye(len(FAMILIES))[[label for _, label in data]]
    cut = len(data) * 4 // 5
    w, b = np.zeros((len(used), len(FAMILIES))), np.zeros(len(FAMILIES))
    speed = [np.zeros_like(w), np.zeros_like(b)]
    for _ in range(300):
        z = x[:cut] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y[:cut]) / cut
        for i, (t, g) in enumerate(((w, x[:cut].T @ error + 1e-6 * w), (b, error.sum(axis=0)))):
            speed[i] = 0.9 * speed[i] - 20.0 * g
            t += speed[i]
    z = x[cut:] @ w + b

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float(-(y[cut:] * (q - np.log(np.exp(q).sum(axis=1, keepdims=True)))).sum())

    temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    weights = np.zeros((SPACE, len(FAMILIES)))
    weights[used] = np.round(w, 4)
    return Model(weights, np.round(b, 4), temperature)


def _let(value: Column, body) -> Column:
    """Bind a value once, so that its expression isn't repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def classify(paragraph: Column, model: Model) -> Column:
    """family, probability, similarity and confirmed of a paragraph."""
    used = np.abs(model.weights).sum(axis=1) > 0
    table = _constant([model.weights[i].tolist() if used[i] else None for i in range(SPACE)], "array<array<double>>")
    bias = _constant(model.bias.tolist(), "array<double>")
    zeros = _constant([0.0] * len(FAMILIES), "array<double>")
    templates = _constant([[shingle_hashes(words(t)) for t in TEMPLATES[f]] for f in TEMPLATES] + [[]], "array<array<array<bigint>>>")
    names = F.split(F.lit(",".join(FAMILIES)), ",")

    def judge(probabilities: Column, triples: Column) -> Column:
        top = F.array_max(probabilities)
        place = (F.array_position(probabilities, top) - 1).cast("int")
        own = F.array_distinct(F.transform(triples, lambda g: F.xxhash64(g)))
        similar = _let(
            own,
            lambda s: F.coalesce(
                F.array_max(F.transform(F.get(templates, place), lambda t: F.size(F.array_intersect(s, t)) / F.greatest(F.lit(1), F.least(F.size(s), F.size(t))))), F.lit(0.0)
            ),
        )
        sure = (top >= MIN_PROBABILITY) & (F.get(names, place) != UNKNOWN)
        return _let(
            F.struct(place.alias("place"), top.alias("top"), similar.alias("similar"), sure.alias("sure")),
            lambda r: F.struct(
                F.when(r["sure"] & (r["similar"] >= MIN_SIMILARITY), F.get(names, r["place"])).otherwise(F.lit(UNKNOWN)).alias("family"),
                r["top"].alias("probability"),
                r["similar"].alias("similarity"),
                (r["sure"] & (r["similar"] >= MIN_SIMILARITY)).alias("confirmed"),
            ),
        )

    def softmax(total: Column, n: Column) -> Column:
        logits = F.zip_with(total, bias, lambda a, b: (a / F.sqrt(F.greatest(n, F.lit(1))) + b) / F.lit(model.temperature))
        return _let(
            logits,
            lambda z: _let(
                F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x))
            ),
        )

    def of_words(w: Column) -> Column:
        pairs = F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        return _let(
            F.struct(w.alias("one"), pairs.alias("two")),
            lambda s: _let(
                F.struct(s["one"].alias("one"), s["two"].alias("two"), F.when(F.size(s["one"]) > 2, F.array_compact(F.zip_with(s["two"], F.slice(s["one"], 3, F.greatest(F.size(s["one"]), F.lit(1))), lambda ab, c: F.concat(ab, F.lit(" "), c)))).otherwise(_whole(s["one"])).alias("three")),
                of_grams,
            ),
        )

    def of_grams(s: Column) -> Column:
        every = F.concat(s["one"], F.array_compact(s["two"]), s["three"])
        buckets = F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(SPACE)).cast("int")))
        return _let(
            buckets,
            lambda b: _let(
                F.aggregate(F.filter(F.transform(b, lambda i: F.get(table, i)), lambda r: r.isNotNull()), zeros, lambda acc, r: F.zip_with(acc, r, lambda x, y: x + y)),
                lambda total: _let(softmax(total, F.size(b)), lambda p: judge(p, s["three"])),
            ),
        )

    return _let(F.filter(F.split(ascii_lower(paragraph), "[^a-z0-9]+"), lambda w: w != ""), of_words)


def _whole(own: Column) -> Column:
    """A line of fewer than three words is one shingle; one without words has none."""
    return F.filter(F.array(F.array_join(own, " ")), lambda x: x != "")


def _candidates(lines: Column) -> Column:
    """Numbers of the lines that a template's shingle touches, ascending."""
    every = [(len(words(t)), shingle_hashes(words(t))) for family in TEMPLATES.values() for t in family]
    known = sorted({h for n, own in every if n >= 3 for h in own})
    short = sorted({h for n, own in every if n < 3 for h in own})

    def is_short(own: Column) -> Column:
        return F.xxhash64(F.array_join(own, " ")).isin(short)

    def marked(by_line: Column, flat: Column, line: Column) -> Column:
        last = F.size(flat) - 3
        places = F.when(last >= 0, F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.xxhash64(F.array_join(F.slice(flat, k + 1, 3), " ")).isin(known)))
        touched = F.flatten(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda k: F.slice(line, k + 1, 3)))
        numbers = F.sequence(F.lit(0), F.size(by_line) - 1)
        alone = F.filter(numbers, lambda i: F.size(F.get(by_line, i)).between(1, 2) & is_short(F.get(by_line, i)))
        pairs = F.filter(numbers, lambda i: (F.size(F.get(by_line, i)) == 1) & (F.size(F.get(by_line, i + 1)) == 1) & is_short(F.concat(F.get(by_line, i), F.get(by_line, i + 1))))
        return F.array_sort(F.array_distinct(F.concat(touched, alone, pairs, F.transform(pairs, lambda i: i + 1))))

    by_line = F.transform(lines, lambda x: F.filter(F.split(ascii_lower(x), "[^a-z0-9]+"), lambda w: w != ""))
    numbered = lambda own: F.flatten(F.transform(own, lambda w, i: F.array_repeat(i, F.size(w))))
    return _let(by_line, lambda own: _let(F.struct(F.flatten(own).alias("flat"), numbered(own).alias("line")), lambda t: marked(own, t["flat"], t["line"])))


def paragraphs(text: Column) -> Column:
    """paragraph (number of its first line, from 0) and text of each run of neighbouring candidates; a run ends where a sentence does."""
    def runs(own: Column) -> Column:
        def begins(i: Column) -> Column:
            here, last = F.get(own, i), F.get(own, i - 1)
            return (i == 0) | (here["line"] != last["line"] + 1) | last["text"].rlike(r"[.!?:;][\s\"')]*$")

        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), begins)
        return _let(
            starts,
            lambda at: F.transform(
                at,
                lambda first, j: F.struct(
                    F.get(own, first)["line"].alias("paragraph"),
                    F.array_join(F.transform(F.slice(own, first + 1, F.coalesce(F.get(at, j + 1), F.size(own)) - first), lambda p: p["text"]), " ").alias("text"),
                ),
            ),
        )

    none = F.from_json(F.lit("[]"), "array<struct<paragraph:int,text:string>>")
    taken = lambda lines: F.transform(_candidates(lines), lambda i: F.struct(i.alias("line"), F.get(lines, i).alias("text")))
    return _let(F.split(text, "\n"), lambda lines: _let(taken(lines), lambda own: F.when(F.size(own) > 0, runs(own)).otherwise(none)))


def scan(docs: DataFrame, model: Model | None = None, column: str = "text") -> DataFrame:
    """``docs`` with ``findings``: paragraph (number of its first line, from 0), family, probability, similarity, confirmed for each paragraph of candidates."""
    model = model or trained()
    found = F.transform(
        paragraphs(F.col(column)),
        lambda p: _let(
            classify(p["text"], model),
            lambda c: F.struct(p["paragraph"].alias("paragraph"), c["family"].alias("family"), c["probability"].alias("probability"), c["similarity"].alias("similarity"), c["confirmed"].alias("confirmed")),
        ),
    )
    none = F.from_json(F.lit("[]"), "array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>")
    return docs.withColumn("findings", F.coalesce(found, none))
