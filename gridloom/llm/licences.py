"""Licence scans with a trained paragraph classifier (operator 2).

Multinomial logistic regression over sparse word n-grams (1 to 3 words) names a paragraph's licence family or "unknown".
It is trained on variants of short templates of each family (words dropped, replaced, surrounded by other text) and, for
the unknown class, on paragraphs of the corpus itself and on sentences that speak of licences without naming one. It is
calibrated by a temperature fitted on templates left out: FOLDS models each learn without a part of the templates and judge
those; ``reliability`` tells how often probabilities of each size were right there. A prediction is confirmed by comparing the paragraph with the
family's templates: the share of the closest template's word pairs that it contains.

A line is a paragraph. Notices that are wrapped over lines are found as runs of adjacent lines (no blank one between) in
which half of a template's word pairs stand close together, also across line ends; a run is classified and confirmed whole.

The unknown class is learnt from the corpus, from notices of licences that are no family here (``FOREIGN``), and from
sentences that use the same words otherwise (``NEITHER``).

Only n-grams of templates and of these sentences are features, so a paragraph with none of the templates' words is unknown
without further work. Training takes a bounded sample: PARAGRAPHS paragraphs, picked by hash from the whole text, of
each of BACKGROUND rows; executors reduce them to features. Scoring maps over whole texts, no shuffle.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .decontaminate import split_words

BACKGROUND = 2_000  # rows of the corpus from which unknown paragraphs are taken
PARAGRAPHS = 4  # of each of these rows
FILLER = 30  # words of a paragraph that variants may be surrounded with
VARIANTS = 60  # of each template
FOLDS = 3  # parts of the templates that are left out in turn for calibration
CONFIRM = 0.5
UNKNOWN = "unknown"
# Short notices by which works name their licence.
TEMPLATES = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "This software is distributed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "Licensed under the Eclipse Public License, version 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
    ],
    "Boost": ["Distributed under the Boost Software License, Version 1.0."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "Text is available under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Dedicated to the public domain under CC0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# The families' identifiers in the form "SPDX-License-Identifier: ...".
SPDX = {
    "Apache": ["Apache-2.0"], "MIT": ["MIT"], "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "AGPL": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "EPL": ["EPL-2.0"], "ISC": ["ISC"], "Boost": ["BSL-1.0"],
    "GPL": ["GPL-3.0-only", "GPL-2.0-or-later"], "LGPL": ["LGPL-2.1-or-later", "LGPL-3.0-only"], "MPL": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0", "CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"],
    "Unlicense": ["Unlicense"],
}
for _family, _names in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _names]
# Notices of licences that are none of the families.
FOREIGN = [
    "Licensed under the EUPL, Version 1.2 only.", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "This file is distributed under the Artistic License 2.0.",
    "Licensed under the Open Software License version 3.0.", "Released under the zlib/libpng license.", "This software is licensed under the Microsoft Public License.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EUPL-1.2",
    "This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2.", "Licensed under the Academic Free License version 3.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Your use of this software is governed by the end user license agreement.", "SPDX-License-Identifier: LicenseRef-Proprietary",
    "Licensed under the PostgreSQL License.", "This program is made available under the terms of the IBM Public License.", "Licensed under the Server Side Public License, version 1.",
]
# Sentences with the same words that name no family.
NEITHER = [
    "All rights reserved.", "See the license file for details.", "The license of this software has not been decided.", "Version 2.0 was released in spring.",
    "He lost his driving license last week.", "The general public was not admitted to the work.", "You may not use this file.", "Licensed under terms to be agreed with the author.",
    "Permission to enter was granted free of charge.", "The software is distributed on disks.", "Creative work in common areas.", "The foundation published a later version of the program.",
    "The apache landed on the roof.", "A student of the institute in Massachusetts.", "Four copies and source documents are available in international waters.",
]


def grams(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def _pairs(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))}


def _template(text: str) -> set[bytes]:
    """The word pairs of a template; what all SPDX lines share tells nothing."""
    return _pairs(split_words(text.encode())) - {b"spdx license", b"license identifier"}


class Runs:
    """Runs of adjacent lines that hold a template only together."""

    def __init__(self, templates: dict[str, list[set[bytes]]]):
        self.sizes = [len(t) for ts in templates.values() for t in ts]
        self.pairs: dict[bytes, dict[bytes, list[int]]] = {}
        for k, t in enumerate(t for ts in templates.values() for t in ts):
            for pair in t:
                first, _, second = pair.partition(b" ")
                self.pairs.setdefault(first, {}).setdefault(second, []).append(k)

    def of(self, lines: list[list[bytes]]) -> list[tuple[int, int]]:
        """(first, last) of runs of at least two of the adjacent ``lines``, given as words; the most alike come first."""
        hits: dict[int, list[tuple[int, int, tuple[bytes, bytes]]]] = {}  # by template: (place, line where the pair starts, pair)
        ends, at, before = [], 0, (b"", 0)
        for k, words in enumerate(lines):
            for w in words:
                for t in self.pairs.get(before[0], {}).get(w, ()):
                    hits.setdefault(t, []).append((at, before[1], (before[0], w)))
                at, before = at + 1, (w, k)
            ends.append(at)
        out = []
        for t, found in hits.items():
            need, width = CONFIRM * self.sizes[t], 2 * self.sizes[t] + 8
            if len(found) < need:
                continue
            low, inside, best = 0, {}, None
            for place, _, pair in found:
                inside[pair] = inside.get(pair, 0) + 1
                while place - found[low][0] > width or inside[found[low][2]] > 1:  # a pair that comes again isn't needed twice
                    gone = found[low][2]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    low += 1
                if len(inside) >= need:
                    if best and found[low][0] > best[3]:
                        out.append(best)
                        best = None
                    if not best or len(inside) / self.sizes[t] > best[0]:
                        best = (len(inside) / self.sizes[t], found[low][1], int(np.searchsorted(ends, place, "right")), place)
            if best:
                out.append(best)
        return [(a, b) for _, a, b, _ in sorted(out, key=lambda x: (-x[0], x[1], x[2])) if b > a]


def blocks_of(text: bytes) -> list[list[bytes]]:
    """The lines of a text that aren't blank, in lists of adjacent ones."""
    out: list[list[bytes]] = [[]]
    for line in text.split(b"\n"):
        if line.strip():
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


class Classifier:
    """Classes are the families in order and UNKNOWN, last. weights: one row per feature, the bias last."""

    def __init__(self, families, vocabulary, weights, temperature, templates, reliability=()):
        self.reliability = reliability  # of training, see the function of that name
        self.families, self.vocabulary, self.weights, self.temperature, self.templates = families, vocabulary, weights, temperature, templates
        self.single = {w for ts in templates.values() for t in ts for pair in t for w in pair.split()}
        self.runs = Runs(templates)

    def logits(self, words: list[bytes]) -> np.ndarray:
        at = [self.vocabulary[g] for g in grams(words) if g in self.vocabulary]
        return (self.weights[at].sum(0) + self.weights[-1]) / self.temperature

    def of(self, words: list[bytes]):
        """(family, probability, likeness), or None for a paragraph without any word of a template."""
        if self.single.isdisjoint(words):
            return None
        z = self.logits(words)
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        if k == len(self.families):
            return UNKNOWN, float(p[k]), 0.0
        own = _pairs(words)
        return self.families[k], float(p[k]), max(len(own & t) / len(t) for t in self.templates[self.families[k]])


    def notices(self, lines: list[bytes]) -> list[tuple]:
        """(line, family, probability, likeness) of adjacent lines, and of runs that are more alike than each of their lines."""
        words = [split_words(x) for x in lines]
        found = {k: (k, *got) for k, w in enumerate(words) if (got := self.of(w)) and got[0] != UNKNOWN}
        if len(lines) > 1:
            taken: set[int] = set()
            for a, b in self.runs.of(words):
                at = range(a, b + 1)
                got = self.of([w for x in words[a : b + 1] for w in x]) if taken.isdisjoint(at) else None
                if got and got[0] != UNKNOWN and got[2] >= CONFIRM and all(got[2] > found[k][3] for k in at if k in found):
                    taken.update(at)
                    for k in at:
                        found.pop(k, None)
                    found[a] = (a, *got)
        return [found[k] for k in sorted(found)]


def _softmax_fit(rows: list[tuple[int, ...]], y: np.ndarray, m: int, classes: int, rounds: int = 200) -> np.ndarray:
    """Multinomial logistic regression by gradient steps with a running scale per weight; rows are features in order. Rows that
    are alike count as one with their number as its weight; each class has the same weight in all."""
    share = np.array([(y == k).mean() for k in range(classes)])
    alike: dict[tuple, float] = {}
    for r, k in zip(rows, y):
        alike[r, k] = alike.get((r, k), 0.0) + 1 / max(share[k], 1e-9) / classes / len(rows)
    rows, y, each = [r for r, _ in alike], np.array([k for _, k in alike]), np.array(list(alike.values()))
    flat = np.array([j for r in rows for j in (*r, m)], np.int64)  # the bias is the last feature of every row
    start = np.cumsum([0, *[len(r) + 1 for r in rows[:-1]]])
    of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    order = np.argsort(flat, kind="stable")
    known, first = np.unique(flat[order], return_index=True)
    of = of[order]
    w, scale, target = np.zeros((m + 1, classes)), np.full((m + 1, classes), 1e-3), np.eye(classes)[y]
    for _ in range(rounds):
        z = np.add.reduceat(w[flat], start)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) * each[:, None]
        g = np.zeros_like(w)
        g[known] = np.add.reduceat(d[of], first)
        g[:-1] += 1e-6 * w[:-1]
        scale += g * g
        w -= 0.5 * g / np.sqrt(scale)
    return w


def _variants(rng: random.Random, filler: list[bytes]):
    """(family or UNKNOWN, number of the template in it, paragraph) made from the fixed values, with words of the corpus around
    some."""
    filler = filler or [b"text"]
    for family, texts in [*TEMPLATES.items(), (UNKNOWN, FOREIGN + NEITHER)]:
        for number, text in enumerate(texts):
            words = text.encode().split()
            for k in range(VARIANTS):
                own = list(words)
                if k and rng.random() < 0.3 and len(own) > 5:
                    del own[rng.randrange(len(own))]
                if k and rng.random() < 0.2 and len(own) > 8:
                    own[rng.randrange(len(own))] = rng.choice(filler)
                around = [rng.choice(filler) for _ in range(rng.choice([0, 0, 2, 8, 20]))] if k else []
                cut = rng.randrange(len(around) + 1)
                yield family, number, b" ".join(around[:cut] + own + around[cut:])


def _background(docs: DataFrame, id_col: str, text_col: str, vocabulary: dict[bytes, int], templates) -> list[tuple[list[int], list[bytes]]]:
    """Of BACKGROUND rows (least hashes of id) PARAGRAPHS paragraphs each (least hashes of the whole text's), but none that
    belongs to a notice or holds most of a template: (features, first words), in a fixed order."""
    keyed = docs.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    least = [r["h"] for r in keyed.select("h").distinct().orderBy("h").limit(BACKGROUND).collect()]  # hashes only: every task sends its own candidates
    if not least:
        return []
    rows = keyed.filter(F.col("h") <= least[-1])
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, templates))

    def pick(batches):
        vocabulary, templates = held.value
        runs, sets = Runs(templates), [t for ts in templates.values() for t in ts]
        for b in batches:
            out: list[tuple] = []
            for h, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                blocks = [[split_words(x) for x in lines] for lines in blocks_of(t)]
                wrapped = [{k for first, last in runs.of(words) for k in range(first, last + 1)} if len(words) > 1 else () for words in blocks]
                plain = [(zlib.crc32(b" ".join(w)), w) for words, gone in zip(blocks, wrapped) for k, w in enumerate(words) if k not in gone]
                plain = [(c, w) for c, w in sorted(plain) if all(len(_pairs(w) & s) < CONFIRM * len(s) for s in sets)]
                out += [(h, sorted({vocabulary[g] for g in grams(w) if g in vocabulary}), b" ".join(w[:FILLER])) for _, w in plain[:PARAGRAPHS]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.binary()))], names=["h", "features", "words"])

    found = rows.mapInArrow(pick, "h long, features array<int>, words binary").collect()  # BACKGROUND * PARAGRAPHS rows at most, but for repeated ids
    return [(list(f), bytes(w).split()) for _, f, w in sorted((r["h"], tuple(r["features"]), bytes(r["words"])) for r in found)]


def train(docs: DataFrame, id_col="doc_id", text_col="text") -> Classifier:
    """From the fixed values and a bounded sample of the corpus' paragraphs (see ``_background``), which count as unknown. Null
    texts are left out, repeated rows count as often as they are there. Works on an empty table, too. The temperature is fitted on
    paragraphs whose template the judging model hasn't seen; classes have the same weight."""
    rng = random.Random(7)
    templates = {f: [_template(t) for t in ts] for f, ts in TEMPLATES.items()}
    fixed = [t for ts in [*TEMPLATES.values(), FOREIGN] for t in ts]
    vocabulary = {g: k for k, g in enumerate(sorted(set().union(*(grams(split_words(t.encode())) for t in fixed))))}
    plain = _background(docs, id_col, text_col, vocabulary, templates)
    families = list(TEMPLATES)
    names = [*families, UNKNOWN]
    variants = list(_variants(rng, [w for _, words in plain for w in words]))
    rows = [tuple(sorted(vocabulary[g] for g in grams(split_words(p)) if g in vocabulary)) for _, _, p in variants] + [tuple(f) for f, _ in plain]
    y = np.array([names.index(f) for f, _, _ in variants] + [len(families)] * len(plain))
    fold = np.array([number % FOLDS for _, number, _ in variants] + [k % FOLDS for k in range(len(plain))])
    fit = lambda keep: _softmax_fit([r for r, k in zip(rows, keep) if k], y[keep], len(vocabulary), len(names))
    z = np.zeros((len(rows), len(names)))
    for k in range(FOLDS):
        w = fit(fold != k)
        z[fold == k] = [w[list(r)].sum(0) + w[-1] for r, own in zip(rows, fold) if own == k]
    asked = np.array([bool(r) for r in rows])  # paragraphs without a feature are unknown without a model
    z, y_asked = z[asked], y[asked]
    each = 1 / np.bincount(y_asked, minlength=len(names))[y_asked]

    def probabilities(t):
        p = np.exp((z - z.max(1, keepdims=True)) / t)
        return p / p.sum(1, keepdims=True)

    def loss(t):
        return -(each * np.log(np.maximum(probabilities(t)[np.arange(len(z)), y_asked], 1e-300))).sum()

    temperature = min((float(t) for t in np.geomspace(0.2, 20, 60)), key=loss)
    p = probabilities(temperature)
    told = reliability(p.max(1), p.argmax(1) == y_asked, each)
    return Classifier(families, vocabulary, fit(np.ones(len(rows), bool)), temperature, templates, told)


def reliability(probability: np.ndarray, right: np.ndarray, weight: np.ndarray, bins: int = 10) -> list[tuple[float, int, float, float, float]]:
    """(least probability, rows, share of all weight, mean probability, share that was right) of bins of the probability, means
    by weight; bins without rows are left out."""
    of = np.minimum((probability * bins).astype(int), bins - 1)
    out = []
    for k in np.unique(of):
        own = of == k
        means = (float(np.average(x[own], weights=weight[own])) for x in (probability, right))
        out.append((float(k) / bins, int(own.sum()), float(weight[own].sum() / weight.sum()), *means))
    return out


def scan(docs: DataFrame, model: Classifier, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_paragraphs, licences) per row of ``docs``: paragraphs are lines that aren't blank; licences has (paragraph,
    family, probability, likeness, confirmed) for those that aren't unknown; a notice over several lines stands once, at its
    first. Of families that are equally likely the first in order counts. Null and empty texts have no paragraphs; texts and
    paragraphs may be of any length; ids may be null or repeated, repeated rows give the same; an empty table gives no rows.
    Other columns are left out, whatever their names."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((model.families, model.vocabulary, model.weights, model.temperature, model.templates))
    row = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("likeness", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches):
        own = Classifier(*held.value)
        for b in batches:
            n, found = [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                at, each = 0, []
                for lines in blocks_of(t or b""):
                    for k, family, probability, likeness in own.notices(lines):
                        each.append({"paragraph": at + k, "family": family, "probability": probability, "likeness": likeness, "confirmed": likeness >= CONFIRM})
                    at += len(lines)
                n.append(at)
                found.append(each)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.list_(row))], names=["id", "n_paragraphs", "licences"])

    schema = f"id {kind}, n_paragraphs long, licences array<struct<paragraph:int,family:string,probability:double,likeness:double,confirmed:boolean>>"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op2_licence_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(docs))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        F.col("id").alias("doc_id"), "n_paragraphs", F.size(sure).cast("long").alias("n_licences"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"])))).alias("families"),
        F.size(F.filter("licences", lambda x: ~x["confirmed"])).cast("long").alias("n_unconfirmed"),
    )
