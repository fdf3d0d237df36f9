"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are sentences; lines that are wrapped are joined, and where a joined paragraph is no notice, its lines are
judged one by one. A multinomial logistic regression on word uni- and bigrams tells license families apart and from
everything else. It's trained on perturbed notices, on notices whose telling words were exchanged (which are unknown
licenses), and on paragraphs of the corpus itself; a temperature, fitted on held-out ones, calibrates its
probabilities, so that the unknown class gets what isn't sure. A prediction stands if the paragraph follows a
template of the family closely enough, word pair by word pair in order, and no other family's more closely. Word
pairs count by how few families have them, so another license's name in a template's place isn't confirmed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.functions.session import small_batches, table
from mergeloom.llm import _text
from mergeloom.llm._sample import fitting_sample

#: Documents, at most, some of whose paragraphs are examples of the unknown class, and paragraphs taken from each.
FIT_ROWS = 2_000
FIT_PARAGRAPHS = 2
#: Uni- and bigrams of those that the model knows besides the templates' own, the most frequent ones.
FEATURES = 1_000
PERTURBED = 30
EXCHANGED = 10
ROUNDS = 150
LEAST = 0.5
SIMILAR = 0.5
#: A line of so many bytes goes on in the next one, unless it ends a sentence.
WRAPPED = (30, 120)

# Short public notices by which license families name themselves.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Released under the AGPL v3."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD license."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, distribution, and reproduction in any medium, provided the original work is properly cited."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives License."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL v2."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.", "Licensed under the ISC License."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at", "Licensed under the Mozilla Public License 2.0."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This software is proprietary and may be used only under the terms of a license agreement."],
}
#: Notices of so few words that a part of them says nothing; a paragraph must hold the whole.
NOTICES = {
    "agpl": ["GNU Affero General Public License", "GNU AGPL"], "apache": ["Apache License", "Apache 2.0 License"], "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"], "cc-by": ["CC BY 4.0"], "cc-by-nc": ["CC BY-NC 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0"], "cc0": ["CC0 1.0"], "gpl": ["GNU General Public License", "GNU GPL"], "isc": ["ISC License"], "lgpl": ["GNU Lesser General Public License", "GNU LGPL"], "mit": ["MIT License"], "mpl": ["Mozilla Public License"],
    "proprietary": ["All rights reserved."],
}
#: Sentences that speak of the same things without granting or naming a license.
UNRELATED = [
    "The driver must carry a valid license at all times.", "Her license was revoked after the second offence.", "The software version 3 was released in the spring.", "Public transport is free of charge on weekends.",
    "Terms and conditions may apply to this offer.", "The general public was invited to the foundation.", "He took artistic license with the source material.", "The work is available in the library.",
    "They redistribute income under the new law.", "Version 2.0 of the program is under development.", "The apache helicopter landed without warning.", "Students of MIT released a study.",
    "The copyright law was modified by parliament.", "A warranty of two years is provided with the product.", "Permission to enter was granted by the owner.", "The license plate was from another state.",
    "All seats must be reserved in advance.", "Human rights belong to all people.",
]

_NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_STOP = np.zeros(256, np.int64)
_STOP[[ord(c) for c in ".!?"]] = 1
_LINE = np.zeros(256, np.int64)
_LINE[10] = 1


@dataclass
class Form:
    """A template or notice: its word pairs in order, and what each is worth (one for one that no other family has)."""

    pairs: np.ndarray
    worth: np.ndarray
    whole: bool  # a notice must be held as a whole

    def held(self, pairs: np.ndarray) -> float:
        """How much of it a paragraph (its word pairs in order) follows: 0 to 1."""
        n = len(self.pairs)
        if not n or not len(pairs):
            return 0.0
        if self.whole:
            return float(any((pairs[i : i + n] == self.pairs).all() for i in np.flatnonzero(pairs[: len(pairs) - n + 1] == self.pairs[0])))
        if len(pairs) > 2 * n + 8:  # the stretch with the most of its word pairs
            found = np.concatenate([[0], np.cumsum(np.isin(pairs, self.pairs))])
            i = int((found[2 * n + 8 :] - found[: -2 * n - 8]).argmax())
            pairs = pairs[i : i + 2 * n + 8]
        best = np.zeros(len(pairs) + 1)  # worth of the best common subsequence up to each place
        for x, worth in zip(self.pairs, self.worth, strict=True):
            best[1:] = np.maximum(best[1:], np.where(pairs == x, best[:-1] + worth, 0))
            best = np.maximum.accumulate(best)
        return float(best[-1] / self.worth.sum())


@dataclass
class Model:
    families: list[str]  # the last class, without a name here, is unknown
    hashes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    forms: list[list[Form]]
    known: dict[bytes, tuple[float, float]] = field(default_factory=dict)

    def likeness(self, family: int, pairs: np.ndarray) -> tuple[float, float]:
        """How closely a paragraph follows the family's forms, and the closest of the other families'."""
        key = family.to_bytes(2, "little") + pairs.tobytes()
        if key not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            like = [max(f.held(pairs) for f in forms) for forms in self.forms]
            self.known[key] = (like[family], max([x for i, x in enumerate(like) if i != family], default=0.0))
        return self.known[key]


def paragraphs(column: pa.Array) -> Iterator[tuple]:
    """Per chunk: first row, bytes, row offsets, word starts and ends, first word of each row, first word of each joined paragraph, of each line or sentence, and hashes of the words."""
    for lo, _, raw, at in _text.chunks(column):
        start, end, row = _text.words(raw, at, _NOT_WORD)
        joined = np.zeros(len(start), bool)
        lines = joined
        if len(start):
            stops, breaks = np.concatenate([[0], np.cumsum(_STOP[raw])]), np.concatenate([[0], np.cumsum(_LINE[raw])])
            gap = start[1:] - end[:-1]
            ends = (stops[start[1:]] > stops[end[:-1]]) & (gap >= 2)
            crossed = breaks[start[1:]] - breaks[end[:-1]]
            # how long the line is that a word ends
            at_break = np.flatnonzero(raw == 10)
            edges = np.unique(np.concatenate([[-1], at_break, at - 1, [len(raw)]]))
            k = np.searchsorted(edges, end[:-1], "left")
            size = edges[np.minimum(k, len(edges) - 1)] - edges[k - 1] - 1
            hard = (crossed > 1) | ((crossed == 1) & ((size < WRAPPED[0]) | (size > WRAPPED[1])))
            joined[1:] = ends | hard
            lines = np.zeros(len(start), bool)
            lines[1:] = ends | (crossed > 0)
            head = row[:-1][np.diff(row) > 0]
            joined[head] = lines[head] = True
        yield lo, raw, at, start, end, row, np.flatnonzero(joined), np.flatnonzero(lines), _text.hash_spans(raw, start, end)


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbours; of a single word, its own."""
    return _text.mix(words[:-1] * np.uint64(3) + _text.mix(words[1:])) if len(words) > 1 else words


def _words(texts: list[str]) -> list[np.ndarray]:
    """Hashes of the words of each text."""
    out = []
    for _, _, _, _, _, row, _, _, one in paragraphs(pa.array(texts, pa.large_string())):
        out += [one[a:b] for a, b in zip(row[:-1], row[1:], strict=True)]
    return out


def _grams(texts: list[str]) -> list[np.ndarray]:
    return [np.unique(np.concatenate([w, pairs_of(w)])) for w in _words(texts)]


def _perturbed(text: str, rng: np.random.Generator, noise: list[str], telling: set[str], exchange: bool = False) -> str:
    """Without some words that don't tell the family, in capitals, or between others; with ``exchange``, without those that do."""
    words = text.split()
    if exchange:
        words = [noise[int(rng.integers(len(noise)))].split()[0] if _plain(w) in telling else w for w in words]
    elif len(words) > 4:
        words = [w for w in words if _plain(w) in telling or rng.random() > 0.08]
    if rng.random() < 0.3:
        words = [w.upper() for w in words]
    for at, p in ((0, 0.25), (len(words), 0.35)):
        if noise and rng.random() < p:
            words[at:at] = noise[int(rng.integers(len(noise)))].split()[: int(rng.integers(1, 8))]
    return " ".join(words)


def _plain(word: str) -> str:
    return "".join(c for c in word.lower() if c.isalnum())


def fit(corpus: list[str], templates: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None, seed: int = 3) -> Model:
    """Trains on perturbed templates against unrelated sentences, exchanged templates and paragraphs of the corpus that hold no template."""
    templates, notices = TEMPLATES if templates is None else templates, NOTICES if notices is None else notices
    rng = np.random.Generator(np.random.PCG64(seed))
    families = sorted(templates)
    own = {f: templates[f] + notices.get(f, []) for f in families}
    pairs = {f: [pairs_of(w) for w in _words(own[f])] for f in families}
    shared = Counter(x for f in families for x in {int(h) for p in pairs[f] for h in p})
    forms = [[Form(p, np.array([1 / shared[int(x)] for x in p]), i >= len(templates[f])) for i, p in enumerate(pairs[f])] for f in families]
    # words that few families have, by which they're told apart
    vocabulary = {f: {_plain(w) for t in own[f] for w in t.split()} for f in families}
    in_families = Counter(w for f in families for w in vocabulary[f])
    telling = {f: {w for w in vocabulary[f] if in_families[w] <= 3} for f in families}

    noise: list[str] = []
    for text in corpus:
        lines = [x for line in text.split("\n") for x in line.split(". ") if x.strip()]
        noise += [lines[int(i)] for i in rng.choice(len(lines), min(FIT_PARAGRAPHS, len(lines)), replace=False)] if lines else []
    every = [g for f in families for g in _grams(own[f])]
    full = [i >= len(templates[f]) for f in families for i in range(len(own[f]))]
    held_by = _grams(noise) if noise else []
    of, flat, clean = np.repeat(np.arange(len(noise)), [len(g) for g in held_by]), np.concatenate([*held_by, np.zeros(0, np.uint64)]), np.ones(len(noise), bool)
    for t, whole in zip(every, full, strict=True):  # paragraphs that hold a template are no examples of the unknown class
        clean &= np.bincount(of[np.isin(flat, t)], minlength=len(noise)) < (1 if whole else SIMILAR / 2) * len(t)
    noise = [x for x, ok in zip(noise, clean, strict=True) if ok]
    noise = [x for x in noise if x.split()]
    names = noise or UNRELATED
    texts, labels = list(UNRELATED), [len(families)] * len(UNRELATED)
    for k, f in enumerate(families):
        for t in own[f]:
            texts += [_perturbed(t, rng, noise, telling[f]) for _ in range(PERTURBED)]
            texts += [_perturbed(t, rng, names, telling[f], exchange=True) for _ in range(EXCHANGED)]
            labels += [k] * PERTURBED + [len(families)] * EXCHANGED
    for t in UNRELATED:
        texts += [_perturbed(t, rng, noise, set()) for _ in range(PERTURBED // 2)]
        labels += [len(families)] * (PERTURBED // 2)
    texts += noise
    labels += [len(families)] * len(noise)
    grams = _grams(texts)
    own_grams = np.unique(np.concatenate([*every, *_grams(UNRELATED)]))
    seen, n = np.unique(np.concatenate([*grams[len(texts) - len(noise) :], np.zeros(0, np.uint64)]), return_counts=True)
    often = seen[np.argsort(-n, kind="stable")][:FEATURES]
    known = np.union1d(own_grams, often[n[np.argsort(-n, kind="stable")][:FEATURES] >= 5])
    text = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    hit = known[at] == flat
    x = np.zeros((len(texts), len(known)), np.float32)
    x[text[hit], at[hit]] = 1
    held = rng.random(len(texts)) < 0.3
    y = np.eye(len(families) + 1, dtype=np.float32)[labels]
    w, b = np.zeros((len(known), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    xt, yt = x[~held], y[~held]
    for step in range(1, ROUNDS + 1):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - yt) / len(yt)
        for i, grad in enumerate([xt.T @ g + 1e-4 * w, g.sum(0)]):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            move = 0.08 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
            if i:
                b = b - move
            else:
                w = w - move
    w, b = w.astype(np.float64), b.astype(np.float64)
    z = x[held] @ w + b
    gold = np.array(labels)[held]

    def loss(t: float) -> float:
        q = z / t
        q = q - np.log(np.exp(q - q.max(1, keepdims=True)).sum(1, keepdims=True)) - q.max(1, keepdims=True)
        return -float(q[np.arange(len(gold)), gold].mean())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return Model(families, known, w, b, temperature, forms)


def probabilities(words: np.ndarray, first: np.ndarray, model: Model, rows_of: _text.Weights) -> tuple[np.ndarray, np.ndarray]:
    """(paragraphs with known n-grams, their probabilities by class)."""
    stop = np.append(first[1:], len(words))
    paragraph = np.repeat(np.arange(len(first)), stop - first)
    two = np.zeros(len(words), np.uint64)
    two[:-1] = np.where(paragraph[1:] == paragraph[:-1], _text.mix(words[:-1] * np.uint64(3) + _text.mix(words[1:])), np.uint64(0))
    # each n-gram counts once a paragraph, as in training
    found = [rows_of.rows(g) for g in (words, two)]
    pair = np.unique(np.concatenate([paragraph[f > 0] * (len(model.hashes) + 1) + f[f > 0] for f in found]))
    of, gram = pair // (len(model.hashes) + 1), pair % (len(model.hashes) + 1) - 1
    some, begin = np.unique(of, return_index=True)
    if not len(some):
        return some, np.zeros((0, len(model.bias)))
    z = (np.add.reduceat(model.weights[gram], begin, axis=0) + model.bias) / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return some, p / p.sum(1, keepdims=True)


def scan_texts(column: pa.Array, model: Model, least: float = LEAST, similar: float = SIMILAR) -> Iterator[tuple[int, str, int, int, float, float]]:
    """(row, family, start, end, probability, similarity) of each confirmed paragraph; places in code points."""
    rows_of = _text.Weights(model.hashes, np.arange(len(model.hashes), dtype=np.float64), bits=20)
    for lo, raw, at, start, end, row, joined, lines, words in paragraphs(column):
        if not len(words):
            continue
        out, taken = [], np.zeros(len(words), bool)
        for first in (joined, lines):
            some, p = probabilities(words, first, model, rows_of)
            best, stop = p.argmax(1), np.append(first[1:], len(words))
            for i in np.flatnonzero((best < len(model.families)) & (p.max(1, initial=0) >= least)):
                a, b = int(first[some[i]]), int(stop[some[i]])
                if taken[a:b].any():
                    continue
                like, other = model.likeness(int(best[i]), pairs_of(words[a:b]))
                if like >= similar and like >= other:
                    taken[a:b] = True
                    out.append((a, b, model.families[best[i]], float(p[i].max()), like))
        if out:
            points = _text.code_points(raw)
            for a, b, family, probability, like in sorted(out):
                r = int(np.searchsorted(row, a, "right")) - 1
                zero = points[at[r]]
                yield lo + r, family, int(points[start[a]] - zero), int(points[end[b - 1]] - zero), probability, like


COLUMNS = "doc_id long, family string, start long, end long, probability double, similarity double"


def license_scan(
    docs: DataFrame, least: float = LEAST, similar: float = SIMILAR, bound: int = FIT_ROWS, templates: dict[str, list[str]] | None = None, notices: dict[str, list[str]] | None = None
) -> DataFrame:
    """License notices in whole texts, of the families that ``templates`` (and ``notices``) name; by default those above.

    docs: doc_id, text; further columns are ignored. Returns a row per paragraph that the classifier gives a family with at least
    probability ``least`` and that follows at least ``similar`` of one of the family's templates (or holds one of its short notices), and
    none of another family more closely: doc_id, family, start, end (code
    points, end exclusive), probability and similarity. Texts that are null, empty or without notices give no rows; repeated ones
    give theirs each. Ties between families go to the first by name. An empty table gives no rows (the model then knows only its own
    examples). Rows stay where they are."""
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = fitting_sample(own.where("text is not null"), bound).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])  # at most `bound` rows
    model = fit(rows.column("text").to_pylist(), templates, notices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(scan_texts(batch.column(1), model, least, similar))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([x[0] for x in out], pa.int64())), *[pa.array([x[i + 1] for x in out], k) for i, k in enumerate(kinds)]], names=[c.split()[0] for c in COLUMNS.split(", ")]
            )

    return own.mapInArrow(run, COLUMNS)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scans": op6_license_scans}
SQL: dict[str, str] = {}
