"""Licence notices in documents: a paragraph classifier, trained here.

A sparse logistic regression over word n-grams tells the family of a paragraph,
an unknown licence, or none; what it says is confirmed by comparison with the
templates of the family. Its unknown class is learned from notices of made-up
licences, and the bound on its probabilities is calibrated on others.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

# Wording of common licence notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" basis, without warranties or conditions of any kind.",
    ],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "AGPL-3.0": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This software is proprietary and confidential; no license is granted.", "All rights reserved."],
}
# Identifiers in SPDX lines.
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"], "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause"], "MPL-2.0": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"], "ISC": ["ISC"], "Unlicense": ["Unlicense"],
}
for _family, _ids in SPDX.items():
    TEMPLATES[_family] += [f"SPDX-License-Identifier: {x}" for x in _ids]
# How notices of licences that are not in the list may read.
UNKNOWN_FORMS = [
    "Licensed under the {x} License.", "Licensed under the {x} Public License, version {n}.", "Released under the {x} License, version {n}.", "Distributed under the {x} Software License, Version {n}.",
    "This work is licensed under the {x} Licence v. {n}.", "SPDX-License-Identifier: {x}-{n}", "SPDX-License-Identifier: {x}", "Licensed under the {x}, Version {n} only (the Licence).", "This software is made available under the terms of the {x} License.",
    "You may use, copy and share this file under the terms of the {x} Community License Agreement.", "This program is licensed under the {x} General License, version {n}; see the file for the full text.", "Use of this software is subject to the {x} licence.",
]
# Sentences that look a little like notices and are none.
OTHER = [
    "The minister said that the law was in force and the work is under way in the city.",
    "She lost her driving license and had to apply for a new one at the office.",
    "The new version of the program is free of charge for any person who works in a public library.",
    "In general the public wants a version of the story in which the author is known.",
    "The terms of the agreement were published by the foundation, and the file is in the library.",
    "A copy of the letter was found in the house, and the conditions are met in full.",
    "This file is about the history of the apache people and their use of the land.",
    "He studied at MIT and the work is without modification in the public domain of ideas.",
]
# Short words that run through any prose.
FUNCTION_WORDS = "the of and to in is be it as by for this that with or an are at from on not no de la en que el un des les der die das und von".split()
NONE, UNKNOWN = "none", "unknown"
#: Of a paragraph those stretches are read in which words that licences use lie
#: this close, with some words around; of a longer stretch, windows.
NEAR, AROUND, PARAGRAPH_WORDS = 10, 6, 80
EXAMPLES = 60
#: Share of a template's word pairs that a paragraph must hold to confirm it; a
#: template of few words must be held whole.
CONFIRMED, FEW_WORDS = 0.6, 7
#: Under this share of every template of its family a family is not believed.
NOTICE_SHARE = 0.2
#: Words that tell of a licence wherever they stand.
TELLING = frozenset("license licence licensed licensing licenses spdx mit apache gnu gpl lgpl agpl bsd copyright redistribution".split())

words_of = re.compile(r"\w+").findall


def grams(words: list[str]) -> Counter:
    """Word 1- to 3-grams."""
    return Counter(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def _examples(seed: int) -> list[tuple[list[str], str]]:
    """Notices with words around them or lost from them, notices of licences
    with made-up names, and prose without any."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwz"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    common = [w for x in OTHER for w in words_of(x.lower())] + FUNCTION_WORDS
    filler = lambda n: [word() if rng.random() < 0.5 else rng.choice(common) for _ in range(n)]
    around = lambda words: filler(rng.choice((0, 0, 0, 3, 12))) + words + filler(rng.choice((0, 0, 0, 3, 12)))
    out = []
    for family, texts in TEMPLATES.items():
        for k in range(max(EXAMPLES, 12 * len(texts))):
            words = words_of(texts[k % len(texts)].lower())
            if k % 3 == 2 and len(words) > 30:  # a window of a long paragraph
                at = rng.randrange(len(words) - 20)
                words = words[at : at + rng.randint(20, 50)]
            out.append((around([w for w in words if rng.random() > 0.04]), family))
    for k in range(EXAMPLES * 6):
        name = " ".join(word() for _ in range(rng.randint(1, 3)))
        text = UNKNOWN_FORMS[k % len(UNKNOWN_FORMS)].format(x=name, n=f"{rng.randint(1, 9)}.{rng.randint(0, 9)}")
        out.append((around(words_of(text.lower())), UNKNOWN))
    for k in range(EXAMPLES * 8):
        base = words_of(OTHER[k % len(OTHER)].lower()) if k % 3 == 0 else []
        out.append((filler(rng.randint(1, 40)) + base + filler(rng.randint(0, 20)), NONE))
    return out


@dataclass
class Classifier:
    """Sparse multinomial logistic regression over word n-grams."""

    vocabulary: dict[tuple[str, ...], int]
    weights: np.ndarray  # (features + 1) x classes, the last row the bias
    classes: list[str]
    anchors: frozenset[str]
    least: float = 0.5  # probability below which a family is unknown

    def probabilities(self, words: list[str]) -> np.ndarray:
        scores = self.weights[-1].copy()
        for g, n in grams(words).items():
            if (i := self.vocabulary.get(g)) is not None:
                scores += min(n, 2) * self.weights[i]
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()

    def family(self, words: list[str]) -> tuple[str, float, float] | None:
        """(family or "unknown", probability, share of the family's closest
        template that the words hold), or None for no notice."""
        if self.anchors.isdisjoint(words):
            return None
        p = self.probabilities(words)
        best = self.classes[int(p.argmax())]
        if best == NONE:
            return None
        if best == UNKNOWN:
            return UNKNOWN, float(p.max()), max(t.held(words) for x in _templates().values() for t in x)
        shares = [(t.held(words), t) for t in _templates()[best]]
        sure = p.max() >= self.least and any(share >= t.bound for share, t in shares)
        held = max(share for share, _ in shares)
        if not sure and held < NOTICE_SHARE:
            return None
        return (best if sure else UNKNOWN), float(p.max()), held


class Template:
    """A template's words and word pairs."""

    def __init__(self, text: str):
        self.words = words_of(text.lower())
        self.pairs = set(zip(self.words, self.words[1:], strict=False))
        self.bound = 1.0 if len(self.words) <= FEW_WORDS else CONFIRMED

    def held(self, words: list[str]) -> float:
        """Share of the pairs that ``words`` hold."""
        if not self.pairs:
            return float(self.words[0] in words)
        return len(self.pairs.intersection(zip(words, words[1:], strict=False))) / len(self.pairs)


@cache
def _templates() -> dict[str, list[Template]]:
    return {family: [Template(t) for t in texts] for family, texts in TEMPLATES.items()}


@cache
def trained(seed: int = 5) -> Classifier:
    """Fits the classifier to made-up examples by gradient steps, and calibrates
    it on others: the probability below which a family counts as unknown is the
    lowest that leaves at least 99 of 100 named families right, made-up licences
    and prose being among what is named."""
    examples = _examples(seed)
    known = Counter(g for x, y in examples if y != NONE for g in grams(x))
    listed = {g for texts in (*TEMPLATES.values(), [x.format(x="", n="") for x in UNKNOWN_FORMS]) for t in texts for g in grams(words_of(t.lower()))}
    vocabulary = {g: i for i, g in enumerate(sorted(g for g in listed if known[g] > 1))}
    classes = [*TEMPLATES, UNKNOWN, NONE]
    x = np.zeros((len(examples), len(vocabulary) + 1), np.float32)
    y = np.zeros((len(examples), len(classes)), np.float32)
    for i, (words, label) in enumerate(examples):
        for g, n in grams(words).items():
            if g in vocabulary:
                x[i, vocabulary[g]] = min(n, 2)
        x[i, -1] = 1
        y[i, classes.index(label)] = 1
    w, speed = np.zeros((x.shape[1], len(classes)), np.float32), 0
    for _ in range(300):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.5 * (x.T @ (p - y) / len(x) + 1e-4 * w)
        w = w + speed
    prose = {v for t in OTHER for v in words_of(t.lower())} | set(FUNCTION_WORDS)
    anchors = (frozenset(g[0] for t in TEMPLATES.values() for x in t for g in grams(words_of(x.lower())) if len(g) == 1) - prose) | TELLING
    model = Classifier(vocabulary, w, classes, anchors)
    seen = []
    for words, label in _examples(seed + 1):
        p = model.probabilities(words)
        best = classes[int(p.argmax())]
        if best in TEMPLATES:
            seen.append((float(p.max()), best == label))
    seen.sort(reverse=True)
    right = np.cumsum([ok for _, ok in seen]) / np.arange(1, len(seen) + 1)
    good = np.flatnonzero(right >= 0.99)
    model.least = seen[good[-1]][0] if len(good) else 1.0
    return model


Word = tuple[int, int, str, int]  # start, stop, lower case, line


def _paragraphs(text: str) -> Iterator[list[Word]]:
    """The words of each run of lines that hold a word; a line of nothing but
    marks, such as those that begin a comment, is blank."""
    run: list[Word] = []
    at = 0
    for n, line in enumerate(text.split("\n")):
        own = [(at + m.start(), at + m.end(), m[0].lower(), n) for m in re.finditer(r"\w+", line)]
        if not own and run:
            yield run
            run = []
        run += own
        at += len(line) + 1
    if run:
        yield run


def _stretches(words: list[Word], anchors: frozenset[str]) -> Iterator[tuple[int, int, int, int]]:
    """First and last word between which anchors lie close, and the same with
    the words around."""
    first = last = -1
    for i, w in enumerate([*words, (0, 0, "", 0)]):
        done = i == len(words)
        if not done and w[2] not in anchors:
            continue
        if first >= 0 and (done or i - last > NEAR):
            yield first, last + 1, max(0, first - AROUND), min(len(words), last + 1 + AROUND)
            first = -1
        first, last = i if first < 0 else first, i


def notices(text: str, model: Classifier) -> Iterator[tuple[int, int, str, float, float]]:
    """(start, stop, family, probability, template share) of every notice."""
    if model.anchors.isdisjoint(words_of(text.lower())):
        return
    for words in _paragraphs(text):
        for first, last, low, high in _stretches(words, model.anchors):
            yield from _read(words[low:high], first - low, last - low, model)


def _read(words: list[Word], first: int, last: int, model: Classifier) -> Iterator[tuple[int, int, str, float, float]]:
    """The notices of a stretch, whose anchors lie from ``first`` to ``last``:
    that of the whole of it, or those of its lines if lines confirm different
    families; of a stretch of over PARAGRAPH_WORDS, windows with half overlap."""
    lines = sorted({w[3] for w in words})
    if len(lines) > 1:
        parts = [[i for i, w in enumerate(words) if w[3] == n] for n in lines]
        named = [model.family([words[i][2] for i in p]) for p in parts]
        if len({x[0] for x in named if x and x[0] != UNKNOWN}) > 1:
            for p in parts:
                yield from _read([words[i] for i in p], max(0, first - p[0]), min(len(p), last - p[0]), model)
            return
    step, ended = PARAGRAPH_WORDS // 2, None
    for i in range(0, max(1, len(words) - step), step):
        part = words[i : i + PARAGRAPH_WORDS] if len(words) > PARAGRAPH_WORDS else words
        own = [w[2] for w in part]
        found = model.family(own)
        if found:
            pairs = set().union(*(t.pairs for t in _templates().get(found[0], [])))
            told = [k + d for k, pair in enumerate(zip(own, own[1:], strict=False)) if pair in pairs for d in (0, 1)]
            begin, end = min([first - i, *told]), max([last - i, *(k + 1 for k in told)])
            begin, end = part[max(0, begin)][0], part[min(len(part), end) - 1][1]
            if not (ended and ended[0] == found[0] and ended[1] > begin):
                yield begin, end, *found
            ended = (found[0], end)
        if len(words) <= PARAGRAPH_WORDS:
            break


def scan(docs: DataFrame, model: Classifier | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices of every document: ``doc_id, start, stop, family,
    probability, template_share``, one row per notice.

    A paragraph is a run of lines up to one without a word, so that a notice may
    be wrapped and stand in a comment. Of a paragraph the stretches with words of
    licences are classified, each as a whole unless its lines confirm different
    families; one of over 80 words in windows with half overlap, neighbouring
    windows of one family giving one row. ``family`` is "unknown" where the
    words read like the notice of another licence, or the probability is under
    the calibrated bound, or no template of the family confirms it. Positions
    are in characters. Null and empty texts have none, null ids and repeated
    rows stay; other columns are not read.
    """
    prepare(docs.sparkSession)
    model = model or trained()
    schema = "doc_id long, start int, stop int, family string, probability double, template_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = [], []
            for i, text in enumerate(batch.column(1)):
                found = list(notices(text.as_py() or "", model))
                own += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())
            arrays = [batch.column(0).take(pa.array(own, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "stop", "family", "probability", "template_share"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
