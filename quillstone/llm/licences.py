"""Licence scan by a trained paragraph classifier.

Paragraphs (lines) are scored by a multinomial logistic regression over sparse word n-grams (1 to 3) for the licence
families, licence text of no family (`unknown`) and other text. It is trained here on variations of template sentences
and of sentences of other licences, whole or cut, with words lost, replaced and added, against paragraphs of the corpus
itself (a bounded sample, a parameter). Calibration uses sentences and paragraphs kept out of the training: a
temperature makes the probabilities true shares, and a limit is set below which a family's paragraph is `unknown` too.
A predicted family is confirmed by comparison with its templates: the paragraph must have a share of a template's word
3-grams, its numbers, and half of those 3-grams that tell the template from each other family; with the share but
without the rest (another version, another condition) it is `unknown`.

Most paragraphs need no score: the largest weights that each word can bring into any n-gram that it starts are summed,
and a paragraph whose sum cannot outweigh the class of other text is passed over. That bound is exact.

Rows: null and empty texts and blank lines have no paragraph; a text may have several rows, one for each paragraph with
licence text, numbered from 0 among its lines; adjacent lines up to a blank one are a paragraph too, with the number of
their first line, where together they confirm a family that none of them confirms (a grant wrapped over lines); repeated rows get theirs each; null ids are kept; an empty table gives an
empty result; other columns are ignored. Whole texts are scanned, a line of any length as one paragraph.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, uniform

#: The sentences by which public licences are granted or named, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "bsd": ("Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    "cc-by-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, dedicated to the public domain under CC0 1.0 Universal."),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "isc": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "lgpl": ("This work is licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    "mit": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "mpl-2.0": ("Released under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."),
    "reserved": ("All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
}
#: Licence text of no family above: what the class `unknown` is trained on.
OTHERS = (
    "Use of this material is governed by the Northwind Community License Agreement.",
    "You may copy this text for private study if the source is named.",
    "This data set is licensed for research purposes only; redistribution requires a signed agreement.",
    "Distributed under the terms of the Example Vendor Evaluation License.",
    "The contents may be shared with students of the course, but not published.",
    "Licensed to the recipient named above for internal use only.",
    "This font is licensed under the Open Typeface Terms, version 7.",
    "Permission to quote short passages is granted to reviewers.",
    "By installing this product you accept the end user license agreement that came with it.",
    "The authors disclaim all warranties, including implied warranties of merchantability and fitness for a particular purpose.",
    "The software is supplied as is, without warranty of any kind; in no event shall the authors be liable for any damages.",
    "Altered versions must be plainly marked as such and must not be misrepresented as being the original work.",
    "The licensee may not sublicense, sell or transfer this license without written consent of the licensor.",
    "Each contributor grants you a royalty-free, worldwide copyright license to reproduce and distribute the contribution.",
    "This document may be distributed verbatim, provided that no fee is charged and this notice is kept.",
    "Licensed under the Regional Open Data License; derivatives must be shared under the same terms.",
    "Commercial use of these images requires a separate license from the copyright holder.",
    "Any person may use the text freely as long as credit is given to the publisher.",
    "This notice does not grant permission to use the trade names or trademarks of the licensor.",
    "If you modify the program, you must make the source code of your changes available under this license.",
)
#: Licence text of no family, kept out of the training: sets the limit of `unknown`.
CALIBRATION = (
    "This publication is made available under the Harbour Press Reader License.",
    "Educational institutions may reproduce these pages free of charge with attribution.",
    "You are permitted to use the library in your own programs, but not to resell it.",
    "The database is provided under the terms of the Lakeside Data Agreement, version 2.",
    "Redistribution of the recordings in any form is prohibited without a license from the label.",
    "The material is offered without any guarantee, and the copyright owner accepts no liability for its use.",
    "Copying and distribution of this file, with or without modification, are permitted if the author is credited.",
    "This specification is subject to the patent and copyright policy of the consortium.",
    "Use, copying and display of the work is allowed for non-profit organisations under their membership license.",
    "A license to the source code is granted to subscribers for the duration of the agreement.",
    "This work is licensed under the Meadow Share License, version 1.0.",
    "Released under the Quartz Public Terms.",
)
#: Other text, where the corpus gives none.
PLAIN = ("The weather was fine and the road led along the river to the next village.", "In this section we describe how the samples were collected.", "Add the flour and stir until the mixture is smooth.")
NONE, UNKNOWN = "none", "unknown"
SCHEMA = "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean"
_WORD = re.compile(r"\w+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(w: list[str]) -> set[str]:
    return {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def trigrams(w: list[str]) -> set[tuple[str, ...]]:
    return set(zip(w, w[1:], w[2:], strict=False))


def _compared() -> dict[str, list[tuple[set, list[set], set]]]:
    """For each family its templates' word 3-grams, the sets of those that tell each from another family's, and its numbers."""
    all_ = {f: [trigrams(words(t)) for t in ts] for f, ts in TEMPLATES.items()}
    whole = {f: set().union(*gs) for f, gs in all_.items()}
    apart = lambda f, g: [g - whole[o] for o in whole if o != f and g & whole[o] and g - whole[o]]
    return {f: [(g, apart(f, g), {x for x in words(t) if x[0].isdigit()}) for g, t in zip(all_[f], ts, strict=True)] for f, ts in TEMPLATES.items()}


_COMPARED = _compared()


def similarity(w: list[str], family: str) -> float:
    """Of a template's word 3-grams, the share that the paragraph has; the best template of the family counts."""
    own = trigrams(w)
    return max((len(g & own) / len(g) for g, *_ in _COMPARED.get(family, ())), default=0.0)


def compare(w: list[str], family: str, confirm: float) -> tuple[float, bool, bool]:
    """(similarity, confirmed, contradicted). A template that the paragraph has the share `confirm` of confirms the family if
    the paragraph also has its numbers and half of what tells it from each other family; if templates are similar but
    none has that, the paragraph is another licence of the same wording."""
    own, single = trigrams(w), set(w)
    like = [(len(g & own) / len(g), numbers <= single and all(2 * len(d & own) >= len(d) for d in apart)) for g, apart, numbers in _COMPARED.get(family, ())]
    near = [ok for x, ok in like if x >= confirm]
    return max((x for x, _ in like), default=0.0), any(near), bool(near) and not any(near)


class Model:
    """Weights of the n-grams of the templates and of other licences for each family, `unknown` and other text (last), and the limit."""

    def __init__(self):
        self.families = [*TEMPLATES, UNKNOWN, NONE]
        self.vocabulary = {g: i for i, g in enumerate(sorted(set().union(*(grams(words(t)) for ts in (*TEMPLATES.values(), OTHERS) for t in ts))))}
        self.w = np.zeros((len(self.vocabulary), len(self.families)), dtype=np.float32)
        self.b = np.zeros(len(self.families), dtype=np.float32)
        self.limit, self.report, self.top = 0.5, 0.5, {}

    def ids(self, w: list[str]) -> list[int]:
        return [i for g in grams(w) if (i := self.vocabulary.get(g)) is not None]

    def probabilities(self, w: list[str]) -> np.ndarray:
        z = self.w[self.ids(w)].sum(axis=0, dtype=np.float64) + self.b
        z = np.exp(z - z.max())
        return z / z.sum()

    def train(self, samples: list[tuple[list[str], int]], epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        ids = [np.array(self.ids(w), dtype=np.int64) for w, _ in samples]
        y = np.array([c for _, c in samples])
        m, s = [np.zeros_like(self.w), np.zeros_like(self.b)], [np.zeros_like(self.w), np.zeros_like(self.b)]
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(samples))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x = np.zeros((len(pick), len(self.vocabulary)), dtype=np.float32)
                for r, k in enumerate(pick):
                    x[r, ids[k]] = 1
                z = x @ self.w + self.b
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), y[pick]] -= 1
                p /= len(pick)
                t += 1
                for q, (par, g) in enumerate(((self.w, x.T @ p + decay * self.w), (self.b, p.sum(axis=0)))):
                    m[q] = 0.9 * m[q] + 0.1 * g
                    s[q] = 0.999 * s[q] + 0.001 * g * g
                    par -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)
        self.bounds()

    def temper(self, samples: list[tuple[list[str], int]]) -> None:
        """Divides all weights by the temperature that makes these samples likeliest, so that probabilities are calibrated."""
        z = np.array([self.w[self.ids(w)].sum(axis=0, dtype=np.float64) + self.b for w, _ in samples])
        y = np.array([c for _, c in samples])

        def loss(t: float) -> float:
            s = z / t - (z / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

        best = min((float(t) for t in np.geomspace(0.2, 5, 65)), key=loss)
        self.w, self.b = (self.w / best).astype(np.float32), (self.b / best).astype(np.float32)
        self.bounds()

    def bounds(self) -> None:
        """For each word the most that n-grams starting with it can add to any family over the class of other text."""
        gain = np.maximum(0, (self.w[:, :-1] - self.w[:, -1:]).max(axis=1))
        best: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
        for g, i in self.vocabulary.items():
            n = g.count(" ")
            first = g.split(" ", 1)[0]
            best[first][n] = max(best[first][n], float(gain[i]))
        self.top = {w: sum(x) for w, x in best.items() if sum(x) > 0}

    def floor(self) -> float:
        """A sum of bounds below this leaves the class of other text with at least half of the probability."""
        return float(-np.log(len(self.families) - 1) - (self.b[:-1] - self.b[-1]).max())


def varied(sentence: list[str], other: list[str], rng) -> list[str]:
    """The words of a sentence with some lost or replaced, and others around; the whole one a fifth of the time."""
    w = list(sentence)
    if rng.random() > 0.2:
        w = [other[rng.integers(len(other))] if rng.random() < 0.03 else x for x in w if rng.random() > 0.04 or len(w) < 6]
    if len(w) > 14 and rng.random() < 0.4:
        a = rng.integers(0, len(w) - 10)
        w = w[a : a + rng.integers(10, len(w) - a + 1)]
    pick = lambda: [other[i] for i in rng.integers(len(other), size=rng.integers(0, 9))]
    return (pick() if rng.random() < 0.4 else []) + w + (pick() if rng.random() < 0.4 else [])


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", background: int = 600, paragraphs: int = 4000, longest: int = 50_000, each: int = 250, seed: int = 3) -> Model:
    """Other text comes from at most `background` documents of up to `longest` characters (the bound of what the driver
    collects), the first by a hash of their ids, and `paragraphs` of them."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null").where(F.length("text") <= longest)
    picked = keyed.select("doc_id", uniform(F.col("doc_id"), seed).alias("u")).orderBy("u", "doc_id").limit(background)  # a bounded number of rows
    rows = keyed.join(F.broadcast(picked.distinct()), "doc_id").orderBy("u", "doc_id", "text").select("text").limit(2 * background).collect()
    lines = [words(x) for r in rows for x in r["text"].split("\n") if x.strip()]
    lines = [w for w in lines[:paragraphs] if max(similarity(w, f) for f in TEMPLATES) < 0.5] or [words(x) for x in PLAIN]
    rng = np.random.default_rng(seed)
    pool = sorted({x for w in lines for x in w})
    model = Model()
    unknown, none = len(TEMPLATES), len(TEMPLATES) + 1
    aside = lines[::5] or lines  # other text for the calibration
    samples = [(w, none) for k, w in enumerate(lines) if k % 5 or len(lines) < 5]
    for k, ts in enumerate((*TEMPLATES.values(), OTHERS)):
        for t in ts:
            samples += [(varied(words(t), pool, rng), k) for _ in range(max(12, each // len(ts)))]
            samples += [(words(t), k)] * 5
    model.train(samples)
    # Calibrated on new variations, sentences of no family that were kept out, and other text kept out.
    known = [(varied(words(t), pool, rng), k) for k, ts in enumerate(TEMPLATES.values()) for t in ts for _ in range(6)]
    strange = [varied(words(t), pool, rng) for t in CALIBRATION for _ in range(25)]
    model.temper([*known, *((w, unknown) for w in strange), *((w, none) for w in aside)])
    # Paragraphs of no family are reported where 99 % of other text is not, between one half and a quarter.
    model.report = float(np.clip(np.quantile([model.probabilities(w)[-1] for w in aside], 0.01), 0.25, 0.5))
    # The limit keeps 95 % of what is reported of sentences of no family out of the families, but no whole template sentence.
    reported = sorted(float(p[:unknown].max()) for w in strange for p in [model.probabilities(w)] if p[-1] < 0.5)
    whole = min(float(model.probabilities(words(t))[k]) for k, ts in enumerate(TEMPLATES.values()) for t in ts)
    model.limit = min(reported[int(0.95 * len(reported))] if reported else 0.5, whole * 0.98)
    return model


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.5) -> DataFrame:
    """A row for each paragraph with licence text: SCHEMA. Family is `unknown` below the calibrated limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model.__dict__)

    def work():
        m = Model.__new__(Model)
        m.__dict__ = shared.value
        get, floor = m.top.get, m.floor()
        known = {g for ts in TEMPLATES.values() for t in ts for tw in [words(t)] for g in zip(tw, tw[1:], tw[2:])}

        def wrapped(block: list[list[str]], sure: set[str]):
            """(family, probability, similarity) that lines confirm together, from their first known 3-gram to their last."""
            w = [x for line in block for x in line]
            if not known.intersection(zip(w, w[1:], w[2:])):
                return None
            at = [i for i, g in enumerate(zip(w, w[1:], w[2:])) if g in known]
            w = w[at[0] : at[-1] + 3]
            if not any(f not in sure and compare(w, f, confirm)[1] for f in TEMPLATES):
                return None
            p = m.probabilities(w)
            best = int(p[:-1].argmax())
            family, (like, confirmed, _) = m.families[best], compare(w, m.families[best], confirm)
            return (family, float(p[best]), like) if p[-1] < 0.5 and p[best] >= m.limit and confirmed and family not in sure else None

        def call(texts):
            out = []
            for i, text in enumerate(texts):
                block, sure = [], set()
                for k, line in enumerate([*text.split("\n"), ""] if text else ()):
                    w = words(line)
                    if line.strip():
                        block.append(w)
                    else:
                        if len(block) > 1 and (grant := wrapped(block, sure)):
                            out.append((i, k - len(block), *grant, True))
                        block, sure = [], set()
                    if not w or sum([get(x, 0.0) for x in w]) < floor:
                        continue
                    p = m.probabilities(w)
                    if p[-1] >= 0.5:
                        continue
                    best = int(p[:-1].argmax())
                    like, confirmed, contradicted = compare(w, m.families[best], confirm)
                    family = m.families[best] if p[best] >= m.limit and not contradicted else UNKNOWN
                    if family == UNKNOWN and p[-1] >= m.report:
                        continue
                    out.append((i, k, family, float(p[best]), like, family != UNKNOWN and confirmed))
                    if out[-1][-1]:
                        sure.add(family)
            return [tuple(zip(*out, strict=True))] if out else []

        return call

    return by_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, SCHEMA)
