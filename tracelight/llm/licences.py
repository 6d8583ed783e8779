"""Licence scan: a trained paragraph classifier whose predictions templates confirm.

Paragraphs (lines, and runs of lines up to one without words) are scored by a multinomial logistic regression on sparse word n-grams over licence
families and ``unknown``. The unknown class learns from paragraphs of the documents themselves; the
bar a family must reach is set on such paragraphs that were not learned from. A prediction is confirmed
if enough of a template's n-grams stand in the paragraph.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.common import bounded_sample

WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
UNKNOWN = "unknown"
#: Words that two licences named in one paragraph may share.
SHARED = {"licensed", "released", "under", "the", "license"}

#: Notices in common use, by family. The wording is that of the licences and their usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "Released under the 3-Clause BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "This work is dedicated to the public domain under CC0 1.0 Universal",
        "Released under CC0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Released under the Unlicense"),
}


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> list[str]:
    """Words and pairs of neighbours."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # n-grams x (families + unknown)
    bias: np.ndarray
    bar: float
    templates: list[tuple[int, frozenset[str]]]
    _anchors: frozenset[str] | None = field(default=None, repr=False)

    @property
    def anchors(self) -> frozenset[str]:
        """Words without which no family can beat unknown: those of n-grams that speak for a family."""
        if self._anchors is None:
            lifts = (self.weights[:, :-1] - self.weights[:, -1:]).max(axis=1) > 0
            self._anchors = frozenset(w for g, i in self.vocabulary.items() if lifts[i] for w in g.split(" "))
        return self._anchors

    def probabilities(self, words: list[str]) -> np.ndarray:
        rows = [i for i in map(self.vocabulary.get, set(grams(words))) if i is not None]
        score = self.bias + self.weights[rows].sum(axis=0)
        e = np.exp(score - score.max())
        return e / e.sum()

    def similarity(self, family: int, words: list[str]) -> float:
        """Largest share of a template's n-grams that the paragraph holds."""
        own = set(grams(words))
        return max((len(t & own) / len(t) for k, t in self.templates if k == family), default=0.0)

    def named(self, words: list[str], agreement: float) -> list[tuple[int, float, float]]:
        """(family, probability, similarity): the best family of the words; then of what its templates leave
        of them, as long as templates confirm that. A family whose probability others share, so that it
        misses the bar, counts if the words without its own then name another."""
        found: list[tuple[int, float, float]] = []
        shared: list[tuple[int, float, float]] = []
        while not self.anchors.isdisjoint(words):
            p = self.probabilities(words)
            best = int(p[:-1].argmax())
            more, above = found + shared, p[best] >= self.bar
            if p[best] <= p[-1] or 1 - p[-1] < self.bar or any(best == x[0] for x in more):
                break
            one = (best, float(p[best]), self.similarity(best, words))
            own = frozenset().union(*(t for k, t in self.templates if k == best))
            if one[2] < agreement or more and own.isdisjoint(set(words) - SHARED):
                return found or ([one] if above and not more else [])
            if above:
                found, shared = [*found, *shared, one], []
            else:
                shared.append(one)
            pairs = [f"{a} {b}" in own for a, b in zip(words, words[1:])]
            gone = [x or y for x, y in zip([*pairs, False], [False, *pairs])]
            words = [w for w, x in zip(words, gone) if not x or w in SHARED]
        return found

    def scan(self, text: str | None, agreement: float = 0.6) -> list[tuple[int, str, str, float, float]]:
        """(line, paragraph, family, probability, similarity) of every line above the bar, and of runs of lines
        whose templates confirm a family that none of their lines does."""
        found = []
        lines = (text or "").split("\n")
        words = [words_of(line) for line in lines]
        start, sure = 0, set()
        for number in range(len(lines) + 1):
            if number < len(lines) and words[number]:
                for best, p, similarity in self.named(words[number], agreement):
                    found.append((number, lines[number], self.families[best], p, similarity))
                    if similarity >= agreement:
                        sure.add(best)
                continue
            if number - start > 1:
                for best, p, similarity in self.named([w for own in words[start:number] for w in own], agreement):
                    if similarity >= agreement and best not in sure:
                        found.append((start, "\n".join(lines[start:number]), self.families[best], p, similarity))
            start, sure = number + 1, set()
        return found


def train(paragraphs: list[str], steps: int = 300, rate: float = 0.5, sparse: float = 2e-4, per_template: int = 40) -> Model:
    """Proximal gradient descent with an L1 penalty; repeats exactly.

    Positives are templates in the midst of words of the corpus, with words left out now and then;
    unknown learns from half of ``paragraphs``, and the bar is the highest family probability among the
    other half, at least one half.
    """
    random = np.random.default_rng(3)
    families = sorted(TEMPLATES)
    templates = [(k, words_of(t)) for k, f in enumerate(families) for t in TEMPLATES[f]]
    known = [(k, frozenset(grams(t))) for k, t in templates]
    corpus = [words_of(p) for p in paragraphs]
    corpus = [w for w in corpus if w and max(len(t & set(grams(w))) / len(t) for _, t in known) < 0.5]
    learned, checked = corpus[::2], corpus[1::2]
    rows, labels = [], []
    for k, template in templates:
        for n in range(per_template):
            kept = [w for w in template if n == 0 or random.random() > 0.1]
            around = learned[random.integers(len(learned))][: random.integers(0, 12)] if learned and n % 2 else []
            rows.append(kept + around if n % 4 == 1 else around + kept)
            labels.append(k)
    # Words of licences out of place are unknown, too.
    common = [w for _, t in templates for w in t]
    for _ in range(len(templates) * 4):
        some = [common[i] for i in random.integers(0, len(common), 3)]
        rows.append(some + (learned[random.integers(len(learned))][:20] if learned else []))
        labels.append(len(families))
    rows += learned
    labels += [len(families)] * len(learned)
    vocabulary = {g: i for i, g in enumerate(sorted({g for _, t in templates for g in grams(t)}))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for r, words in enumerate(rows):
        x[r, [i for i in map(vocabulary.get, grams(words)) if i is not None]] = 1
    y = np.eye(len(families) + 1, dtype=np.float32)[labels]
    weight = (1 / np.maximum(1, y.sum(axis=0)))[labels]
    weight[np.array(labels) == len(families)] *= len(families)
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    b[-1] = 1.0
    for _ in range(steps):
        score = x @ w + b
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - y) * weight[:, None].astype(np.float32)
        w -= rate * (x.T @ error)
        b -= rate * 0.1 * error.sum(axis=0)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * sparse)
    b[-1] = max(b[-1], b[:-1].max() + 1e-3)  # no evidence at all is unknown
    model = Model(families, vocabulary, w, b, 0.5, known)
    highest = max((float(model.probabilities(v)[:-1].max()) for v in checked if not model.anchors.isdisjoint(v)), default=0.0)
    model.bar = float(np.clip(highest, 0.5, 0.9))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 300, fit_paragraphs: int = 4000) -> Model:
    """Learns unknown from the paragraphs of at most ``fit_rows`` documents (smallest hashes of the id), at
    most ``fit_paragraphs`` of them; families from the templates."""
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    some = bounded_sample(some, "id", fit_rows)
    lines = some.select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    lines = lines.orderBy(F.xxhash64("line"), "line").limit(fit_paragraphs)
    return train([r["line"] for r in lines.collect()])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", agreement: float = 0.6) -> DataFrame:
    """One row per row of ``docs``: id and ``paragraphs``, an array of (line, text, family, probability,
    similarity, confirmed) for each licence paragraph of the whole text.

    Null and empty texts have none; null ids are kept; repeated rows each come out; an empty table
    gives an empty result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["line", "text", "family", "probability", "similarity"]

    @F.pandas_udf("array<struct<line:int,text:string,family:string,probability:double,similarity:double>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(names, x)) for x in shared.value.scan(t, agreement)] for t in texts])

    own = docs.select(F.col(id_col).cast(kind).alias(id_col), find(F.col(text_col)).alias("found"))
    confirmed = F.transform("found", lambda x: x.withField("confirmed", x["similarity"] >= agreement))
    return own.select(id_col, confirmed.alias("paragraphs"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: licences (confirmed families, sorted and comma-joined), counts and the best probability."""
    sure = F.filter("paragraphs", lambda x: x["confirmed"])
    return found.select(
        id_col,
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("licences"),
        F.size("paragraphs").cast("long").alias("n_predicted"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_max(F.transform("paragraphs", lambda x: x["probability"])).alias("probability"),
    )
