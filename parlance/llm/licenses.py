"""Licence scans with a trained paragraph classifier.

Sparse n-grams of words feed a multinomial logistic regression over licence
families and an unknown class, trained here on varied templates and on other
text.  Its probabilities are calibrated on examples it has not seen, and a
prediction counts only if the paragraph shares enough n-grams with a template
of the family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, key_to_id, record, slices, text_bytes

UNKNOWN = "unknown"
#: Notices by family, as their licences recommend them or as they are commonly shortened.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU GPL version 2.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "Proprietary": ("All rights reserved.", "Copyright (c) 2024 the authors. All rights reserved.", "This document is confidential and proprietary. Unauthorized copying is prohibited."),
}
#: Text of other kinds that shares words with notices.
OTHER = (
    "The license plate was found in the public park, and the general opened a version of the file.",
    "She got her driving license at the age of eighteen and works under a general contract.",
    "All of the people reserved a table for the evening, and the rights were read to them.",
    "The above conditions of the work include a copy of the source and the name of the author.",
    "You should have a free copy of this program at the public library along with other software.",
    "The university under the international treaty released a statement on common creative work.",
    "Use of this form is required by the following agreement, with a fee and without any purpose.",
    "This work is based on the version of the story that the general public knows.",
    "He had permission to copy the notice, to publish it, and to sell copies to any person.",
    "Rights reserved seats all over the house; the software under test was a basic version.",
)
_WORD = re.compile(rb"[a-z0-9]+(?:[-.][a-z0-9]+)*")
#: Least calibrated probability, and least share of n-grams in common with a template.
LEAST_PROBABILITY, LEAST_OVERLAP = 0.5, 0.6
#: Least share of the word pairs of several lines that templates of one family have, for the lines to be one paragraph.
LEAST_PURITY = 0.8


def tokens(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def grams(words: list[bytes], most: int = 3) -> list[bytes]:
    """All runs of one to ``most`` words."""
    return [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


class SparseRows:
    """Features of paragraphs: the places of each one's n-grams, whose values are 1 / sqrt(their number); and a bias of 1."""

    def __init__(self, paragraphs: list[list[bytes]], features: dict[bytes, int]):
        found = [sorted({features[g] for g in grams(words) if g in features}) for words in paragraphs]
        self.sizes = np.array([len(f) for f in found], np.int64)
        self.at = np.array([x for f in found for x in f], np.int64)
        self.owner = np.repeat(np.arange(len(found)), self.sizes)
        self.value = 1 / np.sqrt(np.maximum(self.sizes, 1))

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """(paragraphs, classes) of ``weights`` (features + 1, classes), the last row the bias."""
        out = np.tile(weights[-1], (len(self.sizes), 1))
        some = np.flatnonzero(self.sizes)
        if len(some):
            starts = (np.cumsum(self.sizes) - self.sizes)[some]
            out[some] += np.add.reduceat(weights[self.at], starts, axis=0) * self.value[some, None]
        return out

    def gradient(self, errors: np.ndarray, features: int) -> np.ndarray:
        """The sum over paragraphs of features times errors (paragraphs, classes)."""
        flat = errors[self.owner] * self.value[self.owner, None]
        out = np.stack([np.bincount(self.at, flat[:, k], features) for k in range(errors.shape[1])], axis=1)
        return np.concatenate([out, errors.sum(axis=0, keepdims=True)])


@dataclass
class LicenseModel:
    """``weights`` is (features + 1, classes), the last row the bias; probabilities are softmax(scores / temperature)."""

    families: list[str]
    features: dict[bytes, int]
    weights: np.ndarray
    temperature: float
    template_pairs: list[list[frozenset[bytes]]]

    def probabilities(self, paragraphs: list[list[bytes]]) -> np.ndarray:
        return _softmax(SparseRows(paragraphs, self.features).scores(self.weights) / self.temperature)

    def overlap(self, words: list[bytes], family: int) -> float:
        """The largest share of a template's word pairs that the paragraph has, or of the paragraph's that a template has."""
        own = _pairs(words)
        if not own:
            return 0.0
        return max((max(len(own & t) / len(t), len(own & t) / len(own) if len(own) >= 4 else 0.0) for t in self.template_pairs[family]), default=0.0)

    def purity(self, words: list[bytes], family: str) -> float:
        """The share of the paragraph's word pairs that some template of the family has."""
        own = _pairs(words)
        return len(own & frozenset().union(*self.template_pairs[self.families.index(family)])) / max(1, len(own))


def _pairs(words: list[bytes]) -> frozenset[bytes]:
    return frozenset(a + b" " + b for a, b in zip(words, words[1:], strict=False))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(rng: np.random.Generator, background: list[list[bytes]], each: int) -> tuple[list[list[bytes]], list[int]]:
    """Varied templates of every family, and other text for the unknown class (the last)."""
    texts, classes = [], []
    families = list(TEMPLATES)
    vocabulary = sorted({w for t in TEMPLATES.values() for x in t for w in tokens(x.encode())})
    for k, family in enumerate(families):
        base = [tokens(t.encode()) for t in TEMPLATES[family]]
        for i in range(each):
            words = [w for w in base[i % len(base)] if rng.random() > (0.06 if len(base[i % len(base)]) > 8 else 0)]
            if background and rng.random() < 0.5:
                noise = background[rng.integers(len(background))]
                cut = rng.integers(0, min(len(noise), 30) + 1)
                words = words + noise[:cut] if rng.random() < 0.5 else noise[:cut] + words
            texts.append(words)
            classes.append(k)
    other = [tokens(t.encode()) for t in OTHER]
    for i in range(4 * each):
        if i % 4 == 0 and background:
            words = background[rng.integers(len(background))]
        elif i % 4 == 1:
            words = [vocabulary[j] for j in rng.integers(0, len(vocabulary), rng.integers(1, 25))]
        elif i % 4 == 2:
            words = list(rng.permutation(np.array(base_words := other[rng.integers(len(other))], object)[: rng.integers(3, len(base_words) + 1)]))
        else:
            words = other[rng.integers(len(other))]
        texts.append(words)
        classes.append(len(families))
    return texts, classes


def train(background: list[str] = (), seed: int = 7, each: int = 60, steps: int = 150) -> LicenseModel:
    """Fits the classifier to the templates and to paragraphs of other text, and calibrates its temperature.

    ``background`` is a bounded list of paragraphs for the unknown class; those
    which hold a word pair of a template's are not used.
    """
    families = list(TEMPLATES)
    template_pairs = [[_pairs(tokens(t.encode())) for t in TEMPLATES[f]] for f in families]
    known = set().union(*(p for f in template_pairs for p in f))
    plain = [w for w in (tokens(b.encode()) for b in background) if not _pairs(w) & known]
    features = {g: i for i, g in enumerate(sorted({g for t in (*[x for f in TEMPLATES.values() for x in f], *OTHER) for g in grams(tokens(t.encode()))}))}
    model = LicenseModel([*families, UNKNOWN], features, np.zeros((len(features) + 1, len(families) + 1)), 1.0, [*template_pairs, []])

    texts, classes = _examples(np.random.default_rng(seed), plain, each)
    x, y = SparseRows(texts, features), np.eye(len(families) + 1)[classes]
    w = np.zeros(model.weights.shape)
    velocity = np.zeros_like(w)
    for _ in range(steps):
        gradient = x.gradient(_softmax(x.scores(w)) - y, len(features)) / len(texts) + 1e-5 * w
        velocity = 0.9 * velocity - 8.0 * gradient
        w += velocity
    held, held_classes = _examples(np.random.default_rng(seed + 1), plain, max(1, each // 3))
    scores, right = SparseRows(held, features).scores(w), np.arange(len(held))
    loss = {t: -np.log(np.maximum(_softmax(scores / t)[right, held_classes], 1e-12)).mean() for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)}
    model.weights, model.temperature = w, min(loss, key=loss.get)
    return model


def scan(df: DataFrame, model: LicenseModel, id_col: str = "doc_id", text_col: str = "text", least_probability: float = LEAST_PROBABILITY, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """(id, paragraph, last, family, probability, overlap) of each paragraph that is a licence notice.

    Lines are what newlines part, numbered from 0.  Neighbouring lines that
    hold a word pair of some template are a run.  A run that is a notice as a
    whole, nearly all of whose word pairs templates of that family have, is one
    paragraph, so a hard-wrapped licence is judged whole; otherwise each of its
    lines is a paragraph.  ``paragraph`` and ``last`` are its first and last
    line.  A paragraph is a notice if a family is likelier than any other and
    the unknown class, by at least ``least_probability``, and it shares
    ``least_overlap`` of the word pairs with one of the family's templates.
    Lines without a word pair of any template share nothing, so they are not
    scored.  Null and empty texts have no paragraphs; repeated rows each give
    theirs; other columns don't matter; an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judged(own: LicenseModel, paragraphs: list[list[bytes]]) -> list[tuple[str, float, float] | None]:
        out: list[tuple[str, float, float] | None] = []
        for begin in range(0, len(paragraphs), 500):
            some = paragraphs[begin : begin + 500]
            p = own.probabilities(some)
            for words, best, most in zip(some, p.argmax(axis=1), p.max(axis=1), strict=True):
                common = own.overlap(words, best) if own.families[best] != UNKNOWN and most >= least_probability else -1.0
                out.append((own.families[best], float(most), common) if common >= least_overlap else None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        pairs = frozenset().union(*(t for f in own.template_pairs for t in f))
        starts = frozenset(p.split(b" ")[0] for p in pairs)
        for batch in batches:
            for part in slices(batch, "text"):
                found: list[tuple[int, int, list[bytes]]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    for k, raw in enumerate(text.lower().split(b"\n")):
                        words = _WORD.findall(raw)
                        if not starts.isdisjoint(words) and not pairs.isdisjoint(map(b" ".join, zip(words, words[1:], strict=False))):
                            found.append((i, k, words))
                single = judged(own, [f[2] for f in found])
                edges = [k for k in range(len(found)) if not k or found[k][0] != found[k - 1][0] or found[k][1] != found[k - 1][1] + 1]
                runs = list(zip(edges, [*edges[1:], len(found)], strict=True)) if edges else []
                spans = [(a, b) for a, b in runs if b - a > 1]
                whole = dict(zip(spans, judged(own, [[w for f in found[a:b] for w in f[2]] for a, b in spans]), strict=True))
                rows: list[tuple[int, int, int, str, float, float]] = []
                for a, b in runs:
                    all_ = whole.get((a, b))
                    if all_ and own.purity([w for f in found[a:b] for w in f[2]], all_[0]) >= LEAST_PURITY:
                        rows.append((found[a][0], found[a][1], found[b - 1][1], *all_))
                    else:
                        rows += [(found[k][0], found[k][1], found[k][1], *single[k]) for k in range(a, b) if single[k]]
                at, first, last, family, chance, common = (list(c) for c in zip(*rows, strict=True)) if rows else ([] for _ in range(6))
                yield record(doc=part.column("doc").take(pa.array(at, pa.int64())), paragraph=pa.array(first, pa.int32()), last=pa.array(last, pa.int32()), family=pa.array(family, pa.string()), probability=pa.array(chance, pa.float64()), overlap=pa.array(common, pa.float64()))

    out = df.select(doc_key(id_col, text_col).alias("doc"), text_bytes(text_col).alias("text")).mapInArrow(run, "doc long, paragraph int, last int, family string, probability double, overlap double")
    return out.select(key_to_id("doc").alias(id_col), "paragraph", "last", "family", "probability", "overlap")


def background(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = 200, paragraphs: int = 600) -> list[str]:
    """Paragraphs of the documents with the smallest hashes of their ids: at most ``documents`` of them reach the driver."""
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").select("id", F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"))
    ids = chosen.orderBy("h", "id", "t").limit(documents).select("id").distinct()
    lines = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").select("id", F.posexplode(F.split("text", "\n")).alias("n", "line")).where("length(line) between 20 and 2000")
    return [r[0] for r in lines.orderBy("id", "n", "line").limit(paragraphs).select("line").collect()]
