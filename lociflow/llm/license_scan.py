"""Licence scans: a trained classifier of passages, whose finds a comparison with templates confirms.

Passages are scored by a multinomial logistic regression on sparse word n-grams; its classes are licence families and
`unknown`, and a family's score is its probability against `unknown` alone. It is trained here, on variants of the
templates below, on scrambled templates, and on a bounded sample of the corpus' own paragraphs (lines with words)
without any template. Its temperature and the least probability of a family are calibrated on variants and paragraphs
held out. A predicted family stands only if the passage holds at least LEAST_SIMILARITY of the five-word shingles of
one of its templates.

Passages are any runs of words, over line breaks and comment marks, so wrapped texts count whole. As both conditions
must hold, the shingles are looked up first and only passages that pass are scored.
"""

from __future__ import annotations

import bisect
import itertools
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices of licences, as their authors ask to state them, and sentences of their texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "Released under the GNU GPL, version 3 or later.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
    ),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License 2.0.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Licensed under the zlib License.",
    ),
    "Artistic-2.0": ("This program is free software; you may redistribute it and/or modify it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License 2.0."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "EUPL": ("Licensed under the EUPL, Version 1.2 or later",),
    "WTFPL": ("This work is free. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2",),
    "OFL": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0": ("Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "Proprietary": ("All rights reserved.", "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This software is proprietary and confidential."),
}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
SHINGLE, LEAST_SIMILARITY = 5, 0.8
#: A passage is at most so many times as long as its template.
REACH = 2
#: Words that few texts without a licence hold, to tell those without reading them word for word.
HARDLY_PROSE = frozenset("license licensed permission redistribution copyright reserved proprietary unencumbered bsd cc0 gnu software".split())
#: Paragraphs of the corpus that training may see, characters of the longest that may be one (20 MB in all at most),
#: documents that they come from on average, and variants of each template.
SAMPLE_PARAGRAPHS, SAMPLE_CHARACTERS, SAMPLE_DOCUMENTS, VARIANTS = 2000, 10_000, 1000, 60
#: Of held-out paragraphs without a licence, the share that may pass the least probability.
FALSE_SHARE = 0.001
SEED = 7

_tokens = re.compile(r"[^\W_]+").findall
_words = re.compile(r"[^\W_]+").finditer
#: Words that mark a comment at the start of a line; other marks aren't words.
_marks = re.compile(r"(?im)^[ \t]*(?:dnl|rem)(?=[ \t\r\n])").finditer
_paragraphs = re.compile(r"[^\n\r\x0b\x0c]*\w[^\n\r\x0b\x0c]*").finditer


def shingles(tokens: list[str]) -> tuple[tuple[str, ...], ...]:
    """Distinct five-word shingles in order; a shorter text is one."""
    return tuple(dict.fromkeys(tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))))


def against_unknown(z: np.ndarray) -> np.ndarray:
    """Of logits of all classes, the probability of each against the first."""
    return 1 / (1 + np.exp(np.clip(z[..., :1] - z, -500, 500)))


@dataclass(frozen=True)
class Scanner:
    """A trained classifier: n-grams with rows of weights, biases, and what calibration found."""

    grams: dict[tuple[str, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    templates: tuple[tuple[int, tuple[tuple[str, ...], ...]], ...]

    @cached_property
    def places(self) -> dict[tuple[str, ...], list[tuple[int, int]]]:
        """Numbers of the templates that hold a shingle, and its place in each."""
        out: dict[tuple[str, ...], list[tuple[int, int]]] = {}
        for i, (_, t) in enumerate(self.templates):
            for place, s in enumerate(t):
                out.setdefault(s, []).append((i, place))
        return out

    @cached_property
    def marks(self) -> tuple[str, ...]:
        """Words, one of which every passage holds that is similar to a template: without them too few shingles are left."""
        common: Counter = Counter(w for _, t in self.templates for w in {w for s in t for w in s})
        out: set[str] = set()
        for _, t in self.templates:
            left, own = set(t), set()
            while len(left) >= LEAST_SIMILARITY * len(t):
                held = Counter(w for s in left for w in set(s))
                w = max(held, key=lambda w: (w in out, w in HARDLY_PROSE, len(w) > 3, held[w], common[w], w))
                own.add(w)
                left = {s for s in left if w not in s}
            out |= own
        return tuple(sorted(w for w in out if not any(v != w and v in w for v in out)))

    def features(self, tokens: list[str]) -> list[int]:
        """Numbers of the known n-grams (of 1 to 3 words) of a paragraph; longer ones only where their words are known."""
        get = self.grams.get
        found, before, last = set(), None, None
        for t in tokens:
            one = get((t,))
            if one is not None:
                found.add(one)
                if last is not None:
                    found.add(get((last, t)))
                    if before is not None:
                        found.add(get((before, last, t)))
                before, last = last, t
            else:
                before = last = None
        found.discard(None)
        return sorted(found)

    def probabilities(self, features: list[int]) -> np.ndarray:
        """Of each family against `unknown` alone, so that families don't take from each other."""
        return against_unknown((self.bias + self.weights[features].sum(axis=0)) / self.temperature)

    def passages(self, tokens: list[str]) -> Iterator[tuple[bool, int, int, int, float]]:
        """(astray, first, end, template, similarity) of runs of tokens that hold enough of a template's shingles.

        A run begins at any shingle and goes as far as they follow in the template's order, or if that isn't enough
        (astray) in any order, within REACH times the template's length."""
        hits: dict[int, list[tuple[int, int]]] = {}
        get = self.places.get
        for n in {len(s) for s in self.places}:
            for i, s in enumerate(zip(*(tokens[k:] for k in range(n)))):
                for t, place in get(s, ()):
                    hits.setdefault(t, []).append((i, place))
        for t, found in hits.items():
            k, size = len(self.templates[t][1]), len(next(iter(self.templates[t][1])))
            if len({place for _, place in found}) < LEAST_SIMILARITY * k:
                continue
            for j, (first, last) in enumerate(found):
                seen, end, astray = set(), first, False
                for i, place in itertools.islice(found, j, None):
                    if i - first > REACH * (k + size):
                        break
                    if i > first and place <= last:
                        if len(seen) >= LEAST_SIMILARITY * k:
                            break
                        astray = True
                    if place not in seen:
                        seen.add(place)
                        end = i + size
                    last = place
                if len(seen) >= LEAST_SIMILARITY * k:
                    yield astray, first, end, t, len(seen) / k

    def scan(self, text: str | None) -> list[tuple[int, int, str, float, float]]:
        """(start, end, family, probability, similarity) of confirmed passages, as characters of the text, in order.

        Of passages that overlap, those in order, more similar to their template, then of the longer template, stand;
        one of the same family widens it."""
        low = (text or "").lower()
        if not any(w in low for w in self.marks):
            return []
        skip = {m.end() for m in _marks(text)}
        at = [(m[0].lower(), m.start(), m.end()) for m in _words(text) if m.end() not in skip]
        tokens = [t for t, _, _ in at]
        scored = []
        for astray, first, end, t, similarity in self.passages(tokens):
            k = self.templates[t][0]
            p = self.probabilities(self.features(tokens[first:end]))
            if p[k] >= self.least:
                scored.append((astray, -similarity, -len(self.templates[t][1]), end - first, -float(p[k]), first, end, k))
        taken: list[list] = []  # first, end, family, probability, similarity; apart from each other, in order
        for astray, less, _, _, q, first, end, k in sorted(scored):
            lo = bisect.bisect_right(taken, first, key=lambda x: x[1])
            hi = bisect.bisect_left(taken, end, key=lambda x: x[0])
            if lo == hi:
                taken.insert(lo, [first, end, k, -q, -less])
            elif hi == lo + 1 and taken[lo][2] == k and not astray:
                taken[lo][:2] = min(first, taken[lo][0]), max(end, taken[lo][1])
        return [(at[first][1], at[end - 1][2], FAMILIES[k], round(p, 6), round(s, 6)) for first, end, k, p, s in taken]


def variants(rng: random.Random, prose: list[list[str]]) -> list[tuple[list[str], int]]:
    """Training paragraphs: templates with words lost, in prose or in part, and, of no family, their scrambled words."""
    out = []
    for k, (_, texts) in enumerate(TEMPLATES.items(), 1):
        for text in texts:
            tokens = _tokens(text.lower())
            for v in range(VARIANTS):
                lost = 0.0 if v % 3 == 0 else 0.08
                own = [t for t in tokens if rng.random() >= lost] or tokens
                around = rng.choice(prose) if prose and v % 2 else []
                at = rng.randrange(len(around) + 1)
                out.append((around[:at] + own + around[at:], k))
            for _ in range(VARIANTS // 6):
                some = rng.sample(tokens, max(1, len(tokens) // 2))
                around = rng.choice(prose) if prose else []
                at = rng.randrange(len(around) + 1)
                out.append((around[:at] + some[: rng.randrange(1, 4)] + around[at:], 0))
    return out + [(p, 0) for p in prose]


def train(paragraphs: list[str]) -> Scanner:
    """Fit and calibrate, with paragraphs of the corpus as examples of no family (those with a template inside are left
    out). The same paragraphs give the same scanner."""
    rng = random.Random(SEED)
    templates = tuple((k, shingles(_tokens(t.lower()))) for k, (_, texts) in enumerate(TEMPLATES.items(), 1) for t in texts)
    known = {s for _, t in templates for s in t}
    prose = []
    for p in paragraphs:
        tokens = _tokens(p.lower())
        if not any(tuple(tokens[i : i + n]) in known for n in range(3, SHINGLE + 1) for i in range(len(tokens) - n + 1)):
            prose.append(tokens)
    grams: dict[tuple[str, ...], int] = {}
    for texts in TEMPLATES.values():
        for t in texts:
            tokens = _tokens(t.lower())
            for n in (1, 2, 3):
                for i in range(len(tokens) - n + 1):
                    grams.setdefault(tuple(tokens[i : i + n]), len(grams))
    blank = Scanner(grams, np.zeros((len(grams), len(FAMILIES))), np.zeros(len(FAMILIES)), 1.0, 0.5, templates)
    data = [(blank.features(t), k) for t, k in variants(rng, prose)]
    rng.shuffle(data)
    cut = len(data) * 4 // 5
    x = np.zeros((len(data), len(grams)), np.float32)
    for i, (f, _) in enumerate(data):
        x[i, f] = 1
    y = np.array([k for _, k in data])
    hot = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b = np.zeros((len(grams), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(150):  # gradient descent with momentum and a small ridge
        z = x[:cut] @ w + b
        z = np.exp(z - z.max(axis=1, keepdims=True))
        error = z / z.sum(axis=1, keepdims=True) - hot[:cut]
        mw = 0.9 * mw + x[:cut].T @ error / cut + 1e-5 * w
        mb = 0.9 * mb + error.mean(axis=0)
        w, b = w - 2.0 * mw, b - 2.0 * mb
    z = (x[cut:] @ w + b).astype(np.float64)

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(probabilities(t)[np.arange(len(z)), y[cut:]], 1e-12)).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    p = against_unknown(z / temperature)
    none = np.sort(p[y[cut:] == 0][:, 1:].max(axis=1)) if (y[cut:] == 0).any() else np.array([0.0])
    least = float(np.clip(none[max(0, int(len(none) * (1 - FALSE_SHARE)) - 1)], 0.3, 0.6))
    return Scanner(grams, w.astype(np.float64), b.astype(np.float64), temperature, least, templates)


def training_paragraphs(docs: DataFrame) -> list[str]:
    """At most SAMPLE_PARAGRAPHS paragraphs, those with the least hash of the documents whose ids have the least hashes
    (about SAMPLE_DOCUMENTS of them, all if there are fewer). So what tasks send to the driver doesn't grow."""
    n = docs.count()
    if not n:
        return []
    positive = lambda *c: F.xxhash64(*c).bitwiseAND(F.lit(2**63 - 1))
    some = docs.where(positive("doc_id") <= int(min(1.0, SAMPLE_DOCUMENTS / n) * 2**63) - 1)
    each = some.select("doc_id", F.explode(F.split("text", r"[\n\r\x0B\x0C]+")).alias("p")).where(F.col("p").rlike(r"\w") & (F.length("p") <= SAMPLE_CHARACTERS))
    return [r.p for r in each.select(positive("doc_id", "p").alias("h"), "p").orderBy("h", "p").limit(SAMPLE_PARAGRAPHS).collect()]


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, licence, families and findings of each row of docs (doc_id, text; others aren't read).

    findings are the confirmed passages (start and end characters, family, probability, similarity), in order;
    n_paragraphs counts lines with words;
    families are their distinct families, sorted, and licence is the family of the most findings, the first in order
    of those with as many, or null. Null and empty texts have no paragraphs. Repeated rows give repeated rows.
    """
    scanner = docs.sparkSession.sparkContext.broadcast(train(training_paragraphs(docs)))
    finding = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [scanner.value.scan(t) for t in texts]
            n = [sum(1 for _ in _paragraphs(t or "")) for t in texts]
            families = [sorted({x[2] for x in f}) for f in found]
            most = [min(names, key=lambda k: (-sum(x[2] == k for x in f), k)) if names else None for names, f in zip(families, found)]
            rows = [[dict(zip(("start", "end", "family", "probability", "similarity"), x)) for x in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(most, pa.string()), pa.array(families, pa.list_(pa.string())), pa.array(rows, pa.list_(finding))], ["doc_id", "n_paragraphs", "licence", "families", "findings"])

    shape = "doc_id long, n_paragraphs long, licence string, families array<string>, findings array<struct<start:long,end:long,family:string,probability:double,similarity:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, shape)
