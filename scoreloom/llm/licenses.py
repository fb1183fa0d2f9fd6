"""Licence notices found by a trained paragraph classifier and confirmed by templates.

A paragraph is a run of lines without a blank one between them; a line without a letter or digit, such as
a bare comment mark, is blank. It is read in overlapping windows of two lengths (``SCALES``), so a short notice is not
lost among other words and a wrapped one is not torn apart. The features of a window are hashed word 1- and 2-grams; a softmax
regression gives a probability to each licence family and to the unknown class. It is trained in numpy on the driver: on
variants of the templates (words dropped, cut, neighbours added) and on ``SAMPLE_DOCS`` documents at most, of whose
whole texts ``DRAWN`` windows each are drawn as the unknown class.

A window proposes each family of probability ``FLOOR`` or more. The notice is confirmed if the window and its
surroundings in the paragraph hold ``CONFIRMED`` of the word 3-grams of a template of that family, and half of those that tell it
from each similar template of another family. The least probability that counts is calibrated on the scanned table itself: over all windows of all whole texts
that are ``UNLIKE`` any template, at most one in ``ONE_IN`` reaches it. One pass reads the texts; the calibration reads its output.

Defined cases: a null or empty text has no licence and no row; a repeated row is found again; a null ``doc_id`` is a document;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import GOLDEN, ODD, WordHashes, bytes_of, map_batches, mix
from scoreloom.staging import staged

_GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
#: Notices by family.
TEMPLATES = {
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    "GPL-3.0": (
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3 or later.",
        _GNU.format("This program", "", "3"),
    ),
    "GPL-2.0": (
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Licensed under the GNU General Public License, version 2.",
        _GNU.format("This program", "", "2"),
    ),
    "LGPL": (
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        _GNU.format("This library", "Lesser ", "2.1"),
    ),
    "AGPL-3.0": (
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the GNU Affero General Public License, version 3.",
        _GNU.format("This program", "Affero ", "3"),
    ),
    "BSD": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC0": ("Released into the public domain under CC0 1.0.",),
}
FAMILIES = sorted(TEMPLATES)
FEATURES = 1 << 15
#: Words of a window and of a step, from the shortest window on.
SCALES = ((8, 4), (48, 24))
#: Words of a text whose weights are summed at once; a longer text is read in several rounds.
ROUND = 1 << 15
SAMPLE_DOCS, DRAWN, VARIANTS = 1000, 4, 60
FLOOR, CONFIRMED, UNLIKE, ONE_IN = 0.02, 0.6, 0.3, 2000
#: Steps of probability in which unknown windows are counted.
BINS = 1000
FOUND = "doc_id long, found array<struct<family: string, paragraph: int, probability: double, similarity: double>>, unlike array<int>, windows long"
_TOKEN = re.compile(rb"[a-z0-9]+(?:[.][a-z0-9]+)*|\n")
_hashes = WordHashes()
_LINE_END = _hashes[b"\n"]


def tokens(text: bytes) -> list[bytes]:
    """The words of a text, in lower case, and its line ends."""
    return _TOKEN.findall(text.lower().replace(b"\r\n", b"\n").replace(b"\r", b"\n"))


def paragraphs(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The words of a text, their hashes, and where paragraphs start and the last one ends."""
    found = tokens(text)
    hashes = _hashes.of(found)
    ends = hashes == _LINE_END
    if ends.all():
        return [], hashes[:0], np.zeros(1, np.int64)
    blank = np.zeros(len(found), bool)
    np.logical_and(ends[1:], ends[:-1], out=blank[1:])
    of_word = np.cumsum(blank)[~ends]
    words = [w for w in found if w != b"\n"] if ends.any() else found
    return words, hashes[~ends], np.concatenate([[0], np.flatnonzero(of_word[1:] != of_word[:-1]) + 1, [len(words)]])


def grams(words: list[bytes], n: int = 3) -> set:
    return set(zip(*[words[k:] for k in range(n)], strict=False))


def features(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each word, given by its hash, and of each pair of neighbours."""
    limit = np.uint64(FEATURES - 1)
    return (mix(h) & limit).astype(np.int64), (mix(h[:-1] * ODD + h[1:]) & limit).astype(np.int64)


def windows(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and paragraph of every window, by start; a paragraph within a shorter window needs no longer one."""
    starts, lengths = edges[:-1], np.diff(edges)
    out, shorter = [], 0
    for size, step in SCALES:
        own = np.flatnonzero(lengths > shorter)
        count = 1 + np.maximum(0, -(-(lengths[own] - size) // step))
        which = np.repeat(own, count)
        at = starts[which] + step * (np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count))
        out.append((at, np.minimum(at + size, edges[which + 1]), which))
        shorter = size
    at, to, which = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((to, at))
    return at[order], to[order], which[order]


class Template:
    """The grams of a notice, and for each similar notice of another family those that tell it from that one."""

    def __init__(self, words: list[bytes]):
        self.n = min(3, len(words))
        self.length = len(words)
        self.all = grams(words, self.n)
        self.apart: list[set] = []

    def similarity(self, words: list[bytes]) -> tuple[float, bool]:
        """The part of its grams that ``words`` hold, and whether they hold half of every set that tells it apart."""
        held = self.all & grams(words, self.n)
        return len(held) / len(self.all), all(2 * len(held & own) >= len(own) for own in self.apart)


def _templates() -> dict[str, list[Template]]:
    out = {f: [Template(tokens(t.encode())) for t in TEMPLATES[f]] for f in FAMILIES}
    for family, held in out.items():
        others = [t.all for f, ts in out.items() if f != family for t in ts]
        for t in held:
            t.apart = [t.all - other for other in others if t.all & other and t.all - other]
    return out


class Classifier:
    """Softmax regression over sparse features; class 0 is unknown."""

    def __init__(self):
        self.weights = np.zeros((FEATURES, len(FAMILIES) + 1), np.float32)
        self.bias = np.zeros(len(FAMILIES) + 1, np.float32)
        self.templates = _templates()
        #: Words around a window that a template may reach into.
        self.reach = max(t.length for ts in self.templates.values() for t in ts)

    def probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of one window, the plain way."""
        single, pairs = features(_hashes.of(words))
        e = self.weights[np.concatenate([single, pairs])].sum(axis=0, dtype=np.float64)
        e = e / np.sqrt(2 * len(words) - 1) + self.bias
        e = np.exp(e - e.max())
        return e / e.sum()

    def train(self, samples: list[list[bytes]], labels: list[int], epochs: int = 6, rate: float = 0.1) -> None:
        rng = np.random.default_rng(5)
        seen = [np.concatenate(features(_hashes.of(s))) for s in samples]
        squares = np.full(self.weights.shape, 1e-2, np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(seen)):
                f = seen[k]
                size = np.sqrt(len(f))
                e = self.weights[f].sum(axis=0) / size + self.bias
                e = np.exp(e - e.max())
                d = e / e.sum()
                d[labels[k]] -= 1
                self.bias -= 0.01 * d
                step = np.broadcast_to(d / size, (len(f), len(d)))
                squares[f] += step * step
                self.weights[f] -= rate * step / np.sqrt(squares[f])

    def of_windows(self, hashes: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Probabilities of windows, by running sums over the words: a word is looked up once however many hold it."""
        out = np.empty((len(at), len(self.bias)))
        for first in range(0, len(hashes), ROUND):
            here = slice(*np.searchsorted(at, [first, first + ROUND]).tolist())
            if here.start == here.stop:
                continue
            single, pairs = features(hashes[first : int(to[here].max())])
            alone = self.weights[single]
            sums = np.zeros((len(alone) + 1, alone.shape[1]))
            sums[1:] = alone
            sums[1:-1] += self.weights[pairs]
            np.cumsum(sums, axis=0, out=sums)
            a, b = at[here] - first, to[here] - first
            e = (sums[b - 1] - sums[a] + alone[b - 1]) / np.sqrt(2 * (b - a) - 1)[:, None] + self.bias
            e -= e.max(axis=1, keepdims=True)
            np.exp(e, out=e)
            np.divide(e, e.sum(axis=1, keepdims=True), out=out[here])
        return np.round(out, 6)

    def read(self, text: bytes | None) -> tuple[list[dict], list[int], int]:
        """The likeliest confirmed window of each family, the steps of unknown windows, and the number of windows."""
        words, hashes, edges = paragraphs(text or b"")
        if not words:
            return [], [], 0
        at, to, which = windows(edges)
        p = self.of_windows(hashes, at, to)
        best: dict[str, dict] = {}
        unlike = []
        for k in np.flatnonzero(p[:, 1:].max(axis=1) >= FLOOR).tolist():
            i = int(which[k])
            around = words[max(edges[i], at[k] - self.reach) : min(edges[i + 1], to[k] + self.reach)]
            near = {f: [t.similarity(around) for t in ts] for f, ts in self.templates.items()}
            if max(s for held in near.values() for s, _ in held) < UNLIKE:
                unlike.append(int(p[k, 1:].max() * BINS))
                continue
            for c, family in enumerate(FAMILIES, 1):
                similarity = max((s for s, apart in near[family] if apart), default=0.0)
                if p[k, c] < FLOOR or similarity < CONFIRMED or (family in best and p[k, c] <= best[family]["probability"]):
                    continue
                best[family] = {"family": family, "paragraph": i, "probability": float(p[k, c]), "similarity": similarity}
        return [best[f] for f in sorted(best)], unlike, len(at)

    def search(self, text: bytes | None) -> list[dict]:
        """The likeliest confirmed paragraph of each family in a text, whatever its probability."""
        return self.read(text)[0]


def _unknown_windows(docs: DataFrame, classifier: Classifier) -> list[list[bytes]]:
    """Windows unlike any template, drawn by hash from the whole texts of a bounded number of documents."""
    rows = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", F.lit(9), F.xxhash64("text")).alias("p"), "text")
    # a first cut by hash leaves about twice the documents needed; the driver orders these
    cut = int(min(1.0, 2 * SAMPLE_DOCS / max(1, rows.count())) * (1 << 20))
    known = docs.sparkSession.sparkContext.broadcast(classifier.templates)

    def draw(batches):
        seen: set[int] = set()
        for batch in batches:
            out = []
            for place, text in zip(batch.column("p").to_pylist(), bytes_of(batch.column("text")), strict=True):
                words, _, edges = paragraphs(text)
                if place in seen or not words:
                    continue
                seen.add(place)
                at, to, _ = windows(edges)
                order = np.argsort(mix(np.arange(len(at), dtype=np.uint64) * GOLDEN + np.uint64(place & (1 << 64) - 1)))
                drawn = [words[at[k] : to[k]] for k in order[:DRAWN]]
                drawn = [w for w in drawn if all(t.similarity(w)[0] < UNLIKE for ts in known.value.values() for t in ts)]
                out += [(place, b" ".join(w)) for w in drawn]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([w for _, w in out], pa.binary())], names=["p", "words"])

    few = rows.where(F.pmod("p", F.lit(1 << 20)) <= cut).mapInArrow(draw, "p long, words binary").distinct().collect()
    chosen = sorted({r["p"] for r in few})[:SAMPLE_DOCS]
    last = chosen[-1] if chosen else 0
    return [w.split() for p, w in sorted((r["p"], bytes(r["words"])) for r in few) if p <= last]


def train_classifier(docs: DataFrame) -> Classifier:
    """Templates against windows of a bounded sample of ``docs(doc_id, text)``."""
    out = Classifier()
    samples = _unknown_windows(docs, out)
    labels = [0] * len(samples)
    around = [x for w in samples[:200] for x in w] or [b"text"]
    rng = np.random.default_rng(3)
    for k, family in enumerate(FAMILIES, 1):
        for template in TEMPLATES[family]:
            words = tokens(template.encode())
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.05] or words
                size = SCALES[int(rng.integers(len(SCALES)))][0]
                start = int(rng.integers(0, max(1, len(kept) - size + 1)))
                kept = kept[start : start + size]
                free = int(rng.integers(0, size - len(kept) + 1)) if rng.random() < 0.6 else 0
                before = int(rng.integers(0, free + 1))
                pick = [around[i] for i in rng.integers(0, len(around), free)]
                samples.append(pick[:before] + kept + pick[before:])
                labels.append(k)
    out.train(samples, labels)
    return out


def read_licenses(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: confirmed notices, steps of unknown windows, number of windows; written once."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def read(batch: pa.RecordBatch) -> dict:
        found, unlike, count = zip(*[sent.value.read(t) for t in bytes_of(batch.column("text"))], strict=True) if batch.num_rows else ((), (), ())
        return {"doc_id": batch.column("doc_id"), "found": list(found), "unlike": list(unlike), "windows": list(count)}

    return staged(map_batches(docs.select(F.col("doc_id").cast("long"), "text"), read, FOUND), "licenses")


def least_probability(read: DataFrame) -> float:
    """The probability that at most one in ``ONE_IN`` unknown windows of the whole table reaches."""
    windows_ = read.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    steps = read.select(F.explode("unlike").alias("step")).groupBy("step").count().collect()  # BINS rows at most
    reached, least = 0, FLOOR
    for step, n in sorted(((r["step"], r["count"]) for r in steps), reverse=True):
        reached += n
        if reached > windows_ // ONE_IN:
            least = max(least, (step + 1) / BINS)
            break
    return min(least, 1.0)


def scan_licenses(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """``(doc_id, family, paragraph, probability, similarity)``: a row per document and family it names."""
    read = read_licenses(docs, classifier)
    found = read.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    return found.where(F.col("probability") >= F.lit(least_probability(read)))
