"""Licence notices in text: a trained paragraph classifier, confirmed against templates.

A paragraph's word uni-, bi- and trigrams feed one logistic regression for each licence family. It is trained on the
templates below: whole, cut, reworded and amid other words, against paragraphs of other words and of licence words
out of order, which are a class of their own: unknown. On made-up paragraphs held out from training, a Platt scaling
turns each class's scores into probabilities. A family is reported where its probability suffices and isn't below that
of unknown; the best of its templates, aligned with the paragraph, confirms it or doesn't, and the result tells which.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned
from .decontam import lcs

#: Made-up paragraphs of each kind, and their seed.
MADE, SEED = 160, 6
#: Probability from which a family is named; below it the paragraph is unknown.
SURE = 0.5
#: Share of a template's words that a paragraph has in order, from which the template confirms the family.
CONFIRMS = 0.7

#: Short notices by which licences are usually referred to.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "released under the apache 2.0 license",
        "this project is available under the apache license 2.0",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "this project is distributed under the terms of the mit license",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "gpl-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "licensed under the gnu gpl version 3",
        "released under the terms of the gpl v3",
    ],
    "gpl-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
        "licensed under the gnu gpl version 2",
    ],
    "lgpl": [
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "licensed under the gnu lesser general public license version 2.1",
        "released under the lgpl",
    ],
    "agpl-3.0": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it under the terms of the gnu affero general public license",
        "released under the agpl",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
        "released under the 3-clause bsd license",
        "use of this source code is governed by a bsd-style license that can be found in the license file",
    ],
    "mpl-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "this work is licensed under the creative commons attribution license",
    ],
    "cc-by-sa": [
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "text is available under the creative commons attribution-sharealike license",
        "licensed under cc by-sa 4.0",
    ],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under cc by-nc 4.0",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        "released into the public domain under cc0",
        "this work is dedicated to the public domain",
    ],
    "proprietary": [
        "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",
        "confidential and proprietary all rights reserved unauthorized copying is strictly prohibited",
    ],
}
FAMILIES = tuple(TEMPLATES)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_KNOWN = frozenset(w for t in TEMPLATES.values() for x in t for w in words_of(x))
_PLACE = {w: i for i, w in enumerate(sorted(_KNOWN))}
_TEMPLATE_WORDS = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}


def grams(words: list[str]) -> set[str]:
    """Uni-, bi- and trigrams of words that templates have; any other word stands between."""
    w = [x if x in _KNOWN else "" for x in words]
    out = {x for x in w if x}
    for k in (2, 3):
        out.update(" ".join(g) for g in zip(*(w[i:] for i in range(k))) if all(g))
    return out


class LicenceModel(NamedTuple):
    index: dict[str, int]
    weights: np.ndarray  # families and unknown x (grams + 1)
    scale: np.ndarray  # families and unknown x 2: slope and offset of the calibration
    words: np.ndarray  # grams x 3: the places of their words; after them, one that is always there

    def probabilities(self, words: list[str]) -> np.ndarray:
        """Of each family, and last of none of them."""
        at = [self.index[g] for g in sorted(grams(words)) if g in self.index]
        z = self.weights[:, at].sum(axis=1) + self.weights[:, -1]
        return 1 / (1 + np.exp(-np.clip(self.scale[:, 0] * z + self.scale[:, 1], -40, 40)))

    def possible(self, known: frozenset[str], seen: dict) -> np.ndarray:
        """Families that some order of ``known`` words could be sure of: a bound, by all their grams that speak for one."""
        if (out := seen.get(known)) is None:
            there = np.zeros(len(_PLACE) + 1, bool)
            there[[*(_PLACE[w] for w in known), -1]] = True
            at = np.flatnonzero(there[self.words].all(axis=1))
            z = (np.maximum(self.weights[:, at], 0).sum(axis=1) + self.weights[:, -1])[:-1]
            slope, offset = self.scale[:-1].T
            out = seen[known] = (slope <= 0) | (1 / (1 + np.exp(-np.clip(slope * z + offset, -40, 40))) >= SURE)
        return out


def _made(r: random.Random, n: int) -> list[tuple[list[str], int]]:
    """Paragraphs of each family, and as many times two without licence; -1 is unknown."""
    filler = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(400)]
    some = lambda lo, hi: [r.choice(filler) for _ in range(r.randint(lo, hi))]
    common, out = sorted(_KNOWN), []
    for f, templates in enumerate(_TEMPLATE_WORDS.values()):
        for _ in range(n):
            w = list(r.choice(templates))
            if len(w) > 14 and r.random() < 0.5:
                k = r.randint(0, len(w) - 12)
                w = w[k : k + r.randint(12, 30)]
            if r.random() < 0.4:
                w = [x for x in w if r.random() > 0.08] or w
            if r.random() < 0.3:
                w.insert(r.randint(0, len(w)), r.choice(filler))
            out.append((some(0, 12) * (r.random() < 0.5) + w + some(0, 12) * (r.random() < 0.5), f))
    for _ in range(2 * n * len(FAMILIES)):
        k = r.random()
        w = some(1, 40) if k < 0.4 else [r.choice(common) for _ in range(r.randint(1, 25))] if k < 0.7 else [x if r.random() < 0.6 else r.choice(common) for x in some(2, 30)] if k < 0.9 else r.choice(("the license of the driver is expired", "a public version of the file is under way", "terms of use and privacy", "this work is a general version", "she was granted permission to use the library", "free of charge")).split() + some(0, 6)
        out.append((w, -1))
    return out


class _Grams(NamedTuple):
    """Paragraphs' grams as places of ones in a matrix, with a one for each paragraph at the end."""

    row: np.ndarray
    col: np.ndarray
    rows: int
    cols: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Scores: paragraphs x classes."""
        return np.stack([np.bincount(self.row, weights=w[self.col], minlength=self.rows) for w in weights], axis=1)

    def gathered(self, values: np.ndarray) -> np.ndarray:
        """Sums of paragraphs' values by gram: classes x grams."""
        return np.stack([np.bincount(self.col, weights=v[self.row], minlength=self.cols) for v in values.T])


def fit_licences(made: int = MADE, seed: int = SEED) -> LicenceModel:
    """Trains on made-up paragraphs and calibrates on others; the same for the same seed. It reads no table."""
    r = random.Random(seed)
    train, held = _made(r, made), _made(r, made // 2)
    index = {g: i for i, g in enumerate(sorted({g for w, _ in train for g in grams(w)}))}

    def matrix(rows: list) -> tuple[_Grams, np.ndarray]:
        own = [[*(index[g] for g in sorted(grams(w)) if g in index), len(index)] for w, _ in rows]
        y = np.array([y for _, y in rows])
        classes = np.append(np.arange(len(FAMILIES)), -1)
        return _Grams(np.repeat(np.arange(len(rows)), [len(x) for x in own]), np.array([c for x in own for c in x]), len(rows), len(index) + 1), (y[:, None] == classes).astype(np.float64)

    x, target = matrix(train)
    w, m, v = (np.zeros((target.shape[1], x.cols)) for _ in range(3))
    for step in range(1, 151):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.gathered(p - target) / x.rows + 2e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    x, target = matrix(held)
    z, scale = x.times(w), np.tile([1.0, 0.0], (target.shape[1], 1))
    for f, t in enumerate(target.T):
        t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))  # Platt's targets
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(scale[f, 0] * z[:, f] + scale[f, 1], -40, 40)))
            scale[f] -= 0.3 * np.array([((p - t) * z[:, f]).mean() / (z[:, f] ** 2).mean(), (p - t).mean()])
    words = np.array([([_PLACE[x] for x in g.split()] + [len(_PLACE)] * 3)[:3] for g in index])
    return LicenceModel(index, w, scale, words)


def sure_of(p: np.ndarray) -> np.ndarray:
    """The families that suffice, out of all classes' probabilities."""
    return np.flatnonzero((p[:-1] >= SURE) & (p[:-1] >= p[-1]))


def aligned(words: list[str], family: str, at_least: float = 0.0, longest: bool = False) -> tuple[float, int, int]:
    """The largest share of one of the family's templates that the paragraph has in order and close together, above ``at_least``; the first word there, and the one after the last.

    With ``longest``, that of the longest template which has such a share: a short one may be a part of it.
    """
    best, found, of = at_least, (0, 0), []
    for t in sorted(_TEMPLATE_WORDS[family], key=len, reverse=True):
        wanted, span = set(t), 2 * len(t)
        at = [i for i, w in enumerate(words) if w in wanted]
        hi = 0
        for k, lo in enumerate(at):  # a window of twice the template starts at each of its words
            while hi < len(at) and at[hi] < lo + span:
                hi += 1
            if hi - k <= best * len(t):  # it has too few of them
                continue
            got = lcs(t, words[lo : lo + span]) / len(t)
            if got > best:
                best, found, of = got, (lo, min(at[hi - 1] + 1, lo + span)), t
                if best == 1:
                    break
        if best == 1 or (longest and of):
            break
    if not of:
        return 0.0, 0, 0
    lo, hi = found  # without words that add nothing at its ends
    while hi - lo > 1 and lcs(of, words[lo : hi - 1]) / len(of) >= best:
        hi -= 1
    while hi - lo > 1 and lcs(of, words[lo + 1 : hi]) / len(of) >= best:
        lo += 1
    return best, lo, hi


def compare(words: list[str], family: str) -> float:
    """The largest share of one of the family's templates that the paragraph has in order and close together."""
    return aligned(words, family)[0]


def scan(text: str | None, model: LicenceModel, seen: dict) -> list[tuple[int, str, float, float, str, float]]:
    """(paragraph, family, probability, similarity, notice's text, probability of none) of each line, or stretch of lines, that has a licence.

    Every family that is sure enough is told. A notice wrapped over lines without an empty one between them is
    told once, at its first line, in place of its lines' own weaker rows of that family.
    """
    lines = (text or "").split("\n")
    words = [_WORD.findall(x.lower()) for x in lines]

    def judged(said: list[str]) -> np.ndarray:
        key = tuple(w if w in _KNOWN else "" for w in said)
        key = tuple(k for i, k in enumerate(key) if k or (i and key[i - 1]))
        if (p := seen.get(key)) is None:
            if len(seen) > 200_000:
                seen.clear()
            p = seen[key] = model.probabilities(said)
        return p

    rows: dict[tuple[int, str], tuple[float, float, str, float]] = {}
    for n, said in enumerate(words):
        if _KNOWN.isdisjoint(said):  # no gram of a template: the score of nothing, which is unknown
            continue
        p = judged(said)
        for f in sure_of(p):
            rows[n, FAMILIES[f]] = (float(p[f]), compare(said, FAMILIES[f]), lines[n], float(p[-1]))
    first = 0
    for end in [*(n for n, x in enumerate(lines) if not x.strip()), len(lines)]:
        if end - first > 1:
            can = model.possible(_KNOWN.intersection(w for n in range(first, end) for w in words[n]), seen)
            if can.any():
                _wrapped(range(first, end), lines, words, judged, rows, can)
        first = end + 1
    return [(n, f, *v) for (n, f), v in sorted(rows.items(), key=lambda r: (r[0][0], -r[1][0], r[0][1]))]


def _wrapped(block: range, lines: list[str], words: list[list[str]], judged, rows: dict[tuple[int, str], tuple[float, float, str, float]], can: np.ndarray) -> None:
    """Adds to ``rows`` the notices that go over lines of a block."""
    line = [n for n in block for _ in words[n]]
    said = [w for n in block for w in words[n]]
    have = set(said)
    for f, family in enumerate(FAMILIES):
        # words of which a template has enough in the block
        if can[f] and any(len(have.intersection(t)) >= CONFIRMS * len(set(t)) - (len(t) - len(set(t))) for t in _TEMPLATE_WORDS[family]):
            todo = [(0, len(said))]
            while todo:
                lo, hi = todo.pop()
                got, a, b = aligned(said[lo:hi], family, CONFIRMS - 1e-9, longest=True)
                if not got:
                    continue
                a, b = a + lo, b + lo
                todo += [(lo, a), (b, hi)]  # other notices before and after it
                span = range(line[a], line[b - 1] + 1)
                own = [n for n in span if (n, family) in rows]
                if len(span) == 1:
                    continue
                p = max((judged(said[a:b]), judged([w for n in span for w in words[n]])), key=lambda p: p[f])
                if f in sure_of(p):
                    for n in own:
                        del rows[n, family]
                    rows[span[0], family] = (float(p[f]), got, "\n".join(lines[n] for n in span), float(p[-1]))
    if not any((n, f) in rows for n in block for f in FAMILIES):  # sure as a whole alone: told at its best place
        p = judged(said) if not _KNOWN.isdisjoint(said) else np.zeros(len(FAMILIES) + 1)
        for f in sure_of(p):
            got, a, b = aligned(said, FAMILIES[f])
            if got:
                rows[line[a], FAMILIES[f]] = (float(p[f]), got, "\n".join(lines[n] for n in range(line[a], line[b - 1] + 1)), float(p[-1]))


def find_licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, paragraph, family, probability, unknown, similarity, confirmed, notice) for each paragraph with a licence.

    Paragraphs are lines, numbered from 0 as they stand, or the lines from there on that a wrapped notice takes; each
    family that suffices has a row. ``unknown`` is the probability of none of them, ``confirmed`` whether a template is
    there. All of a text's are judged, however long; those of no family are not returned. Null and empty texts have none,
    a null doc_id stays null, repeated rows count each, an empty table gives no rows, other columns are not read.
    """
    tuned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            found = [(i, *f) for i, t in enumerate(b.column("text").to_pylist()) for f in scan(t, model, seen)]
            ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.float64(), pa.float64()), 1)), pa.array([f[4] >= CONFIRMS for f in found], pa.bool_()), pa.array([f[5] for f in found], pa.string()), pa.array([f[6] for f in found], pa.float64())], ["doc_id", "paragraph", "family", "probability", "similarity", "confirmed", "notice", "unknown"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, paragraph long, family string, probability double, similarity double, confirmed boolean, notice string, unknown double")
