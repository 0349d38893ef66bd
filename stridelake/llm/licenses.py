"""License scans: a trained paragraph classifier, confirmed against templates.

A paragraph is a run of lines with words between blank lines. Each of its lines is judged by itself, for notices that stand on
one line among others, and so are its lines joined, for notices wrapped over many.

A multinomial logistic regression over word 1- to 3-grams, with L1 sparsity, tells licence families and `unknown` apart. It is
trained from the templates below, varied by dropped and added words, against paragraphs of the corpus (a bounded sample) and
near misses as `unknown`. A temperature calibrates its probabilities: it is set by a first model, on templates and paragraphs
that model has not seen; a second model learns from all.

A prediction is confirmed by template comparison: of all templates that share enough of their word pairs with the paragraph,
the one that shares most must be of the predicted family. Versions and variants of a licence are families of their own, so a
notice of a version that has no template shares as much with several families, and is not reported.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import fresh, one_text, with_field

#: Names by family (SPDX identifiers): fixed values. The Creative Commons families are made by rule below.
NAMES = {
    "MIT": ["MIT License"],
    "ISC": ["ISC License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License"],
    "GPL": ["GNU General Public License", "GNU GPL"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "EPL 2.0"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
}
#: SPDX identifiers that differ from the family's name: fixed values.
IDENTIFIERS = {f: [f"{f}-only", f"{f}-or-later", f] for f in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
#: Opening sentences of notices and licences: fixed values.
NOTICES = {
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
}
#: The grants of the GNU licences, by their name and version: fixed value.
GNU_GRANT = (
    "This {thing} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {version} of the License, or (at your option) any later version."
)
for _family, _name, _version, _thing in [
    ("GPL-2.0", "GNU General Public License", "2", "program"),
    ("GPL-3.0", "GNU General Public License", "3", "program"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"),
    ("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
]:
    NOTICES[_family] = [GNU_GRANT.format(thing=_thing, name=_name, version=_version)]
#: Creative Commons: each part of a licence's name, short and long, and the suites by version. Fixed values.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
CC_SETS = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
for _version, _scope in (("3.0", "Unported"), ("4.0", "International")):
    for _set in CC_SETS:
        _long = "-".join(CC_PARTS[p] for p in _set.split("-"))
        NAMES[f"CC-{_set}-{_version}"] = [f"CC {_set} {_version}", f"Creative Commons {_long} {_version} {_scope} License"]
#: How a short notice names a licence: fixed values.
FORMS = ["Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.", "This project is licensed under the terms of the {}.", "This work is licensed under a {}."]

#: Words that, after a `not`, deny a licence: fixed values.
GRANTING = frozenset(["licensed", "released", "distributed", "available", "covered"])

UNKNOWN = "unknown"
TEMPLATES = {
    family: [f.format(n) for n in names for f in FORMS] + [f"SPDX-License-Identifier: {i}" for i in IDENTIFIERS.get(family, [family])] + NOTICES.get(family, [])
    for family, names in NAMES.items()
}
FAMILIES = [UNKNOWN, *TEMPLATES]
#: Paragraphs that share words with licences and are none: fixed values.
NEAR_MISSES = [
    "He holds a driving license, version unknown, issued under the general rules of the state.",
    "The public may use the library free of charge without restriction.",
    "MIT researchers released a study under the direction of the institute.",
    "The Apache helicopter was licensed for export.",
    "A creative work of the commons, in the public interest.",
    "Fishing licences are granted to any person over sixteen.",
    "Permission to build was granted by the general assembly.",
    "Version 3 of the work was redistributed to the members.",
    "The new license fee was approved; licenses are issued by the ministry.",
    "Copyright law and public licenses are taught in the second year.",
]
#: Paragraphs of the corpus that stand for `unknown` in training, at most, and the share of them that a word of templates may be in and still count as distinctive.
TRAIN_PARAGRAPHS, COMMON = 4000, 0.01
MIN_PROBABILITY, MIN_AGREEMENT = 0.5, 0.6
WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def grams(found: list[str]) -> list[str]:
    return [" ".join(found[i : i + k]) for k in (1, 2, 3) for i in range(len(found) - k + 1)]


def _pairs(found: list[str]) -> set[tuple[str, str]]:
    return set(zip(found, found[1:], strict=False))


@cache
def _template_pairs() -> dict[str, list[set[tuple[str, str]]]]:
    return {family: [_pairs(words(t)) for t in templates] for family, templates in TEMPLATES.items()}


def agreements(found: list[str]) -> dict[str, tuple[int, float, frozenset]]:
    """By family, its best template that shares MIN_AGREEMENT of its word pairs with the paragraph: how many, which share, and which pairs."""
    own, out = _pairs(found), {}
    for family, templates in _template_pairs().items():
        scores = [(len(t & own), len(t & own) / len(t), frozenset(t & own)) for t in templates if len(t & own) >= MIN_AGREEMENT * len(t)]
        if scores:
            out[family] = max(scores, key=lambda s: s[:2])
    return out


@dataclass
class Model:
    """weights: of each n-gram, a weight for each family; only the n-grams with some weight. distinctive: words of the templates
    that ordinary paragraphs seldom have; a paragraph without any is no licence."""

    weights: dict[str, np.ndarray]
    bias: np.ndarray
    temperature: float
    distinctive: frozenset[str] = frozenset()

    def probabilities(self, found: list[str]) -> np.ndarray:
        seen = [self.weights[g] for g in set(grams(found)) if g in self.weights]
        logits = (self.bias + np.sum(seen, axis=0)) if seen else self.bias
        p = np.exp((logits - logits.max()) / self.temperature)
        return p / p.sum()

    def judge(self, paragraph: str) -> tuple[str, float, float, frozenset] | None:
        """Family, probability, agreement with its best template and the word pairs shared with it, if the paragraph is taken for a licence."""
        found = words(paragraph)
        if self.distinctive.isdisjoint(found) or any(a == "not" and b in GRANTING for a, b in zip(found, found[1:], strict=False)):
            return None
        p = self.probabilities(found)
        best = int(p.argmax())
        if best == 0 or p[best] < MIN_PROBABILITY:
            return None
        agree = agreements(found)
        own = agree.pop(FAMILIES[best], None)
        return (FAMILIES[best], float(p[best]), *own[1:]) if own and all(own[:2] > other[:2] for other in agree.values()) else None


def _varied(rng: np.random.Generator, text: str, filler: list[str]) -> list[str]:
    """The words of a notice with some dropped, and others of the corpus before and after."""
    kept = [w for w in words(text) if rng.random() > 0.04]
    around = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 30))] if filler else []
    return around() + kept + around()


@dataclass
class _Examples:
    """Feature rows and labels over a fixed index of n-grams."""

    index: dict[str, int]
    x: np.ndarray
    y: np.ndarray

    @classmethod
    def of(cls, examples: list[tuple[list[str], int]], index: dict[str, int]) -> _Examples:
        x = np.zeros((len(examples), len(index)), dtype=np.float32)
        for row, (found, _) in enumerate(examples):
            x[row, [index[g] for g in set(grams(found)) if g in index]] = 1
        return cls(index, x, np.array([y for _, y in examples], dtype=np.int64))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(data: _Examples, rounds: int, rate: float, l1: float) -> tuple[np.ndarray, np.ndarray]:
    """Proximal gradient descent on the multinomial log loss, each family weighing alike."""
    classes = len(FAMILIES)
    share = np.bincount(data.y, minlength=classes).astype(np.float32)
    balance = (1 / np.maximum(share, 1))[data.y][:, None] / classes
    onehot = np.eye(classes, dtype=np.float32)[data.y]
    w, b = np.zeros((len(data.index), classes), dtype=np.float32), np.zeros(classes, dtype=np.float32)
    for _ in range(rounds):
        off = (_softmax(data.x @ w + b) - onehot) * balance
        w -= rate * (data.x.T @ off)
        b -= rate * off.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    return w, b


def train(paragraphs: list[str], copies: int = 8, rounds: int = 80, rate: float = 6.0, l1: float = 2e-5, seed: int = 0) -> Model:
    """The model, from ordinary paragraphs and the templates. Every fourth template of a family and every fourth paragraph are
    held out of a first fit and set the temperature; the second fit has them all."""
    rng = np.random.default_rng(seed)
    ordinary = [w for w in (words(p) for p in paragraphs) if w and not agreements(w)]
    filler = [w for p in ordinary[:500] for w in p[:20]]
    known = {g for t in [*sum(TEMPLATES.values(), []), *NEAR_MISSES] for g in grams(words(t))}
    index = {g: i for i, g in enumerate(sorted(known))}
    varied = [(_varied(rng, t, filler), y, i % 4 == 3) for y, family in enumerate(FAMILIES) if y for i, t in enumerate(TEMPLATES[family]) for _ in range(copies)]
    varied += [(w, 0, i % 4 == 3) for i, w in enumerate(ordinary)] + [(_varied(rng, t, filler), 0, i % 4 == 3) for i, t in enumerate(NEAR_MISSES) for _ in range(copies)] + [([], 0, False)]
    held = _Examples.of([(w, y) for w, y, apart in varied if apart], index)
    first = _fit(_Examples.of([(w, y) for w, y, apart in varied if not apart], index), rounds, rate, l1)
    logits, at = held.x @ first[0] + first[1], np.arange(len(held.y))
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[at, held.y], 1e-9)).mean()
    temperature = min(np.geomspace(0.1, 4, 30), key=loss)
    w, b = _fit(_Examples.of([(w, y) for w, y, _ in varied], index), rounds, rate, l1)
    counts: dict[str, int] = defaultdict(int)
    for p in ordinary:
        for word in set(p):
            counts[word] += 1
    distinctive = frozenset(x for t in sum(TEMPLATES.values(), []) for x in words(t) if counts[x] <= COMMON * len(ordinary))
    return Model({g: w[i] for g, i in index.items() if np.abs(w[i]).max() > 0}, b, float(temperature), distinctive)


def sample_paragraphs(docs: DataFrame, rows: int = TRAIN_PARAGRAPHS) -> list[str]:
    """At most `rows` lines (up to 2000 characters of each, for the training alone) of the documents with the least hashes: of at
    most `rows` / 4 of them (one text an id), those lines with the least hashes."""
    some = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(rows // 4).select("doc_id")
    lines = one_text(docs, some).select(F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select(F.substring("line", 1, 2000).alias("line")).filter("trim(line) <> ''").distinct()
    return [r["line"] for r in lines.orderBy(F.xxhash64("line"), "line").limit(rows).collect()]


LICENSES = "array<struct<paragraph:int,line:int,lines:int,family:string,probability:double,agreement:double>>"


def paragraphs_of(text: str) -> Iterator[tuple[int, list[str]]]:
    """The number of the first line, and the lines, of each paragraph."""
    own: list[str] = []
    for at, line in enumerate(text.split("\n")):
        if line.strip():
            own.append(line)
        elif own:
            yield at - len(own), own
            own = []
    if own:
        yield text.count("\n") + 1 - len(own), own


def judged(model: Model, text: str) -> tuple[int, list[dict]]:
    """How many paragraphs a text has, and the licences in them, in order: of lines that are notices by themselves, and of whole
    paragraphs that are. A line that is but a part of the paragraph's notice is not told, nor a paragraph whose family a line of its own has."""
    n, found = 0, []
    searched = not model.distinctive.isdisjoint(words(text))
    for first, lines in paragraphs_of(text):
        if searched:
            units = [(first + i, 1, got) for i, line in enumerate(lines) if (got := model.judge(line))]
            whole = model.judge(" ".join(lines)) if len(lines) > 1 else None
            if whole and whole[0] not in {u[2][0] for u in units}:
                units = [*(u for u in units if not u[2][3] <= whole[3]), (first, len(lines), whole)]
            found += [{"paragraph": n, "line": at, "lines": many, "family": g[0], "probability": g[1], "agreement": g[2]} for at, many, g in units]
        n += 1
    return n, found


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns (n_paragraphs, licenses; underscores where docs has these): the number of its paragraphs, and the
    licences found, with the place of their lines.

    Null, empty and blank texts have no paragraphs. Repeated rows each give a row. An empty table gives none."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    text, names = docs.columns.index("text"), fresh(docs, "n_paragraphs", "licenses")
    number = [("paragraph", pa.int32()), ("line", pa.int32()), ("lines", pa.int32())]
    kind = pa.list_(pa.struct([*number, ("family", pa.string()), ("probability", pa.float64()), ("agreement", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judged(held.value, t.as_py() or "") for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([n for n, _ in found], pa.int64()), pa.array([x for _, x in found], kind)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(find, with_field(docs.schema, (names[0], "long"), (names[1], LICENSES)))


def license_scan(docs: DataFrame) -> DataFrame:
    """Train on a bounded sample and scan all of docs: doc_id, n_paragraphs, n_license_paragraphs, families (sorted, distinct,
    comma-joined; empty if none) and licenses."""
    out = scan(docs.select(F.col("doc_id").cast("long"), "text"), train(sample_paragraphs(docs)))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"]))), ",")
    many = F.size(F.array_distinct(F.transform("licenses", lambda x: x["paragraph"]))).cast("long")
    return out.select("doc_id", "n_paragraphs", many.alias("n_license_paragraphs"), families.alias("families"), "licenses")
