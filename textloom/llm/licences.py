"""Licence scan: a paragraph classifier over sparse word n-grams, confirmed against templates.

A logistic regression over single words and word pairs (present or not) is fitted here, on notices written from the
templates below, on notices of other licences and on ordinary paragraphs, to a class for each licence family and one for unknown.
A temperature calibrates its probabilities: it is fitted on templates and on licences that the model which it is fitted with has not seen.
Scoring looks a paragraph's n-grams up in the table of weights and adds them; weights are whole numbers, so a sum is the same in any order.

A paragraph is a notice of a family if the model says so and at least half of the word triples of a template of that family stand in it.
So every notice holds a template's triple, and only paragraphs that do are scored: nothing that could be confirmed is left out.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Least calibrated probability of a family, and least share of a template's word triples that the paragraph must hold.
MIN_PROBABILITY, MIN_TEMPLATE = 0.5, 0.5
SCALE = 10_000
SEED, VARIANTS, NEGATIVES, STEPS = 7, 24, 700, 300
TEMPERATURES = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8)
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0", "released under the apache license", "distributed under the apache 2.0 license", "spdx license identifier apache 2.0", "distributed under apache 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2.0",
    ),
    "mit": (
        "released under the mit license", "licensed under the mit license", "distributed under the terms of the mit license", "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "licensed under the bsd license", "released under the 3 clause bsd license", "spdx license identifier bsd 3 clause", "use of this source code is governed by a bsd style license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl", "released under the gpl version 2 license", "spdx license identifier gpl 3.0", "released under gpl 3.0", "licensed under gpl v3",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "lgpl": ("licensed under the gnu lesser general public license", "released under the lgpl license", "under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2.1"),
    "agpl": ("licensed under the gnu affero general public license", "released under the agpl license", "under the terms of the gnu affero general public license", "spdx license identifier agpl 3.0"),
    "mpl": ("licensed under the mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license", "released under the mpl 2.0 license", "spdx license identifier mpl 2.0"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the cc by 4.0 license", "licensed under the creative commons attribution license"),
    "cc-by-sa": ("licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "available under the cc by sa 4.0 license", "licensed under the creative commons attribution share alike license"),
    "cc-by-nc": ("licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "available under the cc by nc 4.0 license", "licensed under the creative commons attribution non commercial license"),
    "cc-by-nd": ("licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", "available under the cc by nd 4.0 license"),
    "public-domain": ("released under cc0 1.0 universal license", "dedicated to the public domain under cc0", "this is free and unencumbered software released into the public domain", "this work is in the public domain"),
    "isc": ("licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part of this publication may be reproduced", "unauthorized copying of this file is strictly prohibited all rights reserved"),
}
#: Licences outside the families: unknown, like ordinary text. The second row is kept from the model that the temperature is fitted with.
OTHERS = (
    (
        "licensed under the eclipse public license version 2.0", "distributed under the boost software license version 1.0", "licensed under the artistic license 2.0", "licensed under the sil open font license version 1.1",
        "licensed under the european union public licence version 1.2", "made available under the open database license", "licensed under the microsoft public license", "this software is provided as is without any express or implied warranty",
    ),
    (
        "licensed under the common development and distribution license version 1.0", "released under the academic free license version 3.0", "distributed under the python software foundation license", "licensed under the universal permissive license",
        "licensed under the open software license 3.0", "released under the mulan permissive software license", "available under the zope public license", "subject to the q public license version 1.0",
    ),
)
#: Words of ordinary paragraphs, among them those that notices share.
_COMMON = (
    "the of and to a in is that for it as was with be by on not he this are or his from at which but have an had they you were there one all we can more when who will would if so said what "
    "up its about into than them only some could time these two may then do first any my now such like our over even most made after also did many must before back see through way where get much go "
    "good new write know year work free use copy terms version public general software source law school driver driving fishing marriage plate office house music book page permission slip copyright "
    "dispute debate act license licence licensed licensing fee renew expired copy copied modified part right rights domain name library commons house creative writing attribution error"
).split()


def _tokens(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def _grams(words: list[str]) -> set[str]:
    return set(words) | {" ".join(p) for p in zip(words, words[1:], strict=False)}


def _triples(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}) if words else []


@functools.cache
def anchors() -> tuple[str, ...]:
    """Words of which every paragraph that can be confirmed holds one.

    They are taken from the templates until in each the word triples without any of them are fewer than a confirmation needs. The commonest
    words come last, then those in more triples come first; the order only decides how many paragraphs are scored.
    """
    held = [[set(t.split()) for t in _triples(_tokens(x))] for family in TEMPLATES.values() for x in family]
    chosen: list[str] = []
    while open_ := [rest for t in held if len(rest := [g for g in t if not g & set(chosen)]) >= MIN_TEMPLATE * len(t)]:
        gain = {w: sum(w in g for rest in open_ for g in rest) for rest in open_ for g in rest for w in g}
        chosen.append(min(gain, key=lambda w: (w in _COMMON[: _COMMON.index("good")] or w.isdigit(), w in ("under", "without"), w in _COMMON and not w.startswith("licens"), -gain[w], w)))
    return tuple(chosen)


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@functools.cache
def train() -> tuple[tuple[str, ...], dict[str, tuple[int, ...]], tuple[int, ...], float]:
    """(classes, weights by n-gram, intercepts, temperature); the same on every call.

    The second template of each family and the second row of ``OTHERS`` are kept from a first model, whose probabilities of them fit the
    temperature; the model itself sees all.
    """
    rng = np.random.default_rng(SEED)
    classes = (*sorted(TEMPLATES), UNKNOWN)
    filler = lambda n: [str(w) for w in rng.choice(_COMMON, n)]

    def written_from(template: str) -> list[list[str]]:
        words = _tokens(template)
        out = [words]
        for _ in range(VARIANTS):
            drop = int(rng.integers(0, len(words))) if len(words) > 8 and rng.integers(0, 2) else -1
            out.append(filler(int(rng.integers(0, 12))) + [w for i, w in enumerate(words) if i != drop] + filler(int(rng.integers(0, 12))))
        return out

    rows: list[tuple[list[str], int, bool]] = []  # words, class, whether kept from the first model
    for k, family in enumerate(classes[:-1]):
        last = len(TEMPLATES[family]) - 1
        rows += [(words, k, i == min(1, last) > 0) for i, template in enumerate(TEMPLATES[family]) for words in written_from(template)]
    rows += [(words, len(classes) - 1, bool(i)) for i, others in enumerate(OTHERS) for other in others for words in written_from(other)]
    rows += [(filler(int(rng.integers(1, 60))), len(classes) - 1, i % 5 == 0) for i in range(NEGATIVES)]
    vocab = sorted({g for texts in (*TEMPLATES.values(), *OTHERS) for t in texts for g in _grams(_tokens(t))})
    place = {g: i for i, g in enumerate(vocab)}
    x = np.zeros((len(rows), len(vocab)), np.float32)
    for i, (words, _, _) in enumerate(rows):
        x[i, [place[g] for g in _grams(words) if g in place]] = 1
    y = np.eye(len(classes), dtype=np.float32)[[k for _, k, _ in rows]]
    held = np.array([h for _, _, h in rows])

    def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((len(vocab), len(classes)), np.float32), np.zeros(len(classes), np.float32)
        for _ in range(STEPS):
            error = (_soft(x @ w + b) - y) / len(x)
            w -= 4.0 * (x.T @ error + 2e-5 * w)
            b -= 4.0 * error.sum(0)
        return np.round(w * SCALE).astype(int), np.round(b * SCALE).astype(int)

    w, b = fit(x[~held], y[~held])
    z = (x[held] @ w + b) / SCALE
    loss = {t: -np.log((_soft(z / t) * y[held]).sum(1) + 1e-12).mean() for t in TEMPERATURES}
    w, b = fit(x, y)
    return classes, {g: tuple(int(v) for v in w[i]) for g, i in place.items()}, tuple(int(v) for v in b), min(loss, key=loss.get)


def classify(words: list[str]) -> tuple[str, float]:
    """Family or unknown, and its probability, of one paragraph; what ``scan`` computes, in Python."""
    classes, weights, intercepts, temperature = train()
    z = (np.array(intercepts) + sum((np.array(weights[g]) for g in _grams(words) if g in weights), np.zeros(len(classes), int))) / (SCALE * temperature)
    return classes[int(z.argmax())], float(_soft(z[None, :]).max())


def _constant(values) -> Column:
    """An array of strings that the optimizer folds to one literal."""
    return F.split(F.lit("|".join(values)), r"\|")


def paragraphs(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, block, wide, paragraph, words): lines that hold a template's triple, and such blocks of non-blank lines.

    paragraph is the line's number, or that of the block's first line; wide marks blocks, of which those of one line are left out.
    """
    anchor = F.lit(rf"(?i)(?<![a-z0-9])(?:{'|'.join(anchors())})(?![a-z0-9])")
    hit = lambda x: F.rlike(x, anchor)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    # A blank line ends a piece and isn't part of it.
    pieces = docs.filter(hit(F.col("text"))).select(F.col("doc_id").cast("long"), F.split("text", r"(?:^|(?<=\n))[ \t\r\f\x0B]*\n").alias("pieces"))
    numbered = F.filter(F.transform("pieces", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: hit(s["x"]))
    start = lambda s: F.aggregate(F.slice("pieces", 1, s["i"]), F.lit(0), lambda acc, x: acc + newlines(x) + 1)
    blocks = pieces.select("doc_id", F.explode(F.transform(numbered, lambda s: F.struct(start(s).alias("start"), F.rtrim(s["x"], F.lit(" \t\r\n\f")).alias("x")))).alias("b"))
    # Identifies a block between here and the end of the scan; it isn't evaluated twice.
    blocks = blocks.select("doc_id", F.monotonically_increasing_id().alias("block"), "b.start", "b.x")
    lines = F.transform(F.split("x", "\n"), lambda x, i: F.struct(F.lit(False).alias("wide"), (F.col("start") + i).alias("paragraph"), x.alias("line")))
    whole = F.filter(F.array(F.struct(F.lit(True).alias("wide"), F.col("start").alias("paragraph"), F.col("x").alias("line"))), lambda s: F.contains(s["line"], F.lit("\n")))
    words = lambda s: F.regexp_extract_all(F.lower(s["line"]), F.lit("[a-z0-9]+"), F.lit(0))
    read = F.transform(F.filter(F.concat(lines, whole), lambda s: hit(s["line"])), lambda s: F.struct(s["wide"].alias("wide"), s["paragraph"].alias("paragraph"), words(s).alias("words")))
    known = _constant(sorted({t for family in TEMPLATES.values() for x in family for t in _triples(_tokens(x))}))
    # What holds no template's triple can't be confirmed. Words are explicit here, so that nothing below this row is computed again for each of them.
    chosen = F.filter(read, lambda s: F.arrays_overlap(_runs(s["words"], 3), known))
    return blocks.select("doc_id", "block", F.explode(chosen).alias("p")).select("doc_id", "block", "p.wide", "p.paragraph", "p.words")


def _runs(words: Column, n: int) -> Column:
    """All runs of n words; all words together where they are fewer."""
    run = lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(n)])
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), run)).otherwise(F.array(F.concat_ws(" ", words)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, paragraph, family, probability, template_share): one row for each line (from 0) that is a confirmed licence notice.

    A notice wrapped over lines is one row, with the first line of its block of non-blank lines: a block counts if it's confirmed
    for a family that none of its lines is confirmed for.

    Null and empty texts have no lines. Every row is scanned, repeated rows and rows without doc_id too. Lines of any length are taken whole.
    """
    classes, weights, intercepts, temperature = train()
    found = paragraphs(docs)
    # array_intersect gives each n-gram once.
    grams = F.array_intersect(F.concat("words", _runs(F.col("words"), 2)), _constant(weights))
    table = F.str_to_map(F.lit("|".join(f"{g}:{' '.join(map(str, w))}" for g, w in weights.items())), F.lit(r"\|"), F.lit(":"))
    numbers = lambda text: F.split(text, " ").cast("array<int>")
    add = lambda acc, g: F.zip_with(acc, numbers(F.element_at(table, g)), lambda a, b: a + b)
    sums = F.aggregate(grams, numbers(F.lit(" ".join(map(str, intercepts)))), add)
    likely = lambda z, top: F.struct(F.array_position(z, top).cast("int").alias("best"), (1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))).alias("probability"))
    verdict = _let(sums, lambda s: _let(F.transform(s, lambda v: v / (SCALE * temperature)), lambda z: _let(F.array_max(z), lambda top: likely(z, top))))
    # An explode of one row, over which no filter is pushed down: the sums are computed once.
    scored = found.select("*", F.explode(F.array(verdict)).alias("verdict")).select("*", "verdict.*")
    named = scored.filter((F.col("best") < len(classes)) & (F.col("probability") >= MIN_PROBABILITY))
    # Only the templates of the family that the model names are compared.
    templates = F.element_at(_constant(["/".join(",".join(_triples(_tokens(x))) for x in TEMPLATES[f]) for f in classes[:-1]]), F.col("best"))
    held = lambda t, have: F.size(F.array_intersect(F.split(t, ","), have)) / F.size(F.split(t, ","))
    share = _let(_runs(F.col("words"), 3), lambda have: F.array_max(F.transform(F.split(templates, "/"), lambda t: held(t, have))))
    family = F.element_at(_constant(classes), F.col("best"))
    sure = named.select("doc_id", "block", "wide", "paragraph", family.alias("family"), "probability", share.alias("share"))
    sure = sure.filter(F.col("share") >= MIN_TEMPLATE)
    in_line = F.min("wide").over(Window.partitionBy("block", "family"))
    return sure.withColumn("least", in_line).filter("wide = least").select(
        "doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("share", 6).alias("template_share")
    )
