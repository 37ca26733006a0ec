"""Licence scan with a trained paragraph classifier; scanning uses DataFrame functions only.

Paragraphs are classified by multinomial logistic regression over sparse word n-grams.  It is trained on the driver from
the templates below, varied by a rule, against other versions of the same licences, sentences about rights and bags of the same
words that name no licence; a temperature fitted on examples kept apart calibrates the probabilities, `unknown` among
them.  A prediction is confirmed where the paragraph holds enough of the bigrams of a whole notice or sentence of its
family, and where the versions that it names are the family's.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ascii_lower, durable

UNKNOWN = "unknown"

# Names by which notices call each family.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "GNU Affero General Public License v3.0", "AGPL-3.0", "Affero General Public License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License", "Apache License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause", "Modified BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0", "Creative Commons Attribution Non-Commercial License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0", "Creative Commons Attribution Share Alike License"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero", "CC0 Public Domain Dedication"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GNU General Public License v2.0", "GPL v2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GNU General Public License v3.0", "GPL v3", "GPL-3.0", "GPLv3"),
    "ISC": ("ISC License", "ISC licence"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "GNU Lesser General Public License v3.0", "LGPL-3.0", "Lesser General Public License"),
    "MIT": ("MIT License", "MIT licence", "Expat License", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
# Versions that a family's notices may name; others are another licence.  Families without any have one version.
VERSIONS = {
    "AGPL-3.0": ("3", "3.0"), "Apache-2.0": ("2", "2.0"), "CC-BY-4.0": ("4", "4.0"), "CC-BY-NC-4.0": ("4", "4.0"), "CC-BY-SA-4.0": ("4", "4.0"), "CC0-1.0": ("1", "1.0"),
    "GPL-2.0": ("2", "2.0"), "GPL-3.0": ("3", "3.0"), "LGPL-2.1": ("2.1",), "LGPL-3.0": ("3", "3.0"), "MPL-2.0": ("2", "2.0"),
}
# Sentences of the licences themselves and of their usual notices.
TEXTS = {
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ),
    "Apache-2.0": (
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions.",
        "This License does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following two conditions are met: redistributions must reproduce the above copyright notice.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following three conditions are met.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.",
        "This work is released under the CC0 1.0 Universal Public Domain Dedication, http://creativecommons.org/publicdomain/zero/1.0/",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This file is free software; you can redistribute it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions.',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
        "For more information, please refer to http://unlicense.org/",
    ),
}
# Names of versions that are none of the families, and sentences of licences that leave the family or its version open.
OTHERS = (
    "Apache License, Version 1.1", "Apache License, Version 1.0", "Apache Software License 1.1", "GNU General Public License, version 1", "GPL-1.0", "GNU Lesser General Public License, version 2", "GNU Library General Public License, version 2", "GNU Free Documentation License, version 1.3",
    "Mozilla Public License, version 1.1", "Mozilla Public License 1.0", "MPL 1.1", "CC BY 3.0", "CC BY 2.0", "CC BY-SA 3.0", "CC BY-SA 2.5", "CC BY-NC 3.0", "CC BY-NC-ND 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution 3.0 Unported License",
    "Creative Commons Attribution-ShareAlike 3.0 Unported License", "Creative Commons Attribution-NoDerivatives 4.0 International License", "BSD 4-Clause License", "Eclipse Public License 2.0", "Artistic License 2.0", "Boost Software License 1.0", "Microsoft Public License", "Common Development and Distribution License 1.0",
)
OPEN = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "This product includes software developed by the Apache Software Foundation (http://www.apache.org/).",
    "You should have received a copy of the GNU General Public License along with this program; if not, see http://www.gnu.org/licenses/.",
    "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see http://www.gnu.org/licenses/.",
    "See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.",
)
# How notices begin, and sentences about rights that name no family.
OPENINGS = ("Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This software is licensed under the {}.", "This project is available under the terms of the {}.", "License: {}", "SPDX-License-Identifier: {}", "Code is released under {}.", "Published under {}")
NEGATIVES = (
    "All rights reserved.", "Copyright by the author. All rights reserved.", "No part of this work may be reproduced without permission of the publisher.", "Reprinted with permission.",
    "He lost his driving license.", "A fishing license is required in this area.", "The software requires a commercial license agreement.", "You need permission to enter the building.",
    "The warranty covers parts and labour for two years.", "The general public was not admitted.", "The Apache people live in the southwest.", "She studied at MIT before joining the company.",
    "The helicopter was an Apache.", "Creative people have little in common.", "Version 2.0 was released yesterday.", "The license expired and was revoked by the board.", "Licensed under the Acme Proprietary License.",
    "This product is licensed, not sold.", "The foundation published free software for the public.", "The commons were open to the public.", "Mozilla was founded in California.", "The law permits redistribution of land.",
)
# Words of which every feature holds one at least.  A paragraph without any has no features, so the classifier
# has nothing but its bias to say about it, `unknown`: looking only at paragraphs with such words changes no result.
ANCHORS = ("affero", "agpl", "apache", "bsd", "cc", "cc0", "commons", "contributor", "contributors", "copyleft", "copyright", "creative", "derivative", "endorse", "expat", "freebsd", "gnu", "gpl", "gplv2", "gplv3", "irrevocable", "isc", "lgpl", "licence", "license", "licensed", "licenses", "licensor", "merchantability", "mit", "mozilla", "mpl", "noninfringement", "permission", "redistribute", "redistributed", "redistribution", "redistributions", "royalty", "spdx", "sublicense", "unencumbered", "unlicense", "version", "warranties", "warranty")

_WORD = re.compile(r"[a-z0-9]+")
#: Words of the longest feature.
GRAMS = 4
#: The share of a template's bigrams that a paragraph must hold to confirm a prediction.
CONFIRM = 0.8
#: Bigrams of a template: one with fewer is a bare name, and confirms only a paragraph that says nothing else.
BARE = 4
#: Lines of this many characters that do not end a sentence are hard-wrapped: they go on in the next line.
WRAPPED = (45, 100)
#: How notices name versions, in lower-case text.
VERSION = r"(?:version|licen[cs]e|universal|public|cc0|mpl|gpl|apache|cc[- ]by(?:-[a-z]{2})*|by(?:-[a-z]{2})*|attribution|noncommercial|sharealike|\bv)[\s,./:(-]*v?\.?\s?([0-9](?:\.[0-9])?)(?![0-9])"


def words(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def grams(w: list[str], n: int = GRAMS) -> set[str]:
    out = {" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)}
    return {g for g in out if not set(g.split()).isdisjoint(ANCHORS)}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # unknown last
    features: tuple[str, ...]
    weights: np.ndarray  # features by families
    bias: np.ndarray
    accept: float  # least probability of a family


def examples(seed: int) -> list[tuple[str, list[str]]]:
    """Templates varied by rule: notices with a lost word or a clause around them, parts of texts, bags of words as unknown."""
    rng, out = random.Random(seed), []
    spare = ["this", "the", "of", "work", "see", "file", "for", "details", "project", "documentation", "page", "and", "its"]
    for family, names in NAMES.items():
        for name in names:
            for opening in OPENINGS:
                w = words(opening.format(name))
                out.append((family, w))
                out.append((family, rng.sample(spare, rng.randint(1, 4)) + w + rng.sample(spare, rng.randint(0, 6))))
        for text in TEXTS[family]:
            w = words(text)
            for _ in range(12):
                i = rng.randint(0, max(0, len(w) // 3))
                part = [x for x in w[i : i + rng.randint(max(6, len(w) // 2), len(w))] if rng.random() > 0.04]
                told = family not in VERSIONS or any(x.isdigit() for x in part) or not any(x.isdigit() for x in w)
                out.append((family if told else UNKNOWN, part))  # a part that has lost its version is of no family
            out += [(family, w)] * 4
    for name in OTHERS:
        for opening in OPENINGS:
            out += [(UNKNOWN, words(opening.format(name))), (UNKNOWN, rng.sample(spare, 3) + words(opening.format(name)) + rng.sample(spare, rng.randint(0, 6)))]
    for text in OPEN:
        w = words(text)
        out += [(UNKNOWN, w)] * 3 + [(UNKNOWN, [x for x in w if rng.random() > 0.04]) for _ in range(6)]
    pool = sorted({x for t in (*NEGATIVES, *(s for ts in TEXTS.values() for s in ts)) for x in words(t)})
    anchors = [a for a in ANCHORS if a in pool]
    for text in NEGATIVES:
        w = words(text)
        out += [(UNKNOWN, w), *((UNKNOWN, rng.sample(spare, 3) + w + rng.sample(spare, rng.randint(0, 8))) for _ in range(5))]
    out += [(UNKNOWN, rng.sample(pool, rng.randint(4, 30)) + [rng.choice(anchors)]) for _ in range(600)]
    out += [(UNKNOWN, rng.sample(spare, 5))] * 20
    rng.shuffle(out)
    return out


def _matrix(rows: list[tuple[str, list[str]]], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(place)), dtype=np.float32)
    for i, (_, w) in enumerate(rows):
        x[i, [place[g] for g in grams(w) if g in place]] = 1
    return x


@lru_cache(maxsize=2)
def train(seed: int = 3, rounds: int = 120, most: int = 8000) -> Model:
    """Fit the classifier on the templates; a fifth of the examples only sets temperature and acceptance."""
    rows = examples(seed)
    cut = len(rows) * 4 // 5
    families = (*sorted(NAMES), UNKNOWN)
    counts: dict[str, int] = {}
    for _, w in rows[:cut]:
        for g in grams(w):
            counts[g] = counts.get(g, 0) + 1
    vocab = tuple(sorted(sorted(counts, key=lambda g: (-counts[g], g))[:most]))
    place = {g: i for i, g in enumerate(vocab)}
    y = np.array([families.index(f) for f, _ in rows])
    x, target = _matrix(rows[:cut], place), np.eye(len(families), dtype=np.float32)[y[:cut]]
    w, b = np.zeros((len(vocab), len(families)), np.float32), np.zeros(len(families), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target) / len(x)
        g = x.T @ e + 2e-5 * np.sign(w) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 2.0 * e.sum(axis=0)
    w[np.abs(w) < 0.01] = 0
    held = _matrix(rows[cut:], place) @ w + b

    def probability(temperature: float) -> np.ndarray:
        z = held / temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(probability(t)[np.arange(len(held)), y[cut:]] + 1e-9).mean()
    t = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    p = probability(t)
    strange = p[y[cut:] == len(families) - 1][:, :-1].max(axis=1)
    accept = float(min(0.9, max(0.5, np.quantile(strange, 0.99))))
    return Model(families, vocab, w / t, b / t, accept)


def _grams(w: Column, n: int) -> Column:
    """Runs of n words of the array w."""
    if n == 1:
        return w
    run = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return F.when(F.size(w) >= n, run).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, confirm: float = CONFIRM) -> DataFrame:
    """One row per row of docs: id, n_paragraphs, n_candidates, `licences` and the best of them.

    Paragraphs are lines; hard-wrapped ones (WRAPPED) are joined with the next.  n_candidates: paragraphs with a word that
    features hold.  licences: an array of paragraph, family, probability, similarity, confirmed for every paragraph
    whose most likely family is at least as likely as the model accepts.  licence, probability and confirmed repeat the
    first confirmed one, else the most likely; they are `unknown`, the likeliest family's probability and false where
    no paragraph is accepted, and null where there is no paragraph.  similarity: the greatest share of a template's bigrams that the paragraph
    holds; bare names count by what they share of both.  A paragraph that names no version, or another than the
    family's, is never confirmed, unless the family has but one.

    Null and empty texts: no paragraphs.  Null ids and repeated rows: a row each.  Paragraphs of any length are read
    whole.  Empty table: no rows.  Other columns are not read.  Model and templates are of fixed size, so they are sent
    to every executor; a document's hits are few and are counted where its n-grams are.
    """
    spark = docs.sparkSession
    model = model or train()
    low = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    anchor = r"(?<![a-z0-9])(?:" + "|".join(sorted(ANCHORS, key=len, reverse=True)) + r")(?![a-z0-9])"
    wrapped = r"(?m)^([^\n]{%d,%d})(?<![.!?:])\r?\n(?=[^\s])" % WRAPPED
    lines = F.filter(F.split(F.col("low"), "\n"), lambda x: F.trim(x) != "")
    lines = F.transform(lines, lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.regexp_replace(low, wrapped, "$1 ").alias("low"))
    rows = rows.select("id", "row", F.regexp_count("low", F.lit(r"(?m)^[^\n]*[^\s\x00-\x20][^\n]*$")).cast("long").alias("n_paragraphs"), F.when(F.col("low").rlike(anchor), F.filter(lines, lambda x: x["text"].rlike(anchor))).alias("candidates"))
    rows = durable(rows, "licence-candidates")

    c = rows.select("row", F.explode("candidates").alias("c")).select("row", "c.paragraph", F.regexp_extract_all("c.text", F.lit("([a-z0-9]+)"), F.lit(1)).alias("w"), F.regexp_extract_all("c.text", F.lit(VERSION), F.lit(1)).alias("versions"))
    families = list(model.families)
    table = _table(spark, model)
    every = F.array_distinct(F.concat(*[_grams(F.col("w"), n) for n in range(1, GRAMS + 1)]))
    hits = c.select("row", "paragraph", F.explode(every).alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy("row", "paragraph").agg(F.array(*[F.sum(F.col("w")[i]) for i in range(len(families))]).alias("z"))
    bias = F.array(*[F.lit(float(x)) for x in model.bias])
    names = F.array(*[F.lit(f) for f in families])
    z = sums.select("row", "paragraph", F.zip_with("z", bias, lambda x, y: x + y).alias("z"))
    z = z.select("row", "paragraph", "z", F.array_max("z").alias("top"))
    z = z.select("row", "paragraph", F.transform("z", lambda x: F.exp(x - F.col("top"))).alias("e"))
    share = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(F.slice(F.zip_with("e", names, lambda e, f: F.struct(e.alias("e"), f.alias("family"))), 1, len(families) - 1))
    z = z.select("row", "paragraph", best.alias("best"), share.alias("share"))
    z = durable(z.select("row", "paragraph", (F.col("best.e") / F.col("share")).alias("p"), "best.family"), "licence-classes")

    # template comparison, only for accepted paragraphs and templates of the predicted family
    bigrams = F.array_distinct(_grams(F.col("w"), 2))
    templates = _templates(spark)
    likely = z.where(F.col("p") >= model.accept)
    pairs = c.join(likely, ["row", "paragraph"]).select("row", "paragraph", "family", "versions", bigrams.alias("g")).withColumn("n", F.size("g"))
    pairs = pairs.join(F.broadcast(templates), "family")
    same, t = F.size(F.array_intersect("g", "t")), F.size("t")
    part = same / F.when(t >= BARE, t).otherwise(F.col("n") + t - same)
    named = (F.size("allowed") == 0) | ((F.size("versions") > 0) & (F.size(F.array_except("versions", "allowed")) == 0))
    close = pairs.groupBy("row", "paragraph").agg(F.max(part).alias("similarity"), F.first(named).alias("named"))
    found = z.join(close, ["row", "paragraph"], "left")
    one = F.struct("paragraph", "family", F.col("p").alias("probability"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce((F.col("similarity") >= confirm) & F.col("named"), F.lit(False)).alias("confirmed"))
    per = found.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("p") >= model.accept, one))).alias("licences"), F.max("p").alias("most"))
    best = F.array_max(F.transform("licences", lambda x: F.struct(x["confirmed"].alias("confirmed"), x["probability"].alias("probability"), x["family"].alias("family"))))
    out = rows.join(per, "row", "left").withColumn("best", best)
    tried, nothing = F.col("n_paragraphs") > 0, _softmax(model.bias)[:-1].max()
    return out.select(
        F.col("id").alias(id_col),
        "n_paragraphs",
        F.when(F.col("candidates").isNotNull(), F.size("candidates")).otherwise(0).cast("long").alias("n_candidates"),
        F.when(F.col("best").isNotNull(), F.col("best.family")).when(tried, F.lit(UNKNOWN)).alias("licence"),
        F.when(F.col("best").isNotNull(), F.col("best.probability")).when(tried, F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(float(nothing)))).alias("probability"),
        F.coalesce(F.col("best.confirmed"), F.lit(False)).alias("confirmed"),
        F.coalesce("licences", F.array()).alias("licences"),
    )


def _table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(g, [float(x) for x in model.weights[i]]) for i, g in enumerate(model.features) if model.weights[i].any()]
    return spark.createDataFrame(rows, "gram string, w array<double>")


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _templates(spark: SparkSession) -> DataFrame:
    """(family, t, allowed): the bigrams of every notice and sentence, and the versions that the family may name."""
    two = lambda w: sorted({" ".join(w[i : i + 2]) for i in range(len(w) - 1)})
    rows = [(f, two(words(t)), list(VERSIONS.get(f, ()))) for f in NAMES for t in (*TEXTS[f], *(o.format(n) for n in NAMES[f] for o in OPENINGS))]
    return spark.createDataFrame([r for r in rows if r[1]], "family string, t array<string>, allowed array<string>")
