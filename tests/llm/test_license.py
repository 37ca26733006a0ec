import random

from pyspark.sql import functions as F

from framewright.llm import license as lic


def brute(text, model):
    """The classifier in plain Python, for one paragraph."""
    import numpy as np

    place = {g: i for i, g in enumerate(model.features)}
    z = model.bias.astype(float).copy()
    hits = [place[g] for g in lic.grams(lic.words(text)) if g in place and model.weights[place[g]].any()]
    if not hits:
        return None
    z = z + model.weights[hits].sum(axis=0)
    p = np.exp(z - z.max())
    p = p / p.sum()
    i = int(p[:-1].argmax())
    return model.families[i], float(p[i])


def test_scan_equals_the_plain_model(spark):
    model, rng = lic.train(), random.Random(8)
    rows = [" ".join(w) for _, w in lic.examples(99)[:150]] + ["Plain text.", "mit", "license " * 40]
    rng.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id int, text string").withColumn("row", F.lit("clash"))
    for r in lic.scan(df).collect():
        want = brute(rows[r.doc_id], model)
        if want is None or want[1] < model.accept:
            assert r.licence in (None, lic.UNKNOWN)
        else:
            assert r.licence == want[0] and abs(r.probability - want[1]) < 1e-4


def test_held_out_examples():
    model = lic.train()
    good = strange = known = unknown = 0
    for family, w in lic.examples(1234):
        got = brute(" ".join(w), model)
        label = got[0] if got and got[1] >= model.accept else lic.UNKNOWN
        if family == lic.UNKNOWN:
            unknown, strange = unknown + 1, strange + (label != family)
        else:
            known, good = known + 1, good + (label == family)
    assert good >= 0.95 * known and strange <= 0.03 * unknown


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "Intro\nReleased under the MIT License.\nEnd"), (None, "Licensed under CC BY-NC 4.0."), (5, "He lost his license."), (6, "word " * 50_000 + "\nLicensed under the Apache License, Version 2.0."), (4, "Released under the MIT License.")]
    got = lic.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(((r.doc_id, r.licence, r.confirmed, r.n_paragraphs) for r in got), key=repr) == sorted(
        [(1, None, False, 0), (2, None, False, 0), (3, None, False, 0), (4, "MIT", True, 3), (None, "CC-BY-NC-4.0", True, 1), (5, "unknown", False, 1), (6, "Apache-2.0", True, 2), (4, "MIT", True, 1)], key=repr
    )
    assert lic.scan(spark.createDataFrame([], "doc_id int, text string")).collect() == []


# Notices as projects write them; none of them is a template.
HELD_OUT = [
    ("GPL-2.0", "This file is part of Foo.\n\nFoo is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"),
    ("GPL-2.0", "This code is licensed under the GPL v2 or later."),
    ("GPL-3.0", "    Bar is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n"),
    ("GPL-3.0", "The whole package is distributed under the terms of the GNU GPL v3."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.\n"),
    ("LGPL-3.0", "Baz is licensed under the GNU Lesser General Public License, version 3, see COPYING."),
    ("AGPL-3.0", "The server is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License, version 3, as published by the Free Software Foundation."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Copyright 2019 The Authors. Released under the Apache License 2.0, see the LICENSE file."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n'),
    ("MIT", "Our code is available under the MIT License, have fun."),
    ("BSD-3-Clause", "Neither the name of Example Inc. nor the names of its contributors may be used to\nendorse or promote products derived from this software without specific prior\nwritten permission."),
    ("BSD-3-Clause", "Code in this folder uses the BSD 3-Clause License."),
    ("BSD-2-Clause", "Everything here is under the BSD 2-Clause License unless it says otherwise."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Text of this page is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Photos: licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "The data set is published under CC BY-NC 4.0 for research."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
WRONG = [
    "Licensed under the Apache License, Version 1.1.", "Licensed under the Mozilla Public License, version 1.1.", "Licensed under CC BY-SA 3.0.", "All rights reserved. MIT was founded in 1861.", "Released under the GNU General Public License, version 1.", "Text is under CC BY-NC-SA 4.0.",
    "MIT", "Apache", "All rights reserved.", "She studied at MIT under a license from the state, version 2 of the plan.",
]


def test_held_out_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HELD_OUT)], "doc_id int, text string")
    got = {r.doc_id: r for r in lic.scan(df).collect()}
    missed = [(f, got[i].licence) for i, (f, _) in enumerate(HELD_OUT) if got[i].licence != f]
    assert len(missed) <= 0.1 * len(HELD_OUT), missed
    assert [(f, got[i].licence) for i, (f, _) in enumerate(HELD_OUT) if got[i].confirmed and got[i].licence != f] == []


def test_other_versions_and_bare_words_are_not_confirmed(spark):
    df = spark.createDataFrame(list(enumerate(WRONG)), "doc_id int, text string")
    assert [(WRONG[r.doc_id], r.licence) for r in lic.scan(df).collect() if r.confirmed] == []


def test_similarity_and_confirmation_equal_brute_force(spark):
    import re

    model, texts = lic.train(), [t for _, t in HELD_OUT] + WRONG
    two = lambda w: {" ".join(w[i : i + 2]) for i in range(len(w) - 1)}
    templates = [(f, two(lic.words(t))) for f in lic.NAMES for t in (*lic.TEXTS[f], *(o.format(n) for n in lic.NAMES[f] for o in lic.OPENINGS))]
    for r in lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect():
        units = re.sub(r"(?m)^([^\n]{45,100})(?<![.!?:])\r?\n(?=[^\s])", r"\1 ", texts[r.doc_id].lower()).split("\n")
        units = [u for u in units if u.strip()]
        assert r.n_paragraphs == len(units)
        want = []
        for i, u in enumerate(units):
            got = brute(u, model)
            if got is None or got[1] < model.accept:
                continue
            g, best = two(lic.words(u)), 0.0
            for f, t in templates:
                if f == got[0] and t:
                    best = max(best, len(g & t) / (len(t) if len(t) >= lic.BARE else len(g | t)))
            said, allowed = set(re.findall(lic.VERSION, u)), set(lic.VERSIONS.get(got[0], ()))
            want.append((i, got[0], round(best, 6), best >= lic.CONFIRM and (not allowed or bool(said) and said <= allowed)))
        assert [(x.paragraph, x.family, round(x.similarity, 6), x.confirmed) for x in r.licences] == want
        if not want:
            assert r.licence == lic.UNKNOWN and r.licences == []
