"""License scans: wrapped notices, licenses that aren't known, and a brute-force matcher."""

import random
import re

import pyarrow as pa
import pytest

from mergeloom.llm import licenses

WRAPPED = {
    "gpl": "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */",
    "lgpl": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
}
OTHERS = [
    "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License 2.0.",
    "Licensed under the European Union Public Licence, Version 1.2.", "Released under the Boost Software License.", "Licensed under the Artistic License, Version 2.0.",
]


@pytest.fixture(scope="module")
def model(docs):
    return licenses.fit([r.text for r in docs.collect()])


def families(text, model):
    return [x[1] for x in licenses.scan_texts(pa.array([text]), model)]


@pytest.mark.parametrize("family", WRAPPED)
def test_wrapped_notices(family, model):
    for text in (WRAPPED[family], "Some words before it.\n\n" + WRAPPED[family] + "\n\nand some words after it", WRAPPED[family].replace("\n", "\r\n")):
        assert set(families(text, model)) == {family}


@pytest.mark.parametrize("text", OTHERS)
def test_other_licenses_are_unknown(text, model):
    assert families(text, model) == []


def plain(text):
    return re.findall("[a-z0-9]+|[^\x00-\x7f]+", text.lower())


def follows(pairs, form):
    """The longest common subsequence of word pairs, as a share."""
    best = [0] * (len(pairs) + 1)
    for x in form:
        diagonal = 0
        for j in range(1, len(pairs) + 1):
            diagonal, best[j] = best[j], diagonal + 1 if pairs[j - 1] == x else max(best[j], best[j - 1])
    return best[-1] / len(form)


def test_brute_force(docs, model):
    """Documents of prose with whole, wrapped notices in between: every paragraph against every template, in plain Python."""
    r = random.Random(8)
    prose = [x for t in docs.limit(60).collect() for x in t.text.split("\n") if not re.search("licen|rights", x, re.I)]
    texts, want, may = [], [], []  # families that must be found, and that may be
    for _ in range(120):
        parts, own, close = [], [], set()
        for _ in range(r.randrange(1, 6)):
            if r.random() < 0.5:
                parts.append(r.choice(prose))
            else:
                f = r.choice(sorted(licenses.TEMPLATES))
                words = r.choice(licenses.TEMPLATES[f]).split(" ")
                at = [i for i in range(8, len(words) - 1, 9) if not words[i - 1].endswith((".", ":", ";"))]
                for i in at:
                    words[i] = "\n" + words[i]
                parts.append(" ".join(words).replace(" \n", "\n"))
        texts.append("\n\n".join(parts))
        for part in parts:
            for sentence in re.split(r"(?<=[.!?])\s+", part):
                w = plain(sentence)
                pairs = list(zip(w, w[1:], strict=False))
                like = {f: max(follows(pairs, list(zip(plain(t), plain(t)[1:], strict=False))) for t in ts) for f, ts in licenses.TEMPLATES.items()} if pairs else {}
                if like and max(like.values()) > 0.9:
                    own.append(max(like, key=like.get))
                close |= {f for f, x in like.items() if x > 0.4} | {f for f, ns in licenses.NOTICES.items() for n in ns if " ".join(plain(n)) in " ".join(w)}
        want.append(own)
        may.append(close)
    got = [[] for _ in texts]
    for x in licenses.scan_texts(pa.array(texts), model):
        got[x[0]].append(x[1])
    assert sum(set(w) <= set(g) for g, w in zip(got, want, strict=True)) >= 0.97 * len(texts)
    assert all(set(g) <= m for g, m in zip(got, may, strict=True)) and not all(may)


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "Granted under the Zebra Grant, second edition."), (2, "Zebras graze."), (None, None), (3, ""), (1, "Granted under the Zebra Grant, second edition.")], "doc_id long, text string")
    found = licenses.license_scan(docs, templates={"zebra": ["Granted under the Zebra Grant, second edition."], "okapi": ["Granted under the Okapi Grant, second edition."]}, notices={}).collect()
    assert [(r.doc_id, r.family) for r in found] == [(1, "zebra"), (1, "zebra")]
