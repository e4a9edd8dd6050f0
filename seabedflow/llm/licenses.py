"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of adjacent lines with words, joined, so a hard-wrapped notice is whole. ``CORES`` holds what
identifies a notice of each family: its name in a grant, before or after "license" or in an SPDX line, or the sentence its full text
begins with. Around each core found, ``NEAR`` words to both sides are a set of word 1- to 3-grams, and softmax regression over a sparse
vocabulary of n-grams tells the family of the core from "unknown". The vocabulary has only n-grams with an anchor word, and
every core holds one; paragraphs without an anchor word are found by a regular expression and never sent to Python.
The certainty a family needs is calibrated on held-out unknown texts so that at most 1 in 100 passes for any family.

Training texts are generated from ``TEMPLATES`` and ``OTHER`` with seeded word losses and neighbours; nothing is read from the corpus.

Defined results: null and empty texts hold no licence; a document with several families lists them all in
alphabetical order, ``n_paragraphs`` counts paragraphs with any, and its ``family`` is the one of the most certain paragraph, ties by name; repeated rows are each
scanned; an empty table gives an empty table.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: How notices of each family are usually worded.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 3", "released under the agpl", "spdx license identifier agpl 3 0", "agplv3 license", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation either version 3", "license agpl 3 0", "agpl 3 0 licensed"),
    "apache": ("licensed under the apache license version 2 0", "released under the apache license", "apache software license", "spdx license identifier apache 2 0", "you may not use this file except in compliance with the license", "apache license version 2 0", "apache license", "this project uses the apache license", "distributed under the apache 2 0 license", "license apache 2 0"),
    "bsd": ("licensed under the bsd license", "released under the 3 clause bsd license", "bsd style license", "spdx license identifier bsd 3 clause", "redistribution and use in source and binary forms with or without modification are permitted", "bsd license", "bsd 3 clause license", "this project uses the bsd license", "distributed under the terms of the bsd license", "license bsd"),
    "cc-by": ("licensed under cc by 4 0", "licensed under a creative commons attribution 4 0 international license", "this work is available under cc by", "creative commons attribution license", "cc by 4 0", "creative commons attribution 4 0 international", "license cc by 4 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 license", "this work is available under cc by nc", "creative commons attribution noncommercial license", "cc by nc 4 0", "creative commons attribution noncommercial 4 0 international", "attribution non commercial", "license cc by nc 4 0"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "licensed under a creative commons attribution sharealike 4 0 license", "this work is available under cc by sa", "creative commons attribution sharealike license", "cc by sa 4 0", "creative commons attribution sharealike 4 0 international", "attribution share alike", "license cc by sa 4 0"),
    "cc0": ("released under cc0 1 0", "dedicated to the public domain under cc0", "creative commons zero public domain dedication", "this work is in the public domain", "cc0 1 0 universal", "license cc0 1 0", "spdx license identifier cc0 1 0"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "released under the gpl", "spdx license identifier gpl 3 0", "under the terms of the gnu general public license as published by the free software foundation", "gplv3 license", "licensed under the gnu general public license version 3", "gnu general public license", "it under the terms of the gnu general public license as published by", "gnu gpl version 2", "gpl license", "this project uses the gpl license", "license gpl 3 0"),
    "isc": ("licensed under the isc license", "released under the isc license", "spdx license identifier isc", "isc license", "this project uses the isc license", "license isc", "isc licensed", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": ("licensed under the gnu lesser general public license version 3", "released under the lgpl", "spdx license identifier lgpl 3 0", "lgplv3 license", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1", "gnu library general public license", "distributed under the lgplv2 1", "license lgpl 3 0"),
    "mit": ("released under the mit license", "licensed under the mit license", "mit licensed", "spdx license identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license", "the mit license mit", "mit style license", "this project uses the mit license", "distributed under the terms of the mit license", "license mit"),
    "mpl": ("licensed under the mozilla public license version 2 0", "released under the mpl", "this source code form is subject to the terms of the mozilla public license", "spdx license identifier mpl 2 0", "mozilla public license version 2 0", "mozilla public license", "this project uses the mpl 2 0 license", "license mpl 2 0"),
    "proprietary": ("all rights reserved", "copyright all rights reserved no part may be reproduced without permission", "proprietary and confidential license", "this file is proprietary and confidential", "copyright 2020 company inc all rights reserved"),
    "artistic": ("licensed under the artistic license 2 0", "released under the artistic license", "the artistic license", "spdx license identifier artistic 2 0", "this program is free software you can redistribute it and or modify it under the artistic license", "license artistic 2 0"),
    "boost": ("distributed under the boost software license version 1 0", "licensed under the boost software license", "boost software license 1 0", "spdx license identifier bsl 1 0", "license bsl 1 0"),
    "epl": ("licensed under the eclipse public license version 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license v 2 0", "released under the epl", "spdx license identifier epl 2 0", "license epl 2 0"),
    "wtfpl": ("do what the fuck you want to public license", "released under the wtfpl", "licensed under the wtfpl version 2", "spdx license identifier wtfpl", "license wtfpl"),
    "zlib": ("licensed under the zlib license", "released under the zlib license", "zlib license", "spdx license identifier zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "license zlib"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx license identifier unlicense", "the unlicense", "this project uses the unlicense", "license unlicense"),
}
#: Sentences with the same words that grant nothing.
OTHER = (
    "he lost his driving license after the accident", "the apache helicopter landed near the village", "researchers at mit published a paper", "the general public was not admitted", "the library is open to the public",
    "a license fee is due each year", "the pilot was licensed to fly at night", "the gnu grazed on the plain with its herd", "the foundation of the house is stone", "creative people in the commons debated",
    "copyright law is taught in the second year", "please read the terms and conditions", "the restaurant has a license to serve wine", "source and binary stars were observed", "permission to land was granted free of charge",
    "the mozilla browser was updated", "the reserved seats were all taken", "the domain of this function is public knowledge", "all rights of way are reserved for walkers", "a warranty covers parts for two years",
    "the plate on the car and the license number", "all rights reserved to the crown by the treaty", "rights reserved to the tribes remain in law", "powers and rights are reserved to the people", "the mit license plate collection was sold", "a bsd license plate hung on the wall", "issued under the state license plate program", "the boost in sales and the license fee",
    "an eclipse is public and needs no license", "an artistic license was taken with the story", "he has an artistic temperament and a license to drive", "the isc license exam was postponed", "released under the licence of the crown", "the public domain of the state park", "software is used in the lab without modification", "the isc conference met in spring", "attribution of the painting is disputed", "commercial fishing requires a license",
)
ANCHORS = ("license", "licensed", "licence", "licenced", "licensing", "copyright", "creative", "commons", "apache", "mit", "bsd", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv3", "lgplv2", "agpl", "agplv3", "affero", "mozilla", "mpl", "isc", "cc", "cc0", "spdx", "unlicense", "domain", "rights", "reserved", "redistribution", "permission", "warranty", "proprietary", "artistic", "boost", "bsl", "eclipse", "epl", "wtfpl", "zlib")
NEAR = 8
_GRANT = r"(?:licensed|released|distributed|redistributed|available|published|provided|issued|offered|covered|shared)(?: \w+){0,3} (?:under|by|with)(?: \w+){0,6}?"
_NAMES = {
    "agpl": r"(?:gnu )?affero general public license|(?:gnu )?agpl(?:v?3)?",
    "apache": r"apache(?: software)?(?: license| 2)",
    "artistic": r"artistic(?! license (?:was|is|with|to|in))",
    "boost": r"boost software|bsl",
    "bsd": r"(?:[0234] clause )?bsd(?: [0234] clause)?",
    "cc-by": r"cc by(?! nc| sa| nd)|creative commons attribution(?! non ?commercial| share ?alike| no ?deriv)",
    "cc-by-nc": r"cc by nc|creative commons attribution non ?commercial",
    "cc-by-sa": r"cc by sa|creative commons attribution share ?alike",
    "cc0": r"cc0|cc zero|creative commons zero",
    "epl": r"eclipse public license|epl",
    "gpl": r"gnu general public license|(?:gnu )?gpl(?:v?[123])?",
    "isc": r"isc",
    "lgpl": r"(?:gnu )?(?:lesser|library) general public license|(?:gnu )?lgpl(?:v?[123])?",
    "mit": r"mit|expat",
    "mpl": r"mozilla public license|mpl(?:v?[12])?",
    "unlicense": r"unlicense",
    "wtfpl": r"wtfpl",
    "zlib": r"zlib(?: libpng)?",
}
#: What identifies a notice by itself.
_WHOLE = {
    "agpl": r"affero general public license",
    "apache": r"apache (?:software )?license|you may not use this file except in compliance with the license",
    "artistic": r"the artistic license(?! (?:was|is|with|to|in|of))",
    "boost": r"boost software license",
    "bsd": r"bsd style license|redistribution and use in source and binary forms",
    "cc-by": r"cc by [1-4] 0|creative commons attribution(?: [1-4] 0)?(?: international)? license|creative commons attribution [1-4] 0",
    "cc-by-nc": r"cc by nc|creative commons attribution non ?commercial|attribution non ?commercial [1-4] 0",
    "cc-by-sa": r"cc by sa|creative commons attribution share ?alike|attribution share ?alike [1-4] 0",
    "cc0": r"cc0 1 0|cc0 universal|creative commons zero|public domain dedication|(?:work|text|file|document) is in the public domain|dedicated to the public domain",
    "epl": r"eclipse public license",
    "gpl": r"gnu general public license|gnu gpl",
    "isc": r"permission to use copy modify and(?: or)? distribute this software for any purpose",
    "lgpl": r"(?:lesser|library) general public license|gnu lgpl",
    "mit": r"mit licensed|permission is hereby granted free of charge to any person obtaining a copy",
    "mpl": r"mozilla public license",
    "proprietary": r"all rights reserved|proprietary and confidential",
    "unlicense": r"free and unencumbered software released into the public domain|the unlicense",
    "wtfpl": r"do what the f\w+ you want to public license",
    "zlib": r"in no event will the authors be held liable for any damages arising from the use of this software",
}
CORES = {
    f: re.compile(r"\b(?:" + "|".join([_WHOLE[f]] * (f in _WHOLE) + [rf"{_GRANT} (?:{n})|(?:{n})(?: v?\d+)?(?: \d+)?(?: only| or later| style)? licensed?|license(?: identifier)?(?: is| type)?(?: the)? (?:{n})" for n in [_NAMES.get(f)] if n]) + r")\b")
    for f in sorted(_WHOLE)
}
UNKNOWN = "unknown"
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return ["license" if w == "licence" else "licensed" if w == "licenced" else w for w in _WORD.findall(text.lower())]


def grams(words: Sequence[str]) -> set[str]:
    """Word 1- to 3-grams that hold an anchor word, each once."""
    at = {i for i, w in enumerate(words) if w in _ANCHOR}
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for a in at for i in range(max(0, a - n + 1), min(a, len(words) - n) + 1)}


_ANCHOR = set(ANCHORS)


def _varied(words: list[str], rng: random.Random, filler: list[str]) -> list[str]:
    kept = [w for w in words if rng.random() > 0.06] or words
    pad = lambda: rng.sample(filler, rng.randint(0, 6))
    return [*pad(), *kept, *pad()]


class _Sparse:
    """A matrix of zeros and ones as the places of the ones in each row; every row has one."""

    def __init__(self, rows: list[list[int]], width: int):
        self.width, self.at = width, np.concatenate(rows)
        self.begin = np.cumsum([0, *map(len, rows)])[:-1]
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        by = np.argsort(self.at, kind="stable")
        self.row, column = row[by], self.at[by]
        self.cut = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        self.column = column[self.cut]

    def times(self, m: np.ndarray) -> np.ndarray:
        return np.add.reduceat(m[self.at], self.begin)

    def transposed_times(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, m.shape[1]))
        out[self.column] = np.add.reduceat(m[self.row], self.cut)
        return out


class LicenseModel:
    def __init__(self, copies: int = 30, steps: int = 250, ridge: float = 1e-4, seed: int = 11, pass_rate: float = 0.01):
        rng = random.Random(seed)
        self.names = [UNKNOWN, *sorted(TEMPLATES)]
        filler = sorted({w for t in OTHER for w in words_of(t)} - _ANCHOR)
        rows = [(self.names.index(f), _varied(words_of(t), rng, filler)) for f, ts in TEMPLATES.items() for t in ts for _ in range(copies)]
        rows += [(0, _varied(words_of(t), rng, filler)) for t in OTHER for _ in range(copies * 2)]
        pool = [w for f in TEMPLATES.values() for t in f for w in words_of(t)]
        mixed = (rng.sample(pool, rng.randint(1, 8)) for _ in range(copies * 20))
        # words that happen to make up a core are no example of unknown
        rows += [(0, ws) for ws in mixed if not any(r.search(" ".join(ws)) for r in CORES.values())]
        rng.shuffle(rows)
        held, used = rows[::5], [r for i, r in enumerate(rows) if i % 5]
        vocabulary = sorted({g for _, ws in used for g in grams(ws)})
        self.index = {g: i for i, g in enumerate(vocabulary)}
        rows_of = [self._features(ws) for _, ws in used]
        x = _Sparse(rows_of, len(self.index) + 1)
        y = np.array([c for c, _ in used])
        hot = np.eye(len(self.names))[y]
        own = (1 / np.bincount(y, minlength=len(self.names)))[y][:, None]
        own = own / own.mean()
        theta = np.zeros((len(self.index) + 1, len(self.names)))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            z = x.times(theta)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.transposed_times(own * (hot - p)) / len(y) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta += 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.theta = theta
        self.threshold = 0.0
        foreign = sorted(max(self.certainty(f, ws) for f in CORES) for c, ws in held if c == 0)
        self.threshold = max(0.5, foreign[int(len(foreign) * (1 - pass_rate))])

    def _features(self, words: Sequence[str]) -> list[int]:
        """Places of the known n-grams, and the constant's."""
        return sorted(i for i in (self.index.get(g) for g in grams(words)) if i is not None) + [len(self.index)]

    def certainty(self, family: str, words: Sequence[str]) -> float:
        """Probability of the family where only it and unknown come into question."""
        z = self.theta[self._features(words)].sum(0)
        return float(1 / (1 + np.exp(np.clip(z[0] - z[self.names.index(family)], -50, 50))))

    def paragraph(self, text: str) -> list[tuple[str, float]]:
        """(family, certainty) of each family confirmed in the paragraph."""
        joined, found = " ".join(words_of(text)), {}
        for family, core in CORES.items():
            for m in core.finditer(joined):
                before, after = joined[: m.start()].split()[-NEAR:], joined[m.end() :].split(None, NEAR)[:NEAR]
                sure = self.certainty(family, [*before, *m[0].split(), *after])
                if sure >= self.threshold:
                    found[family] = max(sure, found.get(family, 0.0))
        return list(found.items())


@cache
def default_model() -> LicenseModel:
    """Fitted once in a process; the training texts are fixed, so every fit is the same."""
    return LicenseModel()


def paragraphs(text: str) -> Iterator[str]:
    """Runs of adjacent lines that hold words."""
    lines = []
    for line in text.split("\n"):
        if _WORD.search(line):
            lines.append(line)
        elif lines:
            yield "\n".join(lines)
            lines = []
    if lines:
        yield "\n".join(lines)


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """One row per document: doc_id, family (null if none), families, n_paragraphs (confirmed ones), confidence."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model or default_model())
    anchor = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(ANCHORS) + r")(?![^\W_])")

    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for s in parts:
            out = []
            for t in s:
                each = [f for p in paragraphs(t or "") if anchor.search(p) and (f := m.paragraph(p))]
                found = [f for fs in each for f in fs]
                best = min(found, key=lambda f: (-f[1], f[0]), default=(None, None, None))
                out.append((best[0], sorted({f[0] for f in found}), len(each), best[1]))
            yield pd.DataFrame(out, columns=["family", "families", "n_paragraphs", "confidence"])

    udf = F.pandas_udf(scanned, "family string, families array<string>, n_paragraphs long, confidence double")
    # only texts with an anchor word go to Python
    words = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(ANCHORS) + r")(?![\p{L}\p{N}])"
    text = text_of()
    t = docs.select("doc_id", udf(F.when(text.rlike(words), text)).alias("s"))
    return t.select("doc_id", "s.*")
