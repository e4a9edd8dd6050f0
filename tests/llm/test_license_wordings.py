"""Usual notices, hard-wrapped ones among them, and sentences with the same words that grant nothing."""

import numpy as np
import pytest
from seabedflow.llm import licenses

NOTICES = [
    ("gpl", "Licensed under the GNU General Public License, version 3."),
    ("gpl", "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */"),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ("agpl", "it under the terms of the GNU Affero General Public License as\npublished by the Free Software Foundation, either version 3"),
    ("apache", "Apache License, Version 2.0"),
    ("mit", "This project uses the MIT License."),
    ("mit", "MIT License"),
    ("isc", "ISC License"),
    ("bsd", "BSD 2-Clause License"),
    ("gpl", "# SPDX-License-Identifier: GPL-2.0-or-later"),
    ("unlicense", "This is free and unencumbered software released into the public\ndomain."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"),
    ("gpl", "GNU General Public License version 2"),
    ("epl", "Made available under the Eclipse Public License v2.0, see the file EPL."),
    ("zlib", "This library is distributed under the zlib license."),
    ("wtfpl", "This code is licensed under the WTFPL."),
    ("artistic", "You may use it under the terms of the Artistic License 2.0."),
    ("boost", "Use, modification and distribution are subject to the Boost Software License, Version 1.0."),
    ("mit", "The source code is available under the terms of the\nMIT license, see LICENSE."),
    ("cc-by", "Text is shared under a Creative Commons Attribution 4.0 International License."),
    ("mpl", "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0."),
    ("proprietary", "Copyright 2019 Acme Corp. All rights reserved."),
    ("bsd", "Use of this source code is governed by a BSD-style license"),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
]
NONE = ["Mit.", "Ungte mit.", "Sie kam mit Lizenz", "The Apache helicopter landed.", "Researchers at MIT published a paper.", "The general public was not admitted.", "A lawyer explained copyright law.", "all rights reserved to the states remain in force", "The car was released under the MIT license plate program.", "The painter took artistic license with the scene.", "The eclipse was public; no license was needed to watch it.", "Zlib is a village in Moravia.", "Sales got a boost from the software license deal.", "Students at MIT hold a fishing license."]


@pytest.fixture(scope="module")
def model():
    return licenses.default_model()


@pytest.mark.parametrize("family, text", [*NOTICES, *((None, t) for t in NONE)])
def test_wordings(model, family, text):
    found = [f for p in licenses.paragraphs(f"Intro\n\n{text}\n\nend") for f, _ in model.paragraph(p)]
    assert found == ([family] if family else [])


def test_several_families_and_paragraphs(spark, model):
    rows = [(0, "MIT License\nLicensed under the Apache License, Version 2.0.\n\n \nISC License"), (1, "//\n// Released under\n// the MIT License.\n//\n// code")]
    got = {r.doc_id: (r.families, r.n_paragraphs) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {0: (["apache", "isc", "mit"], 2), 1: (["mit"], 1)}


def test_sparse_products_equal_dense_ones():
    rows = [[0, 3], [2], [0, 1, 2, 3]]
    x = licenses._Sparse(rows, 5)
    dense = np.array([[float(j in r) for j in range(5)] for r in rows])
    m, n = np.arange(10.0).reshape(5, 2), np.arange(6.0).reshape(3, 2)
    assert (x.times(m) == dense @ m).all() and (x.transposed_times(n) == dense.T @ n).all()


def test_rows_without_content_and_long_ones(spark, model):
    rows = [(None, "MIT License"), (None, None), (1, ""), (1, "word " * 60_000 + "\n\nReleased under the GPL.\n"), (2, "x" * 100_000)]
    got = [(r.doc_id, r.family, r.n_paragraphs) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert sorted(got, key=str) == sorted([(None, "mit", 1), (None, None, 0), (1, None, 0), (1, "gpl", 1), (2, None, 0)], key=str)
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
