"""Common license families, in notices and in whole texts, by the registered scan's own templates."""

from __future__ import annotations

from test_text_operators import table

from plantlens.llm import licenses

NOTICES = {
    "This project is licensed under the MIT License - see the file": "permissive",
    "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation": "copyleft",
    "This library is licensed under the GNU Affero General Public License.": "copyleft",
    "the Free Software as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "copyleft",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.": "permissive",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission.": "permissive",
    "are made available under the terms of the Eclipse Public License v2.0": "copyleft",
    "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication; licensed under CC0 1.0": "public-domain",
    "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "copyleft",
    "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "noderivatives",
    "This is free and unencumbered software released into the public domain.": "public-domain",
    "Distributed under the Boost Software License, Version 1.0.": "permissive",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions:": "permissive",
}


def test_common_notices_and_texts(spark):
    notices = ["some words before it " + t + " and words after" for t in NOTICES]
    # bodies without their openings: the second of two parts whose first is a tenth of the words
    bodies = {t.name: t.text.split() for t in licenses.TEMPLATES if t.name.endswith("-text")}
    docs = table(spark, notices + [" ".join(w[len(w) // 10:]) for w in bodies.values()] + ["nothing of that kind in here"])
    got = [(r.families.split(","), r.licenses.split(",")) for r in licenses.scan(docs).orderBy("doc_id").collect()]
    for kind, (families, _) in zip(NOTICES.values(), got):
        assert kind in families
    for name, (_, names) in zip(bodies, got[len(notices):]):
        assert name in names
    assert got[-1] == ([""], [""])


def test_rows_of_one_id_are_judged_alone(spark):
    text = "This is free and unencumbered software released into the public domain."
    docs = spark.createDataFrame([(1, text), (1, "other words"), (1, text), (None, text), (None, None), (2, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_licenses) for r in licenses.scan(docs).collect())
    assert [(i, n > 0) for i, n in got] == [("1", False), ("1", True), ("1", True), ("2", False), ("None", False), ("None", True)]


def test_no_short_template_is_missed(spark):
    # one-shingle templates at the start of texts, where only one window has their shingle
    own = [licenses.Template(f"t{i:03}", "own", f"a{i} b{i} c{i} d{i} e{i}") for i in range(300)]
    docs = table(spark, [t.text + f" tail{i} of that text {i} goes on" for i, t in enumerate(own)])
    got = [r.licenses for r in licenses.scan(docs, own).orderBy("doc_id").collect()]
    assert got == [t.name for t in own]
