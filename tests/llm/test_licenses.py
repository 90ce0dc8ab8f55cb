import pytest

from tessera.llm import licenses

FIELDS = "doc_id long, path string, text string, own string, dir string"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], FIELDS)
    return {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}


@pytest.mark.parametrize("text, want", [
    ("Some words.\nLicensed under the Apache License, Version 2.0\nmore words", "Apache-2.0"), ("# SPDX-License-Identifier: MIT\ncode", "MIT"), (MIT, "MIT"),
    ("x This work is licensed under the GNU General Public License, version 3 y", "GPL-3.0"), ("x This work is licensed under the GNU General Public License, version 2 y", "GPL-2.0"),
    ("All rights reserved. Redistribution without permission is prohibited.", "Proprietary"), ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
    ("The driving licence of the driver was lost near the sea", None), ("nothing at all", None), ("", None), (None, None),
])
def test_own_licence(text, want):
    assert licenses.scan_text(text, 0.6)[0] == want


def test_every_template_finds_itself():
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert licenses.scan_text(f"Alpha beta gamma. {t}. Delta omega.", 0.6)[0] == name, t


def test_nearest_directory_wins(spark):
    got = run(spark, [
        (1, "LICENSE", "Licensed under the Apache License, Version 2.0"), (2, "a/LICENSE", MIT), (3, "a/b/c.txt", "words only"), (4, "z/y/x.txt", "words only"), (5, "a/own.txt", "SPDX-License-Identifier: ISC " + "word " * 50),
        (6, None, "words only"), (7, "top.txt", None), (8, "ab/x.txt", "plain"),
    ])
    assert {i: got[i]["license"] for i in got} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "Apache-2.0", 5: "ISC", 6: None, 7: "Apache-2.0", 8: "Apache-2.0"}
    assert got[3]["from_dir"] == "a" and got[4]["from_dir"] == "" and got[5]["from_dir"] is None
    assert got[2]["is_file"] and not got[5]["is_file"]


def test_ties_repeats_and_empty_tables(spark):
    got = run(spark, [(1, "d/one", MIT), (2, "d/two", "Licensed under the ISC License"), (3, "d/x", "plain")])
    best = min((-got[i]["score"], got[i]["own"]) for i in (1, 2))[1]
    assert got[3]["license"] == best
    df = spark.createDataFrame([(1, "d/x", MIT, "", "")] * 3, FIELDS)
    assert licenses.scan_licenses(df).count() == 3 and licenses.scan_licenses(df.limit(0)).count() == 0


BOILERPLATE = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License
as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."""


@pytest.mark.parametrize("kind, version, want", [("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")])
def test_boilerplates_of_the_fsf(kind, version, want):
    assert licenses.scan_text("int f(void);\n" + BOILERPLATE.format(kind, version) + "\nvoid g(void);", 0.6)[0] == want


def test_full_licence_texts_are_licence_files(spark):
    texts = licenses.full_texts()
    assert set(licenses.TEMPLATES) - set(texts) == {"Proprietary"}
    rows = []
    for k, (name, t) in enumerate(sorted(texts.items())):
        rows += [(2 * k, f"{name}/LICENSE", f"Some Project\nCopyright (c) 2021 Jane Roe and others\n\n{t}"), (2 * k + 1, f"{name}/src/a.txt", "words only")]
    got = run(spark, rows)
    for k, name in enumerate(sorted(texts)):
        assert (got[2 * k]["own"], got[2 * k]["is_file"], got[2 * k + 1]["license"]) == (name, True, name)


def test_a_header_in_a_long_file_is_no_licence_file():
    name, _, inside, n = licenses.scan_text(licenses.full_texts()["MIT"] + " code words follow here" * 200, 0.6)
    assert name == "MIT" and 2 * inside < n
