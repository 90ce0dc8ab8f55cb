"""Licence scans: TF-IDF cosine to templates, then inheritance along paths.

1. Notices.  Wherever a trigger word of licences stands in a text, windows of
   words around it are compared with notice and header templates by the cosine
   of sparse TF-IDF vectors (inverse document frequencies come from the
   templates, which are fixed).  The best template at or above ``least`` is the
   document's own licence.  A document of which notices make up at least half
   of the words is a licence file.
   Documents with a trigger word are also compared as a whole with the full
   texts of licences, by the same cosine with inverse document frequencies of
   their own.  One at or above ``least`` that holds at least half of the words
   of the document and of the licence makes it a licence file of that licence.
2. Inheritance.  Licence files give their directory a licence (the best score,
   ties to the smaller name).  The directories of documents without an own
   licence are listed once, spread to their ancestors and joined to licensed
   directories by path; the deepest one wins.  No pair of documents is formed,
   and a directory with a third of all rows is still one directory.

Defined results: null and empty texts have no own licence; a null path has no
directory and inherits nothing; files at the top inherit from the top; repeated
rows get equal results; an empty table gives no rows; ties between templates
go to the smaller name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from tessera.llm.common import scan
from tessera.operators.lineage import store

TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only",
                "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only",
                "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only",
                 "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only",
                 "redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only",
                 "redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal", "licensed under CC0 1.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0"],
    "Proprietary": ["All rights reserved. Redistribution without permission is prohibited", "Confidential and proprietary. All rights reserved"],
}
for _name, _kind, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    TEMPLATES[_name].append(f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {_kind}General Public License "
                            f"as published by the Free Software Foundation; either version {_version} of the License, or (at your option) any later version")
TOKEN = re.compile(r"\d+(?:\.\d+)*|[^\W\d_]+")
TRIGGER = re.compile(r"licen[sc]e|licencia|lizenz|spdx|hereby\W+granted|redistribution|public\W+domain|rights\W+reserved", re.IGNORECASE)
FOUND = StructType([
    StructField("doc_id", LongType()), StructField("path", StringType()), StructField("own", StringType()),
    StructField("score", DoubleType()), StructField("is_file", BooleanType()),
])


def _terms(text: str) -> list[str]:
    return [w.removesuffix(".0") if w[0].isdigit() else w.lower() for w in TOKEN.findall(text)]


@lru_cache(maxsize=1)
def full_texts() -> dict[str, str]:
    """Full licence texts; relatives that differ by few words are made from the text at hand."""
    texts = {p.name.removesuffix(".txt"): p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    texts["AGPL-3.0"] = re.sub(r"GNU\s+General", "GNU Affero General", texts["GPL-3.0"], flags=re.IGNORECASE)
    for name, word in (("CC-BY-4.0", ""), ("CC-BY-NC-4.0", "NonCommercial"), ("CC-BY-NC-SA-4.0", "NonCommercial-ShareAlike"), ("CC-BY-ND-4.0", "NoDerivatives")):
        texts[name] = re.sub("ShareAlike", word, texts["CC-BY-SA-4.0"], flags=re.IGNORECASE)
    return texts


@lru_cache(maxsize=1)
def _full_bags() -> list[Counter]:
    return [Counter(_terms(t)) for _, t in sorted(full_texts().items())]


@lru_cache(maxsize=2)
def _index(full: bool = False):
    """Inverse frequencies and, per term, the templates that hold it with their weights."""
    if full:
        bags = list(zip(sorted(full_texts()), _full_bags()))
    else:
        bags = [(name, Counter(_terms(t))) for name, ts in sorted(TEMPLATES.items()) for t in ts]
    df = Counter(w for _, b in bags for w in b)
    idf = {w: math.log((1 + len(bags)) / (0.5 + n)) for w, n in df.items()}
    lists: dict[str, list] = {}
    for k, (_, b) in enumerate(bags):
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in b.items()))
        for w, n in b.items():
            lists.setdefault(w, []).append((k, n * idf[w] / norm))
    return [name for name, _ in bags], [sum(b.values()) for _, b in bags], idf, lists, math.log((1 + len(bags)) / 0.5)


def best_template(terms: list[str], full: bool = False) -> tuple[str | None, float]:
    """Template nearest to a bag of terms, by cosine; unknown terms count against it."""
    names, _, idf, lists, rare = _index(full)
    bag, dots, norm = Counter(terms), {}, 0.0
    for w, n in bag.items():
        x = n * idf.get(w, rare)
        norm += x * x
        for k, y in lists.get(w, ()):
            dots[k] = dots.get(k, 0.0) + x * y
    if not dots:
        return None, 0.0
    score, name = max((round(v / math.sqrt(norm), 9), [-ord(c) for c in names[k]], k) for k, v in dots.items())[::2]
    return names[name], score


def whole_text(terms: list[str], least: float) -> tuple[str | None, float, int]:
    """Licence of which the document is the full text, its score and the words they share."""
    names, sizes = _index(True)[:2]
    if 2 * len(terms) < min(sizes):
        return None, 0.0, 0
    name, score = best_template(terms, True)
    if name is None or score < least:
        return None, 0.0, 0
    k = names.index(name)
    both = (Counter(terms) & _full_bags()[k]).total()
    return (name, score, both) if 2 * both >= max(len(terms), sizes[k]) else (None, 0.0, 0)


def scan_text(text: str, least: float) -> tuple[str | None, float, int, int]:
    """Own licence, its score, words in notices, words in all."""
    if not text:
        return None, 0.0, 0, 0
    known = _index()[2]
    best, best_score, covered = None, 0.0, set()
    hits = [m.start() for m in TRIGGER.finditer(text)]
    if not hits:
        return None, 0.0, 0, 0
    spots = [(m.start(), m.group()) for m in TOKEN.finditer(text)]
    terms = [w.removesuffix(".0") if w[0].isdigit() else w.lower() for _, w in spots]
    starts = [s for s, _ in spots]
    from bisect import bisect_right

    seen = set()
    for h in hits:
        i = max(0, bisect_right(starts, h) - 1)
        a, b = i, i + 1  # widest run of template words around the trigger, small gaps allowed
        while a > 0 and i - a < 40 and (terms[a - 1] in known or (a > 1 and terms[a - 2] in known)):
            a -= 1
        while b < len(terms) and b - i < 60 and (terms[b] in known or (b + 1 < len(terms) and terms[b + 1] in known)):
            b += 1
        for lo, hi in {(a, b), (max(a, i - 5), min(b, i + 8)), (max(a, i - 9), min(b, i + 9)), (max(a, i - 3), min(b, i + 5)), (max(a, i - 5), min(b, i + 2))}:
            if (lo, hi) in seen:
                continue
            seen.add((lo, hi))
            name, score = best_template(terms[lo:hi])
            if score >= least:
                covered.update(range(lo, hi))
                if (score, best or "") > (best_score, "") and (score > best_score or name < best):
                    best, best_score = name, score
    name, score, both = whole_text(terms, least)
    if name:
        return name, score, max(both, len(covered)), len(terms)
    return best, best_score, len(covered), len(terms)


def own_licenses(docs: DataFrame, least: float = 0.6, id_col="doc_id", path_col="path", text_col="text") -> DataFrame:
    """``doc_id, path, own, score, is_file`` of every row."""
    def start():
        def one(i, path, text):
            name, score, inside, n = scan_text(text, least)
            yield i, path, name, score, bool(name) and 2 * inside >= n

        return one

    return scan(docs, [docs[id_col].cast("long"), docs[path_col].cast("string"), docs[text_col].cast("string")], start, FOUND)


def scan_licenses(docs: DataFrame, least: float = 0.6, id_col="doc_id", path_col="path", text_col="text") -> DataFrame:
    """``doc_id, path, own, score, is_file, license, from_dir`` of every row."""
    found = own_licenses(docs, least, id_col, path_col, text_col).withColumn(
        "dir", F.when(F.contains(F.col("path"), F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    found = store(found)
    given = found.where("is_file and dir is not null").groupBy("dir").agg(
        F.min(F.struct(-F.col("score"), F.col("own").alias("name"))).alias("b")).select(F.col("dir").alias("from_dir"), F.col("b.name").alias("name"))
    bare = found.where("own is null and dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    depth = F.explode(F.sequence(F.lit(0), F.size(parts)))
    above = bare.select("dir", depth.alias("depth")).select(
        "dir", "depth", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.col("depth")), "/")).alias("from_dir"))
    near = above.join(given, "from_dir").groupBy("dir").agg(
        F.max_by(F.struct("name", "from_dir"), "depth").alias("n")).select("dir", F.col("n.name").alias("name"), F.col("n.from_dir").alias("from_dir"))
    out = found.join(near, "dir", "left")
    bare_row = F.col("own").isNull()
    return out.select("doc_id", "path", "own", "score", "is_file", F.coalesce("own", "name").alias("license"),
                      F.when(bare_row, F.col("from_dir")).alias("from_dir"))
