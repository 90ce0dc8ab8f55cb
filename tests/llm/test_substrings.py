import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from conftest import DATA

from tessera.llm import queries, substrings


def brute(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[a:a + length] for _, d in data for a in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - length + 1):
            if seen[d[a:a + length]] > 1:
                gone[a:a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect())


def test_the_registered_query_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(queries.op7_repeated_substrings(spark, DATA)) == brute(rows)


def test_passages(frame, words):
    p, q = words(150, 9)[:700], words(150, 10)[:401]
    rows = [(1, words(80, 1) + p + words(50, 2)), (2, words(90, 3) + p), (3, p), (4, q + " zz " + q), (5, q[1:]), (6, p[100:499]), (7, p[100:500]),
            (8, words(20, 8) + p[:400] + p[:400]), (9, "ab" * 900), (10, "x" * 401), (11, "é" * 300 + words(30, 7)), (12, words(60, 6) + "é" * 300)]
    assert found(substrings.remove_repeats(frame(rows))) == brute(rows)


@pytest.mark.parametrize("most", [2, 8192])
def test_common_passages_with_different_edges(frame, words, most):
    p = words(120, 12)[:450]
    rows = [(i, f"{words(12, 100 + i)}{p[i % 40:]}{words(12, 300 + i)}") for i in range(120)]
    assert found(substrings.remove_repeats(frame(rows), most=most)) == brute(rows)


def test_very_long_texts_cross_segments(frame, words):
    size, substrings.SEGMENT = substrings.SEGMENT, 1 << 11
    try:
        p = words(400, 21)
        rows = [(1, words(3000, 22) + p + words(2000, 23)), (2, p + words(1000, 24))]
        assert found(substrings.remove_repeats(frame(rows))) == brute(rows)
    finally:
        substrings.SEGMENT = size


def test_edge_cases(frame, words):
    p = words(120, 30)[:420]
    rows = [(1, None), (2, ""), (3, "short"), (4, p), (4, p), (5, None)]
    assert found(substrings.remove_repeats(frame(rows))) == brute(rows)
    assert substrings.remove_repeats(frame(rows).limit(0)).count() == 0
    kept = substrings.remove_repeats(frame([(1, p + "tail"), (2, p)])).collect()
    assert {r["doc_id"]: r["kept"] for r in kept} == {1: "tail", 2: ""}
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame(rows), length=50)


def brute_passages(rows, n=51):
    """Ids of texts with n words, as written, that another text holds too."""
    at = {}
    for i, t in set(rows):
        data = (t or "").encode()
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
        for a, b in zip(w, w[n - 1:]):
            at.setdefault(data[a[0]: b[1]], set()).add((i, t))
    return {i for docs in at.values() if len(docs) > 1 for i, _ in docs}


def flagged(df):
    return {r["doc_id"] for r in df.collect() if r["repeats"]}


def test_texts_with_passages_of_other_texts(spark, documents, frame, words):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert flagged(queries.op7_repeated_substrings(spark, DATA)) == brute_passages(rows)
    p = " ".join(words(60, 40).split()[:51])
    rows = [(1, words(70, 41) + " " + p + "\n" + words(9, 42)), (2, p), (3, p.rsplit(" ", 1)[0]), (4, p[1:] + " x"), (5, "a " * 50 + "b"), (6, "c " + "a " * 50 + "b a a"),
            (7, p.replace(" ", "\n")), (8, words(51, 43) + " " + words(51, 43)), (9, words(60, 44)), (9, words(60, 44))]
    assert flagged(substrings.remove_repeats(frame(rows))) == brute_passages(rows) == {1, 2, 5, 6, 9}
    common = words(55, 45)
    rows = [(i, f"{words(12, 500 + i)} {common[i % 7:]} {words(12, 700 + i)}") for i in range(90)] + [(200, words(90, 46))]
    assert flagged(substrings.remove_repeats(frame(rows))) == brute_passages(rows)


def test_a_long_text_is_cut_as_short_ones_are(words):
    text = np.frombuffer((words(9000, 50) + " " + "z" * 30_000 + " " + words(9000, 50)).encode(), np.uint8)
    at = np.array([0, len(text)])
    short = [x for x in substrings._of_chunk(text, at, 400, 51) if x[4][0] == 3]
    p, k, ctx = (np.sort(x) for x in (short[0][1], short[0][2], short[0][3]))
    size, block = substrings.SEGMENT, substrings.WORD_BLOCK
    substrings.SEGMENT, substrings.WORD_BLOCK = 1 << 12, 300
    try:
        parts = list(substrings._of_chunk(text, at, 400, 51))
    finally:
        substrings.SEGMENT, substrings.WORD_BLOCK = size, block
    long = [x for x in parts if x[4][0] == 3]
    assert set(long[0][2].tolist()) == set(k.tolist()) and set(p.tolist()) <= set(long[0][1].tolist())
    spans = lambda ps: sorted((int(a), int(b)) for x in ps if x[4][0] == 1 for a, b in zip(x[1], x[2]))
    assert spans(parts) == spans(substrings._of_chunk(text, at, 400, 51))
