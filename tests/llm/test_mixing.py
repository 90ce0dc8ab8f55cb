import re
from collections import defaultdict

import pytest
from conftest import DATA

from tessera.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Water filling by repetition; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, out, open_ = share * sum(sizes.values()), {}, set(order)
    while True:
        left = total - sum(most * sizes[s] for s in order if s not in open_)
        level = left / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            break
        open_ -= over
    for s in order:
        out[s] = level * w[s] if s in open_ else most * sizes[s]
    return out


def check(rows, got, near):
    """rows: (doc_id, text, source)."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes, longest = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        sizes[source[i]] += n
        longest[source[i]] = max(longest[source[i]], n)
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    assert sorted(r["doc_id"] for r in got) == sorted(size)
    for r in got:
        i = r["doc_id"]
        assert (r["size"], r["source_size"]) == (size[i], sizes[source[i]]) and r["target"] == pytest.approx(want[source[i]], rel=1e-9, abs=1e-9)
        assert 0 <= r["taken"] <= 2 * size[i] and (size[i] == 0 or r["taken"] % size[i] == 0)
        taken[source[i]] += r["taken"]
    for s in want:
        assert abs(taken[s] - want[s]) <= near * max(1, want[s]) + longest[s], (s, taken[s], want[s])


def test_the_registered_query_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.select("doc_id", "text", "source").collect()]
    got = queries.op5_mixing(spark, DATA).collect()
    check(rows, got, 0.01)
    assert sorted(map(tuple, queries.op5_mixing(spark, DATA).collect())) == sorted(map(tuple, got))


def test_a_hot_source_and_one_held_at_its_bound(frame, words):
    rows = [(i, words(5 + i % 90, i), "hot") for i in range(400)] + [(1000 + i, words(30, i), "b") for i in range(60)] + [(2000 + i, words(9, i), "tiny") for i in range(3)] + [(3000, words(50, 1), None)]
    check(rows, mixing.mix(frame(rows)).collect(), 0.01)


def test_edge_cases(frame):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t ", "b"), (4, "one two", "c"), (5, "x y", "c"), (6, "w", None)]
    check(rows, mixing.mix(frame(rows)).collect(), 0.01)
    assert mixing.mix(frame(rows).limit(0)).count() == 0
    zero = mixing.mix(frame([(1, None, "a"), (2, "", None)])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in zero} == {(0, 0.0, 0)}
    twice = mixing.mix(frame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", "t")])).collect()
    assert len(twice) == 3


def test_copies_take_effect(frame, words):
    rows = [(i, words(20, i), "ab"[i % 2]) for i in range(80)]
    docs = frame(rows)
    times = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r["doc_id"]] += 1
    assert dict(n) == {i: k for i, k in times.items() if k}


def test_sources_go_by_code_point(frame):
    rows = [(1, "a b c d", "Z"), (2, "a b c d", "a"), (3, "a b c d", "é"), (4, "a b c d", "\U0001F600"), (5, "a b c d", "￮")]
    check(rows, mixing.mix(frame(rows)).collect(), 0.01)
