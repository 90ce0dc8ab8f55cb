import re
from collections import defaultdict

from conftest import DATA

from tessera.llm import neardup, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, num=85, den=100):
    """n_shingles and component of each id, over all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    at, up = defaultdict(list), {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_the_registered_query_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert found(queries.op2_near_duplicates(spark, DATA)) == brute(rows)


def test_near_copies_around_the_threshold(frame, words):
    base = words(200, 1).split()
    rows = [(0, " ".join(base))]
    for n in range(1, 9):  # each changed word touches up to five shingles
        w = list(base)
        for k in range(n):
            w[(k * 23) % 200] = f"new{n}x{k}"
        rows.append((n, " ".join(w)))
    rows += [(20 + k, " ".join(base[: 196 - k])) for k in range(6)]
    assert found(neardup.near_duplicates(frame(rows))) == brute(rows)


def test_large_groups(frame, words):
    """Groups above the short-list and block sizes: copies, and near copies that all differ."""
    common, rows = words(120, 3).split(), []
    rows += [(i, " ".join(common)) for i in range(300)]
    rows += [(1000 + i, " ".join([*common[:60], f"only{i}", *common[60:]])) for i in range(150)]
    rows += [(5000 + i, f"{words(40, i)} {' '.join(common[:30])}") for i in range(60)]
    block, neardup.BLOCK = neardup.BLOCK, 64
    try:
        assert found(neardup.near_duplicates(frame(rows))) == brute(rows)
    finally:
        neardup.BLOCK = block


def test_edge_cases(frame):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "x y z"), (8, "ÉA b c d e"), (9, "éa b c d e"), (10, "w " * 200_000)]
    assert found(neardup.near_duplicates(frame(rows))) == brute(rows)
    assert neardup.near_duplicates(frame(rows[:1]).limit(0)).count() == 0
    twice = neardup.near_duplicates(frame([(4, "one two"), (4, "one two"), (5, "one two"), (None, "one two")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in twice) == [(0, 0, True), (4, 4, True), (4, 4, True), (5, 4, False)]


def test_keep_one(frame):
    kept = neardup.keep_one(frame([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, ""), (1, "a b c d e f")]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and "rep" in kept.columns
