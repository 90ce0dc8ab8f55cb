import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from tessera.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "Hello, World! it's HELLO", "ünïcødé ΣΑΣ ß ﬁ é", "tabs\tand\nlines\x1cseps", "<|endoftext|> inside <|startoftext|>", "a" * 5000, "   ", "数字 123 四五六", "don't  we'LL!!..", "x y　z İstanbul"]


def ids_of(texts):
    tok = Tokenizer.from_file(PATH)
    tok.no_truncation()
    tok.no_padding()
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def check(rows, pieces, size=4096, least_fill=0.97):
    want = defaultdict(list)
    for (i, _), ids in zip(rows, ids_of([t for _, t in rows])):
        want[i].append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_seq[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    for i, ps in by_doc.items():
        assert sum(p["length"] for p in ps) == sum(map(len, want[i]))
        for p in ps:
            assert any(len(x) == p["doc_tokens"] and zlib.crc32(x[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in want[i]), i
        if len(want[i]) == 1:
            ps.sort(key=lambda p: p["start"])
            assert [p["start"] for p in ps] == list(np.cumsum([0, *[p["length"] for p in ps]])[:-1])
    for ps in by_seq.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == list(np.cumsum([0, *[p["length"] for p in ps]])[:-1])
        assert 0 < sum(p["length"] for p in ps) <= size and all(p["length"] > 0 for p in ps)
    total = sum(p["length"] for p in pieces)
    if total > 20 * size:
        assert total >= least_fill * size * len(by_seq)


def test_the_registered_query_is_an_exact_cover(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    check(rows, queries.op4_packing(spark, DATA).collect())


def test_odd_texts_and_repeated_rows(frame):
    rows = list(enumerate(ODD)) + [(3, ODD[3]), (2, ODD[2])]
    check(rows, packing.pack(frame(rows), PATH).collect())


def test_small_sequences_and_many_partitions(frame, words):
    rows = [(i, words(1 + (i * 37) % 400, i)) for i in range(150)]
    check(rows, packing.pack(frame(rows), PATH, size=256, window=16, docs_per_partition=20).collect(), size=256, least_fill=0.8)


def test_empty_table_and_bad_size(frame):
    assert packing.pack(frame([(1, "x")]).limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame([(1, "x")]), PATH, size=100)


def test_the_curve_visits_every_cell_once_and_steps_to_neighbours():
    cells = {packing.hilbert([a, b], 3): (a, b) for a in range(8) for b in range(8)}
    assert sorted(cells) == list(range(64))
    assert all(abs(cells[k][0] - cells[k + 1][0]) + abs(cells[k][1] - cells[k + 1][1]) == 1 for k in range(63))


def test_crc_of_joined_blocks():
    ids = np.arange(1000, dtype="<u4")
    blocks = np.array([zlib.crc32(ids[a:a + 64].tobytes()) for a in range(0, 1000, 64)], "<u4").tobytes()
    assert packing.joined_crc(blocks, 1000) == zlib.crc32(ids.tobytes())


def test_copies_lie_side_by_side(frame, words):
    rows = [(i, words(60, 7)) for i in range(40)] + [(100 + i, words(60, 100 + i)) for i in range(200)]
    pieces = packing.pack(frame(rows), PATH).collect()
    assert len({p["sequence_id"] for p in pieces if p["doc_id"] < 40}) <= 6
