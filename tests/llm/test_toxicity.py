import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tessera.llm import queries, toxicity


@pytest.fixture(scope="module")
def scored(spark):
    d = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return queries.op10_toxicity(spark, d).join(labels, "doc_id", "left").collect()


def test_held_out_rows(scored):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)


def test_held_out_accuracy(scored):
    out = [(r["score"], r["toxic"]) for r in scored if r["held_out"] and r["toxic"] is not None]
    s, y = np.array(out).T
    assert ((s >= 0.5) == y).mean() >= 0.95
    pos, neg = s[y == 1], s[y == 0]
    assert (pos[:, None] > neg[None]).mean() + 0.5 * (pos[:, None] == neg[None]).mean() >= 0.95


def data(frame):
    rows = [(i, f"you are an idiot and a moron {i}" if i % 3 == 0 else f"the calm river runs by the town {i}") for i in range(240)]
    return frame(rows), [(i, int(i % 3 == 0)) for i in range(240)]


def test_edge_cases(spark, frame):
    docs, y = data(frame)
    labels = spark.createDataFrame([(i, t, 1) for i, t in y] + [(None, 1, 1), (3, None, 1), (3, 1, 1)], "doc_id long, toxic int, text int")
    more = docs.unionByName(frame([(900, None), (901, ""), (902, "calm " * 100_000), (903, "you idiot moron"), (903, "you idiot moron"), (None, "calm river")]))
    got = toxicity.score(more, labels).collect()
    by = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 246 and by[903] > 0.5 > by[902] and by[900] == by[901] < 0.5
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


def test_labels_of_held_out_rows_are_never_read(spark, frame):
    docs, y = data(frame)
    lie = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in y]
    a, b = (spark.createDataFrame(x, "doc_id long, toxic int") for x in (y, lie))
    assert sorted(map(tuple, toxicity.score(docs, a).collect())) == sorted(map(tuple, toxicity.score(docs, b).collect()))


def test_reject_keeps_clean_rows_whole(spark, frame):
    docs, y = data(frame)
    kept = toxicity.reject(docs, spark.createDataFrame(y, "doc_id long, toxic int"))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in y if not t}


def test_isotonic_calibration_is_monotone():
    at, value = toxicity.isotonic(np.array([0.1, 0.4, 0.3, 0.9]), np.array([0, 1, 0, 1]))
    assert list(value) == sorted(value) and list(at) == sorted(at)
