"""The pipeline's stages, each against what its operator promises for that stage's own input."""

import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from conftest import DATA

import corpus_pipeline
from tessera.llm import toxicity
from tessera.operators.lineage import store
from test_neardup import brute
from test_packing import check


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, f in corpus_pipeline.STAGES:
        after = store(f(spark, docs, DATA))
        out[name] = (docs.collect(), after.collect(), docs, after)
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "pseudonyms", "mixing", "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][3].columns == stages[name][2].columns


def test_toxic_documents_go(spark, stages):
    before, after, docs, _ = stages["toxicity"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    bad = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == bad


def test_one_of_each_group_stays(stages):
    before, after, *_ = stages["near_duplicates"]
    want = brute([(r["doc_id"], r["text"]) for r in before], 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, x in want.items() if x[2])


def test_values_are_replaced(stages):
    before, after, *_ = stages["pseudonyms"]
    old, new = {r["doc_id"]: r["text"] for r in before}, {r["doc_id"]: r["text"] for r in after}
    assert set(old) == set(new) and any(old[i] != new[i] for i in old)
    assert all("@" not in (t or "").replace("@d", "") or ".example" in t or old[i] == t for i, t in new.items())


def test_documents_are_repeated_at_most_twice(stages):
    from collections import Counter

    before, after, *_ = stages["mixing"]
    n = Counter(r["doc_id"] for r in after)
    assert set(n.values()) <= {1, 2} and set(n) <= {r["doc_id"] for r in before}


def test_pieces_cover_what_was_mixed(stages):
    before, after, *_ = stages["packing"]
    check([(r["doc_id"], r["text"]) for r in before], after)


def test_an_empty_corpus(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_from_0_80_on_go(spark, stages, frame, words):
    before, after, *_ = stages["near_duplicates"]
    want = brute([(r["doc_id"], r["text"]) for r in before], 80, 100)
    assert sorted(r["doc_id"] for r in after) == sorted(i for i, x in want.items() if x[2])
    base = words(200, 1).split()
    rows = [(0, " ".join(base))]
    for n in range(3, 7):  # 4 changed words: 176 of 216 shingles
        rows.append((n, " ".join(f"new{n}x{i}" if i in range(20, 20 + 40 * n, 40) else w for i, w in enumerate(base))))
    want = brute(rows, 80, 100)
    assert want[4][1] == 0 != brute(rows)[4][1]
    got = corpus_pipeline.near_duplicates(spark, frame(rows), DATA)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, x in want.items() if x[2])


def test_whole_runs_with_odd_rows(spark, stages, tmp_path):
    """Null ids, repeated rows, null and empty texts and clashing columns go through all stages."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, "a b c d e f", "en", None, 11), (None, "a b c d e f", "en", None, 11), (None, "q r s t", "en", "x", 7), (900, None, None, "x", None), (901, "", "en", "x", 0),
                                 (902, "one two 123-45-6789", "en", "x", 19), (902, "one two 123-45-6789", "en", "x", 19), (902, "other words here", "en", "x", 16)], docs.schema)
    for c in ("nth", "copies", "row", "id", "rep", "found", "kinds", "hash", "n"):
        docs, odd = docs.withColumn(c, docs["doc_id"]), odd.withColumn(c, odd["doc_id"])
    docs.union(odd).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES[:-1]:
        after = store(f(spark, table, str(tmp_path)))
        assert after.columns == table.columns
        if name == "near_duplicates":
            assert after.where("doc_id is null").count() == 3 and after.where("doc_id = 902").count() == 2
        assert after.where("doc_id is not null and (nth <> doc_id or row <> doc_id or nth is null)").isEmpty()
        table = after
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.columns == stages["packing"][3].columns and whole.count() > 0
    first = whole.where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"] for r in first} == {r["doc_id"] for r in table.select("doc_id").distinct().collect()}


def test_batches_of_whole_texts_are_bounded_in_bytes(spark, frame):
    """Rows alone (10,000 of them) bound no memory: a batch ends by its bytes too, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def largest():
        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.record_batch({"n": pa.array([b.nbytes], pa.int64())})

        texts = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 10000) text")
        return max(r["n"] for r in texts.mapInArrow(sizes, "n long").collect())

    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, frame([(1, "a b c d e f")]), DATA)
            assert largest() < 10_000_000
        spark.conf.set(key, "2m")
        corpus_pipeline.pseudonyms(spark, frame([(1, "a b c d e f")]), DATA)
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


WORKER = """
import re, sys
sys.path[:0] = [{repo!r}]
import pandas
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from tessera.llm import common, neardup, toxicity

class Frame:  # hands out the function that maps its batches
    columns, schema = ["doc_id", "text"], type("S", (), {{"fields": []}})()
    select = lambda self, *_: self
    mapInArrow = lambda self, run, _: run
    where = lambda self, _: self
    sparkSession = type("S", (), {{"sparkContext": type("C", (), {{"broadcast": staticmethod(lambda m: type("B", (), {{"value": m}}))}})}})

def held():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", f.read()))) / 1024

def task():
    if {name!r} == "toxicity":
        return toxicity.reject(Frame(), Frame())
    return common.scan(Frame(), ["doc_id", "text"], neardup._sketch_rows(5, neardup.K), neardup.SKETCH)

toxicity.train = lambda *_: toxicity.Model(["a b c"] * 20 + ["you idiot"] * 20, [0] * 20 + [1] * 20)
toxicity.held_out = lambda *_: 0
to_arrow_schema(neardup.SKETCH)
before, rows = held(), 0
for _ in range(3):
    with open({path!r}, "rb") as f:
        rows += sum(b.num_rows for b in task()(pa.ipc.open_stream(f)))
print(rows, held() - before)
"""


@pytest.mark.parametrize("name,most", [("toxicity", 25), ("near_duplicates", 52)])
def test_workers_give_back_what_a_stage_took(name, most, tmp_path):
    """Workers go on to the next stage: what each of them leaves behind would add up in the executor."""
    rng, path = random.Random(1), str(tmp_path / "batches")
    t = pa.table({"doc_id": range(10_000), "text": [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(10_000)]})
    with pa.ipc.new_stream(path, t.schema) as out:
        out.write_table(t)
        out.write_table(t)
    code = WORKER.format(repo=str(Path(corpus_pipeline.__file__).parent), name=name, path=path)
    ran = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    rows, held = map(float, ran.stdout.split())
    assert rows == 60_000 and held < most
