import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table of ``(doc_id, text[, source])`` rows, with columns that clash with internal names."""
    def make(rows, source=None):
        rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else source, 7, "a", "b", 3) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid string, rep string, k long").repartition(3)

    return make


@pytest.fixture
def words():
    rng = random.Random(5)
    return lambda n, seed=None: " ".join((rng if seed is None else random.Random(seed)).choice("abcdefghij") + str((rng if seed is None else random.Random(seed + i)).randrange(500)) for i in range(n))
