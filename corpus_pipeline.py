"""A corpus from raw documents to training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes every stage's result beside the checkpoints and reads it back as the
next one's documents.  All but the last keep the columns of ``documents``.

1. toxicity: documents predicted toxic go.
2. near_duplicates: of each group of near-copies (Jaccard similarity of five-word
   shingles of 0.80 or more) the one of smallest id stays.
3. pseudonyms: personal values are replaced within the texts.
4. mixing: every document occurs as often as its source's target asks for.
5. packing: the pieces of the training sequences.

No stage but packing drops or changes anything else; null and empty texts pass
through all of them, and an empty table gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, neardup, packing, pii, queries, toxicity
from tessera.llm.common import table
from tessera.operators.lineage import store


#: Bytes of an Arrow batch.  Spark's own bound is 64 MB or 10,000 rows: with whole texts some 100 MB while a batch
#: grows, and as much again in the worker, for each task that runs.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def small_batches(stage):
    """``stage`` with ``BATCH`` set for the session, unless the session has a bound of its own."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH[0], None) is None:
            spark.conf.set(*BATCH)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, num=80, den=100, size=5)


@small_batches
def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, queries.PII_KEY, counts=False)


@small_batches
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a small word cache: the same workers hold what the other stages need
    return packing.pack(docs, queries.WORD_BPE, size=4096, end_id=2, cache=60_000)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mix), ("packing", pack)]

#: Trees, hashes and tokenizers are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
