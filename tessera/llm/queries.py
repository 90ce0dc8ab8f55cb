"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import ann, hamming, licenses, mixing, neardup, packing, pii, substrings, token_counts, toxicity
from tessera.llm.common import table

#: Places of the vocabulary files; parameters of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


#: Example key of the pseudonyms; a deployment passes its own secret.
PII_KEY = "example-key"


def op1_collision_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where("vec_id % 20 = 0"), k=20)


def op2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100, size=5)


def op3_pseudonyms(spark, sf_dir):
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, size=4096, end_id=2)


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_licenses(spark, sf_dir):
    """Documents lie at source/language/id, so that licence files serve their folder."""
    d = table(spark, sf_dir, "documents")
    parts = [F.coalesce(F.col(c), F.lit("unknown")) for c in ("source", "lang")]
    return licenses.scan_licenses(d.select("doc_id", "text", F.concat_ws("/", *parts, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path")))


def op7_repeated_substrings(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=400, with_text=False).drop("kept")


def op8_hamming_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.nearest_codes(e, e.where("vec_id % 50 = 0"), k=10)


def op9_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op10_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_collision_search, op2_near_duplicates, op3_pseudonyms, op4_packing, op5_mixing, op6_licenses,
    op7_repeated_substrings, op8_hamming_search, op9_token_counts, op10_toxicity,
)}

ORACLE_SQL: dict[str, str] = {
    "op8_hamming_search": """
        WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
        near AS (
            SELECT q.vec_id AS query_id, e.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.embedding[i] > 0) <> (e.embedding[i] > 0) AS INTEGER))) AS INTEGER) AS distance
            FROM e AS q JOIN e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM near) WHERE rank <= 10""",
}
