import duckdb
import numpy as np
from conftest import DATA

from tessera.llm import hamming, queries


def test_the_registered_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = con.execute(f"SELECT query_id, rank, vec_id, distance FROM ({queries.ORACLE_SQL['op8_hamming_search']})").fetchall()
    got = queries.op8_hamming_search(spark, DATA).select("query_id", "rank", "vec_id", "distance").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_exactness_on_clustered_codes():
    rng = np.random.RandomState(1)
    codes = rng.randint(0, 2**63, 400).astype(np.uint64)
    codes = np.concatenate([codes, codes[:50], codes[:100] ^ np.uint64(0b10110)])
    ids = np.arange(len(codes))
    index = hamming.Index(ids, codes)
    for q in range(0, len(codes), 7):
        got, dist = index.search(q, codes[q], 10)
        d = np.bitwise_count(codes ^ codes[q]).astype(int)
        want = sorted((int(d[i]), int(i)) for i in ids if i != q)[:10]
        assert list(zip(dist.tolist(), got.tolist())) == want


def test_nulls_few_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 5, 0), (2, None, 0), (3, 5, 0), (3, 5, 0), (None, 7, 0)], "vec_id long, code long, value int")
    got = hamming.nearest_codes(df, df.where("vec_id = 1"), k=5).select("vec_id", "distance", "rank").collect()
    assert sorted(map(tuple, got)) == [(3, 0, 1), (3, 0, 2)]
    assert hamming.nearest_codes(df.limit(0), df.limit(0)).count() == 0
