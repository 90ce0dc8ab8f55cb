"""Searching a stated query set against all rows, block by block."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType


def search_blocks(rows: DataFrame, queries: DataFrame, find: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType,
                  order: list[Column], k: int, keys: list[str], block: int = 16_384, query_block: int = 8_192) -> DataFrame:
    """``find(block of rows, block of queries)`` for every pair of blocks, then the best ``k`` per query.

    Both frames have ``id``, ``value`` and the columns ``keys``; only rows and
    queries with equal keys meet.  Blocks are dealt by a hash of the id, so
    their sizes are bounded and even; each pair of blocks is one task's group
    and returns at most ``k`` rows per query.
    """
    n, m = rows.count(), queries.count()
    parts, groups = max(1, -(-n // block)), max(1, -(-m // query_block))
    row_side = rows.select(*keys, "id", "value", F.lit(False).alias("asks"),
                           F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    query_side = queries.select(*keys, "id", "value", F.lit(True).alias("asks"),
                                F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"),
                                F.pmod(F.xxhash64("id"), F.lit(groups)).alias("group"))

    def one(t: pa.Table) -> pa.Table:
        asks = t["asks"]
        return find(t.filter(pa.compute.invert(asks)), t.filter(asks))

    import pyarrow.compute  # noqa: F401  (bound as pa.compute in the worker)

    near = row_side.unionByName(query_side).groupBy(*keys, "part", "group").applyInArrow(one, schema)
    place = Window.partitionBy("query_id").orderBy(*order)
    return near.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
