"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut in four 16-bit segments, each with its own table from
value to rows.  A query probes the segments in turn at radius 0, then 1, and so
on; once the first ``a`` segments are probed to radius ``r`` and the rest to
``r - 1``, every code within distance ``4r + a - 1`` has been met, because its
differences cannot exceed that in every segment.  The search ends when the k-th
verified distance is within that reach, so results and ties are exact.

Defined results: null codes take no part; a query never finds rows of its own
id; equal codes are found at distance 0; fewer than ``k`` candidates are
returned all; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.blocks import search_blocks

SEGMENTS, BITS = 4, 16
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("distance", IntegerType())])


def sign_code(v: Column, bits: int = 64) -> Column:
    """Signs of the first 64 components as a long; null for a null vector or component."""
    each = F.transform(F.slice(v, 1, bits), lambda x, i: F.when(x.isNull(), F.lit(None).cast("long")).when(
        x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


@lru_cache(maxsize=BITS + 1)
def _masks(r: int) -> np.ndarray:
    all_ = np.arange(1 << BITS, dtype=np.uint32)
    return all_[np.bitwise_count(all_) == r].astype(np.int64)


class Index:
    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes
        self.order, self.start = [], []
        for s in range(SEGMENTS):
            part = (codes >> np.uint64(BITS * s) & np.uint64(0xFFFF)).astype(np.int64)
            self.order.append(np.argsort(part, kind="stable"))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << BITS))]))

    def _rows(self, s: int, values: np.ndarray) -> np.ndarray:
        a, b = self.start[s][values], self.start[s][values + 1]
        full = b > a
        a, n = a[full], (b - a)[full]
        if not len(a):
            return a
        return self.order[s][np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def search(self, own: int, code: np.uint64, k: int):
        seen = self.ids == own
        found, dist = [], []
        counts = np.zeros(SEGMENTS * BITS + 2, np.int64)
        for r in range(BITS + 1):
            for s in range(SEGMENTS):
                part = int(code >> np.uint64(BITS * s) & np.uint64(0xFFFF))
                new = self._rows(s, part ^ _masks(r))
                new = np.unique(new[~seen[new]])
                if len(new):
                    seen[new] = True
                    d = np.bitwise_count(self.codes[new] ^ code).astype(np.int64)
                    found.append(new)
                    dist.append(d)
                    counts += np.bincount(d, minlength=len(counts))
                reach = SEGMENTS * r + s
                if counts[: reach + 1].sum() >= k:
                    break
            else:
                continue
            break
        if not found:
            return self.ids[:0], np.zeros(0, np.int64)
        rows, dist = np.concatenate(found), np.concatenate(dist)
        best = np.lexsort((self.ids[rows], dist))[:k]
        return self.ids[rows[best]], dist[best]


def _find(k: int):
    def find(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if rows.num_rows and queries.num_rows:
            index = Index(rows["id"].to_numpy(), rows["value"].to_numpy().view(np.uint64))
            for own, code in zip(queries["id"].to_numpy(), queries["value"].to_numpy().view(np.uint64)):
                ids, dist = index.search(own, code, k)
                for col, got in zip(out, (np.full(len(ids), own), ids, dist)):
                    col.append(got)
        cat = lambda c: np.concatenate(c) if c else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "distance": cat(out[2]).astype(np.int32)})

    return find


def nearest_codes(rows: DataFrame, queries: DataFrame, k: int = 10, id_col="vec_id", code_col="code", block: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, distance``: exactly the ``k`` nearest codes of each query."""
    def side(df):
        return df.where(df[code_col].isNotNull() & df[id_col].isNotNull()).select(
            df[id_col].cast("long").alias("id"), df[code_col].cast("long").alias("value"))

    near = search_blocks(side(rows), side(queries), _find(k), FOUND, [F.col("distance"), F.col("vec_id")], k, [], block)
    return near.select("query_id", "rank", "vec_id", "distance")
