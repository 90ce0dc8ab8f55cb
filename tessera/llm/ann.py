"""Nearest neighbours by collision counting, with query-centred windows.

In each block of rows, vectors are projected on ``lines`` directions and every
projection is kept as one sorted array.  A query opens a window around its own
projection in each array; windows of all radii use the same arrays (virtual
rehashing).  A vector collides where it lies in the window, and those that
collide in at least ``lines - misses`` arrays are verified by the exact inner
product.  A first, narrow round around the query's places gives a bound on the
k-th distance; windows then grow until they reach ``reach`` times the k-th
verified distance, where a vector no farther than that is counted often enough
with a chance of about 0.97.  Collisions are counted by what lies *outside* the
windows, which is the shorter part of each array.

The largest inner product is the nearest point once each vector gets one more
component that lifts all to the block's largest norm.

Defined results: vectors that are null, zero, or hold a null or non-finite
component take no part, as rows or as queries; vectors of other lengths are
only compared among themselves; a query never finds rows of its own id; fewer
than ``k`` candidates are returned all; ties go to the smaller id; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.llm.blocks import search_blocks

LINES, MISSES, REACH = 96, 9, 1.8
FOUND = StructType([StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", DoubleType())])


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(t: pa.Table) -> np.ndarray:
    values = t["value"].combine_chunks()
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def directions(dim: int, lines: int) -> np.ndarray:
    """Rows of random orthogonal bases, scaled like Gaussian directions."""
    rng, parts = np.random.RandomState(11), []
    while sum(p.shape[1] for p in parts) < lines:
        parts.append(np.linalg.qr(rng.randn(dim, dim))[0] * np.sqrt(dim))
    return np.concatenate(parts, axis=1)[:, :lines]


class Block:
    """Sorted projections of one block of vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: int = LINES):
        self.ids, self.x, self.lines = ids, x, lines
        norm = np.einsum("ij,ij->i", x, x)
        self.top = np.sqrt(norm.max())
        lifted = np.concatenate([x, np.sqrt(np.maximum(0, norm.max() - norm))[:, None]], axis=1)
        self.planes = directions(lifted.shape[1], lines)
        p = (lifted @ self.planes).T
        self.order = np.ascontiguousarray(np.argsort(p, axis=1, kind="stable"))
        self.values = np.take_along_axis(p, self.order, axis=1)

    def search(self, own: np.ndarray, q: np.ndarray, k: int, misses: int = MISSES, reach: float = REACH):
        """Ids and scores found for each query; rounds run over all open queries."""
        unit = np.linalg.norm(q, axis=1)
        at = np.concatenate([q * (self.top / unit)[:, None], np.zeros((len(q), 1))], axis=1) @ self.planes
        places = [np.searchsorted(v, at[:, j]) for j, v in enumerate(self.values)]
        state = [_Query(self, own[i], q[i], unit[i], k) for i in range(len(q))]
        side = max(4, k // 2)
        for i, s in enumerate(state):
            s.verify(np.unique(np.concatenate([self.order[j, max(0, p[i] - side): p[i] + side] for j, p in enumerate(places)])))
            s.h = 0.85 * reach * s.far if np.isfinite(s.far) else 0.25 * self.top
        left = [i for i, s in enumerate(state) if not s.all_seen()]
        while left:
            h = np.array([max(state[i].h, 1e-9 * self.top) for i in left])
            lo = [np.searchsorted(v, at[left, j] - h).tolist() for j, v in enumerate(self.values)]
            hi = [np.searchsorted(v, at[left, j] + h, side="right").tolist() for j, v in enumerate(self.values)]
            again = []
            for c, i in enumerate(left):
                s, outside = state[i], []
                for o, a, b in zip(self.order, lo, hi):
                    outside.append(o[: a[c]])
                    outside.append(o[b[c]:])
                missed = np.bincount(np.concatenate(outside), minlength=len(self.ids))
                s.verify(np.flatnonzero((missed <= misses) & ~s.seen))
                if s.h < reach * s.far and not s.all_seen():
                    s.h = reach * s.far if np.isfinite(s.far) else 1.5 * s.h
                    again.append(i)
                else:
                    s.seen = None
            left = again
        return [s.best() for s in state]


class _Query:
    """Verified candidates of one query and the distance of its k-th."""

    def __init__(self, block: Block, own, q, unit, k):
        self.block, self.own, self.q, self.unit, self.k = block, own, q, unit, k
        self.seen = np.zeros(len(block.ids), bool)
        self.ids, self.scores, self.far, self.n = block.ids[:0], np.zeros(0), np.inf, 0

    def all_seen(self) -> bool:
        return self.n == len(self.block.ids)

    def verify(self, new: np.ndarray) -> None:
        self.seen[new] = True
        self.n += len(new)
        ids, scores = self.block.ids[new], self.block.x[new] @ self.q
        keep = ids != self.own
        ids, scores = np.concatenate([self.ids, ids[keep]]), np.concatenate([self.scores, scores[keep]])
        top = np.lexsort((ids, -scores))[: self.k] if len(ids) <= 4 * self.k else self._top(ids, scores)
        self.ids, self.scores = ids[top], scores[top]
        if len(self.ids) == self.k:
            self.far = np.sqrt(max(0.0, 2 * self.block.top**2 - 2 * self.block.top / self.unit * self.scores[-1]))

    def _top(self, ids, scores):
        cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
        best = np.flatnonzero(scores >= cut)
        return best[np.lexsort((ids[best], -scores[best]))[: self.k]]

    def best(self):
        return self.ids, self.scores


def _find(k: int):
    def find(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if rows.num_rows and queries.num_rows:
            b = Block(rows["id"].to_numpy(), matrix(rows))
            owners, vectors = queries["id"].to_numpy(), matrix(queries)
            for at in range(0, len(owners), 256):
                found = b.search(owners[at: at + 256], vectors[at: at + 256], k)
                for own, (ids, scores) in zip(owners[at: at + 256], found):
                    for col, got in zip(out, (np.full(len(ids), own), ids, scores)):
                        col.append(got)
        cat = lambda c, t: np.concatenate(c) if c else np.zeros(0, t)
        return pa.table({"query_id": cat(out[0], np.int64), "vec_id": cat(out[1], np.int64), "score": cat(out[2], np.float64)})

    return find


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, id_col="vec_id", vector_col="embedding", block: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products found for each query."""
    def side(df):
        ok = df.where(usable(df[vector_col]) & df[id_col].isNotNull())
        v = F.transform(ok[vector_col], lambda x: x.cast("double"))
        return ok.select(ok[id_col].cast("long").alias("id"), v.alias("value"), F.size(v).alias("dim"))

    near = search_blocks(side(rows), side(queries), _find(k), FOUND, [F.col("score").desc(), F.col("vec_id")], k, ["dim"], block)
    return near.select("query_id", "rank", "vec_id", "score")
