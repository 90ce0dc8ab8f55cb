"""Connected components: local contraction, then alternating star contractions.

Each partition of at most about ``LOCAL`` edges is first contracted by
union-find to stars, which drops every edge that its partition does not need.
One partition is then done; several go on in rounds.  Every round rewires edges
towards the smallest neighbour, so the number of rounds grows with the
logarithm of the longest path and each round is two aggregations and two joins.
Nothing is collected; only two numbers (edge count and an order-free digest)
reach the driver to detect the fixpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.lineage import cut


def _digest(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


#: Edges that one task contracts, some tens of MB.
LOCAL = 500_000


def _contract(edges: DataFrame) -> DataFrame:
    """Stars with the components of each partition's edges."""
    def run(batches):
        import pyarrow as pa

        up: dict = {}

        def find(x):
            root = x
            while up[root] != root:
                root = up[root]
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        kind = None
        for b in batches:
            kind = b.schema
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                u, v = find(u), find(v)
                if u != v:
                    up[max(u, v)] = min(u, v)
        leaves = [x for x in up if up[x] != x]
        for at in range(0, len(leaves), 65_536):
            part = leaves[at: at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind[0].type), pa.array([find(x) for x in part], kind[1].type)], names=["u", "v"])

    return edges.select("u", "v").mapInArrow(run, edges.select("u", "v").schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", stored: bool = False) -> DataFrame:
    """``(node, component)`` for every end of an edge between ids that order.

    ``component`` is the smallest id reachable, the node itself included.
    Edges with a null end are ignored; a node whose only edge is a self-loop
    forms its own component; no edges give no rows.  ``stored`` edges are cheap
    to read twice and are not written again.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where(
        "a is not null and b is not null"
    )
    loops = e.where("a = b").select(F.col("a").alias("node"))
    e = e.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e if stored else cut(e.distinct())
    parts = -(-e.count() // LOCAL)
    if parts:
        e = cut(_contract(e.coalesce(parts)))
    before = _digest(e) if parts > 1 else (0, None)
    while before[0]:
        e = cut(_small_star(_large_star(e)))
        now = _digest(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return (
        found.union(loops.select("node", F.col("node").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )
