"""Whole-graph algorithms callable as rules.

``REGISTRY[name](spark, inputs, options)`` takes edge relations (from, to
and, where wanted, a weight that defaults to 1) and gives a DataFrame.
Algorithms with a distributed form run as joins and aggregations in a driver
loop over checkpoints.  The few that are sequential by nature (depth-first
order, flows, cliques, modularity passes, k shortest paths, walks) run on the
driver over at most ``MAX_EDGES`` edges and refuse beyond.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict, deque

from pyspark.sql import DataFrame, functions as F

from tessera.errors import LimitExceeded, Refusal, TypeRefusal
from tessera.operators.components import connected_components
from tessera.operators.lineage import cut
from tessera.operators.ranking import numbered, ranked

MAX_EDGES = 5_000_000
REGISTRY: dict[str, object] = {}


def rule(*names):
    def add(f):
        for n in names:
            REGISTRY[n] = f
        return f

    return add


def edges_of(df: DataFrame, undirected: bool = False, negative: bool = False) -> DataFrame:
    """``s, d, w``; weights must be finite, and not negative unless allowed."""
    cols = df.columns
    if len(cols) < 2:
        raise TypeRefusal("an edge relation needs two columns")
    w = F.col(f"`{cols[2]}`").cast("double") if len(cols) > 2 else F.lit(1.0)
    bad = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    bad = bad if negative else bad | (w < 0)
    e = df.select(F.col(f"`{cols[0]}`").alias("s"), F.col(f"`{cols[1]}`").alias("d"), F.when(bad, F.raise_error(F.lit("an edge weight is not lawful"))).otherwise(w).alias("w"))
    return e.unionByName(e.select(F.col("d").alias("s"), F.col("s").alias("d"), "w")) if undirected else e


def nodes_of(e: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    n = e.select(F.col("s").alias("n")).union(e.select(F.col("d").alias("n")))
    if extra is not None:
        n = n.union(extra.select(F.col(f"`{extra.columns[0]}`").alias("n")))
    return n.distinct()


def collected(e: DataFrame) -> list[tuple]:
    rows = e.limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise LimitExceeded(f"this algorithm takes at most {MAX_EDGES} edges")
    return sorted((r["s"], r["d"], r["w"]) for r in rows)


def frame(spark, rows, like: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"c{k} {t}" for k, t in enumerate(like)))


def node_type(e: DataFrame) -> str:
    return e.schema["s"].dataType.simpleString()


def flag(o, name, default):
    return o.get(name, default)


@rule("PageRank")
def pagerank(spark, inputs, o):
    e = edges_of(inputs[0], flag(o, "undirected", False)).select("s", "d")
    theta, eps, rounds = float(flag(o, "theta", 0.85)), float(flag(o, "epsilon", 1e-4)), int(flag(o, "iterations", 10))
    nodes = cut(nodes_of(e))
    n = nodes.count()
    if not n:
        return nodes.select("n", F.lit(0.0).alias("score"))
    links = cut(e.join(e.groupBy("s").agg(F.count(F.lit(1)).alias("deg")), "s").groupBy("s", "d").agg((F.count(F.lit(1)) / F.first("deg")).alias("p")))
    score = nodes.withColumn("score", F.lit(1.0 / n))
    for _ in range(rounds):
        got = links.join(score, links["s"] == score["n"]).groupBy("d").agg(F.sum(F.col("p") * F.col("score")).alias("x"))
        new = cut(score.join(got, score["n"] == got["d"], "left").select(
            "n", (F.lit((1 - theta) / n) + theta * F.coalesce("x", F.lit(0.0))).alias("score"), F.col("score").alias("old")))
        gone = new.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        score = new.select("n", "score")
        if gone < eps:
            break
    return score


@rule("DegreeCentrality")
def degree(spark, inputs, o):
    e = edges_of(inputs[0])
    both = e.select(F.col("s").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("d", F.lit(0), F.lit(1)))
    if len(inputs) > 1:
        both = both.union(inputs[1].select(F.col(f"`{inputs[1].columns[0]}`"), F.lit(0), F.lit(0)))
    return both.groupBy("n").agg(F.sum(F.col("o") + F.col("i")).alias("total"), F.sum("o").alias("out"), F.sum("i").alias("in"))


@rule("ConnectedComponents")
def weak(spark, inputs, o):
    e = edges_of(inputs[0])
    found = connected_components(e, "s", "d")
    nodes = nodes_of(e, inputs[1] if len(inputs) > 1 else None)
    return nodes.join(found, nodes["n"] == found["node"], "left").select("n", F.coalesce("component", "n").alias("component"))


def reach_colours(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """``n, c``: the smallest node that reaches each node."""
    colour = nodes.select("n", F.col("n").alias("c"))
    while True:
        sent = e.join(colour, e["s"] == colour["n"]).select(F.col("d").alias("n"), "c")
        new = cut(colour.union(sent).groupBy("n").agg(F.min("c").alias("c")))
        if new.exceptAll(colour).isEmpty():
            return new
        colour = new


@rule("StronglyConnectedComponents", "SCC")
def strong(spark, inputs, o):
    e = cut(edges_of(inputs[0]).select("s", "d").where("s <> d").distinct())
    nodes = cut(nodes_of(e.withColumn("w", F.lit(1.0)), inputs[1] if len(inputs) > 1 else None).union(
        nodes_of(edges_of(inputs[0]))).distinct())
    done = None
    while not nodes.isEmpty():
        colour = reach_colours(e, nodes)
        # within a colour, what reaches the colour's own node forms its component
        a, b = colour.select(F.col("n").alias("s"), F.col("c").alias("cs")), colour.select(F.col("n").alias("d"), F.col("c").alias("cd"))
        inner = cut(e.join(a, "s").join(b, "d").where("cs = cd").select("s", "d", F.col("cs").alias("c")))
        hit = colour.where("n = c")
        while True:
            more = inner.join(hit.select(F.col("n").alias("d")), "d").select(F.col("s").alias("n"), "c")
            new = cut(hit.union(more).distinct())
            if new.count() == hit.count():
                break
            hit = new
        done = hit if done is None else cut(done.union(hit))
        nodes = cut(nodes.join(hit.select("n"), "n", "left_anti"))
        e = cut(e.join(nodes.withColumnRenamed("n", "s"), "s", "left_semi").join(nodes.withColumnRenamed("n", "d"), "d", "left_semi"))
    return done.select("n", F.col("c").alias("component")) if done is not None else nodes.select("n", F.col("n").alias("component"))


def simple(e: DataFrame) -> DataFrame:
    """Distinct undirected edges without loops, both ways."""
    one = e.where("s <> d").select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct()
    return one.select(F.col("a").alias("s"), F.col("b").alias("d")).union(one.select("b", "a"))


@rule("KCoreDecomposition")
def k_core(spark, inputs, o):
    """Waves of peeling: what has at most ``k`` neighbours left goes, and ``k`` rises to the least degree."""
    e = edges_of(inputs[0])
    nodes, left, k = nodes_of(e), cut(simple(e)), 0
    done = nodes.limit(0).select("n", F.lit(0).cast("bigint").alias("core"))
    waves = 0
    while True:
        deg = cut(left.groupBy("s").agg(F.count(F.lit(1)).alias("deg")))
        least = deg.agg(F.min("deg")).first()[0]
        if least is None:
            break
        k, waves = max(k, least), waves + 1
        gone = deg.where(F.col("deg") <= k).select(F.col("s").alias("n"), F.lit(k).cast("bigint").alias("core"))
        done = done.unionByName(gone)
        done = cut(done) if waves % 12 == 0 else done
        ends = gone.select("n")
        left = cut(left.join(ends.withColumnRenamed("n", "s"), "s", "left_anti").join(ends.withColumnRenamed("n", "d"), "d", "left_anti").select("s", "d"))
    return nodes.join(done, "n", "left").select("n", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))


@rule("ClusteringCoefficients")
def clustering(spark, inputs, o):
    e = edges_of(inputs[0])
    deg = e.where("s <> d").select(F.col("s").alias("n")).union(e.where("s <> d").select("d")).groupBy("n").agg(F.count(F.lit(1)).alias("degree"))
    one = simple(e)
    size = one.groupBy("s").agg(F.count(F.lit(1)).alias("k"))
    # every triangle is found once, from its node of least degree: wedges stay few at hubs
    ranked = cut(one.join(size, "s").withColumnRenamed("k", "ks").join(size.select(F.col("s").alias("d"), F.col("k").alias("kd")), "d").where(
        F.struct("ks", "s") < F.struct("kd", "d")).select("s", "d"))
    wedge = ranked.alias("a").join(ranked.alias("b"), F.col("a.s") == F.col("b.s")).where("a.d < b.d").select(
        F.col("a.s").alias("x"), F.col("a.d").alias("y"), F.col("b.d").alias("z"))
    closing = one.where("s < d").select(F.col("s").alias("y"), F.col("d").alias("z"))
    tri = wedge.join(closing, ["y", "z"])
    per = tri.select(F.explode(F.array("x", "y", "z")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("triangles"))
    out = nodes_of(e).join(deg, "n", "left").join(per, "n", "left").select(
        "n", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce("degree", F.lit(0)).alias("degree"))
    return out.select("n", F.when(F.col("degree") > 1, 2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("coefficient"), "triangles", "degree")


def distances(e: DataFrame, starts: DataFrame, paths: bool = True) -> DataFrame:
    """``start, n, cost, path`` of least cost; ties go to the least path."""
    best = cut(starts.select(F.col("n").alias("start"), "n", F.lit(0.0).alias("cost"), F.array("n").alias("path")))
    front = best
    while not front.isEmpty():
        step = front.join(e, front["n"] == e["s"]).select(
            "start", F.col("d").alias("n"), (F.col("cost") + F.col("w")).alias("cost"),
            F.concat("path", F.array("d")).alias("path") if paths else F.array("d").alias("path"))
        step = step.groupBy("start", "n").agg(F.min(F.struct("cost", F.size("path").alias("k"), "path")).alias("b")).select("start", "n", "b.cost", "b.path")
        old = best.select(F.col("start").alias("os"), F.col("n").alias("on"), F.col("cost").alias("oc"), F.col("path").alias("op"))
        better = step.join(old, (step["start"] == old["os"]) & (step["n"] == old["on"]), "left")
        tie = F.struct("cost", F.size("path"), "path") < F.struct("oc", F.size("op"), "op") if paths else F.col("cost") < F.col("oc")
        front = cut(better.where(F.col("oc").isNull() | tie).select("start", "n", "cost", "path"))
        best = cut(best.join(front.select("start", "n"), ["start", "n"], "left_anti").select("start", "n", "cost", "path").unionByName(front))
    return best


def column(df: DataFrame) -> DataFrame:
    return df.select(F.col(f"`{df.columns[0]}`").alias("n")).distinct()


@rule("ShortestPathBFS")
def shortest_bfs(spark, inputs, o):
    e = edges_of(inputs[0]).withColumn("w", F.lit(1.0))
    starts, ends = column(inputs[1]), column(inputs[2])
    found = distances(e.select("s", "d", "w").distinct(), starts)
    pairs = starts.select(F.col("n").alias("a")).crossJoin(ends.select(F.col("n").alias("b")))
    return pairs.join(found, (pairs["a"] == found["start"]) & (pairs["b"] == found["n"]), "left").select("a", "b", "path")


@rule("ShortestPathDijkstra")
def dijkstra(spark, inputs, o):
    e = edges_of(inputs[0], flag(o, "undirected", False)).groupBy("s", "d").agg(F.min("w").alias("w"))
    starts = column(inputs[1])
    ties = bool(flag(o, "keep_ties", False)) and len(inputs) > 2
    found = distances(e, starts)
    if len(inputs) < 3:
        return found.select("start", F.col("n").alias("end"), "cost", "path")
    pairs = starts.select(F.col("n").alias("a")).crossJoin(column(inputs[2]).select(F.col("n").alias("b")))
    if ties:
        return _all_shortest(spark, e, found, pairs)
    none = F.array().cast(found.schema["path"].dataType)
    return pairs.join(found, (pairs["a"] == found["start"]) & (pairs["b"] == found["n"]), "left").select(
        "a", "b", F.coalesce("cost", F.lit(float("inf"))).alias("cost"), F.coalesce("path", none).alias("path"))


def _all_shortest(spark, e, found, pairs):
    """Every least-cost path: backwards along edges on which costs add up."""
    d = found.select("start", "n", "cost")
    tight = cut(e.join(d.select("start", F.col("n").alias("s"), F.col("cost").alias("cs")), "s").join(
        d.select("start", F.col("n").alias("d"), F.col("cost").alias("cd")), ["start", "d"]).where((F.abs(F.col("cs") + F.col("w") - F.col("cd")) < 1e-9) & (F.col("s") != F.col("d"))).select("start", "s", "d"))
    goal = pairs.join(d, (pairs["a"] == d["start"]) & (pairs["b"] == d["n"])).select("start", F.col("b").alias("end"), "cost", F.array("b").alias("path"))
    done, front = None, cut(goal)
    while not front.isEmpty():
        full = front.where(F.element_at("path", 1) == F.col("start"))
        done = full if done is None else cut(done.unionByName(full))
        rest = front.where(F.element_at("path", 1) != F.col("start"))
        front = cut(rest.join(tight, (rest["start"] == tight["start"]) & (F.element_at(rest["path"], 1) == tight["d"])).where(~F.array_contains("path", F.col("s"))).select(
            rest["start"], "end", "cost", F.concat(F.array("s"), "path").alias("path")))
    lost = pairs.join(d, (pairs["a"] == d["start"]) & (pairs["b"] == d["n"]), "left_anti").select(
        F.col("a").alias("start"), F.col("b").alias("end"), F.lit(float("inf")).alias("cost"), F.array().cast(found.schema["path"].dataType).alias("path"))
    return (done.unionByName(lost) if done is not None else lost).select("start", "end", "cost", "path")


@rule("ShortestPathAStar")
def a_star(spark, inputs, o):
    """With an admissible heuristic the answer is the least-cost path itself."""
    return dijkstra(spark, [inputs[0], *inputs[2:4]], {})


@rule("ClosenessCentrality")
def closeness(spark, inputs, o):
    e = edges_of(inputs[0], flag(o, "undirected", False)).groupBy("s", "d").agg(F.min("w").alias("w"))
    nodes = nodes_of(e)
    n = nodes.count()
    found = distances(e, nodes, paths=False)
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("k"), F.sum("cost").alias("total")).select(
        F.col("start").alias("n"), F.when((F.col("total") > 0) & F.lit(n > 1), F.col("k") * F.col("k") / F.col("total") / F.lit(max(1, n - 1))).otherwise(0.0).alias("score"))


@rule("MinimumSpanningForestKruskal")
def forest(spark, inputs, o):
    """Boruvka rounds: every component takes its lightest edge out."""
    e = edges_of(inputs[0], negative=True).where("s <> d")
    e = cut(e.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.min(F.struct("w", "s", "d")).alias("e")).select("e.*", "a", "b"))
    chosen = e.limit(0)
    comp = nodes_of(e).select("n", F.col("n").alias("c"))
    while True:
        x = e.join(comp.select(F.col("n").alias("s"), F.col("c").alias("cs")), "s").join(comp.select(F.col("n").alias("d"), F.col("c").alias("cd")), "d").where("cs <> cd")
        key = F.struct("w", "a", "b")
        out = x.select(F.col("cs").alias("c"), key.alias("k"), "s", "d", "w", "a", "b").union(x.select("cd", key, "s", "d", "w", "a", "b"))
        best = cut(out.groupBy("c").agg(F.min_by(F.struct("w", "s", "d", "a", "b"), "k").alias("m")).select("m.*").distinct())
        if best.isEmpty():
            return chosen.select(F.col("s").alias("from"), F.col("d").alias("to"), F.col("w").alias("cost"))
        chosen = cut(chosen.select("w", "s", "d", "a", "b").unionByName(best))
        found = connected_components(chosen, "a", "b")
        nodes = nodes_of(e)
        comp = cut(nodes.join(found, nodes["n"] == found["node"], "left").select("n", F.coalesce("component", "n").alias("c")))


@rule("MinimumSpanningTreePrim")
def tree(spark, inputs, o):
    e = edges_of(inputs[0], negative=True)
    start = column(inputs[1]).orderBy("n").first() if len(inputs) > 1 else nodes_of(e).orderBy("n").first()
    if start is None:
        return forest(spark, inputs[:1], o)
    found = connected_components(e, "s", "d")
    root = found.where(F.col("node") == F.lit(start["n"])).first()
    if root is None:
        raise Refusal("the start node is not in the graph")
    inside = found.where(F.col("component") == F.lit(root["component"])).select(F.col("node").alias("from"))
    return forest(spark, inputs[:1], o).join(inside, "from", "left_semi").select("from", "to", "cost")


@rule("TopSort")
def top_sort(spark, inputs, o):
    e = cut(edges_of(inputs[0]).select("s", "d").distinct())
    left, levels, level = cut(nodes_of(e.withColumn("w", F.lit(1.0)))), None, 0
    while True:
        ready = left.join(e.select(F.col("d").alias("n")), "n", "left_anti")
        ready = cut(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            break
        levels = ready if levels is None else cut(levels.unionByName(ready))
        left = cut(left.join(ready, "n", "left_anti"))
        e = cut(e.join(ready.select(F.col("n").alias("s")), "s", "left_anti").select("s", "d"))
        level += 1
    if levels is None:
        return left.limit(0).select(F.lit(0).cast("bigint").alias("i"), "n")
    return numbered(levels.select("level", "n"), [F.col("level"), F.col("n")]).select((F.col("_row") - 1).alias("i"), "n")


@rule("LabelPropagation")
def label_propagation(spark, inputs, o):
    """Synchronous rounds; a node takes the heaviest label near it, ties to the smallest."""
    e = cut(edges_of(inputs[0], True))
    lab = cut(nodes_of(e).select("n", F.col("n").alias("l")))
    for _ in range(int(flag(o, "max_iter", 10))):
        votes = e.join(lab, e["d"] == lab["n"]).groupBy("s", "l").agg(F.sum("w").alias("v")).union(lab.select("n", "l", F.lit(0.5)))
        pick = votes.groupBy("s", "l").agg(F.sum("v").alias("v")).groupBy("s").agg(F.min_by("l", F.struct(-F.col("v"), F.col("l"))).alias("l"))
        new = cut(pick.select(F.col("s").alias("n"), "l"))
        if new.exceptAll(lab).isEmpty():
            break
        lab = new
    return lab.select("l", "n")


@rule("BetweennessCentrality")
def betweenness(spark, inputs, o):
    edges = collected(edges_of(inputs[0], flag(o, "undirected", False)).groupBy("s", "d").agg(F.min("w").alias("w")))
    kind = node_type(edges_of(inputs[0]))
    out: dict = defaultdict(list)
    for s, d, w in edges:
        out[s].append((d, w))
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    shared = spark.sparkContext.broadcast(dict(out))  # bounded by MAX_EDGES

    def run(batches):
        import pandas as pd

        adj = shared.value
        for pdf in batches:
            for src in pdf["n"]:
                dist, sigma, before, order = {src: 0.0}, defaultdict(float, {src: 1.0}), defaultdict(list), []
                heap, fixed = [(0.0, src)], set()
                while heap:
                    c, v = heapq.heappop(heap)
                    if v in fixed:
                        continue
                    fixed.add(v)
                    order.append(v)
                    for x, w in adj.get(v, ()):
                        nc = c + w
                        if x not in dist or nc < dist[x] - 1e-12:
                            dist[x], sigma[x], before[x] = nc, sigma[v], [v]
                            heapq.heappush(heap, (nc, x))
                        elif abs(nc - dist[x]) <= 1e-12 and x not in fixed and v != x:
                            sigma[x] += sigma[v]
                            before[x].append(v)
                share: dict = defaultdict(float)
                for v in reversed(order):
                    for p in before[v]:
                        share[p] += sigma[p] / sigma[v] * (1 + share[v])
                rows = [(v, x) for v, x in share.items() if v != src]
                yield pd.DataFrame(rows, columns=["n", "x"])

    base = frame(spark, [(n,) for n in nodes], [kind]).toDF("n")
    part = base.repartition(max(1, min(200, len(nodes) // 16)), "n").mapInPandas(run, f"n {kind}, x double").groupBy("n").agg(F.sum("x").alias("x"))
    return base.join(part, "n", "left").select("n", F.coalesce("x", F.lit(0.0)).alias("score"))


@rule("CommunityDetectionLouvain")
def louvain(spark, inputs, o):
    rows = collected(edges_of(inputs[0], True))
    kind = node_type(edges_of(inputs[0]))
    ids = {n: k for k, n in enumerate(sorted({x for s, d, _ in rows for x in (s, d)}))}
    adj: list[dict] = [defaultdict(float) for _ in ids]
    for s, d, w in rows:
        adj[ids[s]][ids[d]] += w
    member = [[k] for k in range(len(ids))]
    least, rounds = float(flag(o, "delta", 1e-4)), int(flag(o, "max_iter", 10))
    while len(adj) > 2:
        total = sum(sum(a.values()) for a in adj) or 1.0
        com, deg = list(range(len(adj))), [sum(a.values()) for a in adj]
        vol = list(deg)
        moved_any = False
        for _ in range(rounds):
            moved = False
            for v in range(len(adj)):
                near: dict = defaultdict(float)
                for x, w in adj[v].items():
                    if x != v:
                        near[com[x]] += w
                vol[com[v]] -= deg[v]
                stay = near.get(com[v], 0.0) - vol[com[v]] * deg[v] / total
                best, gain = com[v], stay
                for c in sorted(near):
                    g = near[c] - vol[c] * deg[v] / total
                    if g > gain + least:
                        best, gain = c, g
                moved |= best != com[v]
                com[v] = best
                vol[best] += deg[v]
            moved_any |= moved
            if not moved:
                break
        if not moved_any:
            break
        names = {c: k for k, c in enumerate(sorted(set(com)))}
        new: list[dict] = [defaultdict(float) for _ in names]
        for v, a in enumerate(adj):
            for x, w in a.items():
                new[names[com[v]]][names[com[x]]] += w
        for m in member:
            m.append(names[com[m[-1]]])
        adj = new
    depth = flag(o, "keep_depth", None)
    labels = lambda m: m[:0:-1][: int(depth)] if depth is not None else m[:0:-1]
    back = {k: n for n, k in ids.items()}
    return frame(spark, [(labels(m), back[k]) for k, m in enumerate(member)], ["array<bigint>", kind])


@rule("MaxFlow")
def max_flow(spark, inputs, o):
    rows = collected(edges_of(inputs[0]))
    kind = node_type(edges_of(inputs[0]))
    s, t = column(inputs[1]).first()["n"], column(inputs[2]).first()["n"]
    cap: dict = defaultdict(lambda: defaultdict(float))
    given: dict = defaultdict(float)
    for a, b, w in rows:
        if a != b:
            cap[a][b] += w
            cap[b][a] += 0.0
            given[a, b] += w
    while True:
        before, queue = {s: None}, deque([s])
        while queue and t not in before:
            v = queue.popleft()
            for x in sorted(cap[v]):
                if cap[v][x] > 1e-12 and x not in before:
                    before[x] = v
                    queue.append(x)
        if t not in before or s == t:
            break
        path, x = [], t
        while before[x] is not None:
            path.append((before[x], x))
            x = before[x]
        room = min(cap[a][b] for a, b in path)
        for a, b in path:
            cap[a][b] -= room
            cap[b][a] += room
    side, queue = {s}, deque([s])
    while queue:
        v = queue.popleft()
        for x in cap[v]:
            if cap[v][x] > 1e-12 and x not in side:
                side.add(x)
                queue.append(x)
    return frame(spark, sorted((a, b, w) for (a, b), w in given.items() if a in side and b not in side), [kind, kind, "double"])


@rule("MaximalCliques")
def cliques(spark, inputs, o):
    rows = collected(edges_of(inputs[0]))
    kind, most = node_type(edges_of(inputs[0])), int(flag(o, "max_cliques", 1 << 20))
    adj: dict = defaultdict(set)
    for a, b, _ in rows:
        adj[a], adj[b]
        if a != b:
            adj[a].add(b)
            adj[b].add(a)
    out: list = []
    stack = [(frozenset(), set(adj), set())]
    while stack:
        r, p, x = stack.pop()
        if not p and not x:
            out.append(sorted(r))
            if len(out) > most:
                raise LimitExceeded("too many cliques")
            continue
        pivot = max(p | x, key=lambda v: len(adj[v] & p))
        for v in list(p - adj[pivot]):
            stack.append((r | {v}, p & adj[v], x & adj[v]))
            p = p - {v}
            x = x | {v}
    return frame(spark, [(k, n) for k, c in enumerate(sorted(out)) for n in c], ["bigint", kind])


def _least(adj, s, t, banned_edges=frozenset(), banned_nodes=frozenset()):
    heap, done = [(0.0, [s])], set()
    while heap:
        c, path = heapq.heappop(heap)
        v = path[-1]
        if v == t:
            return c, path
        if v in done:
            continue
        done.add(v)
        for x, w in adj.get(v, ()):
            if x not in done and x not in banned_nodes and (v, x) not in banned_edges:
                heapq.heappush(heap, (c + w, [*path, x]))
    return None


@rule("KShortestPathYen")
def yen(spark, inputs, o):
    if "k" not in o:
        raise TypeRefusal("KShortestPathYen needs k")
    rows = collected(edges_of(inputs[0], flag(o, "undirected", False)).groupBy("s", "d").agg(F.min("w").alias("w")))
    kind, adj, k = node_type(edges_of(inputs[0])), defaultdict(list), int(o["k"])
    for a, b, w in rows:
        adj[a].append((b, w))
    cost = {(a, b): w for a, b, w in rows}
    out = []
    for s in sorted(r["n"] for r in column(inputs[1]).collect()):
        for t in sorted(r["n"] for r in column(inputs[2]).collect()):
            first = _least(adj, s, t)
            found, spare = ([first] if first else []), []
            while found and len(found) < k:
                path = found[-1][1]
                for i in range(len(path) - 1):
                    root = path[: i + 1]
                    banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root and len(p) > i + 1}
                    tail = _least(adj, path[i], t, banned, frozenset(root[:-1]))
                    if tail:
                        whole = root[:-1] + tail[1]
                        c = sum(cost[e] for e in zip(whole, whole[1:]))
                        if (c, whole) not in spare and (c, whole) not in found:
                            heapq.heappush(spare, (c, whole))
                if not spare:
                    break
                found.append(heapq.heappop(spare))
            out += [(s, t, c, p) for c, p in found]
    return frame(spark, out, [kind, kind, "double", f"array<{kind}>"])


def _condition(spark, nodes: DataFrame, o) -> set | None:
    """Nodes whose row meets the condition option, over the node relation's columns."""
    cond = o.get("condition")
    if cond is None or isinstance(cond, bool):
        return None
    from tessera.plans.engine import Frame, mangle

    df = nodes.toDF(*[mangle(c) for c in nodes.columns])
    f = Frame(spark, df, tuple(nodes.columns))
    return {r[0] for r in df.where(f.expr(cond)).select(df.columns[0]).collect()}


def _search(spark, inputs, o, deep: bool):
    rows = collected(edges_of(inputs[0]))
    kind, adj = node_type(edges_of(inputs[0])), defaultdict(list)
    for a, b, _ in rows:
        if b not in adj[a]:
            adj[a].append(b)
    good, most = _condition(spark, inputs[1], o), int(flag(o, "limit", 1))
    starts = sorted(r["n"] for r in column(inputs[2] if len(inputs) > 2 else inputs[1]).collect())
    seen: set = set()
    out = []
    for s in starts:
        if s in seen or len(out) >= most:
            continue
        before, line = {s: None}, deque([s])
        if not deep:
            seen.add(s)
        while line and len(out) < most:
            v = line.pop() if deep else line.popleft()
            if deep:
                if v in seen:
                    continue
                seen.add(v)
            if v != s and (good is None or v in good):
                route, x = [], v
                while x is not None:
                    route.append(x)
                    x = before[x]
                out.append((s, v, route[::-1]))
            for x in (reversed(adj.get(v, [])) if deep else adj.get(v, [])):
                if x not in seen:
                    before[x] = v
                    line.append(x)
                    if not deep:
                        seen.add(x)
    return frame(spark, out, [kind, kind, f"array<{kind}>"])


@rule("BreadthFirstSearch", "BFS")
def bfs(spark, inputs, o):
    return _search(spark, inputs, o, False)


@rule("DepthFirstSearch", "DFS")
def dfs(spark, inputs, o):
    return _search(spark, inputs, o, True)


@rule("RandomWalk")
def random_walk(spark, inputs, o):
    if "steps" not in o:
        raise TypeRefusal("RandomWalk needs steps")
    rows = collected(edges_of(inputs[0]))
    kind, adj = node_type(edges_of(inputs[0])), defaultdict(list)
    for a, b, w in rows:
        adj[a].append((b, w))
    rng, out, n = random.Random(int(flag(o, "seed", 0))), [], 0
    for s in sorted(r["n"] for r in column(inputs[2]).collect()):
        for _ in range(int(flag(o, "iterations", 1))):
            path = [s]
            for _ in range(int(o["steps"])):
                near = adj.get(path[-1])
                if not near:
                    break
                path.append(rng.choices([x for x, _ in near], [w or 1e-12 for _, w in near])[0])
            out.append((n, s, path))
            n += 1
    return frame(spark, out, ["bigint", kind, f"array<{kind}>"])


@rule("ReorderSort")
def reorder_sort(spark, inputs, o):
    """Rank-prefixed rows: ranks with gaps for ties, or row numbers with ``break_ties``."""
    df = inputs[0]
    cols = [F.col(f"`{c}`") for c in df.columns]
    down = bool(flag(o, "descending", False))
    by = flag(o, "sort_by", list(range(len(cols))))
    by = [by] if not isinstance(by, list) else by
    x = ranked(df, [(cols[k], down) for k in by], [c.asc_nulls_first() for c in cols])
    number = F.col("_row") if flag(o, "break_ties", False) else F.col("_rank")
    skip, take = int(flag(o, "skip", 0)), int(flag(o, "take", 0))
    x = x.where(F.col("_row") > skip)
    x = x.where(F.col("_row") <= skip + take) if take else x
    return x.select(number.alias("rank"), *[cols[k] for k in flag(o, "out", list(range(len(cols))))])


@rule("Constant")
def constant_rule(spark, inputs, o):
    from tessera.plans.engine import rows_frame

    rows = o["data"]
    return rows_frame(spark, rows, len(rows[0]) if rows else 0)


@rule("CsvReader")
def csv_rule(spark, inputs, o):
    from tessera.sources.files import read_csv

    return read_csv(spark, **o)


@rule("JsonReader")
def json_rule(spark, inputs, o):
    from tessera.sources.files import read_json

    return read_json(spark, **o)
