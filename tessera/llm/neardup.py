"""Near-duplicate documents by bottom-k sketches of one hash function.

1. One pass takes each whole text to its set of word shingles, hashed once,
   and keeps the ``k`` smallest hashes (the sketch), the set's size and a
   fingerprint of the set.  Documents with equal sets are one class from here
   on: copies by the thousand count as one representative.
2. Inverted lists.  Sketches of sets at the wanted similarity share at least
   ``overlap`` values but for a chance below 1e-9, so it is enough to list each
   set under its ``K - overlap + 1`` rarest values: two similar sets meet in
   one of those lists, and values of passages that many texts share drop out.
3. Overlaps.  The few pairs of short lists, and in long lists the pairs with
   one set of the list (a list never becomes all its pairs), are kept where the
   union-sketch estimate reaches ``overlap / K``; each sketch travels once per
   distinct pair, not per list.  Sets of a long list that this leaves apart are
   estimated against the rest of the list.  The connected components of what is
   kept are neighbourhoods: no link leads out of one.
4. Exact links.  Each neighbourhood gathers the texts of its sets once (the ids
   are broadcast while they are few, so other texts are not moved), counts
   exact intersections over the postings of its shingles, and gives back a
   spanning forest of the pairs that reach the threshold.
Lists of over ``BLOCK`` sets, and neighbourhoods of more sets, shingles or bytes
than a block takes, are verified as ``linked`` says.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; texts shorter than a shingle are one shingle; repeated rows are
linked as equal sets; all texts of an id that has several count as its own; null
ids take no part in components (their component is null, and they are kept); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.llm.common import fresh, give_back, scan
from tessera.operators.components import connected_components
from tessera.operators.lineage import few, free, store

K, SHORT, BLOCK, PIVOTS, SHINGLES, BYTES = 64, 16, 2048, 4, 1_000_000, 8_000_000
LARGE = 1_000_000  # bytes of a group that are worth giving back at once
SKETCH = StructType([
    StructField("doc_id", LongType()), StructField("n", LongType()), StructField("f1", LongType()),
    StructField("f2", LongType()), StructField("bytes", LongType()), StructField("sketch", ArrayType(LongType())),
])


class _Words(dict):
    """Hashes of words, for one task: kept by the worker they would stay through all later stages."""

    def __missing__(self, w):
        if len(self) >= 200_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def shingles(text: str | None, size: int, hashes: _Words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    x = np.full(n, np.uint64(min(len(h), size)))
    for j in range(min(size, len(h))):
        x = (x ^ h[j: j + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _sketch_rows(size: int, k: int):
    def start():
        weigh, hashes = np.uint64(0xC2B2AE3D27D4EB4F), _Words()

        def one(i, text):
            s = shingles(text, size, hashes)
            mixed = s * weigh
            f1 = int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0
            f2 = int(np.bitwise_xor.reduce(mixed ^ (mixed >> np.uint64(31))).astype(np.int64)) if len(s) else 0
            yield i, len(s), f1, f2, len((text or "").encode()), (s[:k] ^ np.uint64(1 << 63)).view(np.int64).tolist()

        return one

    return start


PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


class Overlaps:
    """Sizes of intersections among sets, by postings of their shared values."""

    def __init__(self, values: list[np.ndarray]):
        self.n, sizes = len(values), np.array([len(v) for v in values], np.int64)
        _, self.code, often = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(self.n), sizes)
        self.lists = owner[np.argsort(self.code, kind="stable")]
        self.often, self.start = often, np.concatenate([[0], np.cumsum(often)])
        self.at = np.concatenate([[0], np.cumsum(sizes)])

    def of(self, i: int) -> np.ndarray:
        """How many values set ``i`` shares with every set."""
        own = self.code[self.at[i]: self.at[i + 1]]
        own = own[self.often[own] > 1]
        k = self.often[own]
        rows = np.repeat(self.start[own] - np.cumsum(k) + k, k) + np.arange(k.sum())
        return np.bincount(self.lists[rows], minlength=self.n)


def forest(t: pa.Table, values: list[np.ndarray], fits, confirm=None) -> pa.Table:
    """Edges that join what links join; pairs already in one component are skipped.

    ``side``: 0 asks and answers, 1 asks, 2 answers.  ``fits(i, shared)`` masks
    the rows that may link to row ``i``; ``confirm(i, j)`` has the last word.
    """
    ids, side = t["rep"].to_numpy(), t["side"].to_numpy()
    comp = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
    shared, answers, edges = None, side != 1, []
    for i in np.flatnonzero(side != 2).tolist():
        apart = answers & (comp != comp[i])
        if not apart.any():
            continue
        shared = shared or Overlaps(values)
        near = np.flatnonzero(apart & fits(i, shared.of(i)))
        if confirm is None:
            found, first = np.unique(comp[near], return_index=True)
            edges += [(ids[i], ids[j]) for j in near[first]]
            comp[np.isin(comp, found)] = comp[i]
        else:
            for j in near.tolist():
                if comp[j] != comp[i] and confirm(i, j):
                    edges.append((ids[i], ids[j]))
                    comp[comp == comp[j]] = comp[i]
    x = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"a": x.min(axis=1) if len(x) else x[:, 0], "b": x.max(axis=1) if len(x) else x[:, 1]})


def estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Union-sketch estimate of the similarity of two sets."""
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / max(1, len(union)))


def _by_sketch(k: int, least: float, num: int, den: int):
    """Rows of a long list -> edges between those whose estimate is high enough."""

    def run(t: pa.Table) -> pa.Table:
        n, sk = t["n"].to_numpy(), [np.asarray(x, np.int64) for x in t["sketch"].to_pylist()]
        lens = np.array([len(x) for x in sk])

        def fits(i, both):  # a cheap bound first: common values can only be fewer within the union's sketch
            return (both >= least * np.minimum(k, lens + lens[i] - both)) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))

        return forest(t, sk, fits, lambda i, j: estimate(sk[i], sk[j], k) >= least)

    return run


def _by_shingles(size: int, num: int, den: int):
    """Rows of a neighbourhood -> edges that reach the threshold on full sets."""
    hashes = _Words()  # each task reads an empty one of its own

    def run(t: pa.Table) -> pa.Table:
        sets = [shingles(x, size, hashes) for x in t["text"].to_pylist()]
        n = np.array([len(x) for x in sets])
        return forest(t, sets, lambda i, both: (both > 0) & (den * both >= num * (n + n[i] - both)))

    return run


def _lean(check):
    """``check`` that gives back what a large group took."""

    def run(t: pa.Table) -> pa.Table:
        edges = check(t)
        if t.nbytes > LARGE:
            give_back()
        return edges

    return run


def linked(rows: DataFrame, key: str, check, sets: int) -> DataFrame:
    """Edges ``a, b`` with the components of all links inside each group of ``key``.

    ``rows`` has ``key``, ``rep``, ``blocks`` (how many its group needs) and what
    ``check`` reads.  Groups of several blocks are first verified block by block,
    with the same few pivots as guests in every block: that joins uniform groups
    as a whole.  Only what stays outside a group's largest component is then
    verified against the other blocks.  The edges are stored; ``sets`` is about
    how many there may be.
    """
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rows = rows.withColumn("x", own)
    large = rows.where("blocks > 1")
    some = not large.select("rep").isEmpty()
    if some:
        seeds = [F.min_by("rep", F.xxhash64("rep", F.lit(s))) for s in range(PIVOTS)]
        pivots = large.groupBy(key).agg(F.array_distinct(F.array(*seeds)).alias("rep")).select(key, F.explode("rep").alias("rep"))
        guests = large.join(pivots, [key, "rep"]).withColumnRenamed("x", "own").withColumn(
            "x", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int")))).where("x <> own").drop("own")
        whole = rows.unionByName(guests)
    else:
        whole = rows
    first = store(whole.withColumn("side", F.lit(0)).withColumn("label", F.col("rep")).groupBy(key, "x").applyInArrow(_lean(check), PAIR), sets)
    return first.unionByName(store(_left_over(large.drop("x"), key, first, check), sets)) if some else first


def _left_over(rows: DataFrame, key: str, edges: DataFrame, check, details: DataFrame | None = None) -> DataFrame:
    """Edges that join, within a group of ``key``, what ``edges`` leaves outside its largest component.

    ``details`` adds what ``check`` reads by ``rep`` to the rows that are still to be verified.
    """
    label = connected_components(edges, "a", "b", stored=True).withColumnRenamed("node", "rep")
    left = rows.join(label, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    sizes = left.groupBy(key, "label").agg(F.count(F.lit(1)).alias("c"), F.first("blocks").alias("blocks")).groupBy(key).agg(
        F.max_by("label", F.struct("c", "label")).alias("top"), F.max("c").alias("most"), F.sum("c").alias("total"), F.first("blocks").alias("all"))
    part = lambda c: F.greatest(F.lit(1), F.ceil(F.col("all") * c / F.col("total"))).cast("int")
    sizes = sizes.where("most < total").select(key, "top", part(F.col("total") - F.col("most")).alias("rb"), part(F.col("most")).alias("mb"))
    left = left.join(sizes, key).withColumn("r", F.pmod(F.xxhash64("rep"), F.col("rb")).cast("int")).withColumn("m", F.pmod(F.xxhash64("rep"), F.col("mb")).cast("int"))
    left = left.join(details, "rep") if details is not None else left
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside, rest = left.where("label = top"), left.where("label <> top")
    both = inside.withColumn("side", F.lit(2)).withColumn("r", to("rb")).unionByName(rest.withColumn("side", F.lit(1)).withColumn("m", to("mb")))
    # blocks of the rest among themselves: r <= m
    pairs = rest.withColumn("o", to("rb")).withColumn("side", F.when(F.col("o") == F.col("r"), 0).when(F.col("r") < F.col("o"), 1).otherwise(2))
    pairs = pairs.withColumn("m", -1 - F.greatest("r", "o")).withColumn("r", F.least("r", "o")).drop("o")
    return both.unionByName(pairs).groupBy(key, "r", "m").applyInArrow(_lean(check), PAIR)


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, size: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row; linked at ``den*both >= num*union``."""
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sk = store(scan(base, ["doc_id", "text"], _sketch_rows(size, K), SKETCH))
    classes = store(sk.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.max("bytes").alias("bytes")))
    sets = classes.count()
    hoods = connected_components(_candidates(classes, num, den, sets), "a", "b", stored=True).select(F.col("node").alias("rep"), F.col("component").alias("hood"))
    sized = hoods.join(classes.select("rep", "n", "bytes"), "rep")
    room = sized.groupBy("hood").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / SHINGLES), F.ceil(F.sum("bytes") / BYTES)).alias("blocks"))
    members = store(hoods.join(room, "hood").select("rep", "hood", "blocks"), sets)
    n = members.count()
    texts = base.withColumnRenamed("doc_id", "rep").join(few(members, n), "rep")
    if sk.select(F.col("doc_id").alias("rep")).join(few(members, n), "rep").count() > n:  # an id with several rows: all its texts count
        texts = texts.dropDuplicates(["rep", "text"])
    comps = store(connected_components(linked(texts, "hood", _by_shingles(size, num, den), sets), "a", "b", stored=True), sets)
    labelled = classes.select("n", "f1", "f2", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select(
        "n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    free(members)
    out = sk.select("doc_id", "n", "f1", "f2").join(labelled, ["n", "f1", "f2"], "left")
    comp = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def least_overlap(k: int, share: float, miss: float = 1e-9) -> int:
    """Values that sketches of ``k`` share at least, but for a chance of ``miss``, at similarity ``share``."""
    below = 0.0
    for m in range(k + 1):
        below += math.comb(k, m) * share**m * (1 - share) ** (k - m)
        if below > miss:
            return m
    return k


def _candidates(classes: DataFrame, num: int, den: int, sets: int) -> DataFrame:
    """Pairs ``a, b`` of representatives whose components hold every link."""
    overlap = least_overlap(K, num / den)
    each = classes.select("rep", F.explode("sketch").alias("v"))
    often = each.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = Window.partitionBy("rep")
    ranked = each.join(often, "v").withColumn("place", F.row_number().over(mine.orderBy("df", "v"))).withColumn("shared", F.count(F.lit(1)).over(mine))
    ranked = ranked.join(classes.select("rep", "n", F.size("sketch").alias("len")), "rep")
    # sets smaller than a sketch are held whole
    need = F.least(F.ceil(F.col("len") * num / den), F.lit(overlap))
    rare = F.col("place") <= F.col("len") - need + 1 - (F.col("len") - F.col("shared"))
    lists = store(ranked.where(rare).select("rep", "v", "n"), 4 * sets)
    sizes = lists.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    lists = lists.join(sizes, "v")
    close = den * F.least("n", "m") >= num * F.greatest("n", "m")
    brief = lists.where(F.col("c") <= SHORT).select("v", "rep", "n")
    short = brief.select("v", F.col("rep").alias("a"), "n").join(brief.select("v", F.col("rep").alias("b"), F.col("n").alias("m")), "v").where(
        close & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    # a long list gives the pairs with one of its sets: the same set in most lists of a group of near copies, so few pairs are distinct
    long = lists.where(F.col("c") > SHORT)
    pivots = long.groupBy("v").agg(F.min(F.struct(F.xxhash64("rep"), "rep", F.col("n").alias("m"))).alias("p")).select("v", F.col("p.rep").alias("b"), F.col("p.m").alias("m"))
    spokes = long.join(pivots, "v").where(close & (F.col("rep") != F.col("b"))).select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
    near = store(_likely(short.unionByName(spokes).distinct(), classes, overlap), sets)
    # what a pivot does not join to its list is verified against the rest of the list
    rows = long.select("v", "rep", "n", F.ceil(F.col("c") / BLOCK).alias("blocks"))
    if not rows.isEmpty():
        near = near.unionByName(store(_left_over(rows, "v", near, _by_sketch(K, overlap / K, num, den), classes.select("rep", "sketch")), sets))
    return near


def _likely(pairs: DataFrame, classes: DataFrame, overlap: int) -> DataFrame:
    """Pairs whose union-sketch estimate reaches ``overlap / K``."""
    c = classes.select("rep", "sketch")
    both = pairs.join(c.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(
        c.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    e = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return both.where(e >= overlap / K).select("a", "b")


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, size: int = 5, id_col="doc_id", text_col="text") -> DataFrame:
    """Rows of ``docs`` without near-duplicates of smaller id; of rows with one id and equal texts one stays.

    Rows with a null id all stay.  No text is shuffled while the ids that go, or
    that occur several times, are few enough to broadcast.
    """
    gone_id = fresh("id", docs)
    gone = store(near_duplicates(docs, num, den, size, id_col, text_col).where("not kept").select(F.col("doc_id").alias(gone_id)).distinct(), docs.count())
    rest = docs.join(few(gone, gone.count()), docs[id_col].cast("long") == gone[gone_id], "left_anti")
    several = docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].cast("long").alias(gone_id)).count().where("count > 1").select(gone_id)
    n = several.count()
    if not n:
        return rest
    several = store(several, n)
    on, cols = rest[id_col].cast("long") == several[gone_id], docs.columns
    once = rest.join(few(several, n), on, "left_anti")
    return once.unionByName(rest.join(few(several, n), on, "left_semi").dropDuplicates([id_col, text_col]).select(*cols))
