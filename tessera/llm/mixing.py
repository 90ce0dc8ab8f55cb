"""Mixing sources to target weights by entropy balancing, in DataFrame operations.

Targets.  A source's target is its share by weight of ``share`` times all
words, held at ``most`` times its own words; the excess goes to the others by
weight until none is above.  That is the water level L with
``sum(min(most * S, L * w)) = share * sum(S)``, found from running sums over
the sources in the order in which they fill up.

Rates.  Among all document rates r in [0, most] that meet the targets, entropy
balancing takes the one nearest to "every document once", in relative entropy
with documents weighted by ``size / z``, where ``z = (size / mean)^tilt`` with sizes
rounded to sixteenths of octaves.  Its dual is convex, with one multiplier t
per source and ``r = min(most, exp(t * z))``.  Documents are reduced to words
per (source, size bin) by one aggregation; Newton steps, guarded by bisection,
then run on all sources in parallel over those few hundred bins each.

Copies.  Within blocks of about ``block`` documents of one source, dealt by a
hash of the id, documents go from longest to shortest; each gets the whole
number of copies nearest to its rate plus the words still owed, so what a block
takes differs from its target by about half of its shortest document.  Blocks
are small whatever the size of a source, so a source with a third of all rows
is spread like any other.  The same input gives the same copies.

Defined results: null text has size 0 and is taken 0 words; a null source is a
source, last in order; a source without words has target 0; repeated rows are
documents of their own; null ids are told apart by their whole rows; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import fresh
from tessera.operators.lineage import few, store

WORD = r"[^\x20\x09-\x0D]+"
#: Sources of which the multipliers are broadcast, some MB; more are joined.
MOST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Number of runs outside ASCII white space, null as 0."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("at", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("at").cast("int") + 1))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    w = (
        w.withColumn("full", F.coalesce(F.sum(most * F.col("source_size")).over(upto), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("want", share * F.sum("source_size").over(all_))
        .withColumn("level", (F.col("want") - F.col("full")) / F.col("open"))
    )
    # the first source whose share at its level is within its bound sets the level; levels only fall after it
    fits = F.col("level") * F.col("weight") <= most * F.col("source_size")
    w = w.withColumn("level", F.max(F.when(fits & (F.col("source_size") > 0), F.col("level"))).over(all_))
    target = F.least(most * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), most * F.col("source_size")))
    return w.select("source", "source_size", target.cast("double").alias("target"))


def size_bin(size: Column) -> Column:
    """Sixteenths of octaves: at most some hundreds of bins, however many sizes."""
    return F.floor(F.log2(size.cast("double")) * 16).cast("int")


def covariate(bin_: Column, mean: Column, tilt: float) -> Column:
    return F.pow(F.pow(F.lit(2.0), (bin_ + 0.5) / 16) / mean, F.lit(float(tilt)))


def rate_of(t: Column, z: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(t * z, F.lit(50.0))))


def multipliers(bins: DataFrame, goal: DataFrame, tilt: float, most: float = 2.0, steps: int = 60, tol: float = 1e-9) -> DataFrame:
    """``source, source_size, target, mean, t``: dual multipliers by guarded Newton steps.

    ``bins``: ``source, bin, words, docs``, the documents above size 0.  All
    sources step at the same time, each over its own few hundred bins.
    """
    own = bins.groupBy("source").agg(
        (F.sum("words") / F.sum("docs")).alias("mean"), F.sort_array(F.collect_list(F.struct("bin", "words"))).alias("bins"))
    x = goal.join(own.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.coalesce("bins", F.array().cast("array<struct<bin:int,words:bigint>>")).alias("bins"))

    def both(t: Column) -> Column:
        """Words taken at multiplier t, and their derivative."""
        def add(acc, b):
            z = covariate(b["bin"], F.col("mean"), tilt)
            got = b["words"] * rate_of(t, z, most)
            return F.struct((acc["got"] + got).alias("got"), (acc["slope"] + F.when(t * z < F.log(F.lit(float(most))), got * z).otherwise(0.0)).alias("slope"))

        return F.aggregate("bins", F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("slope")), add)

    def step(acc, _):
        seen = F.transform(F.array(both(acc["t"])), lambda v: _move(acc, v["got"] - F.col("target"), v["slope"], tol * F.greatest(F.col("target"), F.lit(1.0))))
        return F.element_at(seen, 1)

    start = F.struct(F.lit(0.0).alias("t"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"))
    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["t"])
    return x.select("source", "source_size", "target", "mean", t.alias("t"))


def _move(acc: Column, gap: Column, slope: Column, near: Column) -> Column:
    """One Newton step, or a bisection where Newton would leave the bracket."""
    lo, hi = F.when(gap < 0, acc["t"]).otherwise(acc["lo"]), F.when(gap >= 0, acc["t"]).otherwise(acc["hi"])
    newton = acc["t"] - F.when(slope > 0, gap / slope)
    to = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
    done = F.abs(gap) <= near
    return F.struct(F.when(done, acc["t"]).otherwise(to).alias("t"), F.when(done, acc["lo"]).otherwise(lo).alias("lo"),
                    F.when(done, acc["hi"]).otherwise(hi).alias("hi"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, tilt: float = 0.25, block: int = 200,
        id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, row, nth`` of every row.

    ``row`` is a hash of the whole row and ``nth`` numbers equal rows.
    """
    # the text is reduced to its size and a hash before rows are counted: it is never shuffled
    small = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
                        word_count(docs[text_col]).alias("size"), _row_hash(docs).alias("row"))
    n = docs.count()
    equal = small.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("times"))
    rows = store(equal.select("doc_id", "row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth"), "source", "size"), n)
    bins = rows.where("size > 0").groupBy("source", size_bin(F.col("size")).alias("bin")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    goal = targets(sizes.select("source", "source_size"), weights, share, most)
    t = multipliers(bins, goal, tilt, most)
    t = t.join(sizes.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    t = store(t.select(F.col("source").alias("s"), "source_size", "target", "mean", "t", F.ceil(F.col("docs") / block).alias("blocks")), min(n, 10 * MOST_SOURCES))
    # a row per source: few, so that a hot source is not gathered by the join; beyond, Spark splits skewed joins itself
    t = F.broadcast(t) if t.count() <= MOST_SOURCES else t
    z = covariate(size_bin(F.greatest("size", F.lit(1))), F.col("mean"), tilt)
    rate = F.when(F.col("size") > 0, rate_of(F.col("t"), z, most)).otherwise(F.lit(1.0))
    each = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "source_size", "target", F.pmod(F.xxhash64("doc_id", "row", "nth"), F.col("blocks")).alias("block"),
        F.struct((-F.col("size")).alias("minus"), "doc_id", "row", "nth", rate.alias("rate")).alias("d"))
    blocks = each.groupBy("source", "block").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list("d")).alias("ds"))

    def deal(acc, d):
        size = (-d["minus"]).cast("double")
        want = d["rate"] * size + acc["owed"]
        n = F.when(size > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.floor(want / size + F.lit(0.5)).cast("double")))).otherwise(
            F.lit(1.0))
        return F.struct((want - n * size).alias("owed"), F.concat(acc["copies"], F.array(n.cast("int"))).alias("copies"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("copies"))
    dealt = blocks.withColumn("copies", F.aggregate("ds", start, deal, lambda a: a["copies"]))
    x = dealt.select("source_size", "target", F.explode(F.arrays_zip("ds", "copies")).alias("x"))
    return x.select(
        F.col("x.ds.doc_id").alias("doc_id"), (-F.col("x.ds.minus")).alias("size"), "source_size", "target",
        (F.col("x.copies") * -F.col("x.ds.minus")).alias("taken"), F.col("x.copies").alias("copies"), F.col("x.ds.row").alias("row"), F.col("x.ds.nth").alias("nth"))


def _row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])


def mixed(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Copies are found by id and row hash.  While they are few enough their table
    is broadcast and no text moves; beyond that each text is shuffled once.
    Equal rows are one row here, taken as often as all of them together.
    """
    own_id, own_row, copies = (fresh(n, docs) for n in ("id", "row", "copies"))
    names = store(mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).groupBy("doc_id", "row").agg(
        F.sum("copies").cast("int").alias(copies), F.count(F.lit(1)).alias("times")).withColumnsRenamed({"doc_id": own_id, "row": own_row}), docs.count())
    rows = docs.withColumn(fresh("hash", docs), _row_hash(docs))
    on = rows[f"`{id_col}`"].cast("long").eqNullSafe(names[own_id]) & (rows[fresh("hash", docs)] == names[own_row])

    def taken(which: DataFrame, single: bool) -> DataFrame:
        both = rows.join(few(which.drop("times"), which.count()), on)
        both = both if single else both.dropDuplicates([own_id, own_row])
        return both.withColumn(own_row, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])

    out, several = taken(names.where(f"times = 1 and `{copies}` > 0"), True), names.where(f"times > 1 and `{copies}` > 0")
    return out if several.isEmpty() else out.unionByName(taken(several, False))
