"""Joins of intervals that intersect, as equi-joins on dyadic cells.

An interval of length L lies in at most two cells of the least power of two
not below L.  Two intervals are compared on the larger of their levels, so each
is listed once per level that occurs at or above its own, in at most two cells:
no interval, however long, is cut into many pieces, and nothing is compared
with everything.  A pair counts only in the cell of the later of its starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Levels of unbounded ends: one cell that holds everything.
TOP = 62


def _level(lo: Column, hi: Column) -> Column:
    span = hi.cast("decimal(20,0)") - lo.cast("decimal(20,0)") + 1
    return F.when(lo.isNull() | hi.isNull() | (span > 1 << (TOP - 1)), F.lit(TOP)).otherwise(F.greatest(F.ceil(F.log2(span.cast("double")) - 1e-12), F.lit(0))).cast("int")


def _cell(x: Column, level: Column) -> Column:
    return F.when(level >= TOP, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftright", x, level))


def interval_join(left: DataFrame, right: DataFrame, a: tuple[str, str], b: tuple[str, str], on: list[str] = ()) -> DataFrame:
    """Rows of ``left`` and ``right`` whose closed intervals of longs intersect.

    ``a`` and ``b`` name the ends; a null end is unbounded, an interval that
    ends before it starts meets nothing.  ``on`` names columns that must be
    equal too.  Other columns must differ between the sides.
    """
    def side(df, ends, tag):
        lo, hi = (F.col(f"`{e}`").cast("bigint") for e in ends)
        return df.where(F.coalesce(lo <= hi, F.lit(True))).withColumn(f"_lo{tag}", lo).withColumn(f"_hi{tag}", hi).withColumn(f"_l{tag}", _level(lo, hi))

    x, y = side(left, a, "a"), side(right, b, "b")
    found = x.select(F.col("_la").alias("l")).union(y.select("_lb")).distinct().collect()  # at most 63 rows
    levels = F.array(*[F.lit(int(r["l"])) for r in sorted(found)]) if found else F.array(F.lit(TOP))

    def listed(df, tag):
        lo, hi, own = F.col(f"_lo{tag}"), F.col(f"_hi{tag}"), F.col(f"_l{tag}")
        df = df.withColumn("_level", F.explode(F.filter(levels, lambda v: v >= own)))
        ends = F.array_distinct(F.array(_cell(lo, F.col("_level")), _cell(hi, F.col("_level"))))
        return df.withColumn("_cell", F.explode(ends))

    both = listed(x, "a").join(listed(y, "b"), [*on, "_level", "_cell"])
    start = F.greatest("_loa", "_lob")  # null only where both are unbounded: the top cell
    meets = F.coalesce(F.col("_loa") <= F.col("_hib"), F.lit(True)) & F.coalesce(F.col("_lob") <= F.col("_hia"), F.lit(True))
    once = (F.col("_level") == F.greatest("_la", "_lb")) & F.coalesce(_cell(start, F.col("_level")) == F.col("_cell"), F.lit(True))
    return both.where(meets & once).drop("_level", "_cell", "_loa", "_hia", "_la", "_lob", "_hib", "_lb")
