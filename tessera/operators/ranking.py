"""Global row numbers, ranks and quantiles without a one-task sort of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.lineage import cut, few


def numbered(df: DataFrame, order: list[Column], name: str = "_row") -> DataFrame:
    """``df`` with numbers from 1 in the order given, which must tell all rows apart.

    Rows are range-partitioned and sorted once; only one count per partition
    reaches the driver.
    """
    x = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id()))
    sizes = sorted((r["_part"], r["n"], r["lo"]) for r in x.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo")).collect())
    before, total = [], 0
    for part, n, lo in sizes:
        before.append((part, total - lo + 1))
        total += n
    base = df.sparkSession.createDataFrame(before, "_part int, _before long")
    return x.join(F.broadcast(base), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def ranked(df: DataFrame, keys: list[tuple[Column, bool]], order: list[Column], name: str = "_rank") -> DataFrame:
    """``numbered`` by keys (and whether each descends) and then ``order``, with the rank of each key: ties share the least number."""
    made = df.select("*", *[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)])
    sort = [F.col(f"_k{i}").desc_nulls_last() if down else F.col(f"_k{i}").asc_nulls_first() for i, (_, down) in enumerate(keys)]
    x = numbered(made, [*sort, *order])
    names = [f"_k{i}" for i in range(len(keys))]
    first = x.groupBy(*names).agg(F.min("_row").alias(name)).toDF(*[f"_f{i}" for i in range(len(keys))], name)
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"_k{i}").eqNullSafe(F.col(f"_f{i}"))
    return x.join(first, on).drop(*names, *[f"_f{i}" for i in range(len(keys))])


#: Half the share of rows between the two estimates that enclose a quantile.
NEAR = 0.002


def quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """``keys, value``: per group the least value that at least a share ``q`` of its rows does not exceed.

    Two estimates enclose it.  Rows below, between and above them are counted,
    and only values of the part that holds the wanted row are counted one by
    one, so bad estimates cost time and never change a result.
    """
    if not df._jdf.queryExecution().analyzed().deterministic():
        df = cut(df)
    x, names = df.select(*keys, F.col(value).cast("double").alias("_x")), [f"_g{i}" for i in range(len(keys))]
    ends = F.percentile_approx("_x", F.array(*[F.lit(min(1.0, max(0.0, q + d))) for d in (-NEAR, NEAR)]), 2_000)

    def with_group(left, right):
        right = right.toDF(*names, *right.columns[len(keys):])
        on = F.lit(True)
        for k, g in zip(keys, names):
            on = on & F.col(k).eqNullSafe(F.col(g))
        right = few(right, size)  # rows of few groups do not move
        return (left.join(right, on, "left") if keys else left.crossJoin(right)).drop(*names)

    groups = cut(x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), ends.alias("_e")))
    size = groups.count()
    part = F.when(F.col("_x") < F.col("_e")[0], 0).when(F.col("_x") <= F.col("_e")[1], 1).otherwise(2)
    sized = with_group(x, groups.select(*keys, "_e")).groupBy(*keys).agg(*[F.count_if(part == i).alias(f"_p{i}") for i in range(3)])
    nth = F.greatest(F.lit(1), F.col("_n") - F.floor(F.col("_n") - F.col("_n") * q))
    low = F.col("_p0")
    chosen = with_group(groups, sized).withColumn("_nth", nth).withColumn("_part", F.when(F.col("_nth") <= low, 0).when(F.col("_nth") <= low + F.col("_p1"), 1).otherwise(2))
    chosen = chosen.withColumn("_nth", F.col("_nth") - F.when(F.col("_part") == 0, 0).when(F.col("_part") == 1, low).otherwise(low + F.col("_p1")))
    inside = with_group(x, chosen.select(*keys, "_e", "_part", "_nth")).where(part == F.col("_part"))
    counted = inside.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"), F.first("_nth").alias("_nth"))
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("_upto", F.sum("_c").over(w)).where(F.col("_upto") >= F.col("_nth")).groupBy(*keys).agg(F.min("_x").alias("_x"))
    return with_group(groups.select(*keys), found).withColumnRenamed("_x", value) if keys else found.withColumnRenamed("_x", value)
