"""Aggregates: one Spark aggregate expression each.

``build(name, value, extra, tie)`` gives a column for ``groupBy().agg()``.
``tie`` is a struct of all columns in canonical order; it settles every choice
between equals, so results do not depend on the order of rows.  A quantile is
exact and takes passes of its own (``ranking.quantile``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tessera.errors import TypeRefusal, UnknownName
from tessera.functions.scalar import INTS, NUMBERS, arrow, refuse  # noqa: F401

#: Aggregates that may stand inside recursion: idempotent, commutative, associative.
MEET = {"min", "max", "and", "or", "union", "intersection", "choice", "min_cost", "shortest", "bit_and", "bit_or", "hll_union"}
NORMAL = {"count", "count_unique", "sum", "product", "mean", "variance", "std_dev", "unique", "group_count", "collect", "latest_by",
          "smallest_by", "bit_xor", "hll", "hll_sketch", "count_min", "tdigest", "quantile"}
NEUTRAL = {"count": 0, "count_unique": 0, "and": True, "or": False}


def _numbers(name, v, t, nulls_pass=False):
    if not isinstance(t, (*NUMBERS, T.NullType)):
        raise TypeRefusal(f"aggregate '{name}' requires numbers, not {t.simpleString()}")
    return v if nulls_pass else F.coalesce(v, refuse(f"aggregate '{name}' refuses null"))


def _order(tie: Column, value: Column) -> Column:
    return F.array_sort(F.collect_list(F.struct(tie.alias("t"), value.alias("v"))))


def _bits(op: str):
    def f(v):
        whole = F.collect_list(v)
        first = F.element_at(whole, 1)

        def step(acc, x):
            byte = lambda b, i: F.conv(F.substr(F.hex(b), 2 * i - 1, F.lit(2)), 16, 10).cast("bigint")
            out = F.transform(F.sequence(F.lit(1), F.octet_length(acc)), lambda i: F.lpad(F.hex(getattr(byte(acc, i), op)(byte(x, i))), 2, "0"))
            same = F.octet_length(acc) == F.octet_length(x)
            return F.when(same, F.when(F.octet_length(acc) == 0, acc).otherwise(F.unhex(F.array_join(out, "")))).otherwise(refuse("byte strings of one length are wanted"))

        return F.aggregate(F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0))), first, step)

    return f


def build(name: str, v: Column, t: T.DataType, extra: list, tie: Column) -> Column:
    """The aggregate column of ``name`` over values ``v`` of type ``t``."""
    if name == "choice_rand":
        raise TypeRefusal("unseeded choice is refused")
    if name == "count":
        return F.count(F.lit(1))
    if name == "count_unique":
        return F.count_distinct(v) + F.coalesce(F.max(v.isNull().cast("int")), F.lit(0)).cast("bigint")
    if name == "sum":
        x = _numbers(name, v, t)
        if not isinstance(t, INTS):
            return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))
        whole = F.sum(x.cast("decimal(38,0)"))
        return F.coalesce(whole.cast("bigint"), F.lit(0).cast("bigint"))
    if name == "product":
        x = _numbers(name, v, t)
        if isinstance(t, INTS):
            return F.aggregate(F.collect_list(x.cast("bigint")), F.lit(1).cast("bigint"), lambda a, b: a * b)
        return F.coalesce(F.product(x.cast("double")), F.lit(1.0))
    if name == "mean":
        return F.avg(_numbers(name, v, t).cast("double"))
    if name == "variance":
        return F.var_samp(_numbers(name, v, t).cast("double"))
    if name == "std_dev":
        return F.stddev_samp(_numbers(name, v, t).cast("double"))
    if name in ("min", "max"):
        return getattr(F, name)(_numbers(name, v, t, True))
    if name in ("and", "or"):
        if not isinstance(t, T.BooleanType):
            raise TypeRefusal(f"aggregate '{name}' requires booleans")
        return F.coalesce((F.bool_and if name == "and" else F.bool_or)(v), F.lit(name == "and"))
    if name == "unique":
        out = F.array_sort(F.collect_set(v))
        return F.when(F.max(v.isNull()), F.array_prepend(out, F.lit(None))).otherwise(out)
    if name == "group_count":
        seen = F.array_sort(F.collect_list(F.struct(v.alias("v"))))
        # runs of the sorted values: where they start, and how far the next one is; each array is bound once
        once = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)

        def runs(s):
            first = lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1))
            starts = F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))), first))
            return once(starts, lambda at: F.transform(at, lambda p, j: F.struct(
                F.get(s, p)["v"].alias("value"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).cast("bigint").alias("count"))))

        return once(seen, runs)
    if name == "union":
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(v))))
    if name == "intersection":
        all_ = F.collect_list(v)
        return F.array_sort(F.aggregate(all_, F.array_distinct(F.element_at(all_, 1)), F.array_intersect))
    if name == "collect":
        out = F.transform(_order(tie, v), lambda x: x["v"])
        return F.slice(out, 1, int(extra[0])) if extra else out
    if name == "choice":
        return F.min_by(v, tie)
    if name in ("latest_by", "smallest_by", "min_cost"):
        p, cost = (v["_1"], v["_2"]) if isinstance(t, T.StructType) else (F.element_at(v, 1), F.element_at(v, 2))
        if name == "latest_by":
            return F.min_by(p, F.struct(-cost.cast("double"), tie))
        if name == "smallest_by":
            return F.min_by(p, F.struct(cost, tie))
        return F.min_by(v, F.struct(cost, tie))
    if name == "shortest":
        return F.min_by(v, F.struct(F.size(v), v))
    if name in ("bit_and", "bit_or", "bit_xor"):
        return _bits({"bit_and": "bitwiseAND", "bit_or": "bitwiseOR", "bit_xor": "bitwiseXOR"}[name])(v)
    if name == "hll":
        return F.hll_sketch_estimate(F.hll_sketch_agg(v, 14))
    if name == "hll_sketch":
        return F.hll_sketch_agg(v, 14)
    if name == "hll_union":
        return F.hll_union_agg(v)
    if name == "count_min":
        return F.count_min_sketch(v, F.lit(0.001), F.lit(0.99), F.lit(1))
    if name == "tdigest":
        return F.kll_sketch_agg_double(_numbers(name, v, t).cast("double"))
    if name == "quantile":
        q = float(extra[0]) if extra else -1
        if not 0 <= q <= 1:
            raise TypeRefusal("'quantile' needs a constant from 0 to 1")
        return _numbers(name, v, t).cast("double")  # the engine takes the quantile of these
    raise UnknownName(f"no aggregate {name}")
