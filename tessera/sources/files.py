"""Readers and writers for text formats and result envelopes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tessera.errors import TypeRefusal

TYPES = {"Any": "string", "String": "string", "Int": "bigint", "Float": "double", "Bool": "boolean", "Bytes": "binary", "Uuid": "string", "Json": "string"}


def _indexed(df: DataFrame, on: bool) -> DataFrame:
    if not on:
        return df
    names = df.columns
    rows = df.rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))  # file order; one pass, no shuffle
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("index", T.LongType()), *df.schema.fields])).select("index", *names)


def read_csv(spark: SparkSession, url: str | None = None, content: str | None = None, types: list | None = None,
             delimiter: str = ",", has_headers: bool = True, prepend_index: bool = False) -> DataFrame:
    """Typed CSV; short rows are filled with nulls, long ones cut; bad values refuse unless the type ends in ``?``."""
    types = types or []
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(types))])
    source = url if content is None else spark.sparkContext.parallelize(content.splitlines(), 1)
    df = spark.read.schema(schema).csv(source, sep=delimiter, header=has_headers, mode="PERMISSIVE")
    cols = []
    for k, t in enumerate(types):
        kind = TYPES.get(t.rstrip("?"))
        if kind is None:
            raise TypeRefusal(f"no CSV type {t}")
        c = F.col(f"c{k}")
        cols.append((c.try_cast(kind) if t.endswith("?") else c.cast(kind)).alias(f"c{k}"))
    return _indexed(df.select(*cols), prepend_index)


def read_json(spark: SparkSession, url: str | None = None, content: str | None = None, fields: list | None = None,
              json_lines: bool = True, null_if_absent: bool = False, prepend_index: bool = False) -> DataFrame:
    """Fields of JSON lines, or of one JSON array, with inferred types."""
    if content is not None:
        lines = content.splitlines() if json_lines else [json.dumps(x) for x in json.loads(content)]
        df = spark.read.json(spark.sparkContext.parallelize([x for x in lines if x.strip()], 1))
    else:
        df = spark.read.json(url, multiLine=not json_lines)
    missing = [f for f in fields or [] if f not in df.columns]
    if missing and not null_if_absent:
        raise TypeRefusal(f"field {missing[0]} is absent")
    cols = []
    for f in fields or df.columns:
        c = F.col(f"`{f}`") if f in df.columns else F.lit(None).cast("string")
        cols.append((c if null_if_absent or f not in df.columns else F.coalesce(c, F.raise_error(F.lit(f"field {f} is absent")))).alias(f))
    return _indexed(df.select(*cols), prepend_index)


def envelope(df: DataFrame) -> dict:
    """``ok, headers, rows, took`` of a result, for hosts that speak JSON."""
    import time

    began = time.time()
    rows = [[v for v in r] for r in df.collect()]
    return {"ok": True, "headers": df.columns, "rows": rows, "took": time.time() - began}


def to_arrow(df: DataFrame):
    """A result as an Arrow table."""
    return df.toArrow()


