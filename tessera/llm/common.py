"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _trim():
    import ctypes

    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # another C library
        return lambda _: 0


def give_back() -> None:
    """Return what this worker process has freed to the system.

    Workers serve one stage after another, and their allocators would hold on
    to the most that any stage took for its batches of whole texts.
    """
    pa.default_memory_pool().release_unused()
    _trim()(0)


def scan(df: DataFrame, cols: list[str], row_fn: Callable[[], Callable[..., Iterable[tuple]]], schema: StructType, chunk: int = 4096) -> DataFrame:
    """Map rows through Python in Arrow batches.

    ``row_fn()`` is called once per task and returns the function that turns
    one row into output tuples, so per-worker state (tokenizers, caches) has
    one home.  Output leaves in batches of ``chunk`` rows: memory per task is
    one input batch plus one output batch, and goes back when the task ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = row_fn(), []

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(target)], schema=target
            )

        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                for row in zip(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                    out.extend(fn(*row))
                    if len(out) >= chunk:
                        yield flush()
                        out = []
        if out:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from mapped(batches)
        give_back()

    return df.select(*cols).mapInArrow(run, schema)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(name: str, df: DataFrame) -> str:
    """A column name for inside use that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
