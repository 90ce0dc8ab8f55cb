"""Cutting lineage through storage that every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, functions as F

#: Rows of ids that a join broadcasts after counting them, some tens of MB; more are shuffled.
FEW_IDS = 500_000


def _folder(spark) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            place = tempfile.mkdtemp(prefix="tessera-ckpt-")
        sc.setCheckpointDir(place)
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def _shuffles_freed(spark):
    """What is written out no longer needs the shuffle files behind it; they go when the write ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the reliable checkpoint folder.

    The folder is the session's ``spark.checkpoint.dir``; only a local session
    without one gets a private folder (tests, notebooks).  Reliable checkpoints
    survive the loss of any executor, unlike block-manager copies.
    """
    _folder(df.sparkSession)
    with _shuffles_freed(df.sparkSession):
        return df.checkpoint(eager=True)


#: Rows of a few numbers in one file, some MB.
ROWS_A_FILE = 200_000


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it back.

    Smaller than a checkpoint for wide or long intermediate tables, and
    columns are pruned on reading.  The files go by ``free`` or when the
    session's interpreter exits.  Where ``rows``, about how many narrow rows
    there may be, is known, they go to as few files as they need; each file
    costs a remote call or more, and shuffles leave many partitions.
    """
    spark = df.sparkSession
    df = df if rows is None else df.repartition(max(1, -(-rows // ROWS_A_FILE)))
    place = f"{_folder(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(place)
    atexit.register(_remove, spark, place)
    out = spark.read.schema(df.schema).parquet(place)
    out._stored = place
    return out


def few(ids: DataFrame, rows: int) -> DataFrame:
    """``ids`` (a few numbers a row) with a broadcast asked for where its counted rows are few."""
    return F.broadcast(ids) if rows <= FEW_IDS else ids


def free(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        _remove(df.sparkSession, df._stored)


def _remove(spark, place: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except Exception:  # the session is gone: its owner clears the folder
        pass
