import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '*')}]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def db(spark):
    from tessera.plans.database import Database

    return Database(spark)


@pytest.fixture
def rows(db):
    """Rows of a script, as a set of tuples."""
    def run(text, params=None):
        return {tuple(r) for r in db.run(text, params).collect()}

    return run


@pytest.fixture
def value(db):
    """Value of one expression."""
    def run(expression, params=None):
        return db.run(f"u[x] <- [[1]] ?[y] := u[x], y = {expression}", params).first()[0]

    return run
