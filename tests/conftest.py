import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from yushi.session import build

    session = build("yushi-tests", 8)
    yield session
    session.stop()


@pytest.fixture
def run(spark):
    """run(fn, [texts]) -> list of results of a column function."""
    from pyspark.sql import functions as F

    def plain(v):
        return tuple(v) if hasattr(v, "asDict") else v

    def go(fn, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
        rows = df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()
        return [plain(r.v) for r in rows]

    return go
