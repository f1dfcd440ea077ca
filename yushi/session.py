"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build(app: str = "yushi", cpus: int | str = "*") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own."""
    cores = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.yushi.source.tasks", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df, name: str):
    """The rows of df, written once to the shared folder and read from there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder below the shared folder that the session names.

    Only a local session without that setting gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="yushi-")
    import uuid

    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
