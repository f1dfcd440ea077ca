"""Page numbers of any depth: rows stored in order, with a directory of how many lie in each part.

The rows are cut into ranges of the order, one folder each; the directory has one row per folder. A page is found
by adding up the directory, which lists as many numbers as there are folders, and reading the folders it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def store(df: DataFrame, order: list[Column], path: str, parts: int) -> None:
    """Write df in order. The order must name every row (end it with a key), so that no value fills a part alone."""
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    placed.sortWithinPartitions(*order).write.partitionBy("_part").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_part").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/directory")


def page(spark: SparkSession, path: str, order: list[Column], size: int, number: int = 1) -> DataFrame:
    """One page by number: only the parts it lies in are read."""
    first, before, parts, base = size * (number - 1), 0, [], 0
    for part, n in sorted(tuple(r) for r in spark.read.parquet(f"{path}/directory").select("_part", "n").collect()):
        if before + n > first and before < first + size:
            base = base if parts else before
            parts.append(part)
        before += n
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_part").isin(parts) if parts else F.lit(False))
    return rows.drop("_part").orderBy(*order).offset(max(0, first - base)).limit(size)
