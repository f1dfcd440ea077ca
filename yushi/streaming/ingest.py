"""Incremental page ingestion.

New page files are read as a stream.  Each micro-batch is reduced to its page
versions (first identity, last payload per content hash) and appended as one
small part; readers merge the parts.  The merge does not depend on order or
batching, so the stream's result equals the batch job's.  A part is named after
its epoch and overwritten on a retry, so a lost executor or a restarted query
never counts a page twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from yushi.operators import layers
from yushi.plans import layers as plans


COMPACTED = -1  # epoch number that no running query can have


def _mark(out: str, epoch: int) -> str:
    """One row with the newest capture time up to an epoch; readers of the parts skip names that begin with _."""
    return f"{out}/_newest/epoch={epoch}"


def _newest_before(spark: SparkSession, out: str, epoch: int):
    """Newest capture time of the earlier parts, NULL for the first batch: the row the epoch before has left."""
    try:
        return spark.read.schema("newest timestamp").parquet(_mark(out, epoch - 1)).first().newest
    except AnalysisException:
        if epoch > 0:
            raise
        return None


def _write_newest(spark: SparkSession, out: str, epoch: int, newest) -> None:
    spark.createDataFrame([(newest,)], "newest timestamp").write.mode("overwrite").parquet(_mark(out, epoch))


def _there(spark: SparkSession, path: str) -> bool:
    """Does the folder or file exist, wherever Spark's readers find it?"""
    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").take(1))
    except AnalysisException:
        return False


def start(pages: DataFrame, out: str, checkpoint: str, delay: str = "30 days"):
    """Run over everything available now; `pages` is a streaming DataFrame of
    raw rows (see `plans.layers.raw_rows`).  Pages older than the newest earlier
    capture minus `delay` are merged like others and counted as late.

    A query without its checkpoint would number its parts from 0 again and overwrite those that are
    there, so it refuses; compact the folder and go on in the new one."""
    spark = pages.sparkSession
    if _there(spark, f"{out}/epoch=0") and not _there(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{out} has parts of a query whose checkpoint is not {checkpoint}; compact it to a new folder first")

    def write(batch: DataFrame, epoch: int) -> None:
        newest = _newest_before(spark, out, epoch)
        line = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce((F.col("scraped_at") < line).cast("long"), F.lit(0))
        marked = batch.withColumn("late", late)
        part = marked.groupBy("content_hash").agg(
            F.min(F.struct("scraped_at", "raw_id", *[c for c in plans.IDENTITY if c not in ("scraped_at", "raw_id")])).alias("first"),
            F.max(F.struct("scraped_at", "raw_id", "structured")).alias("last"),
            F.count("*").alias("copies"), F.sum("late").alias("late"))
        path = f"{out}/epoch={epoch}"
        seen = Observation()
        part.observe(seen, F.max("last.scraped_at").alias("newest")).write.mode("overwrite").parquet(path)
        here = seen.get["newest"]
        _write_newest(spark, out, epoch, max((t for t in (newest, here) if t is not None), default=None))

    return (pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read(spark: SparkSession, out: str) -> DataFrame:
    """Merged page versions of all parts."""
    return layers.merge_versions(spark.read.parquet(out).drop("epoch", "late"))


def late_pages(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).agg(F.coalesce(F.sum("late"), F.lit(0)).alias("late"))


def compact(spark: SparkSession, out: str, target: str) -> None:
    """Write the merged parts to a new folder, which a new query can go on with.

    They stand under an epoch number no query has, late pages stay counted."""
    parts = spark.read.parquet(out)
    late = parts.groupBy("content_hash").agg(F.sum("late").alias("late"))
    read(spark, out).join(late, "content_hash").write.mode("overwrite").parquet(f"{target}/epoch={COMPACTED}")
    _write_newest(spark, target, COMPACTED, parts.agg(F.max("last.scraped_at").alias("m")).first().m)
