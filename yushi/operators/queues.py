"""Work queues: what a run still has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _newest(df: DataFrame, at: str, key: str, limit: int | None) -> DataFrame:
    if limit is None:
        return df
    return df.orderBy(F.col(at).desc(), F.col(key)).limit(limit)


def unprocessed(raw: DataFrame, institutions: DataFrame, processed: DataFrame, limit: int | None = 10,
                retry: bool = False) -> DataFrame:
    """Pages without a processed row, newest first.

    `retry` also queues pages whose only processed rows failed.  The anti-join
    runs on ids alone; the institution name is added behind it."""
    done = processed if not retry else processed.where("processing_status <> 'failed'")
    todo = raw.join(done.select("raw_id"), "raw_id", "left_anti")
    names = institutions.select("institution_id", "institution_name")
    return _newest(todo.join(names, "institution_id"), "scraped_at", "raw_id", limit)


def unintegrated(processed: DataFrame, institutions: DataFrame, products: DataFrame, limit: int | None = 10,
                 consumed: DataFrame | None = None) -> DataFrame:
    """Completed rows whose id no product carries, newest first.

    Products keep the id of their first version only, so later versions come up
    again; pass the ids of all integrated rows as `consumed` to leave them out."""
    todo = processed.where("processing_status = 'completed'").join(
        products.select(F.col("processed_data_id").alias("processed_id")), "processed_id", "left_anti")
    if consumed is not None:
        todo = todo.join(consumed.select("processed_id"), "processed_id", "left_anti")
    names = institutions.select("institution_id", "institution_name")
    return _newest(todo.join(names, "institution_id"), "processed_at", "processed_id", limit)


BUCKETS = 16


def stored_by_id(rows: DataFrame, path: str, table: str, key: str = "processed_id", mode: str = "overwrite") -> DataFrame:
    """Rows stored in buckets of an id, so that joins on it with other such tables need no exchange.

    One task writes a bucket, so a write adds as many files as there are buckets, not as many for each task."""
    rows.repartition(BUCKETS, key).write.mode(mode).bucketBy(BUCKETS, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def record(ids: DataFrame, path: str, table: str) -> None:
    """Add the ids a run has taken to the ledger; an id that is there twice does no harm."""
    stored_by_id(ids.select("processed_id"), path, table, mode="append")


def open_rows(processed: DataFrame, ledger: DataFrame, institutions: DataFrame, limit: int | None = 10) -> DataFrame:
    """Completed rows that no run has taken yet, newest first, by the ledger of consumed ids.

    Unlike the ids that products carry, the ledger knows later versions of a product too."""
    todo = processed.where("processing_status = 'completed'").join(ledger.select("processed_id").hint("merge"), "processed_id", "left_anti")
    names = institutions.select("institution_id", "institution_name")
    return _newest(todo.join(names, "institution_id"), "processed_at", "processed_id", limit)


def backlog(raw: DataFrame, processed: DataFrame) -> DataFrame:
    return raw.select("raw_id").join(processed.select("raw_id"), "raw_id", "left_anti").agg(
        F.count("*").alias("backlog"))
