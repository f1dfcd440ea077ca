"""Freshness, status and run metrics; newest rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshness(raw: DataFrame, cutoff: Column) -> DataFrame:
    """Counts and first / last capture per institution, overall and since `cutoff`."""
    recent = F.col("scraped_at") >= cutoff
    at = F.col("scraped_at")
    return raw.groupBy("institution_id").agg(
        F.count("*").alias("total_count"), F.min(at).alias("total_earliest"), F.max(at).alias("total_latest"),
        F.count_if(recent).alias("recent_count"), F.min(F.when(recent, at)).alias("recent_earliest"),
        F.max(F.when(recent, at)).alias("recent_latest"))


def status_counts(processed: DataFrame) -> DataFrame:
    return processed.groupBy("processing_status").agg(F.count("*").alias("n"))


def success_rate(rows: DataFrame, ok: Column) -> DataFrame:
    """Share of good rows in percent, two decimals, 0 for an empty table."""
    counted = rows.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"))
    return counted.withColumn("success_rate", F.when(
        F.col("total") > 0, F.round(F.col("ok") / F.col("total") * 100, 2)).otherwise(F.lit(0.0)))


def active_counts(products: DataFrame) -> DataFrame:
    return products.where("is_active").groupBy("loan_category").agg(F.count("*").alias("n"))


def run_summary(log: DataFrame) -> DataFrame:
    """Per run: totals, duration and the status code of the run.

    Errors are counted and the first is named; the full list stays in the log,
    as one run may hold any number of them."""
    ok = F.col("ok") == 1
    out = log.groupBy("run_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("success_count"), F.count_if(~ok).alias("error_count"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.min(F.when(~ok, F.col("source_no"))).alias("first_error_source"))
    micros = [F.unix_micros(F.col(x).cast("timestamp")) for x in ("ended", "started")]
    seconds = (micros[0] - micros[1]) / F.lit(1000000.0)
    return out.withColumns({
        "duration_seconds": F.round(seconds, 3),
        "status_code": F.when(F.col("success_count") == 0, 500).when(F.col("error_count") == 0, 200).otherwise(207)})


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def latest(df: DataFrame, group: str, at: str, key: str, columns) -> DataFrame:
    """Newest row per group, the smallest key in a tie.

    Tasks keep one row per group before the shuffle, so a hot group costs one row per task."""
    rest = [c for c in columns if c not in (group, at, key)]
    w = Window.partitionBy(group).orderBy(F.col(at).desc(), F.col(key))
    return df.select(group, at, key, *rest, F.row_number().over(w).alias("_place")).where("_place = 1").drop("_place")


def newest_per_group(df: DataFrame, group: str, at: str, key: str, k: int) -> DataFrame:
    """k newest rows per group; the rank filter also runs before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.col(at).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_source(items: DataFrame) -> DataFrame:
    """One row per source document with what it holds.

    The items themselves stay rows (join on source_url); a document may be the
    source of any share of the table, so they are not gathered into a list."""
    return items.where("source_url <> ''").groupBy("source_url").agg(
        F.count("*").alias("n_items"), F.min("product_name").alias("first_name"),
        F.max("product_name").alias("last_name"), F.min("raw_id").alias("first_raw_id"))


def mined_values(df: DataFrame, arrays: dict[str, str]) -> DataFrame:
    """How often each mined value occurs over the corpus."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("vals")) for k, c in arrays.items()])
    return (df.select(F.inline(kinds)).select("kind", F.explode("vals").alias("value"))
            .groupBy("kind", "value").agg(F.count("*").alias("n_docs")))
