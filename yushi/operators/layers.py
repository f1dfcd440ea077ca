"""Layer tables: content dedup, product upsert, change history, staged writes.

Merges choose their winners by numbers of fixed width: time and id of a version become one
decimal, so the first and the last of a key are a hash aggregation over narrow
rows, and partial aggregation shrinks a hot key before the shuffle. The wide columns are fetched
afterwards, for the winners only, by key and number: versions of a hot key have different
numbers and spread over all tasks. Nothing wide is sorted. Inputs are read once for each set of columns, so
pass stored tables, of which a scan reads no more than these.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.operators.identity import dense_ids


def _place(at: Column, no: Column) -> Column:
    """Time in microseconds and id in one number, in the order (time, id); a missing time comes first."""
    wide = lambda x, n: x.cast(f"decimal({n},0)")
    micros = F.coalesce(F.unix_micros(at.cast("timestamp")), F.lit(-(10**17)))
    shifted = wide(no, 19) + wide(F.lit(str(2**63)), 20)
    return (wide(micros, 18) * wide(F.lit("2" + "0" * 19), 20) + shifted).cast("decimal(38,0)")


def _fetched(won: DataFrame, rows: DataFrame, key, place: str) -> DataFrame:
    """The rows of `rows` (key, place, more) whose place has won, in a join that hashes the winners."""
    names = {k: f"_key{n}" for n, k in enumerate(key)}
    rows = rows.withColumnsRenamed({**names, place: "_place"})
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] + [F.col(place) == F.col("_place")]
    return won.hint("shuffle_hash").join(rows, same).drop(*names.values(), "_place")


# -------------------------------------------------------------- content dedup
def page_versions(pages: DataFrame, identity, payload, key=("content_hash",)) -> DataFrame:
    """Partial form of the raw layer: per key the first identity, the last payload.

    (scraped_at, raw_id) names a capture: rows that repeat one are equal and become one version, `copies`
    counts them all. Page bodies stay in the page store; the layer carries hash and length and
    points to the body by raw_id."""
    order, place = ["scraped_at", "raw_id"], _place(F.col("scraped_at"), F.col("raw_id"))
    struct = lambda cols: F.struct(*order, *[c for c in cols if c not in order])
    won = pages.groupBy(*key).agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("copies"))
    first = pages.select(*key, place.alias("_first"), struct(identity).alias("first"))
    last = pages.select(*key, place.alias("_last"), struct(payload).alias("last"))
    both = _fetched(_fetched(won, first, key, "_first"), last, key, "_last")
    return both.select(*key, "first", "last", "copies").distinct()


def merge_versions(*parts: DataFrame, key=("content_hash",)) -> DataFrame:
    """Union of partial forms to one row per key; order and batching do not matter."""
    parts = reduce(DataFrame.unionByName, parts)
    return parts.groupBy(*key).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("copies").alias("copies"))


def as_layer(versions: DataFrame, key=("content_hash",)) -> DataFrame:
    """First-wins identity and last-wins payload as plain columns."""
    payload = [f for f in versions.schema["last"].dataType.names if f not in ("scraped_at", "raw_id")]
    identity = [f for f in versions.schema["first"].dataType.names if f not in key]
    return versions.select(
        *key, *[F.col(f"first.{f}").alias(f) for f in identity],
        *[F.col(f"last.{f}").alias(f) for f in payload],
        F.col("last.scraped_at").alias("updated_at"), "copies")


# -------------------------------------------------------------- product upsert
PRODUCT_KEY = ["institution_id", "product_name", "loan_type"]


def upsert(current: DataFrame, incoming: DataFrame, order: str = "newest") -> DataFrame:
    """Products after applying all incoming versions.

    The version applied first opens a product and fixes the columns an update
    leaves alone; the one applied last gives the refreshed columns.  `newest`
    applies in time order, `literal` newest first, so that the oldest wins. Equal rows count once."""
    refreshed = [c for c in V.UPSERT_REFRESHED if c not in PRODUCT_KEY]
    kept = [c for c in incoming.columns if c not in refreshed and c not in PRODUCT_KEY]
    columns = [*PRODUCT_KEY, *kept, *refreshed]
    place = _place(F.col("data_updated_at"), F.col("processed_data_id"))
    # what is stored already was applied before anything that comes in
    old = current.select(*columns, F.lit("-" + "9" * 38).cast("decimal(38,0)").alias("_at"))
    both = old.unionByName(incoming.select(*columns, (place if order == "newest" else -place).alias("_at")))
    won = both.groupBy(*PRODUCT_KEY).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    opened = both.select(*PRODUCT_KEY, F.col("_at").alias("_first"), *kept)
    latest = both.select(*PRODUCT_KEY, F.col("_at").alias("_last"), *refreshed)
    merged = _fetched(_fetched(won, opened, PRODUCT_KEY, "_first"), latest, PRODUCT_KEY, "_last")
    return merged.select(*columns).distinct()


def with_ids(products: DataFrame, known: DataFrame) -> DataFrame:
    """Products with their ids: kept where `known` (key, product_id) has one, new
    ones counted on from the highest."""
    df = products.join(known.select(*PRODUCT_KEY, F.col("product_id").alias("_id")), PRODUCT_KEY, "left")
    fresh = df.where(F.col("_id").isNull()).select(*PRODUCT_KEY)
    last = F.coalesce(known.agg(F.max("product_id")).scalar(), F.lit(0))
    ids = dense_ids(fresh, F.to_json(F.struct(*PRODUCT_KEY)), last, "_new")
    return (df.join(ids, PRODUCT_KEY, "left").withColumn("product_id", F.coalesce("_id", "_new"))
            .drop("_id", "_new"))


def _plain(column: Column, kind: str) -> Column:
    return F.to_json(column) if kind.startswith(("struct", "array", "map")) else column.cast("string")


def history(versions: DataFrame, fields, last: DataFrame | None = None) -> DataFrame:
    """What changed from each version of a product to the next, every version counted.

    `last` holds the last version of each product before these (the stored products), so a run compares only what came in.
    The step before a version is looked for inside its month; the first version of a month
    looks at the last of the month before that has any.  So no window holds more than
    one product's month, or one row per month, however often a product changes."""
    order = ["data_updated_at", "processed_data_id"]
    kinds = {f: versions.schema[f].dataType.simpleString() for f in fields}

    def narrow(df, new):
        return df.select(*PRODUCT_KEY, F.date_trunc("month", "data_updated_at").alias("_month"), F.struct(
            F.unix_micros(F.col("data_updated_at").cast("timestamp")).alias("at"), F.lit(new).alias("new"), F.col("processed_data_id").alias("no"),
            F.col("data_updated_at").alias("changed_at"), *[_plain(F.col(f), kinds[f]).alias(f) for f in fields]).alias("v"))

    rows = narrow(versions, True) if last is None else narrow(last, False).unionByName(narrow(versions, True))
    month = [*PRODUCT_KEY, "_month"]
    within = Window.partitionBy(*month).orderBy("v.at", "v.new", "v.no")
    across = Window.partitionBy(*PRODUCT_KEY).orderBy("_month")
    steps = rows.select("*", F.lag("v").over(within).alias("inner_old"), F.lead(F.lit(1)).over(within).alias("_next"))
    ends = steps.where("_next IS NULL").select(*month, "v")
    before = ends.select(*month, F.lag("v").over(across).alias("month_old")).where(F.col("month_old").isNotNull())
    pairs = (steps.where("v.new").join(before, month, "left").withColumn("old", F.coalesce("inner_old", "month_old"))
             .where(F.col("old").isNotNull()))
    entries = F.array_compact(F.array(*[
        F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"v.{c}")),
               F.struct(F.lit(c).alias("k"), F.col(f"old.{c}").alias("o"), F.col(f"v.{c}").alias("n")))
        for c in fields]))
    return (pairs.withColumn("e", entries).where(F.size("e") > 0).select(
        *PRODUCT_KEY, F.col("v.no").alias("processed_data_id"),
        F.transform("e", lambda x: x["k"]).alias("changed_fields"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["o"]))).alias("old_values"),
        F.map_from_entries(F.transform("e", lambda x: F.struct(x["k"], x["n"]))).alias("new_values"),
        F.col("v.changed_at").alias("changed_at")))


def first_records(records: DataFrame, key, position) -> DataFrame:
    """One record per key, the first by `position`; unnamed records are left out."""
    rest = [c for c in records.columns if c not in key and c not in position]
    picked = (records.where(F.col("product_name").isNotNull()).groupBy(*key)
              .agg(F.min(F.struct(*position, *rest)).alias("r")))
    return picked.select(*key, *[F.col(f"r.{c}").alias(c) for c in [*position, *rest]])


# ------------------------------------------------------------------------ sink
def write_layer(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a layer; with partitions only those present in `df` are replaced."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def write_version(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a layer as a new version; readers see it whole or not at all.

    The rows go to a folder of their own. Only when all are there, a manifest with the next number names it: a job that dies before
    leaves the old version in force, one that dies after has nothing left to do. With `partition_by`, partitions that df does not
    have stay as they are in the version before. Two writers of the same number can't both succeed."""
    spark, version = df.sparkSession, f"version-{uuid.uuid4().hex}"
    old = _manifest(spark, path)
    if partition_by is None:
        df.write.parquet(f"{path}/{version}")
        entries = [(version, None)]
    else:
        df.write.partitionBy(partition_by).parquet(f"{path}/{version}")
        # as many rows as the layer has partitions
        new = [r[0] for r in spark.read.schema(df.schema).parquet(f"{path}/{version}").select(F.col(partition_by).cast("string")).distinct().collect()]
        entries = [(version, p) for p in new] + [(v, p) for v, p in old[1] if p not in new]
    rows = spark.createDataFrame([(old[0] + 1, v, p) for v, p in entries], "number long, version string, part string")
    rows.coalesce(1).write.mode("error").parquet(f"{path}/_manifest/{old[0] + 1:012d}")


def _manifest(spark, path: str) -> tuple[int, list[tuple[str, str | None]]]:
    """Number and entries of the version in force."""
    try:
        rows = spark.read.schema("number long, version string, part string").parquet(f"{path}/_manifest/*").collect()
    except AnalysisException:
        return 0, []
    last = max((r.number for r in rows), default=0)
    return last, [(r.version, r.part) for r in rows if r.number == last]


def read_version(spark, path: str, partition_by: str | None = None) -> DataFrame:
    """The version in force. Versions that still hold partitions are read as one table each, so filters on the partition prune all of them."""
    _, entries = _manifest(spark, path)
    out = None
    for version in sorted({v for v, _ in entries}):
        rows, own = spark.read.parquet(f"{path}/{version}"), [p for v, p in entries if v == version]
        if partition_by and len({v for v, _ in entries}) > 1:
            named = F.col(partition_by).cast("string").isin([p for p in own if p is not None])
            rows = rows.where(named | F.col(partition_by).isNull() if None in own else named)
        out = rows if out is None else out.unionByName(rows)
    return out


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row and line, absent fields left out."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
