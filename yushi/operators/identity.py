"""Stable ids without a global sort, and which names and codes mean one institution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yushi.session import written


def dense_ids(df: DataFrame, key: Column, start: Column, name: str) -> DataFrame:
    """Number distinct keys start+1, start+2, … in the order of their md5.

    The first three hex digits cut the order into 4,096 even buckets: rows are
    numbered inside their bucket and shifted by the size of the buckets before
    it, so only the 4,096 bucket sizes ever meet in one task."""
    hashed = df.withColumn("_h", F.md5(key.cast("binary"))).withColumn("_b", F.substring("_h", 1, 3))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    shifts = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    # at most 4,096 rows of two short columns
    return (hashed.join(F.broadcast(shifts), "_b").withColumn(name, start + F.col("_shift") + place)
            .drop("_h", "_b", "_shift"))


# ---------------------------------------------------------------- components
def _hung(edges: DataFrame, centre: str, other: str) -> DataFrame:
    """Each neighbour of a node hung under the smallest of them and the node itself.

    The smallest comes from a plain group-by, so a node with very many neighbours is
    combined before the shuffle; the join back is one that adaptive execution may split."""
    lowest = edges.groupBy(F.col(centre).alias("_c")).agg(F.least(F.min(other), F.col("_c")).alias("_low"))
    return edges.join(lowest, F.col(centre) == F.col("_c")).select(F.col(other).alias("hi"), F.col("_c"), F.col("_low").alias("lo"))


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for edges (a, b).

    Alternating stars: first every node hangs its larger neighbours under its smallest one, then each
    node hangs itself and its smaller neighbours under the smallest. The number of rounds grows with
    the logarithm of the longest path. Every round is a written table, which ends the lineage, so a lost
    executor repeats one round at most. Nodes without an edge to another are roots of their own."""
    named = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now, seen = written(named.where("hi <> lo").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        both = now.unionAll(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        large = _hung(both, "hi", "lo").where("hi > _c AND hi <> lo").select("hi", "lo").distinct()
        small = _hung(large, "hi", "lo")
        # of a node's smaller neighbours and itself, all but the smallest go under the smallest
        under = small.select("hi", "lo").unionAll(small.select(F.col("_c").alias("hi"), "lo"))
        now = written(under.where("hi <> lo").distinct(), "edges")
    return nodes.join(now.withColumnRenamed("hi", "node"), "node", "left").select("node", F.coalesce("lo", "node").alias("root"))


# --------------------------------------------------------------- institutions
def _said(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def institution_map(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """institution_id, is_new of every (institution_code, institution_name) that occurs; missing ones are ''.

    `institutions` has institution_id, name and an array of codes. A known institution is found by code or name, the
    lower id wins. The others form a graph of codes and names: whatever is linked by a common code or a common name, over any
    number of rows, is one new institution. Nothing said gives no id."""
    seen = written(rows.select(_said("institution_code").alias("institution_code"), _said("institution_name").alias("institution_name")).distinct(), "institutions-seen")
    by_code = (institutions.select("institution_id", F.explode("codes").alias("institution_code"))
               .groupBy("institution_code").agg(F.min("institution_id").alias("_by_code")))
    by_name = institutions.groupBy("institution_name").agg(F.min("institution_id").alias("_by_name"))
    known = (seen.join(by_code, "institution_code", "left").join(by_name, "institution_name", "left")
             .select("institution_code", "institution_name", F.least("_by_code", "_by_name").alias("_known")))
    # '0' stands before codes and '1' before names, so a component with a code is known by its first code
    code = F.when(F.col("institution_code") != "", F.concat(F.lit("0"), "institution_code"))
    name = F.when(F.col("institution_name") != "", F.concat(F.lit("1"), "institution_name"))
    known = written(known.select("*", code.alias("_code"), name.alias("_name")), "institutions-known")
    unknown = known.where("_known IS NULL AND (_code IS NOT NULL OR _name IS NOT NULL)")
    roots = written(components(unknown.select(F.coalesce("_code", "_name").alias("a"), F.coalesce("_name", "_code").alias("b"))), "institution-roots")
    last = F.coalesce(institutions.agg(F.max("institution_id")).scalar(), F.lit(0))
    fresh = dense_ids(roots.select("root").distinct(), F.col("root"), last, "_fresh")
    found = roots.join(fresh, "root").select(F.col("node").alias("_node"), "_fresh")
    out = known.withColumn("_node", F.when(F.col("_known").isNull(), F.coalesce("_code", "_name"))).join(found, "_node", "left")
    return written(out.select("institution_code", "institution_name", F.coalesce("_known", "_fresh").alias("institution_id"),
                              F.col("_fresh").isNotNull().alias("is_new")), "institution-map")


def with_institutions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with what `institution_map` says of their code and name."""
    key = known.select(F.col("institution_code").alias("_c"), F.col("institution_name").alias("_n"), "institution_id", "is_new")
    same = (_said("institution_code") == F.col("_c")) & (_said("institution_name") == F.col("_n"))
    return rows.join(key, same, "left").drop("_c", "_n")


def resolve_institutions(rows: DataFrame, institutions: DataFrame) -> DataFrame:
    """Id of each row's institution; see `institution_map`."""
    return with_institutions(rows, institution_map(rows, institutions))
