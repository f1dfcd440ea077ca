"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every document d gets a rate r between 0 and 2. Of all rates that give each source its target number of words, the ones nearest
to 1 in relative entropy are exponentially tilted by the document's size: r = min(2, exp(lambda * size / mean size of the source)). The lambdas solve the
convex dual. Its gradient and curvature are sums over all documents; equal sizes of a source have equal rates, so each
Newton step is one aggregation over the (source, size) histogram, safeguarded by a bracket. Sums are decimal, so that no order of
rows changes them and reruns agree.

Rates become copies by systematic rounding: sizes of a source in falling order, running sum of fractions, a copy more at each whole
number; of `OFFSETS` starting points the one nearest the target is taken, and one copy is added or left out if that brings it nearer. Which documents of one size get the copy more
follows the hash of doc_id; ranks are taken within hash buckets, so a size that a third of all documents share is spread.

One row per source meets in one task to share out the targets; everything else is keyed by source, size and bucket.

Defined results: words are runs without ASCII white space; a null text has size 0, and size 0 takes 0 words; a null source is a source and
comes last; repeated rows count and are rounded one by one; a null doc_id is kept; an empty table gives no rows; other columns are
carried by `repeat` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from yushi.llm.tables import stored

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
OFFSETS, BUCKETS = 16, 1024
STEPS, CLOSE = 60, 1e-9


def size_of(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def keyed(docs: DataFrame, carried: Column) -> DataFrame:
    """src, no_src (the source without nulls), size, bucket, hash, and what is carried."""
    h = F.xxhash64("doc_id")
    return docs.select(
        F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"), size_of().alias("size"),
        F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"), h.alias("hash"), carried.alias("row"),
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """src, no_src, total to which a target is added. Shares by weight; what is above `most` times a source goes to the others by weight.

    That is min(most * total, level * weight) with one level for all, found where the sorted caps stop being below it."""
    order = W.orderBy("no_src", "src")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(most) * F.col("total")).withColumn("reach", F.col("cap") / F.col("weight"))
    every, before = W.partitionBy(), W.orderBy("reach", "no_src", "src").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("total").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / heavy)
    level = F.min(F.when(F.col("level") < F.col("reach"), F.struct("reach", "level"))).over(every)["level"]
    return rows.withColumn("at", level).withColumn("target", F.least("cap", F.coalesce(F.col("at") * F.col("weight"), "cap"))).drop("weight", "cap", "reach", "level", "at")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "no_src", "size").agg(F.count("*").alias("n"))


def _rate(size: str = "size") -> Column:
    """min(2, exp(lambda x)); 2 where a source is taken as often as it may be, 1 where it has no words."""
    x = F.col(size) / F.col("mean")
    return F.coalesce("fixed", F.least(F.lit(MOST), F.exp(F.least(F.col("lam") * x, F.lit(2.0)))))


def balance(hist: DataFrame, wanted: DataFrame) -> DataFrame:
    """src, no_src, total, target, mean, fixed, lam: Newton steps on the dual of all sources at once."""
    means = hist.groupBy("src", "no_src").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    fixed = F.when(F.col("total") == 0, 1.0).when(F.col("target") >= F.lit(MOST * (1 - CLOSE)) * F.col("total"), MOST)
    start = wanted.join(means, ["src", "no_src"]).withColumn("fixed", fixed)
    state = stored(
        start.withColumns({
            "lam": F.when(F.col("fixed").isNotNull(), 0.0).otherwise(F.log(F.col("target") / F.col("total"))),
            "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "off": F.lit(1.0),
        }),
        "balance",
    )
    for _ in range(STEPS):
        x, r = F.col("size") / F.col("mean"), _rate()
        words = F.col("n") * F.col("size")
        exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
        sums = (
            hist.join(state.filter(F.col("fixed").isNull()).select("src", "no_src", "mean", "fixed", "lam"), ["src", "no_src"]).groupBy("src", "no_src")
            .agg(exact(words * r).alias("got"), exact(F.when(r < MOST, words * r * x).otherwise(0.0)).alias("slope"))
        )
        g, lam = F.col("got") - F.col("target"), F.col("lam")
        lo = F.when(g <= 0, F.greatest(lam, F.coalesce("lo", lam))).otherwise(F.col("lo"))
        hi = F.when(g >= 0, F.least(lam, F.coalesce("hi", lam))).otherwise(F.col("hi"))
        reach = F.lit(1.0) + F.abs(lam)
        newton = lam - F.greatest(-reach, F.least(reach, F.when(F.col("slope") > 0, g / F.col("slope")).otherwise(F.signum(g) * reach)))
        middle = (F.col("lo2") + F.col("hi2")) / 2
        inside = (F.col("lo2").isNull() | (newton > F.col("lo2"))) & (F.col("hi2").isNull() | (newton < F.col("hi2")))
        step = F.when(g == 0, lam).when(inside, newton).when(F.col("lo2").isNotNull() & F.col("hi2").isNotNull(), middle).otherwise(newton)
        off = F.abs(g) / F.greatest(F.col("target"), F.lit(1.0))
        moved = (
            state.join(sums, ["src", "no_src"], "left").withColumns({"lo2": lo, "hi2": hi})
            .withColumns({"new": F.when(F.col("fixed").isNotNull() | (off <= CLOSE), lam).otherwise(step), "off": F.when(F.col("fixed").isNotNull(), 0.0).otherwise(off)})
        )
        state = stored(moved.select("src", "no_src", "total", "target", "mean", "fixed", F.col("new").alias("lam"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "off"), "balance")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= CLOSE:
            break
    return state.drop("lo", "hi", "off")


def rounded(hist: DataFrame, state: DataFrame) -> DataFrame:
    """src, no_src, size, least (copies of every document), more (documents with a copy more), target, total."""
    rate = _rate()
    rows = hist.join(state, ["src", "no_src"]).withColumn("rate", rate).withColumn("least", F.floor("rate").cast("long"))
    part = ((F.col("rate") - F.col("least")) * F.col("n")).cast("decimal(38,12)")
    falling = W.partitionBy("src", "no_src").orderBy(F.col("size").desc())
    rows = rows.withColumn("part", part).withColumn("end", F.sum("part").over(falling.rowsBetween(W.unboundedPreceding, 0)).cast("double"))
    rows = rows.withColumn("begin", F.coalesce(F.lag("end").over(falling), F.lit(0.0)))
    more = lambda u: F.least(F.col("n"), F.greatest(F.lit(0), F.floor(F.col("end") + u) - F.floor(F.col("begin") + u)))
    taken = lambda u: F.sum(F.col("size") * (F.col("n") * F.col("least") + more(F.lit(u))))
    offsets = [(k + 0.5) / OFFSETS for k in range(OFFSETS)]
    tries = rows.groupBy("src", "no_src").agg(*[taken(u).alias(f"u{k}") for k, u in enumerate(offsets)])
    best = state.select("src", "no_src", "target").join(tries, ["src", "no_src"]).select(
        "src", "no_src", F.array_min(F.array(*[F.struct(F.abs(F.col("target") - F.col(f"u{k}")).alias("d"), (F.col("target") - F.col(f"u{k}")).alias("off"), F.lit(u).alias("u")) for k, u in enumerate(offsets)])).alias("b"))
    rows = rows.join(best, ["src", "no_src"]).select("src", "no_src", "size", "n", "least", more(F.col("b.u")).alias("more"), F.col("b.off").alias("off"), "target", "total")
    # one copy more or less, of the size that brings the source nearest
    gap = F.abs(F.abs("off") - F.col("size"))
    can = ((F.col("off") > 0) & (F.col("more") < F.col("n")) & (F.col("least") < MOST)) | ((F.col("off") < 0) & (F.col("more") > 0))
    turned = rows.filter(can & (gap < F.abs("off"))).groupBy("src", "no_src").agg(F.min(F.struct(gap.alias("gap"), "size"))["size"].alias("turn"))
    turn = F.when(F.col("size") == F.col("turn"), F.signum("off").cast("long")).otherwise(0)
    return rows.join(turned, ["src", "no_src"], "left").select("src", "no_src", "size", "least", (F.col("more") + F.coalesce(turn, F.lit(0))).alias("more"), "target", "total")


def copies(rows: DataFrame, counts: DataFrame, classes: DataFrame) -> DataFrame:
    """rows with copies, target and total. counts has the number of rows by src, no_src, size and bucket."""
    key = ["src", "no_src", "size"]
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spread = counts.withColumn("before", before).join(classes, key).drop("n")
    place = F.row_number().over(W.partitionBy(*key, "bucket").orderBy("hash"))
    ranked = rows.withColumn("place", place).join(spread, [*key, "bucket"])
    return ranked.withColumn("copies", F.col("least") + F.when(F.col("before") + F.col("place") <= F.col("more"), 1).otherwise(0))


def _mixed(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """rows with copies, target, total; narrow is the same without what is carried."""
    counts = stored(narrow.groupBy("src", "no_src", "size", "bucket").agg(F.count("*").alias("n")), "counts")
    hist = stored(counts.groupBy("src", "no_src", "size").agg(F.sum("n").alias("n")), "sizes")
    sources = hist.groupBy("src", "no_src").agg(F.sum(F.col("n") * F.col("size")).alias("total"))
    state = balance(hist, targets(sources))
    return copies(rows, counts, stored(rounded(hist, state), "classes"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row."""
    rows = stored(keyed(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"))), "rows")
    mixed = _mixed(rows, rows.drop("row"))
    return mixed.select("row.doc_id", "row.source", "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs."""
    rows = keyed(docs, F.struct("*"))
    narrow = stored(rows.drop("row"), "rows")
    mixed = _mixed(rows, narrow)
    return mixed.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def mix_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of every source as often as its target asks for."""
    return repeat(docs)
