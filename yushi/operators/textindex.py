"""Stored inverted index over the two-character pieces of texts.

An index is a folder with two tables and one row about the whole:

* `postings` (bucket, slice, bigram, key): which documents hold a bigram. Buckets are hashes of the bigram and folders, so a
  search lists only those of its own bigrams; a bigram that very many documents hold is dealt over slices by the hash of the key, so
  no task and no file holds all of it.
* `frequencies` (bucket, bigram, df): how many documents hold it.
* `about` (documents).

A search ranks by summed idf weights. Whoever must hold m of n bigrams holds one of the n - m + 1 rarest, so only documents from those lists
are candidates; the long lists of frequent bigrams are filtered by them before anything is summed.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yushi.operators.search import bigrams

BUCKETS = 64
#: Documents of one slice of a bigram's list.
SLICE = 1_000_000


def _bucket(bigram: Column) -> Column:
    return F.pmod(F.xxhash64(bigram), F.lit(BUCKETS)).cast("int")


def text_of(texts: list[str]) -> Column:
    return F.concat_ws(" ", *texts)


def build(docs: DataFrame, key: str, texts: list[str], path: str, slice_size: int = SLICE) -> None:
    """Write the index of all documents; `key` is unique and not null."""
    spark = docs.sparkSession
    found = docs.select(F.col(key).alias("key"), F.explode(bigrams(text_of(texts))).alias("bigram"))
    counts = found.groupBy("bigram").agg(F.count("*").alias("df")).withColumn("bucket", _bucket(F.col("bigram")))
    counts.repartition("bucket").sortWithinPartitions("bucket", "bigram").write.partitionBy("bucket").parquet(f"{path}/frequencies")
    often = spark.read.parquet(f"{path}/frequencies").where(F.col("df") > slice_size).select("bigram", "df")
    slices = F.pmod(F.xxhash64("key"), F.ceil(F.coalesce("df", F.lit(1)) / slice_size)).cast("int")
    dealt = found.join(often, "bigram", "left").select(_bucket(F.col("bigram")).alias("bucket"), slices.alias("slice"), "bigram", "key")
    dealt.repartition("bucket", "slice").sortWithinPartitions("bucket", "slice", "bigram", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    docs.agg(F.count("*").alias("documents")).write.parquet(f"{path}/about")


def _lists(spark: SparkSession, path: str, table: str, asked: list[str]) -> DataFrame:
    """Rows of the asked bigrams; the buckets are known when the plan is made, so other folders are not listed."""
    some = F.col("bucket").isin(sorted({_bucket_number(spark, b) for b in asked}))
    return spark.read.parquet(f"{path}/{table}").where(some & F.col("bigram").isin(asked))


def _bucket_number(spark: SparkSession, bigram: str) -> int:
    return spark.range(1).select(_bucket(F.lit(bigram))).first()[0]


def pieces(words: str) -> list[str]:
    """Distinct bigrams of a query, in order of their first place."""
    return list(dict.fromkeys(words[i:i + 2] for i in range(max(1, len(words) - 1)) if words))


def search(spark: SparkSession, path: str, words: str, share: float = 0.5) -> DataFrame:
    """key, n_bigrams, score of all documents with at least `share` of the query's bigrams; score is the sum of their idf weights.

    On the driver are one frequency for each bigram of the query, nothing that grows with the documents."""
    asked = pieces(words)
    total = spark.read.parquet(f"{path}/about").first().documents
    df = {r.bigram: r.df for r in _lists(spark, path, "frequencies", asked).select("bigram", "df").collect()} if asked else {}
    least, known = max(1, ceil(share * len(asked))), sorted(df, key=lambda b: (df[b], b))
    if len(known) < least:
        return spark.createDataFrame([], spark.read.parquet(f"{path}/postings").select("key").schema.add("n_bigrams", "long").add("score", "double"))
    weight = {b: F.log(F.lit(1 + (total - n + 0.5) / (n + 0.5))) for b, n in df.items()}
    lists = _lists(spark, path, "postings", known)
    # of the bigrams that occur, a hit lacks len(known) - least at most
    rare, often = known[:len(known) - least + 1], known[len(known) - least + 1:]
    seeds = lists.where(F.col("bigram").isin(rare)).select("key", "bigram")
    more = lists.where(F.col("bigram").isin(often)).select("key", "bigram").join(seeds.select("key").distinct(), "key", "left_semi")
    own = F.coalesce(*[F.when(F.col("bigram") == b, w) for b, w in weight.items()])
    hits = seeds.unionAll(more).groupBy("key").agg(F.count("*").alias("n_bigrams"), F.sum(own).alias("score"))
    return hits.where(F.col("n_bigrams") >= least)


def best(docs: DataFrame, key: str, path: str, words: str, best: int, order: list[str], share: float = 0.5) -> DataFrame:
    """The `best` documents of a search with all their columns, n_bigrams and score; ties by the columns in `order`."""
    hits = search(docs.sparkSession, path, words, share).withColumn("score", F.round("score", 6))
    found = docs.join(hits.withColumnRenamed("key", key), key)
    return found.orderBy(F.col("score").desc(), *order).limit(best)
