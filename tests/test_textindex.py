"""The stored text index against a scan of all texts."""

import math
import random

import pytest

from conftest import SF
from yushi.operators import textindex
from yushi.plans import catalog

SIGNS = "ローン住宅教育車の金利abc 1"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [(k, "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 12))), rng.choice(["ローン", None, ""])) for k in range(400)]
    return out + [(400 + k, "教育ローン" + str(k), "hot") for k in range(300)]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    docs = spark.createDataFrame(texts, "id long, a string, b string").repartition(4)
    textindex.build(docs, "id", ["a", "b"], path, slice_size=50)
    return path


def scan(texts, words, share):
    body = {k: " ".join(x for x in (a, b) if x is not None) for k, a, b in texts}
    grams = {k: ({t[i:i + 2] for i in range(max(1, len(t) - 1))} if t else set()) for k, t in body.items()}
    asked = {words[i:i + 2] for i in range(max(1, len(words) - 1))}
    df = {g: sum(g in s for s in grams.values()) for g in asked}
    weight = {g: math.log(1 + (len(body) - n + 0.5) / (n + 0.5)) for g, n in df.items()}
    least = max(1, math.ceil(share * len(asked)))
    return {k: (len(s & asked), round(sum(weight[g] for g in s & asked), 6)) for k, s in grams.items() if len(s & asked) >= least}


@pytest.mark.parametrize("words, share", [("教育ローン", 0.5), ("教育ローン", 1.0), ("住宅ローンの金利", 0.3), ("の", 0.5), ("zzz教育", 0.4), ("教育", 0.0), ("zz", 0.5)])
def test_index_equals_a_scan(spark, texts, index, words, share):
    got = {r.key: (r.n_bigrams, round(r.score, 6)) for r in textindex.search(spark, index, words, share).collect()}
    assert got == scan(texts, words, share)


def test_nothing_asked_nothing_found(spark, index):
    assert textindex.search(spark, index, "").count() == 0


def test_a_hot_bigram_is_split(spark, index):
    lists = spark.read.parquet(f"{index}/postings")
    parts = lists.where("bigram = '教育'").groupBy("slice").count().collect()
    df = spark.read.parquet(f"{index}/frequencies").where("bigram = '教育'").first().df
    assert df > 300 and len(parts) == -(-df // 50) and max(r["count"] for r in parts) < 100


def test_only_buckets_of_the_query_are_read(spark):
    plan = catalog.search_text(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:] if "bigram" in x.split("]")[0]]
    assert scans and all("bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
    hits = catalog.search_text(spark, SF)
    assert hits.count() <= 50 and hits.where("n_bigrams < 4").count() == 0


def test_best_breaks_ties_by_order(spark, texts, index):
    docs = spark.createDataFrame(texts, "id long, a string, b string")
    got = [(r.id, r.score) for r in textindex.best(docs, "id", index, "教育ローン", 20, ["id"]).collect()]
    want = sorted(((k, s) for k, (_, s) in scan(texts, "教育ローン", 0.5).items()), key=lambda x: (-x[1], x[0]))[:20]
    assert got == want
