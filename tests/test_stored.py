"""Stored layers: versions, the clustered product layer, pages by number."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF
from yushi.operators import layers, pages, search
from yushi.plans import catalog
from yushi.sources import corpus


def values(df):
    return sorted(tuple(r) for r in df.select("v", "p").collect())


def test_a_version_replaces_its_partitions(spark, tmp_path):
    path = str(tmp_path / "layer")
    write = lambda rows: layers.write_version(spark.createDataFrame(rows, "v int, p string"), path, "p")
    write([(1, "a"), (2, "b"), (9, None)])
    write([(3, "b")])
    assert values(layers.read_version(spark, path, "p").na.fill({"p": "-"})) == [(1, "a"), (3, "b"), (9, "-")]
    write([(4, "a"), (5, "b"), (6, None)])
    assert values(layers.read_version(spark, path, "p").na.fill({"p": "-"})) == [(4, "a"), (5, "b"), (6, "-")]
    plan = layers.read_version(spark, path, "p").where("p = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "(p#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_layer_without_partitions(spark, tmp_path):
    path = str(tmp_path / "layer")
    for k in (1, 2):
        layers.write_version(spark.createDataFrame([(k, "x")], "v int, p string"), path)
    assert values(layers.read_version(spark, path)) == [(2, "x")]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    """Partition a is written, then b fails: readers still have the old rows, and a later writer goes on."""
    path = str(tmp_path / "layer")
    layers.write_version(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    broken = spark.createDataFrame([(7, "a"), (8, "b")], "v int, p string").repartition(2, "p").withColumn("v", F.when(F.col("p") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        layers.write_version(broken, path, "p")
    assert values(layers.read_version(spark, path, "p")) == [(1, "a"), (2, "b")]
    # rows written, manifest not: the same
    spark.createDataFrame([(7, "a")], "v int, p string").write.partitionBy("p").parquet(f"{path}/version-lost")
    assert values(layers.read_version(spark, path, "p")) == [(1, "a"), (2, "b")]
    layers.write_version(spark.createDataFrame([(3, "a")], "v int, p string"), path, "p")
    assert values(layers.read_version(spark, path, "p")) == [(2, "b"), (3, "a")]


LOAN = "id int, loan_type string, interest_rate_min double, interest_rate_max double, loan_amount_min long, loan_amount_max long, loan_term_min int, loan_term_max int"


@pytest.fixture(scope="module")
def loans(spark):
    rng = random.Random(4)
    pick = lambda lo, hi: None if rng.random() < 0.1 else rng.randint(lo, hi)
    out = []
    for k in range(6000):
        r, a, t = pick(1, 15), pick(1, 90), pick(1, 30)
        out.append((k, "t", None if r is None else r / 1.0, None if rng.random() < 0.1 else (r or 3) + 1.5, None if a is None else a * 100_000, None if rng.random() < 0.1 else (a or 9) * 200_000, t, pick(30, 40)))
    return spark.createDataFrame(out, LOAN)


@pytest.mark.parametrize("asked", [{"rate": (2.0, 3.0)}, {"amount": (300_000, 500_000)}, {"term": (1, 2)}, {"rate": (1.0, 2.0), "amount": (0, 200_000), "term": (3, 9)}])
def test_open_ends_find_what_nulls_do(loans, asked):
    query = search.LoanQuery(loan_type=None, **asked)
    ids = lambda df: sorted(r.id for r in df.select("id").collect())
    assert 0 < len(ids(search.search(loans, query))) and ids(search.search(loans, query)) == ids(search.search(search.with_open_ends(loans), query))


def test_clustered_rows_skip_row_groups(spark, loans, tmp_path):
    rows = search.with_open_ends(loans).withColumn("_place", search.curve())

    def groups(df, name):
        """Row groups whose bounds let a row through, and all."""
        path = str(tmp_path / name)
        df.coalesce(1).write.option("parquet.block.size", 8192).option("parquet.page.size", 1024).parquet(path)
        hit = total = 0
        for f in (tmp_path / name).glob("*.parquet"):
            meta = pq.ParquetFile(f).metadata
            for g in range(meta.num_row_groups):
                c = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k).statistics for k in range(meta.num_columns)}
                total += 1
                hit += c["rate_from"].min <= 2.0 and c["rate_to"].max >= 1.0 and c["amount_from"].min <= 300_000 and c["amount_to"].max >= 100_000
        return hit, total

    near, total = groups(rows.orderBy("_place"), "near")
    anyhow, same = groups(rows.orderBy(F.xxhash64("id")), "anyhow")
    assert total > 10 and near < 0.6 * total and anyhow > 0.9 * same


def test_ranges_are_pushed_to_the_stored_layer(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = catalog.search_facets(spark, SF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert all(f"{x}_from" in pushed and f"{x}_to" in pushed for x in ("rate", "amount", "term")) and plan.count("FileScan") == 1


def test_page_numbers_equal_a_full_sort(spark, tmp_path):
    """Page 10,000 of rows with many ties, NULLs and a hot value, from the parts it lies in."""
    df = spark.range(30_000).selectExpr("id", "IF(id % 3 = 0, 7, IF(id % 11 = 0, NULL, id % 1000)) AS sort")
    order = [F.col("sort").desc_nulls_last(), F.col("id")]
    pages.store(df, order, str(tmp_path / "o"), 12)
    whole = [tuple(r) for r in df.orderBy(*order).collect()]
    for size, number in ((3, 10_000), (3, 1), (3, 4_321), (2_999, 5), (40_000, 1), (100, 301)):
        got = pages.page(spark, str(tmp_path / "o"), order, size, number)
        assert [tuple(r) for r in got.select("id", "sort").collect()] == whole[size * (number - 1):size * number]
    parts = {r._part: r.n for r in spark.read.parquet(str(tmp_path / "o" / "directory")).collect()}
    assert len(parts) == 12 and max(parts.values()) < 6_000  # the hot value, a third of all rows, is cut
    plan = pages.page(spark, str(tmp_path / "o"), order, 3, 4_321)._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "Exchange rangepartitioning" not in plan


def test_the_queue_goes_by_the_ids_that_products_carry(spark):
    """Versions of the earlier run that no product carries come up again, in the SQL too."""
    from yushi.check_sql import checks

    got = [r.processed_id for r in catalog.queue_integrate(spark, SF).collect()]
    carried = {r.processed_data_id for r in catalog.integrated_products(spark, SF).select("processed_data_id").collect()}
    done = corpus.processed_rows(spark, SF).where("processing_status = 'completed'").join(corpus.institutions(spark, SF), "institution_id", "left_semi")
    todo = [r.processed_id for r in done.orderBy(F.col("processed_at").desc(), "processed_id").select("processed_id").collect() if r.processed_id not in carried]
    assert got == todo[:10]
    assert "priority" not in checks()["queue_integrate"].rsplit(" d ON d.done", 1)[1]


def test_rejects_of_the_earlier_run_are_rejected_again(spark):
    early = corpus.processed_rows(spark, SF).where(corpus.INTEGRATED_WHERE).select(F.col("processed_id").alias("processed_data_id"))
    rejects = catalog.integrate_job_rejects(spark, SF)
    everything = catalog.integration_rejects(spark, SF)
    again = rejects.join(early, "processed_data_id", "left_semi").count()
    assert again > 0 and again == everything.join(early, "processed_data_id", "left_semi").count()


def test_a_bucket_is_one_file_whatever_the_number_of_tasks(spark, tmp_path):
    from yushi.operators import queues

    rows = spark.range(1000).withColumnRenamed("id", "processed_id").repartition(7)
    stored = queues.stored_by_id(rows, str(tmp_path / "b"), "one_file_a_bucket")
    assert len(list((tmp_path / "b").glob("part-*.parquet"))) == queues.BUCKETS and stored.count() == 1000
    spark.sql("DROP TABLE one_file_a_bucket")
