"""Layers, queues, merges and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF
from yushi.operators import identity, layers, links, matching, metrics, queues, search
from yushi.plans import catalog
from yushi.plans import layers as plans
from yushi.sources import corpus, seeds
from yushi.streaming import ingest


@pytest.fixture(scope="module")
def raw(spark):
    return catalog.raw_layer_rows(spark, SF).persist()


def rows(df):
    return sorted(map(str, df.collect()))


def test_dedup_counts_hashes(raw):
    layer = plans.ingest_raw(raw)
    assert layer.count() == raw.select("content_hash").distinct().count()
    assert layer.agg(F.sum("copies")).first()[0] == raw.count()


def test_ingest_in_any_batching(raw):
    """Two batches in either order give the layer of one batch; a rerun changes no row."""
    early, late = raw.where("scraped_at < '1998-01-01'"), raw.where("scraped_at >= '1998-01-01'")
    whole = rows(layers.as_layer(plans.ingest_raw(raw)))
    assert rows(layers.as_layer(plans.ingest_raw(late, plans.ingest_raw(early)))) == whole
    assert rows(layers.as_layer(plans.ingest_raw(early, plans.ingest_raw(late)))) == whole
    again = layers.as_layer(plans.ingest_raw(raw, plans.ingest_raw(raw))).drop("copies")
    assert rows(again) == rows(layers.as_layer(plans.ingest_raw(raw)).drop("copies"))


def test_queue_and_done_make_all(spark):
    pages, done = corpus.raw_pages(spark, SF), corpus.processed_rows(spark, SF)
    todo = queues.unprocessed(pages, corpus.institutions(spark, SF), done, limit=None)
    assert todo.count() + done.count() == pages.count()
    failed = done.where("processing_status = 'failed'").count()
    again = queues.unprocessed(pages, corpus.institutions(spark, SF), done, limit=None, retry=True)
    assert again.count() == todo.count() + failed


def test_consumed_leaves_the_queue(spark):
    done = catalog.processed_layer(spark, SF)
    known, dim = catalog.integrated_products(spark, SF), corpus.institutions(spark, SF)
    open_rows = queues.unintegrated(done, dim, known, limit=None)
    consumed = open_rows.select("processed_id")
    assert queues.unintegrated(done, dim, known, limit=None, consumed=consumed).count() == 0


def test_ledger_needs_no_exchange_and_keeps_later_versions_out(spark):
    df = catalog.queue_integrate(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("LeftAnti"):]
    assert plan.count("FileScan parquet") == 3 and plan.count("Bucketed: true") == 2  # processed rows, ledger, names
    below = join[:join.index("BroadcastExchange")] if "BroadcastExchange" in join else join
    assert "Exchange hashpartitioning" not in below and "SortAggregate" not in plan
    early = {r.processed_data_id for r in catalog.product_versions(spark, SF).where("early").collect()}
    everything = queues.open_rows(catalog.processed_table(spark, SF), catalog.ledger(spark, SF), corpus.institutions(spark, SF), limit=None)
    assert early and not early & {r.processed_id for r in everything.collect()}


def test_ledger_grows_by_what_a_run_took(spark, tmp_path):
    queues.record(spark.createDataFrame([(1,), (2,)], "processed_id long"), str(tmp_path / "l"), "ledger_grows")
    queues.record(spark.createDataFrame([(2,), (5,)], "processed_id long"), str(tmp_path / "l"), "ledger_grows")
    assert sorted(r.processed_id for r in spark.table("ledger_grows").collect()) == [1, 2, 2, 5]
    done = spark.createDataFrame([(k, k, 1, "completed", dt.datetime(2024, 1, k)) for k in (1, 2, 3, 4, 5)], "processed_id long, raw_id long, institution_id long, processing_status string, processed_at timestamp")
    names = spark.createDataFrame([(1, "x")], "institution_id long, institution_name string")
    assert [r.processed_id for r in queues.open_rows(done, spark.table("ledger_grows"), names).collect()] == [4, 3]


@pytest.mark.parametrize("name", ["dedup_pages", "upsert_products", "upsert_products_literal", "dedup_by_source"])
def test_winners_are_chosen_by_fixed_width_keys(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "HashAggregate" in plan


def test_repeated_captures_and_odd_numbers(spark):
    """The same capture twice is one version; ids and times below zero keep their order; keys may be NULL."""
    def at(year, month=1):
        return dt.datetime(year, month, 1)
    cols = "k string, raw_id long, scraped_at timestamp, v string"
    data = [("a", 5, at(2024), "x"), ("a", 5, at(2024), "x"), ("a", -9, at(2024), "y"), ("a", 2**62, at(1901), "old"), ("a", -(2**62), at(1901), "oldest"),
            (None, 1, at(2024), "n"), (None, 2, at(2024, 2), "m"), ("b", -1, at(1950), "b")]
    got = {r.k: (r.first.v, r.last.v, r.copies) for r in layers.page_versions(spark.createDataFrame(data, cols), ["v"], ["v"], ("k",)).collect()}
    assert got == {"a": ("oldest", "x", 5), None: ("n", "m", 2), "b": ("b", "b", 1)}


def test_history_of_two_runs_is_that_of_one(spark):
    """The stored products are the last versions, so a run compares only what comes in."""
    rows_ = [product(1, 1, 1.0), product(2, 5, 2.0), product(3, 9, 2.0), product(4, 12, 4.0), product(5, 2, 7.0, "b"), product(6, 20, 8.0, "b")]
    every = spark.createDataFrame(rows_, PRODUCT)
    fields = ["summary", "interest_rate_min"]
    step = lambda df: rows(df.select(*layers.PRODUCT_KEY, "processed_data_id", "changed_fields", "old_values", "new_values", "changed_at"))
    whole = step(layers.history(every, fields))
    early, late = every.where("data_updated_at < '2024-01-07'"), every.where("data_updated_at >= '2024-01-07'")
    stored = layers.upsert(every.where("false"), early)
    assert sorted(step(layers.history(early, fields)) + step(layers.history(late, fields, last=stored))) == whole


PRODUCT = ("institution_id long, product_name string, loan_type string, processed_data_id long, loan_category string, summary string, "
           "interest_rate_min double, interest_rate_max double, interest_rate_type string, loan_amount_min long, loan_amount_max long, "
           "loan_term_min int, loan_term_max int, repayment_methods array<string>, application_requirements string, features string, "
           "data_updated_at timestamp")


def product(no, day, rate, name="a", category="c"):
    return (1, name, "t", no, f"{category}{no}", f"s{no}", rate, rate, "変動金利", 1, 2, 1, 2, ["r"], f"q{no}", "f", dt.datetime(2024, 1, day))


def test_upsert_orders(spark):
    current = spark.createDataFrame([product(1, 1, 1.0)], PRODUCT)
    new = spark.createDataFrame([product(2, 5, 2.0), product(3, 3, 3.0), product(4, 2, 9.0, "b"), product(5, 8, 8.0, "b")], PRODUCT)
    got = {r.product_name: r for r in layers.upsert(current, new).collect()}
    assert (got["a"].processed_data_id, got["a"].loan_category, got["a"].interest_rate_min) == (1, "c1", 2.0)
    assert (got["b"].processed_data_id, got["b"].interest_rate_min) == (4, 8.0)
    got = {r.product_name: r for r in layers.upsert(current, new, "literal").collect()}
    assert (got["a"].processed_data_id, got["a"].interest_rate_min) == (1, 3.0)
    assert (got["b"].processed_data_id, got["b"].interest_rate_min) == (5, 9.0)


def test_history(spark):
    versions = spark.createDataFrame([product(1, 1, 1.0), product(2, 2, 2.0), product(3, 9, 2.0)], PRODUCT)
    steps = layers.history(versions, ["summary", "interest_rate_min"]).orderBy("changed_at").collect()
    assert [s.changed_fields for s in steps] == [["summary", "interest_rate_min"], ["summary"]]
    assert steps[0].old_values == {"summary": "s1", "interest_rate_min": "1.0"} and steps[1].new_values == {"summary": "s3"}


def test_history_keeps_every_version(spark):
    """Three versions in a month and one in the next: three steps; the requirements are watched too."""
    def at(no, month, day, rate, need):
        row = list(product(no, day, rate))
        row[14], row[16] = need, dt.datetime(2024, month, day)
        return tuple(row)
    versions = spark.createDataFrame([at(1, 1, 5, 1.0, "x"), at(2, 1, 20, 2.0, "x"), at(3, 1, 25, 3.0, "x"), at(4, 3, 1, 3.0, "y")], PRODUCT)
    fields = [f for f in plans.HISTORY_FIELDS if f != "summary"]
    steps = layers.history(versions, fields).orderBy("changed_at").collect()
    assert [s.changed_fields for s in steps] == [["interest_rate_min", "interest_rate_max"]] * 2 + [["application_requirements"]]
    assert [s.processed_data_id for s in steps] == [2, 3, 4] and steps[2].old_values == {"application_requirements": "x"}


def test_update_takes_new_requirements(spark):
    got = layers.upsert(spark.createDataFrame([product(1, 1, 1.0)], PRODUCT), spark.createDataFrame([product(2, 5, 2.0)], PRODUCT)).first()
    assert got.application_requirements == "q2" and got.processed_data_id == 1


def test_integrate_run(spark):
    done, dim = catalog.processed_layer(spark, SF), corpus.institutions(spark, SF)
    out = plans.integrate(done, catalog.structured_rows(spark, SF), dim, catalog.integrated_products(spark, SF))
    products = out["products"]
    assert products.count() == products.select(*layers.PRODUCT_KEY).distinct().count()
    assert {r.reason for r in out["rejects"].collect()} == {"null_product_name"}
    assert out["history"].count() > 0


def test_process_batch(spark, raw):
    def summarise(batches):
        for b in batches:
            yield b.assign(response_text=["```json\n{\"data_confidence\":{\"analysis_reliability\":\"%d\"}}\n```" % (len(p) % 10)
                                          for p in b["prompt"]])[["raw_id", "response_text"]]

    out = plans.process_batch(raw, corpus.institutions(spark, SF), corpus.processed_rows(spark, SF), summarise, "m1", limit=25)
    got = out.collect()
    assert len(got) == 25 and all(r.parse_ok and r.validation_status == "valid" for r in got)
    assert all(r.validation_messages.startswith('{"analysis_reliability"') for r in got)


def test_stream_equals_batch(spark, raw, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    months = [raw.where("scraped_at >= '1998-01-01'"), raw.where("scraped_at < '1998-01-01'")]
    months[0].coalesce(1).write.parquet(source)
    ingest.start(spark.readStream.schema(raw.schema).parquet(source), out, check).awaitTermination()
    months[1].coalesce(1).write.mode("append").parquet(source)
    ingest.start(spark.readStream.schema(raw.schema).parquet(source), out, check).awaitTermination()
    assert rows(layers.as_layer(ingest.read(spark, out))) == rows(layers.as_layer(plans.ingest_raw(raw)))
    newest = raw.agg(F.max("scraped_at")).first()[0]
    line = newest - dt.timedelta(days=30)
    assert ingest.late_pages(spark, out).first().late == months[1].where(F.col("scraped_at") < F.lit(line)).count()
    small = str(tmp_path / "small")
    late = ingest.late_pages(spark, out).first().late
    ingest.compact(spark, out, small)
    assert ingest.read(spark, small).count() == plans.ingest_raw(raw).count() and ingest.late_pages(spark, small).first().late == late


def test_stream_goes_on_behind_compaction(spark, raw, tmp_path):
    """Compact, then a new query on the compacted folder: nothing is lost, late pages stay counted."""
    out, small = str(tmp_path / "out"), str(tmp_path / "small")
    for part, folder in ((raw.where("scraped_at >= '1998-01-01'"), "a"), (raw.where("scraped_at < '1998-01-01'"), "b")):
        source = str(tmp_path / folder)
        part.repartition(3).write.parquet(source)
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.start(stream, out if folder == "a" else small, str(tmp_path / f"check-{folder}")).awaitTermination()
        if folder == "a":
            ingest.compact(spark, out, small)
    assert rows(layers.as_layer(ingest.read(spark, small))) == rows(layers.as_layer(plans.ingest_raw(raw)))
    line = raw.agg(F.max("scraped_at")).first()[0] - dt.timedelta(days=30)
    before = ingest.late_pages(spark, out).first().late
    later = raw.where("scraped_at < '1998-01-01'").where(F.col("scraped_at") < F.lit(line)).count()
    assert ingest.late_pages(spark, small).first().late == before + later


def test_stream_refuses_parts_of_a_lost_checkpoint(spark, raw, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    raw.limit(50).write.parquet(source)
    stream = lambda: spark.readStream.schema(raw.schema).parquet(source)
    ingest.start(stream(), out, str(tmp_path / "check")).awaitTermination()
    before = rows(ingest.read(spark, out))
    with pytest.raises(ValueError, match="checkpoint"):
        ingest.start(stream(), out, str(tmp_path / "other"))
    ingest.start(stream(), out, str(tmp_path / "check")).awaitTermination()
    assert rows(ingest.read(spark, out)) == before


def test_a_repeated_run_leaves_the_same_totals(spark, tmp_path):
    from yushi.plans import extract

    pages = catalog.ruled_pages(spark, SF).drop("product_name")
    go = lambda run: plans.run_all({r: pages.where(F.col("source_rule") == r) for r in extract.RULES}, extract.RULES, run, str(tmp_path / "log"))
    summary = lambda out: rows(out["summary"].drop("started", "ended"))
    first, other = summary(go("a")), summary(go("b"))
    again = go("a")
    assert summary(again) == first and first[0].replace("run_id='a'", "run_id='b'") == other[0]
    assert again["summary"].first().total == again["counters"]["total"] > again["counters"]["ok"] > 0
    assert again["products"].count() == again["counters"]["ok"] and "html_content" not in str(again["log"]._jdf.queryExecution().executedPlan().toString())


def test_withdrawn_products_are_stored_and_filtered_by_the_scan(spark):
    plan = catalog.active_products(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "is_active" in plan.split("PushedFilters: [")[1].split("]")[0]
    every = catalog.stored_products(spark, SF)
    assert 0 < catalog.active_products(spark, SF).count() < every.count()


def test_dense_ids(spark):
    keys = spark.range(5000).select(F.col("id").cast("string").alias("k"))
    got = identity.dense_ids(keys, F.col("k"), F.lit(100), "n")
    in_order = [r.k for r in got.orderBy("n").collect()]
    assert sorted(r.n for r in got.collect()) == list(range(101, 5101))
    import hashlib
    assert in_order == sorted(in_order, key=lambda k: hashlib.md5(k.encode()).hexdigest())


def test_resolve_with_seed(spark):
    seen = spark.createDataFrame([("1250", ""), ("0004", "x"), ("", "青森銀行"), ("9999", "新"), ("9999", "別"), ("", "")],
                                 "institution_code string, institution_name string")
    got = {(r.institution_code, r.institution_name): r for r in identity.resolve_institutions(seen, seeds.institutions(spark)).collect()}
    assert got["1250", ""].institution_id == 3 and got["0004", "x"].institution_id == 4 and got["", "青森銀行"].institution_id == 1
    assert got["9999", "新"].institution_id == got["9999", "別"].institution_id == 7 and got["9999", "新"].is_new
    assert got["", ""].institution_id is None


SAID = "institution_code string, institution_name string"


def test_new_institutions_share_codes_or_names(spark):
    seen = spark.createDataFrame([("9001", "X"), ("9002", "X"), ("", "X"), (None, "Y"), ("9003", None), ("9003", "Y"), ("9004", "")], SAID)
    got = {(r.institution_code, r.institution_name): r.institution_id for r in identity.resolve_institutions(seen, seeds.institutions(spark)).collect()}
    assert got["9001", "X"] == got["9002", "X"] == got["", "X"] and got[None, "Y"] == got["9003", None] == got["9003", "Y"]
    assert sorted(set(got.values())) == [7, 8, 9]


def test_components_against_union_find(spark):
    """A chain of 50 codes and names, a hot node with 300 others, single nodes, random edges."""
    import random

    rng = random.Random(7)
    edges = [(f"0c{k // 2}", f"1c{(k + 1) // 2}") for k in range(99)] + [(f"0h{k}", "1hot") for k in range(300)] + [("1hot", "0h7"), ("0s", "0s")]
    edges += [(f"0r{rng.randint(0, 120)}", f"1r{rng.randint(0, 120)}") for _ in range(90)]
    rng.shuffle(edges)
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        root[hi] = lo
    got = {r.node: r.root for r in identity.components(spark.createDataFrame(edges, "a string, b string").repartition(4)).collect()}
    assert got == {x: find(x) for x in root}
    assert len({v for k, v in got.items() if k[1] == "c"}) == 1
    assert identity.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_a_name_that_a_third_of_all_rows_share(spark):
    pages = spark.range(3000).selectExpr("CAST(id AS STRING) AS institution_code", "IF(id % 3 = 0, '信金', concat('n', id)) AS institution_name")
    dim = spark.createDataFrame([(5, "信用", ["0000x"])], "institution_id long, institution_name string, codes array<string>")
    out = identity.resolve_institutions(pages, dim)
    assert out.count() == 3000 and out.where("institution_name = '信金'").select("institution_id").distinct().count() == 1
    assert out.agg(F.max("institution_id")).first()[0] == 5 + 2001


def test_name_match_against_pairs(spark):
    """The substring join finds what comparing all pairs finds."""
    web = [(1, 10, "とうしんカーライフプラン"), (1, 11, "教育ローン"), (1, 12, "新教育ローン"), (2, 13, "フリーローン"), (1, 9, "ローン")]
    sheets = [(1, "カーライフプラン"), (1, "とうしんカーライフプラン"), (1, "新教育ローンα"), (1, "定期"), (2, "フリー"), (2, "とうしんカードローン")]
    w = spark.createDataFrame(web, "institution_id long, web_pos long, web_name string")
    b = spark.createDataFrame(sheets, "institution_id long, brochure_name string")
    got = {(r.institution_id, r.brochure_name): r.web_pos for r in matching.match_names(w, b).collect()}
    from yushi.fixed_values import NAME_ALIASES
    want = {}
    for inst, name in sheets:
        hits = [p for i, p, n in web if i == inst and (name in n or n in name or any(a in n for a in NAME_ALIASES.get(name, [])))]
        if hits:
            want[inst, name] = min(hits)
    assert got == want


def test_run_summary(spark):
    def log(run, oks):
        return [(run, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=30 * i), i, ok) for i, ok in enumerate(oks)]
    df = spark.createDataFrame(log("a", [1, 1, 1, 1]) + log("b", [1, 0, 1, 0]) + log("c", [0, 0, 0, 0]),
                               "run_id string, ts timestamp, source_no int, ok int")
    got = {r.run_id: (r.success_count, r.error_count, r.status_code, r.duration_seconds) for r in metrics.run_summary(df).collect()}
    assert got == {"a": (4, 0, 200, 90.0), "b": (2, 2, 207, 90.0), "c": (0, 4, 500, 90.0)}


def test_empty_success_rate(spark):
    df = spark.createDataFrame([], "s string")
    assert metrics.success_rate(df, F.col("s") == "x").first().success_rate == 0.0


def test_search(spark):
    loans = spark.createDataFrame([(1, 10, "住宅ローン", 0.45), (2, 10, "マイカーローン", 1.2), (3, 20, "住宅ローン", 0.6), (4, 20, "教育ローン", 1.1)],
                                  "id int, institution_id int, loan_type string, interest_rate_min double")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(search.search(loans, search.LoanQuery())) == [1, 3]
    assert ids(search.search(loans, search.LoanQuery(max_rate=0.5))) == [1]
    assert ids(search.search(loans, search.LoanQuery(loan_type=None, institution_id=20))) == [3, 4]
    assert ids(search.search(loans, search.LoanQuery(loan_type=None))) == [1, 2, 3, 4]
    order = [F.col("interest_rate_min"), F.col("id")]
    first, second = search.page(loans, order, 2).collect(), search.page(loans, order, 2, 2).collect()
    deep = search.after(loans, "interest_rate_min", "id", first[-1].interest_rate_min, first[-1].id, 2).collect()
    assert [r.id for r in first] == [1, 3] and deep == second


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "教育ローンの説明"), (2, "住宅ローン"), (3, "定期")], "id int, t string")
    got = {r.id: r.score for r in search.text_search(docs, ["t"], "教育ローン").collect()}
    assert got == {1: 4, 2: 2}
    assert [r.id for r in search.text_search(docs, ["t"], "教育ローン", share=0.6).collect()] == [1]
    assert [r.id for r in search.text_search(docs, ["t"], "教育ローン", order=["id"], best=1).collect()] == [1]
    assert [r.id for r in search.text_search(docs, ["t"], "教育ローン", exact=True).collect()] == [1]


def test_links(spark):
    html = '<a href="/kojin/loan/car/">x</a> <A class="b" HREF=\'house\'>y</A><a href="/kojin/loan/">z</a><a href="/kojin/loan/a/b">w</a><a href="http://h.example/kojin/loan/edu">v</a>'
    df = spark.createDataFrame([("https://b.example/kojin/loan/", html)], "url string, html string")
    got = sorted(r.link for r in links.discover(df, "url", F.col("html"), "/kojin/loan/").collect())
    assert got == ["http://h.example/kojin/loan/edu", "https://b.example/kojin/loan/car/"]


def test_profiles(spark):
    got = lambda url: spark.range(1).select(
        matching.profile_path(matching.url_path(F.lit(url))).alias("p"), matching.rate_slug(F.lit(url)).alias("s"),
        matching.file_name(matching.url_path(F.lit(url))).alias("f")).first()
    r = got("https://b.example/kojin/loan/freeloan/silverloan?x=1")
    assert (r.p, r.s, r.f) == ("/kojin/loan/freeloan/silverloan", "free", "silverloan")
    r = got("https://b.example/kojin/loan/freeloan/support/")
    assert (r.p, r.s) == ("/kojin/loan/freeloan/support/", "reform")
    r = got("https://b.example/x/carlife_s.pdf#p")
    assert (r.p, r.s, r.f) == (None, None, "carlife_s.pdf")


def test_layer_write_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "layer")
    layers.write_layer(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    layers.write_layer(spark.createDataFrame([(3, "b")], "v int, p string"), path, ["p"])
    assert sorted((r.v, r.p) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_extracted_pages_enter_the_raw_layer(spark):
    """Extraction output goes into the layer without its page bodies."""
    pages = catalog.ruled_pages(spark, SF).drop("product_name")
    from yushi.plans import extract

    out = extract.extract_products(pages)
    assert "html_content" not in out.columns
    layer = layers.as_layer(plans.ingest_raw(plans.raw_rows(out)))
    assert layer.count() == out.select("content_hash").distinct().count()
    first = layer.where("content_length > 0").first()
    assert len(first.structured) == 22 and len(first.content_hash) == 64


def test_product_ids(spark):
    known = spark.createDataFrame([(1, "a", "t", 7)], "institution_id long, product_name string, loan_type string, product_id long")
    new = spark.createDataFrame([(1, "a", "t"), (1, "b", "t"), (2, "a", "t")], "institution_id long, product_name string, loan_type string")
    got = {(r.institution_id, r.product_name): r.product_id for r in layers.with_ids(new, known).collect()}
    assert got[1, "a"] == 7 and sorted(got.values()) == [7, 8, 9]


def test_rank_filter_runs_before_the_shuffle(spark):
    plan = catalog.recent_samples(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_hot_group(spark):
    """A third of all pages share one body, institution and product."""
    pages = spark.range(3000).selectExpr(
        "id AS raw_id", "IF(id % 3 = 0, 1, id) AS institution_id", "'u' AS source_url", "'t' AS page_title",
        "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS content_hash", "1 AS content_length",
        "TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(id % 700 AS INT)) AS scraped_at", "struct(id AS v) AS structured")
    hot = layers.as_layer(plans.ingest_raw(pages)).where("content_hash = 'hot'").first()
    assert hot.copies == 1000 and hot.raw_id == 0
    newest = metrics.latest(pages, "institution_id", "scraped_at", "raw_id", ["source_url"]).where("institution_id = 1").first()
    assert newest.raw_id % 700 == max(i % 700 for i in range(3000) if i % 3 == 0 or i == 1)


def test_search_reads_the_stored_layer_with_pushed_filters(spark):
    plan = catalog.search_basic(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "interest_rate_min" in plan.split("PushedFilters: [")[1].split("]")[0] and "loan_type" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "Exchange" not in plan and "HashAggregate" not in plan


def test_text_search_is_a_selection(spark):
    assert 0 < catalog.search_text(spark, SF).count() < catalog.products(spark, SF).count()


def test_newest_row_is_picked_before_the_shuffle(spark):
    plan = catalog.latest_per_institution(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "SortAggregate" not in plan


def test_each_rule_set_reads_its_own_pages(spark):
    plan = catalog.extract_products(spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan parquet")[1:]]
    assert len(scans) == 4 and all("source_rule" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)
