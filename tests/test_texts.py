"""Equal texts are looked at once, and every row gets what its text gives."""

from pyspark.sql import functions as F

from yushi.operators import texts
from yushi.plans import catalog
from yushi.sources import corpus

from conftest import SF


def test_equal_texts_are_read_once_and_no_row_is_lost(spark):
    rows = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(
        [("a", "x"), ("a", "x"), ("a", None), ("a", None), ("", "x"), (None, "x"), (None, "x"), ("b", "x")])], "i int, t string, k string")
    out = texts.per_text(rows, "t", lambda df: df.withColumns({"n": F.length("t"), "run": F.uuid()}), ["k"]).orderBy("i").collect()
    assert [(r.i, r.k, r.n) for r in out] == [(0, "x", 1), (1, "x", 1), (2, None, 1), (3, None, 1), (4, "x", 0), (5, "x", None), (6, "x", None), (7, "x", 1)]
    runs = [r.run for r in out]
    assert runs[0] == runs[1] and runs[2] == runs[3] and runs[5] == runs[6] and len(set(runs)) == 5


def test_patterns_run_behind_the_distinct_pages(spark):
    plan = catalog.strict_fields(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_digest" in plan


def test_source_rows_are_spread_without_a_setting(spark):
    tasks = spark.conf.get(corpus.SPREAD)
    spark.conf.unset(corpus.SPREAD)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        assert corpus.raw_pages(spark, SF).rdd.getNumPartitions() == 5
    finally:
        spark.conf.set(corpus.SPREAD, tasks)
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_rule_set_sees_each_different_page_once(spark):
    from yushi.plans import extract

    seen = []

    def rule(pages):
        seen.append(pages.count())
        return pages.select("raw_id", "institution_id", "scraped_at", F.length("html_content").alias("n"))

    rows = [(i, i % 3, i, "u", "r", h, None, None, None, v) for i, (h, v) in enumerate([("a", None), ("a", None), ("a", "web"), ("", None), (None, None)])]
    pages = spark.createDataFrame(rows, "raw_id long, institution_id long, scraped_at long, source_url string, source_rule string, html_content string, "
                                        "brochure_text string, brochure_file string, rate_page_text string, variant string")
    out = extract.once_per_page(rule)(pages).orderBy("raw_id").collect()
    assert seen == [4] and [tuple(r) for r in out] == [(0, 0, 0, 1), (1, 1, 1, 1), (2, 2, 2, 1), (3, 0, 3, 0), (4, 1, 4, None)]


def _below(plan: str, node: str) -> str:
    """What a plan's text shows from the first such node on."""
    return plan[plan.index(node):]


def test_a_filter_on_what_patterns_find_stays_behind_the_distinct_pages(spark):
    rows = corpus.raw_pages(spark, SF).select("raw_id", "html_content")
    found = texts.per_text(rows, "html_content", lambda df: df.withColumn("name", F.regexp_extract("html_content", "<h1>(.+?)</h1>", 1)))
    plan = found.where("name <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "regexp_extract" not in _below(plan, "Aggregate [_digest")


def test_products_of_pages_leave_no_pattern_to_the_scan(spark):
    from yushi.plans import layers

    rows = layers.split_rejects(catalog.all_product_rows(spark, SF))[0]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" in plan and "regexp_extract" not in _below(plan, "Aggregate [_digest")


def test_grids_are_normalised_once_by_all_tasks(spark):
    plan = catalog._web_products(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")


def test_a_reference_is_decoded_without_repeating_its_parts(spark, run):
    from html import unescape

    from yushi.functions import text as T

    numbers = [0, 1, 8, 9, 10, 11, 31, 32, 37, 65, 127, 128, 129, 150, 159, 160, 165, 55296, 57343, 64976, 65374, 65534, 65535, 65536, 128512, 1114111, 1114112, 99999999, 100000000]
    found = [*(f"a&#{n}{end}b" for n in numbers for end in (";", "")), *(f"&#{x}{n:0{w}x}{end}z" for n in numbers for x in "xX" for w in (1, 12) for end in (";", ""))]
    found += ["&amp;lt;", "&ampx", "&AMP;&Amp;", "&#;&#x;&#xg;", "&unknown;", "&notit;", "&times;&times", "&#0037;&#X0025;", "", "a & b", "&#12354", "&#" + "9" * 400 + ";", "&#x" + "0" * 50 + "41;"]
    assert run(T.unescape, found) == [unescape(t) for t in found]
    plan = spark.createDataFrame([("a",)], "t string").select(T.unescape(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_latin_letters_and_signs_need_no_python(spark):
    from unicodedata import normalize

    from yushi.functions import text as T

    plain = "".join(map(chr, range(0xBF, 0x100)))
    rows = spark.createDataFrame([(plain,), ("3\u00d75～Ａé",), ("½",), ("e\u0301",), ("ﾛｰﾝ",)], "t string")
    got = rows.select("t", F.col("t").rlike(T._PLAIN).alias("plain"), T.nfkc(F.col("t")).alias("n")).collect()
    assert [r.plain for r in got] == [True, True, False, False, False] and all(r.n == normalize("NFKC", r.t) for r in got)
