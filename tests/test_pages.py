"""Whole pages through the rule sets."""

from pyspark.sql import functions as F

from yushi.functions import shaping
from yushi.functions import text as T
from yushi.plans import extract

CAR = ("<html><head><title>カーライフプラン プライム</title></head><body><h1>カーライフプラン プライム</h1>"
       "<p>年2.20%～年3.25%</p><p>10万円～1,000万円</p><p>6ヶ月～15年</p></body></html>")
HOUSE = "<html><head><title>住宅ローン</title></head><body><h2>住宅ローン 住まいる</h2></body></html>"
SCHEMA = ("raw_id long, institution_id long, source_url string, scraped_at timestamp, source_rule string, html_content string, "
          "brochure_text string, brochure_file string, rate_page_text string, variant string")


def pages(spark, *rows):
    return spark.createDataFrame([(i, 1, u, None, r, h, b, f, t, v) for i, (u, r, h, b, f, t, v) in enumerate(rows)], SCHEMA)


def test_simple_rule(spark):
    df = pages(spark, ("u", "simple", CAR, None, None, None, None), ("u", "simple", HOUSE, None, None, None, None),
               ("u", "simple", "<p>open", None, None, None, None))
    car, house, other = extract.simple_products(df).orderBy("raw_id").collect()
    assert (car.min_interest_rate, car.max_interest_rate, car.min_loan_amount, car.max_loan_amount) == (2.2, 3.25, 100000, 10000000)
    assert (car.min_loan_term_months, car.max_loan_term_months, car.category) == (6, 180, "マイカー")
    assert (house.min_loan_amount, house.max_loan_amount) == (500000, 100000000)
    assert (house.min_loan_term_months, house.max_loan_term_months) == (12, 420)
    assert other.min_loan_amount is None and other.category == "その他"


def test_bank_rule(spark):
    url = "https://bank.example/kojin/loan/mycarloan/"
    html = "<h1>車</h1><p>金利は店頭へ</p><p>500万円以内</p><p>車両と船舶に</p>"
    sheet = "満18歳以上 75歳以下\n返済期間 10年以内\n車両 船舶 変動金利 2.0％～3.0％"
    table = "WEB完結型\n年1.5〜2.5％\n来店型\n年3.0〜4.0％"
    df = pages(spark, (url, "bank", html, sheet, None, table, None), (url, "bank", html, sheet, None, table, "web"),
               (url, "bank", html, None, None, table, None), ("https://x.example/other", "bank", html, None, None, table, None))
    plain, web, bare, other = extract.bank_products(df).orderBy("raw_id").collect()
    assert (plain.min_interest_rate, plain.max_interest_rate, plain.min_age, plain.max_age) == (2.0, 3.0, 18, 75)
    assert (plain.min_loan_term_months, plain.max_loan_term_months) == (120, 120)
    assert (plain.min_loan_amount, plain.max_loan_amount) == (100000, 5000000)
    assert plain.special_features == "船舶 / 車両" and plain.interest_type == "変動金利"
    assert web.product_name == "青森みちのくマイカーローン〈WEB完結型〉"
    assert (web.min_interest_rate, web.max_interest_rate) == (1.5, 2.5)
    assert web.special_features == "船舶 / 車両 / WEB完結型"
    assert (bare.min_interest_rate, bare.max_interest_rate) == (1.5, 2.5)
    assert other.product_name == "車" and other.loan_type is None and other.min_interest_rate is None
    assert (other.min_age, other.max_age) == (20, 75)


def test_rules_unite(spark):
    df = pages(spark, ("u", "simple", CAR, None, None, None, None),
               ("https://x.example/detail/1.html", "catalogue", "<h1>新フリーローン</h1><table><tr><td>適用金利</td><td>3.4% ～ 14.8%</td></tr></table>",
                None, None, None, None),
               ("u", "brochure", "", "教育ローン\nご融資金額 10万円以上500万円以内\n変動金利 3.0％", "kyoiku_s.pdf", None, None))
    rows = {r.source_rule: r for r in extract.extract_products(df).collect()}
    assert rows["catalogue"].product_name == "新フリーローン" and rows["catalogue"].max_interest_rate == 14.8
    assert rows["catalogue"].category == "フリー" and rows["catalogue"].max_loan_amount == 10000000
    assert rows["brochure"].product_name == "教育ローン" and rows["brochure"].loan_type == "education"
    assert rows["brochure"].max_loan_amount == 5000000 and rows["brochure"].min_interest_rate == 3.0


def test_swap_and_sanity(spark):
    schema = ("min_interest_rate double, max_interest_rate double, min_loan_amount long, max_loan_amount long, "
              "min_loan_term_months int, max_loan_term_months int, min_age int, max_age int, t string")
    df = spark.createDataFrame([(5.0, 2.0, 900, 100, 60, 12, None, None, "フリーローン"), (0.1, 2.0, None, 5000000, 1, 2, 30, None, "x")], schema)
    a, b = shaping.swap_inverted(df).collect()
    assert (a.min_interest_rate, a.max_interest_rate, a.min_loan_amount, a.max_loan_amount) == (2.0, 5.0, 100, 900)
    assert (a.min_loan_term_months, a.max_loan_term_months) == (12, 60)
    a, b = shaping.sanity(df, F.col("t")).collect()
    assert a.min_interest_rate is None and (a.min_age, a.max_age) == (20, 80) and a.min_loan_amount == 100
    assert b.max_interest_rate is None and b.min_loan_amount == 100000 and (b.min_age, b.max_age) == (30, 75)


def test_references_are_those_of_html(run):
    """All names, decimal and hexadecimal references, each decoded once."""
    import html

    texts = ["a&amp;lt;b", "&copy;&middot;&#65374;&#x3000;&#37;x", "&#128;&#0;&#xD800;&bogus;&copy", "& & &;", "&NotEqualTilde; &AMP; &#x1F600;", "", None,
             *[f"&{n}" for n in list(html.entities.html5)[::37]]]
    assert run(T.unescape, texts) == [None if t is None else html.unescape(t) for t in texts]


def test_references_of_any_length(run):
    """Random strings of references, whole, cut short, glued to other words, with any number of digits."""
    import html
    import random

    assert run(T.unescape, ["&#0000000065;", "&#x000000041;b", "&copy2024", "&notit;", "&#99999999999;"]) == ["A", "Ab", "©2024", "¬it;", "\ufffd"]
    rng = random.Random(11)
    names = list(html.entities.html5)
    parts = ["&", ";", "#", "x", "0", "65", " ", "copy", "amp", "é", "<b", "=", "&#", "&#x", "&#X"]

    def piece():
        kind = rng.random()
        if kind < 0.3:
            return rng.choice(parts)
        if kind < 0.6:
            return "&" + rng.choice(names) + rng.choice(["", ";", "2024", "x", " "])
        code = rng.choice([rng.randint(0, 300), rng.randint(0, 0x120000), rng.choice([0xFDD0, 0xFFFE, 0x1FFFF, 0xD800, 10**12])])
        return rng.choice([f"&#{code:0{rng.randint(1, 14)}d}", f"&#x{code:0{rng.randint(1, 14)}x}", f"&#X{code:X}"]) + rng.choice(["", ";", "g"])

    texts = ["".join(piece() for _ in range(rng.randint(1, 8))) for _ in range(600)]
    assert run(T.unescape, texts) == [html.unescape(t) for t in texts]


def test_no_reference_is_left_on_the_pages(spark):
    import re

    from conftest import SF
    from yushi.plans import catalog

    named = re.compile("&(?:copy|middot|amp|nbsp|quot|lt|gt);")
    assert not any(named.search(r.raw.replace("&amp;", "")) for r in catalog.page_text(spark, SF).collect())


def test_rate_behind_references(run):
    from yushi.functions import rates

    got = run(lambda t: rates.simple(T.fold(T.raw_text(t))), ["<p>年1.25&#37;&#65374;年3.50&#37;</p>"])
    assert got[0] is not None


def test_overview_reads_nested_elements(run):
    from yushi.functions import rates

    html = "<h2>商品概要</h2><p>金利 <b>1.5%</b> ～ <b>3.0%</b></p><ul><li>限度額 <em>500万円</em></li></ul><h2>x</h2>"
    assert run(rates.overview, [html])[0] == ("1.5%-3.0%", "500万円")


def test_references_need_their_semicolon_where_a_cut_text_says_so(run):
    texts = ["and&amp", "a&ampTo", "&amp;amp", "&lt;&copy2024", "&#65;&#66", "&notit;"]
    assert run(lambda t: T.unescape(t, bare=False), texts) == ["and&amp", "a&ampTo", "&amp", "<&copy2024", "A&#66", "&notit;"]
    assert run(lambda t: T.split_text(t, bare=False), ["<p>and&amp</p><p>To&amp;</p>"]) == ["and&amp\nTo&"]
