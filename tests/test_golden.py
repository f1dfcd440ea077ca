"""Golden values of the single operators."""

from decimal import Decimal

from pyspark.sql import functions as F

from yushi.functions import amounts, answers, grids, labels, rates, shaping, terms
from yushi.functions import text as T


def test_normalize_cell(run):
    texts = ["１２３", "ａｂｃ", "ＡＢＣ　１２３", " 改行\nタブ\t混在 ", None, "ｶｰﾄﾞﾛｰﾝ", "①年", "㌢", "か゛"]
    assert run(T.normalize_cell, texts) == ["123", "abc", "ABC 123", "改行 タブ 混在", "", "カードローン", "1年", "センチ", "か ゙"]


def test_unify_marks(run):
    assert run(T.normalize_text, ["１２か月～３年 A–B", "ｶ月 3カ月〜"]) == ["12ヶ月〜3年 A-B", "ヶ月 3ヶ月〜"]


def test_rate_cells(run):
    texts = ["２．５％", "年2.1099％", "1,200%", "1.200%", "金利なし", None, "1.2.3%"]
    found = run(lambda c: rates.cell_decimal(T.normalize_cell(c)), texts)
    assert found == [Decimal("2.50"), Decimal("2.10"), Decimal("1200.00"), Decimal("1.20"), None, None, None]
    texts = ["2.5%", "3.125%", "1,500.75%", "無料", "変動金利 2.3%", None]
    found = run(lambda c: rates.cell_decimal_grouped(T.normalize_cell(c)), texts)
    assert found == [Decimal("2.50"), Decimal("3.12"), Decimal("1500.75"), None, Decimal("2.30"), None]


def test_single_amount(run):
    texts = ["融資限度額：500万円", "限度額 1,000万円", "最大 300 万円まで", "１００万円", "500,000円", "融資金額は特になし"]
    found = run(lambda c: amounts.single(T.normalize_cell(c)), texts)
    assert found == [5000000, 10000000, 3000000, 1000000, 500000, None]


def test_longest_term(run):
    texts = ["返済期間：5年", "最長 10 年まで", "１５年以内", "36ヶ月", "24カ月", "期間の定めなし"]
    assert run(lambda c: terms.longest(T.normalize_cell(c)), texts) == [60, 120, 180, 36, 24, None]


def test_simple_rates(run):
    texts = ["年2.20% ～ 年3.25%", "2.30% ～ 3.10%", "年2.50%", "変動金利 年2.675%", "なし", "年3.25%～年2.20%"]
    assert run(rates.simple, texts) == [(2.2, 3.25), (2.3, 3.1), (2.5, 2.5), (2.675, 2.675), None, (2.2, 3.25)]
    assert run(labels.rate_type_simple, texts[2:4]) == ["固定金利", "変動金利"]


def test_simple_amounts(run):
    assert run(amounts.simple, ["10万円～1,000万円", "300万円以内", "最高 800万円", "x"]) == [
        (100000, 10000000), (10000, 3000000), (10000, 8000000), None]


def test_simple_terms(run):
    assert run(terms.simple, ["6ヶ月～10年", "最長 15年", "3年～7年", "3年と月々、7年"]) == [(6, 120), (6, 180), (36, 84), (3, 84)]


def test_category(run):
    texts = ["マイカー", "住宅", "教育", "フリーローン", "カードローン", "その他"]
    assert run(labels.category_by_text, texts) == ["マイカー", "住宅", "教育", "フリー", "カード", "その他"]
    kinds = ["カードローン", "教育カードローン", "教育ローン", "多目的", None]
    assert run(labels.category_standard, kinds) == ["マイカーローン", "マイカーローン", "教育ローン", "フリーローン", "その他"]
    fixed = run(lambda c: labels.category_standard(c, "fixed"), kinds)
    assert fixed == ["カードローン", "カードローン", "教育ローン", "フリーローン", "その他"]


def test_strict_rates(run):
    none = F.array().cast("array<string>")
    default = shaping.type_default(F.lit("mycar"), "rate")
    texts = ["詳細はお問い合わせください", "年2.8%～3.8%", "年2.8%～年3.8%", "変動金利は店頭で1.2%～1.4%", "固定金利 1.2%～1.9%",
             "<b>1.9</b>％〜<b>4.5</b>％"]
    found = run(lambda c: rates.strict(c, c, none, default), texts)
    assert found == [(1.8, 3.8), (1.8, 3.8), (2.8, 3.8), (1.8, 3.8), (1.2, 1.9), (1.9, 4.5)]


def test_context_rates(run):
    texts = ["金利は2.8%です。最大0.5%引下げ",
             "固定2.8%のほかに長い説明がここに入りますので近くありません 3.5% その後も長い説明がここに入りますので 最大0.5%引下げ",
             "年1.2%〜年3.4%", "なし", "1,5%", "5% 6%"]
    assert run(rates.from_context, texts) == [None, (2.8, 3.5), (1.2, 3.4), None, (1.5, 1.5), (5.0, 6.0)]


def test_rate_table_and_sections(run):
    texts = ["年1.2〜3.4％", "年1.2％〜年3.4％", "固定 2.0％", "固定 2.0％ 変動 3.0％", "固定 2.0％ 変動 30.0％"]
    assert run(rates.from_rate_table, texts) == [(1.2, 3.4), (1.2, 3.4), None, (2.0, 3.0), None]
    page = "金利\nWEB完結型\n準備中\n来店型\n年2.0〜3.0％\nWEB完結型\n年1.0〜1.5％"
    for variant, want in (("web", (1.0, 1.5)), ("store", (2.0, 3.0))):
        found = run(lambda c, v=variant: rates.first_typed(F.transform(rates.sections_by_variant(c, v), rates.from_rate_table)), [page])
        assert found == [want]


def test_brochure_rates(run):
    texts = ["固定金利 2.5％ 変動金利 1.5％ 損害金 14.6％", "金利 2.0％ 損害金 18.0％", "1.2%〜2.1%", ""]
    assert run(rates.from_brochure_typed, texts) == [(1.5, 2.5), (2.0, 2.0), (1.2, 2.1), None]
    assert run(rates.from_brochure, texts) == [(1.5, 14.6), (2.0, 18.0), (1.2, 2.1), None]


def test_cell_rates(run):
    texts = ["3.4% ～ 14.8%", "最大0.5%", "年2.5%", "0.5% ～ 25.0%", "2.5%", "5.0%～2.0%"]
    assert run(rates.from_cell, texts) == [(3.4, 14.8), None, (2.5, 2.5), None, None, None]


def test_strict_amounts(run):
    default = shaping.type_default(F.lit("mycar"), "amount")
    texts = ["ご融資金額 10万円～1,000万円", "最高1,000万円", "最高 500,000円", "10万円～300万円", "1万円～3万円", "100,000円～900,000円"]
    assert run(lambda c: amounts.strict(c, default), texts) == [
        (100000, 100000), (100000, 10000000), (100000, 500000), (100000, 3000000), (100000, 10000000), (100000, 900000)]


def test_collected_amounts(run):
    texts = ["融資は500万円まで", "10万円以内、1億円まで", "1.5億円以内と300万円以内", "1万円", "なし"]
    assert run(amounts.collect, texts) == [(None, 5000000), (100000, 100000000), (3000000, 150000000), (None, 10000), None]


def test_cell_and_line_amounts(run):
    texts = ["10万円以上100万円以下(10万円単位)、150万円、200万円", "10万円以上1,000万円以下", "最高500万円", "x"]
    assert run(amounts.from_cell, texts) == [(100000, 2000000), (100000, 10000000), (100000, 5000000), None]
    texts = ["ご融資金額 10万円以上1,000万円以内", "融資額 30万円以上\n限度額 最大200万円", "手数料 1万円以内", "限度額 500円以内"]
    assert run(amounts.from_lines, texts) == [(100000, 10000000), (300000, 2000000), None, None]


def test_strict_terms(run):
    default = shaping.type_default(F.lit("mycar"), "term")
    texts = ["10年6ヵ月以内", "3年の自動更新", "最長 15年", "7年以内", "120ヶ月以内", "6ヶ月～10年", "6ヶ月～60ヶ月", "相談"]
    assert run(lambda c: terms.strict(c, default), texts) == [
        (12, 126), (12, 36), (12, 180), (12, 84), (12, 120), (6, 120), (6, 60), (6, 120)]


def test_collected_terms(run):
    texts = ["返済期間10年以内", "3ヶ月以上", "最長35年 6か月", "2024年10月", "1ヶ月"]
    assert run(lambda c: terms.collect(c, 6), texts) == [(120, 120), (3, 3), (6, 420), None, (1, 1)]
    assert run(lambda c: terms.collect(c, 3), ["3ヶ月〜1年"]) == [(3, 12)]


def test_ages(run):
    texts = ["満20歳以上満65歳未満", "満18歳以上、満70歳以下", "20歳～75歳", "成人"]
    assert run(terms.ages_strict, texts) == [(20, 64), (18, 70), (20, 75), (20, 75)]
    assert run(terms.ages_loose, ["満20歳以上 完済時満75歳以下", "満20歳以上"]) == [(20, 75), (20, None)]
    assert run(terms.ages_from_cell, ["満20歳以上満65歳未満", "満20歳以上", "20歳"]) == [(20, 64), (20, 80), None]


def test_labels(run):
    assert run(labels.repayment_words, ["自動振替と元利均等", "x"]) == ["口座自動振替; 元利均等返済", "口座自動振替"]
    assert run(labels.repayment_phrase, ["毎月元利均等月賦返済です"]) == ["元利均等月賦返済"]
    hints = F.array(F.lit("固定金利"), F.lit("変動金利"))
    assert run(lambda c: labels.rate_type_from_hints(c, hints), ["固定", "変動と固定", "x", None]) == ["固定金利", "変動金利", "固定金利", "固定金利"]
    assert run(labels.rate_type_standard, ["固定", "変動", "選択", "x", None]) == ["固定金利", "変動金利", "金利選択型", None, None]
    words = F.array(F.lit("学費"), F.lit("入学金"), F.lit("留学"))
    assert run(lambda c: labels.features_by_profile(c, words), ["留学と学費", "x"]) == ["学費 / 留学", None]
    assert run(labels.feature_list, ["a / b/ /c"]) == [["a", "b", "c"]]


def test_page_text(run):
    html = ("<html><head><title> 車 &amp; 家 </title><style>p{}</style><script>var a='<p>9%</p>'</script></head>"
            "<body><h1>マイカー<b>ローン</b></h1><!-- 1% --><noscript>no</noscript><p> 年２．５％ </p></body></html>")
    assert run(T.split_text, [html, "<p>open", "plain", ""]) == ["車 & 家\nマイカー\nローン\n年２．５％", "open", "plain", ""]
    assert run(T.page_title, [html, "<p>x</p>"]) == ["車 & 家", None]
    assert run(lambda c: T.element(c, "h1"), [html]) == ["マイカーローン"]


def test_names(run):
    assert run(T.name_from_heading, ["<h1>ご案内</h1><h2>住宅ローン 住まいる</h2>", "<p>x</p>"]) == ["住宅ローン 住まいる", "青い森信用金庫 ローン"]
    assert run(T.name_from_catalogue, ["<h1>青森県信用組合 「新フリーローン」</h1>", "<p/>"]) == ["新フリーローン", "不明な商品"]


def test_encoding(run):
    good = "マイカーローン"
    broken = good.encode().decode("latin-1")
    assert run(T.fix_encoding, [broken, good, "abc", "café", None]) == [good, good, "abc", "café", None]


def test_dates(run):
    assert run(T.as_of_date, ["２０２４年７月１日現在", "x"]) == ["2024-07-01", None]
    assert run(T.checked_date, ["2024-13-01", "2024-12-31", None]) == [None, "2024-12-31", None]


def test_grid(run, spark):
    text = "商品名|変動金利|キャンペーン\nカーライフプラン|年２．５％|2.10%\n||"
    df = spark.createDataFrame([(1, text)], "doc int, t string").withColumn("g", grids.normalize(grids.from_text(F.col("t"))))
    rows = grids.rate_records(df.select("doc", "g"), "g").drop("g").collect()
    assert [(r.product_name, r.rate_floating, r.rate_campaign) for r in rows] == [("カーライフプラン", Decimal("2.50"), Decimal("2.10"))]
    table = "<table><tr><th>借入限度額</th><td>10～500万円</td></tr><tr><td>金利</td><td>年2.5%</td></tr></table>"
    assert run(grids.html_tables, [table]) == [[[["借入限度額", "10～500万円"], ["金利", "年2.5%"]]]]


def test_overview(run):
    html = "<h2>商品概要</h2><p>金利 1.5% ～ 3.5%</p><p>限度額 1,000万円</p><h3>次</h3><p>金利 9.0% ～ 9.9%</p>"
    assert run(rates.overview, [html, "<h2>他</h2>"]) == [("1.5%-3.5%", "1,000万円"), (None, None)]


def test_answer_json(run):
    texts = ["x\n```json\n{\"a\": 1}\n```\ny", " {\"a\": 2} ", "```json {\"a\"", None]
    assert run(answers.answer_json, texts) == ['{"a": 1}', '{"a": 2}', '```json {"a"', None]


def test_summary(run):
    good = (
        '{"loan_summary":{"basic_info":{"product_name":"a","institution_name":"b","loan_type":"c","summary":"d"},'
        '"key_conditions":{"interest_rate":{"type":"固定選択","rate":"1.2-2.8%"},"loan_amount":{"min":100,"max":8000,"unit":"万円"},'
        '"loan_term":{"min":1,"max":35,"unit":"年"}},"metadata":{"source_url":"u","scraped_at":"2024-07-22T10:30:00+09:00",'
        '"processed_at":"2024-07-22T10:35:00+09:00","ai_model":"m"}}}')
    outside = good.replace(',"metadata"', '},"metadata"').replace('"ai_model":"m"}}}', '"ai_model":"m"}}')
    bad = good.replace('"min":100', '"min":9000').replace('"固定選択"', '"選択"')
    found = run(lambda c: F.array_join(answers.summary_messages(c), ";"), [good, outside, bad, "{"])
    assert found == ["", "", "error:value:key_conditions.interest_rate.type;warning:range:key_conditions.loan_amount", "error:json"]


def test_units(run):
    assert run(lambda c: shaping.months_to_years(c.cast("int")), ["6", "12", "35", "0", None]) == [1, 1, 2, None, None]
    assert run(lambda c: shaping.percent_text(c.cast("double")), ["2.5", "10", "100"]) == ["2.5％", "10％", "100％"]
