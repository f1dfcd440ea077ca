"""Loan page corpus derived from the star-schema tables.

The given tables hold no loan pages, so every row of `orders` becomes one
captured page, every row of `part` one brochure table, and so on.  Each table is
a chain of stages; a stage maps column names to expressions written in the SQL
subset that Spark and ANSI engines share, so that a check in another engine can
start from the very same rows.  All derivations are per row: they cost no
shuffle and grow with the source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ raw pages
_LABEL = (
    "CASE kindno WHEN 0 THEN 'マイカーローン' WHEN 1 THEN '住宅ローン' WHEN 2 THEN '教育ローン' "
    "WHEN 3 THEN 'フリーローン' WHEN 4 THEN 'カードローン' ELSE 'おまとめローン' END"
)
_SLUG = (
    "CASE kindno WHEN 0 THEN 'mycarloan' "
    "WHEN 1 THEN CASE WHEN pno % 4 = 1 THEN 'jutakuloan/aoginshinyo' ELSE 'reform' END "
    "WHEN 2 THEN CASE WHEN pno % 4 = 0 THEN 'kyouikuloan_hanpuku' ELSE 'kyouikuloan' END "
    "WHEN 3 THEN CASE WHEN pno % 4 = 1 THEN 'freeloan' ELSE 'freeloan/support' END "
    "WHEN 4 THEN 'cardloan' ELSE 'omatomeloan' END"
)
_RATE_LINE = (
    "CASE form WHEN 0 THEN '金利：年' || lo || '%～年' || hi || '%（変動金利）' "
    "WHEN 1 THEN '固定金利 ' || lo || '%～' || hi || '%' "
    "WHEN 2 THEN '金利は年' || lo || '%です。' || chr(10) || 'お取引内容により店頭表示から最大0.5%引下げ' || chr(10) || "
    "'さらに長期のお借入れは年' || hi || '％、短期は' || lo || '%' "
    "WHEN 3 THEN '<b>' || lo || '</b>％～<b>' || hi || '</b>％（固定金利）' "
    "ELSE '金利は窓口にお問い合わせください' END"
)
_AMOUNT_LINE = (
    "CASE aform WHEN 0 THEN '融資金額：10万円～' || amt || '万円' "
    "WHEN 1 THEN 'ご融資限度額：最高1,' || amt || '万円（' || amt || '万円以内は来店不要）' "
    "WHEN 2 THEN 'ご融資金額 10万円以上' || amt || '万円以内、最大 1億円まで' "
    "ELSE 'お借入は500,000円～9,' || amt || ',000円' END"
)
_TERM_LINE = (
    "CASE tform WHEN 0 THEN '融資期間：6ヶ月～' || yrs || '年' "
    "WHEN 1 THEN '最長' || yrs || '年' "
    "WHEN 2 THEN '返済期間は' || yrs || '年6ヵ月以内' "
    "WHEN 3 THEN '期間 3年から' || yrs || '年まで（繰上返済可）' "
    "ELSE '契約期間3年（自動更新）、最短 36カ月' END"
)
_AGE_LINE = (
    "CASE gform WHEN 0 THEN '満20歳以上満65歳未満の方' "
    "WHEN 1 THEN '満18歳以上、完済時満75歳以下の方' ELSE 'お取引のある方' END"
)
_REPAY_LINE = (
    "CASE gform WHEN 0 THEN '毎月元利均等返済（口座自動振替）' "
    "WHEN 1 THEN '元金均等による月賦返済、随時返済も可' ELSE 'ご返済方法は店頭へ' END"
)
_FEATURE_LINE = (
    "CASE aform WHEN 0 THEN 'WEB完結で来店不要、WEB申込は300万円まで。新車・中古車・借換も' "
    "WHEN 1 THEN '安定した収入のある方。保証人は原則不要です。学費・入学金・授業料に' "
    "WHEN 2 THEN '提携ATMで利用可。保証会社の審査があります。増改築・リフォーム・ボーナス返済' "
    "ELSE '継続的な収入のある方。お使いみちは自由。最長・限度額は店頭で。繰上返済手数料無料' END"
)

RAW_PAGES = ("orders", [
    {
        "raw_id": "o_orderkey",
        "institution_id": "CAST(o_custkey % 25 AS BIGINT)",
        "scraped_at": "o_orderdate",
        "state": "o_orderstatus",
        "priority": "o_orderpriority",
        "pno": "o_orderkey % 40",
        "kindno": "(o_orderkey % 40) % 6",
        "form": "o_orderkey % 5",
        "aform": "o_orderkey % 4",
        "tform": "o_orderkey % 5",
        "gform": "o_orderkey % 3",
        "blank": "CASE WHEN o_orderkey % 50 = 49 THEN 1 ELSE 0 END",
        "lo": "CAST(1 + o_orderkey % 7 AS STRING) || '.' || CAST(o_custkey % 5 AS STRING) || '5'",
        "hi": "CAST(9 + o_orderkey % 7 AS STRING) || '.50'",
        "amt": "CAST(100 * (1 + o_custkey % 5) AS STRING)",
        "yrs": "CAST(1 + o_orderkey % 35 AS STRING)",
    },
    {
        "kind": _LABEL,
        "slug": _SLUG,
        "rate_line": _RATE_LINE,
        "amount_line": _AMOUNT_LINE,
        "term_line": _TERM_LINE,
        "age_line": _AGE_LINE,
        "repay_line": _REPAY_LINE,
        "feature_line": _FEATURE_LINE,
        "variant": "CASE aform WHEN 0 THEN 'web' WHEN 1 THEN 'store' ELSE NULL END",
        "product_name": f"'プラン' || CAST(pno AS STRING) || ({_LABEL})",
    },
    {
        "source_url": "'https://bank' || CAST(institution_id AS STRING) || '.example.com/kojin/loan/' || slug || "
                      "CASE WHEN pno % 3 = 2 THEN '' ELSE '/' END",
        "table_html":
            "'<table class=\"rates\"><tr><th>ご利用金利</th><td>年' || lo || '%</td></tr>"
            "<tr><th>優遇後</th><td>最大0.9%引下げ</td></tr>"
            "<tr><th>店頭金利</th><td>' || lo || '% ～ ' || hi || '%</td></tr>"
            "<tr><th>借入限度額</th><td>10～' || amt || '万円</td></tr>"
            "<tr><th>借入金額</th><td>10万円以上' || amt || '万円以下(10万円単位)、1,' || amt || '万円</td></tr>"
            "<tr><th>借入時年令</th><td>' || age_line || '</td></tr>"
            "<tr><th>資金使途</th><td>' || kind || '資金</td></tr>"
            "<tr><th>返済期間</th><td>' || yrs || '年以内</td></tr></table>'",
    },
    {
        "html_content":
            "CASE WHEN blank = 1 THEN '' ELSE "
            "'<!DOCTYPE html><html lang=\"ja\"><head><meta charset=\"utf-8\"><title> ' || product_name || '&amp;ご案内 </title>"
            "<style>p{margin:0}</style><script>var r=\"9.99%\";if(a<b){x()}</script></head><body>' || "
            "'<h1>' || product_name || '</h1><!-- 1.11% --><p>' || rate_line || '</p><p>' || amount_line || '</p><p>' || "
            "term_line || '</p><ul><li>' || age_line || '</li><li>' || repay_line || '</li><li>' || feature_line || '</li></ul>' || "
            "CASE WHEN gform = 0 THEN table_html ELSE '' END || "
            "'<h2>商品概要</h2><p>適用金利 ' || lo || '% ～ ' || hi || '%</p><p>限度額 ' || amt || '万円&nbsp;以内</p><p>優遇後 年' || lo || '&#37;&#65374;年' || hi || '&#x25;&#x3000;&amp;lt;&times;</p>' || "
            "'<h3>お問い合わせ</h3><p>TEL 017-123-' || CAST(1000 + pno AS STRING) || '</p>"
            "<noscript>JavaScript 8.88%</noscript><a href=\"/kojin/loan/' || slug || '/\">' || kind || '</a></body></html>' END",
    },
    {
        "brochure_text":
            "CASE WHEN form = 4 THEN NULL ELSE "
            "'商品説明書 ' || product_name || chr(10) || '２０２' || CAST(pno % 5 AS STRING) || '年' || CAST(1 + pno % 12 AS STRING) || "
            "'月' || CAST(1 + pno % 28 AS STRING) || '日現在' || chr(10) || "
            "CASE form WHEN 0 THEN '固定金利 ' || lo || '％ 変動金利 ' || hi || '％' "
            "WHEN 1 THEN '実質年率 ' || lo || '％～' || hi || '％ 遅延損害金 14.6％' "
            "WHEN 2 THEN '金利 ' || lo || '％、遅延損害金 18.0％' ELSE '金利は店頭に表示' END || chr(10) || "
            "CASE aform WHEN 0 THEN 'ご融資金額 10万円以上' || amt || '万円以内' || chr(10) || '限度額 1,' || amt || '万円' "
            "WHEN 1 THEN 'ご融資限度額 最大' || amt || '万円' WHEN 2 THEN '融資額 30万円以上' || chr(10) || '融資額 1億円まで' "
            "ELSE 'お申込みは店頭で' END || chr(10) || "
            "CASE tform WHEN 0 THEN '返済期間 ' || yrs || '年以内' WHEN 1 THEN '期間 3ヶ月以上' || yrs || '年以内' "
            "WHEN 2 THEN '期間の定めなし' ELSE '最長 ' || yrs || '年' END || chr(10) || age_line END",
        "rate_page_text":
            "'金利一覧' || chr(10) || CASE form WHEN 0 THEN '年' || lo || '〜' || hi || '％' "
            "WHEN 1 THEN '年' || lo || '％〜年' || hi || '％' "
            "WHEN 2 THEN '固定 ' || lo || '％ ご契約内容により期間ごとに異なります 変動 ' || hi || '％ 優遇 最大0.3％引下げ' "
            "ELSE '店頭表示' END || chr(10) || "
            "'WEB完結型' || chr(10) || CASE WHEN form = 3 THEN '準備中' ELSE '年' || lo || '～' || hi || '％' END || chr(13) || chr(10) || "
            "'来店型' || chr(10) || '年' || hi || '％―年19.50％' || chr(10) || 'WEB完結型のご注意' || chr(10) || '年2.00～3.00％'",
        "wide_text":
            "translate(rate_line || '　' || amount_line || chr(10) || term_line, '0123456789%,', '０１２３４５６７８９％，')",
        "broken_text": "product_name || ' ' || kind",
    },
])

# ------------------------------------------------- processed rows and answers
_ANSWER = (
    "'{\"product_analysis\":{\"executive_summary\":\"' || product_name || 'の要約\",\"competitive_advantages\":[\"' || kind || '\",\"低金利\"]},"
    "\"customer_guide\":{' || CASE WHEN gform = 2 THEN '' ELSE '\"simple_explanation\":\"' || kind || 'の説明' || amt || '\",' END || "
    "'\"key_benefits\":[\"' || yrs || '年\"],\"application_difficulty\":\"普通\"},"
    "\"market_positioning\":{\"target_market_segment\":\"スタンダード\"},\"risk_assessment\":{\"flexibility_score\":\"' || CAST(1 + pno % 10 AS STRING) || '\",\"borrower_risks\":[\"' || hi || '%\"]},"
    "\"data_confidence\":{\"analysis_reliability\":\"' || CAST(pno % 10 AS STRING) || '\"}}'"
)
_SUMMARY = (
    "'{\"loan_summary\":{\"basic_info\":{\"product_name\":\"' || product_name || '\",\"institution_name\":\"' || "
    "CAST(institution_id AS STRING) || '\",\"loan_type\":\"' || kind || '\"' || "
    "CASE WHEN gform = 2 THEN '' ELSE ',\"summary\":\"概要\"' END || '},\"key_conditions\":{\"interest_rate\":{\"type\":\"' || "
    "CASE form WHEN 0 THEN '変動' WHEN 1 THEN '固定' ELSE '固定選択型' END || '\",\"rate\":\"' || lo || '%\"},\"loan_amount\":{\"min\":' || "
    "CASE WHEN form = 2 THEN '\"10\"' WHEN form = 3 THEN '900' ELSE '10' END || ',\"max\":' || amt || ',\"unit\":\"万円\"},"
    "\"loan_term\":{\"min\":3,\"max\":' || yrs || ',\"unit\":\"年\"}},\"metadata\":{\"source_url\":\"' || source_url || "
    "'\",\"scraped_at\":\"' || CASE WHEN aform = 1 THEN '昨日' ELSE '2024-07-22T10:30:00+09:00' END || "
    "'\",\"processed_at\":\"2024-07-22T10:35:00+09:00\",\"ai_model\":\"m1\"}}}'"
)
PROCESSED = (RAW_PAGES, [
    {
        "processed_id": "2 * raw_id + 1",
        "processing_status": "CASE state WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END",
        "processed_at": "scraped_at",
        "answer_json": _ANSWER,
        "summary_json": _SUMMARY,
    },
    {
        "response_text":
            "CASE gform WHEN 0 THEN '結果です。' || chr(10) || '```json' || chr(10) || answer_json || chr(10) || '```' || chr(10) || '以上' "
            "WHEN 1 THEN CASE WHEN form = 1 THEN '{\"broken\": ' ELSE chr(10) || answer_json END "
            "ELSE CASE WHEN form = 2 THEN '```json' || chr(10) || answer_json ELSE answer_json END END",
    },
])
# a page of low priority has not been processed yet
PROCESSED_WHERE = "priority <> '5-LOW'"
# completed rows of the most urgent pages were integrated by an earlier run
INTEGRATED_WHERE = "processing_status = 'completed' AND priority = '1-URGENT'"

# institutions that offer no loans any more; their products stay stored, marked as not active
WITHDRAWN = "institution_id % 2 = 1"

# ------------------------------------------------------------ brochure tables
GRIDS = ("part", [
    {
        "doc_id": "CAST(floor(p_partkey / 8) AS BIGINT)",
        "table_no": "p_partkey % 8",
        "page_index": "p_partkey % 3",
        "institution_id": "CAST(p_size % 5 AS BIGINT)",
        "r1": "CAST(1 + p_size % 9 AS STRING) || '.' || CAST(10 + p_partkey % 90 AS STRING) || '9'",
        "r2": "CAST(2 + p_size % 13 AS STRING) || '.' || CAST(p_size % 10 AS STRING)",
        "nm": "CASE p_size % 6 WHEN 0 THEN 'カーライフプラン' WHEN 1 THEN '新教育ローン' WHEN 2 THEN 'フリーローン' "
              "WHEN 3 THEN 'カードローン' WHEN 4 THEN '定期預金' ELSE '教育カードローン' END",
    },
    {
        "grid_text":
            "CASE p_size % 4 "
            "WHEN 0 THEN '商品名|変動金利|保証料込み' || chr(10) || p_name || '|年' || r1 || '％|' || r2 || '%' || chr(10) || nm || '|無料|' || r1 "
            "WHEN 1 THEN 'プラン|店頭金利|キャンペーン' || chr(10) || nm || '|' || r2 || '５％|年' || r1 || '%' || chr(10) || '||' || chr(10) || p_brand || '|1,200%' "
            "WHEN 2 THEN '年利|取扱商品' || chr(10) || '最大0.5%引下げ|' || nm || chr(10) || r1 || '%|' || nm || chr(10) || r1 || '%|' || nm "
            "ELSE 'ご案内' END",
        "web_grid_text":
            "'商品名|融資金額|融資期間' || chr(10) || 'とうしん' || nm || '|10万円以上' || CAST(100 * (1 + p_size % 9) AS STRING) || "
            "'万円以内|最長' || CAST(1 + p_size % 20 AS STRING) || '年以内' || chr(10) || nm || '|' || CAST(50 + p_size AS STRING) || "
            "'0万円以内|36ヶ月以内・' || CAST(1 + p_size % 12 AS STRING) || '年' || chr(10) || 'あ|1万円以内|1年' || chr(10) || "
            "'定期預金のご案内|1万円以内|1年'",
        "poster_text":
            "'＜' || p_name || '＞' || chr(10) || nm || 'キャンペーン' || chr(10) || '年' || r2 || '%から' || r1 || '%' || chr(10) || "
            "'損害金 21.5% ２０２４年' || CAST(1 + p_size % 14 AS STRING) || '月' || CAST(1 + p_size % 31 AS STRING) || '日'",
    },
])

# -------------------------------------------------------- favourites, run log
FAVOURITES = ("events", [
    {"product_id": "event_id % 1000 + 1", "added_at": "ts"},
])
FAVOURITES_WHERE = "event_type = 'purchase'"
RUN_LOG = ("events", [
    {
        "run_id": "CAST(CAST(ts AS DATE) AS STRING)",
        "source_no": "user_id % 4",
        "ok": "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END",
    },
])

INSTITUTION_NAME = (
    "n_name || CASE n_nationkey % 3 WHEN 0 THEN '銀行' WHEN 1 THEN '信用金庫' ELSE '信用組合' END"
)
INSTITUTIONS = ("nation", [
    {
        "institution_id": "CAST(n_nationkey AS BIGINT)",
        "institution_code": "lpad(CAST(n_nationkey AS STRING), 4, '0')",
        "institution_name": INSTITUTION_NAME,
        "institution_name_kana": "'キカン' || CAST(n_nationkey AS STRING)",
    },
])


KEYS = {"orders": "o_orderkey", "part": "p_partkey"}
SPREAD = "spark.yushi.source.tasks"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Source rows spread over so many tasks as the session asks for, else as it has shuffle partitions.

    One short row becomes a whole page, and a file of few row groups is read by as few tasks."""
    df = table(spark, sf_dir, name)
    tasks = spark.conf.get(SPREAD, None) or spark.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(tasks), KEYS[name]) if name in KEYS else df


def apply_stages(df: DataFrame, stages) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in stage.items()])
    return df


def derive(spark: SparkSession, sf_dir: str, spec) -> DataFrame:
    """Run the stages of `spec` over its source table, in Spark."""
    source, stages = spec
    return apply_stages(_source(spark, sf_dir, source) if isinstance(source, str) else derive(spark, sf_dir, source), stages)


def derive_sql(spec) -> str:
    """The same stages as one nested SELECT for a checking engine."""
    source, stages = spec
    sql = source if isinstance(source, str) else f"({derive_sql(source)})"
    for stage in stages:
        cols = ", ".join(f"{expr} AS {name}" for name, expr in stage.items())
        sql = f"(SELECT *, {cols} FROM {sql})"
    return sql[1:-1]


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RAW_PAGES)


def as_stored(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns as if read from a stored table.

    Filters on extracted fields would otherwise be pushed into the derivation
    and repeat its text building; a generator stops them, as a scan would."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def processed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, PROCESSED).where(PROCESSED_WHERE)


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, GRIDS)


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["institution_id", "institution_code", "institution_name", "institution_name_kana"]
    return derive(spark, sf_dir, INSTITUTIONS).select(*cols)


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FAVOURITES).where(FAVOURITES_WHERE).select("user_id", "product_id", "added_at")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, RUN_LOG)
