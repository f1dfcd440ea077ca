"""Fixed values.

Patterns, word lists, default tables and label texts that decide results.  They
must stay exactly as they are for results to agree with existing data, so they
are kept together here as plain text.  Patterns use the syntax common to Java
regular expressions and RE2 (no look-around) and expect text whose digits and
blanks were folded to ASCII (`functions.text.fold`).
"""

# --------------------------------------------------------------- institutions
# id, code, name, kana, other codes seen for the same institution
INSTITUTIONS = [
    (1, "0001", "青森銀行", "アオモリギンコウ", []),
    (2, "0002", "みちのく銀行", "ミチノクギンコウ", []),
    (3, "0003", "青い森信用金庫", "アオイモリシンヨウキンコ", ["1250"]),
    (4, "0004", "東奥信用金庫", "トウオウシンヨウキンコ", ["1251"]),
    (5, "0005", "青森県信用組合", "アオモリケンシンヨウクミアイ", ["2020", "2260"]),
    (6, "0117", "青森みちのく銀行", "アオモリミチノクギンコウ", []),
]

# ------------------------------------------------------------ source profiles
BOTH_TYPES = ["固定金利", "変動金利"]
AGE_TERM = ["min_age", "max_age", "min_loan_term", "max_loan_term"]
TERM_REPAY = ["min_loan_term", "max_loan_term", "repayment_method"]
AGE_TERM_REPAY = ["min_age", "max_age", "min_loan_term", "max_loan_term", "repayment_method"]
TERM_AMOUNT_RATE = [
    "min_loan_term", "max_loan_term", "min_loan_amount",
    "max_loan_amount", "min_interest_rate", "max_interest_rate",
]
HOUSING_WORDS = ["借換", "リフォーム", "新築", "中古", "増改築", "最長"]

# path prefix, product name, loan type, category, rate type hints, key words,
# fields taken from the brochure first, brochure file
PATH_PROFILES = [
    ("/kojin/loan/mycarloan/", "青森みちのくマイカーローン", "マイカーローン", "自動車", BOTH_TYPES,
     ["車両", "中古車", "新車", "船舶", "借換"], AGE_TERM, "l-75.pdf"),
    ("/kojin/loan/kyouikuloan_hanpuku/", "青森みちのく教育ローン反復利用型", "教育ローン", "教育", BOTH_TYPES,
     ["在学中据置", "学費", "入学金", "留学", "最長", "限度額", "何度でも"], TERM_REPAY, "l-77.pdf"),
    ("/kojin/loan/certificate/", "青森みちのく教育ローン証書貸付型", "教育ローン", "教育", BOTH_TYPES,
     ["在学中据置", "学費", "入学金", "留学", "最長"], TERM_REPAY, "l-78.pdf"),
    ("/kojin/loan/kyouikuloan/", "青森みちのく教育カードローン", "教育ローン", "教育", BOTH_TYPES,
     ["学費", "入学金", "授業料", "ローンカード"], TERM_REPAY, "l-79.pdf"),
    ("/kojin/loan/freeloan/", "青森みちのくフリーローン", "フリーローン", "多目的", BOTH_TYPES,
     ["お使いみちは自由", "最長"], AGE_TERM, "l-81.pdf"),
    ("/kojin/loan/omatomeloan/", "青森みちのくおまとめローン", "おまとめローン", "多目的", BOTH_TYPES,
     ["借換", "おまとめ", "低金利"], AGE_TERM, "l-83.pdf"),
    ("/kojin/loan/freeloan/silverloan", "青森みちのくシルバーローン", "フリーローン", "多目的", BOTH_TYPES,
     ["60歳以上", "年金受給者", "最長"], AGE_TERM_REPAY, "l-85.pdf"),
    ("/kojin/loan/freeloan/support/", "青森みちのく住宅サポートローン", "住宅ローン", "住宅", BOTH_TYPES,
     ["お使いみちは自由", "最長"], AGE_TERM_REPAY, "l-86.pdf"),
    ("/kojin/loan/jutakuloan/aoginshinyo/", "青森みちのく住宅ローン （あおぎん信用保証型）", "住宅ローン", "住宅",
     BOTH_TYPES, HOUSING_WORDS, AGE_TERM_REPAY, "l-94.pdf"),
    ("/kojin/loan/jutakuloan/zenkokuhosho/", "青森みちのく住宅ローン （全国保証型）", "住宅ローン", "住宅",
     ["固定金利"], HOUSING_WORDS, AGE_TERM_REPAY, "l-95.pdf"),
    ("/kojin/loan/reform/", "青森みちのくリフォームローン", "住宅ローン", "住宅", BOTH_TYPES,
     ["リフォーム", "増改築"], AGE_TERM_REPAY, "l-87.pdf"),
    ("/kojin/loan/akiyarikatsuyouloan/", "青森みちのく空き家利活用ローン", "住宅ローン", "住宅", BOTH_TYPES,
     HOUSING_WORDS, AGE_TERM_REPAY, "l-88.pdf"),
]

# exact path (with a closing slash), loan type, category
EXACT_PATH_PROFILES = [
    ("/loan/car/", "car", "auto"),
    ("/loan/housing/", "home", "housing"),
    ("/loan/education/", "education", "education"),
    ("/loan/freeloan/", "freeloan", "multi-purpose"),
    ("/loan/card/", "card", "card"),
]

# file name, product name, loan type, category, hints, key words, brochure-first fields
FILE_PROFILES = [
    ("carlife_s.pdf", "カーライフローン", "car", "auto", BOTH_TYPES,
     ["新車", "中古車", "借換", "ロードサービス", "優遇"], TERM_AMOUNT_RATE),
    ("mycarplus_s.pdf", "マイカープラス", "car", "auto", BOTH_TYPES,
     ["新車", "中古車", "借換"], TERM_AMOUNT_RATE),
    ("kyoiku_s.pdf", "教育ローン", "education", "education", BOTH_TYPES,
     ["学費", "入学金", "授業料", "留学", "在学中", "据置"], TERM_AMOUNT_RATE),
    ("newkyoiku_s.pdf", "新教育ローン", "education", "education", BOTH_TYPES,
     ["無担保", "学費", "入学金", "授業料", "最長"], TERM_AMOUNT_RATE),
    ("kyoikucl_s.pdf", "教育カードローン", "education", "education", BOTH_TYPES,
     ["極度額", "カード", "学費", "随時借入"], ["min_loan_amount", "max_loan_amount", "min_interest_rate", "max_interest_rate"]),
    ("free_s.pdf", "フリーローン", "freeloan", "multi-purpose", ["固定金利"],
     ["使途自由", "おまとめ", "借換"], TERM_AMOUNT_RATE),
]

# catalogue product: id, name, category, category code
CATALOGUE_PRODUCTS = [
    ("2030107", "新フリーローン", "フリー", "05"),
    ("2030027", "けんしんようミドルカードローン", "カード", "04"),
    ("2030120", "多目的ローン", "多目的", "03"),
]

# text in the URL -> rate table page; first hit wins
RATE_SLUG_BY_KEYWORD = [
    ("mycarloan", "mycar"),
    ("freeloan/silverloan", "free"),
    ("freeloan/support", "reform"),
    ("freeloan", "free"),
    ("omatomeloan", "free"),
    ("cardloan", "card"),
    ("kyouikuloan_hanpuku", "tuition"),
    ("certificate", "tuition"),
    ("kyouikuloan/", "tuition"),
    ("akiyarikatsuyouloan", "akiyarikatsuyou"),
    ("jutakuloan", "housing"),
    ("housing", "housing"),
    ("reform", "reform"),
]
# lower-cased URL -> default rate group; first hit wins, else "default"
RATE_GROUP_BY_KEYWORD = [
    ("carlife", "car"), ("mycar", "car"), ("kyoiku", "education"), ("free", "freeloan"),
]
# lower-cased URL -> product type
PRODUCT_TYPE_BY_KEYWORD = [
    ("mycar", "mycar"), ("education", "education"), ("freeloan", "freeloan"),
]

VARIANT_LABELS = {"web": "WEB完結型", "store": "来店型"}
VARIANT_SUFFIXES = {"web": "〈WEB完結型〉", "store": "〈来店型〉"}

# -------------------------------------------------------------------- defaults
# product type: rate (percent), amount (yen), term (months)
TYPE_DEFAULTS = {
    "mycar": ((1.8, 3.8), (100000, 10000000), (6, 120)),
    "education": ((2.3, 3.8), (100000, 5000000), (12, 180)),
    "education_deed": ((2.3, 3.8), (100000, 5000000), (12, 180)),
    "education_card": ((3.5, 5.5), (100000, 3000000), (12, 36)),
    "cardloan": ((4.5, 14.5), (100000, 5000000), (12, 84)),
    "freeloan": ((6.8, 14.5), (100000, 5000000), (6, 84)),
    "reform": ((2.5, 4.5), (100000, 5000000), (12, 84)),
    "housing": ((0.5, 2.5), (100000, 5000000), (12, 84)),
    "housing_support": ((3.0, 6.0), (100000, 5000000), (12, 84)),
    "omatomeloan": ((6.8, 12.5), (100000, 5000000), (6, 120)),
    "silver": ((8.0, 14.5), (100000, 5000000), (12, 84)),
    "akiya": ((2.0, 4.0), (100000, 5000000), (12, 84)),
}
TYPE_DEFAULT_OTHER = ((2.0, 14.5), (100000, 5000000), (12, 84))

# category: amount (yen), term (months)
CATEGORY_DEFAULTS = {
    "マイカー": ((10000, 10000000), (3, 180)),
    "住宅": ((500000, 100000000), (12, 420)),
    "教育": ((10000, 10000000), (3, 192)),
    "フリー": ((10000, 3000000), (6, 120)),
    "カード": ((10000, 5000000), (1, 120)),
}

# catalogue category: rate (percent), amount (yen); others use the last rows
CATALOGUE_RATE_DEFAULTS = {"カード": (4.0, 14.8), "フリー": (3.4, 14.8), "多目的": (3.4, 14.8)}
CATALOGUE_RATE_OTHER = (2.0, 14.8)
CATALOGUE_AMOUNT_DEFAULTS = {"カード": (100000, 3000000)}
CATALOGUE_AMOUNT_OTHER = (100000, 10000000)
CATALOGUE_AGE = (20, 80)
GUARANTOR_DEFAULT = "原則不要（保証会社の保証を受けられる方）"
INCOME_DEFAULT = "継続した収入のある方"

# rate group: percent
GROUP_RATES = {
    "car": (2.0, 5.0), "education": (2.0, 4.0), "freeloan": (4.0, 14.0), "default": (2.0, 14.0),
}

# loan type: ages
AGE_BY_TYPE = {
    "教育ローン": (20, 75), "マイカーローン": (18, 75), "フリーローン": (20, 80), "おまとめローン": (20, 69),
}
AGE_OTHER = (20, 75)

RATE_BAND = (0.3, 20.0)          # percent, sanity check
AMOUNT_FLOOR_FILL = 100000       # yen, when only the upper amount is known
STRICT_MIN_AMOUNT = 100000
STRICT_MIN_TERM = 12
STRICT_AGE = (20, 75)
STRICT_REPAYMENT = "口座自動振替"
SIMPLE_MIN_AMOUNT = 10000
SIMPLE_MIN_TERM = 6

# ----------------------------------------------------------- category rules
# (label, words) in order; first hit wins
CATEGORY_BY_TEXT = [
    ("マイカー", ["マイカー", "カーライフ", "自動車", "車"]),
    ("住宅", ["住宅", "住まい", "マンション", "戸建"]),
    ("教育", ["教育", "学費", "入学"]),
    ("フリー", ["フリー", "暮らし", "使途自由"]),
    ("カード", ["カードローン", "極度額"]),
]
CATEGORY_BY_TEXT_OTHER = "その他"

# (label, words in the name, words in the lower-cased URL)
CATEGORY_BY_NAME_URL = [
    ("カード", ["カード"], ["card"]),
    ("フリー", ["フリー", "自由"], []),
    ("多目的", ["多目的"], []),
    ("住宅", ["住宅"], ["housing"]),
    ("教育", ["教育"], ["education"]),
    ("自動車", ["マイカー", "自動車"], ["car"]),
]
CATEGORY_BY_NAME_URL_OTHER = "その他"

# カー is tested before カード, so card loans end in the car class
CATEGORY_STANDARD = [
    ("マイカーローン", ["マイカー", "自動車", "カー"]),
    ("住宅ローン", ["住宅", "ホーム"]),
    ("カードローン", ["カード"]),
    ("教育ローン", ["教育"]),
    ("フリーローン", ["フリー", "多目的"]),
]
CATEGORY_STANDARD_OTHER = "その他"

RATE_TYPE_STANDARD = [("固定金利", ["固定"]), ("変動金利", ["変動"]), ("金利選択型", ["選択"])]
RATE_TYPE_CONSTANT = "変動金利"

# ------------------------------------------------------------- rate patterns
RATE_BOLD = r"<b>(\d+\.\d+)(?:&nbsp;)?</b>\s*[%％]\s*[〜～]\s*(?:<b>)?(\d+\.\d+)(?:&nbsp;)?(?:</b>)?\s*[%％]"
RATE_YEAR_HIGH = r"年\s*([2-9]\d*\.\d+)\s*[%％]\s*[〜～]\s*年\s*([2-9]\d*\.\d+)\s*[%％]"
RATE_TYPED = r"(?:固定|変動)金利.*?(\d+\.\d+)\s*[%％]\s*[〜～]\s*(\d+\.\d+)\s*[%％]"
RATE_REDUCTION_BELOW = 1.5
RATE_LOOSE_RANGE = (
    r"(?:年\s*)?(\d+(?:[\.,]\d+)?)\s*[％%]\s*[\-~〜～－–—]\s*(?:年\s*)?(\d+(?:[\.,]\d+)?)\s*[％%]"
)
RATE_LOOSE_ONE = r"(\d+(?:[\.,]\d+)?)\s*[％%]"
RATE_CONTEXT = 16
RATE_CONTEXT_WORDS = ["引下げ", "▲", "最大", "割引"]
TABLE_RANGE_TAIL = r"年\s*(\d+(?:[\.,]\d+)?)\s*[\-~〜]\s*(\d+(?:[\.,]\d+)?)\s*％"
TABLE_RANGE_BOTH = r"年\s*(\d+(?:[\.,]\d+)?)\s*％\s*[\-~〜]\s*年\s*(\d+(?:[\.,]\d+)?)\s*％"
TABLE_ONE = r"(\d+(?:[\.,]\d+)?)\s*％"
TABLE_CONTEXT = 20
TABLE_BAND = (0.1, 20.0)
BROCHURE_RANGE = r"(\d+(?:\.\d+)?)\s*[％%]\s*[\-~〜～－–—]\s*(\d+(?:\.\d+)?)\s*[％%]"
BROCHURE_ONE = r"(\d+(?:\.\d+)?)\s*[％%]"
BROCHURE_FIXED = r"固定金利\s*(\d+(?:\.\d+)?)\s*[％%]"
BROCHURE_FLOATING = r"変動金利\s*(\d+(?:\.\d+)?)\s*[％%]"
BROCHURE_BAND = (0.5, 15.0)
SIMPLE_YEAR_RANGE = r"年\s*(\d+\.\d+)\s*[%％]\s*[〜~～]\s*年\s*(\d+\.\d+)\s*[%％]"
SIMPLE_RANGE = r"(\d+\.\d+)\s*[%％]\s*[〜~～]\s*(\d+\.\d+)\s*[%％]"
SIMPLE_YEAR_ONE = r"年\s*(\d+\.\d+)\s*[%％]"
CELL_SKIP_WORDS = ["引下げ", "引下", "優遇", "割引", "最大", "まで"]
CELL_RANGE = r"(\d+\.\d+)\s*[%％]\s*[〜～]\s*(\d+\.\d+)\s*[%％]"
CELL_YEAR_ONE = r"年\s*(\d+\.\d+)\s*[%％]"
CELL_ONE = r"(\d+\.\d+)\s*[%％]"
CELL_BAND = (1.0, 20.0)
DETAIL_BAND = (1.5, 20.0)
POSTER_ONE = r"([0-9]+(?:\.[0-9]+)?)\s*%"
POSTER_BAND = (0.01, 20.0)
POSTER_WORDS = ["マイカー", "カーライフ", "マイカーローン", "ローン"]
POSTER_NAME = "マイカーローン（ポスター）"
RATE_CELL_DIGITS = r"([0-9][0-9,\.]*[0-9])\s*%?"
RATE_CELL_GROUPED = r"(\d+(?:,\d{3})*(?:\.\d+)?)\s*%?"
RATE_CELL_NONE_WORDS = ["無料", "なし"]

# ------------------------------------------------------------ amount patterns
STRICT_MAX_MAN = r"(?:最高|限度額|上限|最大|ご融資金額).*?(\d+(?:,\d{3})*)\s*万円"
STRICT_MAX_YEN = r"(?:最高|限度額|上限|最大|ご融資金額).*?(\d+(?:,\d{3})*)\s*円"
STRICT_RANGE_MAN = r"(\d+(?:,\d{3})*)\s*万円?\s*[〜～から]\s*(\d+(?:,\d{3})*)\s*万円"
STRICT_RANGE_YEN = r"(\d+(?:,\d{3})*)\s*円\s*[〜～から]\s*(\d+(?:,\d{3})*)\s*円"
STRICT_REPAYMENT_BELOW = 500000
COLLECT_UP_TO = r"(\d+(?:,\d+)?(?:\.\d+)?)(億|万)円?\s*(?:まで|以下|以内)"
COLLECT_RANGE = r"(\d+(?:,\d+)?(?:\.\d+)?)(億|万)円?\s*～\s*(\d+(?:,\d+)?(?:\.\d+)?)(億|万)円?"
COLLECT_LOAN = r"融資.*?(\d+(?:,\d+)?)(万)円?\s*(?:まで|以下|以内)"
COLLECT_HIGHEST = r"最高.*?(\d+(?:,\d+)?)(万|億)円?"
COLLECT_LARGEST = r"最大.*?(\d+(?:,\d+)?)(万|億)円?"
COLLECT_ANY = r"(\d+(?:,\d+)?)(万|億)円?"
COLLECT_ABOVE = 10000
SIMPLE_AMOUNT_RANGE = r"(\d+(?:,\d{3})*)\s*万円[^\d]*?(\d+(?:,\d{3})*)\s*万円"
SIMPLE_AMOUNT_UP_TO = r"(\d+(?:,\d{3})*)\s*万円以内"
SIMPLE_AMOUNT_HIGHEST = r"最高\s*(\d+(?:,\d{3})*)\s*万円"
CELL_AMOUNT_RANGE = r"(\d+(?:,\d{3})*)\s*万円以上.*?(\d+(?:,\d{3})*)\s*万円以下"
CELL_AMOUNT_MAN = r"(\d+(?:,\d{3})*)\s*万円"
CELL_AMOUNT_HIGHEST = r"最高.*?(\d+(?:,\d{3})*)\s*万円"
CELL_MIN_AMOUNT = 100000
LINE_LABEL = r"(融資金額|ご融資金額|ご融資額|融資額|ご融資限度額|限度額)"
LINE_RANGE = r"(\d+(?:,\d+)?)\s*(万|億)?円\s*以上[^0-9]{0,20}(\d+(?:,\d+)?)\s*(万|億)?円\s*(?:以内|まで)"
LINE_UP_TO = r"(\d+(?:,\d+)?)\s*(万|億)?円\s*(?:以内|まで)"
LINE_FROM = r"(\d+(?:,\d+)?)\s*(万|億)?円\s*以上"
LINE_LARGEST = r"(?:最大|上限)[^0-9]{0,5}(\d+(?:,\d+)?)\s*(万|億)?円"
LINE_LIMIT = r"(?:融資限度額|限度額)[^0-9]{0,10}(\d+(?:,\d+)?)\s*(万|億)?円"
LINE_BAND = (10000, 100000000)
WEB_AMOUNT_RANGE = r"(\d+(?:,\d+)?)\s*万円?\s*以上[^0-9]*(\d+(?:,\d+)?)\s*万円?\s*以内"
WEB_AMOUNT_UP_TO = r"(\d+(?:,\d+)?)\s*万円?\s*以内"
ONE_AMOUNT_LABELLED = r"(?:最大|上限|限度額|融資限度額)[^0-9]{0,10}(\d+(?:,\d{3})*)\s*(万|億)?円"
ONE_AMOUNT_ANY = r"(\d+(?:,\d{3})*)\s*(万|億)?円(?:まで|以内)?"
LABELLED_LIMIT_RANGE = r"(\d+(?:,\d{3})*)\s*[〜～]\s*(\d+(?:,\d{3})*)\s*万円"

# -------------------------------------------------------------- term patterns
# kind: ym = years and months, y = years, m = months, m_y / m_m = ranges
STRICT_TERMS = [
    ("ym", r"(\d+)\s*年\s*(\d+)\s*[ヵヶ]月以内"),
    ("ym", r"最大\s*(\d+)\s*年\s*(\d+)\s*[ヵヶ]月"),
    ("ym", r"(\d+)\s*年\s*(\d+)\s*[ヵヶ]月まで"),
    ("y", r"(\d+)\s*年.*?自動更新"),
    ("y", r"契約期間.*?(\d+)\s*年"),
    ("y", r"最長\s*(\d+)\s*年"),
    ("y", r"最大\s*(\d+)\s*年"),
    ("y", r"(\d+)\s*年間"),
    ("y", r"(\d+)\s*年以内"),
    ("m", r"(\d+)\s*[ヵヶ]月以内"),
    ("m", r"最長\s*(\d+)\s*[ヵヶ]月"),
    ("m", r"最大\s*(\d+)\s*[ヵヶ]月"),
    ("m_y", r"(\d+)\s*[ヵヶ]月\s*[～〜]\s*(\d+)\s*年"),
    ("m_m", r"(\d+)\s*[ヵヶ]月\s*[～〜]\s*(\d+)\s*[ヵヶ]月"),
]
ANY_YEARS = r"(\d+)\s*年"
ANY_MONTHS = r"(\d+)\s*(?:ヶ月|か月|カ月|ヵ月|ケ月)"
KE_MONTHS = r"(\d+)\s*ヶ月"
COLLECT_YEARS = (1, 40)
COLLECT_MONTHS = (1, 480)
SIMPLE_TERM_MONTH_YEAR = r"(\d+)\s*ヶ?月[^\d]*?(\d+)\s*年"
SIMPLE_TERM_LONGEST = r"最長\s*(\d+)\s*年"
SIMPLE_TERM_YEARS = r"(\d+)\s*年[^\d]*?(\d+)\s*年"
CELL_YEARS = (1, 50)
CELL_MONTHS = (1, 600)
TERM_NONE_WORDS = ["定めなし", "特になし"]

# --------------------------------------------------------------- age patterns
STRICT_AGES = [
    (r"満(\d+)歳以上.*?満(\d+)歳未満", -1),
    (r"満(\d+)歳以上.*?満(\d+)歳以下", 0),
    (r"(\d+)歳以上.*?(\d+)歳以下", 0),
    (r"(\d+)歳[〜～](\d+)歳", 0),
]
AGE_FROM = r"満?\s*(\d{1,2})\s*歳\s*以上"
AGE_TO = r"(?:満?\s*(\d{1,2})\s*歳\s*以下|完済時.*?満?\s*(\d{1,2})\s*歳以下)"
CELL_AGE_FROM = r"満(\d+)歳以上"
CELL_AGE_BELOW = r"満(\d+)歳未満"
CELL_AGE_MAX = 80

# --------------------------------------------------------- words and features
REPAYMENT_WORDS = [("自動振替", "口座自動振替"), ("元利均等", "元利均等返済"), ("随時返済", "随時返済可能")]
REPAYMENT_PATTERN = r"(元利均等|元金均等).*?返済"
FEATURE_WORDS = [
    ("WEB完結", "WEB完結対応"), ("来店不要", "来店不要"), ("保証料込", "保証料込み"),
    ("繰上返済", "繰上返済対応"), ("自動更新", "自動更新"), ("ATM", "ATM利用可能"),
]
INCOME_WORDS = [("安定した収入", "安定した収入があること"), ("継続的な収入", "継続的な収入があること")]
GUARANTOR_NOT_NEEDED = "原則不要（保証会社が保証）"
GUARANTOR_COMPANY = "保証会社による保証"
WEB_LIMIT = r"WEB.*?(\d+(?:,\d{3})*)\s*万円"
NAME_WORDS_TITLE = ["ローン", "カード"]
NAME_WORDS_HEADING = ["ローン", "カード", "プラン"]
NAME_FALLBACK_HEADING = "青い森信用金庫 ローン"
NAME_FALLBACK_CATALOGUE = "不明な商品"
NAME_PREFIX = "青森みちのく"
NAME_QUOTED_H1 = r"青森県信用組合\s*[「\"](.+?)[」\"]"
NAME_QUOTED_TITLE = r"青森県信用組合[「\"](.+?)[」\"]"
BROCHURE_NAMES = ["カーライフプラン", "マイカープラス", "教育カードローン", "新教育ローン", "教育ローン", "フリーローン"]
AS_OF_DATE = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
OVERVIEW_HEADING = "商品概要|商品詳細|商品内容"

# web product name -> brochure names
NAME_ALIASES = {
    "とうしんカーライフプラン": ["カーライフプラン", "マイカーローン"],
    "教育ローン": ["教育プラン", "教育ローン"],
    "新教育ローン": ["新教育ローン"],
    "教育カードローン": ["教育カードローン"],
    "フリーローン": ["フリーローン"],
    "シルバーライフローン": ["シルバーライフローン"],
    "とうしんカードローン": ["カードローン"],
}
WEB_TABLE_NAMES = [
    "カーライフプラン", "マイカーローン", "教育プラン", "教育ローン", "新教育ローン",
    "教育カードローン", "フリーローン", "シルバーライフローン", "カードローン",
]

# ----------------------------------------------------------------------- grids
HEADER_ALIASES = {
    "product_name": ["商品名", "商品", "プラン", "名称", "商品／プラン", "取扱商品"],
    "rate_campaign": ["キャンペーン", "金利優遇", "優遇後金利", "増額金利", "特別金利"],
    "rate_floating": ["変動金利", "基準金利", "通常金利", "店頭金利", "年利"],
    "rate_incl_guarantee": ["保証料込", "保証料込み", "保証料含む"],
}
TABLE_SCORE_WORDS = ["金利", "％", "%", "保証", "年", "変動", "キャンペーン"]

# ---------------------------------------------------------------- text mining
MINE_RATES = [r"(\d+\.\d+)%", r"金利[：:\s]*(\d+\.\d+)", r"年率[：:\s]*(\d+\.\d+)", r"実質年率[：:\s]*(\d+\.\d+)"]
MINE_AMOUNTS = [r"(\d+)万円", r"(\d{1,3}(?:,\d{3})*)円", r"融資額[：:\s]*(\d+)", r"借入[：:\s]*(\d+)"]
MINE_TERMS = [r"(\d+)年", r"(\d+)ヶ月", r"期間[：:\s]*(\d+)", r"返済期間[：:\s]*(\d+)"]
MINE_PHONES = [r"(\d{2,4}-\d{2,4}-\d{4})"]

# ------------------------------------------------------------- stored records
STRUCTURED_KEYS = [
    "product_name", "loan_category", "min_interest_rate", "max_interest_rate",
    "interest_rate_type", "min_loan_amount", "max_loan_amount",
    "min_loan_period_months", "max_loan_period_months", "min_age", "max_age",
    "guarantor_fee", "handling_fee", "prepayment_fee", "application_conditions",
    "repayment_method", "application_method", "required_documents",
    "guarantor_info", "guarantor_required", "collateral_info", "features",
]
# stored key <- other names used for it, first non-null wins
KEY_SYNONYMS = {
    "loan_category": ["category", "loan_type"],
    "interest_rate_type": ["interest_type"],
    "min_loan_period_months": ["min_loan_term_months", "min_loan_term"],
    "max_loan_period_months": ["max_loan_term_months", "max_loan_term"],
    "features": ["special_features"],
}
PROCESSING_STATES = ["pending", "processing", "completed", "failed", "retry"]
# columns an existing product takes over from a newer version
UPSERT_REFRESHED = [
    "product_name", "loan_type", "summary", "interest_rate_min", "interest_rate_max",
    "interest_rate_type", "loan_amount_min", "loan_amount_max", "loan_term_min",
    "loan_term_max", "repayment_methods", "application_requirements", "features",
    "data_updated_at",
]
FAVOURITE_LIMIT = 100

# sections of the model's answer
ANSWER_SECTIONS = [
    "product_analysis", "customer_guide", "market_positioning", "risk_assessment",
    "financial_summary", "actionable_insights", "data_confidence",
]
FENCE_OPEN = "```json"
FENCE_CLOSE = "```"

# summary document: path, type
SUMMARY_REQUIRED = [
    ("basic_info.product_name", "string"),
    ("basic_info.institution_name", "string"),
    ("basic_info.loan_type", "string"),
    ("basic_info.summary", "string"),
    ("key_conditions.interest_rate.type", "string"),
    ("key_conditions.interest_rate.rate", "string"),
    ("key_conditions.loan_amount.min", "number"),
    ("key_conditions.loan_amount.max", "number"),
    ("key_conditions.loan_amount.unit", "string"),
    ("key_conditions.loan_term.min", "number"),
    ("key_conditions.loan_term.max", "number"),
    ("key_conditions.loan_term.unit", "string"),
    ("metadata.source_url", "string"),
    ("metadata.scraped_at", "string"),
    ("metadata.processed_at", "string"),
    ("metadata.ai_model", "string"),
]
SUMMARY_ALLOWED = {
    "key_conditions.interest_rate.type": ["固定", "変動", "固定選択"],
    "key_conditions.loan_amount.unit": ["万円", "円"],
    "key_conditions.loan_term.unit": ["年", "月"],
}
SUMMARY_DATES = ["metadata.scraped_at", "metadata.processed_at"]
SUMMARY_RANGES = ["key_conditions.loan_amount", "key_conditions.loan_term"]
ISO_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"

DEFAULT_SEARCH_TYPE = "住宅ローン"
