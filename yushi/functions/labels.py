"""Keyword classification: categories, rate types, repayment, features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import group, has_any, hit, let, pick, whole


def _joined(pairs, text: Column, sep: str = "; ") -> Column:
    """Labels whose word occurs, in rule order."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.contains(w), label) for w, label in pairs])), sep)


def repayment_words(text: Column) -> Column:
    return let(_joined(V.REPAYMENT_WORDS, text), lambda f: F.when(f != "", f).otherwise(V.STRICT_REPAYMENT))


def repayment_phrase(text: Column) -> Column:
    return hit(text, V.REPAYMENT_PATTERN)


def rate_type_from_hints(text: Column, hints: Column) -> Column:
    """The page decides first; the profile's hints fill in."""
    body = F.coalesce(text, F.lit(""))
    named = F.when(body.contains("固定") & ~body.contains("変動"), "固定金利").when(body.contains("変動"), "変動金利")
    typed = F.transform(hints, lambda h: F.when(h.contains("固定") & ~h.contains("変動"), "固定金利").when(
        h.contains("変動"), "変動金利"))
    return F.coalesce(named, F.try_element_at(F.filter(typed, lambda t: t.isNotNull()), F.lit(1)))


def rate_type_simple(text: Column) -> Column:
    return F.when(text.contains("変動金利"), "変動金利").otherwise("固定金利")


def rate_type_standard(name: Column) -> Column:
    return pick(V.RATE_TYPE_STANDARD, name, None)


def category_by_text(text: Column) -> Column:
    return pick(V.CATEGORY_BY_TEXT, text, V.CATEGORY_BY_TEXT_OTHER)


def category_by_name_url(name: Column, url: Column) -> Column:
    low = F.lower(url)
    out = None
    for label, words, url_words in V.CATEGORY_BY_NAME_URL:
        cond = has_any(name, words) | has_any(low, url_words)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(V.CATEGORY_BY_NAME_URL_OTHER)


def category_standard(name: Column, rules: str = "literal") -> Column:
    """Stored category of a loan type.

    `literal` keeps the given order, in which every card loan counts as a car
    loan; `fixed` tests the card rule first."""
    table = list(V.CATEGORY_STANDARD)
    if rules == "fixed":
        table.sort(key=lambda rule: rule[0] != "カードローン")
    return pick(table, F.coalesce(name, F.lit("")), V.CATEGORY_STANDARD_OTHER)


def product_type(url: Column, loan_type: Column, category: Column) -> Column:
    low = F.lower(url)
    out = None
    for word, kind in V.PRODUCT_TYPE_BY_KEYWORD:
        out = F.when(low.contains(word), kind) if out is None else out.when(low.contains(word), kind)
    return (out.when(category.contains("カードローン"), "card").when(loan_type.contains("教育"), "education")
            .when(loan_type.contains("自動車") | category.contains("マイカー"), "mycar").otherwise("general"))


def features_common(text: Column) -> Column:
    return F.array_join(F.array_compact(F.array(
        F.when(text.contains("WEB") & has_any(text, ["申込", "完結"]), "WEB申込対応"),
        F.when(text.contains("来店不要"), "来店不要"),
        F.when(text.contains("ATM"), "ATM利用可能"))), "; ")


def features_listed(text: Column) -> Column:
    return _joined(V.FEATURE_WORDS, text)


def features_by_profile(text: Column, words: Column) -> Column:
    """Profile key words found in the text, sorted, NULL if none."""
    found = F.array_sort(F.array_distinct(F.filter(words, lambda w: F.contains(text, w))))
    return let(found, lambda f: F.when(F.size(f) > 0, F.array_join(f, " / ")))


def with_variant_tag(special: Column, variant: Column) -> Column:
    tag = F.when(variant == "web", V.VARIANT_LABELS["web"]).when(variant == "store", V.VARIANT_LABELS["store"])
    return F.when(tag.isNotNull(), F.concat_ws(" / ", special, tag)).otherwise(special)


def feature_list(text: Column) -> Column:
    """'/' separated feature text to an array without empty entries."""
    return F.filter(F.transform(F.split(text, "/"), lambda p: F.trim(p)), lambda p: p != "")


def income(text: Column) -> Column:
    return let(_joined(V.INCOME_WORDS, text), lambda f: F.when(f != "", f).otherwise(V.INCOME_WORDS[0][1]))


def guarantor(text: Column) -> Column:
    return (F.when(text.contains("保証人") & text.contains("不要"), V.GUARANTOR_NOT_NEEDED)
            .when(text.contains("保証会社"), V.GUARANTOR_COMPANY).otherwise(""))


def product_notes(text: Column, kind: Column) -> Column:
    """Facts that only one product type states."""
    web_limit = F.when((kind == "education") & text.contains("WEB完結"), whole(group(text, V.WEB_LIMIT, 1)) * 10000)
    return F.struct(
        F.when((kind == "card") & text.contains("3年自動更新"), "3年自動更新").alias("loan_term_note"),
        ((kind == "card") & text.contains("専用カード")).alias("card_issuance"),
        ((kind == "education") & text.contains("在学中") & text.contains("利息のみ")).alias("interest_only_during_study"),
        web_limit.alias("web_completion_limit"),
        ((kind == "mycar") & text.contains("繰上返済手数料無料")).alias("early_repayment_fee_free"),
        ((kind == "mycar") & text.contains("ボーナス返済")).alias("bonus_repayment_available"),
    )
