"""Page corpus -> product rows.

Each source has its own rule set.  The corpus is split by `source_rule` and the
branches are united by column name: one small plan per rule set instead of one
projection holding every pattern.  Keep the page table partitioned by
`source_rule` so that each branch reads only its own files.

Input columns: raw_id, institution_id, source_url, scraped_at, source_rule,
html_content, brochure_text, brochure_file, rate_page_text, variant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yushi.functions import amounts, grids, labels, rates, shaping, terms
from yushi.functions import text as T
from yushi.functions.regex import no_pair, once
from yushi.operators import matching
from yushi.operators.texts import per_text
from yushi.sources import seeds

IDS = ["raw_id", "institution_id", "source_url", "scraped_at", "source_rule", "page_title", "content_hash", "content_length"]
c = F.col


def identified(pages: DataFrame, body: str = "html_content") -> DataFrame:
    """Title, hash and length beside the page, so that its body can stay behind."""
    return pages.withColumns({
        "page_title": T.page_title(c("html_content")), "content_hash": T.content_hash(c(body)),
        "content_length": F.length(F.coalesce(body, F.lit("")))})


def bank_products(pages: DataFrame) -> DataFrame:
    """Page text and brochure by profile, rate chain page -> brochure -> rate table."""
    df = T.with_page_text(matching.with_profiles(identified(pages), "source_url"), "html_content", "page")
    df = df.withColumns({
        "sheet": F.coalesce("brochure_text", F.lit("")),
        "rate_text": T.normalize_rate_page(c("rate_page_text")),
        "heading": T.first_heading(c("html_content")),
    })
    slug = matching.rate_slug(c("source_url"))
    df = df.withColumns({
        "amount": once(amounts.collect(c("page"))),
        "h_term": once(terms.collect(c("page"), 6)), "h_age": once(terms.ages_loose(c("page"))),
        "b_term": once(terms.collect(c("sheet"), 6)), "b_age": once(terms.ages_loose(c("sheet"))),
        "repay": once(labels.repayment_phrase(c("page"))),
        "channel_rate": once(F.when(slug.isNotNull() & c("variant").isNotNull(), variant_rate(c("rate_text"), c("variant")))),
    })
    df = df.withColumn("_rate", once(matching.fallback_rate(
        rates.from_context(c("page")), rates.from_brochure(c("sheet")),
        F.when(slug.isNotNull(), rates.from_rate_table(c("rate_text"))), c("variant"),
        F.coalesce("channel_rate", no_pair("double")))))
    body = F.when(c("sheet") != "", c("sheet")).otherwise(c("page"))
    merged = shaping.merge_fields({
        "min_loan_term": (c("h_term.lo"), c("b_term.lo")), "max_loan_term": (c("h_term.hi"), c("b_term.hi")),
        "min_age": (c("h_age.lo"), c("b_age.lo")), "max_age": (c("h_age.hi"), c("b_age.hi")),
        "repayment_method": (c("repay"), F.lit(None).cast("string")),
    }, F.coalesce("brochure_keys", F.array().cast("array<string>")))
    df = df.withColumns({
        **merged,
        "min_loan_amount": c("amount.lo"), "max_loan_amount": c("amount.hi"),
        "min_interest_rate": c("_rate.lo"), "max_interest_rate": c("_rate.hi"),
        "product_name": T.variant_name(F.coalesce("profile_name", T.normalize_text(c("heading"))), c("variant")),
        "loan_type": c("profile_type"), "category": c("profile_category"),
        "interest_type": labels.rate_type_from_hints(body, c("hints")),
        "special_features": labels.with_variant_tag(once(labels.features_by_profile(body, c("keywords"))), c("variant")),
    })
    df = df.withColumnsRenamed({"min_loan_term": "min_loan_term_months", "max_loan_term": "max_loan_term_months"})
    return _checked(df)


def _checked(df: DataFrame) -> DataFrame:
    """The sanity step, with the names of what it filled."""
    out = shaping.sanity(df, c("loan_type"))
    return out.withColumn("imputed_fields", shaping.imputed_fields(["min_loan_amount", "min_age", "max_age"])).select(*IDS, *PRODUCT_COLUMNS)


def variant_rate(rate_text, variant):
    """Rate of a sales channel's section; the whole page if no section has one."""
    def of(name):
        blocks = rates.sections_by_variant(rate_text, name)
        return rates.first_typed(F.transform(blocks, rates.from_rate_table))

    return F.coalesce(F.when(variant == "web", of("web")).when(variant == "store", of("store")),
                      rates.from_rate_table(rate_text))


def simple_products(pages: DataFrame) -> DataFrame:
    """Plain patterns on the whole text, category defaults, inverted pairs swapped."""
    df = identified(pages).withColumn("page", T.fold(T.raw_text(c("html_content"))))
    df = shaping.spread(df, rate=rates.simple(c("page")), amount=amounts.simple(c("page")), term=terms.simple(c("page")))
    df = df.withColumn("category", labels.category_by_text(c("page")))
    df = shaping.swap_inverted(shaping.fill(df, shaping.category_defaults(c("category")), zero_is_missing=True))
    return df.select(
        *IDS, T.name_from_heading(c("html_content")).alias("product_name"), "category",
        "min_interest_rate", "max_interest_rate", labels.rate_type_simple(c("page")).alias("interest_type"),
        "min_loan_amount", "max_loan_amount", "min_loan_term_months", "max_loan_term_months",
        shaping.imputed_fields(shaping.category_defaults(c("category"))).alias("imputed_fields"))


def catalogue_products(pages: DataFrame) -> DataFrame:
    """Labelled table rows of catalogue pages with catalogue defaults."""
    df = identified(pages).withColumns({
        "page": T.raw_text(c("html_content")),
        "f": grids.catalogue_fields(grids.html_tables(T.fold(c("html_content")))),
        "product_name": T.name_from_catalogue(c("html_content")),
    })
    df = df.withColumns({
        "category": labels.category_by_name_url(c("product_name"), c("source_url")),
        "guarantor_requirements": c("f.guarantor_requirements"), "income_requirements": F.lit(None).cast("string"),
    })
    df = shaping.spread(df, rate=c("f.rate"), amount=c("f.amount"), age=c("f.age"))
    df = shaping.fill(df, shaping.catalogue_defaults(c("category")))
    return df.select(
        *IDS, "product_name", "category", "min_interest_rate", "max_interest_rate",
        F.lit("変動金利").alias("interest_type"), "min_loan_amount", "max_loan_amount", "min_age", "max_age",
        labels.features_listed(c("page")).alias("special_features"),
        shaping.imputed_fields(n for n in shaping.catalogue_defaults(c("category")) if not n.endswith("requirements")).alias("imputed_fields"))


def brochure_products(pages: DataFrame) -> DataFrame:
    """Brochure texts with the file's profile, merged with the page they belong to.

    The profile's fields come from the sheet first, the others from the page first; either fills
    what the other lacks. The sanity step and the profile's key words follow."""
    df = pages.where(c("brochure_text").isNotNull()).join(
        F.broadcast(seeds.file_profiles(pages.sparkSession)), c("brochure_file") == c("file_name"), "left")
    df = T.with_page_text(identified(df.withColumn("sheet", T.normalize_brochure(c("brochure_text"))), "sheet"), "html_content", "page")
    df = df.withColumns({
        "s_rate": once(rates.from_brochure_typed(c("sheet"))), "s_amount": once(amounts.from_lines(c("sheet"))),
        "s_term": once(terms.collect(c("sheet"), 6)), "s_age": once(terms.ages_loose(c("sheet"))),
        "h_amount": once(amounts.collect(c("page"))),
        "h_term": once(terms.collect(c("page"), 6)), "h_age": once(terms.ages_loose(c("page"))),
        "h_rate": once(rates.from_context(c("page"))),
    })
    pairs = {
        "min_interest_rate": ("rate", "lo"), "max_interest_rate": ("rate", "hi"), "min_loan_amount": ("amount", "lo"), "max_loan_amount": ("amount", "hi"),
        "min_loan_term": ("term", "lo"), "max_loan_term": ("term", "hi"), "min_age": ("age", "lo"), "max_age": ("age", "hi"),
    }
    merged = shaping.merge_fields(
        {k: (F.coalesce(c(f"h_{n}.{side}"), c(f"s_{n}.{side}")), c(f"s_{n}.{side}")) for k, (n, side) in pairs.items()},
        F.coalesce("brochure_keys", F.array().cast("array<string>")))
    df = df.withColumns({
        **merged,
        "product_name": T.name_from_brochure(c("sheet"), c("profile_name")), "loan_type": c("profile_type"), "category": c("profile_category"),
        "interest_type": labels.rate_type_from_hints(c("sheet"), c("hints")), "repayment_method": labels.repayment_phrase(c("page")),
        "special_features": labels.features_by_profile(c("sheet"), c("keywords")),
    })
    df = df.withColumnsRenamed({"min_loan_term": "min_loan_term_months", "max_loan_term": "max_loan_term_months"})
    return _checked(df)


PRODUCT_COLUMNS = [
    "product_name", "loan_type", "category", "min_interest_rate", "max_interest_rate", "interest_type",
    "min_loan_amount", "max_loan_amount", "min_loan_term_months", "max_loan_term_months",
    "min_age", "max_age", "repayment_method", "special_features", "imputed_fields",
]
INPUTS = ["source_url", "source_rule", "html_content", "brochure_text", "brochure_file", "rate_page_text", "variant"]


def once_per_page(rule):
    """The rule set over the different inputs of pages; every capture of a page gets the record of its inputs.

    In the rule's frame a digest of the inputs stands for raw_id, and what a capture has of its own is NULL: the rule sets only pass these on."""
    def products(pages: DataFrame) -> DataFrame:
        captures = pages.select("raw_id", "institution_id", "scraped_at", F.sha2(F.to_json(F.struct(*INPUTS)), 256).alias("_inputs"), *INPUTS)
        none = [F.lit(None).cast(pages.schema[x].dataType).alias(x) for x in ("institution_id", "scraped_at")]
        found = rule(captures.select(c("_inputs").alias("raw_id"), *INPUTS).distinct().select("*", *none))
        records = found.drop("institution_id", "scraped_at").withColumnRenamed("raw_id", "_inputs")
        return captures.drop(*INPUTS).join(records, "_inputs").select(*found.columns)

    return products


RULES = {name: once_per_page(rule) for name, rule in {
    "bank": bank_products, "simple": simple_products, "catalogue": catalogue_products, "brochure": brochure_products}.items()}


def extract_products(pages: DataFrame, rules=RULES) -> DataFrame:
    """All sources' products with the same columns; no action runs here."""
    out = None
    for name, rule in rules.items():
        part = rule(pages.where(c("source_rule") == name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def strict_fields(pages: DataFrame, kind) -> DataFrame:
    """Labelled rows first, then cells, then text patterns and type defaults; equal pages of a kind are read once."""
    def found(df):
        df = df.withColumns({
            "page": T.fold(T.raw_text(c("html_content"))),
            "tables": grids.html_tables(T.fold(c("html_content"))),
        })
        df = df.withColumn("f", grids.loan_fields(c("tables")))
        cells = F.flatten(F.flatten(c("tables")))
        default = lambda field: shaping.type_default(c("_kind"), field)
        return shaping.spread(
            df,
            rate=F.coalesce(c("f.rate"), rates.from_all_cells(cells), rates.strict(c("html_content"), c("page"), cells, default("rate"))),
            amount=F.coalesce(c("f.amount"), amounts.strict(c("page"), default("amount"))),
            term=F.coalesce(c("f.term"), terms.strict(c("page"), default("term"))),
            age=terms.ages_strict(c("page")),
        ).drop("f", "tables", "page")

    return per_text(pages.withColumn("_kind", kind), "html_content", found, ["_kind"]).drop("_kind")
