"""Raw -> processed -> product layers as whole-table jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions import answers, labels, shaping
from yushi.operators import identity, layers, metrics, queues, search
from yushi.plans.extract import identified
from yushi.session import written

c = F.col


# ------------------------------------------------------------------- raw layer
def raw_rows(products: DataFrame, more=()) -> DataFrame:
    """Extraction output as raw-layer rows: common keys, record, hash, length.

    Title, hash and length are taken over when the extraction added them and are
    computed from html_content otherwise."""
    if "content_hash" not in products.columns:
        products = identified(products)
    df = shaping.harmonize(products.withColumn("dropped_keys", shaping.dropped_keys(products)))
    at = F.coalesce(c("scraped_at").try_cast("timestamp"), F.current_timestamp())
    return df.select(
        "raw_id", "institution_id", F.coalesce("source_url", F.lit("")).alias("source_url"),
        "page_title", "content_hash", "content_length", at.alias("scraped_at"),
        shaping.structured(df).alias("structured"), "dropped_keys", *more)


IDENTITY = ["raw_id", "institution_id", "source_url", "page_title", "content_length", "scraped_at"]


def ingest_raw(rows: DataFrame, layer: DataFrame | None = None, key=("content_hash",)) -> DataFrame:
    """New pages merged into the raw layer's versions (`layers.as_layer` reads them).

    Running it again over the same pages changes nothing but `copies`."""
    new = layers.page_versions(rows, IDENTITY, ["structured"], key)
    return new if layer is None else layers.merge_versions(layer, new, key=key)


def ingest_pages(rows: DataFrame, institutions: DataFrame, layer: DataFrame | None = None) -> dict[str, DataFrame]:
    """The whole job: institutions of the rows found or numbered anew, then the raw layer.

    `rows` are raw rows with institution_code and institution_name instead of an id."""
    known = identity.institution_map(rows, institutions)
    first = lambda c: F.min(F.nullif(F.col(c), F.lit(""))).alias(c)
    new = known.where("is_new").groupBy("institution_id").agg(first("institution_code"), first("institution_name"))
    found = identity.with_institutions(rows, known).drop("institution_code", "institution_name", "is_new")
    return {"raw": ingest_raw(found, layer), "new_institutions": new}


# ------------------------------------------------------------- processed layer
def process_batch(raw: DataFrame, institutions: DataFrame, processed: DataFrame,
                  summarise: Callable, model: str, limit: int | None = 10) -> DataFrame:
    """Queue -> prompt -> injected model -> parsed rows, one row for each page of the queue.

    `summarise` maps batches (raw_id, prompt) to (raw_id, response_text); it is
    the only step outside the JVM and runs once per partition of the queue.  Queue and
    replies are written once, so no later action asks the model again; a page
    without a reply is kept as failed."""
    queue = written(queues.unprocessed(raw, institutions, processed, limit), "queue")
    spread = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = queue.select("raw_id", answers.prompt(
        c("institution_name"), c("source_url"), c("page_title"), c("structured")).alias("prompt")).repartition(spread, "raw_id")
    replies = written(asked.mapInPandas(summarise, "raw_id long, response_text string"), "replies")
    return processed_rows(queue.select("raw_id", "institution_id").join(replies, "raw_id", "left"), F.lit(model),
                          F.current_timestamp())


def processed_rows(replies: DataFrame, model: Column, at: Column, summary: str | None = None) -> DataFrame:
    """Stored form of answers; missing and unreadable ones are kept and marked.

    Where rows carry a summary document, its findings decide the validation status."""
    df = replies.withColumn("ai_summary", answers.answer_json(c("response_text")))
    df = df.withColumn("parse_ok", F.coalesce(answers.is_json(c("ai_summary")), F.lit(False)))
    parsed = answers.parse_answer(c("ai_summary"))
    found = answers.summary_status(answers.summary_messages(c(summary))) if summary else F.lit("valid")
    return df.select(
        "raw_id", "institution_id", "ai_summary", model.alias("ai_model"),
        F.when(c("response_text").isNull(), "failed").otherwise("completed").alias("processing_status"),
        F.when(c("parse_ok"), found).otherwise("error").alias("validation_status"),
        F.when(c("parse_ok"), answers.quality_messages(parsed)).alias("validation_messages"),
        F.when(c("response_text").isNull(), "no reply").when(~c("parse_ok"), "unreadable reply").alias("error_message"),
        "parse_ok", at.alias("processed_at"))


# --------------------------------------------------------------- product layer
def product_rows(processed: DataFrame, structured: DataFrame, rate_type: str = "constant",
                 rules: str = "literal") -> DataFrame:
    """Completed rows with their page record as product rows (one left join)."""
    df = processed.join(structured, "raw_id", "left").withColumn("a", answers.parse_answer(c("ai_summary")))
    kind = (F.lit(V.RATE_TYPE_CONSTANT) if rate_type == "constant"
            else labels.rate_type_standard(c("structured.interest_rate_type")))
    s = "structured"
    features = F.struct(
        F.coalesce("a.product_analysis.competitive_advantages", F.array().cast("array<string>")).alias("competitive_advantages"),
        F.coalesce("a.customer_guide.key_benefits", F.array().cast("array<string>")).alias("key_benefits"),
        F.coalesce("a.market_positioning.unique_selling_points", F.array().cast("array<string>")).alias("unique_selling_points"),
        F.coalesce("a.customer_guide.recommended_use_cases", F.array().cast("array<string>")).alias("recommended_use_cases"),
        F.coalesce("a.market_positioning.target_market_segment", F.lit("")).alias("market_segment"),
        F.coalesce("a.customer_guide.application_difficulty", F.lit("")).alias("application_difficulty"),
        F.coalesce("a.risk_assessment.flexibility_score", F.lit("")).alias("flexibility_score"),
        F.coalesce("a.market_positioning.interest_rate_competitiveness", F.lit("")).alias("rate_competitiveness"))
    requirements = F.struct(
        F.coalesce(f"{s}.application_conditions", F.lit("")).alias("basic_conditions"),
        F.coalesce("a.risk_assessment.borrower_risks", F.array().cast("array<string>")).alias("risk_factors"),
        F.coalesce("a.actionable_insights.pre_application_checklist", F.array().cast("array<string>")).alias("pre_check_list"),
        F.coalesce(f"{s}.required_documents", F.lit("")).alias("required_documents"),
        F.coalesce(f"{s}.guarantor_info", F.lit("")).alias("guarantor_info"),
        F.coalesce(f"{s}.collateral_info", F.lit("")).alias("collateral_info"))
    empty = F.array().cast("array<string>")
    analysis = F.to_json(F.struct(
        F.coalesce("a.product_analysis.executive_summary", F.lit("")).alias("executive_summary"),
        F.coalesce("a.product_analysis.potential_concerns", empty).alias("potential_concerns"),
        F.coalesce("a.product_analysis.best_fit_customers", empty).alias("best_fit_customers"),
        F.coalesce("a.financial_summary.cost_simulation", F.create_map().cast("map<string,string>")).alias("cost_simulation"),
        F.coalesce("a.actionable_insights.negotiation_points", empty).alias("negotiation_points"),
        F.coalesce("a.actionable_insights.alternative_considerations", empty).alias("alternative_considerations")))
    return df.select(
        c("processed_id").alias("processed_data_id"), "institution_id",
        c(f"{s}.product_name").alias("product_name"), c(f"{s}.loan_category").alias("loan_type"),
        labels.category_standard(c(f"{s}.loan_category"), rules).alias("loan_category"),
        F.coalesce("a.customer_guide.simple_explanation", "a.product_analysis.executive_summary", F.lit("")).alias("summary"),
        shaping.stored_rate(c(f"{s}.min_interest_rate")).alias("interest_rate_min"),
        shaping.stored_rate(c(f"{s}.max_interest_rate")).alias("interest_rate_max"),
        kind.alias("interest_rate_type"),
        c(f"{s}.min_loan_amount").alias("loan_amount_min"), c(f"{s}.max_loan_amount").alias("loan_amount_max"),
        shaping.months_to_years(c(f"{s}.min_loan_period_months")).alias("loan_term_min"),
        shaping.months_to_years(c(f"{s}.max_loan_period_months")).alias("loan_term_max"),
        F.array(F.coalesce(f"{s}.repayment_method", F.lit(""))).alias("repayment_methods"),
        requirements.alias("application_requirements"), features.alias("features"),
        F.lit(None).cast("string").alias("product_code"), F.lit("円").alias("loan_amount_unit"), F.lit("年").alias("loan_term_unit"),
        analysis.alias("ai_analysis"),
        F.lit(True).alias("is_active"), c("processed_at").alias("data_updated_at"))


def split_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(storable rows, rejects with reason); name and type must not be NULL."""
    reason = F.when(c("product_name").isNull(), "null_product_name").when(c("loan_type").isNull(), "null_loan_type")
    tagged = rows.withColumn("reason", reason)
    return (tagged.where(c("reason").isNull()).drop("reason"),
            tagged.where(c("reason").isNotNull()).select("processed_data_id", "institution_id", "reason"))


HISTORY_FIELDS = [
    "summary", "interest_rate_min", "interest_rate_max", "interest_rate_type", "loan_amount_min", "loan_amount_max",
    "loan_term_min", "loan_term_max", "repayment_methods", "application_requirements", "features",
]


def run_rows(processed: DataFrame, structured: DataFrame, institutions: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Storable rows and rejects of everything that a run finds open, without storing anything."""
    queue = queues.open_rows(processed, ledger, institutions, None).drop("institution_name")
    return split_rejects(product_rows(queue, structured))


def integrate(processed: DataFrame, structured: DataFrame, institutions: DataFrame, products: DataFrame,
              order: str = "newest", limit: int | None = None, ledger: DataFrame | None = None) -> dict[str, DataFrame]:
    """One run: queue, product rows, upsert, what changed, what was rejected, and the ids that were taken.

    The product rows of the queue are written once; everything else reads them and the stored products. With a
    `ledger` of consumed ids the queue is what it lacks, else what no product carries."""
    queue = (queues.unintegrated(processed, institutions, products, limit) if ledger is None
             else queues.open_rows(processed, ledger, institutions, limit)).drop("institution_name")
    rows = written(product_rows(queue, structured), "product-rows")
    good, rejects = split_rejects(rows)
    old = products.select(*good.columns)
    stored = layers.upsert(old, good, order)
    changes = layers.history(good, HISTORY_FIELDS, last=old)
    if "product_id" in products.columns:
        stored = written(layers.with_ids(stored, products.select(*layers.PRODUCT_KEY, "product_id")), "products")
        changes = changes.join(stored.select(*layers.PRODUCT_KEY, "product_id"), layers.PRODUCT_KEY, "left")
    return {"products": stored, "history": changes, "rejects": rejects, "taken": rows.select(c("processed_data_id").alias("processed_id"))}


def withdraw(products: DataFrame, gone: Column) -> DataFrame:
    """Products whose offer has ended stay in the layer, marked as not active."""
    return products.withColumn("is_active", c("is_active") & ~F.coalesce(gone, F.lit(False)))


def store_products(products: DataFrame, known: DataFrame | None, path: str) -> None:
    """Write a version of the product layer with ids, by loan type; `known` gives the ids of products stored before.

    Rows of a type lie along `search.curve`, so that row groups hold narrow ranges of rate, amount and term; where a type
    is large, it is cut into several files along the curve."""
    if known is None:
        known = products.sparkSession.createDataFrame([], "institution_id long, product_name string, loan_type string, product_id long")
    rows = search.with_open_ends(layers.with_ids(products, known)).withColumn("_place", search.curve())
    placed = rows.repartitionByRange("loan_type", "_place").sortWithinPartitions("loan_type", "_place").drop("_place")
    layers.write_version(placed, path, "loan_type")


def read_products(spark, path: str) -> DataFrame:
    return layers.read_version(spark, path, "loan_type")


def run_all(sources: dict[str, DataFrame], rules: dict[str, Callable], run_id: str, log_path: str | None = None) -> dict:
    """Extract every source once; rows that yield no product become rejects.

    A source is one branch of the plan, its bad rows are data and not errors, so no source can stop another. What was extracted is
    written once: products, rejects and log read it, and `counters` were observed by that write. With `log_path` the log lies there in
    one folder per run, so the same run id again replaces its rows and totals stay right."""
    out = None
    for name, pages in sources.items():
        part = rules[name](pages)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    ok, seen = c("product_name").isNotNull(), Observation()
    out = written(out.observe(seen, F.count("*").alias("total"), F.count_if(ok).alias("ok")), "extracted")
    log = out.select(F.lit(run_id).alias("run_id"), c("scraped_at").alias("ts"), c("source_rule").alias("source_no"),
                     ok.cast("int").alias("ok"))
    if log_path:
        layers.write_layer(log, log_path, ["run_id"])
        log = out.sparkSession.read.schema(log.schema).parquet(log_path).where(c("run_id") == run_id)
    return {"products": out.where(ok), "rejects": out.where(~ok), "log": log, "summary": metrics.run_summary(log), "counters": seen.get}
