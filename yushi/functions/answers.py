"""Model answers and summaries: parsing, validation and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import let

ANSWER_SCHEMA = (
    "product_analysis struct<executive_summary:string,competitive_advantages:array<string>,"
    "potential_concerns:array<string>,best_fit_customers:array<string>>,"
    "customer_guide struct<simple_explanation:string,key_benefits:array<string>,application_difficulty:string,"
    "recommended_use_cases:array<string>>,"
    "market_positioning struct<interest_rate_competitiveness:string,unique_selling_points:array<string>,"
    "target_market_segment:string>,"
    "risk_assessment struct<borrower_risks:array<string>,flexibility_score:string,total_cost_transparency:string>,"
    "financial_summary struct<validated_conditions:map<string,string>,cost_simulation:map<string,string>>,"
    "actionable_insights struct<pre_application_checklist:array<string>,negotiation_points:array<string>,"
    "alternative_considerations:array<string>>,"
    "data_confidence struct<analysis_reliability:string,missing_information:array<string>,last_updated_estimate:string>,"
    "data_quality map<string,string>"
)


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def answer_json(response: Column) -> Column:
    """Text of the first fenced JSON block, or the whole text without one."""
    opened = F.instr(response, V.FENCE_OPEN)
    behind = F.substring(response, opened + len(V.FENCE_OPEN), F.length(response))
    closed = F.instr(behind, V.FENCE_CLOSE)
    return _strip(F.when((opened > 0) & (closed > 0), F.substring(behind, F.lit(1), closed - 1)).otherwise(response))


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def parse_answer(text: Column) -> Column:
    """Known sections as a struct; unreadable text gives NULL."""
    return F.from_json(text, ANSWER_SCHEMA, {"mode": "PERMISSIVE"})


def _places(path: str) -> list[str]:
    """The metadata may stand beside the summary or inside it."""
    return [f"$.loan_summary.{path}"] + ([f"$.{path}"] if path.startswith("metadata.") else [])


def _kind(doc: Column, path: str) -> Column:
    """string / number / object / array / null of a path, NULL when absent."""
    name = F.coalesce(*[F.schema_of_variant(F.try_variant_get(doc, p, "variant")) for p in _places(path)])
    return let(name, lambda n: (
        F.when(n == "STRING", "string").when(n.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(n == "VOID", "null").when(n.startswith("OBJECT"), "object")
        .when(n.startswith("ARRAY"), "array").when(n.isNotNull(), F.lower(n))))


def _value(doc: Column, path: str, kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in _places(path)])


def _findings(doc: Column, kinds: Column) -> Column:
    """`kinds` holds the kind of every required path, in order."""
    kind = {path: kinds[i] for i, (path, _) in enumerate(V.SUMMARY_REQUIRED)}
    found = []
    for path, wanted in V.SUMMARY_REQUIRED:
        found.append(F.when(kind[path].isNull(), f"error:missing:{path}"))
        found.append(F.when(kind[path] != wanted, f"error:type:{path}"))
    for path, allowed in V.SUMMARY_ALLOWED.items():
        found.append(F.when((kind[path] == "string") & ~_value(doc, path, "string").isin(allowed), f"error:value:{path}"))
    for path in V.SUMMARY_RANGES:
        both = (kind[path + ".min"] == "number") & (kind[path + ".max"] == "number")
        inverted = _value(doc, path + ".min", "double") > _value(doc, path + ".max", "double")
        found.append(F.when(both & inverted, f"warning:range:{path}"))
    for path in V.SUMMARY_DATES:
        dated = _value(doc, path, "string").rlike(V.ISO_DATE_TIME)
        found.append(F.when((kind[path] == "string") & ~dated, f"warning:date:{path}"))
    return F.array_compact(F.array(*found))


def summary_messages(text: Column) -> Column:
    """Findings about a summary document, in rule order.

    missing / type / value findings are errors, range / date findings warnings.
    The document is parsed once and each path is looked at once."""
    def of(doc):
        kinds = F.array(*[_kind(doc, path) for path, _ in V.SUMMARY_REQUIRED])
        return F.when(doc.isNull(), F.array(F.lit("error:json"))).otherwise(let(kinds, lambda k: _findings(doc, k)))

    return let(F.try_parse_json(text), of)


def summary_status(messages: Column) -> Column:
    return (F.when(F.exists(messages, lambda m: m.startswith("error:")), "error")
            .when(F.size(messages) > 0, "warning").otherwise("valid"))


def quality_messages(answer: Column) -> Column:
    """Quality section of an answer under either of its two names."""
    return F.coalesce(F.to_json(answer["data_quality"]), F.to_json(answer["data_confidence"]))


_TASK = (
    "次のローン商品データを読み、消費者向けの要約を JSON だけで返してください。"
    "数値は変更せず、推測は加えないでください。"
)


def _layout() -> str:
    """The fields of an answer by section, as the schema has them."""
    sections = re.findall(r"(\w+) struct<(.*?)>(?:,(?=\w+ (?:struct|map))|,data_quality|$)", ANSWER_SCHEMA)
    return "; ".join(f"{name}(" + ", ".join(re.findall(r"(\w+):", body)) + ")" for name, body in sections)


def prompt(institution: Column, url: Column, title: Column, structured: Column) -> Column:
    """One request text per page: task, source, data and the sections wanted."""
    return F.concat(
        F.lit(_TASK), F.lit("\n機関: "), institution, F.lit("\nURL: "), url, F.lit("\n題名: "), F.coalesce(title, F.lit("")),
        F.lit("\nデータ: "), F.to_json(structured), F.lit("\n項目: " + _layout()),
    )
