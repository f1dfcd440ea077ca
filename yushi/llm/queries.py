"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from yushi.llm import alignment, collocations, decontaminate, jaccard, kernel, language, licenses, lines, mixing, quality, suffixes, tokens, urls
from yushi.llm.oracle import ORACLE_SQL
from yushi.llm.tables import read


def op1_quality_rules(spark, sf_dir):
    return quality.judged(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_license_scan(spark, sf_dir):
    return licenses.report(read(spark, sf_dir, "documents"))


def op4_mix_sources(spark, sf_dir):
    return mixing.report(spark.read.parquet(f"{sf_dir}/documents.parquet"))  # no Python task, so none is made ready


def op5_url_filter(spark, sf_dir):
    return urls.judged(read(spark, sf_dir, "pages"))


def op6_repeated_substrings(spark, sf_dir):
    return suffixes.report(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return lines.line_report(read(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language.report(read(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard.report(read(spark, sf_dir, "documents"))


def op10_token_output(spark, sf_dir):
    return tokens.encode_report(read(spark, sf_dir, "documents"))


def op11_quality_classifier(spark, sf_dir):
    return kernel.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_collocations(spark, sf_dir):
    return collocations.report(read(spark, sf_dir, "documents"))


def op13_token_alignment(spark, sf_dir):
    return alignment.report(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_url_filter": op5_url_filter,
    "op6_repeated_substrings": op6_repeated_substrings,
    "op7_line_dedup": op7_line_dedup,
    "op8_language_id": op8_language_id,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_token_output": op10_token_output,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_collocations": op12_collocations,
    "op13_token_alignment": op13_token_alignment,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
