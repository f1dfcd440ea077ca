"""Seed tables: institutions and source profiles (fixed, a few rows each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yushi import fixed_values as V


def institutions(spark: SparkSession) -> DataFrame:
    rows = [(i, code, name, kana, [code, *others], "active") for i, code, name, kana, others in V.INSTITUTIONS]
    return spark.createDataFrame(
        rows, "institution_id long, institution_code string, institution_name string, "
              "institution_name_kana string, codes array<string>, status string")


def code_aliases(spark: SparkSession) -> DataFrame:
    return institutions(spark).select("institution_id", F.explode("codes").alias("institution_code"))


def path_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.PATH_PROFILES, "profile_path string, profile_name string, profile_type string, profile_category string, "
                         "hints array<string>, keywords array<string>, brochure_keys array<string>, brochure_file string")


def exact_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.EXACT_PATH_PROFILES, "profile_path string, profile_type string, profile_category string")


def file_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        V.FILE_PROFILES, "file_name string, profile_name string, profile_type string, profile_category string, "
                         "hints array<string>, keywords array<string>, brochure_keys array<string>")


def catalogue_products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.CATALOGUE_PRODUCTS, "product_id string, name string, category string, cat_code string")
