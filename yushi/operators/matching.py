"""Joins on names, paths and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.sources import seeds

_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def profile_path(path: Column) -> Column:
    """Longest profile prefix of a path, NULL without one."""
    out = F.lit(None).cast("string")
    for prefix in sorted((p[0] for p in V.PATH_PROFILES), key=len):
        out = F.when(path.startswith(prefix), prefix).otherwise(out)
    return out


def exact_path(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def first_keyword(url: Column, table, other=None) -> Column:
    out = None
    for word, label in table:
        out = F.when(url.contains(word), label) if out is None else out.when(url.contains(word), label)
    return out if other is None else out.otherwise(other)


def rate_slug(url: Column) -> Column:
    return first_keyword(F.coalesce(url, F.lit("")), V.RATE_SLUG_BY_KEYWORD)


def rate_group(url: Column) -> Column:
    return first_keyword(F.lower(url), V.RATE_GROUP_BY_KEYWORD, "default")


def with_profiles(df: DataFrame, url: str) -> DataFrame:
    """Add the profile found by longest prefix (seed table of twelve rows)."""
    seed = seeds.path_profiles(df.sparkSession)
    return (df.withColumn("profile_path", profile_path(url_path(F.col(url))))
            .join(F.broadcast(seed), "profile_path", "left"))


def with_exact_profiles(df: DataFrame, path: str) -> DataFrame:
    """Add the profile of exactly this path (seed table of five rows)."""
    seed = seeds.exact_profiles(df.sparkSession).select(
        F.col("profile_path").alias(path), F.col("profile_type").alias("exact_type"), F.col("profile_category").alias("exact_category"))
    return df.join(F.broadcast(seed), path, "left")


def with_file_profiles(df: DataFrame, file: str) -> DataFrame:
    """Add the profile of the brochure file (seed table of six rows)."""
    seed = seeds.file_profiles(df.sparkSession).select(F.col("file_name").alias(file), F.col("profile_name").alias("file_product"))
    return df.join(F.broadcast(seed), file, "left")


# ------------------------------------------------------------ web and brochure
def _cut(names: DataFrame, name: str, part: str, others: DataFrame, other: str) -> DataFrame:
    """Rows of names with each substring that is as long as one of the other names: linear in the name."""
    sizes = others.agg(F.collect_set(F.length(other))).scalar()
    sized = names.withColumn("_k", F.explode(sizes)).where((F.col("_k") > 0) & (F.col("_k") <= F.length(name)))
    at = F.sequence(F.lit(1), F.length(name) - F.col("_k") + 1)
    pieces = F.array_distinct(F.transform(at, lambda i: F.substring(F.col(name), i, F.col("_k"))))
    return sized.withColumn(part, F.explode(pieces)).drop("_k")


def match_names(web: DataFrame, brochures: DataFrame) -> DataFrame:
    """First web product (by position) whose name contains or is contained in a
    brochure's name, or contains one of its aliases, within an institution.

    Containment is an equi-join on substrings: a name holds another exactly when
    the other equals one of its substrings.  Names are made distinct and the
    substring index keeps one position per entry, so neither a common word nor a
    hot institution can multiply rows."""
    key = "institution_id"
    names = web.groupBy(key, "web_name").agg(F.min("web_pos").alias("web_pos"))
    wanted = brochures.select(key, "brochure_name").distinct()
    alias_map = F.create_map(*[F.lit(x) for k, v in V.NAME_ALIASES.items() for x in (k, "|".join(v))])
    own = F.array(F.col("brochure_name"))
    aliases = F.split(F.try_element_at(alias_map, F.col("brochure_name")), r"\|")
    parts = wanted.select(key, "brochure_name", F.explode(F.array_union(
        own, F.coalesce(aliases, F.array().cast("array<string>")))).alias("part"))
    index = (_cut(names, "web_name", "part", parts, "part")
             .groupBy(key, "part").agg(F.min("web_pos").alias("web_pos")))
    inside_web = parts.join(index, [key, "part"]).select(key, "brochure_name", "web_pos")
    inside_brochure = (_cut(wanted, "brochure_name", "web_name", names, "web_name")
                       .join(names, [key, "web_name"]).select(key, "brochure_name", "web_pos"))
    return (inside_web.unionByName(inside_brochure).groupBy(key, "brochure_name")
            .agg(F.min("web_pos").alias("web_pos")))


def merge_web(web: DataFrame, brochures: DataFrame, fields) -> DataFrame:
    """Brochure rows with the web values of their matched product where present."""
    matched = match_names(web, brochures)
    found = matched.join(web.select("institution_id", "web_pos", *[F.col(f).alias(f"web_{f}") for f in fields]),
                         ["institution_id", "web_pos"])
    out = brochures.join(found, ["institution_id", "brochure_name"], "left")
    return out.select(
        *[c for c in brochures.columns if c not in fields],
        *[F.coalesce(f"web_{f}", f).alias(f) for f in fields],
        F.col("web_pos").isNotNull().alias("web_source"))


# -------------------------------------------------------------- rate fallback
def fallback_rate(page: Column, brochure: Column, table: Column, variant: Column, variant_rate: Column) -> Column:
    """Page, else brochure, else rate table; a complete variant rate wins over all."""
    complete = variant.isNotNull() & variant_rate["lo"].isNotNull() & variant_rate["hi"].isNotNull()
    return F.when(complete, variant_rate).otherwise(F.coalesce(page, brochure, table))
