"""Product links of a page corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page `base`."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/)", 1)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(host, href))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(host, F.lit("/"))), href)))


def discover(pages: DataFrame, url: str, html: str, path: str) -> DataFrame:
    """Distinct links one level below `path` over all pages."""
    hrefs = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    found = pages.select(F.col(url).alias("base"), F.explode(F.array_distinct(hrefs)).alias("href"))
    links = found.where(F.col("href").contains(path)).select(resolve(F.col("base"), F.col("href")).alias("link"))
    one_level = F.col("link").rlike(re.escape(path) + "[^/]+/?$")
    tail = path.rstrip("/").rsplit("/", 1)[-1]
    if tail:
        one_level = one_level & ~F.regexp_replace("link", "/+$", "").endswith(tail)
    return links.where(one_level).distinct()
