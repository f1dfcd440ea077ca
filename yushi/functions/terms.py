"""Loan terms in months and age limits as (lo, hi) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import all_hits, group, has_any, hit, let, one, pair, small, span, two


def _ints(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(all_hits(text, pattern, 1), small), lambda x: x.isNotNull())


def strict(text: Column, default: Column) -> Column:
    """Fourteen ordered forms; one-sided forms start at the fixed shortest term."""
    shortest = F.lit(V.STRICT_MIN_TERM)

    def months(kind, pattern):
        if kind == "ym":
            return two(text, pattern, small, lambda y, m: pair(shortest, y * 12 + m))
        if kind == "m_y":
            return two(text, pattern, small, lambda m, y: pair(m, y * 12))
        if kind == "m_m":
            return two(text, pattern, small, pair)
        factor = 12 if kind == "y" else 1
        return one(text, pattern, small, lambda x: pair(shortest, x * factor))

    return F.coalesce(*[months(k, p) for k, p in V.STRICT_TERMS], default)


def collect(text: Column, shortest: int) -> Column:
    """Shortest and longest of all terms, those below `shortest` only if alone.

    Every qualified form (期間…年, 最長…年, …年以内) names a number that the plain
    form names as well, so the two plain forms find the whole set."""
    years = F.filter(_ints(text, V.ANY_YEARS), lambda x: x.between(*V.COLLECT_YEARS))
    months = F.filter(_ints(text, V.ANY_MONTHS), lambda x: x.between(*V.COLLECT_MONTHS))
    found = F.concat(months, F.transform(years, lambda y: y * 12))
    return let(found, lambda f: F.coalesce(
        span(F.filter(f, lambda x: x.between(shortest, V.COLLECT_MONTHS[1]))), span(f)))


def simple(text: Column) -> Column:
    def both_years(h):
        first, last = (small(group(h, V.SIMPLE_TERM_YEARS, i)) for i in (1, 2))
        return F.when(h.isNotNull(), pair(F.when(h.contains("月"), first).otherwise(first * 12), last * 12))

    return F.coalesce(
        two(text, V.SIMPLE_TERM_MONTH_YEAR, small, lambda m, y: pair(m, y * 12)),
        one(text, V.SIMPLE_TERM_LONGEST, small, lambda y: pair(F.lit(V.SIMPLE_MIN_TERM), y * 12)),
        let(hit(text, V.SIMPLE_TERM_YEARS), both_years),
    )


def from_cell(cell: Column) -> Column:
    years = F.filter(_ints(cell, V.ANY_YEARS), lambda x: x.between(*V.CELL_YEARS))
    months = F.filter(_ints(cell, V.KE_MONTHS), lambda x: x.between(*V.CELL_MONTHS))
    longest = F.array_max(F.concat(months, F.transform(years, lambda y: y * 12)))
    return let(longest, lambda m: F.when(m.isNotNull(), pair(F.lit(V.SIMPLE_MIN_TERM), m)))


def longest(text: Column) -> Column:
    """Longest term named in a normalised text."""
    found = F.concat(_ints(text, V.ANY_MONTHS), F.transform(_ints(text, V.ANY_YEARS), lambda y: y * 12))
    return F.when(~has_any(text, V.TERM_NONE_WORDS), F.array_max(found))


def labelled_years(cell: Column) -> Column:
    return one(cell, V.ANY_YEARS, small, lambda y: pair(F.lit(V.STRICT_MIN_TERM), y * 12))


# ------------------------------------------------------------------------ ages
def ages_strict(text: Column) -> Column:
    tries = [two(text, p, small, lambda a, b, d=d: pair(a, b + d)) for p, d in V.STRICT_AGES]
    return F.coalesce(*tries, pair(F.lit(V.STRICT_AGE[0]), F.lit(V.STRICT_AGE[1])))


def ages_loose(text: Column) -> Column:
    """Either side may be missing."""
    upper = let(hit(text, V.AGE_TO), lambda h: F.coalesce(small(group(h, V.AGE_TO, 1)), small(group(h, V.AGE_TO, 2))))
    return pair(small(group(text, V.AGE_FROM, 1)), upper)


def ages_from_cell(cell: Column) -> Column:
    upper = F.coalesce(small(group(cell, V.CELL_AGE_BELOW, 1)) - 1, F.lit(V.CELL_AGE_MAX))
    return one(cell, V.CELL_AGE_FROM, small, lambda a: pair(a, upper))
