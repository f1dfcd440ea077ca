"""Interest rate extraction, all results in percent.

Every function maps a text column to a (lo, hi) struct, NULL when nothing was
found.  All of them are plain column expressions: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import (
    all_hits, comma_num, group, has_any, let, num, one, ordered, pair, span, two,
)

_MARK = chr(1)


def _same(x: Column) -> Column:
    return pair(x, x)


def values_without_context(text: Column, pattern: str, reach: int, words) -> Column:
    """Numbers whose surroundings (`reach` characters each side) hold none of `words`.

    Matches are fenced with a mark character and split off, so odd pieces are the
    matches; running lengths give each match its place in the original text.
    """
    pieces = F.split(F.regexp_replace(text, "(?d)(?:" + pattern + ")", _MARK + "$0" + _MARK), _MARK)
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("no"),
                     F.array().cast("array<struct<at:int,piece:string>>").alias("found"))

    def step(acc, piece):
        is_match = acc["no"] % 2 == 1
        grown = F.when(is_match, F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), piece.alias("piece")))))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), (acc["no"] + 1).alias("no"),
                        grown.otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step, lambda acc: acc["found"])

    def around(m):
        first = F.greatest(m["at"] - reach, F.lit(1))
        return F.substring(text, first, m["at"] + F.length(m["piece"]) + reach - first)

    clean = F.filter(found, lambda m: ~has_any(around(m), words))
    nums = F.transform(clean, lambda m: comma_num(group(m["piece"], pattern, 1)))
    # the text holds no mark character of its own unless it is broken; then nothing fits
    return F.when(text.contains(_MARK), F.array().cast("array<double>")).otherwise(nums)


def strict(html: Column, text: Column, cells: Column, default: Column) -> Column:
    """Emphasised, yearly, then typed ranges; then table cells; then `default`."""
    def ranged(source, pattern):
        return let(two(source, pattern, num, pair), lambda p: F.when(
            ~((p["lo"] < V.RATE_REDUCTION_BELOW) & (p["hi"] < V.RATE_REDUCTION_BELOW)), p))

    firsts = F.transform(F.filter(cells, lambda c: c.contains("%")), lambda c: num(group(c, V.CELL_ONE, 1)))
    return F.coalesce(
        ranged(html, V.RATE_BOLD), ranged(text, V.RATE_YEAR_HIGH), ranged(text, V.RATE_TYPED),
        span(F.filter(firsts, lambda x: x.isNotNull())), default,
    )


def from_context(text: Column) -> Column:
    nums = values_without_context(text, V.RATE_LOOSE_ONE, V.RATE_CONTEXT, V.RATE_CONTEXT_WORDS)
    return F.coalesce(two(text, V.RATE_LOOSE_RANGE, comma_num, ordered), span(nums))


def from_rate_table(text: Column) -> Column:
    """`text` has unified dashes and waves (`text.normalize_rate_page`)."""
    nums = values_without_context(text, V.TABLE_ONE, V.TABLE_CONTEXT, V.RATE_CONTEXT_WORDS)
    kept = F.filter(nums, lambda x: x.between(*V.TABLE_BAND))
    return F.coalesce(
        two(text, V.TABLE_RANGE_TAIL, comma_num, ordered),
        two(text, V.TABLE_RANGE_BOTH, comma_num, ordered),
        let(kept, lambda k: F.when(F.size(k) >= 2, span(k))),
    )


def from_brochure(text: Column) -> Column:
    nums = F.transform(all_hits(text, V.BROCHURE_ONE, 1), num)
    return F.coalesce(two(text, V.BROCHURE_RANGE, num, ordered), span(nums))


def from_brochure_typed(text: Column) -> Column:
    """Fixed and floating rate if named, else every plausible rate."""
    named = F.filter(F.array(num(group(text, V.BROCHURE_FIXED, 1)), num(group(text, V.BROCHURE_FLOATING, 1))),
                     lambda x: x.isNotNull())
    nums = F.filter(F.transform(all_hits(text, V.BROCHURE_ONE, 1), num), lambda x: x.between(*V.BROCHURE_BAND))
    return F.coalesce(span(named), span(nums))


def simple(text: Column) -> Column:
    return F.coalesce(
        two(text, V.SIMPLE_YEAR_RANGE, num, ordered),
        two(text, V.SIMPLE_RANGE, num, ordered),
        one(text, V.SIMPLE_YEAR_ONE, num, _same),
    )


def from_cell(cell: Column) -> Column:
    """Rate of one table cell; preferential cells and odd values give NULL."""
    def fitting(found):
        return let(found, lambda p: F.when(
            p["lo"].between(*V.CELL_BAND) & p["hi"].between(*V.CELL_BAND) & (p["lo"] <= p["hi"]), p))

    found = F.coalesce(fitting(two(cell, V.CELL_RANGE, num, pair)), fitting(one(cell, V.CELL_YEAR_ONE, num, _same)))
    return F.when(~has_any(cell, V.CELL_SKIP_WORDS), found)


def from_all_cells(cells: Column) -> Column:
    """Smallest and largest first rate of the cells without discount words."""
    kept = F.filter(cells, lambda c: ~has_any(c, V.CELL_SKIP_WORDS))
    nums = F.transform(kept, lambda c: num(group(c, V.CELL_ONE, 1)))
    return span(F.filter(nums, lambda x: x.between(*V.DETAIL_BAND)))


def from_poster(text: Column) -> Column:
    nums = F.transform(all_hits(text, V.POSTER_ONE, 1), num)
    found = span(F.filter(nums, lambda x: x.between(*V.POSTER_BAND)))
    return let(found, lambda p: F.when(p.isNotNull(), pair(F.round(p["lo"], 3), F.round(p["hi"], 3))))


def _truncated(digits: Column) -> Column:
    """Two decimals, cut off in the text so that no rounding can happen."""
    return F.regexp_extract(digits, r"^\d+(?:\.\d{0,2})?", 0).try_cast("decimal(18,2)")


def cell_decimal(cell: Column) -> Column:
    """First run of digits, commas and points of a normalised cell."""
    digits = F.replace(group(cell, V.RATE_CELL_DIGITS, 1), F.lit(","), F.lit(""))
    return let(digits, lambda d: F.when(d.rlike(r"^\d+(?:\.\d+)?$"), _truncated(d)))


def cell_decimal_grouped(cell: Column) -> Column:
    digits = F.replace(group(cell, V.RATE_CELL_GROUPED, 1), F.lit(","), F.lit(""))
    return F.when(~has_any(cell, V.RATE_CELL_NONE_WORDS), _truncated(digits))


def overview(html: Column) -> Column:
    """Rate range and limit named within 20 elements of an overview heading."""
    section = F.regexp_extract(
        html, r"(?is)<h[234]\b[^>]*>[^<]*(?:" + V.OVERVIEW_HEADING + r")[^<]*</h[234]\s*>(.*?)(?:<h[234]\b|$)", 1)
    # an element's text runs to its end tag, through the elements inside; without an end tag to the next tag
    each = r"(?is)<([a-z][a-z0-9]*)\b[^>]*>(?=(.*?)</\1\s*>|([^<]*))"
    whole, direct = (F.slice(F.regexp_extract_all(section, F.lit(each), F.lit(k)), 1, 20) for k in (2, 3))
    elements = F.zip_with(whole, direct, lambda w, d: F.when(w != "", F.regexp_replace(w, r"</?[a-zA-Z!?][^>]*>", "")).otherwise(d))

    def facts(e):
        rated = F.filter(e, lambda x: has_any(x, ["金利", "利率"]) & x.rlike(V.CELL_RANGE))
        limited = F.filter(e, lambda x: x.contains("限度額") & x.rlike(V.CELL_AMOUNT_MAN))
        rate, limit = F.try_element_at(rated, F.lit(-1)), F.try_element_at(limited, F.lit(-1))
        return F.struct(
            let(rate, lambda r: F.concat(group(r, V.CELL_RANGE, 1), F.lit("%-"), group(r, V.CELL_RANGE, 2), F.lit("%")))
            .alias("rate_range"),
            F.concat(group(limit, V.CELL_AMOUNT_MAN, 1), F.lit("万円")).alias("max_limit"))

    return let(elements, facts)


def sections_by_variant(text: Column, variant: str) -> Column:
    """Line blocks from each line naming `variant` up to the next other label."""
    label = V.VARIANT_LABELS[variant]
    other = V.VARIANT_LABELS["store" if variant == "web" else "web"]

    def blocks(lines):
        last = F.size(lines)

        def block(at):
            later = F.filter(F.sequence(at, last - 1), lambda j: (j > at) & F.get(lines, j).contains(other))
            return F.array_join(F.slice(lines, at + 1, F.coalesce(F.array_min(later), last) - at), "\n")

        starts = F.filter(F.sequence(F.lit(0), last - 1), lambda i: F.get(lines, i).contains(label))
        return F.transform(starts, block)

    return let(F.split(text, "\n"), blocks)


def first_typed(pairs: Column) -> Column:
    """First non-null (lo, hi) of an array."""
    return F.try_element_at(F.filter(pairs, lambda p: p.isNotNull()), F.lit(1))


