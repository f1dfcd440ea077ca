"""Loan amounts in yen as (lo, hi) structs, NULL when nothing was found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import all_hits, group, hit, let, one, pair, span, two, whole

MAN, OKU = 10_000, 100_000_000
_YEN = "bigint"


def man(text: Column) -> Column:
    return whole(text) * MAN


def _unit(unit: Column) -> Column:
    return let(unit, lambda u: F.when(u == "億", F.lit(OKU)).when(u == "万", F.lit(MAN)).otherwise(F.lit(1)).cast(_YEN))


def _scaled(number: Column, unit: Column) -> Column:
    """Amount with a decimal part and a unit, cut to whole yen."""
    return F.floor(F.replace(number, F.lit(","), F.lit("")).try_cast("double") * _unit(unit)).cast(_YEN)


def strict(text: Column, default: Column) -> Column:
    """Upper limit first (in 万円, in 円), then ranges, then `default`.

    The first amount behind a limit word wins even when it opens a range."""
    floor_amount = F.lit(V.STRICT_MIN_AMOUNT).cast(_YEN)

    def ranged(pattern, parse):
        return let(two(text, pattern, parse, pair), lambda p: F.when(p["hi"] >= V.STRICT_REPAYMENT_BELOW, p))

    return F.coalesce(
        one(text, V.STRICT_MAX_MAN, man, lambda x: pair(floor_amount, x)),
        one(text, V.STRICT_MAX_YEN, whole, lambda x: pair(floor_amount, x)),
        ranged(V.STRICT_RANGE_MAN, man), ranged(V.STRICT_RANGE_YEN, whole), default,
    )


def collect(text: Column) -> Column:
    """All amounts named as limits or ranges; a single one is an upper limit."""
    def single(pattern):
        return F.transform(all_hits(text, pattern), lambda h: _scaled(group(h, pattern, 1), group(h, pattern, 2)))

    ends = F.flatten(F.transform(all_hits(text, V.COLLECT_RANGE), lambda h: F.array(
        _scaled(group(h, V.COLLECT_RANGE, 1), group(h, V.COLLECT_RANGE, 2)),
        _scaled(group(h, V.COLLECT_RANGE, 3), group(h, V.COLLECT_RANGE, 4)))))
    named = F.filter(
        F.concat(single(V.COLLECT_UP_TO), ends, single(V.COLLECT_LOAN), single(V.COLLECT_HIGHEST),
                 single(V.COLLECT_LARGEST)),
        lambda x: x > V.COLLECT_ABOVE)
    any_amount = F.filter(single(V.COLLECT_ANY), lambda x: x >= V.COLLECT_ABOVE)
    found = span(let(named, lambda n: F.when(F.size(n) > 0, n).otherwise(any_amount)))
    return let(found, lambda p: F.when(p["lo"] == p["hi"], pair(F.lit(None).cast(_YEN), p["hi"])).otherwise(p))


def simple(text: Column) -> Column:
    up_to = lambda x: pair(F.lit(V.SIMPLE_MIN_AMOUNT).cast(_YEN), x)
    return F.coalesce(
        two(text, V.SIMPLE_AMOUNT_RANGE, man, pair),
        one(text, V.SIMPLE_AMOUNT_UP_TO, man, up_to),
        one(text, V.SIMPLE_AMOUNT_HIGHEST, man, up_to),
    )


def from_cell(cell: Column) -> Column:
    """以上…以下 range, raised by amounts listed behind it; or 最高."""
    behind = F.get(F.split(cell, "万円以下"), F.lit(1))
    listed = cell.contains("、") | behind.contains("万円")
    extra = F.when(listed, F.array_max(F.transform(all_hits(behind, V.CELL_AMOUNT_MAN, 1), man)))
    return F.coalesce(
        two(cell, V.CELL_AMOUNT_RANGE, man, lambda lo, hi: pair(lo, F.greatest(hi, extra))),
        one(cell, V.CELL_AMOUNT_HIGHEST, man, lambda x: pair(F.lit(V.CELL_MIN_AMOUNT).cast(_YEN), x)),
    )


def from_lines(text: Column) -> Column:
    """Smallest lower and largest upper amount over the labelled lines of a text."""
    def in_band(x):
        return let(x, lambda v: F.when(v.between(*V.LINE_BAND), v))

    def value(h, pattern, i=1):
        return whole(group(h, pattern, i)) * _unit(group(h, pattern, i + 1))

    def first(line, pattern):
        return let(hit(line, pattern), lambda h: value(h, pattern))

    def positive(x):
        return let(x, lambda v: F.when(v > 0, v))

    def line_amounts(line):
        return let(hit(line, V.LINE_RANGE), lambda ranged: with_range(line, ranged))

    def with_range(line, ranged):
        ups = F.transform(all_hits(line, V.LINE_UP_TO), lambda h: value(h, V.LINE_UP_TO))
        froms = F.filter(F.transform(all_hits(line, V.LINE_FROM), lambda h: value(h, V.LINE_FROM)), lambda x: x > 0)
        named = [in_band(first(line, p)) for p in (V.LINE_LARGEST, V.LINE_LIMIT)]
        lo = F.when(ranged.isNotNull(), positive(value(ranged, V.LINE_RANGE, 1))).otherwise(
            in_band(F.get(froms, F.lit(0))))
        hi = F.when(ranged.isNotNull(), positive(value(ranged, V.LINE_RANGE, 3))).otherwise(
            F.array_max(F.array(in_band(F.try_element_at(ups, F.lit(-1))), *named)))
        return pair(lo, hi)

    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(V.LINE_LABEL))
    ends = let(F.transform(lines, line_amounts), lambda found: pair(
        F.array_min(F.transform(found, lambda p: p["lo"])), F.array_max(F.transform(found, lambda p: p["hi"]))))
    return let(ends, lambda p: F.when(p["lo"].isNotNull() | p["hi"].isNotNull(), p))


def from_web_cell(cell: Column) -> Column:
    return F.coalesce(
        two(cell, V.WEB_AMOUNT_RANGE, man, pair),
        one(cell, V.WEB_AMOUNT_UP_TO, man, lambda x: pair(F.lit(None).cast(_YEN), x)),
    )


def single(text: Column) -> Column:
    """The one amount a normalised text stands for; labelled limits come first."""
    def value(pattern):
        return let(hit(text, pattern), lambda h: F.when(
            h.isNotNull(), whole(group(h, pattern, 1)) * _unit(group(h, pattern, 2))))

    return let(F.coalesce(value(V.ONE_AMOUNT_LABELLED), value(V.ONE_AMOUNT_ANY)), lambda x: F.when(x > 0, x))


def labelled_limit(cell: Column) -> Column:
    return two(cell, V.LABELLED_LIMIT_RANGE, man, pair)
