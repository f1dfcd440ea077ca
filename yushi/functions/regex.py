"""Small column helpers for ordered first-match and collect-all patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# only "\n" ends a line for ".", as in the pattern dialect of fixed_values
_FLAGS = "(?d)"


def let(value: Column, make) -> Column:
    """make(value) with `value` computed once, however often `make` uses it.

    Keeps nested first-match expressions linear in size: written out, every use
    of a match would repeat its pattern, and repeats multiply with nesting."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def once(value: Column) -> Column:
    """The same value, computed once per row however many columns read from it.

    Reading the fields of a struct expression would otherwise copy its pattern
    matching into every reader when projections are merged."""
    return let(value, lambda v: v)


def hit(text: Column, pattern: str) -> Column:
    """First match as text, NULL without a match."""
    return let(F.regexp_extract(text, _FLAGS + pattern, 0), lambda h: F.when(h != "", h))


def group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, _FLAGS + pattern, i)


def all_hits(text: Column, pattern: str, i: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(i))


def has_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for w in words:
        cond = cond | text.contains(w)
    return cond


def pair(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def ordered(lo: Column, hi: Column) -> Column:
    return pair(F.least(lo, hi), F.greatest(lo, hi))


def no_pair(kind: str) -> Column:
    return F.lit(None).cast(f"struct<lo:{kind},hi:{kind}>")


def span(values: Column) -> Column:
    """(min, max) of an array, NULL for an empty one."""
    return let(values, lambda v: F.when(F.size(v) > 0, pair(F.array_min(v), F.array_max(v))))


def _filled(text: Column) -> Column:
    """NULL for the empty text a pattern gives without a match: a failing cast
    inside a higher-order function costs an exception per row."""
    return let(text, lambda t: F.when(t != "", t))


def num(text: Column) -> Column:
    return _filled(text).try_cast("double")


def comma_num(text: Column) -> Column:
    return F.replace(_filled(text), F.lit(","), F.lit(".")).try_cast("double")


def whole(text: Column) -> Column:
    return F.replace(_filled(text), F.lit(","), F.lit("")).try_cast("bigint")


def small(text: Column) -> Column:
    return _filled(text).try_cast("int")


def two(text: Column, pattern: str, parse, make) -> Column:
    """First match of a two-group pattern, parsed and combined."""
    return let(F.regexp_extract(text, _FLAGS + pattern, 0), lambda h: F.when(
        h != "", let(pair(parse(group(h, pattern, 1)), parse(group(h, pattern, 2))), lambda p: make(p["lo"], p["hi"]))))


def one(text: Column, pattern: str, parse, make) -> Column:
    return let(F.regexp_extract(text, _FLAGS + pattern, 0), lambda h: F.when(
        h != "", let(parse(group(h, pattern, 1)), make)))


def pick(label_words, text: Column, other) -> Column:
    """Ordered keyword rules: the first rule with a contained word gives the label."""
    out = None
    for label, words in label_words:
        cond = has_any(text, words)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(other)
