"""Plausibility checks, defaults, units and common keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yushi import fixed_values as V
from yushi.functions.regex import once

RANGED = {
    "rate": ("min_interest_rate", "max_interest_rate"),
    "amount": ("min_loan_amount", "max_loan_amount"),
    "term": ("min_loan_term_months", "max_loan_term_months"),
    "age": ("min_age", "max_age"),
}


def spread(df: DataFrame, **pairs: Column) -> DataFrame:
    """(lo, hi) structs to the usual min/max columns."""
    cols = {f"_{k}": once(p) for k, p in pairs.items()}
    out = df.withColumns(cols)
    flat = {}
    for k in pairs:
        lo, hi = RANGED[k]
        flat[lo], flat[hi] = F.col(f"_{k}.lo"), F.col(f"_{k}.hi")
    return out.withColumns(flat).drop(*cols)


def _by_key(table: dict, key: Column, other=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other) if other is not None else out


def sanity(df: DataFrame, loan_type: Column) -> DataFrame:
    """Drop odd rates, complete amounts, order terms, fill ages (rates in percent)."""
    c = F.col
    odd = ((c("min_interest_rate") > c("max_interest_rate")) | (c("min_interest_rate") < V.RATE_BAND[0])
           | (c("max_interest_rate") > V.RATE_BAND[1]))
    keep = F.coalesce(~odd, F.lit(True))
    known = F.coalesce(c("max_loan_amount"), F.lit(0)) != 0
    no_floor = (F.coalesce(c("min_loan_amount"), F.lit(0)) == 0) | (c("min_loan_amount") > c("max_loan_amount"))
    swap = ((c("min_loan_term_months") > c("max_loan_term_months"))
            & (c("min_loan_term_months") != 0) & (c("max_loan_term_months") != 0))
    kind = F.trim(F.coalesce(loan_type, F.lit("")))
    age = [_by_key({k: F.lit(v[i]) for k, v in V.AGE_BY_TYPE.items()}, kind, F.lit(V.AGE_OTHER[i])) for i in (0, 1)]
    return df.withColumns({
        "min_interest_rate": F.when(keep, c("min_interest_rate")),
        "max_interest_rate": F.when(keep, c("max_interest_rate")),
        "min_loan_amount": F.when(known & no_floor, F.least(c("max_loan_amount"), F.lit(V.AMOUNT_FLOOR_FILL)))
        .otherwise(c("min_loan_amount")),
        "min_loan_term_months": F.when(swap, c("max_loan_term_months")).otherwise(c("min_loan_term_months")),
        "max_loan_term_months": F.when(swap, c("min_loan_term_months")).otherwise(c("max_loan_term_months")),
        "min_age": F.coalesce("min_age", age[0]),
        "max_age": F.coalesce("max_age", age[1]),
        "min_loan_amount_imputed": F.coalesce(known & no_floor, F.lit(False)),
        "min_age_imputed": c("min_age").isNull(),
        "max_age_imputed": c("max_age").isNull(),
    })


def imputed_fields(names) -> Column:
    """Names of the columns that a default has filled, in order."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.col(f"{n}_imputed"), n) for n in names])), ",")


def swap_inverted(df: DataFrame) -> DataFrame:
    """Exchange inverted rate, amount and term pairs."""
    cols = {}
    for key in ("rate", "amount", "term"):
        lo, hi = RANGED[key]
        inverted = F.col(lo) > F.col(hi)
        cols[lo] = F.when(inverted, F.col(hi)).otherwise(F.col(lo))
        cols[hi] = F.when(inverted, F.col(lo)).otherwise(F.col(hi))
    return df.withColumns(cols)


def fill(df: DataFrame, defaults: dict, zero_is_missing: bool = False) -> DataFrame:
    """Complete missing columns and mark them with `<name>_imputed`."""
    cols = {}
    for name, value in defaults.items():
        missing = F.col(name).isNull() | (F.col(name) == 0) if zero_is_missing else F.col(name).isNull()
        cols[f"{name}_imputed"] = missing & value.isNotNull()
        cols[name] = F.when(missing & value.isNotNull(), value).otherwise(F.col(name))
    return df.withColumns(cols)


def category_defaults(category: Column) -> dict:
    out = {}
    for j, names in enumerate((RANGED["amount"], RANGED["term"])):
        for i in (0, 1):
            kind = "bigint" if j == 0 else "int"
            out[names[i]] = _by_key({k: F.lit(v[j][i]).cast(kind) for k, v in V.CATEGORY_DEFAULTS.items()}, category)
    return out


def catalogue_defaults(category: Column) -> dict:
    out = {}
    for i in (0, 1):
        out[RANGED["rate"][i]] = _by_key({k: F.lit(v[i]) for k, v in V.CATALOGUE_RATE_DEFAULTS.items()}, category,
                                         F.lit(V.CATALOGUE_RATE_OTHER[i]))
        out[RANGED["amount"][i]] = _by_key({k: F.lit(v[i]).cast("bigint") for k, v in V.CATALOGUE_AMOUNT_DEFAULTS.items()},
                                           category, F.lit(V.CATALOGUE_AMOUNT_OTHER[i]).cast("bigint"))
        out[RANGED["age"][i]] = F.lit(V.CATALOGUE_AGE[i])
    out["guarantor_requirements"] = F.lit(V.GUARANTOR_DEFAULT)
    out["income_requirements"] = F.lit(V.INCOME_DEFAULT)
    return out


def type_default(kind: Column, what: str) -> Column:
    """(lo, hi) default of a product type; what = rate, amount or term."""
    j, cast = {"rate": (0, "double"), "amount": (1, "bigint"), "term": (2, "int")}[what]
    make = lambda v: F.struct(F.lit(v[j][0]).cast(cast).alias("lo"), F.lit(v[j][1]).cast(cast).alias("hi"))
    return _by_key({k: make(v) for k, v in V.TYPE_DEFAULTS.items()}, kind, make(V.TYPE_DEFAULT_OTHER))


def group_rate(kind: Column) -> Column:
    make = lambda v: F.struct(F.lit(v[0]).alias("lo"), F.lit(v[1]).alias("hi"))
    return _by_key({k: make(v) for k, v in V.GROUP_RATES.items()}, kind)


# ----------------------------------------------------------------------- units
def months_to_years(months: Column) -> Column:
    """Whole years, at least one; 0 and NULL stay unknown."""
    return F.when(months != 0, F.greatest(F.lit(1), F.floor(months / 12).cast("int")))


def fraction_to_percent(x: Column) -> Column:
    return F.round(x * 100, 6)


def percent_to_fraction(x: Column) -> Column:
    return F.round(x / 100, 8)


def percent_text(percent: Column) -> Column:
    """Three decimals at most, no closing zeros, full-width sign."""
    digits = F.round(percent, 3).try_cast("decimal(12,3)").cast("string")
    return F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit("％"))


def stored_rate(percent: Column) -> Column:
    return percent.try_cast("decimal(6,4)")


# ----------------------------------------------------------------- common keys
def harmonize(df: DataFrame) -> DataFrame:
    """Give every stored key its value from whichever name a source used."""
    cols = {}
    for key in V.STRUCTURED_KEYS:
        names = [n for n in [key, *V.KEY_SYNONYMS.get(key, [])] if n in df.columns]
        if names:
            cols[key] = F.coalesce(*[F.col(n) for n in names])
    return df.withColumns(cols)


def dropped_keys(df: DataFrame) -> Column:
    """How many values of a row would be lost without the common keys."""
    lost = F.lit(0)
    for key, names in V.KEY_SYNONYMS.items():
        present = [F.col(n) for n in names if n in df.columns]
        if present:
            stored = F.col(key).isNull() if key in df.columns else F.lit(True)
            lost = lost + (stored & F.coalesce(*present).isNotNull()).cast("int")
    return lost


def structured(df: DataFrame) -> Column:
    """The stored record: 22 keys, absent ones NULL."""
    return F.struct(*[(F.col(k) if k in df.columns else F.lit(None).cast("string")).alias(k) for k in V.STRUCTURED_KEYS])


def merge_fields(fields: dict, priority: Column) -> dict:
    """Brochure values win for the profile's keys when present.

    `fields` maps a key to its (page column, brochure column)."""
    return {k: F.when(F.array_contains(priority, k) & sheet.isNotNull(), sheet).otherwise(page)
            for k, (page, sheet) in fields.items()}
